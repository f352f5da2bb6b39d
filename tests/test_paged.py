"""The source of list pages: partitions, caps, and errors as rows."""

from __future__ import annotations

from fathomlake.sources.paged import ListPages, ListReader, Pages, links_of


def fetched(path, page):
    """Pages of two links each; the third answers nothing, the fourth fails, the fifth is empty."""
    if page == 3:
        raise FileNotFoundError(page)
    if page == 4:
        raise ConnectionError("HTTP 500")
    return "" if page == 5 else f"<a href='/tthc?matt={page}a'>one<br>{page}</a><a href=/tthc?matt={page}b>two</a><a href='/other'>x</a>"


def test_links():
    html = "<a href='/a?b=1&amp;c=2'> <b>T</b> &amp; t </a><a>no address</a><a href='/n'> </a><A HREF=\"/u\" class=z>U</A>"
    assert list(links_of(html)) == [("/a?b=1&c=2", "T & t"), ("/u", "U")]


def test_partitions_and_caps():
    reader = ListReader({"path": "x", "max_pages": "5", "pages_each": "2", "max_items": "1", "fetch": "tests.test_paged:fetched", "link": "tthc"})
    assert reader.partitions() == [Pages(1, 2), Pages(3, 4), Pages(5, 5)]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [
        (1, 0, "/tthc?matt=1a", "one1", None), (2, 0, "/tthc?matt=2a", "one2", None),
        (3, None, None, None, "no answer"), (4, None, None, None, "ConnectionError: HTTP 500"), (5, None, None, None, "no links"),
    ]


def test_read(spark, tmp_path):
    spark.dataSource.register(ListPages)
    for page in (1, 2):
        spark.createDataFrame([(f"<a href='/tthc?matt={page}{k}'>t{k}</a>",) for k in "ab"], "value string").coalesce(1).write.text(f"{tmp_path}/page={page}")
    df = spark.read.format("list_pages").options(path=f"file:{tmp_path}", max_pages=3, pages_each=1).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [(1, 0, "/tthc?matt=1a", "ta", None), (1, 1, "/tthc?matt=1b", "tb", None), (2, 0, "/tthc?matt=2a", "ta", None), (2, 1, "/tthc?matt=2b", "tb", None), (3, None, None, None, "no answer")]
