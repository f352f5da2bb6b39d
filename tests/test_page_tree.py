"""The tag-stack parser against a plain XML parse of well-formed pages, and by hand where tags are missing."""

from __future__ import annotations

import datetime as dt
import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from fathomlake.functions import extract, page_tree


def item(title, detail):
    return f'<div class="tthc-list-item x"><h3 class="item-title">{title}</h3><div class="tthc-list-item-detail">{detail}</div></div>'


def random_page(r, depth=0):
    def node(depth):
        kind = r.random()
        if depth > 5 or kind < 0.3:
            return r.choice(["a", "b &amp; c", "\n line \n", " x ", "Mở rộng"])
        inner = "".join(node(depth + 1) for _ in range(r.randint(0, 3)))
        if kind < 0.5:
            return f'<div class="{r.choice(["tthc-list-item", "q tthc-list-item-detail", "plain"])}">{inner}</div>'
        if kind < 0.7:
            return f'<span class="{r.choice(["item-title", "my-item-title-2", "z"])}">{inner}</span>'
        return f"<{(t := r.choice(['div', 'b', 'i', 'section']))}>{inner}</{t}>"

    return "<body>" + "".join(node(0) for _ in range(4)) + "</body>"


def reference(html):
    """By ElementTree: first descendants of each item, the last of items with one title."""
    texts = {}
    for div in ET.fromstring(html).iter("div"):
        if "tthc-list-item" not in div.get("class", ""):
            continue
        below = list(div.iter())[1:]
        title = next((x for x in below if "item-title" in x.get("class", "")), None)
        detail = next((x for x in below if "tthc-list-item-detail" in x.get("class", "")), None)
        if title is not None and detail is not None:
            name = "".join(title.itertext()).replace("Mở rộng", "").replace("Thu gọn", "")
            texts[" ".join(name.split())] = "\n".join(x for x in map(str.strip, "".join(detail.itertext()).splitlines()) if x)
    return list(texts.items())


def test_well_formed_pages():
    r, some = random.Random(3), 0
    for _ in range(1500):
        html = random_page(r)
        got = [(t, text) for t, _, _, text in page_tree.items_of(html)]
        assert got == reference(html), html
        some += bool(got)
    assert some > 50


def test_nested_and_unclosed():
    read = lambda html: [(t, text) for t, _, _, text in page_tree.items_of(html)]
    nested = item("A", "<div>one<div>two</div>three</div>") + item("B", "<p>x<p>y<ul><li>1<li>2</ul>")
    assert read(nested) == [("A", "onetwothree"), ("B", "xy12")]
    # A detail that is never closed goes on to the end of what holds it, not of the page.
    assert read('<main><div class="tthc-list-item"><b class=item-title>T</b><div class=\'tthc-list-item-detail\'>in</main>out') == [("T", "in")]
    # A tag that closes nothing is none; comments and scripts hold no tags.
    assert read("</div></b>" + item("C", "a</span>b<!-- <div> --><script>`<div>`</script>")) == [("C", "ab``")]
    assert read(None) == read("") == read("<div") == read("<div class='tthc-list-item'>") == []


def test_of_one_title_the_last():
    html = item("Phí", "1") + item("Hồ sơ", "old") + item("phí", "2") + item("Hồ sơ", "<b>new</b>")
    assert page_tree.items_of(html) == [("Phí", "phí", "2", "1"), ("Hồ sơ", "hồ sơ", "<b>new</b>", "new"), ("phí", "phí", "2", "2")]


def test_no_cap_and_linear(spark):
    many = "".join(item(f"t{i}", f"x{i}") for i in range(20_000))
    assert len(page_tree.items_of(many)) == 20_000
    assert page_tree.items_of("<div class='tthc-list-item'>" * 20_000) == []


def test_a_record(spark):
    html = item("Lĩnh vực", "Cũ") + item("Lĩnh vực Mở rộng", "Cư trú &amp; hộ tịch") + item("Thời hạn giải quyết", "<div><i>03 ngày</i></div><div>khác</div>") + item("Căn cứ pháp lý", "<ul><li>Luật Cư trú</ul>")
    page = spark.createDataFrame([(1, "Đăng ký tạm trú", "https://x.vn/?matt=5", html)], "page_id long, title string, url string, html string")
    r = extract.page_record(page, F.lit(dt.date(2024, 1, 31))).first()
    assert (r.linh_vuc, r.ma_thu_tuc, r.thoi_gian_ngay, r.can_cu_phap_ly) == ("Cư trú & hộ tịch", "BCA-5", 3, "Luật Cư trú")


def test_all_pages(spark, sf_dir):
    """Raw pages of the web have no such items, and none is made up."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert pages.where(F.size(page_tree.page_items(F.col("html"))) != 0).count() == 0
    for html in (r.html for r in pages.limit(50).collect()):
        nodes = page_tree.nodes_of(html)
        assert sum(n.tag == "p" for n in nodes) == html.count("<p>") and all(n.start <= n.end for n in nodes)
