"""A Spark data source of list pages: some pages are one partition, what goes wrong is a row, caps are in the reader.

    spark.dataSource.register(ListPages)
    spark.read.format("list_pages").option("path", folder).option("max_pages", 40).load()

Options: path; max_pages (pages 1 to so many are read); max_items (links taken of one page, at most: no page needs more, as the
whole crawl's cap is not higher); link (a text that the address of a wanted link holds); pages_each (pages of a partition);
fetch ("module:function", from path and page to HTML; without it, files under path/page=N are read). A page that cannot be
read, or that has no wanted link, is a row with an error and without a link, and ends nothing. A lost task reads its pages
again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from importlib import import_module
from re import I, sub
from re import compile as pattern

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.page_tree import nodes_of, text_of

HREF = pattern(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", I)


def saved_page(path: str, page: int) -> str:
    """The HTML that was saved under path/page=N, in whatever files."""
    # Spark writes file:/x for what is file:///x elsewhere.
    system, root = fs.FileSystem.from_uri(sub(r"^file:/+", "file:///", path))
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{root}/page={page}")) if f.is_file and not f.base_name.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(page)
    return "".join(system.open_input_stream(f).read().decode() for f in found)


def links_of(html: str, link: str = "") -> Iterator[tuple[str, str]]:
    """Address and text of the links of a page with both, those whose address holds a text."""
    for node in nodes_of(html):
        if node.tag == "a" and (found := HREF.search(node.rest)):
            href, title = unescape(next(x for x in found.groups() if x is not None)), text_of(html[node.start : node.end]).strip()
            if href and title and link in href:
                yield href, title


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class ListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.link, self.fetch = options["path"], options.get("link", ""), options.get("fetch")
        self.max_pages, self.each = int(options.get("max_pages", 2)), int(options.get("pages_each", 8))
        self.max_items = int(options.get("max_items", 2**31 - 1))

    def partitions(self) -> list[InputPartition]:
        return [Pages(i, min(i + self.each - 1, self.max_pages)) for i in range(1, self.max_pages + 1, self.each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch: Callable[[str, int], str] = saved_page
        if self.fetch:
            module, name = self.fetch.split(":")
            fetch = getattr(import_module(module), name)
        for page in range(partition.first, partition.last + 1):
            try:
                html = fetch(self.path, page)
            except FileNotFoundError:
                yield page, None, None, None, "no answer"
                continue
            except Exception as e:  # whatever it is, it is this page's alone
                yield page, None, None, None, f"{type(e).__name__}: {e}"
                continue
            place = -1
            for place, (href, title) in enumerate(links_of(html, self.link)):
                if place >= self.max_items:
                    break
                yield page, place, href, title, None
            if place < 0:
                yield page, None, None, None, "no links"


class ListPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "list_pages"

    def schema(self) -> str:
        return "page int, place int, href string, title string, error string"

    def reader(self, schema) -> ListReader:
        return ListReader(dict(self.options))
