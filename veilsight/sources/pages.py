"""Pages as rows: one parse per page, everything after it is expressions on arrays.

The parse gives each page an array of elements and an array of text pieces. An element
knows the range of its descendants and of its text, and its nearest ancestors of interest,
so containment is a comparison of numbers and no page is ever joined with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..fixed_values import (
    BOILERPLATE,
    KEYWORD_CONTAINER_TAGS,
    LINK_AREAS,
    SEMANTIC_CONTAINERS,
    TEXT_BLOCKS,
)
from ..session import ship_code

NODE = (
    "id int, last int, tag string, elem_id string, classes array<string>, href string, style string, "
    "t0 int, t1 int, chars int, boiler int, area int, is_area boolean"
)
TEXT = "text string, boiler int"
PAGE_PARTS = f"nodes array<struct<{NODE}>>, texts array<struct<{TEXT}>>"

#: Bytes of pages that a task parses at once; a page is never split, so long ones go one by one.
BATCH_BYTES = 1 << 20

PAGE_TAGS = frozenset(TEXT_BLOCKS + SEMANTIC_CONTAINERS + KEYWORD_CONTAINER_TAGS + ("body", "a"))
TABLE_TAGS = frozenset(("table", "tbody", "tr", "td", "span"))

# Elements without content, and elements whose text is not prose.
_EMPTY = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr basefont "
    "bgsound command frame image isindex nextid spacer".split()
)
_SILENT = frozenset(("script", "style", "template", "rt", "rp"))


def _selectors(texts):
    """[(tag or None, id or None, classes)] of simple selectors."""
    out = []
    for text in texts:
        tag = re.match(r"[a-z0-9]*", text).group() or None
        out.append((tag, next(iter(re.findall(r"#([\w-]+)", text)), None),
                    frozenset(re.findall(r"\.([\w-]+)", text))))
    return out


class _PageParser(HTMLParser):
    """Flattens one page. Open elements are closed only by their own end tag."""

    def __init__(self, keep, boilerplate, areas):
        super().__init__(convert_charrefs=True)
        self.keep, self.boilerplate, self.areas = keep, boilerplate, areas
        self.nodes, self.texts, self.open, self.pending = [], [], [], []
        self.seen = self.chars = self.silent = 0

    @staticmethod
    def _matches(selectors, tag, elem_id, classes):
        return any(
            (t is None or t == tag) and (i is None or i == elem_id) and c <= classes
            for t, i, c in selectors
        )

    def flush(self):
        text = "".join(self.pending).strip()
        self.pending.clear()
        if text and not self.silent:
            self.texts.append((text, self.open[-1]["boiler"] if self.open else -1))
            self.chars += len(text)

    def handle_starttag(self, tag, attrs, alone=False):
        self.flush()
        values = {k: v or "" for k, v in attrs}
        classes = values.get("class", "").split()
        about = (tag, values.get("id"), frozenset(classes))
        parent = self.open[-1] if self.open else {"boiler": -1, "area": -1, "is_area": False, "id": -1}
        node = {
            "id": self.seen, "last": self.seen, "tag": tag, "elem_id": values.get("id"),
            "classes": classes, "href": values.get("href"), "style": values.get("style"),
            "t0": len(self.texts), "t1": 0, "chars": self.chars,
            "boiler": self.seen if self._matches(self.boilerplate, *about) else parent["boiler"],
            "area": parent["id"] if parent["is_area"] else parent["area"],
            "is_area": self._matches(self.areas, *about),
        }
        self.seen += 1
        self.open.append(node)
        if tag in self.keep or node["is_area"]:
            self.nodes.append(node)
        self.silent += tag in _SILENT
        if alone or tag in _EMPTY:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, alone=True)

    def _close(self):
        node = self.open.pop()
        node["last"], node["t1"] = self.seen - 1, len(self.texts)
        node["chars"] = self.chars - node["chars"]
        self.silent -= node["tag"] in _SILENT

    def handle_endtag(self, tag):
        self.flush()
        if any(n["tag"] == tag for n in reversed(self.open)):
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.pending.append(data)

    def _break(self, data):
        self.flush()

    handle_comment = handle_decl = handle_pi = _break

    def unknown_decl(self, data):
        self.flush()
        if data[:6].upper() == "CDATA[":
            self.pending.append(data[6:])
            self.flush()

    def finish(self):
        self.close()
        self.flush()
        while self.open:
            self._close()


def _parse(html, keep, boilerplate, areas):
    parser = _PageParser(keep, boilerplate, areas)
    if html:
        parser.feed(html)
        parser.finish()
    names = [part.split()[0] for part in NODE.split(", ")]
    nodes = [{n: node[n] for n in names} for node in parser.nodes]
    return nodes, [{"text": t, "boiler": b} for t, b in parser.texts]


def _portions(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``most`` bytes in a column, one row at least."""
    start = held = 0
    for at, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if at > start and held + (size or 0) > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def flatten(pages: DataFrame, keep=PAGE_TAGS, boilerplate=BOILERPLATE, areas=LINK_AREAS) -> DataFrame:
    """Adds ``nodes`` and ``texts`` in place of ``html``; page order of both is kept.

    What a Python worker holds is bounded by bytes of pages, however many come in a batch.
    """
    boiler, area = _selectors(boilerplate), _selectors(areas)
    rest = [c for c in pages.columns if c != "html"]
    parts = StructType.fromDDL(PAGE_PARTS)
    nodes_type, texts_type = [to_arrow_type(f.dataType) for f in parts]

    def parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _portions(batch, "html", BATCH_BYTES):
                parsed = [_parse(h, keep, boiler, area) for h in some.column("html").to_pylist()]
                made = [pa.array([p[0] for p in parsed], nodes_type), pa.array([p[1] for p in parsed], texts_type)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), *made], names=[*rest, *parts.names])

    ship_code(pages.sparkSession)
    return pages.mapInArrow(parse_pages, StructType([*pages.select(*rest).schema, *parts]))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")
