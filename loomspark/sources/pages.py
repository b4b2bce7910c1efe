"""HTML to text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import storage

#: Pages that are held as Python strings at a time.
AT_ONCE = 64
SKIP = frozenset("noscript script style svg template".split())


class Reader(HTMLParser):
    """Collects text nodes outside of the skipped elements."""

    def __init__(self):
        HTMLParser.__init__(self)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, _attributes):
        self.depth += tag in SKIP

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in SKIP and self.depth > 0

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.depth:
            self.parts.append(text)


def text_of(html: str | None) -> str | None:
    """A page's text, a line for each node; null for null. An unfinished tag at the end is dropped."""
    if html is None:
        return None
    reader = Reader()
    reader.feed(html)
    lines = "\n".join(reader.parts)
    return re.sub(r"(\n\n)\n+", r"\1", lines).strip()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text_of(x.as_py()) for x in part.column(1)], pa.string())], [part.schema.names[0], "text"])
        storage.trim()


def page_text(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """Rows (identifier, text) of a column of HTML, in Arrow batches of bounded bytes."""
    storage.bound_batches(pages.sparkSession)
    schema = T.StructType([pages.schema[ident], T.StructField("text", T.StringType())])
    return pages.select(ident, html).mapInArrow(_read, schema)
