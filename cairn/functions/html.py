"""Blocks of text of HTML pages, by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that make a block, that hold no text of their own, and that never close; fixed values.
BLOCK = frozenset("title article main p h1 h2 h3 h4 h5 h6 li div section figcaption caption blockquote th td pre code summary".split())
HIDDEN = frozenset(("script", "style", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Values that make a block of a meta element, by the attribute that has them; fixed values.
META = {"name": frozenset(("description",)), "property": frozenset(("og:title", "og:description"))}
#: Elements that a new one of the same group closes; fixed values.
IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
#: Blocks of a page that are kept, and the least length of one: features of the extraction, not limits of this engine.
MOST, SHORTEST = 200, 20


def plain(pieces: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(pieces)).strip()


class _Open:
    """An element that is not closed yet: its own text, all text within it, and whether a long block was within it."""

    __slots__ = ("tag", "place", "own", "all", "holds")

    def __init__(self, tag: str, place: int):
        self.tag, self.place, self.own, self.all, self.holds = tag, place, [], [], False


class _Reader(HTMLParser):
    """Decides on each block when it ends: by then all that lies within it has been decided."""

    def __init__(self, shortest: int) -> None:
        super().__init__(convert_charrefs=True)
        self.shortest, self.hidden, self.places = shortest, 0, 0
        self.open, self.title, self.told = [_Open("", 0)], None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in HIDDEN
        self.places += 1
        if tag in VOID:
            self._void(tag, dict(attrs))
            return
        while self.open[-1].tag in IMPLIED.get(tag, ()):
            self._close()
        self.open.append(_Open(tag, self.places))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if any(e.tag == tag for e in self.open[1:]):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.open[-1].own.append(data.strip())
            self.open[-1].all.append(data.strip())

    def finish(self) -> None:
        self.close()
        while len(self.open) > 1:
            self._close()

    def _void(self, tag: str, values: dict[str, str | None]) -> None:
        known = tag == "meta" and any(values.get(name) in wanted for name, wanted in META.items())
        said = plain([(values.get("alt") if tag == "img" else values.get("content") if known else None) or ""])
        if len(said) >= self.shortest:
            self.told.append((self.places, said))
            self.open[-1].holds = True

    def _close(self) -> str:
        done, around = self.open.pop(), self.open[-1]
        around.all += done.all
        if done.tag in BLOCK:
            whole = plain(done.all)
            if done.tag == "title" and (self.title is None or done.place < self.title[0]):
                self.title = done.place, whole
            text = plain(done.own) if done.holds else whole
            if len(text) >= self.shortest:
                self.told.append((done.place, text))
            done.holds |= len(whole) >= self.shortest
        around.holds |= done.holds
        return done.tag


def html_blocks(html: str, shortest: int = SHORTEST, most: int = MOST) -> tuple[str, list[str]]:
    """The title, and the distinct blocks in the order in which they begin.

    A block that encloses another one long enough keeps only the text directly in it, so that nothing is told twice.
    """
    reader = _Reader(shortest)
    reader.feed(html)
    reader.finish()
    blocks = list(dict.fromkeys(text for _, text in sorted(reader.told)))
    return (reader.title or (0, ""))[1], blocks[:most]


def page_blocks(pages: DataFrame, shortest: int = SHORTEST, most: int = MOST) -> DataFrame:
    """(page_id, title, block_index, block): a row a block of (page_id, html) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                rows = [(i, title, k, b) for i, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True) for title, blocks in [html_blocks(html or "", shortest, most)] for k, b in enumerate(blocks)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "title", "block_index", "block"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, title string, block_index bigint, block string")


def domain(url: Column) -> Column:
    """Host of a url in lower case, without a leading www. or a trailing dot; empty where there is none."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


@F.pandas_udf(StringType())
def block_ids(record: pd.Series, index: pd.Series) -> pd.Series:
    """Ids of blocks of captured pages: ``cc-`` and 12 bytes of the BLAKE2b hash of record id and block number."""
    of = lambda r, i: "cc-" + hashlib.blake2b(f"{r}:{i}".encode(), digest_size=12).hexdigest()
    return pd.Series([of(r, i) for r, i in zip(record, index, strict=True)], dtype="str")
