"""HTML elements as rows: one Arrow pass flattens pages to a table of elements, Spark does the rest.

A page that can't be read is one row with the tag FAILED, whose text says why.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FAILED = "!failed"
#: Bytes of a page beyond which it counts as one that can't be read, where a caller wants that; pages of any length are read.
MOST_BYTES: int | None = None
#: Elements that are handed on at once, or more where a page's text is long.
ROWS = 2000
#: Letters of text that are handed on at once, about; elements in each other have the same text again and again.
LETTERS = 16 << 20
ELEMENT = "n int, parents array<int>, tag string, classes array<string>, attrs map<string,string>, text string"


def only_references(html: Column, names: tuple[str, ...] = ("lt", "gt", "amp")) -> Column:
    """html in which no character references count but these, closed by a semicolon; others (`&quot;`, `&amp` at an end) stay as written."""
    return F.regexp_replace(html, f"&(?!(?:{'|'.join(names)});)", "&amp;")


class _Elements(HTMLParser):
    """Elements, each with its number n in document order, its ancestors and where the text below it stands in all text.

    Those that have ended are handed on, some thousands at a time, as they end; what is held is what is open, and the text from there on.
    """

    def __init__(self, hand: Callable[[list[dict]], None]) -> None:
        super().__init__(convert_charrefs=True)
        self.hand = hand
        self.count = 0
        self.open: list[dict] = []
        self.ended: list[dict] = []
        self.said: list[str] = []
        self.length = self.dropped = 0  # of all text; of what isn't held any more

    def _add(self, tag: str, attrs: list[tuple[str, str | None]]) -> dict:
        e = {"n": self.count, "parents": [o["n"] for o in self.open], "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "from": self.length}
        self.count += 1
        return e

    def _end(self, ended: list[dict]) -> None:
        for e in ended:
            e["to"] = self.length
        self.ended += ended
        # longer texts are cut less often, as each time they are copied
        if len(self.ended) >= max(ROWS, (self.length - self.dropped) // 1000):
            self.hand_on()

    def hand_on(self) -> None:
        said = "".join(self.said)
        ended, few, letters = self.ended[::-1], [], 0
        while ended:
            few.append(e := ended.pop())
            e["text"] = said[e.pop("from") - self.dropped : e.pop("to") - self.dropped]
            letters += len(e["text"])
            if letters >= LETTERS or not ended:
                self.hand(few)
                few, letters = [], 0
        kept = self.open[0]["from"] if self.open else self.length
        self.ended, self.said, self.dropped = [], [said[kept - self.dropped :]], kept

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no kind that the parser knows is a comment, as HTML has it
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = self._add(tag, attrs)
        if tag in VOID:
            self._end([e])
        else:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end([self._add(tag, attrs)])

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at]["tag"] == tag:
                ended = self.open[at:]
                del self.open[at:]
                self._end(ended)
                return

    def handle_data(self, data: str) -> None:
        self.said.append(data)
        self.length += len(data)

    def finish(self) -> None:
        """What is still open ends with all text."""
        ended, self.open = self.open, []
        self._end(ended)
        self.hand_on()


def _read(html: str | None, most_bytes: int | None, hand: Callable[[list[dict]], None]) -> None:
    if None not in (html, most_bytes) and len(html) > most_bytes // 4 and len(html.encode()) > most_bytes:
        raise ValueError(f"longer than {most_bytes} bytes")
    parser, digits = _Elements(hand), sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)  # the number of a character reference may be of any length
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError, RecursionError) as error:  # what the parser raises at markup it can't follow; none is known
        raise ValueError(f"not to be read as HTML: {error}") from None
    finally:
        sys.set_int_max_str_digits(digits)
    parser.finish()


def read_page(html: str | None, most_bytes: int | None = MOST_BYTES) -> list[dict]:
    """The elements of one page in document order: n, parents, tag, attrs, text. ValueError if it can't be read.

    Text is kept once, an element's is cut out of it; character references are decoded; unclosed elements end with the one they are in.
    """
    found: list[dict] = []
    _read(html, most_bytes, found.extend)
    return sorted(found, key=lambda e: e["n"])


def _rows(key: pa.Array, found: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string())
    columns = list(zip(*((e["n"], e["parents"], e["tag"], e["attrs"].get("class", "").split(), list(e["attrs"].items()), e["text"]) for e in found), strict=True))
    return pa.RecordBatch.from_arrays([key.take(pa.array([0] * len(found), pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def elements(pages: DataFrame, key: str, html: str, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """key, n, parents, tag, classes, attrs, text: a row for each element of each page, numbered n in its order.

    Null pages have no elements. See read_page(). One page is held at a time, its elements as Arrow rows, and handed on before the next is read. key may be a struct.
    """
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(html).cast("string")).mapInArrow(_pages_read(key, most_bytes), f"`{key}` {kind}, {ELEMENT}")


def read_all(found: DataFrame, key: str) -> DataFrame:
    """Rows of elements(), where one of a page that couldn't be read is an error of the query: for results that have no row to tell it in."""
    said = F.concat(F.lit("page "), F.to_json(F.struct(key)), F.lit(" can't be read: "), "text")
    return found.withColumn("tag", F.when(F.col("tag") == FAILED, F.raise_error(said)).otherwise(F.col("tag")))


def _pages_read(key: str, most_bytes: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [key, "n", "parents", "tag", "classes", "attrs", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few: list[pa.RecordBatch] = []  # short pages go on together
            for k in range(batch.num_rows):
                own, ready = batch.column(0).slice(k, 1), []
                try:  # a page that can't be read to its end gives nothing of what came before
                    _read(batch.column(1)[k].as_py(), most_bytes, lambda found, own=own, ready=ready: ready.append(_rows(own, found, names)))
                except ValueError as error:
                    ready = [_rows(own, [{"n": 0, "parents": [], "tag": FAILED, "attrs": {}, "text": str(error)}], names)]
                while ready:
                    few.append(ready.pop(0))
                    if sum(b.num_rows for b in few) >= ROWS or sum(b.nbytes for b in few) >= LETTERS:
                        yield from pa.Table.from_batches(few).combine_chunks().to_batches()
                        few = []
            if few:
                yield from pa.Table.from_batches(few).combine_chunks().to_batches()

    return run


def inside(children: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """children with owner: the n of the owner element they stand in; owners: key, n."""
    up = children.withColumn("owner", F.explode("parents"))
    own = owners.select(F.col(key), F.col("n").alias("owner"))
    return up.join(own, [key, "owner"])
