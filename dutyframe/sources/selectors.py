"""Pages as rows by a table function: `SELECT ... FROM pages, LATERAL read_html(html, title => 'title', links => 'count(a[href])')`.

Each named argument is a column of the result, told by a selector:

    selector          the text of the first element that it finds, white space collapsed
    selector @ name   that element's attribute
    count(selector)   how many elements it finds

A selector is parts separated by blanks, each inside the one before: tag, #id, .class, [attribute] and [attribute=value], joined without blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructType

from dutyframe.sources.html import read_page

_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)$""")
_COUNT = re.compile(r"^count\((.*)\)$", re.S)


class Selector:
    """A selector, read once for all pages."""

    def __init__(self, told: str):
        self.parts = [self._part(p) for p in told.split()]
        if not self.parts:
            raise ValueError("an empty selector finds nothing")

    @staticmethod
    def _part(told: str) -> tuple[str | None, list[tuple[str, str, str | None]]]:
        found = _PART.match(told)
        if not found:
            raise ValueError(f"no selector: {told!r}")
        wants = []
        for mark, name, value in re.findall(r"([#.\[])([\w-]+)(=[^\]]*)?", found["rest"]):
            wants.append((mark, name, value[1:].strip("'\"") if value else None))
        tag = found["tag"]
        return (None if tag in (None, "*") else tag.lower()), wants

    @staticmethod
    def _fits(part: tuple, e: dict) -> bool:
        tag, wants = part
        if tag is not None and e["tag"] != tag:
            return False
        for mark, name, value in wants:
            attrs = e["attrs"]
            if mark == "#" and attrs.get("id") != name or mark == "." and name not in attrs.get("class", "").split():
                return False
            if mark == "[" and (name not in attrs or value is not None and attrs[name] != value):
                return False
        return True

    def find(self, page: list[dict]) -> Iterator[dict]:
        """The elements that fit the last part and stand inside fitting ones, in the page's order."""
        for e in page:
            if self._fits(self.parts[-1], e):
                left = len(self.parts) - 2
                for up in reversed(e["parents"]):  # from the inside out, so each part takes the nearest that fits
                    if left >= 0 and self._fits(self.parts[left], page[up]):
                        left -= 1
                if left < 0:
                    yield e


class Column:
    """One column of the result."""

    def __init__(self, told: str):
        counted = _COUNT.match(told.strip())
        self.counts = counted is not None
        body, _, self.attribute = (counted[1] if counted else told).partition("@")
        self.attribute = self.attribute.strip()
        if self.counts and self.attribute:
            raise ValueError(f"elements are counted, not attributes: {told!r}")
        self.selector = Selector(body)

    def value(self, page: list[dict]) -> str | int | None:
        found = self.selector.find(page)
        if self.counts:
            return sum(1 for _ in found)
        first = next((e for e in found if not self.attribute or self.attribute in e["attrs"]), None)
        if first is None:
            return None
        return first["attrs"][self.attribute] if self.attribute else " ".join(first["text"].split())


class ReadHtml:
    """One row for each page: the columns asked for, and `failure`, null for a page that could be read.

    A page that can't be read, or is null, is a row whose other columns are null; it never fails the query. A selector
    that can't be read fails the query when it is planned.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, **columns: AnalyzeArgument) -> AnalyzeResult:
        if html.dataType != StringType():
            raise ValueError(f"a page is a string, not {html.dataType.simpleString()}")
        schema = StructType()
        for name, told in columns.items():
            if not told.isConstantExpression or not isinstance(told.value, str):
                raise ValueError(f"the selector of {name} is no constant string")
            schema = schema.add(name, LongType() if Column(told.value).counts else StringType())
        return AnalyzeResult(schema=schema.add("failure", StringType()))

    def __init__(self) -> None:
        self.columns: list[Column] | None = None

    def eval(self, html: str | None, **columns: str):
        if self.columns is None:
            self.columns = [Column(c) for c in columns.values()]
        try:
            if html is None:
                raise ValueError("no content")
            page = read_page(html)
        except ValueError as error:
            yield (*[None] * len(self.columns), str(error))
            return
        yield (*[c.value(page) for c in self.columns], None)


def register(spark: SparkSession, name: str = "read_html") -> None:
    spark.udtf.register(name, udtf(ReadHtml))
