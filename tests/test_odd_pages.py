"""Queries over pages against SQL where pages share urls or hold references that the SQL leaves as they are."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from dutyframe.sources import html
from dutyframe.sources.pharmacies import Pharmacies
from tests.test_queries import rows_of

PAGES = [(k, f"https://a/{k % 3}" + ("#top" if k % 2 else ""), f"<html><title>x{k} &lt;b&gt; &quot;q&quot; &amp;lt; &amp;&amp;{'&amp' if k % 2 else ''}</title><a href='?a=1&b=2'>y</a></html>") for k in range(40)]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).to_parquet(folder / "pages.parquet")
    return str(folder)


def test_a_page_of_any_length_is_read(spark, monkeypatch):
    """A page of over 64 MB has its cards and issues as a short one has; nested elements, which have one text, are handed on apart."""
    long = F.concat(F.repeat(F.lit("x"), 65 << 20), F.lit("<div class=card id=5><h6>a</h6></div>"))
    docs = spark.range(1).select(F.lit(7).cast("long").alias("snapshot_id"), long.alias("content"), F.lit("2025-03-01").cast("date").alias("published_date"))
    records, issues = Pharmacies().parse(docs)
    assert [(r["snapshot_id"], r["local_id"]) for r in records.collect()] == [(7, "5")]
    assert sorted((i["snapshot_id"], i["code"]) for i in issues.collect()) == [(7, "missing_location"), (7, "unreadable_hours")]
    monkeypatch.setattr(html, "LETTERS", 1000)
    handed = []
    html._read("<b>" * 10 + "x" * 400, None, lambda found: handed.append([(e["n"], len(e["text"])) for e in found]))
    assert max(map(len, handed)) == 3 and sorted(e for h in handed for e in h) == [(n, 400) for n in range(10)]


def test_fields_of_pages_that_are_hard_to_read(spark, tmp_path):
    """Markup that the parser knows no way through, no element at all and no content are told as the SQL tells them; a page that can't be read is an error, no row like others."""
    odd = ["<![foo bar]><title>a</title><a href=x>", "<title>b<![ x]></title><p><![ <a href=y>", "no markup", "", None, "<title>c</title><a href='&#" + "9" * 5000 + ";'>"]
    pd.DataFrame([(k, f"u{k}", h) for k, h in enumerate(odd)], columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.sql(__spark_entry__.oracle_sql()["page_fields"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in __spark_entry__.queries()["page_fields"](spark, str(tmp_path)).collect()}
    plain = (0, 2, 3, 4, 5)  # the SQL's own pattern finds no title with a `<` in it, and links within comments
    assert {k: got[k] for k in plain} == {k: want[k] for k in plain} and set(got) == set(want) and got[0] == ("a", 1) and got[4] == (None, None)
    assert [e["attrs"] for e in html.read_page(f"<p a='&#{'9' * 5000};'>")] == [{"a": "\ufffd"}]
    pages = spark.createDataFrame([(7, "<p>" + "x" * 99)], "page_id long, html string")
    with pytest.raises(Exception, match="page .*7.* can't be read: longer than 50 bytes"):
        html.read_all(html.elements(pages, "page_id", "html", most_bytes=50), "page_id").collect()


@pytest.mark.parametrize("name", ["landed_answers", "streamed_answers", "request_plan", "page_columns", "page_fields"])
def test_odd_pages(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{odd}/pages.parquet'")
    assert rows_of(__spark_entry__.queries()[name](spark, odd).toPandas()) == rows_of(con.sql(__spark_entry__.oracle_sql()[name]).df())
