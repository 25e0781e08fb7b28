"""Work that must not grow with a page, a common word or a far point."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutyframe.functions import dates, times
from dutyframe.operators import intervals, locate, nearest, search
from dutyframe.sources import html, registry


def test_a_listing_in_parts_is_one_listing(spark):
    """Days are borrowed across the border of two parts, and not across that of two listings."""
    link = lambda k, title: f'<a title="Download: {title} (1 KB)" href="?fdl={k}">x</a>'
    rows = [(1, 0, link(1, "2024-01-01.docx")), (1, 1, link(2, "x.pdf") + link(3, "2024-01-02.pdf")), (2, 0, link(4, "y.pdf") + link(5, "2024-01-03.pdf")), (1, 2, link(6, "2024-01-04.docx"))]
    found = registry.by_id("moh-attica-hospitals").published(spark.createDataFrame(rows, "page_id long, part long, html string"))
    assert {(r["url"].rpartition("=")[2], str(r["published_date"])) for r in found.collect()} == {("2", "2024-01-01"), ("3", "2024-01-02"), ("5", "2024-01-03")}


def test_elements_are_handed_on_in_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "<p>a</p>" * 3000) for k in range(4)], "page_id long, html string").coalesce(1)
    got = html.elements(pages, "page_id", "html").withColumn("part", F.monotonically_increasing_id())
    assert got.count() == 12000 and html.ROWS < 3000
    assert [r["c"] for r in got.groupBy("page_id").agg(F.count_distinct("n").alias("c")).collect()] == [3000] * 4


def test_a_long_page_is_not_held_as_python_objects(monkeypatch):
    """Elements become Arrow rows as they end: few are held at once, open ones outlive the cuts, and texts are those of a page read as a whole."""
    import pyarrow as pa

    card = lambda k: f"<div class='card c{k}'><p>α{k} &amp; β<br>γ</p><i/></div>δ"
    page = "<main>x" + "".join(map(card, range(5000))) + "<p>open<b>end"
    whole = html.read_page(page)
    assert [e["n"] for e in whole] == list(range(20003)) and whole[0]["text"].startswith("xα0 & βγδα1") and whole[0]["text"].endswith("δopenend") and whole[-2]["text"] == "openend"
    most, held = [], html._rows
    monkeypatch.setattr(html, "_rows", lambda key, found, names: (most.append(len(found)), held(key, found, names))[1])
    rows = [r for b in html._pages_read("k", html.MOST_BYTES)(iter([pa.record_batch([[7, 8], [page, None]], ["k", "h"])])) for r in b.to_pylist()]
    assert max(most) < 4000 and {r["k"] for r in rows} == {7}
    assert sorted((r["n"], r["parents"], r["tag"], dict(r["attrs"]), r["text"]) for r in rows) == [(e["n"], e["parents"], e["tag"], e["attrs"], e["text"]) for e in whole]


def test_pairs_of_two_lists_are_not_made_in_one_piece_of_code(spark):
    """A row of two lists becomes rows of one list first, which are handed on one at a time; else all pairs of both are held at once."""
    names = spark.createDataFrame([(k, "AB"[k % 2] * 4) for k in range(50)], "id long, name_folded string")
    found = search.search_many(names, names.select(F.col("id").alias("needle_id"), F.substring("name_folded", 1, 3).alias("search")))
    steps = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(__" in line or "Coalesce" in line or "REPARTITION_BY_NUM" in line]
    assert [next(w for w in ("Generate", "Coalesce", "Exchange") if w in s) for s in steps] == ["Generate", "Coalesce", "Generate", "Exchange"]
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in range(50) for b in range(50) if (a - b) % 2 == 0} and found.count() == 1250


def test_values_are_worked_out_once(spark):
    """Plans of the readers stay small: the text is folded once, and not again for each use of what it gives."""
    plan = lambda c: spark.createDataFrame([("x",)], "t string").select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(times.parse_ranges(F.col("t"))).count("regexp_extract") < 20
    assert plan(dates.parse_words(F.col("t"))).count("levenshtein") <= 2


def test_totals_of_ranges(spark):
    """Totals as of every pair, without making pairs; ranges without end, empty ones and null bounds too."""
    inf = float("inf")
    points = [("a", float(x % 7), x) for x in range(30)] + [("b", 2.0, 5), ("a", None, 9), (None, 1.0, 3)]
    bounds = [(1, "a", 0.0, 3.0), (2, "a", 2.5, inf), (3, "a", -inf, inf), (4, "a", 3.0, 3.0), (5, "b", 2.0, 2.5), (6, "b", 2.5, 9.0), (7, "a", None, 3.0), (8, None, 0.0, 9.0), (9, "a", 6.0, 7.0), (10, "c", 0.0, 9.0)]
    p, b = spark.createDataFrame(points, "k string, at double, v long"), spark.createDataFrame(bounds, "i long, k string, low double, high double")
    got = intervals.interval_totals(p, b, ["k"], "at", ["v"])
    want = {}
    for i, k, low, high in bounds:
        met = [v for o, x, v in points if None not in (k, low, high, x) and o == k and low <= x < high]
        if met:
            want[i] = (len(met), sum(met))
    assert {r["i"]: (r["n"], r["v"]) for r in got.collect()} == want


def test_common_words_meet_few_places(spark, monkeypatch):
    """Every name shares a word with every place; the lookup goes by the other one, and equal names are sought once."""
    tried, own = spark.sparkContext.accumulator(0), locate.holds_all

    @F.udf("boolean")
    def seen(_):
        tried.add(1)
        return True

    monkeypatch.setattr(locate, "holds_all", lambda wanted, known: F.when(seen(F.size(known)), own(wanted, known)))
    names = spark.range(300).selectExpr("id", "concat('Ν. «Μονάδα Q', id % 150, '»') AS name")
    places = spark.range(400).selectExpr("concat('P', id) AS qid", "array(concat('Μονάδα Q', id)) AS names", "38.0D AS lat", "23.7D AS lon")
    got = locate.match_places(names, places).collect()
    assert {(r["id"], r["outcome"], r["qid"]) for r in got} == {(k, "located", f"P{k % 150}") for k in range(300)}
    assert len(got) == 300 and 0 < tried.value < 2000


def test_far_points_meet_few_places(spark, monkeypatch):
    """Points far from all places, many of them at one spot, against a grid of places: few distances are measured, and none is missed."""
    tried, own = spark.sparkContext.accumulator(0), nearest.distance_km

    @F.udf("boolean")
    def seen(_):
        tried.add(1)
        return True

    monkeypatch.setattr(nearest, "distance_km", lambda a, b, c, d: F.when(seen(a), own(a, b, c, d)))
    places = spark.range(900).selectExpr("id", "30 + floor(id / 30) / 10.0D AS lat", "20 + (id % 30) / 10.0D AS lon")
    points = spark.range(200).selectExpr("id", "CASE WHEN id < 190 THEN -60.0D ELSE -60.0D + id / 10.0D END AS lat", "100.0D AS lon")
    got = nearest.nearest(points, places, 2).select("point", "rank", "place").collect()
    far = points.crossJoin(places.selectExpr("id AS place", "lat AS b", "lon AS l")).withColumn("km", F.round(own(F.col("lat"), F.col("lon"), F.col("b"), F.col("l")), nearest.DIGITS))
    want = far.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("km", "place"))), 1, 2).alias("s")).collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(r["id"], n, x["place"]) for r in want for n, x in enumerate(r["s"], 1)}
    assert 0 < tried.value < 60_000


def test_equal_needles_and_names_meet_once(spark):
    """Copies come together by lists of ids: the result has every pair, once."""
    names = spark.range(50).selectExpr("id", "concat('ABCD', id % 2) AS name_folded")
    needles = spark.range(40).selectExpr("id AS needle_id", "CASE id % 3 WHEN 0 THEN 'bcd0' WHEN 1 THEN 'bc' ELSE 'zzz' END AS search")
    got = search.search_many(names, needles)
    want = {(n, k) for n in range(40) for k in range(50) if n % 3 == 1 or (n % 3 == 0 and k % 2 == 0)}
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert "explode(__ids" in got._jdf.queryExecution().optimizedPlan().toString()
