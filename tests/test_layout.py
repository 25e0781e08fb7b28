"""Pages are drawn from texts and read back; entries, places and cards are held against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from dutyframe.operators import layout, locate, names
from dutyframe.sources import registry, selectors
from dutyframe.sources.base import ISSUE, RECORD
from dutyframe.sources.html import FAILED, elements, read_page

GLYPH = "page int, text string, x double, y double, advance double, font_size double"


def test_drawn_glyphs_are_read_back(spark):
    """Lines that lean within the tolerance, words parted by blanks or by gaps only, in any order."""
    r = random.Random(1)
    glyphs, lines = [], {}
    for page in range(1, 4):
        y = 50.0
        for line in range(1, 7):
            x, words = r.uniform(0, 30), []
            for _ in range(r.randrange(1, 6)):
                word = "".join(r.choice("αβγxyz.7") for _ in range(r.randrange(1, 8)))
                words.append((word, round(x, 3)))
                for c in word:
                    glyphs.append((page, c, x, y + r.uniform(0, 0.5), 5.0, 10.0))
                    x += 5.0
                if r.random() < 0.5:
                    glyphs.append((page, " ", x, y, 2.5, 10.0))
                x += r.uniform(3.0, 40.0)  # more than 0.28 of the font
            lines[page, line] = words
            y += r.uniform(6.0, 30.0)
    r.shuffle(glyphs)
    found = layout.words_of_glyphs(spark.createDataFrame(glyphs, GLYPH), ["page"])
    got = {}
    for w in sorted(found.collect(), key=lambda w: (w["page"], w["line"], w["word"])):
        got.setdefault((w["page"], w["line"]), []).append((w["text"], round(w["x"], 3)))
        assert w["width"] == pytest.approx(5.0 * len(w["text"]))
    assert got == lines
    assert {(r["page"], r["line"]): r["text"] for r in layout.line_texts(found, ["page"]).collect()} == {k: " ".join(w for w, _ in ws) for k, ws in lines.items()}


def test_a_small_gap_is_no_gap(spark):
    rows = [(1, c, x, 5.0, 4.0, 10.0) for c, x in (("p", 0.0), ("q", 6.8), ("r", 13.7))]
    assert [w["text"] for w in layout.words_of_glyphs(spark.createDataFrame(rows, GLYPH), ["page"]).orderBy("x").collect()] == ["pq", "r"]


def page_words(spark, placed):
    rows = [(1, int(y // 3), text, float(x), float(y), 5.0 * len(text), 10.0) for text, x, y in placed]
    return spark.createDataFrame(rows, "page int, line int, text string, x double, y double, width double, font_size double")


def test_tables_without_a_head_or_columns(spark):
    for placed in ([("ένα", 5, 10), ("δύο", 80, 10), ("τρία", 5, 30)], [("ΚΛΙΝΙΚΕΣ", 5, 10), ("κάτω", 5, 30)]):
        assert layout.reconstruct(page_words(spark, placed), ["page"], names.is_table_header).isEmpty()


def test_a_table_of_three_columns(spark):
    """A word left of the first border, a cell of two lines, a row label of two words, a row that the first column doesn't begin."""
    placed = [("ΚΛΙΝΙΚΕΣ", 10, 10), ("πρώτα", 110, 11), ("μετά", 210, 12), ("τέλος", 310, 13), ("Α", 10, 40), ("άλφα", 30, 40), ("x", 100, 36), ("y", 120, 37), ("z", 100, 52), ("u", 215, 41), ("Β", 10, 80), ("w", 320, 90), ("early", 110, 20)]
    got = layout.reconstruct(page_words(spark, placed), ["page"], names.is_table_header).select("column", "label", "row_label", "line", "text").collect()
    assert sorted(tuple(g) for g in got) == [(1, "πρώτα", "Α άλφα", 1, "x y"), (1, "πρώτα", "Α άλφα", 2, "z"), (2, "μετά", "Α άλφα", 1, "u"), (3, "τέλος", "Β", 1, "w")]


def test_width_runs(spark):
    runs = [(5, 9, 1.5), (7, 7, 2.0), (3, 2, 9.0), (0, 4095, 3.0), (0, 4096, 4.0)]
    got = layout.expand_width_runs(spark.createDataFrame(runs, "first int, last int, width double")).groupBy("width").agg(F.count("code").alias("n"), F.min("code").alias("low")).collect()
    assert {tuple(g) for g in got} == {(1.5, 5, 5), (2.0, 1, 7), (3.0, 4096, 0)}


CONNECTORS = {"ΕΩΣ", "ΚΑΙ", "ΜΕΧΡΙ", "ΑΠΟ", ""}


def plain_fold(x):
    return " ".join(re.sub(r"[^A-ZΑ-Ω0-9]+", " ", x.upper().translate(str.maketrans("ΆΈΉΊΌΎΏ", "ΑΕΗΙΟΥΩ"))).split())


def goes_on(before, line):
    if re.match(r"[A-ZΑ-ΩΆΈΉΊΌΎΏ]\.", line):
        return False
    if line.startswith("«"):
        return "»" not in before
    letters = re.sub(r"\.+$", "", before)
    bare = bool(re.fullmatch(r"[A-ZΑ-Ω.]+", letters)) and len(letters.replace(".", "")) <= 5
    return before.count("«") > before.count("»") or bare or plain_fold(before).split(" ")[-1] in CONNECTORS


def entries_of(lines):
    out = []
    for k, line in enumerate(x.strip(" ") for x in lines):
        if not line:
            continue
        if out and line.startswith("("):
            out[-1][2].append(line)
        elif out and goes_on(out[-1][1], line):
            out[-1][1] += " " + line
        else:
            out.append([k, line, []])
    done = []
    for k, name, notes in out:
        hours = re.search(r"(?i)((?:\s+(?:έως|μέχρι))?\s+[0-9]{1,2}[:.][0-9]{2})$", name)
        if hours:
            name, notes = name[: hours.start()].strip(), [*notes, hours[1].strip()]
        if not all(w in CONNECTORS for w in plain_fold(name).split(" ")):
            done.append((k, name, " ".join(notes) or None))
    return done


def test_entries_equal_a_walk_over_the_lines(spark):
    atoms = ["Κ.Ν", "Β.", "«ΚΥΜΑ»", "«ΒΡΑΧΟΣ", "ΠΕΥΚΟ»", "ΜΩΛΟΣ", "ΔΑΣΟΣ έως", "και", "(ΜΟΝΟ ΠΡΩΙ)", "19:05", "ΛΟΦΟΣ μέχρι 7.45", "Τ. «ΝΗΣΙ» 21:10", "", "   ", "ΑΜΜΟΣ 5", "έως 8:00"]
    r = random.Random(3)
    columns = [[r.choice(atoms) for _ in range(r.randrange(9))] for _ in range(150)] + [[], [""], ["(μόνη)"], ["και", "(x)"]]
    got = spark.createDataFrame([(k, c) for k, c in enumerate(columns)], "k int, x array<string>").orderBy("k").select(names.split_entries(F.col("x")).alias("e")).collect()
    assert [[tuple(e) for e in g["e"]] for g in got] == [entries_of(c) for c in columns]


def test_places_equal_all_pairs(spark):
    r = random.Random(4)
    words = ["ΚΥΜΑ", "ΠΕΥΚΟ", "ΠΕΥΚΑ", "ΔΑΣΟΣ", "ΛΙΒΑΔΙ", "ΩΡΑ", "ΝΗΣΙ"]
    places = [(f"P{k}", [" ".join(r.sample(words, r.randrange(1, 4))).title() for _ in range(2)], 38.0 if k % 5 else 35.0, 23.7) for k in range(20)]

    def quoted():
        parts = [w if r.random() < 0.6 else w[: r.randrange(1, 6)] + "." for w in r.sample(words, r.randrange(1, 3))]
        return parts

    asked = [quoted() for _ in range(60)]
    told = [f"Κ.Ν. «{' '.join(p)}»" for p in asked]

    def outcome(parts):
        if sum(len(p.rstrip(".")) for p in parts) < 4:
            return ("unmatched", None)
        fits = lambda p, known: any(w.startswith(p[:-1]) if p.endswith(".") else w == p for w in known)
        hits = sorted({q for q, own, lat, _ in places if lat > 37 for n in own if all(fits(p, n.upper().split(" ")) for p in parts)})
        return ("located", hits[0]) if len(hits) == 1 else ("ambiguous" if hits else "unmatched", None)

    entities = spark.createDataFrame([*enumerate(told), (90, "ΔΑΣΟΣ"), (91, None), (92, "«»"), (93, "«ΔΑΣΟΣ")], "id int, name string")
    got = locate.match_places(entities, spark.createDataFrame(places, "qid string, names array<string>, lat double, lon double")).orderBy("id").collect()
    assert [(g["outcome"], g["qid"]) for g in got] == [outcome(p) for p in asked] + [("unmatched", None)] * 4
    assert all((g["lat"] is not None) == (g["outcome"] == "located") for g in got)


def test_candidates_fold_by_item(spark):
    one = lambda q, point, *own: f'{{"item":{{"value":"x/{q}"}},"label":{{"value":"{own[0]}"}}{"".join(f""","alias":{{"value":"{a}"}}""" for a in own[1:])},"coord":{{"value":"{point}"}}}}'
    told = f'{{"results":{{"bindings":[{",".join([one("B", "Point(20 40)", "n", "m"), one("A", "?", "lost"), one("B", "Point(9 9)", "n", "o"), one("A", "Point(21 41)", "kept")])}]}}}}'
    got = locate.candidates(spark.createDataFrame([(told,), ("no json",), (None,)], "json string")).orderBy("qid").collect()
    assert [tuple(g) for g in got] == [("A", ["kept"], 41.0, 21.0), ("B", ["n", "m", "o"], 40.0, 20.0)]


def pages(spark, *html):
    return spark.createDataFrame([(k, h) for k, h in enumerate(html)], "page_id int, html string")


def test_elements(spark):
    got = elements(pages(spark, "<div id=a>x<br>y<p class='u v'>&lt;z&amp;</div>w", None, "", "<ul><li>1<li>2"), "page_id", "html").orderBy("page_id", "n").collect()
    assert [(g["page_id"], g["tag"], g["parents"], g["classes"], g["text"]) for g in got] == [
        (0, "div", [], [], "xy<z&"), (0, "br", [0], [], ""), (0, "p", [0], ["u", "v"], "<z&"), (3, "ul", [], [], "12"), (3, "li", [0], [], "12"), (3, "li", [0, 1], [], "2"),
    ]


def test_a_page_that_cannot_be_read_is_a_row(spark):
    got = elements(pages(spark, "<p>ok", "<p>" + "é" * 40), "page_id", "html", most_bytes=50).collect()
    assert {(g["page_id"], g["tag"]) for g in got} == {(0, "p"), (1, FAILED)}
    with pytest.raises(ValueError):
        read_page("é" * 40, 50)


def test_selectors():
    page = read_page('<main><div id="top" class="a b"><p>one <a href="/1">x</a></p></div><div class="a"><p>two</p><p lang=el>three<a>y</a></p></div></main><p>four</p>')
    said = lambda s: [e["text"].strip() for e in selectors.Selector(s).find(page)]
    assert said(".a p") == ["one x", "two", "threey"] and said("div.a.b#top p") == ["one x"] and said("main [lang=el]") == ["threey"] and said("p p") == [] and said("*[href]") == ["x"] and said("main div p a") == ["x", "y"]
    values = {c: selectors.Column(c).value(page) for c in ("p", "a @ href", "count( main p )", "h1", "count(h1)", "#top @ class", "p @ id")}
    assert values == {"p": "one x", "a @ href": "/1", "count( main p )": 3, "h1": None, "count(h1)": 0, "#top @ class": "a b", "p @ id": None}
    for bad in ("", "count(p) @ x", "count(p @ x)", "p > a", "..x"):
        with pytest.raises(ValueError):
            selectors.Column(bad)


def test_pages_by_the_table_function(spark):
    selectors.register(spark)
    rows = spark.sql("SELECT page_id, r.* FROM {p}, LATERAL read_html(html, t => 'b', n => 'count(i)') r ORDER BY page_id", p=pages(spark, "<b>x  y</b><i>1</i><i>2</i>", None, ""))
    assert [tuple(r) for r in rows.collect()] == [(0, "x y", 2, None), (1, None, None, "no content"), (2, None, 0, None)]
    for bad in ("html, t => html", "html, t => '>>'", "page_id, t => 'b'"):
        with pytest.raises(Exception, match="FAILED_TO_ANALYZE|ValueError"):
            spark.sql(f"SELECT * FROM {{p}}, LATERAL read_html({bad})", p=pages(spark, "x"))


def card(key, *spans, link=""):
    return f'<div class="card" id="{key}"><i class="card-title"><h6>Δρόμος {key}</h6><h6>όχι</h6></i><b class="card-subtitle"> Δήμος&nbsp;Α </b><div class="card-text">{"".join(f"<span>{s}</span>" for s in spans)}<h6>210{key}</h6></div>{link}</div>'


def test_duty_cards(spark):
    """Fields told apart by whether they are hours; a card with one field, with none, without a key; pages of nothing and too long ones."""
    place = lambda q: f'<a href="#query={q}">m</a>'
    day = dt.date(2024, 5, 3)
    html = "".join([card(1, "Κυριακού", "7:00 - 9:30", link=place("38,24")), card(2, "20:00-8:00 , 9-10", "Λεμονή", link=place("99,24")), card(3, "13:00 - 14:00"), card(4, "Μόνη"), card(5), card(" ", "x", "y"), card(6, "8 - 9", "10 - 11")])
    docs = spark.createDataFrame([(11, html, day), (12, "<p>", day), (13, "<p>" + "x" * 9000, day)], "snapshot_id long, content string, published_date date")
    source = registry.by_id("fsa-attica-pharmacies")
    source.most_bytes = 8000
    records, issues = source.parse(docs)
    at = lambda d, h, m=0: dt.datetime(2024, 5, d, h, m)
    assert sorted(((r["local_id"], r["name"], r["lat"], r["starts_at"], r["ends_at"]) for r in records.collect()), key=str) == sorted([
        ("1", "Κυριακού", 38.0, at(3, 7), at(3, 9, 30)), ("2", "Λεμονή", None, at(3, 20), at(4, 8)), ("2", "Λεμονή", None, at(3, 9), at(3, 10)), ("3", "Δρόμος 3", None, at(3, 13), at(3, 14)),
        ("4", "Μόνη", None, None, None), ("5", "Δρόμος 5", None, None, None), ("6", "8 - 9", None, at(3, 10), at(3, 11)),
    ], key=str)
    assert {(r["address"], r["municipality"], r["phone"]) for r in records.filter("local_id = '4'").collect()} == {("Δρόμος 4", "Δήμος Α", "2104")}
    told = sorted((r["snapshot_id"], r["code"], r["severity"]) for r in issues.collect())
    assert told == sorted([(11, "card_without_id", "warning"), *[(11, "missing_location", "warning")] * 5, *[(11, "unreadable_hours", "warning")] * 2, (12, "empty_document", "warning"), (13, "document_failed", "error")])


def test_listing_and_picker(spark):
    link = lambda k, name, href=None: f'<p><a title="Download: {name} (1,2 MB)" href="{href or f"?x=1&fdl={k}"}">λήψη</a>'
    html = "".join([link(1, "χωρίς.pdf"), link(2, "πρόγραμμα 3.4.2024.odt"), link(3, "άλλο.PDF"), link(4, "και άλλο.pdf"), link(5, "4 ΑΠΡΙΛΙΟΥ 2024 Γ ΟΡΘΗ.pdf", "/get?fdl=5"), '<a href="?fdl=6">', '<a href="?page=2" title="Download: 5.4.2024.pdf">'])
    hospitals = registry.by_id("moh-attica-hospitals")
    got = hospitals.published(pages(spark, html)).orderBy("n").collect()
    assert [(r["url"].split("fdl=")[1], str(r["published_date"]), r["revision"]) for r in got] == [("1", "2024-04-03", 0), ("3", "2024-04-03", 0), ("5", "2024-04-04", 3)]
    assert [r["url"] for r in hospitals.discover(pages(spark, html), "2024-04-04", "2024-04-09").collect()] == ["/get?fdl=5"]
    picker = '<option value="2024-01-05"><select id="Date"><option value="2024-01-02"><option value="2024-01-02 "><option value="2024-02-30"><option><option value="2024-03-01"></select>'
    found = registry.by_id("fsa-attica-pharmacies").discover(pages(spark, picker, "<select id=date><option value=2024-01-03></select>"), "2024-02-01", "2024-01-01")
    assert [r["form"] for r in found.collect()] == ["Date=2024-01-02"]


def test_a_rota_to_records(spark):
    """Two shifts, a name on two lines, a remark, a column that is no shift, and a line of a health centre."""
    placed = [("ΚΛΙΝΙΚΕΣ", 5, 10), ("7:00", 100, 10), ("–", 125, 10), ("13:00", 135, 10), ("13:00", 220, 10), ("–", 250, 10), ("7:00", 260, 10), ("ΠΑΡΑΤΗΡΗΣΕΙΣ", 340, 10)]
    placed += [("Άλφα", 5, 40), ("Κ.Ν", 100, 40), ("ΔΑΣΟΣ", 100, 55), ("(ΜΟΝΟ", 100, 70), ("Α)", 140, 70), ("Κ.", 220, 40), ("«ΚΥΜΑ»", 235, 40), ("όλα", 340, 40), ("Βήτα", 5, 100), ("Κ.", 220, 101), ("«ΠΕΥΚΟ", 235, 101), ("Κ.Υ.", 5, 130), ("ΛΟΦΟΥ:", 30, 130), ("9:00-15:00", 70, 130)]
    words = page_words(spark, placed).withColumns({"snapshot_id": F.lit(1).cast("long"), "published_date": F.lit(dt.date(2024, 12, 31))})
    records, issues = registry.by_id("moh-attica-hospitals").parse(words)
    at = lambda m, d, h: dt.datetime(2025 if m == 1 else 2024, m, d, h)
    got = {(r["kind"], r["name"], r["municipality"], r["starts_at"], r["ends_at"]) for r in records.collect()}
    assert {g for g in got if g[0] == "hospital" and "Κ.Υ" not in g[1] and "9:00" not in g[1]} >= {("hospital", "Κ.Ν ΔΑΣΟΣ", "Αττική", at(12, 31, 7), at(12, 31, 13)), ("hospital", "Κ. «ΚΥΜΑ»", "Αττική", at(12, 31, 13), at(1, 1, 7))}
    assert ("health_centre", "Κ.Υ. ΛΟΦΟΥ", None, at(12, 31, 9), at(12, 31, 15)) in got
    notes = records.filter("name = 'Κ.Ν ΔΑΣΟΣ'").select(F.get_json_object("payload", "$.notes"), F.get_json_object("payload", "$.clinic")).first()
    assert tuple(notes) == ("(ΜΟΝΟ Α)", "Άλφα")
    assert {"non_shift_column", "suspicious_name"} <= {r["code"] for r in issues.collect()}


def test_sources_by_name():
    assert {s.id for s in registry.all_sources()} == {"fsa-attica-pharmacies", "moh-attica-hospitals"}
    with pytest.raises(KeyError):
        registry.by_id("nowhere")
    assert RECORD.count(",") == 16 and ISSUE.count(",") == 4


def test_words_of_glyphs_are_sorted_narrow_and_in_bounded_parts(spark, monkeypatch):
    """Lines of uneven height and blanks; pages as a whole, dealt and cut give the same words, and glyphs are shuffled once with nothing beside their own columns."""
    from dutyframe.operators import scan

    glyphs = [(p, "ab c"[k % 4] if k % 11 else None, 5.0 * (k % 40) + (k % 40 > 20) * 9, 20.0 * (k // 40) + k % 2, 5.0, 10.0) for p in range(6) for k in range(60 + 60 * (p == 4))] + [(9, "x", None, None, 5.0, 10.0)] * 2
    shown = spark.createDataFrame(glyphs, "page int, text string, x double, y double, advance double, font_size double")
    told = {}
    for most in (10**6, 200, 70, 25):
        monkeypatch.setattr(scan, "ROWS_IN_A_TASK", most)
        words = layout.words_of_glyphs(shown, ["page"])
        plan = words._jdf.queryExecution().executedPlan().toString()
        told[most] = sorted(map(str, words.collect()))
        if most == 200:
            assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
            below = plan[plan.index("Exchange") :]
            assert "struct" not in below and "__end" not in below
    assert len(told[10**6]) > 40 and len({tuple(t) for t in told.values()}) == 1
