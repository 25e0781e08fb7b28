from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from dutyframe.llm import license_scan as ls

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in GAP.split((text or "").translate(str.maketrans(ls.UPPER, ls.LOWER))) if w]


def brute(rows):
    out = []
    for k, text in rows:
        w, starts, base, more, best = words(text), [], set(), set(), 0.0
        for phrase, label in ls.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += found
            base |= {label} if found else set()
        for line in (text or "").split("\n"):
            own = set(words(line))
            for label, body in ls.TEMPLATES:
                t = set(body.split())
                if len(own & t) >= math.ceil(ls.THRESHOLD * len(t) - 1e-9):
                    more.add(label)
                    best = max(best, len(own & t) / len(t))
        out.append((k, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if starts else round(best, 9)))
    return Counter(out)


def test_against_all_lines(spark, frame, prose, odd):
    rows = list(odd) + [
        (20, "Released under the MIT License."),
        (21, "x MIT license mit-license apache LICENSE, mit license"),
        (22, "general public license\nof the general public License"),
        (23, "Licensed under CC BY-NC 4.0."),
        (24, "licensed under by nc 4 0"),
        (25, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"),
        (26, "mit licenseß"),
        (27, prose(300, 1) + "\n" + ls.TEMPLATES[5][1].upper() + "\n" + prose(10, 2)),
        (28, "Licensed under the Apache License, Version 2.0.\n" * 3),
        (29, "general\npublic license"),
    ]
    found = ls.scan(frame(rows)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in found)
    assert got == brute(rows)


def test_empty(frame, odd):
    assert ls.scan(frame(odd).limit(0)).isEmpty()


def brute_wrapped(text):
    """Labels and best containment over all lines, and over all stretches of as many words as the template has."""
    more, best = set(), 0.0
    every = words(text)
    for label, body in ls.TEMPLATES:
        t, n = set(body.split()), len(body.split())
        for own in [words(line) for line in text.split("\n")] + [every[k : k + n] for k in range(max(1, len(every) - n + 1))]:
            if len(set(own) & t) >= math.ceil(ls.THRESHOLD * len(t) - 1e-9):
                more.add(label)
                best = max(best, len(set(own) & t) / len(t))
    return ",".join(sorted(more)), round(best, 9)


def test_wrapped_notices(spark, frame, prose):
    mit, gpl, bsd = (ls.TEMPLATES[k][1] for k in (1, 4, 5))
    rows = [
        (1, mit.replace("a copy", "a copy\n")),
        (2, bsd.replace("or without", "or without\n # ")),
        (3, prose(300, 1) + " " + mit.replace("a copy", "a copy\n") + " " + prose(300, 2)),
        (4, gpl.replace(" ", "\n")),
        (5, gpl.replace(" ", "\n\n * ")),
        (6, "\n".join(bsd.split()[:6]) + "\n" + prose(40, 3) + "\n" + "\n".join(bsd.split()[6:])),
        (7, "Released under\nthe MIT"),
        (9, prose(30, 5) + "\n" + " ".join(bsd.split()[:9]) + "\n" + " ".join(bsd.split()[9:]) + "\n" + prose(30, 6)),
        (10, "the mit\n" + prose(30, 7) + " license\nunder released"),
        (8, "licensed under cc\n" + prose(8, 4) + "\nby nc 4 0"),
    ]
    found = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in ls.scan(frame(rows)).collect() if not r["n_base"]}
    assert found == {k: brute_wrapped(t) for k, t in rows if k in found}
    assert {k: found[k][0] for k in (1, 2, 3, 6, 7, 8)} == {1: "mit", 2: "bsd", 3: "mit", 6: "", 7: "mit", 8: ""}


def test_whole_texts_of_a_table(spark, frame, prose):
    """A text of 120 words as a template, wrapped over lines and with words changed; half of it isn't enough."""
    body = prose(120, 9).split()
    table = spark.createDataFrame([("own", " ".join(body)), (None, "no label"), ("none", None), ("blank", " . ")], "label string, text string")
    templates = ls.templates_from(table)
    assert templates == [("own", " ".join(body))]
    wrapped = lambda words: "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    changed = [f"w{k}" if k % 24 == 0 else w for k, w in enumerate(body)]
    rows = [(1, prose(50, 1) + "\n" + wrapped(body) + "\n" + prose(50, 2)), (2, wrapped(changed)), (3, wrapped(body[:30])), (4, prose(150, 3)[:300]), (5, None)]
    found = {r["doc_id"]: r["labels"] for r in ls.scan(frame(rows), templates=templates).collect()}
    assert found[1] == found[2] == "own" and found[3] == found[5] == ""


def test_too_many_templates(spark, monkeypatch):
    monkeypatch.setattr(ls, "TEMPLATE_BYTES", 5)
    with pytest.raises(ValueError, match="bytes"):
        ls.templates_from(spark.createDataFrame([("l", "some words")], "label string, text string"))
