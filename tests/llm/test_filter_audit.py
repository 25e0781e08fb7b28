from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dutyframe.llm import common, filter_audit
from dutyframe.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """Every order applied to every row in turn."""
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, x in labels if k is not None and x == 1}
    smallest = {}
    for k, t, _ in rows:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    told = []
    for k, t, lang in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": k is not None and smallest[t] < k,
        }
        told.append((lang or "", fails, k in good, k in toxic))
    out, shapley = [], Counter()
    for part in {t[0] for t in told}:
        own = [t for t in told if t[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [t for t in left if t[1][f]]
                left = [t for t in left if not t[1][f]]
                shapley[part, f] += len(gone)
                failing = [t for t in own if t[1][f]]
                out.append([part, order, step, len(left), len(gone), len(failing) - len(gone), sum(sum(t[1].values()) == 1 for t in failing), sum(t[2] for t in gone), sum(t[3] for t in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def made(spark, rows, labels):
    docs = spark.createDataFrame([(k, t, lang, "s", True, 1) for k, t, lang in rows], "doc_id long, text string, lang string, part string, good boolean, A int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scratch = Scratch()
    return filter_audit.audit(filter_audit.verdicts(docs, marks, scratch), scratch)


def some(prose, odd):
    rows = [(k, t, "en") for k, t in odd]
    rows += [(20 + k, prose(60 + 20 * k, k), ("en", "de", None, "")[k % 4]) for k in range(12)]
    rows += [(40 + k, prose(110, 5).upper() + "#" * (k % 2), "en") for k in range(9)] + [(40, prose(100, 1), "de")] * 6
    rows += [(60, "w " * 120 + "$", None), (61, " ".join(f"w{k}" for k in range(100)), "fr"), (62, " ".join(f"w{k % 80}" for k in range(100)), "fr"), (63, " ".join(f"w{k % 79}" for k in range(100)), "fr"), (64, "A" + "b" * 9, "fr"), (65, "AA" + "b" * 17, "fr")]
    labels = [(k, k % 2, (k // 3) % 2) for k in range(5, 66, 3)] + [(40, 0, 1), (40, 1, 0), (None, 1, 1), (8, None, 1), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_against_all_orders(spark, prose, odd, monkeypatch, hot_rows):
    """Nulls in any column, empty and long texts, repeated rows and keys, ties; the second time every common key is hot."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rows, labels = some(prose, odd)
    found = made(spark, rows, labels)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == brute(rows, labels)


def test_states_are_shared(spark):
    """Each of the 2**n states is made once, and no survivors stay persisted."""
    root = spark.range(64).select(*[(F.shiftright("id", k) % 2 == 1).alias("ABCDE"[k]) for k in range(5)])
    scratch = Scratch()
    edges = filter_audit.walk(root, {n: F.col(n) for n in "ABCDE"}, [], {}, scratch).collect()
    assert len(scratch.made) == 32 and len({r["state"] for r in edges}) == 32
    assert {(r["state"], r["survivors"]) for r in edges} == {("".join(s), 64 >> n) for n in range(6) for s in itertools.combinations("ABCDE", n)}
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    with pytest.raises(ValueError):
        filter_audit.walk(root, {n: F.col("A") for n in "abcdefgh"}, [], {}, scratch)


def test_empty(spark):
    assert made(spark, [], []).isEmpty()
    assert made(spark, [(1, "a", "en")], []).count() == 600
