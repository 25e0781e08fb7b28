from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dutyframe.llm import components, minhash


def sets_of(rows, width):
    out = {}
    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().translate(minhash.ASCII_LOWER).split()
        out[k] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def brute(rows, width):
    sets, parent = sets_of(rows, width), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    named = {}
    for members in groups.values():
        keys = [rows[m][0] for m in members if rows[m][0] is not None]
        for m in members:
            named[m] = min(keys) if keys else None
    return sorted(((rows[k][0], len(sets[k]), named[k]) for k in range(len(rows))), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, frame, prose, odd, width):
    rows = list(odd)
    for k in range(25):
        base = prose(60, k).split()
        for c in range(6):
            r, words = random.Random(k * 100 + c), list(base)
            for _ in range((c * k) % 9):
                words[r.randrange(len(words))] = f"edit{r.randrange(999)}"
            rows.append((1000 + k * 10 + c, " ".join(words)))
    found = minhash.near_duplicates(frame(rows), width=width).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)
    assert got == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_one_large_group_of_near_copies(spark, frame, prose):
    base, rows = prose(80, 5).split(), []
    for c in range(150):
        r, words = random.Random(c), list(base)
        for _ in range(r.randrange(14)):
            words[r.randrange(len(words))] = f"e{r.randrange(9999)}"
        rows.append((c, " ".join(words)))
    found = minhash.near_duplicates(frame(rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(rows, 2)


def test_estimate(spark):
    rng = np.random.default_rng(3)
    both, only = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    packed = [minhash.pack(minhash.minima(np.concatenate([both, o]))).view(np.int64).tolist() for o in only]
    got = spark.createDataFrame([tuple(packed)], "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(0.8, abs=0.12)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert found == {k: 1 for k in range(2, 41)} | {101: 100, 103: 100}


def test_keep_one_and_empty(spark, frame, odd):
    docs = frame(odd)
    kept = minhash.keep_one(docs, minhash.near_duplicates(docs, width=5))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([x for k, x in enumerate(odd) if k not in (5, 6)], key=str)
    assert kept.columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).isEmpty()


def test_keep_one_goes_by_row(spark, frame, prose):
    """Repeated keys with different texts, against brute force over rows."""

    def near(seed, c):
        words = prose(80, seed).split()
        words[c] = f"edit{c}"
        return " ".join(words)

    rows = [(3, near(1, 0)), (7, near(1, 40)), (7, prose(80, 2)), (7, near(3, 0)), (9, near(3, 40)), (9, prose(80, 4)), (9, prose(80, 4))]
    rows += [(12, near(5, k)) for k in (0, 30, 60)] + [(5, near(6, 0)), (8, near(6, 40)), (8, near(7, 0)), (8, near(7, 40)), (8, ""), (8, " ")]
    groups = [rows[0:2], rows[2:3], rows[3:5], rows[5:7], rows[7:10], rows[10:12], rows[12:14], rows[14:15], rows[15:16]]
    hashes = dict(spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect())
    expected = sorted(min(g, key=lambda r: (r[0], hashes[r[1]])) for g in groups)
    docs = frame(rows)
    kept = minhash.keep_one(docs, minhash.near_duplicates(docs, width=5))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == expected
    assert kept.columns == docs.columns


def test_null_keys_link(spark, frame, prose):
    """Texts that only null keys hold are linked, also as the bridge between two others."""
    base = prose(200, 9).split()

    def edited(*places):
        return " ".join(f"edit{k}" if k in places else w for k, w in enumerate(base))

    rows = [(1, edited(10, 30, 50, 70, 90, 110, 130)), (None, edited()), (2, edited(20, 40, 60, 80, 100, 120, 140)), (3, prose(200, 10))]
    found = minhash.near_duplicates(frame(rows)).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)
    assert got == brute(rows, 2) and [r[2] for r in got] == [1, 1, 3, 1]


def test_cut_is_six_deviations():
    chance = 1 / (1 << minhash.BITS)
    equal = 0.8 + 0.2 * chance
    deviation = (equal * (1 - equal) / minhash.HASHES) ** 0.5 / (1 - chance)
    assert minhash.ESTIMATE_CUT <= 0.8 - 6 * deviation + 0.002
