from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dutyframe.llm import mixing


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    open_, out, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_rounding_keeps_the_sum_and_the_mean():
    rng, sizes = np.random.default_rng(1), np.random.default_rng(2).integers(1, 50, 60).astype(float)
    p = np.full(60, 0.37)
    runs = np.array([mixing.pivotal(sizes, p, rng) for _ in range(600)])
    assert np.allclose(runs @ sizes, (sizes * p).sum())
    assert ((runs > 0) & (runs < 1)).sum(1).max() <= 1
    assert np.abs(runs.mean(0) - 0.37).max() < 0.1
    large = mixing.settle_large(np.append(sizes, 400.0), np.full(61, 0.5), rng)
    assert large[-1] in (0.0, 1.0) and np.isclose((large * np.append(sizes, 400.0)).sum(), 0.5 * (sizes.sum() + 400))


@pytest.fixture(scope="module")
def docs(spark, prose):
    rows = [(k, prose(20 + k % 50, k), ["a", "b", "c", "d", None][min(k % 7, 4)]) for k in range(1500)] + [(9001, None, "a"), (9002, "", "e"), (9003, "x", "e"), (9003, "x", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_targets_and_takings(docs):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = plain_targets(dict(sizes))
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_reruns_agree(docs):
    key = lambda rows: sorted((r["doc_id"], r["taken"], r["source"] or "") for r in rows)
    assert key(mixing.mix(docs).collect()) == key(mixing.mix(docs.repartition(7)).collect())


def test_a_tree_of_several_levels(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    found = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= r["m"] + 1e-6 for r in found)


def test_take_repeats_rows(docs):
    wanted = Counter({k: n for k, n in ((r["doc_id"], r["copies"]) for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("copies")).collect())})
    got = Counter(r["doc_id"] for r in mixing.take(docs).collect())
    assert sum(got.values()) == pytest.approx(sum(wanted.values()), rel=0.1)
    assert mixing.take(docs).columns == docs.columns


def test_empty(docs):
    assert mixing.mix(docs.limit(0)).isEmpty()


def test_small_sources_come_near_their_targets(spark, frame):
    """Fifty documents each, one of which is larger than all the words that are to be added: within 2 % all the same."""
    rng = np.random.default_rng(7)
    rows, sizes = [], {}
    for s in range(9):
        for k in range(50):
            n = 4000 if k == 0 else int(rng.integers(40, 500))
            rows.append((f"s{s}", s * 100 + k, n))
            sizes[s * 100 + k] = n
    df = spark.createDataFrame([(k, " w" * n, s) for s, k, n in rows], "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    taken, target = {}, {}
    for r in found:
        assert r["taken"] == r["copies"] * sizes[r["doc_id"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert max(abs(taken[s] - target[s]) / target[s] for s in target) < 0.02


def test_repair_stays_within_the_copies(prose):
    rng = np.random.default_rng(1)
    for seed in range(200):
        sizes = rng.integers(1, 300, 40).astype(float)
        whole, p = rng.integers(0, 4, 40).astype(float), rng.integers(0, 2, 40).astype(float)
        p[whole == 3] = 0
        words = (sizes * p).sum() + rng.integers(-3000, 3000)
        q = mixing.repair(sizes, whole, p, words, np.random.default_rng(seed))
        assert ((whole + q >= 0) & (whole + q <= 3)).all() and (np.abs(q - p) <= 1).all()
        assert abs((sizes * q).sum() - words) <= abs((sizes * p).sum() - words)
