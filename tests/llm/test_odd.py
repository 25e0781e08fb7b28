"""Odd input beyond nulls and repeats: hot keys, clashing names, very long texts, ties, empty stages, switched-off broadcasts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dutyframe.llm import common, components, decontamination, language_id, license_scan, minhash, mixing, sharding, simhash, suffix_dedup, token_counts

from test_minhash import brute as linked
from test_suffix_dedup import brute as repeats


@pytest.fixture
def no_broadcasts(monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(sharding, "BROADCAST_BLOCKS", 0)


@pytest.fixture
def hot(monkeypatch):
    """Every key of more than three rows counts as hot, and parts of a bucket are tiny."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(minhash, "PART", 3)
    monkeypatch.setattr(components, "ONE_TASK", 3)
    monkeypatch.setattr(components, "WALKED", 0)


def near_rows(prose):
    rows = [(k, prose(60, k)) for k in range(10)] + [(50 + k, "the same text of some words again and again") for k in range(12)] + [(None, prose(60, 3))] * 2
    base = prose(90, 77).split()
    for c in range(30):
        words = list(base)
        for e in range(c % 7):
            words[(c * 13 + e * 11) % 90] = f"e{c}x{e}"
        rows.append((100 + c, " ".join(words)))
    return rows


def test_near_copies_of_hot_buckets_and_without_broadcasts(spark, frame, prose, hot, no_broadcasts):
    rows = near_rows(prose)
    found = minhash.near_duplicates(frame(rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == linked(rows, 2)


def test_repeats_of_hot_grams_and_without_broadcasts(spark, frame, prose, hot, no_broadcasts):
    passage = prose(70, 5)
    rows = [(k, prose(40, k) + passage + prose(20, 1000 + k)) for k in range(15)] + [(99, None), (98, passage), (98, passage)]
    found = suffix_dedup.remove_repeats(frame(rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == repeats(rows)


def test_components_of_a_hub_and_of_nothing(spark, hot):
    links = [(1, k) for k in range(2, 60)] + [(k, k + 100) for k in range(2, 30)] + [(500, 501)]
    df = spark.createDataFrame(links, "u long, v long")
    found = dict(map(tuple, components.components(df).collect()))
    assert found == {k: 1 for k in [*range(2, 60), *range(102, 130)]} | {501: 500}
    assert components.components(df.limit(0)).isEmpty()


def test_one_key_on_half_of_the_rows(spark, prose, monkeypatch):
    """A repeated key is dealt over blocks, the sums stay, and reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 64)
    monkeypatch.setattr(mixing, "UNFOLD", 50)
    rows = [(7, "a b c d", "s")] * 600 + [(k, prose(2 + k % 9, k), "st"[k % 2]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for source in "st":
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    # take() draws by row, not by key, towards the same targets
    words = mixing.take(docs).select("source", F.size(F.split("text", " ")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    targets = {r["source"]: r["target"] for r in found}
    assert all(abs(r["n"] - targets[r["source"]]) <= 10 for r in words)


def test_large_documents_are_rounded_in_pairs():
    rng = np.random.default_rng(4)
    sizes = np.concatenate([np.full(300, 10.0), rng.integers(200, 900, 12).astype(float)])
    sums = []
    for _ in range(400):
        p = mixing.settle_large(sizes, np.full(len(sizes), 0.4), rng)
        assert np.isclose((p * sizes).sum(), 0.4 * sizes.sum())
        assert ((p[300:] > 0) & (p[300:] < 1)).sum() == 0
        sums.append(p)
    assert np.abs(np.mean(sums, 0) - 0.4).max() < 0.1


def test_ties_of_size_and_key(spark):
    docs = spark.createDataFrame([(None, "x y", None)] * 5 + [(1, "x y", None)] * 5, "doc_id long, text string, source string")
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def test_clashing_names(spark, frame, prose, odd):
    docs = clash(frame(odd), "copies", "sid", "size", "block", "hash", "id", "component_id", "kept", "slot", "law", "rank", "text_hash", "n", "u", "v")
    assert mixing.take(docs).columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in minhash.keep_one(docs, minhash.near_duplicates(docs, width=5)).collect()) == [-1, 1, 2, 3, 4, 5, 7, 8]
    carried = sharding.shard_table(docs, carry=("text", "copies", "hash"))
    assert carried.count() == len(odd) and {r["copies"] for r in carried.collect()} == {"clash"}
    bench = spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string")
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns
    for found in (suffix_dedup.remove_repeats(docs), license_scan.scan(docs), simhash.fingerprints(docs), mixing.mix(docs)):
        assert found.count() == len(odd)


def test_blocks_follow_the_rows(spark, frame, monkeypatch):
    """With more, smaller blocks the slots stay the same."""
    rows = [(k, f"t{k}") for k in range(500)] + [(3, "another"), (3, "third")]
    one = Counter(map(tuple, sharding.shard_table(frame(rows)).collect()))
    monkeypatch.setattr(sharding, "BLOCKS", 256)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 0.01)
    monkeypatch.setattr(sharding, "BROADCAST_BLOCKS", 0)
    assert Counter(map(tuple, sharding.shard_table(frame(rows)).collect())) == one


def test_slots_of_a_hot_key(spark, frame, monkeypatch):
    """A key with very many different texts is cut into blocks by checksum; the slots stay those of one block."""
    rows = [(3, f"text {k}") for k in range(300)] + [(3, "same")] * 40 + [(k, f"t{k}") for k in range(400)] + [(9, f"u {k}") for k in range(90)]
    one = Counter(map(tuple, sharding.shard_table(frame(rows)).collect()))
    monkeypatch.setattr(sharding, "HOT_ROWS", 10)
    monkeypatch.setattr(sharding, "hot_limit", lambda n: 20)
    assert Counter(map(tuple, sharding.shard_table(frame(rows)).collect())) == one


def test_texts_beyond_a_chunk(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    passage = prose(60, 8)
    rows = [(1, prose(400, 1) + passage + prose(300, 2)), (2, passage + prose(600, 3) + passage), (3, prose(900, 4))]
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame(rows)).collect()), key=str) == repeats(rows)


def test_tokens_of_texts_beyond_the_long_limit(spark, frame, prose, monkeypatch):
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, prose(300, 1)), (2, "éß " + prose(200, 2))]
    one = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(rows), file).collect()}
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(rows), file).collect()} == one


def test_other_tokenizers_are_refused(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = None
    with pytest.raises(ValueError, match="another way"):
        token_counts.check_tokenizer(json.dumps(file))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.train(spark.createDataFrame([(k, "text", f"l{k}") for k in range(3)], "doc_id long, text string, lang string"))


def test_equal_scores_of_languages(spark):
    """Two languages learned from the same text: the same one is told each time, and flagged."""
    docs = spark.createDataFrame([(k, "one two three", "ab"[k % 2]) for k in range(20)], "doc_id long, text string, lang string")
    found = {(r["lang_pred"], r["ambiguous"]) for _ in range(2) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert len(found) == 1 and next(iter(found))[1]


def test_near_prints_against_all_pairs(spark, frame, prose, hot):
    rows = [(k * 25, prose(80, k // 4) + (f" e{k}" if k % 4 else "")) for k in range(40)]
    found = simhash.fingerprints(frame(rows), queries=F.col("doc_id") % 50 == 0).collect()
    prints = {int(r["fingerprint"], 16) for r in found}
    for r in found:
        own = int(r["fingerprint"], 16)
        assert r["near_prints"] == (sum((own ^ x).bit_count() <= simhash.RADIUS for x in prints) - 1 if r["doc_id"] % 50 == 0 else None)


def test_within_radius_of_nothing(spark):
    empty = spark.createDataFrame([], "f0 long, f1 long")
    assert simhash.within_radius(empty, empty).isEmpty()


def test_stages_on_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).isEmpty(), name


def test_near_copies_stage_by_planted_edits(spark, frame, prose):
    """Copies with words replaced: the stage removes exactly those that five-word shingles link at 0.8; width 2 would link more."""
    rows, edits = [], {}
    for k in range(20):
        base = prose(120, 500 + k).split()
        rows.append((k * 100, " ".join(base)))
        for c in range(1, 6):  # c words far apart
            words = list(base)
            for e in range(c):
                words[10 + e * 22] = f"edit{k}x{c}x{e}"
            edits[k * 100 + c] = c
            rows.append((k * 100 + c, " ".join(words)))
    docs = frame(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    firsts = {k for k, _, component in linked(rows, 5) if k == component}
    assert kept == firsts
    gone = Counter(c for k, c in edits.items() if k not in kept)
    at_two = Counter(edits[r["doc_id"]] for r in minhash.near_duplicates(docs, width=2).collect() if r["doc_id"] in edits and not r["kept"])
    assert gone[1] == gone[2] == 20 and all(at_two[c] >= gone[c] for c in range(1, 6)) and at_two[5] == 20


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_outliers_beside_a_large_group_of_near_copies(spark, frame, prose, hot, no_broadcasts):
    """Texts that resemble a group without belonging to it, some linked with each other: they meet all of the group, in parts."""
    base = prose(120, 5).split()
    edited = lambda own, n, seed: " ".join(f"x{seed}w{k}" if (k * 37 + seed * 11) % 120 < n else w for k, w in enumerate(own))
    rows = [(k, edited(base, k % 4, k)) for k in range(40)]
    far = [edited(base, 17, 900 + k).split() for k in range(3)]
    rows += [(100 + 10 * k + c, edited(own, c, 50 + k)) for k, own in enumerate(far) for c in range(3)]
    found = minhash.near_duplicates(frame(rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == linked(rows, 2)
    assert len({r["component_id"] for r in found}) > 1


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_joins_with_hot_and_null_keys(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rows = [(k % 3 if k < 30 else k, k) for k in range(50)] + [(None, 98), (None, 99)]
    big = common.written(spark.createDataFrame(rows, "a long, b long"), "big")
    keyed = spark.createDataFrame([(0, 10, 7), (1, 10, 8), (40, 1, 9), (77, 0, 1), (None, 2, 5)], "a long, times long, v long")
    want = sorted((a, b, {0: 7, 1: 8, 40: 9}[a]) for a, b in rows if a in (0, 1, 40))
    assert sorted(tuple(r) for r in common.join_keys(big, keyed, "a", "times", len(rows)).select("a", "b", "v").collect()) == want
    assert sorted(tuple(r) for r in common.join_keys(big, keyed, "a", "times", len(rows), "left_semi").select("a", "b").collect()) == [w[:2] for w in want]
    assert sorted(tuple(r) for r in common.salted_join(big, keyed.drop("times"), ["a"], "b").select("a", "b", "v").collect()) == want


def test_rows_are_taken_as_often_after_a_shuffle(spark, frame, prose):
    """The rows come out of a shuffle that may be put together in other ways for each use."""
    rows = [(k % 7, prose(20 + k % 7, k % 7)) for k in range(210)]
    docs = frame(rows).withColumn("source", F.when(F.col("doc_id") < 3, "a").otherwise("b"))
    wanted = Counter()
    for r in mixing.mix(docs).collect():
        wanted[r["doc_id"]] += r["copies"]
    got = mixing.take(docs.repartition(13, "text"))
    assert Counter(r["doc_id"] for r in got.collect()) == +wanted and got.columns == docs.columns


def test_a_walk_names_the_components_that_the_rounds_name(spark, monkeypatch):
    """Chains, rings, hubs, links both ways and again, nodes linked with themselves; numbers, strings and bytes."""
    import random

    r = random.Random(3)
    links = [(k, k + 1) for k in range(30)] + [(40 + k, 40 + (k + 1) % 9) for k in range(9)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7), (3, 2), (2, 3)]
    for kind, name in (("long", int), ("string", "é{:04}".format), ("binary", lambda k: bytes([k % 256, k // 256]))):
        df = spark.createDataFrame([(name(a), name(b)) for a, b in links], f"u {kind}, v {kind}")
        monkeypatch.setattr(components, "WALKED", 10**6)
        walked = {(bytes(a) if kind == "binary" else a, bytes(b) if kind == "binary" else b) for a, b in components.components(df).collect()}
        monkeypatch.setattr(components, "WALKED", 0)
        assert walked == {(bytes(a) if kind == "binary" else a, bytes(b) if kind == "binary" else b) for a, b in components.components(df).collect()}
        assert len({u for u, _ in walked}) == len(walked)
    assert components.components(df.limit(0)).isEmpty()
