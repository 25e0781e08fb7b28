from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

from dutyframe.llm import simhash


def edited_texts(rows):
    distinct = sorted({(k, t or "") for k, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    following = dict(zip(distinct, distinct[1:] + distinct[:1], strict=True))
    out = Counter()
    for k, t in rows:
        t = t or ""
        m, after = len(t) // 3, following[(k, t)][1]
        out[(k, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest())] += 1
    return out


def test_edited_texts_and_likeness(spark, frame, prose, odd):
    rows = [*odd, *((100 + k, prose(30 + k, k)) for k in range(60)), (500, prose(31, 1))]
    found = simhash.fingerprints(frame(rows)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == edited_texts(rows)
    long = [r for r in found if r["doc_id"] is not None and 100 <= r["doc_id"] < 500]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)
    same = {r["fingerprint"] for r in found if r["doc_id"] in (101, 500)}
    assert len(same) == 1
    for r in found:
        ours, theirs = int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)
        assert r["near_edited"] == 1 - (ours ^ theirs).bit_count() / 128


def test_one_document_follows_itself(spark, frame):
    assert [(r["near_edited"], r["near_next"]) for r in simhash.fingerprints(frame([(1, "ab")])).collect()] == [(1.0, 1.0)]
    assert simhash.fingerprints(frame([(1, "ab")]).limit(0)).isEmpty()


def test_within_radius_against_all_pairs(spark):
    r, prints = random.Random(5), []
    for _ in range(60):
        base = r.getrandbits(128)
        for _ in range(4):
            flipped = base
            for _ in range(r.randrange(6)):
                flipped ^= 1 << r.randrange(128)
            prints.append(flipped)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints] + [(None, 1)]
    df = spark.createDataFrame(rows, "f0 long, f1 long")
    for radius in (0, 2, 3, 5):
        want = {(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= radius}
        found = simhash.within_radius(df, df, radius).collect()
        join = lambda x, y: ((x % (1 << 64)) << 64) | (y % (1 << 64))
        assert len(found) == len(want)
        assert {(join(x["a0"], x["a1"]), join(x["b0"], x["b1"])) for x in found} == want


def plain_print(text):
    """Every word votes with the square of its length on the 64 bits of two hashes of it."""
    lanes = [[0] * 64, [0] * 64]
    total = 0
    for word in re.split(r"[\x20\x09-\x0D]+", text):
        weight = min(len(word), 16) ** 2
        total += weight
        b = xxhash.xxh64(word.encode(), seed=xxhash.xxh64(b"b", seed=42).intdigest()).intdigest()
        for lane, h in zip(lanes, (xxhash.xxh64(word.encode(), seed=42).intdigest(), b), strict=True):
            for k in range(64):
                lane[k] += weight * (h >> k & 1)
    f0, f1 = (sum((2 * v > total) << k for k, v in enumerate(lane)) for lane in lanes)
    return f"{f0:016x}{f1:016x}"


def test_fingerprints_bit_by_bit(spark, frame, prose, odd):
    rows = [*odd, (40, "Ωμέγα ß\tß\n\n" + "x" * 40), *((50 + k, prose(9 + 7 * k, k)) for k in range(12))]
    texts = {}
    for k, t in rows:
        texts.setdefault(k, set()).add(plain_print(t or ""))
    for r in simhash.fingerprints(frame(rows)).collect():
        assert r["fingerprint"] in texts[r["doc_id"]]
