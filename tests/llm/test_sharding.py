from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

from dutyframe.llm.sharding import shard_table


def walk(key: int, shards: int) -> int:
    state, at, ahead = key, -1, 0
    while ahead < shards:
        at = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


def key_of(value) -> int:
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:15], 16)


def test_against_the_plain_walk(spark, frame, prose):
    rows = [(k, prose(5, k)) for k in range(400)]
    found = shard_table(frame(rows)).collect()
    texts = dict(rows)
    for r in found:
        h = key_of(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (walk(h, 16), walk(h, 17))
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["grown_shard"] in (r["shard"], 16)


def test_slots_without_gaps(spark, frame, odd):
    found = shard_table(frame(odd + [(9, "same")] * 500)).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert len(found) == len(odd) + 500
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["size"] for r in found if r["doc_id"] in (1, 2)} == {1}


def test_carries_columns_and_takes_no_rows(spark, frame, odd):
    docs = frame(odd)
    found = shard_table(docs, carry=("text", "source", "n_chars"))
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(odd)
    assert shard_table(docs.limit(0)).isEmpty()
