from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from dutyframe.llm import suffix_dedup as sd

L = sd.LENGTH


def brute(rows):
    seen: dict[bytes, int] = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        for i in range(len(b) - L + 1):
            seen[b[i : i + L]] = seen.get(b[i : i + L], 0) + 1
    out = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - L + 1):
            if seen[b[i : i + L]] > 1:
                gone[i : i + L] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def rows_for(prose, odd):
    passage, rows = prose(70, 99), list(odd)
    for k in range(40):
        r = random.Random(k)
        text = prose(60, k)
        if k % 3 == 0:
            at = r.randrange(len(text))
            cut = passage[r.randrange(150) : len(passage) - r.randrange(100)]
            text = text[:at] + cut + text[at:]
        rows.append((100 + k, text))
    rows += [(300, "é" * 400), (301, "ab" * 300 + passage[:250]), (302, passage), (303, passage), (304, passage[:199]), (305, passage[1:201])]
    return rows


def test_against_all_strings(spark, frame, prose, odd):
    rows = rows_for(prose, odd)
    found = sd.remove_repeats(frame(rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_frequent_grams_take_the_other_way(spark, frame, prose, odd, monkeypatch):
    monkeypatch.setattr(sd, "MERGE_ROWS", 2)
    rows = rows_for(prose, odd)
    found = sd.remove_repeats(frame(rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_loser_tree(n):
    r, runs, everything = random.Random(n), [], []
    for k in range(n):
        own = sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(0, 40)))
        everything += own
        lengths, rests = sd.front_code(own)
        runs.append(sd.Run(lengths.tolist(), rests, [(k, i) for i in range(len(own))]))
    merged = list(sd.merge(runs))
    assert [s for _, s, _ in merged] == sorted(everything)
    before = b""
    for _, s, shared in merged:
        assert shared == sd.shared_length(before, s)
        before = s


def test_front_coding():
    assert sd.shared_length(b"abcd" * 50 + b"x", b"abcd" * 50 + b"y", 3) == 200
    lengths, rests = sd.front_code([b"abc", b"abd", b"b"])
    assert (lengths.tolist(), rests) == ([0, 2, 0], [b"abc", b"d", b"b"])


def test_empty(frame, odd):
    assert sd.remove_repeats(frame(odd).limit(0)).isEmpty()
