from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from dutyframe.llm import common, prefix_trie
from dutyframe.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, name long, node long, depth int"


def key(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute(rows, borrow=True):
    convs = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        built[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in own if len(built[c]) == len(path))
        out.append((own[0], len(path), members[path[:-1]][0] if path else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, n):
    r = random.Random(seed)
    rows = []
    for c in [*range(-25, n), 400, 403, 419, 10**15 + 7]:
        if c == 40:
            continue  # a group without its first conversation
        for turn in range(r.choice([1, 1, 2, 3, 4, 5, 8, 9, 17])):
            rows.append((c, turn, ("user", "assistant")[turn % 2], r.choice(["yes", "no", "a b  c", f"own {c}"]) if turn else "hello there"))
    rows += [(7, None, None, None), (7, None, "user", None), (7, 3, "user", "same"), (7, 3, "user", "same"), (7, 3, None, "tie"), (None, 1, "user", "nobody's"), (8, 1, "user:", "x"), (8, 1, "user", ":x")]
    r.shuffle(rows)
    return rows


def trie(spark, rows, borrow=True):
    found = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA), Scratch(), borrow)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_against_brute_force(spark, monkeypatch, hot_rows):
    """Nulls, ties, repeated rows, absent lenders, negative and large ids; the second time common turns and long conversations are hot."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rows = some(hot_rows, 70)
    assert trie(spark, rows) == brute(rows)


def test_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(1000 + c, t, "user", f"w{t} x") for c in range(40) for t in range(3)] + [(5, t, "user", f"w{min(t, 9)} x") for t in range(133)]
    assert trie(spark, rows, False) == brute(rows, False)


def test_nothing_and_a_turnless_conversation(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "a b")]
    assert trie(spark, rows) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
