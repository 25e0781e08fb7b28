from __future__ import annotations

from collections import Counter

import numpy as np

from dutyframe.llm import decontamination as dc


def brute(rows, items):
    """Best similarity of any window of the item's number of words."""
    out = {}
    for k, text in rows:
        w = dc.words_of(text) if text else np.empty(0, np.uint64)
        for item, body in items:
            v = dc.words_of(body) if body else np.empty(0, np.uint64)
            if not len(v) or len(w) < min(dc.WIDTH, len(v)):
                continue
            width, m = min(dc.WIDTH, len(v)), min(len(v), len(w))
            want = Counter(dc.shingle_hashes(v, width).tolist())
            best = 0.0
            for s in range(len(w) - m + 1):
                have = Counter(dc.shingle_hashes(w[s : s + m], width).tolist())
                best = max(best, sum((want & have).values()) / sum((want | have).values()))
            if best >= dc.THRESHOLD:
                out[(k, item)] = round(best, 9)
    return out


def case(prose, odd):
    items = [(k, prose(25 + k, 1000 + k)) for k in range(12)] + [(50, "one two three"), (51, None), (52, "  ")]
    rows = list(odd)
    for k in range(60):
        text = prose(90, k)
        body = items[k % 12][1].split()
        if k % 3 == 0:
            body[k % len(body)] = "changed" if k % 2 else body[k % len(body)].upper() + "!!"
        if k % 4:
            text = text[: 7 * k] + " " + "; ".join(body) + " " + text[7 * k :]
        rows.append((100 + k, text))
    rows.append((400, " ".join(items[3][1].split()[:-1])))
    return rows, items


def test_against_all_windows(spark, frame, prose, odd):
    rows, items = case(prose, odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in dc.contaminated(frame(rows), bench).collect()}
    assert found == brute(rows, items)
    kept = {r["doc_id"] for r in dc.drop_contaminated(frame(rows), bench).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in found}


def test_several_passes_and_no_benchmark(spark, frame, prose, odd, monkeypatch):
    rows, items = case(prose, odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "PASS_BYTES", 500)
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in dc.contaminated(frame(rows), bench).collect()}
    assert found == brute(rows, items)
    assert dc.contaminated(frame(rows), bench.limit(0)).isEmpty()
    assert dc.contaminated(frame(rows).limit(0), bench).isEmpty()


def test_radius_is_complete(prose):
    index = dc.Index([(k, prose(30, k)) for k in range(50)])
    rng = np.random.default_rng(1)
    for print_ in index.prints[:20]:
        bits = rng.choice(64, dc.RADIUS, replace=False)
        moved = np.uint64(int(print_) ^ sum(1 << int(b) for b in bits))
        near = {k for k in range(50) if (int(index.prints[k]) ^ int(moved)).bit_count() <= dc.RADIUS}
        assert set(index.within_radius(moved).tolist()) == near
