from __future__ import annotations

import random

import numpy as np
import pytest

from dutyframe.llm import toxicity

INSULTS = "gronkhead blatherskite dunderpate".split()


@pytest.fixture(scope="module")
def data(spark, prose):
    rows, labels = [], []
    for k in range(700):
        r, words = random.Random(k), prose(40 + k % 90, k).split()
        bad = k % 5 == 0
        if bad:
            for _ in range(1 + k % 4):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_documents(data):
    docs, labels, truth = data
    model = toxicity.train(docs.filter("doc_id < 500"), labels.filter("doc_id < 500"))
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs.filter("doc_id >= 500"), model).collect()}
    right = np.mean([found[k][1] == truth[k] for k in found])
    caught = np.mean([found[k][1] for k in found if truth[k]])
    assert right > 0.95 and caught > 0.85
    kept = {r["doc_id"] for r in toxicity.keep_ordinary(docs.filter("doc_id >= 500"), model).collect()}
    assert kept == {k for k in found if not found[k][1]}


def test_odd_rows(data, frame, odd):
    docs, labels, _ = data
    model = toxicity.train(docs, labels)
    found = toxicity.score(frame(odd), model).collect()
    assert len(found) == len(odd) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(frame(odd).limit(0), model).isEmpty()
    assert toxicity.keep_ordinary(frame(odd), model).columns == frame(odd).columns


def test_nothing_to_learn(data, frame, odd):
    docs, labels, _ = data
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.train(docs, some)
        assert {r["predicted"] for r in toxicity.score(frame(odd), model).collect()} == {0}


def test_every_window_of_long_texts_teaches(spark, prose):
    """Insults that stand in few windows of long texts are all counted."""
    rows = []
    for k in range(6):
        words = prose(20_000, k).split()
        for c in range(6):
            words[k * 7 + c * 3000 + 1500] = INSULTS[0]
        rows.append((1, " ".join(words)))
    rows += [(0, prose(20_000, k)) for k in range(100, 106)]
    found = dict(toxicity.peculiar_units(spark.createDataFrame(rows, "toxic int, t string")))
    places = sum(w.split().count(INSULTS[0].encode()) for kind, text in rows if kind for w in toxicity.windows(text))
    assert found[b" gronkhead "] == found[b" gronkhe"] == places >= 36
    assert all(unit in f" {INSULTS[0]} ".encode() for unit in found)
