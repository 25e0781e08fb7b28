from __future__ import annotations

import random

import numpy as np
import pytest

from dutyframe.llm import language_id

PARTS = {"aa": "tha ing ion ent ough ly st".split(), "bb": "sch keit ung ein lich pf ei".split(), "cc": "eau oux ent que ail oir eu".split(), "dd": "ción ado iza ero osa lla ña".split()}


def made(lang: str, n: int, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, made(lang, 5 + k % 40, k), lang, "s") for k, lang in ((k, "abcd"[k % 4] * 2) for k in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_codewords_are_apart():
    for n in (2, 4, 6, 11, 30):
        code = language_id.codewords(n).astype(int)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert len(code) == n and min(apart) >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(docs):
    model = language_id.train(docs.filter("doc_id < 200"))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.filter("doc_id >= 200"), model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.filter("doc_id >= 200").collect()}
    assert np.mean([found[k] == truth[k] for k in truth]) > 0.97


def test_odd_rows(docs, frame, odd):
    model = language_id.train(docs)
    found = language_id.identify(frame([*odd, (50, "12 34 !"), (51, made("bb", 30, 1) + " " + made("cc", 30, 1))]), model).collect()
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert {1, 2, 3, 50} == und
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(odd) + 2
    assert language_id.identify(frame(odd).limit(0), model).isEmpty()


def test_nothing_to_learn(docs, frame, odd):
    model = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(frame(odd), model).collect()} == {"und"}
    one = language_id.train(docs.filter("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, one).collect()} == {"aa"}
