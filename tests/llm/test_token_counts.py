from __future__ import annotations

import pytest

from dutyframe.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
FILE = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    with open(FILE, encoding="utf-8") as f:
        return token_counts.PreTokens(f.read())


def test_every_letter_counts_as_the_library_does(own):
    def mine(text):
        specials, counts = own.split(text)
        return specials + sum(own.pieces(k) * n for k, n in counts.items())

    some = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}Bc {chr(c)}'S{chr(c)}" for c in some] + ["x<|endoftext|>y<|startoftext|> z", "<|ENDOFTEXT|>", "it's 'RE 12½ don't", ""]
    assert [mine(t) for t in texts] == [len(e.ids) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts(spark, frame, prose, odd, own):
    rows = odd + [(100 + k, prose(30 * k, k) + " <|endoftext|> ἀρχή 東京 ok") for k in range(60)]
    found = token_counts.count_tokens(frame(rows), FILE, limit=50).collect()
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    want = sorted(((k, len((t or "").encode()), len(own.tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in rows), key=key)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=key) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in found)


def test_without_common_pre_tokens(spark, frame, prose, own, monkeypatch):
    monkeypatch.setattr(token_counts, "SAMPLE_ROWS", 1)
    rows = [(k, prose(40, k)) for k in range(20)]
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(rows), FILE).collect()}
    assert found == {k: len(own.tokenizer.encode(t, add_special_tokens=False).ids) for k, t in rows}


def test_empty(frame, odd):
    assert token_counts.count_tokens(frame(odd).limit(0), FILE).isEmpty()
