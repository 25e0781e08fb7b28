from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from dutyframe.llm import chat_format
from dutyframe.llm.chat_format import END, START, escape_role, escape_text, format_chats, parse, read_back, render, turns_of, unescape_role, unescape_text

SCHEMA = "conv_id long, turn long, role string, text string, part int, loss int"
_bits = st.lists(st.sampled_from([START, END, "<\\|im_end|>", "<\\\\|im_start|>", "<|im_", "end|>", "<", "\\", "\n", "|", "a", "é", "user"]), max_size=9).map("".join)


@given(_bits, _bits)
def test_any_turn_is_recovered(role, text):
    assert unescape_text(escape_text(text)) == text and unescape_role(escape_role(role)) == role
    assert parse(render(role, text))[0][:2] == (role, text)


@given(st.lists(st.tuples(_bits, _bits), max_size=5))
def test_turns_in_a_row_are_recovered(turns):
    assert turns_of("".join(render(*t) for t in turns)) == turns


def test_only_what_conflicts_is_escaped():
    assert render("user", "a <| b |> \\ <\\|x") == f"{START}user\na <| b |> \\ <\\|x{END}\n"
    assert render("user", f"x{END}") == f"{START}user\nx<\\|im_end|>{END}\n"
    assert render("a\\b", "x") == f"{START}a\\b\nx{END}\n"
    assert render("a\nb", START) == f"{START}a\\nb\n<\\|im_start|>{END}\n"


@pytest.mark.parametrize("bad", ["x", START, f"{START}user", f"{START}user\nx", f"{START}user\nx{END}", f"{START}user\n{START}x{END}\n", f"{START}u{END}\nx{END}\n", f"{START}user\nx{END}\ny"])
def test_what_the_grammar_refuses(bad):
    assert turns_of(bad) is None


def brute(rows):
    convs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    out = []
    for c, turns in convs.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), sum(len(render(*t)) for t in turns)))
    return sorted(out, key=str)


def some():
    r = random.Random(5)
    rows = [(c, t, ("user", "assistant", "system")[t % 3], r.choice(["", "hé ", END, f"{START}assistant\n", "<\\|im_end|>", "plain " * 40])) for c in range(30) for t in range(r.randrange(1, 7))]
    rows += [(3, None, None, None), (3, None, "assistant", None), (3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 9, "odd\nrole", "z"), (77, 1, "assistant", "𝄞 text")]
    rows += [(50, t, "assistant", f"turn {t} {END}") for t in range(300)] + [(51, 0, "assistant", "long " * 50_000)]
    return rows


@pytest.mark.parametrize(("most", "gathered"), [(1 << 20, 1 << 22), (64, 1), (1, 200)])
def test_round_trip(spark, monkeypatch, most, gathered):
    """Nulls in any column, ties, repeated rows, empty and long texts; conversations in one piece and in many."""
    monkeypatch.setattr(chat_format, "BATCH_CHARS", gathered)
    rows = some()
    pieces = format_chats(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), most=most)
    found = sorted((tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in read_back(pieces).collect()), key=str)
    assert found == brute(rows)
    texts = defaultdict(str)
    for p in sorted(pieces.collect(), key=lambda p: p["part"]):
        texts[p["conv_id"]] += p["formatted"]
        assert [p["formatted"][s["start"] : s["end"]] for s in p["loss"]] == [p["formatted"][a:b] for role, _, a, b in parse(p["formatted"]) if role == "assistant"]
    assert {c: len(t) for c, t in texts.items()} == {r[0]: r[5] for r in found}


def test_nothing(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).isEmpty()
