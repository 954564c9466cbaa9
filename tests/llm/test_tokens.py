"""Piece-wise encoding against the library's own."""

from array import array

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.tokens import PieceEncoder, public_path

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
PLAIN = {f: Tokenizer.from_file(public_path(f)) for f, _ in FILES}
OURS = {f: PieceEncoder(public_path(f), k, limit_bytes=9000) for f, k in FILES}


def check(file, texts):
    ids, starts = OURS[file].encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert array("I", ids[a:b].tolist()) == array("I", PLAIN[file].encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("file", [f for f, _ in FILES])
def test_cases(file):
    check(file, ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "The end.\nNext, one!", "it's don't 'tis I'LL", "x\x01y", "\x02z", "a1b2 3c,d.e\nf\n5", "it's,'s 's5 5's $a$ a_b _c", "tab\tx\ty \x1fz", "e\u0301 x\u0301,y", "² a²b 5²", "<|endoftext|> a", "<|ENDOFTEXT|> a", "naïve ÉCOLE é İ ſ", "日本 語", "a b c", "1234 5.6e7", "\x85 a", "a\tb", "… — “q”", "word " * 300, "W" * 3000])
    check(file, ["same words here", "same words here", "here same words"] * 20)


@pytest.mark.parametrize("file", [f for f, _ in FILES])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAB12 ,.\n'1\té́\x01\x02|<>ß中_-")), max_size=30), min_size=1, max_size=4))
def test_any_text(file, texts):
    check(file, texts)


@pytest.mark.parametrize("file", [f for f, _ in FILES])
def test_long_irregular_text(file, monkeypatch):
    from lodestar.llm import tokens

    monkeypatch.setattr(tokens, "LONG", 40)
    monkeypatch.setattr(tokens, "JOINED", 60)
    check(file, ["one two  three, four\n\nfive 'six' " * 30, " a  b" * 50, "x" * 300 + "  y z"])
    check(file, [" ".join(f"word{i} café{i}, x" for i in range(200))])


def test_memory_is_bounded():
    e = PieceEncoder(public_path("byte_bpe_50k.json"), True, limit_bytes=400_000)
    for k in range(20):
        e.encode(pa.array([" ".join(f"new{k}x{i}" for i in range(500))]))
        assert (len(e.memo) + len(e.older)) * 190 < 600_000


def test_plain_words_skip_the_normalizer(monkeypatch):
    file = "word_bpe_49k.json"
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
    words = ["".join(letters[(i * k) % len(letters)] for k in range(1, 2 + i % 9)) for i in range(1, 400)]
    check(file, [" ".join(words), " ".join(letters), "÷ é÷é", "Àà Éé", "é é", "x" * 2000])
    e, normalized = PieceEncoder(public_path(file), False), []
    whole, together = e.whole, e._together
    monkeypatch.setattr(e, "whole", lambda texts: normalized.extend(texts) or whole(texts))
    monkeypatch.setattr(e, "_together", lambda units, glue: normalized.extend(units if glue != " " else []) or together(units, glue))
    e.encode(pa.array([" ".join(words), "the the The, 12 Éa", "a ÷"]))
    assert sorted(normalized) == sorted([",", "12", "÷", "Éa"])


def test_a_word_is_remembered_once_with_and_without_space():
    e = PieceEncoder(public_path("word_bpe_49k.json"), False)
    e.encode(pa.array(["word word", "Word", " word "]))
    assert set(e.memo) == {b"word", b""}
