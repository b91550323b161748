from __future__ import annotations

import random
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer

from tidemill.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_against_the_library(spark):
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x2FFF) if unicodedata.category(chr(i)) != "Cs"] + list("aeiou st'\n ") * 300
    texts = ["".join(rng.choices(letters, k=40)) for _ in range(400)]
    texts += [None, "", " ", "a" * 3000, "ab" * 500, "x<|endoftext|>y <|endoftext|>", "don't  stop\n\n now", "\x1c\x85 ", "the " * 2000]
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in T.token_counts(df, PATH).collect():
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_very_long_pre_tokens():
    m, library, rng = T.Merger(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH), random.Random(5)
    for text in ("a" * 100_001, "".join(rng.choices("etaoinshr", k=60_000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=100_000)), "=-" * 9_000):
        assert m.counts([text]) == [len(library.encode(text).ids)]


def test_known_words_stay_right_when_forgotten(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 3)
    m = T.Merger(open(PATH, encoding="utf-8").read())
    library = Tokenizer.from_file(PATH)
    text = "several different words make the memory overflow again and again"
    assert m.counts([text]) == [len(library.encode(text).ids)]


def test_clashing_names_repeats_and_long_texts(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, "the same", "x", 5, True), (1, "the same", "x", 5, True), (None, "no id", "y", 6, False), (2, "long text, " * 40_000, "z", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, n_bytes int, over_limit boolean")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(df, PATH).collect()), key=repr)
    assert got == sorted(((i, len(t), n := len(library.encode(t).ids), n > 1024) for i, t, *_ in rows), key=repr)
