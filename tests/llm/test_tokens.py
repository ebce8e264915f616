"""Token ids of many texts at once: slices, remembered words, marks."""

import random

import pyarrow as pa

from zipledger.llm import tokens
from zipledger.llm.tokens import default_vocabulary, encoder


def test_token_ids_of_many_texts(monkeypatch):
    from tokenizers import Tokenizer
    whole, rng = Tokenizer.from_file(default_vocabulary()), random.Random(6)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)  # words are forgotten and met again
    monkeypatch.setattr(tokens, "TOGETHER", 7)
    words = tokens._Words(default_vocabulary())
    pool = ["<|ENDOFTEXT|>", "x<|EndOfText|>", "<|endoftext|>", "\u0130stanbul", "\u201cQuoted\u201d", "T\u0308est", "\u00e9T\u00c9.", "ABC<|",
            "a_b", "--", "don't", "I'll,", "K\u212aM", "\u03a3\u03a3", "m\u00b2", "12.5", "\u4f60\u597d", "a\tb", "\u00a0", "", "The", "the", "THE!"]
    pool += ["".join(rng.choice("abcDE\u00e9\u00c8\u00ff,.") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    for others in (range(20, len(pool)), range(len(pool)), range(20, len(pool))):
        texts = [None, "", " ", "\n\n", "w" * 100]
        texts += [rng.choice(" \n").join(pool[rng.choice(others)] for _ in range(rng.randrange(30))) for _ in range(60)]
        offsets, ids = words.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [
            whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(words.words) <= 40
    with encoder(default_vocabulary()) as encode:
        for text in pool:
            assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_a_word_goes_to_the_library_once(monkeypatch):
    words, asked = tokens._Words(default_vocabulary()), []
    merged = words._merged
    monkeypatch.setattr(words, "_merged", lambda new: asked.extend(new) or merged(new))
    for _ in range(2):
        words.encode(["The cat, the hat.", "A cat (the cat)"] * 500)
    assert sorted(asked) == ["a", "cat", "hat", "the"]


def test_slices_by_bytes_of_text(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    texts = ["abcd", None, "\u00e9\u00e9", "abcd", "x" * 35, "", "y", "z" * 9, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [x.column(1).to_pylist() for x in tokens.slices(batch)]
    assert sum(got, []) == texts and len(got) > 2
    assert all(sum(len((t or "").encode()) for t in x[:-1]) < 20 for x in got)
    assert not list(tokens.slices(batch.slice(0, 0)))
