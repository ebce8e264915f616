"""Periodic runs, spelling variants, byte-pair ids and token ids against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm import brute
from zipledger.llm import byte_pairs, periodic, variants
from zipledger.llm.tokens import default_vocabulary, encoder


@pytest.fixture(scope="module")
def docs(spark):
    return brute.table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.table(spark, [])


# -- periodic runs ---------------------------------------------------------------------

def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, 2 * q) and not any(
                    q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def periodic_words(seed: int) -> list[str]:
    """Words of one of eight shapes: random, powers, mirrored and nested repeats, Fibonacci words."""
    rng = random.Random(seed)
    pick = lambda letters, n: [rng.choice(letters) for _ in range(n)]
    shape, n = seed % 8, rng.randrange(140)
    if shape < 2:
        return pick("ab" if shape else "abcdefgh", n)
    if shape == 2:
        u = pick("abcd", rng.randrange(1, 40))
        return u * rng.randrange(1, 6) + u[:rng.randrange(len(u) + 1)]
    if shape == 3:
        return list("ab" * rng.randrange(5, 40) + "ba" * rng.randrange(5, 40) + "a" * rng.randrange(30))
    if shape == 4:
        return list("a" * rng.randrange(1, 70) + "c" * rng.randrange(1, 70)) * rng.randrange(2, 4)
    if shape == 5:
        a, b = ["a"], ["a", "b"]
        while len(b) < 150:
            a, b = b, b + a
        return b[:n + 60]
    x = ["a"]
    while len(x) < 120:
        x += [x[-rng.randrange(1, len(x) + 1):], pick("ab", 1) * rng.randrange(1, 20), x[:rng.randrange(1, len(x) + 1)]][rng.randrange(3)]
    return x[:180] if shape == 6 else list("abababa"[:rng.randrange(3, 8)]) * 9 + x[:60]


def test_runs_equal_brute_force():
    words = [periodic_words(k) for k in range(800)]
    for w, (n, got) in zip(words, periodic.runs_of([" ".join(w).encode() for w in words])):
        assert n == len(w) and got == brute_runs(w), w


def test_long_periodic_texts():
    for unit, times in ((["a"], 200_000), (["a", "b"], 100_000), ([str(i) for i in range(1000)], 200)):
        (n, got), = periodic.runs_of([" ".join(unit * times).encode()])
        assert got == [(0, len(unit) * times, len(unit))]


def brute_periodic(doc, text):
    w = (text or "").encode().split()
    runs = brute_runs(w) if len(w) < 2000 else []  # the long text of the table is random
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (doc, len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            brute.sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            brute.sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


COLUMNS11 = [c.split()[0] for c in periodic.REPORT.split(", ")]


def test_periodic_report(spark, docs, none):
    assert brute.rows_of(periodic.report(docs), *COLUMNS11) == brute.ordered(brute_periodic(d, t) for d, t in brute.texts())
    assert periodic.report(none).count() == 0 and periodic.runs(none).count() == 0
    rows = [(k, " ".join(periodic_words(k))) for k in range(2, 40)] + [(None, "x " * 30), (50, None), (51, "")]
    table = brute.table(spark, rows)
    want = brute.ordered((d, *r) for d, t in rows for r in brute_runs((t or "").split()))
    assert brute.rows_of(periodic.runs(table), "doc_id", "start", "length", "period") == want
    left = periodic.collapse(table)
    assert left.columns == table.columns
    kept = dict(brute.rows_of(left.filter("doc_id is null or doc_id > 49"), "doc_id", "text"))
    assert kept == {None: "x", 50: None, 51: ""}


def test_planted_periods(docs):
    def want(doc, text):
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        if doc is None or h % 10 or not w:
            return text
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        return b" ".join(w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))).decode()
    rows = [(d, t) for k in range(40) for d, t in ((k, f"{brute.prose(k, 30)} end"),)]
    for table, have in ((docs, brute.texts()), (brute.table(docs.sparkSession, rows), rows)):
        assert brute.rows_of(periodic.plant(table), "doc_id", "text") == brute.ordered((d, want(d, t)) for d, t in have)


# -- spelling variants -----------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, slips):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if slips and doc is not None and h % slips == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if k > 1 and len(w) > 6}
    best = {w: sorted((-n[x], x) for x in n if near(w, x)) for w in n}
    form = {w: b[0][1] if b and -b[0][0] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return brute.ordered((w, form[w], root(w), n[w], len(best[w]), n[form[w]] if form[w] else None) for w in n)


COLUMNS12 = ["word", "form", "root", "n", "n_near", "form_n"]


def variant_rows():
    rng = random.Random(12)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(40)]
    rows = []
    for k in range(120):
        words = [rng.choice(stems) for _ in range(40)]
        for _ in range(12):
            w = rng.choice(stems)
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "c" + w[i + 1:], w + "ü", w.upper()]))
        rows.append((k if k % 9 else None, " ".join(words)))
    # a chain of forms, each tenfold, a tie, a word of 3,000 letters, runs next to other characters
    chain = ["chainone"] * 2 + ["chaintone"] * 20 + ["chaintwone"] * 200 + ["tieword"] * 2 + ["tiewordb"] * 30 + ["tieworda"] * 30
    long = "q" * 3000
    return [*rows, (900, " ".join(chain)), (901, f"{long} {long} {long}q,{long}q"), (902, None), (903, ""),
            (904, "Straßenbahn×÷ straßenbahn×÷ 1straßen2"), (904, "Straßenbahn×÷ straßenbahn×÷ 1straßen2")]


@pytest.mark.parametrize("limit", [2048, 3])
def test_variants(spark, none, limit):
    rows = variant_rows()
    table = brute.table(spark, rows)
    for slips in (0, 31):
        want = brute_variants(rows, slips)
        got = brute.rows_of(variants.variants(table, slips=slips, limit=limit), *COLUMNS12)
        assert got == want
    assert variants.variants(none).count() == 0
    found = variants.variants(table, limit=limit)
    assert brute.rows_of(variants.grouped(found).filter("root = 'chaintwone'"), "root", "n_variants", "n") == [("chaintwone", 3, 222)]


def test_variants_without_words(spark):
    assert variants.variants(brute.table(spark, [(1, "a b c"), (2, None), (3, "oneword")]), slips=31).count() == 0


# -- byte pairs ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    with open(byte_pairs.default_vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(13)
    pools = ["abc ", "aAbB'' \t\n12.,", "".join(map(chr, range(0x250))), "".join(map(chr, range(0x3000))),
             "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000), "the of and ing er st 's 'll \n\n  "]
    out = ["".join(rng.choice(pools[k % 6]) for _ in range(rng.randrange(120))) for k in range(3000)]
    return [*out, "a" * 5000, "ab" * 3000, " " * 999, "\n" * 700 + "x", "é" * 2000, "0" * 1001, "", "<|endoftext|>", "km² ½"]


def test_replay_equals_the_library(library):
    vocab = byte_pairs.vocabulary(byte_pairs.default_vocabulary())
    texts = odd_texts()
    vocab.split("一")
    newer = sorted(vocab._newer)[::5]
    texts += [f"x{c}y 1{c}2 .{c}! {c} {c}{c}é" for c in newer]
    words = sorted({w.encode() for t in texts for w in vocab.split(t)} - vocab.whole.keys())
    memo = {**vocab.whole, **dict(zip(words, byte_pairs.replayed(words, vocab)))}
    for text, want in zip(texts, library.encode_ordinary_batch(texts)):
        ids = byte_pairs.unpacked(b"".join(memo[w.encode()] for w in vocab.split(text))).tolist()
        assert ids == want, text
        assert byte_pairs.decoded(ids, vocab) == text.encode()


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_byte_pair_report(spark, docs, none, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "PART_BYTES", 3000)
    monkeypatch.setattr(byte_pairs, "BUCKET_BYTES", 9000)
    rows = brute.texts() + [(1000 + k, t) for k, t in enumerate(odd_texts()[::10])]
    table = brute.table(spark, rows)
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(packed(ids)).hexdigest(), brute.sha(text or "")))
    got = brute.rows_of(byte_pairs.report(table), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == brute.ordered(want)
    assert byte_pairs.report(none).count() == 0
    ids = byte_pairs.encode(docs)
    back = byte_pairs.decode(ids).collect()
    assert sorted(bytes(r["ids"]) for r in back) == sorted((t or "").encode() for _, t in brute.texts())


def test_packed_numbers_and_words():
    import numpy as np
    rng = np.random.default_rng(1)
    for numbers in ([], [0], [191, 192, 193, 255, 256, 2 ** 32 - 1], rng.integers(0, 1 << 20, 5000), rng.integers(0, 300, 5000)):
        numbers = np.array(numbers, np.uint32)
        assert byte_pairs._unpack_numbers(byte_pairs._pack_numbers(numbers)).tolist() == numbers.tolist()
    for words in ([], [b""], [b"a", b"", b"\n" * 500, b"x" * 70_000]):
        assert byte_pairs._unpack(byte_pairs._pack(words)) == words
        ids = [w * 4 for w in words]
        assert byte_pairs._unpack_ids(byte_pairs._pack_ids(ids)) == ids


def test_byte_pair_vocabulary_is_checked(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary(str(path))


# -- token ids of the word vocabulary --------------------------------------------------

def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer
    whole, rng = Tokenizer.from_file(default_vocabulary()), random.Random(5)
    latin = list(map(chr, range(0x180)))
    pools = [latin, [c for c in latin if c.isalpha()] + list(" .,'²"), [chr(c) for c in range(0x250, 0x3000)],
             [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]]
    texts = ["km²", "12 m²", "x² + y²", "co² level", "¼²", "İstanbul ŉ ſ Å"]
    texts += ["".join(rng.choice(pools[k % 4] if rng.random() < .7 else "abcdeé '") for _ in range(rng.randrange(1, 25)))
              for k in range(6000)]
    with encoder(default_vocabulary()) as encode:
        for text in texts:
            assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text
