"""The operators against brute force on awkward rows, hot keys and empty tables."""

import dataclasses
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from zipledger.llm import (decontaminate, fingerprint, lm, minhash, packing, quality, suffix_array, suffix_tree,
                           token_files, toxicity)
from zipledger.llm.tokens import default_vocabulary

ITEMS = [(1, brute.prose(99, 25)), (2, "KAna lo-ro!"), (3, None), (4, "Two words"), (None, brute.prose(5, 15)),
         (5, brute.prose(99, 25)), (6, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    return brute.table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.table(spark, [])


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


COLUMNS1 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination(spark, docs, none):
    named = [(i, t) for i, t in ITEMS if i is not None]
    want = brute.ordered(brute.decontaminated(brute.texts(), named))
    assert brute.rows_of(decontaminate.report(docs, items(spark, named)), *COLUMNS1) == want
    assert decontaminate.report(docs, items(spark)).filter("contaminated").count() >= sum(r[5] for r in want)
    assert decontaminate.report(none, items(spark)).count() == 0
    assert decontaminate.report(docs, items(spark, [])).filter("contaminated").count() == 0
    assert decontaminate.report(docs, items(spark, [(1, None)])).count() == len(brute.texts())


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    named = [(i, t) for i, t in ITEMS if i is not None]
    want = brute.ordered(brute.decontaminated(brute.texts(), named))
    assert brute.rows_of(decontaminate.report(docs, items(spark, named)), *COLUMNS1) == want


def test_decontamination_removes(spark, docs):
    bench = items(spark, [(1, brute.prose(99, 25))])
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns
    clean = [d for d, t in brute.texts() if not brute.decontaminated([(d, t)], [(1, brute.prose(99, 25))])[0][5]]
    assert brute.rows_of(left, "doc_id") == brute.ordered([(d,) for d in clean])
    spans = decontaminate.remove(docs, bench, what="spans")
    assert spans.columns == docs.columns and spans.count() == docs.count()
    assert decontaminate.report(spans, bench).filter("contaminated").count() == 0
    assert spans.filter("doc_id = 20").first()["text"] == dict(brute.texts())[20]
    with pytest.raises(ValueError):
        decontaminate.remove(docs, bench, what="nothing")


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_tree(docs, none, hot, monkeypatch):
    rule = suffix_tree.rule
    monkeypatch.setattr(suffix_tree, "rule", lambda n: dataclasses.replace(rule(n), hot=hot))
    got = brute.rows_of(suffix_tree.report(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.ordered(brute.repeated_words(brute.texts()))
    assert suffix_tree.report(none).count() == 0
    assert suffix_tree.remove(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_array(docs, none, hot, monkeypatch):
    rule = suffix_array.rule
    monkeypatch.setattr(suffix_array, "rule", lambda n: dataclasses.replace(rule(n), hot=hot))
    got = brute.rows_of(suffix_array.report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.ordered(brute.repeated_bytes(brute.texts()))
    assert suffix_array.report(none).count() == 0


def test_suffix_array_texts(docs):
    left = suffix_array.remove(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert left.filter("doc_id = 11").first()["text"] == ""
    assert left.filter("doc_id = 10").first()["text"] == brute.prose(1, 200)


def test_orders_agree():
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 100, 60, dtype=np.uint8))
    strings = [bytes(rng.integers(97, 99, 50, dtype=np.uint8)) for _ in range(300)]
    strings += [base[:k] + bytes(rng.integers(97, 99, 50 - k, dtype=np.uint8)) for k in range(26, 50)] * 3
    order, common = suffix_array.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    sequences = [[bytes([c]) for c in s] for s in strings]
    for limit in (4096, 5):
        suffix_tree.GROUP, old = limit, suffix_tree.GROUP
        found, shared = suffix_tree.tree_order(sequences)
        suffix_tree.GROUP = old
        assert sorted(found.tolist()) == list(range(len(strings)))
        for got, depth in ((order, common), (found, shared)):
            for k in range(1, len(got)):
                a, b = strings[got[k - 1]], strings[got[k]]
                assert depth[k] == next((i for i in range(50) if a[i] != b[i]), 50)


COLUMNS3 = ["doc_id", "n_chars", "edited_sha256"]


def test_fingerprints(docs, none, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 5000)
    got = fingerprint.report(docs).collect()
    rows = sorted(((d, t or "") for d, t in brute.texts() if d is not None), key=lambda r: -r[0])
    after = {d: rows[i + 1] if i + 1 < len(rows) else None for i, (d, _) in enumerate(rows)}
    assert len(got) == len(brute.texts())
    by_text = defaultdict(set)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        text = next((t for d, t in brute.texts() if d == r["doc_id"]), None) if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            by_text[text or ""].add(r["fingerprint"])
            assert r["n_chars"] == len(text or "")
        if r["doc_id"] is not None and r["doc_id"] != 23 and after[r["doc_id"]]:
            k, text = len(text or "") // 3, text or ""
            assert r["edited_sha256"] == brute.sha(text[:len(text) - k] + after[r["doc_id"]][1][:k])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) >= len(by_text) - 1  # white space only may be as empty
    long = next(r for r in got if r["doc_id"] == 20)
    assert long["near_edited"] > 0.5 and long["near_next"] < 0.05
    assert fingerprint.report(none).count() == 0


def test_fingerprint_of_an_edit(spark):
    text = ". ".join(brute.prose(k, 9) for k in range(40))
    rows = [(3, text), (2, text.replace(" ", " longer ", 1)), (1, brute.prose(90, 300))]
    got = {r["doc_id"]: r for r in fingerprint.report(brute.table(spark, rows)).collect()}
    assert got[3]["near_next"] == pytest.approx(38 / 40)  # one of twenty pairs of sentences
    assert got[2]["near_next"] == 0
    assert got[3]["fingerprint"] != got[2]["fingerprint"] and 0.5 < got[3]["near_edited"] < 0.85


@pytest.mark.parametrize("at", [0, 1, 7, 30])
def test_fingerprint_of_an_inserted_sentence(spark, at):
    line = [brute.prose(k, 9) + "." for k in range(60)]
    rows = [(2, " ".join(line)), (1, " ".join(line[:at] + ["Put in here."] + line[at:]))]
    got = {r["doc_id"]: r for r in fingerprint.report(brute.table(spark, rows)).collect()}
    assert 0.85 < got[2]["near_next"] < 1  # one line: all cuts after the sentence are where they were


def test_fingerprint_differences(spark):
    a, b = list(range(1, 400)), list(range(200, 700))
    check = "transform({0}, h -> shiftleft(h, 16) | (xxhash64(h) & 65535L))"
    pairs = spark.createDataFrame([(1, "p", a, b), (2, "p", [], []), (3, "p", a, a)],
                                  "row long, pair string, a array<long>, b array<long>")
    pairs = pairs.withColumns({c: F.expr(check.format(c)) for c in "ab"})
    got = {r["row"]: r for r in fingerprint.differences(pairs).collect()}
    assert sorted(x >> 16 for x in got[1]["added"]) == list(range(1, 200))
    assert sorted(x >> 16 for x in got[1]["removed"]) == list(range(400, 700))
    assert not got[2]["added"] and not got[3]["removed"]


def _ids(text, end):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files(spark, docs, none, scratch):
    token_files.write(docs, scratch + "/t")
    got = token_files.digest(token_files.read(spark, scratch + "/t")).collect()
    assert len(got) == len(brute.texts())
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])
    at, seen = 0, []
    for r in sorted(got, key=key):
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    want = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in brute.texts() for i in [_ids(t, 2)]]
    assert brute.ordered(seen) == brute.ordered(want)
    token_files.write(none, scratch + "/e")
    assert token_files.digest(token_files.read(spark, scratch + "/e")).count() == 0


def test_packing(docs, none):
    size = 256
    rows = packing.pack(docs, size=size).collect()
    want = brute.ordered([(d, len(i), i) for d, t in brute.texts() for i in [_ids(t, 1)]])
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    for doc_id, n, ids in want:
        mine = {(r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id and r["doc_tokens"] == n}
        cuts = range(0, n, size)
        for c in cuts:
            part = ids[c:c + size]
            assert (c, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) in mine
    assert sum(r["length"] for r in rows) == sum(n for _, n, _ in want)
    assert packing.pack(none).count() == 0


def test_packing_patterns():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 5000, 300))}
    packs = packing.patterns(histogram, 2048)
    used = defaultdict(int)
    for count, lengths in packs:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += count
    assert dict(used) == histogram
    assert sum(k * v for k, v in histogram.items()) >= 0.95 * 2048 * sum(c for c, _ in packs)


def test_minhash(docs, none, monkeypatch):
    got = brute.rows_of(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.ordered(brute.near(brute.texts()))
    assert minhash.near_duplicates(none).count() == 0
    left = minhash.keep(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 11 not in ids and ids.count(23) == 1  # a row that repeats another goes
    assert minhash.keep(none).columns == none.columns and minhash.keep(none).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_minhash_chain_and_dense_group(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    base, rows = brute.prose(50, 300).split(" "), []
    for i in range(12):  # a chain: neighbours are alike, the ends are not
        words = list(base)
        words[:6 * i] = [f"w{k}x{k % 7}" for k in range(6 * i)]
        rows.append((100 + i, " ".join(words)))
    for i in range(25):  # a dense group
        words = brute.prose(60, 200).split(" ")
        words[3 * i] = f"other{i}"
        rows.append((200 + i, " ".join(words)))
    got = brute.rows_of(minhash.near_duplicates(brute.table(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.ordered(brute.near(rows))


def test_lm(docs, none):
    got = lm.scores(docs).collect()
    assert len(got) == len(brute.texts())
    for r in got:
        assert (r["mean_log_score"] is None) == (r["n_words"] == 0)
    twenty = next(r for r in got if r["doc_id"] == 20)
    assert twenty["n_words"] == 9000 and twenty["log_score"] < 0
    # an exact copy elsewhere makes every pair known
    ten, sixteen = (next(r for r in got if r["doc_id"] == d) for d in (10, 16))
    assert ten["mean_log_score"] > sixteen["mean_log_score"]
    assert lm.scores(none).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_by_brute_force(spark, monkeypatch, order):
    # word lists of few words, so that all orders meet again; many parts and buckets
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 10)
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 40))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a"), (103, rows[5][1]), (103, rows[5][1])]
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lm.scores(brute.table(spark, rows), order).collect()]
    assert sorted(got) == sorted(brute.backoff(rows, order, lm.ALPHA))


def test_lm_messages():
    rng = np.random.default_rng(1)
    columns = [np.empty(0, np.uint64), np.zeros(5, np.uint64), np.array([2 ** 64 - 1], np.uint64),
               rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 3, 1000).astype(np.uint64)]
    assert [c.tolist() for c in lm._unpack(lm._pack(columns))] == [c.tolist() for c in columns]
    h = np.unique(rng.integers(0, 2 ** 64 - 1, 5000, dtype=np.uint64, endpoint=True))
    for buckets in (1, 2, 7, 300):
        deal = lm.Deal(buckets)
        back = [(deal.begins[b] + np.cumsum(deal.gaps(h[s], b), dtype=np.uint64)).tolist() for b, (s,) in deal.parted([h])]
        assert sum(back, []) == h.tolist()


def test_lm_by_hand(spark):
    rows = [(1, "a b a b"), (2, "a b c"), (3, "z")]
    got = {r["doc_id"]: r["log_score"] for r in lm.scores(brute.table(spark, rows), order=2).collect()}
    # elsewhere: a 2, b 2, "a b" 2, "b a" 1 of 5 words; "b c" and c occur only here
    want = np.log(2 / 5) + np.log(2 / 2) + 2 * np.log(0.4) - np.log(6)
    assert got[2] == pytest.approx(want)
    assert got[3] == pytest.approx(2 * np.log(0.4) - np.log(8))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, none):
    known = labels(spark, [(10, 1, 0), (18, 1, 0), (20, 1, 0), (24, 0, 0), (None, 1, 1), (99, 1, 0), (11, None, None)])
    got = quality.resample(docs, known, share=0.5).collect()
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert sum(r["kept"] for r in got) == len(got) // 2
    assert min(r["gumbel_key"] for r in got if r["kept"]) >= keys[len(got) // 2] or len(set(keys)) < len(keys)
    assert next(r for r in got if r["doc_id"] == 20)["kept"]
    assert quality.resample(none, known).count() == 0
    uniform = quality.resample(docs, labels(spark, []), share=0.5).collect()
    assert all(r["log_weight"] == 0 for r in uniform if r["doc_id"] in (13, 14)) and sum(r["kept"] for r in uniform)


def toxic_corpus(spark):
    rows, marks = [], []
    for i in range(240):
        words = brute.prose(1000 + i, 40).split(" ")
        bad = i % 4 == 0
        if bad:
            words[10], words[20] = "blurghed", "snarkling" + "abc"[i % 3]
        rows.append((i, " ".join(words) + "."))
        marks.append((i, 1, int(bad)))
    rows += [(None, "blurghed snarklinga"), (500, None), (501, ""), (502, "blurghed snarklingb " * 3000), (0, rows[0][1])]
    return brute.table(spark, rows), labels(spark, marks + [(None, 1, 1), (7, None, None), (900, 1, 1)])


def test_toxicity(spark, none):
    docs, marks = toxic_corpus(spark)
    got = toxicity.scored(docs, marks).collect()
    assert len(got) == 245
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(r["doc_id"] % 4 == 0, r["predicted"] == 1) for r in got if r["held_out"] and r["doc_id"] < 240]
    assert all(a == b for a, b in held)
    assert toxicity.scored(none, marks).count() == 0
    empty = [r["score"] for r in got if r["doc_id"] in (500, 501)]
    assert empty[0] == empty[1] < 0.5
    left = toxicity.keep(docs, marks)
    assert left.columns == docs.columns and 502 not in [r["doc_id"] for r in left.collect()]
    assert toxicity.scored(docs, labels(spark, [])).count() == 245


def test_toxicity_grammar():
    symbols, grammar = toxicity.Symbols({"^idio": 4.0}), toxicity.Composition()
    read = lambda t: dict(zip(toxicity.READINGS, toxicity.readings(t, symbols, grammar)))
    assert read("What an idiot.")["plain"] == 4
    assert read("You are an idiot.")["targeted"] == 4
    assert read("He is not an idiot.")["negated"] == 4
    assert read("She said what an idiot.")["reported"] == 4
    assert read("I will kill you.")["threat"] == toxicity.THREAT_WEIGHT
    assert read("Not good. An idiotic plan")["plain"] == 4
    assert not any(read("").values()) and not any(read(None).values())
