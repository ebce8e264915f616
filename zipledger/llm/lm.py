"""Stupid-backoff language-model scores, from n-gram counts of the whole corpus.

Count tables are partitioned by the hash of the n-gram and joined to the documents' own
n-grams. One row per n-gram and document would be many times the corpus, so rows are
packed: a part (a few MB of texts) deals its distinct n-grams, in ascending order of their
hashes, to buckets, which are ranges of hashes. This happens twice. First a part sends the
leading bits of its hashes, and a bucket says which of them some other n-gram also has; an
n-gram that is claimed by nobody else occurs in this part alone, so its count is known.
Then only the others are sent, as whole hashes of 64 bits with their counts, each order by
itself; the bucket adds up the parts and answers the totals in the same order. At last the
part looks each of its places up and sums per document. An n-gram is one entry per part
however often it occurs, so frequent ones are no load on their bucket. Hashes of n words
are compared with hashes of n words only; among k distinct n-grams of one order, one in
2 ** 64 / k takes another's count in (a trillion: one in 18 million).

A document is scored by the rest of the corpus: its own counts are taken off the totals.
A word's score is c(context word) / c(context) for the longest context of up to ``order - 1``
words with a count, times ALPHA for each word that the context was shortened by; a word
that occurs nowhere else has ALPHA ** order / (words elsewhere + 1).

Defined results: a null or empty text, or one without words, has 0 words, the sum 0 and a
null mean. Repeated rows are documents of their own, each part of the other's rest. Null
ids pass through. No documents make no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from zipledger.llm.common import id_text, pieces, stage
from zipledger.llm.repeats import MESSAGE
from zipledger.llm.words import TOGETHER, gram_hashes, groups, texts_of, word_hashes

ORDER = 3
ALPHA = 0.4
#: The entry that counts words.
WORDS = np.uint64(0)
#: Bytes of texts in a part, and parts whose n-grams make a bucket.
PART_BYTES = 8 << 20
BUCKET_PARTS = 2
#: Kinds of messages.
CLAIM, TOTAL = 1, 2
CHUNK = StructType([StructField("chunk_part", LongType()), *(
    StructField(name, BinaryType()) for name in ("ids", "none", "sizes", "z"))])
_COLUMNS = ["part", "bucket", "kind", "blob"]


def _chunks(part_bytes: int):
    """Rows of about a megabyte of texts, compressed together, with their ids and lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        task, held, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def row() -> pa.RecordBatch:
            columns = [np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids]),
                       np.array([len(t) for t in texts], "<i8")]
            blobs = [packer.compress(b) for b in (*(c.tobytes() for c in columns), b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + held // part_bytes], pa.int64()),
                                               *(pa.array([b], pa.binary()) for b in blobs)], CHUNK.names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids.append(i)
                texts.append(text)
                size += len(text) + 64
                if size >= min(TOGETHER, part_bytes):
                    yield row()
                    held, size, ids, texts = held + size, 0, [], []
        if texts:
            yield row()
    return run


def _texts(rows: pd.DataFrame) -> list[bytes]:
    unpack, out = zstandard.ZstdDecompressor(), []
    for sizes, z in zip(rows["sizes"], rows["z"]):
        ends, raw = np.cumsum(np.frombuffer(unpack.decompress(sizes), "<i8")).tolist(), unpack.decompress(z)
        out += [raw[a:b] for a, b in zip([0, *ends], ends)]
    return out


def _ids(rows: pd.DataFrame) -> pd.Series:
    unpack = zstandard.ZstdDecompressor()
    ids, none = (np.frombuffer(b"".join(map(unpack.decompress, rows[c])), t) for c, t in (("ids", "<i8"), ("none", bool)))
    return pd.Series(pd.arrays.IntegerArray(ids.copy(), none.copy()))


def _grams(texts: list[bytes], order: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first text, words before each text, hashes of the n-grams from each place on for n = 1, 2 ...)."""
    for a, b in groups(texts):
        words, firsts = word_hashes(texts[a:b])
        yield a, firsts, [gram_hashes(words, n) for n in range(1, order + 1)]


def _inside(firsts: np.ndarray, n: int) -> np.ndarray:
    """Places where ``n`` words of one text begin."""
    ends = np.repeat(firsts[1:], np.diff(firsts))
    return np.flatnonzero(np.arange(len(ends)) + n <= ends)


def _counts(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of a part and their counts for n = 1, 2 ..., in ascending order.

    Those of single words begin with the entry that counts words."""
    found, total = [[np.empty(0, np.uint64)] for _ in range(order)], 0
    for _, firsts, grams in _grams(texts, order):
        total += int(firsts[-1])
        for n, g in enumerate(grams, 1):
            found[n - 1].append(g[_inside(firsts, n)])
    out = []
    while found:
        out.append(np.unique(np.concatenate(found.pop(0)), return_counts=True))
    h, count = out[0]
    return [(np.append(WORDS, h), np.append(total, count)), *out[1:]]


# -- messages --------------------------------------------------------------------------

def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers; the bytes of one rank lie side by side, and those that repeat are compressed."""
    packer, out = zstandard.ZstdCompressor(level=1, write_content_size=True), []
    for column in columns:
        planes = np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        planes = [p.tobytes() for p in planes[:-(-int(column.max()).bit_length() // 8)]] if len(column) else []
        packed = [min(p, packer.compress(p), key=len) for p in planes]
        out += [struct.pack("<IB", len(column), len(packed)), struct.pack(f"<{len(packed)}I", *map(len, packed)), *packed]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    unpacker, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(blob):
        size, used = struct.unpack_from("<IB", blob, at)
        lengths = struct.unpack_from(f"<{used}I", blob, at + 5)
        at += 5 + 4 * used
        column = np.zeros((size, 8), np.uint8)
        for i, length in enumerate(lengths):
            plane = blob[at:at + length]
            column[:, i] = np.frombuffer(plane if length == size else unpacker.decompress(plane), np.uint8)
            at += length
        out.append(column.reshape(-1).view("<u8"))
    return out


class Deal:
    """How ascending hashes are dealt to buckets, which are ranges of hashes."""

    def __init__(self, buckets: int):
        self.width = ((1 << 64) - 1) // buckets
        self.begins = np.arange(buckets, dtype=np.uint64) * np.uint64(self.width)
        # leading bits: a bucket has fewer than PART_BYTES n-grams of one order, so few share theirs by chance
        self.shift = np.uint64(max(0, 64 - PART_BYTES.bit_length() - 1 - buckets.bit_length()))

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each bucket's hashes begin, and the end."""
        return np.append(np.searchsorted(h, self.begins), len(h))

    def parted(self, orders: list[np.ndarray]) -> Iterator[tuple[int, list[slice]]]:
        """(bucket, its hashes of each order) of the buckets that have any."""
        at = [self.places(h) for h in orders]
        for bucket in np.flatnonzero(np.any([np.diff(a) > 0 for a in at], axis=0)).tolist():
            yield bucket, [slice(a[bucket], a[bucket + 1]) for a in at]

    def gaps(self, h: np.ndarray, bucket: int, shift: np.uint64 = np.uint64(0)) -> np.ndarray:
        """A bucket's ascending hashes as differences from the one before, the first from the bucket's begin."""
        h = np.append(self.begins[bucket], h) >> shift
        return np.diff(h)


def _ranks(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The messages' numbers one after the other, each as its rank, and how often each rank comes."""
    every = np.concatenate([np.cumsum(c, dtype=np.uint64) for c in columns])
    _, rank, times = np.unique(every, return_inverse=True, return_counts=True)
    return rank, times


def _answered(rows: pd.DataFrame, kind: int, columns: list[list[np.ndarray]]) -> pd.DataFrame:
    """One message of ``kind`` to each sender; ``columns`` has the orders' answers by sender."""
    blobs = [_pack(list(answer)) for answer in zip(*columns)]
    return pd.DataFrame({"part": rows["part"], "bucket": rows["bucket"], "kind": kind, "blob": blobs}, columns=_COLUMNS)


def _send_claims(order: int, buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        deal, part = Deal(buckets), rows["chunk_part"].iloc[0]
        orders = [h for h, _ in _counts(_texts(rows), order)]
        out = [(part, bucket, CLAIM, _pack([deal.gaps(h[s], bucket, deal.shift) for h, s in zip(orders, at)]))
               for bucket, at in deal.parted(orders)]
        return pd.DataFrame(out, columns=_COLUMNS)
    return run


def _answer_claims(rows: pd.DataFrame) -> pd.DataFrame:
    """To each part a bit for each of its leading bits: whether they come more than once."""
    asked, columns = [_unpack(b) for b in rows["blob"]], []
    for messages in zip(*asked):
        rank, times = _ranks(messages)
        ends = np.cumsum([len(m) for m in messages])[:-1]
        columns.append([np.packbits(x) for x in np.split(times[rank] > 1, ends)])
    return _answered(rows, CLAIM, columns)


def _claimed(deal: Deal, orders: list[np.ndarray], answers: pd.DataFrame) -> list[np.ndarray]:
    """For each order which n-grams another part may have too."""
    bits = {b: _unpack(z) for b, z in zip(answers["bucket"], answers["blob"])}
    out = [np.zeros(len(h), bool) for h in orders]
    for bucket, at in deal.parted(orders):
        for flags, s, packed in zip(out, at, bits[bucket]):
            flags[s] = np.unpackbits(packed.astype(np.uint8), count=s.stop - s.start)
    return out


def _send_counts(order: int, buckets: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=_COLUMNS)
        deal, part = Deal(buckets), rows["chunk_part"].iloc[0]
        counted = _counts(_texts(rows), order)
        claimed = _claimed(deal, [h for h, _ in counted], answers)
        counted = [(h[flags], count[flags]) for (h, count), flags in zip(counted, claimed)]
        out = []
        for bucket, at in deal.parted([h for h, _ in counted]):
            columns = [c for (h, count), s in zip(counted, at) for c in (deal.gaps(h[s], bucket), count[s])]
            out.append((part, bucket, TOTAL, _pack(columns)))
        return pd.DataFrame(out, columns=_COLUMNS)
    return run


def _answer_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """The totals of a bucket, to each part for its own n-grams in its order."""
    asked, columns = list(zip(*[_unpack(b) for b in rows["blob"]])), []
    for hashes, counts in zip(asked[::2], asked[1::2]):
        rank, times = _ranks(hashes)
        total = np.bincount(rank, np.concatenate(counts).astype(float), len(times)).astype(np.int64)[rank]
        columns.append(np.split(total, np.cumsum([len(c) for c in counts])[:-1]))
    return _answered(rows, TOTAL, columns)


# -- scores ----------------------------------------------------------------------------

def _totals(deal: Deal, counted: list[tuple[np.ndarray, np.ndarray]], answers: pd.DataFrame) -> list[np.ndarray]:
    """The corpus totals of a part's n-grams of each order."""
    kind = answers["kind"]
    claimed = _claimed(deal, [h for h, _ in counted], answers[kind == CLAIM])
    said = {b: _unpack(z) for b, z in zip(answers["bucket"][kind == TOTAL], answers["blob"][kind == TOTAL])}
    shared = [h[flags] for (h, _), flags in zip(counted, claimed)]
    got = [np.zeros(len(h), np.int64) for h in shared]
    for bucket, at in deal.parted(shared):
        for values, s, answer in zip(got, at, said[bucket]):
            values[s] = answer
    out = []
    for (_, count), flags, values in zip(counted, claimed, got):
        total = count.astype(np.int64)  # what occurs in this part alone
        total[flags] = values
        out.append(total)
    return out


def _score(order: int, buckets: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "n_words", "log_score"])
        texts = _texts(rows)
        counted = _counts(texts, order)
        totals = _totals(Deal(buckets), counted, answers)
        keys, corpus = [h for h, _ in counted], int(totals[0][0])
        keys[0], totals[0] = keys[0][1:], totals[0][1:]
        size, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for start, firsts, grams in _grams(texts, order):
            sizes = np.diff(firsts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rest = []  # for n = 1, 2 ... the counts elsewhere of the n-grams from each place on
            for n, g in enumerate(grams, 1):
                places = _inside(firsts, n)
                spot = np.searchsorted(keys[n - 1], g[places])
                _, same, times = np.unique(owner[places] << 32 | spot, return_inverse=True, return_counts=True)
                elsewhere = np.zeros(len(owner), np.int64)
                elsewhere[places] = totals[n - 1][spot] - times[same]
                rest.append(elsewhere)
            place = np.arange(len(owner)) - firsts[owner]
            size[start:start + len(sizes)] = sizes
            sums[start:start + len(sizes)] = np.bincount(
                owner, _word_scores(rest, place, corpus - sizes[owner], order), len(sizes))
        return pd.DataFrame({"doc_id": _ids(rows), "n_words": size, "log_score": sums})
    return run


def _word_scores(rest: list[np.ndarray], place: np.ndarray, elsewhere: np.ndarray, order: int) -> np.ndarray:
    """The log score of each word; ``place`` is its number in its text, ``elsewhere`` the words of the others."""
    score = order * np.log(ALPHA) - np.log(elsewhere + 1.0)
    for n in range(1, order + 1):  # longer contexts overwrite shorter ones
        hit = np.flatnonzero(rest[n - 1] > 0)
        word = hit + n - 1
        context = rest[n - 2][hit] if n > 1 else np.maximum(elsewhere[hit], 1)
        shorter = np.minimum(order - 1, place[word]) - (n - 1)  # the words the context was shortened by
        score[word] = np.log(rest[n - 1][hit]) - np.log(context) + shorter * np.log(ALPHA)
    return score


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document."""
    # written once: parts are of even size, and a retried task must find the same ones
    parts = stage(id_text(docs).mapInArrow(_chunks(PART_BYTES), CHUNK), "chunks")
    buckets = pieces(parts.select("chunk_part").distinct().count(), BUCKET_PARTS)
    grouped = parts.groupBy("chunk_part")
    claims = grouped.applyInPandas(_send_claims(order, buckets), MESSAGE).groupBy("bucket").applyInPandas(
        _answer_claims, MESSAGE)
    counts = grouped.cogroup(claims.groupBy("part")).applyInPandas(_send_counts(order, buckets), MESSAGE)
    totals = counts.groupBy("bucket").applyInPandas(_answer_totals, MESSAGE)
    out = grouped.cogroup(claims.union(totals).groupBy("part")).applyInPandas(
        _score(order, buckets), "doc_id long, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.withColumn("mean_log_score", mean)
