"""Finding repeated windows of a corpus in two exchanges between parts and buckets.

A unit is a byte or a word, a window is ``n`` consecutive units of one document, and the
question is, for every window, what the other places with the same units are: the least
doc_id among them (bytes), or how many there are (words). Suffixes are not moved whole. Of each window,
the least of the hashes of its ``k``-grams names an anchor; equal windows have the same
anchor, and about one place in (n - k) / 2 is one. So the suffixes at anchors, with the
units to their left that windows may begin at, hold every window exactly once.

1. Each part (a few MB of texts) sends the hash of its anchors' k-grams to the bucket of
   the hash, once per part; the bucket answers which occur twice in the corpus.
2. The part sends the contexts of those anchors, each distinct context once with its least
   doc_id or its count; the bucket sorts their right sides (the order function: a suffix
   array or suffix trees), splits them by their left sides, and answers for each window.

All compares in the buckets are of the units themselves; hashes only choose what is sent.
What a part sends is deduplicated first, so text that a third of the corpus repeats costs
one message per part. A k-gram with more than ``HOT`` places is too short a prefix: its
contexts are sent window by window, by the hash of the whole window, so that a frequent
phrase with many continuations is spread over all buckets. Parts are dealt by size and
buckets by hash; neither grows with a key. Texts are staged and moved compressed.

The steps of this module are those of words; ``byte_windows`` has those of bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import pieces, stage, stage_by
from zipledger.llm.words import gram_hashes, texts_of, word_hashes

#: Text bytes in a part, and about as many behind a bucket. Raise it with the memory of executors.
PART_BYTES = 4 << 20
#: Bytes of texts that anchors are looked for in together, so that arrays stay in a core's cache.
TOGETHER = 1 << 15
#: Places of a k-gram from which on its contexts are sent window by window.
HOT = 2000
MESSAGE = "part long, bucket long, kind int, blob binary"
ODD = np.random.default_rng(256).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: (sorted order of some unit sequences, units each has in common with the one before it)
Order = Callable[[list], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Steps:
    """What parts send and buckets answer in the two exchanges, and the results of a part."""
    send_grams: Callable
    answer_grams: Callable
    send_contexts: Callable
    answer_contexts: Callable
    finish: Callable


@dataclass(frozen=True)
class Rule:
    """What a unit and a window are, how suffixes are ordered, and the steps that ask of a window.

    Without other ``steps`` units are words, and the number of a window's places is asked."""
    words: bool
    n: int
    k: int
    order: Order
    hot: int = HOT
    steps: Steps | None = None


# -- parts -----------------------------------------------------------------------------

def _squeeze(part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        task, held, seq = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            parts, seqs, texts = [], [], []
            for text in texts_of(batch.column(batch.schema.get_field_index("text"))):
                parts.append((task << 24) + held // part_bytes)
                seqs.append((task << 36) + seq)
                texts.append(packer.compress(text))
                held, seq = held + len(text) + 64, seq + 1
            at = batch.schema.get_field_index("text")
            columns = [*batch.columns[:at], *batch.columns[at + 1:], pa.array(parts, pa.int64()),
                       pa.array(seqs, pa.int64()), pa.array(texts, pa.binary())]
            names = [*batch.schema.names[:at], *batch.schema.names[at + 1:], "__part", "__seq", "__z"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def staged(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with the text compressed (``__z``), a part and a row number, written once.

    The doc_id is ``__doc`` (0 and ``__no_id`` where it is null).
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    docs = docs.withColumn("__no_id", F.col("doc_id").isNull()).withColumn(
        "__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    fields = [f"`{c}` {t}" for c, t in docs.dtypes if c != "text"]
    schema = ", ".join([*fields, "__part long", "__seq long", "__z binary"])
    return stage_by(docs.mapInArrow(_squeeze(part_bytes), schema), "parts", "__part", ["__part", "__seq"])


def _byte_grams(raw: bytes, k: int) -> np.ndarray:
    """Hashes of the ``k`` bytes from each place on; they are read as words of up to eight bytes."""
    count, size = len(raw) - k + 1, max(w for w in (8, 4, 2, 1) if w <= k)
    if count <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((len(raw) - size + 1,), f"<u{size}", raw, strides=(1,))  # the word at every byte
    h = np.zeros(count, np.uint64)
    for i, at in enumerate(sorted({*range(0, k - size + 1, size), k - size})):
        h += words[at:at + count] * ODD[i]
    h ^= h >> np.uint64(32)
    h *= ODD[-1]
    return h


class Chunk:
    """Some texts of a part together: their units, anchors and how to cut contexts out."""

    def __init__(self, rule: Rule, texts: list[bytes]):
        self.rule = rule
        if rule.words:
            values, self.firsts = word_hashes(texts)
            self.words = b"\n".join(texts).split()
        else:
            self.raw = b"".join(texts)
            values = np.frombuffer(self.raw, np.uint8)
            self.firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.size = len(values)
        self._anchors(values)

    def cut(self, i: int, j: int) -> bytes:
        return b" ".join(self.words[i:j])

    def _anchors(self, values: np.ndarray) -> None:
        n, k = self.rule.n, self.rule.k
        none = np.empty(0, np.int64)
        self.at, self.lo, self.hi, self.hash = none, none, none, np.empty(0, np.uint64)
        if len(values) < n:
            return
        grams = gram_hashes(values, k) if self.rule.words else _byte_grams(self.raw, k)
        # the hash decides, then the place; 24 bits of place suffice for all but giant texts
        bits = np.uint64(max(24, len(grams).bit_length()))
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        cover, width = 1, n - k + 1
        while cover * 2 <= width:
            least = np.minimum(least[:-cover], least[cover:])
            cover *= 2
        if cover < width:
            least = np.minimum(least[:cover - width], least[width - cover:])
        ends = np.repeat(self.firsts[1:], np.diff(self.firsts))[:len(least)]
        start = np.flatnonzero(np.arange(len(least)) + n <= ends)  # windows inside one text
        if not len(start):
            return
        at = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        change = np.flatnonzero(at[1:] != at[:-1])
        first, last = np.concatenate([[0], change + 1]), np.append(change, len(at) - 1)
        self.at, self.lo, self.hi = at[first], start[first], start[last]
        self.hash = grams[self.at] >> np.uint64(16)  # 48 bits


def chunks(rule: Rule, packed: list[bytes]) -> Iterator[tuple[int, Chunk]]:
    """(number of the first text, chunk) over the texts of a part."""
    unpack = zstandard.ZstdDecompressor()
    texts: list[bytes] = []
    start = size = 0
    for i, z in enumerate(packed):
        texts.append(unpack.decompress(z))
        size += len(texts[-1])
        if size >= TOGETHER:
            yield start, Chunk(rule, texts)
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, Chunk(rule, texts)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(part, its compressed texts) from batches in which the rows of a part follow each other."""
    now, held = None, []
    for batch in batches:
        parts, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if parts[a] != now and held:
                    yield now, held
                    held = []
                now = int(parts[a])
                held += packed[a:b]
    if held:
        yield now, held


def _pack(values: np.ndarray) -> bytes:
    """Numbers of 56 bits."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(np.uint64)


# -- first exchange: which k-grams occur twice -------------------------------------------

def _send_grams(rule: Rule, buckets: int):
    def rows(part: int, found: list[np.ndarray]) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(found), return_counts=True)
        values = h << np.uint64(8) | np.minimum(count, 255).astype(np.uint64)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        blobs = [_pack(v) for v in np.split(values[order], at[1:])] if len(h) else []
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(blobs), pa.int64()), pa.array(names, pa.int64()),
             pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["part", "bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, packed in by_part(batches):
            yield rows(part, [c.hash for _, c in chunks(rule, packed)])
    return run


def _answer_grams(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = [_unpack(b) for b in rows["blob"]]
        every = np.concatenate(values)
        _, inverse = np.unique(every >> np.uint64(8), return_inverse=True)
        total = np.bincount(inverse, (every & np.uint64(255)).astype(float))
        flag = np.where(total >= hot, 2, np.where(total >= 2, 1, 0))[inverse]
        out, at = [], 0
        for part, v in zip(rows["part"], values):
            f = flag[at:at + len(v)]
            at += len(v)
            if f.any():
                known = v[f > 0] >> np.uint64(8) << np.uint64(8)
                out.append((part, 0, 1, _pack(known | f[f > 0].astype(np.uint64))))
        return pd.DataFrame(out, columns=["part", "bucket", "kind", "blob"])
    return run


# -- second exchange: contexts ---------------------------------------------------------

class Contexts:
    """The distinct contexts of a part's repeated anchors by bucket, and where they occur."""

    def __init__(self, rule: Rule, buckets: int, rows: pd.DataFrame, grams: list[bytes]):
        self.by_bucket: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        self.rule, self.rows = rule, rows
        known = np.sort(np.concatenate([_unpack(b) for b in grams])) if grams else np.empty(0, np.uint64)
        self.known, self.hot = known >> np.uint64(8), (known & np.uint64(255)) == 2
        self.buckets = buckets

    def _number(self, bucket: int, key: bytes) -> int:
        """The number of a context in its bucket, which has one more place."""
        mine = self.by_bucket[bucket]
        old = mine.get(key)
        if old is None:
            mine[key] = [1, len(mine)]
            return len(mine) - 1
        old[0] += 1
        return old[1]

    def places(self) -> Iterator[tuple[int, Chunk, list[tuple[int, int, int, int]]]]:
        """(first text, chunk, places) in order; a place: (first window, last window, bucket, number)."""
        n, number, first = self.rule.n, self._number, [bytes((i,)) for i in range(256)]
        for start, chunk in chunks(self.rule, self.rows["__z"].tolist()):
            out = []
            if len(self.known):
                spot = np.minimum(np.searchsorted(self.known, chunk.hash), len(self.known) - 1)
                hit = np.flatnonzero(self.known[spot] == chunk.hash)
                hot, cut = self.hot[spot[hit]], chunk.cut
                bucket = (chunk.hash[hit] % np.uint64(self.buckets)).astype(np.int64)
                every = (bucket, chunk.at[hit], chunk.lo[hit], chunk.hi[hit])
                for b, at, lo, hi in zip(*(x[~hot].tolist() for x in every)):
                    out.append((lo, hi, b, number(b, first[at - lo] + cut(lo, hi + n))))
                for _, at, lo, hi in zip(*(x[hot].tolist() for x in every)):
                    for p in range(lo, hi + 1):  # window by window
                        key = first[at - p] + cut(p, p + n)
                        b = zlib.crc32(key) % self.buckets
                        out.append((p, p, b, number(b, key)))
            yield start, chunk, out


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values("__seq", ignore_index=True)


def _send_contexts(rule: Rule, buckets: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(answers):
            return pd.DataFrame(columns=["part", "bucket", "kind", "blob"])
        found = Contexts(rule, buckets, _ordered(rows), answers["blob"].tolist())
        for _ in found.places():
            pass
        packer, part = zstandard.ZstdCompressor(level=3), rows["__part"].iloc[0]
        out = []
        for bucket, mine in found.by_bucket.items():
            lengths = np.array([len(c) for c in mine], "<u4")
            values = np.array([v for v, _ in mine.values()], "<i8")
            raw = np.uint32(len(mine)).tobytes() + lengths.tobytes() + values.tobytes() + b"".join(mine)
            out.append((part, bucket, 2, packer.compress(raw)))
        return pd.DataFrame(out, columns=["part", "bucket", "kind", "blob"])
    return run


def _read_contexts(blob: bytes) -> tuple[list[bytes], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths = np.frombuffer(raw, "<u4", count, 4)
    values = np.frombuffer(raw, "<i8", count, 4 + 4 * count).tolist()
    ends = (4 + 12 * count + np.cumsum(lengths)).tolist()
    return [raw[e - n:e] for n, e in zip(lengths.tolist(), ends)], values


def window_values(rule: Rule, contexts: list[bytes], values: list[int]) -> list[tuple[bytes, list[int]] | None]:
    """For each distinct context its runs of windows (lengths, values), or None if all have its own value."""
    units = [c[1:].split(b" ") for c in contexts]
    left = np.array([c[0] for c in contexts])
    # contexts whose anchor's k-gram no other context has stand alone
    grams: dict = defaultdict(list)
    for i, (u, at) in enumerate(zip(units, left.tolist())):
        grams[tuple(u[at:at + rule.k])].append(i)
    many = np.array([i for g in grams.values() if len(g) > 1 for i in g], np.int64)
    out: list[tuple[bytes, list[int]] | None] = [None] * len(contexts)
    if not len(many):
        return out
    size, most = len(many), left[many]  # offsets of the anchor in the first and the last window
    fewest = most - np.array([len(units[i]) for i in many]) + rule.n
    order, common = rule.order([units[i][at:] for i, at in zip(many.tolist(), most.tolist())])
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    own = np.array([values[i] for i in many.tolist()], np.int64)
    before = _before([units[i][:at] for i, at in zip(many.tolist(), most.tolist())], int(most.max()))
    kinds = int(before.max(initial=0)) + 1
    side = np.zeros(size, np.int64)  # class of the units to the left, one more for each offset
    found = np.zeros((size, int(most.max()) + 1), np.int64)
    for j in range(found.shape[1]):
        if j:
            rows = np.flatnonzero(most >= j)
            side[rows] = np.unique(side[rows] * kinds + before[rows, j - 1], return_inverse=True)[1]
        rows = np.flatnonzero((fewest <= j) & (j <= most))
        if len(rows):
            key = np.cumsum(common < rule.n - j)[rank[rows]] * (size + 1) + side[rows]
            by = np.argsort(key, kind="stable")
            first = np.concatenate([[True], key[by][1:] != key[by][:-1]])
            sums = np.add.reduceat(own[rows[by]], np.flatnonzero(first))
            found[rows[by], j] = sums[np.cumsum(first) - 1]
    for r, (i, high, low) in enumerate(zip(many.tolist(), most.tolist(), fewest.tolist())):
        each = found[r, low:high + 1][::-1]  # windows from the first on: offsets fall
        ends = np.flatnonzero(each[1:] != each[:-1])
        if len(ends):
            lengths = np.diff(np.concatenate([[-1], ends, [len(each) - 1]]))
            out[i] = (lengths.astype(np.uint8).tobytes(), each[np.append(ends, len(each) - 1)].tolist())
        else:
            out[i] = (bytes((255,)), [int(each[0])])  # to the last window
    return out


def _before(lefts: list, width: int) -> np.ndarray:
    """The units before each anchor as numbers, the nearest first."""
    names: dict[bytes, int] = {}
    out = np.zeros((len(lefts), max(width, 1)), np.int64)
    for r, u in enumerate(lefts):
        out[r, :len(u)] = [names.setdefault(w, len(names)) for w in reversed(u)]
    return out


def _answer_contexts(rule: Rule):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sent = [_read_contexts(b) for b in rows["blob"]]
        number: dict[bytes, int] = {}
        total: list[int] = []
        for keys, values in sent:
            for key, value in zip(keys, values):
                i = number.setdefault(key, len(total))
                if i == len(total):
                    total.append(value)
                else:
                    total[i] += value
        windows, one = window_values(rule, list(number), total), bytes((255,))
        packer, out = zstandard.ZstdCompressor(level=3), []
        for part, bucket, (keys, values) in zip(rows["part"], rows["bucket"], sent):
            counts, lengths, answers = bytearray(), bytearray(), []
            for key, value in zip(keys, values):
                i = number[key]
                runs = windows[i] or (one, [total[i]])
                if runs[0] == one and runs[1][0] == value:
                    counts.append(0)
                else:
                    counts.append(len(runs[1]))
                    lengths += runs[0]
                    answers += runs[1]
            raw = (np.array([len(counts), len(lengths)], "<u4").tobytes() + bytes(counts) + bytes(lengths)
                   + np.array(answers, "<i8").tobytes())
            out.append((part, bucket, 3, packer.compress(raw)))
        return pd.DataFrame(out, columns=["part", "bucket", "kind", "blob"])
    return run


def _read_answer(blob: bytes) -> tuple[bytes, list[int], bytes, list[int]]:
    """(runs of each context, where they begin, windows and value of each run).

    A context without runs has the part's own value in all its windows."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count, runs = np.frombuffer(raw, "<u4", 2).tolist()
    counts, lengths = raw[8:8 + count], raw[8 + count:8 + count + runs]
    begins = np.cumsum(np.frombuffer(counts, np.uint8), dtype=np.int64) - np.frombuffer(counts, np.uint8)
    return counts, begins.tolist(), lengths, np.frombuffer(raw, "<i8", runs, 8 + count + runs).tolist()


# -- results ---------------------------------------------------------------------------

def _finish(rule: Rule, buckets: int, with_text: bool):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["__seq", "n_units", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
        if not len(rows):
            return pd.DataFrame(columns=names)
        rows = _ordered(rows)
        found = Contexts(rule, buckets, rows, answers["blob"][answers["kind"] == 1].tolist())
        every = list(found.places())  # a part is small
        replies = answers[answers["kind"] == 3]
        said = {b: _read_answer(x) for b, x in zip(replies["bucket"], replies["blob"])}
        own = {b: [v for v, _ in mine.values()] for b, mine in found.by_bucket.items()}
        seqs, out = rows["__seq"].tolist(), []
        for start, chunk, places in every:
            cover, firsts = np.zeros(chunk.size + 1, np.int32), chunk.firsts
            begin: list[int] = []
            end: list[int] = []
            for lo, hi, bucket, index in places:
                counts, begins, lengths, values = said[bucket]
                if not counts[index]:
                    if own[bucket][index] > 1:
                        begin.append(lo)
                        end.append(hi)
                    continue
                for r in range(begins[index], begins[index] + counts[index]):
                    last = min(hi, lo + lengths[r] - 1)
                    if values[r] > 1:
                        begin.append(lo)
                        end.append(last)
                    lo = last + 1
            np.add.at(cover, np.array(begin, np.int64), 1)
            np.add.at(cover, np.array(end, np.int64) + rule.n, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edges = np.flatnonzero(gone[1:] & ~gone[:-1]) + 1 if len(gone) else gone
            for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
                drop = gone[a:b]
                removed = int(drop.sum())
                spans = int(((edges > a) & (edges < b)).sum() + (b > a and bool(drop[0]))) if removed else 0
                kept = b" ".join([w for w, x in zip(chunk.words[a:b], drop) if not x] if removed else chunk.words[a:b])
                row = (seqs[start + i], b - a, removed, spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
        return pd.DataFrame(out, columns=names)
    return run


def find(parts: DataFrame, rule: Rule, with_text: bool = False) -> DataFrame:
    """(__seq, n_units, n_removed, n_spans, kept_sha256[, kept]) of every row of ``staged`` docs.

    ``kept`` is the text without the repeated windows: the words joined by a space, or the
    bytes, of which a fragment of a character that a removed byte has cut is left out.
    """
    total = parts.select("__part").distinct().count()  # parts are of even size
    buckets, steps = pieces(total, 1), rule.steps or WORDS
    light = parts.select("__part", "__z")
    grams = light.mapInArrow(steps.send_grams(rule, buckets), MESSAGE)
    asked = stage(grams.groupBy("bucket").applyInPandas(steps.answer_grams(rule.hot), MESSAGE), "grams")
    rows = parts.select("__part", "__seq", "__doc", "__no_id", "__z")
    grouped = rows.groupBy("__part")
    contexts = grouped.cogroup(asked.groupBy("part")).applyInPandas(steps.send_contexts(rule, buckets), MESSAGE)
    answers = contexts.groupBy("bucket").applyInPandas(steps.answer_contexts(rule), MESSAGE)
    schema = "__seq long, n_units long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return grouped.cogroup(asked.union(answers).groupBy("part")).applyInPandas(
        steps.finish(rule, buckets, with_text), schema)


WORDS = Steps(_send_grams, _answer_grams, _send_contexts, _answer_contexts, _finish)
