"""Repeated windows of bytes: the exchanges of ``repeats`` with whole arrays instead of a step per place.

Contexts are rows of one width in which the anchor stands in one column: the bytes a context
has to its left and right, then the bytes themselves, zeros around them. Equal rows are found
by Arrow's dictionaries, which compare bytes. In a bucket the right sides are put in suffix
order and so are the left sides, read from the anchor backwards; what neighbours have in
common makes the classes of right and left sides of any length, and two windows that begin
as far before their anchors are equal if both classes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from zipledger.llm.repeats import ODD, Chunk, Rule, Steps, by_part, chunks

#: Rows worked on together, so that arrays stay in the cache and memory does not grow with a bucket.
ROWS = 1 << 14
LARGEST = np.iinfo(np.int64).max
COLUMNS = ["part", "bucket", "kind", "blob"]


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


class _Reader:
    """Reads what ``_planes`` wrote, one array after another."""

    def __init__(self, blob: bytes):
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(blob), 0

    def bytes(self, count: int) -> np.ndarray:
        self.at += count
        return np.frombuffer(self.raw, np.uint8, count, self.at - count)

    def number(self) -> int:
        return int.from_bytes(self.bytes(4).tobytes(), "little")

    def numbers(self, kind: str, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.bytes(count * size).reshape(size, count).T).view(kind).reshape(count)


def _number(value: int) -> bytes:
    return int(value).to_bytes(4, "little")


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(names: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(name, start, end) of each run of equal names."""
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
    return zip(names[first].tolist() if len(names) else [], list(first), [*list(first)[1:], len(names)])


# -- first exchange: which k-grams occur twice -------------------------------------------

def _gram_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, and 32 bits that tell it from others of its bucket."""
    bucket = h % np.uint64(buckets)
    return bucket << np.uint64(32) | (h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)


def send_grams(rule: Rule, buckets: int):
    def rows(part: int, packed: list[bytes]) -> pa.RecordBatch:
        found = [c.hash for _, c in chunks(rule, packed)]
        keys, count = np.unique(_gram_keys(np.concatenate(found), buckets), return_counts=True)
        packer, names, blobs = zstandard.ZstdCompressor(level=1), [], []
        count = np.minimum(count, 65535).astype("<u2")
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        for bucket, a, b in _slices((keys >> np.uint64(32)).astype(np.int64)):
            names.append(bucket)
            blobs.append(packer.compress(_number(b - a) + _planes(low[a:b]) + _planes(count[a:b])))
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(blobs), pa.int64()), pa.array(names, pa.int64()),
             pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, packed in by_part(batches):
            yield rows(part, packed)
    return run


def answer_grams(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for blob in rows["blob"]:
            reader = _Reader(blob)
            count = reader.number()
            keys.append(reader.numbers("<u4", count))
            counts.append(reader.numbers("<u2", count))
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts))
        flag = np.where(total >= hot, 2, np.where(total >= 2, 1, 0)).astype(np.uint8)[inverse]
        packer, out, at = zstandard.ZstdCompressor(level=1), [], 0
        for part, bucket, mine in zip(rows["part"], rows["bucket"], keys):
            f = flag[at:at + len(mine)]
            at += len(mine)
            if f.any():
                known = mine[f > 0]
                out.append((part, bucket, 1, packer.compress(
                    _number(len(known)) + _planes(known) + np.packbits(f[f > 0] == 2).tobytes())))
        return pd.DataFrame(out, columns=COLUMNS)
    return run


def _known_grams(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether hot) of a part's k-grams that occur twice."""
    keys, hot = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for bucket, blob in zip(answers["bucket"].tolist(), answers["blob"]):
        reader = _Reader(blob)
        count = reader.number()
        keys.append(reader.numbers("<u4", count).astype(np.uint64) | np.uint64(bucket) << np.uint64(32))
        hot.append(np.unpackbits(reader.bytes(-(-count // 8)), count=count).astype(bool))
    return np.concatenate(keys), np.concatenate(hot)


# -- second exchange: contexts ---------------------------------------------------------

class Shape:
    """The columns of a row: two numbers of two bytes, the bytes around the anchor, zeros up to whole words."""

    def __init__(self, rule: Rule):
        self.n, self.left = rule.n, rule.n - rule.k
        self.bytes = self.left + rule.n
        self.width = -(-(4 + self.bytes) // 8) * 8
        self.column = np.arange(self.bytes)

    def inside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the bytes belong to a context that has so many to the left and right of where its anchor begins."""
        return (self.column >= self.left - left[:, None]) & (self.column < self.left + right[:, None])

    def rows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(left), self.width), np.uint8)
        out[:, :4] = np.stack([left, right], 1).astype("<u2").view(np.uint8).reshape(-1, 4)
        return out

    def sides(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.ascontiguousarray(rows[:, :4]).view("<u2").astype(np.int64)
        return both[:, 0], both[:, 1]


def _distinct(blocks: Iterable[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the number of each row) of blocks of rows."""
    kind = pa.binary(width)
    rows = pa.chunked_array([pa.FixedSizeBinaryArray.from_buffers(kind, len(b), [None, pa.py_buffer(b)])
                             for b in blocks], kind)
    if not len(rows):
        return np.empty((0, width), np.uint8), np.empty(0, np.int64)
    found = rows.dictionary_encode()
    del rows
    found = found.combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    names = found.dictionary
    raw = np.frombuffer(names.buffers()[1], np.uint8)[names.offset * width:(names.offset + len(names)) * width]
    return raw.reshape(-1, width), found.indices.to_numpy()


class Part:
    """The places of a part's repeated anchors, in order, and their distinct contexts by bucket.

    ``number`` is the context of each place, counted over ``contexts()``."""

    def __init__(self, rule: Rule, buckets: int, rows: pd.DataFrame, grams: pd.DataFrame):
        self.shape = shape = Shape(rule)
        every: list[Chunk] = []
        starts, size = [], 0
        for _, chunk in chunks(rule, rows["__z"].tolist()):
            every.append(chunk)
            starts.append(size)
            size += chunk.size
        self.raw = b"".join([c.raw for c in every])
        self.firsts = np.concatenate([[0], *[c.firsts[1:] + s for c, s in zip(every, starts)]]).astype(np.int64)
        at, lo, hi = (np.concatenate([np.empty(0, np.int64), *[getattr(c, name) + s for c, s in zip(every, starts)]])
                      for name in ("at", "lo", "hi"))
        keys = _gram_keys(np.concatenate([np.empty(0, np.uint64), *[c.hash for c in every]]), buckets)
        del every
        known, hot = _known_grams(grams)
        spot = pc.fill_null(pc.index_in(pa.array(keys), value_set=pa.array(known)), -1).to_numpy()
        owner = np.searchsorted(self.firsts, lo, side="right") - 1
        hit = np.flatnonzero((spot >= 0) & ~rows["__no_id"].to_numpy(bool)[owner])
        at, lo, hi, owner, bucket = at[hit], lo[hit], hi[hit], owner[hit], (keys[hit] >> np.uint64(32)).astype(np.int64)
        hot = hot[spot[hit]]
        if hot.any():  # window by window
            counts = np.where(hot, hi - lo + 1, 1)
            after = _within(counts)
            at, lo, hi, owner, bucket, hot = (np.repeat(x, counts) for x in (at, lo, hi, owner, bucket, hot))
            lo = lo + after
            hi = np.where(hot, lo, hi)
        self.docs, self.at, self.lo, self.hi, self.owner = rows["__doc"].to_numpy(np.int64), at, lo, hi, owner
        padded = bytes(shape.left) + self.raw + bytes(shape.n)
        self.around = np.ndarray((len(padded) - shape.bytes + 1,), f"V{shape.bytes}", padded, strides=(1,))
        if hot.any():
            bucket[hot] = np.concatenate([_spread(b, buckets) for b in self._blocks(np.flatnonzero(hot))])
        self.bucket, self.number = bucket, np.empty(len(at), np.int64)

    def _blocks(self, places: np.ndarray) -> Iterator[np.ndarray]:
        shape = self.shape
        for a in range(0, len(places), ROWS):
            some = places[a:a + ROWS]
            at = self.at[some]
            left, right = at - self.lo[some], self.hi[some] + shape.n - at
            out = shape.rows(left, right)
            np.multiply(self.around[at].view(np.uint8).reshape(-1, shape.bytes), shape.inside(left, right),
                        out=out[:, 4:4 + shape.bytes])
            yield out

    def contexts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(distinct contexts, bucket of each, least doc_id of its places) of some buckets at a time, by bucket.

        Fills ``number``."""
        order = np.argsort(self.bucket, kind="stable")
        names = self.bucket[order]
        last = np.flatnonzero(np.append(names[1:] != names[:-1], True)) + 1 if len(names) else np.empty(0, np.int64)
        start = known = 0
        while start < len(order):
            end = int(last[min(np.searchsorted(last, start + 4 * ROWS), len(last) - 1)])
            some = order[start:end]
            rows, number = _distinct(self._blocks(some), self.shape.width)  # numbered as they come, so by bucket
            own, bucket = np.full(len(rows), LARGEST), np.empty(len(rows), np.int64)
            np.minimum.at(own, number, self.docs[self.owner[some]])
            bucket[number] = names[start:end]
            self.number[some] = number + known
            yield rows, bucket, own
            start, known = end, known + len(rows)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        shape, packer = self.shape, zstandard.ZstdCompressor(level=3)
        for rows, buckets, own in self.contexts():
            left, right = shape.sides(rows)
            flat = rows[:, 4:4 + shape.bytes][shape.inside(left, right)].tobytes()
            ends = np.concatenate([[0], np.cumsum(left + right)])
            left, right = left.astype("<u2"), right.astype("<u2")
            for bucket, a, b in _slices(buckets):
                yield bucket, packer.compress(b"".join([
                    _number(b - a), _planes(left[a:b]), _planes(right[a:b]), _planes(own[a:b]), flat[ends[a]:ends[b]]]))


def _spread(rows: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each row by all of its bytes."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h += words[:, i] * ODD[i % 60]
        h ^= h >> np.uint64(29)
        h *= ODD[61]
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def send_contexts(rule: Rule, buckets: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(answers):
            return pd.DataFrame(columns=COLUMNS)
        part = rows["__part"].iloc[0]
        found = Part(rule, buckets, rows.sort_values("__seq", ignore_index=True), answers)
        return pd.DataFrame([(part, bucket, 2, blob) for bucket, blob in found.messages()], columns=COLUMNS)
    return run


def window_values(rule: Rule, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each context, windows of each run, its value) of distinct contexts; each has a run at least.

    A run is windows that follow each other and have one value, from the first on."""
    shape = Shape(rule)
    left, right = shape.sides(rows)
    windows = left + right - rule.n + 1
    grams = np.ascontiguousarray(rows[:, 4 + shape.left:4 + shape.left + rule.k])
    group = _distinct([grams], rule.k)[1]
    size = np.bincount(group)
    # contexts whose anchor's k-gram no other context has stand alone; the others are taken by whole groups
    many = np.flatnonzero(size[group] > 1)
    many = many[np.argsort(group[many], kind="stable")]
    names = group[many]
    last = np.flatnonzero(np.append(names[1:] != names[:-1], True)) + 1 if len(names) else np.empty(0, np.int64)
    counts = np.ones(len(rows), np.int64)
    pieces, start = [], 0
    while start < len(many):
        end = int(last[min(np.searchsorted(last, start + ROWS), len(last) - 1)])
        mine = many[start:end]
        found = _runs(rule, shape, rows[mine], left[mine], windows[mine], own[mine])
        counts[mine] = found[0]
        pieces.append((mine, *found))
        start = end
    begins = np.cumsum(counts) - counts
    lengths, values = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    lengths[begins], values[begins] = windows, own
    for mine, some, length, value in pieces:
        to = np.repeat(begins[mine], some) + _within(some)
        lengths[to], values[to] = length, value
    return counts, lengths, values


def _runs(rule: Rule, shape: Shape, rows: np.ndarray, left: np.ndarray, windows: np.ndarray, own: np.ndarray):
    """``window_values`` of contexts whose k-grams others among them have."""
    size, body = len(rows), rows[:, 4:4 + shape.bytes]
    order, common = rule.order(np.ascontiguousarray(body[:, shape.left:]))
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    before, before_common, before_rank = None, None, np.zeros(size, np.int64)
    if shape.left:
        before, before_common = rule.order(np.ascontiguousarray(body[:, :shape.left][:, ::-1]))
        before_rank[before] = np.arange(size)
    fewest = left - windows + 1  # bytes between the beginning of the last window and the anchor
    found = np.zeros((shape.left + 1, size), np.int64)
    for j in range(shape.left + 1):
        at = np.flatnonzero((fewest <= j) & (j <= left))
        if len(at):
            key = np.cumsum(common < rule.n - j)[rank[at]]
            if j:
                key = key * (size + 1) + np.cumsum(before_common < j)[before_rank[at]]
            name = pa.array(key).dictionary_encode().indices.to_numpy()
            least = np.full(int(name.max()) + 1, LARGEST)
            np.minimum.at(least, name, own[at])
            found[j, at] = least[name]
    # windows from the first on: offsets fall
    column = np.arange(shape.left)
    ends = (found[1:] != found[:-1]).T & (column >= fewest[:, None]) & (column < left[:, None])
    counts = 1 + ends.sum(axis=1)
    at, j = np.nonzero(ends[:, ::-1])
    j = shape.left - j  # the offset of the last window of a run that another follows
    stop, value = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    closing = np.cumsum(counts) - 1
    stop[closing], value[closing] = windows, found[fewest, np.arange(size)]
    inner = np.ones(len(stop), bool)
    inner[closing] = False
    stop[inner], value[inner] = left[at] - j + 1, found[j, at]
    lengths = np.diff(stop, prepend=0)
    opening = closing - counts + 1
    lengths[opening] = stop[opening]
    return counts, lengths, value


def answer_contexts(rule: Rule):
    shape = Shape(rule)

    def grams(block: np.ndarray) -> np.ndarray:
        out = np.zeros((len(block), -(-rule.k // 8) * 8), np.uint8)
        out[:, :rule.k] = block[:, 4 + shape.left:4 + shape.left + rule.k]
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks, own, sizes = [], [], []
        for blob in rows["blob"]:
            reader = _Reader(blob)
            count = reader.number()
            left, right = (reader.numbers("<u2", count).astype(np.int64) for _ in range(2))
            own.append(reader.numbers("<i8", count))
            block = shape.rows(left, right)
            block[:, 4:4 + shape.bytes][shape.inside(left, right)] = reader.bytes(int((left + right).sum()))
            blocks.append(block)
            sizes.append(count)
        values, number = np.concatenate(own), np.empty(sum(sizes), np.int64)
        groups, found, known = 1 + len(values) // (4 * ROWS), [], 0
        group = np.concatenate([_spread(grams(b), groups) for b in blocks])
        for g in range(groups):  # all contexts of a k-gram are in one
            mine = np.flatnonzero(group == g)
            picked = np.split(mine, np.searchsorted(mine, np.cumsum(sizes)[:-1]))
            starts = np.cumsum(sizes) - sizes
            distinct, names = _distinct([b[i - a] for b, i, a in zip(blocks, picked, starts)], shape.width)
            least = np.full(len(distinct), LARGEST)
            np.minimum.at(least, names, values[mine])
            found.append(window_values(rule, distinct, least))
            number[mine] = names + known
            known += len(distinct)
        del blocks
        counts, lengths, results = (np.concatenate(x) for x in zip(*found))
        begins = np.cumsum(counts) - counts
        # nothing is said of a context that has the part's own value in all its windows
        said = np.where((counts[number] == 1) & (results[begins[number]] == values), 0, counts[number])
        take = np.repeat(begins[number], said) + _within(said)
        lengths, results = lengths[take].astype("<u2"), results[take]
        ends = np.concatenate([[0], np.cumsum(said)])
        said = said.astype("<u2")
        packer, out, at = zstandard.ZstdCompressor(level=3), [], 0
        for part, bucket, size in zip(rows["part"], rows["bucket"], sizes):
            a, b = ends[at], ends[at + size]
            out.append((part, bucket, 3, packer.compress(b"".join([
                _number(size), _number(b - a), _planes(said[at:at + size]), _planes(lengths[a:b]), _planes(results[a:b])]))))
            at += size
        return pd.DataFrame(out, columns=COLUMNS)
    return run


def _read_answers(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each context, windows of each run, its value) over the buckets of a part, in order."""
    said, lengths, values = ([np.empty(0, np.int64)] for _ in range(3))
    for blob in answers.sort_values("bucket")["blob"]:
        reader = _Reader(blob)
        count, runs = reader.number(), reader.number()
        said.append(reader.numbers("<u2", count).astype(np.int64))
        lengths.append(reader.numbers("<u2", runs).astype(np.int64))
        values.append(reader.numbers("<i8", runs))
    return np.concatenate(said), np.concatenate(lengths), np.concatenate(values)


# -- results ---------------------------------------------------------------------------

def spans(part: Part, own: np.ndarray, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the stretches that repeated windows cover, in order."""
    said, lengths, values = _read_answers(answers)
    lo, hi, owner, number = part.lo, part.hi, part.owner, part.number
    value = own[number]
    if len(values):
        counts = np.maximum(said[number], 1)
        after = _within(counts)
        begins = np.cumsum(said) - said
        run = np.minimum(np.repeat(begins[number], counts) + after, len(values) - 1)
        told = np.repeat(said[number] > 0, counts)
        before = np.cumsum(lengths) - lengths  # windows of runs before, of its context after the next line
        before -= np.repeat(before[np.minimum(begins, len(values) - 1)], said)
        lo, hi, owner, value = (np.repeat(x, counts) for x in (lo, hi, owner, value))
        lo = np.where(told, lo + before[run], lo)
        hi = np.where(told, np.minimum(hi, lo + lengths[run] - 1), hi)
        value = np.where(told, values[run], value)
    gone = np.flatnonzero(value < part.docs[owner])
    begin, end, owner = lo[gone], hi[gone] + part.shape.n, owner[gone]
    if not len(gone):
        return owner, begin, end
    new = np.concatenate([[True], (begin[1:] > end[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    return owner[first], begin[first], end[np.append(first[1:] - 1, len(end) - 1)]


def finish(rule: Rule, buckets: int, with_text: bool):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["__seq", "n_units", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
        if not len(rows):
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("__seq", ignore_index=True)
        part = Part(rule, buckets, rows, answers[answers["kind"] == 1])
        own = np.concatenate([np.empty(0, np.int64), *[o for _, _, o in part.contexts()]])
        owner, begin, end = spans(part, own, answers[answers["kind"] == 3])
        removed = np.bincount(owner, end - begin, len(rows)).astype(np.int64).tolist()
        firsts, raw, out = part.firsts.tolist(), part.raw, []
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
        begin, end = begin.tolist(), end.tolist()
        for i, seq in enumerate(rows["__seq"].tolist()):
            a, b, x, y = firsts[i], firsts[i + 1], cuts[i], cuts[i + 1]
            kept = raw[a:b] if x == y else b"".join(
                [raw[s:e] for s, e in zip([a, *end[x:y]], [*begin[x:y], b])])
            row = (seq, b - a, removed[i], y - x, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
        return pd.DataFrame(out, columns=names)
    return run


BYTES = Steps(send_grams, answer_grams, send_contexts, answer_contexts, finish)
