"""Runs of words: maximal stretches of a document that repeat with a period.

Squares (a stretch twice in a row) are caught over dyadic blocks. Every completed block of
``b = 2 ** j`` words is a catcher for the periods from ``2 b`` to ``4 b - 1``: a square of
such a period repeats at least ``2 b`` words, so it holds a whole block, which comes again
one period later. A word that is appended completes one window of ``b`` words at each
level; the window is compared, by the hashes of the suffixes that end there, with the two
catchers on whose watch it lies. A hit is a pair of equal words ``q`` apart; it is
followed word by word to both sides, and where at least ``q`` words repeat, a square is
reported and merged into the run of that stretch. The comparisons of all words of a text
are made together, level by level, so a text costs n log n steps of array code. Periods
below 8 are compared word by word.

Blocks inside a run of a short period (at most b / 2) come again all over that run. Two
such blocks repeat just as far as their runs reach, unless the runs begin or end the same
distance apart; only those are followed further, and a run is never compared with itself.

Defined results: a null or empty text, or one without words, has no runs and the empty
text as its collapsed form. Null ids pass through. Repeated rows are documents of their
own with equal results. No documents make no rows. Other columns are ignored by ``report``
and ``runs`` and kept by ``collapse``. Words are told apart by 64-bit hashes inside a
document; the words of each run found are compared themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import id_text
from zipledger.llm.words import groups, mix, texts_of, word_hashes

#: A run has at least this many words, and two periods.
LEAST = 12
#: Periods below this are compared word by word; it is twice the smallest block.
SHORT = 8
_LEFT, _RIGHT = np.random.default_rng(11).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_NONE = np.empty(0, np.int64)


def _stretches(equal: np.ndarray, need: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of at least ``need`` true values."""
    at = np.flatnonzero(equal)
    if len(at) < need or not (at[need - 1:] - at[:len(at) - need + 1] == need - 1).any():
        return []
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    begin, end = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + 1
    return [(a, b) for a, b in zip(begin.tolist(), end.tolist()) if b - a >= need]


def _factors(q: int) -> Iterator[int]:
    p = 2
    while p * p <= q:
        if q % p == 0:
            yield p
            while q % p == 0:
                q //= p
        p += 1
    if q > 1:
        yield q


def _repeats(words: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether words ``q`` apart are equal all over the stretch."""
    head = min(end - q, start + 64)
    return bool((words[start:head] == words[start + q:head + q]).all()
                and (words[start:end - q] == words[start + q:end]).all())


class Catchers:
    """The squares of one text, merged into runs ``(start, end, period)``."""

    def __init__(self, words: np.ndarray, least: int = LEAST):
        self.words, self.least = words, least
        self.runs: list[tuple[int, int, int]] = []

    def need(self, q: int) -> int:
        """The words that must come again ``q`` later."""
        return max(self.least - q, q)

    def report(self, lo: int, hi: int, q: int) -> None:
        """The words from ``lo`` to ``hi`` come again ``q`` later: a run, if it has no smaller period."""
        if hi - lo >= self.need(q) and not any(
                _repeats(self.words, lo, hi + q, q // p) for p in _factors(q)):
            self.runs.append((lo, hi + q, q))

    def follow(self, lo: int, hi: int, q: int) -> tuple[int, int]:
        """The whole stretch around ``lo`` to ``hi`` that comes again ``q`` later."""
        words, n, step = self.words, len(self.words) - q, 32
        while lo:
            back = min(step, lo)
            differ = np.flatnonzero(words[lo - back:lo] != words[lo - back + q:lo + q])
            if len(differ):
                lo += int(differ[-1]) + 1 - back
                break
            lo, step = lo - back, 2 * step
        step = 32
        while hi < n:
            on = min(step, n - hi)
            differ = np.flatnonzero(words[hi:hi + on] != words[hi + q:hi + q + on])
            if len(differ):
                hi += int(differ[0])
                break
            hi, step = hi + on, 2 * step
        return lo, hi

    def short_periods(self) -> None:
        for q in range(1, min(SHORT, len(self.words) // 2 + 1)):
            for lo, hi in _stretches(self.words[q:] == self.words[:-q], self.need(q)):
                self.report(lo, hi, q)

    def level(self, h: np.ndarray, b: int) -> None:
        """Compare every window of ``b`` words (hashes ``h``) with its two catchers."""
        blocks = np.repeat(h[::b], b)
        near = np.flatnonzero(h[2 * b:] == blocks[:len(h) - 2 * b])
        far = np.flatnonzero(h[3 * b:] == blocks[:len(h) - 3 * b]) if len(h) > 3 * b else _NONE
        if not len(near) and not len(far):
            return
        start = np.concatenate([near - near % b, far - far % b])
        q = np.concatenate([near + 2 * b, far + 3 * b]) - start
        start, q = self._inside_runs(start, q, b)
        order = np.lexsort((start, q))
        start, q = start[order], q[order]
        firsts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else _NONE
        for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(q)]):
            period = int(q[i])
            while i < j:
                s = int(start[i])
                if not (self.words[s:s + b] == self.words[s + period:s + period + b]).all():
                    i += 1  # equal hashes only
                    continue
                lo, hi = self.follow(s, s + b, period)
                self.report(lo, hi, period)
                i += int(np.searchsorted(start[i:j], hi))  # further blocks of the same stretch

    def _inside_runs(self, start: np.ndarray, q: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Settle hits of blocks inside runs of short periods; the others are returned."""
        cover = None
        for k, (lo, hi, p) in enumerate(self.runs):
            if 2 * p <= b <= hi - lo:
                if cover is None:
                    cover = np.full(len(self.words) + 1, -1, np.int32)
                cover[lo:hi - b + 1] = k
        if cover is None:
            return start, q
        here, there = cover[start], cover[start + q]
        both = (here >= 0) & (there >= 0)
        rest = ~both
        both &= here != there
        here, there, at, apart = here[both], there[both], start[both], q[both]
        ends = np.array([r[:2] for r in self.runs], np.int64)
        lo, lo2, hi, hi2 = ends[here, 0], ends[there, 0] - apart, ends[here, 1], ends[there, 1] - apart
        lined = (lo == lo2) | (hi == hi2)
        lo, hi, known = np.maximum(lo, lo2), np.minimum(hi, hi2), apart
        square = ~lined & (hi - lo >= np.maximum(self.least - known, known))
        for row in np.unique(np.stack([lo[square], hi[square], known[square]], 1), axis=0).tolist():
            self.report(*row)
        _, one = np.unique(np.stack([apart[lined], here[lined], there[lined]], 1), axis=0, return_index=True)
        return np.concatenate([start[rest], at[lined][one]]), np.concatenate([q[rest], apart[lined][one]])

    def catch(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), by start, then period."""
        n = len(self.words)
        if n >= self.least:
            self.short_periods()
            h, b = self.words, 1
            while 4 * b <= n:
                if 2 * b >= SHORT:
                    self.level(h, b)
                h = mix(h[:-b] * _LEFT + h[b:] * _RIGHT)
                b *= 2
        return sorted((lo, hi - lo, q) for lo, hi, q in self.runs)


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words come in a run after its first period."""
    gone = np.zeros(n, bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return gone


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The kept words joined by a space."""
    words = text.split()
    if runs:
        words = [w for w, x in zip(words, dropped(runs, len(words)).tolist()) if not x]
    return b" ".join(words)


def runs_of(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(number of words, runs) of each text."""
    for a, b in groups(texts):
        words, firsts = word_hashes(texts[a:b])
        for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            yield j - i, Catchers(words[i:j], least).catch()


def _longest(runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return (None,) * 4
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
    return start, length, period, 1000 * length // period


REPORT = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
RUN = "array<struct<start: long, length: long, period: long>>"


def _digest(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in REPORT.split(", ")]
        for batch in batches:
            texts, out = texts_of(batch.column(1)), []
            for text, (n, runs) in zip(texts, runs_of(texts, least)):
                lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
                out.append((n, len(runs), *_longest(runs), hashlib.sha256(lines.encode()).hexdigest(),
                            hashlib.sha256(collapsed(text, runs)).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]],
                 *[pa.array(c, pa.string()) for c in columns[6:]]], names)
    return run


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: its number of runs, the longest of them, and digests of all runs and of the kept words."""
    return id_text(docs).mapInArrow(_digest(least), REPORT)


def _all_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, (_, runs) in zip(batch.column(0).to_pylist(), runs_of(texts_of(batch.column(1)), least))
                    for r in runs]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "start", "length", "period"])
    return run


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, length, period): a row for each run."""
    return id_text(docs).mapInArrow(_all_runs(least), "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with each run cut to its first period; the words left are joined by a space. Null texts stay null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = texts_of(batch.column(at))
            left = [collapsed(t, r).decode() for t, (_, r) in zip(texts, runs_of(texts, least))]
            left = pa.array([x if ok else None for x, ok in zip(left, batch.column(at).is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], left, *batch.columns[at + 1:]], batch.schema.names)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, docs.schema)


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the text of a tenth of all documents (chosen by the id's checksum) made periodic from some word on.

    With h the checksum, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Other texts, and texts of null ids or without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = id_text(docs).withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, words))  # split once
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.expr("transform(w, (x, i) -> if(i >= a, element_at(w, cast(a + (i - a) % p + 1 as int)), x))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))
