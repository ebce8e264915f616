"""Byte-level BPE from a rank file, by replaying the merges over the corpus' words.

Texts are split once by the vocabulary's pattern; a part of the corpus (some MB of texts) is
kept as its distinct matches and their numbers in order. A match that is a token needs no
merges. The other distinct ones go to the bucket of their hash, and a bucket works on its distinct words together: an index from
token pair to the places of the pair in all words is kept by the rank that the pair merges
to, the ranks are replayed in ascending order, and a merge looks only at the two pairs it
touches. A word is so merged once for the corpus (its copies are one entry per part) and
its ids go back to the parts that asked.

The result is that of merging the lowest rank first, leftmost first, in each match. Where
a merge makes a pair of a lower rank than the one being replayed (its token has another
spelling with a later rank), that pair is merged before the replay goes on.

Decoding joins the tokens' bytes.

Defined results: a null or empty text has no ids. Null ids pass through. Repeated rows are
documents of their own. No documents make no rows. Other columns are ignored. A vocabulary
without all 256 single bytes, or with over 2 ** 20 ids, is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from zipledger.llm.common import id_text, pieces, stage, text_bytes
from zipledger.llm.words import texts_of

#: Text bytes in a part, and behind a bucket.
PART_BYTES = 32 << 20
BUCKET_BYTES = 32 << 20
#: Word bytes replayed together.
REPLAY_BYTES = 2 << 20
MESSAGE = "part long, bucket long, blob binary"
_SHIFT = 20
#: Up to here the letters and numbers of all Unicode versions at hand agree.
_AGREED = re.compile("[^\x00-՗]")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabulary:
    """Tokens by id, the rank of each pair of tokens that merges, and the splitting pattern."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if not all(bytes([b]) in ranks for b in range(256)) or max(ranks.values()) >> _SHIFT:
            raise ValueError("the vocabulary must have all single bytes and ids below 2 ** 20")
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.merges: dict[int, int] = {}  # two ids -> the id of their bytes together
        for token, i in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.merges[left << _SHIFT | right] = i
        single = frozenset(self.bytes)
        pairs = np.array(sorted(k for k in self.merges if k >> _SHIFT in single and k % (1 << _SHIFT) in single), np.int64)
        self._pairs, self._to = pairs, np.array([self.merges[k] for k in pairs.tolist()], np.int64)
        self.whole = {t: i.to_bytes(4, "little") for t, i in ranks.items()}  # a match that is a token -> its packed id
        self.pattern = pattern
        self._newer = self._exact = None
        import regex
        self._plain = regex.compile(pattern)

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """What pairs of single bytes merge to; -1 if nothing."""
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._to[at], -1) if len(self._pairs) else np.full(len(pairs), -1)

    def split(self, text: str) -> Iterable[str]:
        """The matches of the pattern, in order."""
        pattern = self._plain
        if _AGREED.search(text):
            if self._newer is None:
                self._newer, self._exact = as_library(self.pattern)
            if not self._newer.isdisjoint(text):
                pattern = self._exact
        return pattern.findall(text) if len(text) < 1 << 20 else (m[0] for m in pattern.finditer(text))


def as_library(pattern: str):
    """The pattern with the letters and numbers of the tiktoken library, whose Unicode version is older.

    Also the characters that only the regex library takes for letters or numbers."""
    import regex
    import tiktoken
    every, newer = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), set()
    single = {bytes([b]): b for b in range(256)}
    for name in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        newer |= set(regex.findall(name, every)) - set(bytes(library.encode_ordinary(every)).decode())
    if newer:
        codes = np.array(sorted(map(ord, newer)))
        cut = np.flatnonzero(np.diff(codes) > 1)
        some = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[[0, *cut + 1]], codes[[*cut, -1]]))
        # neither letters nor numbers: kept out of \p{L}+ and \p{N}+, let into the negated class
        pattern = re.sub(r"(\\p\{[LN]\})\+", lambda m: f"(?:(?![{some}]){m[1]})+", pattern)
        pattern = re.sub(r"(\[\^\\s\\p\{L\}\\p\{N\}\])", lambda m: f"(?:{m[1]}|[{some}])", pattern)
    return frozenset(newer), regex.compile(pattern)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once by a worker process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


# -- the replay ------------------------------------------------------------------------

class Replay:
    """Some words side by side; merges of a rank are applied to all of them at once."""

    def __init__(self, words: list[bytes], vocab: Vocabulary):
        self.merges = vocab.merges
        n = sum(map(len, words)) + len(words)
        self.ends = np.cumsum([len(w) + 1 for w in words])  # one behind the separator
        ids = np.array(vocab.bytes, np.int32)[np.frombuffer(b"\0".join([*words, b""]), np.uint8)]
        ids[self.ends - 1] = -1  # separators, and places whose token went into the one before
        self.ids = array("i", ids.tobytes())
        self.next, self.before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        # rank -> places where a pair of that rank begins
        pair = (ids[:-1].astype(np.int64) << _SHIFT) | ids[1:]
        ranks = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), vocab.ranks_of(pair), -1)
        order = np.argsort(ranks, kind="stable")
        met, firsts = np.unique(ranks[order], return_index=True)
        self.places = {rank: array("i", at.astype(np.int32).tobytes()) for rank, at in
                       zip(met.tolist(), np.split(order, firsts[1:])) if rank >= 0}

    def run(self) -> list[bytes]:
        """The packed ids of each word."""
        ids, following, before, places, rank_of = self.ids, self.next, self.before, self.places, self.merges.get
        ranks = sorted(places)  # a heap
        first: list[tuple[int, int]] = []  # pairs that a merge made and that go before the next place
        while ranks:
            rank = heapq.heappop(ranks)
            for at in sorted(places.pop(rank)):
                now = rank
                while True:
                    gone = following[at]
                    left, right = ids[at], ids[gone]
                    # a pair may have changed in the meantime
                    if left >= 0 and right >= 0 and rank_of(left << _SHIFT | right) == now:
                        after, back = following[gone], before[at]
                        ids[at], ids[gone], following[at], before[after] = now, -1, after, at
                        for place, pair in ((back, ids[back] << _SHIFT | now if back >= 0 and ids[back] >= 0 else -1),
                                            (at, now << _SHIFT | ids[after] if ids[after] >= 0 else -1)):
                            found = rank_of(pair)
                            if found is None:
                                continue
                            if found <= rank:
                                heapq.heappush(first, (found, place))
                            elif found in places:
                                places[found].append(place)
                            else:
                                places[found] = array("i", (place,))
                                heapq.heappush(ranks, found)
                    if not first:
                        break
                    now, at = heapq.heappop(first)
        kept = np.flatnonzero(np.frombuffer(ids, np.int32) >= 0)
        packed = np.frombuffer(ids, np.int32)[kept].astype("<u4").tobytes()
        cuts = [0, *np.searchsorted(kept, self.ends).tolist()]
        return [packed[4 * a:4 * b] for a, b in zip(cuts[:-1], cuts[1:])]


def replayed(words: list[bytes], vocab: Vocabulary) -> Iterator[bytes]:
    """The packed ids of some distinct words, REPLAY_BYTES of them at a time."""
    start, held = 0, 0
    for i, word in enumerate(words):
        held += len(word)
        if held >= REPLAY_BYTES or i + 1 == len(words):
            yield from Replay(words[start:i + 1], vocab).run()
            start, held = i + 1, 0


# -- parts and buckets -----------------------------------------------------------------

def _pack(values: list[bytes]) -> bytes:
    """Byte strings: their lengths, then themselves, compressed."""
    sizes = _pack_numbers(np.array([len(v) for v in values], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=9).compress(b"".join(values))


def _unpack(blob: bytes) -> list[bytes]:
    start = 4 + int.from_bytes(blob[:4], "little")
    return _cut(zstandard.ZstdDecompressor().decompress(blob[start:]), _unpack_numbers(blob[4:start]))


def _cut(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 192 as a byte, others as a byte with their last six bits and the bytes of the rest, compressed.

    The bytes of the same place stand side by side; small numbers take little more than their information."""
    large = numbers >= 192
    first = np.where(large, 192 + numbers % 64, numbers).astype(np.uint8)
    rest = np.ascontiguousarray((numbers[large] // 64).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=6).compress(len(first).to_bytes(8, "little") + first.tobytes() + rest.tobytes())


def _unpack_numbers(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.uint32)
    planes = np.frombuffer(raw, np.uint8, offset=8 + n).reshape(4, -1)
    large = out >= 192
    out[large] += np.ascontiguousarray(planes.T).view("<u4").reshape(-1) * np.uint32(64) - np.uint32(192)
    return out


def _pack_ids(values: list[bytes]) -> bytes:
    """Packed ids of words: how many each has, then all of them."""
    counts = _pack_numbers(np.array([len(v) // 4 for v in values], np.uint32))
    return len(counts).to_bytes(4, "little") + counts + _pack_numbers(unpacked(b"".join(values)))


def _unpack_ids(blob: bytes) -> list[bytes]:
    start = 4 + int.from_bytes(blob[:4], "little")
    ids = _unpack_numbers(blob[start:]).astype("<u4").tobytes()
    return _cut(ids, 4 * _unpack_numbers(blob[4:start]).astype(np.int64))


PARTS = "part long, docs array<long>, counts array<long>, words binary, numbers binary"


def _split(path: str, part_bytes: int):
    """Parts of texts: a row has their ids, how many matches each has, the distinct matches and their numbers in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = vocabulary(path).split, TaskContext.get().partitionId() << 32
        docs, counts, numbers, number, held = [], [], [], {}, 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(numbers)
            # small numbers for frequent matches: they compress to little more than their information
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            words, flat = list(number), place[flat]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([_pack([words[k].encode() for k in order])], pa.binary()), pa.array([_pack_numbers(flat)], pa.binary())],
                ["part", "docs", "counts", "words", "numbers"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = np.fromiter((number.setdefault(m, len(number)) for m in split(text.decode())), np.uint32)
                docs.append(doc)
                counts.append(len(found))
                numbers.append(found)
                held += len(text) + 64
                if held >= part_bytes:
                    yield row()
                    part += 1
                    docs, counts, numbers, number, held = [], [], [], {}, 0
        if docs:
            yield row()
    return run


def _asked(words: list[bytes], vocab: Vocabulary, buckets: int) -> dict[int, list[int]]:
    """The numbers of the words that are no token, by bucket, in order."""
    dealt: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        if word not in vocab.whole:
            dealt.setdefault(zlib.crc32(word) % buckets, []).append(k)
    return dealt


def _ask(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _unpack(blob.as_py())
                dealt = _asked(words, vocab, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(dealt), pa.int64()), pa.array(list(dealt), pa.int64()),
                     pa.array([_pack([words[k] for k in ks]) for ks in dealt.values()], pa.binary())],
                    ["part", "bucket", "blob"])
    return run


def _answer(path: str):
    """The ids of a bucket's words, to every part that asked, in its order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [_unpack(blob) for blob in rows["blob"]]
        words = sorted(set().union(*asked))
        ids = dict(zip(words, replayed(words, vocabulary(path))))
        return pd.DataFrame({"part": rows["part"], "bucket": rows["bucket"],
                             "blob": [_pack_ids([ids[w] for w in a]) for a in asked]})
    return run


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def decoded(ids: Iterable[int], vocab: Vocabulary) -> bytes:
    """The bytes of some token ids."""
    return b"".join(map(vocab.tokens.__getitem__, ids))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"


def _finish(path: str, buckets: int, digest: bool):
    """The ids of a part's texts: of each distinct match, then of the matches in order."""
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        vocab, out = vocabulary(path), []
        said = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        for row in parts.to_pylist():
            words = _unpack(row["words"])
            ids_of = [vocab.whole.get(w) for w in words]
            for bucket, numbers in _asked(words, vocab, buckets).items():
                for k, ids in zip(numbers, _unpack_ids(said[bucket])):
                    ids_of[k] = ids
            numbers, at = _unpack_numbers(row["numbers"]), 0
            for doc, count in zip(row["docs"], row["counts"]):
                ids = b"".join(map(ids_of.__getitem__, numbers[at:at + count].tolist()))
                at += count
                if digest:
                    text = decoded(unpacked(ids).tolist(), vocab)
                    out.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
                else:
                    out.append((doc, unpacked(ids).astype(np.int32)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32())]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)],
                        [c.split()[0] for c in (DIGEST if digest else IDS).split(", ")])
    return run


def _encoded(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    docs = id_text(docs)
    buckets = pieces(text_bytes(docs), BUCKET_BYTES, docs.sparkSession.sparkContext.defaultParallelism)
    parts = stage(docs.mapInArrow(_split(path, PART_BYTES), PARTS), "parts")
    asked = parts.select("part", "words").mapInArrow(_ask(path, buckets), MESSAGE)
    # a number of its own: few bytes, much work
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_answer(path), MESSAGE)
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _finish(path, buckets, digest), DIGEST if digest else IDS)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    return _encoded(docs, path or default_vocabulary(), digest=False)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to."""
    return _encoded(docs, path or default_vocabulary(), digest=True)


def decode(rows: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``rows`` with the bytes of the token ids as ``column``; null ids stay null."""
    where = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(where)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            raw = [None if ids is None else decoded(ids, vocab) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(raw, pa.binary()), *batch.columns[at + 1:]], batch.schema.names)
    schema = ", ".join(f"`{name}` {'binary' if name == column else kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, schema)
