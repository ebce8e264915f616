"""Word-piece ids of whole texts, from a vocabulary file of the tokenizers library.

The vocabulary splits at white space, so the ids of a text are those of its
space-separated chunks in order. The chunks of a slice of texts are numbered in Arrow
and each distinct one is looked at once, however often it occurs: the library encodes
the words that the worker does not remember, many in a call, and runs of plain letters
need only its merges. The ids of all occurrences are then taken by number.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers; when there are more, the more frequent half of them stays.
REMEMBERED = 300_000
#: Longer words, in bytes, are not remembered.
LONGEST = 40
#: Bytes of text whose chunks are numbered together (a longer text is a slice alone).
SLICE_BYTES = 4 << 20
#: Words given to the library as one text.
TOGETHER = 1000
#: A run of these after plain letters is a word of its own.
_PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Other characters than those for which lower-casing and composition are those of the vocabulary, letter by letter.
_OTHER = re.compile("[^\x00-įı-ſ]")
_OTHER_RE2 = r"[^\x{0}-\x{12F}\x{131}-\x{17F}]"
#: The start of a mark such as <|endoftext|>, which the vocabulary knows as written only.
_MARK = re.compile(r"<\|\w")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _sure(text: str) -> bool:
    """Whether ``text`` can be lower-cased before the vocabulary does so."""
    return (text.isascii() or not _OTHER.search(text)) and not ("<|" in text and _MARK.search(text))


def _lists(offsets: np.ndarray, ids: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)


def _offsets(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class _Words:
    """The words that a worker remembers: their ids, and how often they were met."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(vocabulary)
        size = self.whole.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("the vocabulary must have at most 65,536 ids")
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(size, bool)  # pieces that end a word
        for piece, i in self.whole.get_vocab().items():
            self.ends[i] = piece.endswith(self.whole.model.end_of_word_suffix)
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = ["￾"] * 256  # bytes as the letters that stand for them
        for c in map(chr, range(0x180)):
            for byte, letter in zip(c.encode(), letters.pre_tokenize_str(c)[0][0]):
                spelled[byte] = letter
        self.spelled = "".join([*spelled[:0x20], " ", *spelled[0x21:]])
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint16()))
        self.met = np.zeros(0)

    def _plain(self, words: pa.Array, other: bool) -> pa.Array:
        """Which words are letters alone, and only such as lower-casing and composition are sure for."""
        plain = pc.utf8_is_alpha(words)
        return pc.and_not(plain, pc.match_substring_regex(words, _OTHER_RE2)) if other else plain

    def _merged(self, words: list[str]) -> Iterator[pa.ListArray]:
        """Ids of runs of plain letters, each one word of the vocabulary's splitting rule."""
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            text = codecs.charmap_decode(" ".join(some).encode(), "strict", self.spelled)[0]
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            offsets = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(offsets) != len(some) + 1:
                raise ValueError("the vocabulary must mark the end of every word")
            yield _lists(offsets, pa.array(ids))

    def _encoded(self, words: pa.Array) -> pa.ListArray:
        ids, counts = array("H"), []
        for word in words.to_pylist():  # one by one: the library holds about 100 bytes for an id
            ids.extend(found := self.whole.encode_batch_fast([word], add_special_tokens=False)[0].ids)
            counts.append(len(found))
        return _lists(_offsets(counts), pa.array(np.frombuffer(ids, np.uint16)))

    def _look(self, words: pa.Array, other: bool, met: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids by number, and the numbers of distinct ``words``; new words are encoded and remembered."""
        numbers = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(numbers.is_null().to_numpy(zero_copy_only=False))
        numbers = numbers.fill_null(0).to_numpy().copy()
        plain = self._plain(words.take(pa.array(new)), other).to_numpy(zero_copy_only=False)
        new = np.concatenate([new[plain], new[~plain]])
        numbers[new] = len(self.words) + np.arange(len(new))
        added, n = words.take(pa.array(new)), int(plain.sum())
        ids = pa.concat_arrays([self.ids, *self._merged(added[:n].to_numpy(zero_copy_only=False).tolist()),
                                self._encoded(added[n:])])

        short = pc.less_equal(pc.binary_length(added), LONGEST).to_numpy(zero_copy_only=False)
        old = len(self.words)
        total = np.concatenate([self.met, np.zeros(len(new))])
        total[numbers] += met
        keep = np.concatenate([np.arange(old), old + np.flatnonzero(short)])
        if len(keep) > REMEMBERED:
            keep = np.sort(keep[np.argpartition(-total[keep], REMEMBERED // 2)[:REMEMBERED // 2]])
        self.words = pa.concat_arrays([self.words, added]).take(pa.array(keep))
        self.ids, self.met = ids.take(pa.array(keep)), total[keep]
        return ids, numbers

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of the k-th text are those from the k-th to the next offset."""
        other, lowered = False, []
        for text in texts:
            text = text or ""
            if _sure(text):
                text = text.lower()
            else:
                other = True
            lowered.append(text.replace("\n", " "))
        split = pc.split_pattern(pa.array(lowered, pa.string()), " ")
        edges, occurring = split.offsets.to_numpy(), split.values.dictionary_encode()
        chunks, occurring = occurring.dictionary, occurring.indices
        del lowered, split  # large
        if other:
            chunks = pa.array([c.lower() if _sure(c) else c for c in chunks.to_pylist()], pa.string())

        # a chunk is letters and then punctuation, or looked at whole
        letters = pc.ascii_rtrim(chunks, characters=_PUNCTUATION)
        letters = pc.if_else(self._plain(letters, other), letters, chunks)
        size = pc.binary_length(letters).to_numpy()
        tailed = np.flatnonzero(size < pc.binary_length(chunks).to_numpy())
        cut = zip(chunks.take(pa.array(tailed)).to_numpy(zero_copy_only=False),
                  pc.utf8_length(letters.take(pa.array(tailed))).to_pylist())
        tails = pa.array([c[n:] for c, n in cut], pa.string())
        words = pa.concat_arrays([letters, tails]).dictionary_encode()
        at = words.indices.to_numpy()
        met = np.bincount(occurring.to_numpy(), minlength=len(chunks))
        met = np.bincount(at, np.concatenate([met, met[tailed]]), len(words.dictionary))
        known, numbers = self._look(words.dictionary, other, met)

        numbers = numbers[at]
        parts = np.insert(numbers[:len(chunks)], tailed + 1, numbers[len(chunks):])
        parts = known.take(pa.array(parts))
        first = np.arange(len(chunks) + 1)
        first[1:] += np.cumsum(np.bincount(tailed, minlength=len(chunks)))
        found = _lists(parts.offsets.to_numpy()[first], parts.values).take(occurring)
        return found.offsets.to_numpy()[edges], found.values.to_numpy()


_WORDS: dict[str, _Words] = {}


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in pieces of about SLICE_BYTES of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    group = (np.cumsum(size, dtype=np.int64) - size) // SLICE_BYTES
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def closed(offsets: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after the ids of each text, as signed 32-bit numbers."""
    return offsets + np.arange(len(offsets), dtype=np.int32), np.insert(ids.astype("<i4"), offsets[1:], end_id)


def encoder_of_many(vocabulary: str) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """A function texts -> (offsets, ids as unsigned 16-bit numbers); None is an empty text."""
    words = _WORDS.get(vocabulary)
    if words is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        words = _WORDS[vocabulary] = _Words(vocabulary)
    return words.encode


@contextmanager
def encoder(vocabulary: str) -> Iterator[Callable[[str | None], np.ndarray]]:
    """A function text -> ids, for single texts."""
    encode = encoder_of_many(vocabulary)
    yield lambda text: encode([text])[1]
