"""Spelling variants: words of the corpus that differ by one letter, grouped under the commonest.

Two words are near if they differ by exactly one inserted, deleted or replaced letter. With
``p`` the place of their first difference, they agree before ``p`` and, behind it, up to a
shift. So the near pairs of a word of ``m`` letters with words of ``m`` and ``m + 1`` letters
are divided by the range ``lo <= p < hi`` that their place is in; each pair is in one
range, and the words that can be near over a range have the letters outside it in common,
which is the key of a group. Ranges start as halves of the word; a group with more than
``GROUP`` words is divided by halving its range, until a single place is left, where the
alphabet bounds it. No group is compared as a whole with itself in rows.

Within a group, a position index has for each (position, letter) the set of words with that
letter there, as the bits of an integer, words in order of their counts. A word is read
letter by letter against it: the set of words without an error, those with one replaced
letter and those with one letter more (index shifted by one) are carried along at once, a
few operations on all words of the group each. The lowest bit of what is left is the
commonest near word.

Defined results: null and empty texts have no words. A null doc_id counts its words without
a slip. Repeated rows count again. No documents, or none with a word that counts, make no
rows. Words are told apart by code points; only A-Z is lower-cased. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import id_text, pieces, stage
from zipledger.llm.words import texts_of

#: Words have at least this many code points, and this many occurrences.
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A word's form has at least this many times its occurrences.
TIMES = 10
#: Words of a group from which on its range of places is halved.
GROUP = 2048
#: Words counted by a task before it hands them on, and postings that a task works on.
HELD = 200_000
TASK_ROWS = 400_000


# -- the vocabulary --------------------------------------------------------------------

def _lowered(text: bytes) -> str:
    return text.lower().decode()  # bytes: A-Z only


def slip(doc_id: int | None, word: str, every: int) -> str:
    """The word, without one of its letters if ``every`` divides the checksum of ``<doc_id>:<word>``."""
    if not every or doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _count(slips: int, letters: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % letters)

    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = runs.findall(_lowered(text))
                if slips:
                    found = [slip(doc_id, w, slips) for w in found]
                counts.update(found)
                if len(counts) >= HELD:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)
    return run


def vocabulary(docs: DataFrame, slips: int = 0, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least ``letters`` letters with ``least`` occurrences. ``slips`` plants misspellings."""
    counts = id_text(docs).mapInArrow(_count(slips, letters), "word string, n long")
    words = counts.filter(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= least)


# -- groups ----------------------------------------------------------------------------

def _keyed(posts: DataFrame) -> DataFrame:
    """Postings with the group: the letters outside the range, for words of one length or one more."""
    after = F.expr("substring(word, hi + 1 + cast(longer as int))")
    return posts.withColumn("g", F.xxhash64("m", "lo", "hi", F.expr("substring(word, 1, lo)"), after))


def _halved(posts: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ranges = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")),
                     F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return posts.withColumn("range", F.explode(ranges)).select("word", "n", "longer", "m", "range.lo", "range.hi")


def groups(words: DataFrame, limit: int = GROUP, letters: int = 1) -> list[DataFrame]:
    """Postings (word, n, longer, m, lo, hi, g) of all groups, each with few words; a table for each halving.

    No word has fewer than ``letters`` letters."""
    length = F.length("word")
    both = F.array(F.struct(F.lit(False).alias("longer"), length.alias("m")),
                   F.struct(F.lit(True).alias("longer"), (length - 1).alias("m")))
    whole = words.select("word", "n", F.explode(both).alias("as")).select("word", "n", "as.longer", "as.m").filter(
        F.col("m") >= max(letters, 1)).withColumn("lo", F.lit(0)).withColumn("hi", F.col("m") + 1)  # a letter more may come at the end
    posts, out = stage(_keyed(_halved(whole)), "postings"), []
    while True:
        hot = stage(posts.filter("hi - lo > 1").groupBy("g").count().filter(F.col("count") > limit).select("g"), "hot")
        if hot.isEmpty():
            return [*out, posts]
        out.append(posts.join(hot, "g", "left_anti"))
        posts = stage(_keyed(_halved(posts.join(hot, "g", "left_semi"))), "postings")


class PositionIndex:
    """Bit sets of a group's words by (position, letter); words are numbered by falling counts."""

    def __init__(self, words: list[tuple[str, int, bool]], lo: int, hi: int):
        self.words = sorted(words, key=lambda w: (-w[1], w[0]))
        self.lo, self.hi = lo, hi
        self.at: list[dict[str, int]] = [{} for _ in range(hi - lo + 2)]
        self.longer, bit = 0, 1
        for word, _, longer in self.words:
            for sets, letter in zip(self.at, word[lo:hi + longer]):
                sets[letter] = sets.get(letter, 0) | bit
            if longer:
                self.longer |= bit
            bit <<= 1
        self.equal = (bit - 1) & ~self.longer

    def near(self, word: str) -> int:
        """The words of the same length with one replaced letter, and the longer ones with one letter more."""
        exact, replaced, more = self.equal | self.longer, 0, 0
        for sets, shifted, letter in zip(self.at, self.at[1:], word[self.lo:self.hi]):
            same = sets.get(letter, 0)
            differ = exact & ~same
            more = (more | differ) & shifted.get(letter, 0)
            replaced = replaced & same | differ
            exact &= same
            if not exact | replaced | more:
                return 0
        if len(word) < self.hi:  # the range ends behind the last letter
            more |= exact
        return replaced & self.equal | more & self.longer

    def found(self) -> Iterator[tuple[str, int, int, str]]:
        """(word, number of near words, count of the commonest, the commonest) of the words with any."""
        count, best = [0] * len(self.words), [len(self.words)] * len(self.words)
        for i, (word, _, longer) in enumerate(self.words):
            if longer:
                continue
            near = self.near(word)
            if near:
                count[i] += near.bit_count()
                best[i] = min(best[i], (near & -near).bit_length() - 1)
                near &= self.longer
                while near:  # the other side of these pairs
                    j = (near & -near).bit_length() - 1
                    count[j] += 1
                    best[j] = min(best[j], i)
                    near &= near - 1
        for (word, _, _), n, b in zip(self.words, count, best):
            if n:
                yield word, n, self.words[b][1], self.words[b][0]


NEAR = "word string, n_near long, best_n long, best string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words of whole groups; rows come sorted by group."""
    def work(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1 and not all(r[2] for r in rows):
            same: dict[tuple, list] = {}  # the letters themselves: a group is only a hash
            for word, n, longer, m, lo, hi, _ in rows:
                same.setdefault((m, lo, hi, word[:lo], word[hi + longer:]), []).append((word, n, longer))
            for (_, lo, hi, _, _), words in same.items():
                if len(words) > 1:
                    yield from PositionIndex(words, lo, hi).found()

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          ["word", "n_near", "best_n", "best"])

    held: list[tuple] = []
    found: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[-1][6] != row[6]:
                found.extend(work(held))
                held = []
            held.append(row)
        if found:
            yield out(found)
            found = []
    found.extend(work(held))
    yield out(found)


def near_words(words: DataFrame, limit: int = GROUP, letters: int = 1) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has near words."""
    columns, found = ["word", "n", "longer", "m", "lo", "hi", "g"], None
    least = words.sparkSession.sparkContext.defaultParallelism
    for posts in groups(words, limit, letters):
        tasks = pieces(posts.count(), TASK_ROWS, least)
        dealt = posts.select(columns).repartition(tasks, "g").sortWithinPartitions("g")
        part = dealt.mapInArrow(_search, NEAR)
        found = part if found is None else found.union(part)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


# -- forms -----------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following the forms ends. Counts rise tenfold at each, so chains are short."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = stage(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, slips: int = 0, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT,
             times: int = TIMES, limit: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that counts.

    ``form`` is the near word with most occurrences (ties: the first in code-point order) if it has ``times`` those of
    the word, ``root`` where following forms ends."""
    words = stage(vocabulary(docs, slips, letters, least), "vocabulary")
    near = near_words(words, limit, letters)
    known = words.join(near, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    known = stage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    root = roots(known.filter("form is not null").select("word", "form"))
    return known.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(found: DataFrame) -> DataFrame:
    """(root, n_variants, n): how many words each root stands for, itself included, and their occurrences."""
    return found.groupBy("root").agg(F.count("*").alias("n_variants"), F.sum("n").alias("n"))
