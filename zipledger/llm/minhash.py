"""Near-duplicate documents: MinHash signatures joined through their coordinates.

A document's set holds the hashes of its distinct shingles of five words. Documents with
equal sets form a class, and one row stands for it from then on, so copies cost nothing
further. A signature has ``M`` coordinates; each (coordinate, value) pair is a posting
list. T is the most collisions that two sets of the wanted similarity fall short of with a
probability of two in a million or less (28 of 48 at 0.85, 24 at 0.80), so only pairs with T
collisions count:

* Prefix: pairs with T collisions share one of each signature's n - T + 1 rarest shared
  values, n being how many of its values any other signature has. Only these are posted;
  a signature with n < T posts nothing, and the values that a third of the corpus has
  come last in the order and are skipped.
* Skip: within a list, the collisions in all other lists are counted by comparing the
  signatures themselves, only with sets whose size allows the similarity.
* A list longer than ``BLOCK`` is dealt into blocks, and pairs of blocks become tasks.

Links are confirmed on the full sets. Not all pairs of a dense group are confirmed: first
every member of a list names the partner it collides with most; these pairs are confirmed
and joined into components. Then the lists that still hold candidate pairs between two
components get the texts of those members, and each such pair is confirmed in one list
(that of the first value the two have in common), best first, unless links found there
have already connected it. That leaves no pair untried between documents of different
components, and no more rows than members and links leave a list.

Defined results: a null or empty text, or one without words, has the empty set and is
linked with nothing. Rows that repeat a doc_id are expected to repeat its text and share
its result. Rows with a null doc_id are linked with nothing and kept. No documents make
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import aside, id_text, stage
from zipledger.llm.components import components
from zipledger.llm.words import gram_hashes, groups, texts_of, word_hashes

SHINGLE = 5
#: Links: 100 * intersection >= similarity * union; this one unless the caller names another.
SIMILARITY = 85
M = 48
#: The chance at most to miss a pair that is just similar enough.
MISSED = 2e-6
BLOCK = 2048
_TURN = np.random.default_rng(48).integers(1, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(49).integers(1, 1 << 63, M, dtype=np.uint64)


def collisions(similarity: int) -> int:
    """T: pairs of this similarity (in hundredths) have fewer collisions with a chance of at most MISSED."""
    p, missed = similarity / 100, 0.0
    for t in range(M + 1):
        missed += math.comb(M, t) * p ** t * (1 - p) ** (M - t)  # fewer than t + 1
        if missed > MISSED:
            return max(t, 1)
    return M


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts of fewer words have one shingle."""
    texts = [t.lower() for t in texts]  # bytes: A-Z only
    for a, b in groups(texts):
        words, firsts = word_hashes(texts[a:b])
        grams = gram_hashes(words, shingle)
        for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if j - i >= shingle:
                yield np.unique(grams[i:j - shingle + 1])
            elif j > i:
                yield gram_hashes(words[i:j], j - i)
            else:
                yield np.empty(0, np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    least = np.full(M, ~np.uint64(0))
    for a in range(0, len(values), 4096):
        np.minimum(least, (values[a:a + 4096, None] * _TURN + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that little is held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        counts, keys, signs = [], [], []
        for values in shingle_sets(texts_of(batch.column(1))):
            counts.append(len(values))
            keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            signs.append(signature(values))
        flat = np.concatenate(signs) if signs else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1) * M, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), lists],
            ["doc_id", "n_shingles", "set_key", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of every document."""
    return id_text(docs).mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def prefixes(classes: DataFrame, similarity: int) -> DataFrame:
    """(rep, n, sig, posts): the postings that a class must have, rarest values first."""
    least = collisions(similarity)
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    tokens = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", token.alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("freq")).filter("freq > 1")
    shared = tokens.join(often, "token").groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("shared"))  # at most M values
    posts = shared.filter(F.size("shared") >= least).select(
        "rep", F.slice("shared", F.lit(1), F.size("shared") - least + 1).alias("posts"))
    return classes.join(posts, "rep")


LIST = ["token", "i", "j"]


def lists(heads: DataFrame) -> DataFrame:
    """Postings with what is needed to count collisions, dealt by list and sorted by set size."""
    posts = heads.withColumn("post", F.explode("posts"))
    blocks = F.ceil(F.col("post.freq") / BLOCK)
    posts = posts.withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(
        F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    posts = posts.withColumn("cell", F.explode(cells)).withColumn("token", F.col("post.token"))
    named = ["label"] if "label" in heads.columns else []
    tokens = [F.col("posts.token").alias("tokens")] if named else []
    return _dealt(posts.select("token", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "block", "rep", "n",
                               "sig", *named, *tokens))


def _dealt(posts: DataFrame) -> DataFrame:
    return posts.repartition(*LIST).sortWithinPartitions(*LIST, "n", "rep")


def _similar(rows: pd.DataFrame, similarity: int, across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, number of collisions) of the pairs with T collisions in each list of ``rows``.

    Rows are compared with the first, second ... row after them for as long as set sizes
    allow. ``across`` only yields pairs of two labels."""
    size, n = len(rows), rows["n"].to_numpy()
    keys = rows[LIST].to_numpy()
    last = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), size - 1)
    end = last[np.searchsorted(last, np.arange(size))] + 1  # where each row's list ends
    sig, block = np.stack(rows["sig"].to_numpy()), rows["block"].to_numpy()
    cross = keys[:, 1] != keys[:, 2]
    label = rows["label"].to_numpy() if across else None
    alive, d, least = np.arange(size), 1, collisions(similarity)
    while len(alive):
        alive = alive[alive + d < end[alive]]
        alive = alive[100 * n[alive] >= similarity * n[alive + d]]  # sorted by size: later ones fail too
        left, right = alive, alive + d
        use = ~cross[left] | (block[left] != block[right])
        if across:
            use &= label[left] != label[right]
        left, right = left[use], right[use]
        same = (sig[left] == sig[right]).sum(axis=1)
        hit = same >= least
        if hit.any():
            yield left[hit], right[hit], same[hit]
        d += 1


def _by_list(work, similarity: int):
    """A ``mapInPandas`` function that gives ``work`` whole lists, as many as a batch holds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = rows[LIST].to_numpy()
            other = (keys != keys[-1]).any(axis=1) if len(rows) else np.empty(0, bool)
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last list may go on
            held = rows.iloc[cut:]
            if cut > 1:
                yield from work(rows.iloc[:cut].reset_index(drop=True), similarity)
        if held is not None and len(held) > 1:
            yield from work(held.reset_index(drop=True), similarity)
    return run


def _name_partners(rows: pd.DataFrame, similarity: int) -> Iterator[pd.DataFrame]:
    """Each member's pair with the partner it collides with most."""
    best, partner = np.full(len(rows), -1), np.full(len(rows), -1)
    for left, right, same in _similar(rows, similarity):
        for x, y in ((left, right), (right, left)):
            better = same > best[x]
            best[x[better]], partner[x[better]] = same[better], y[better]
    found = np.flatnonzero(partner >= 0)
    if len(found):
        a, b = rows["rep"].to_numpy()[found], rows["rep"].to_numpy()[partner[found]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})


def candidates(heads: DataFrame, similarity: int) -> DataFrame:
    """(u, v), u < v: the pairs that members of lists name, each once."""
    named = lists(heads).mapInPandas(_by_list(_name_partners, similarity), "u long, v long")
    return named.filter("u < v").distinct()


def _across(rows: pd.DataFrame, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidate pairs of two labels that fall to this list, by falling collisions."""
    found = list(_similar(rows, similarity, across=True))
    if not found:
        return (np.empty(0, np.int64),) * 3
    left, right, same = (np.concatenate(x) for x in zip(*found))
    earlier: dict[int, frozenset] = {}  # values that come before the list's own
    for r in np.unique(np.concatenate([left, right])).tolist():
        tokens = rows["tokens"].iat[r].tolist()
        earlier[r] = frozenset(tokens[:tokens.index(rows["token"].iat[r])])
    mine = np.array([earlier[a].isdisjoint(earlier[b]) for a, b in zip(left.tolist(), right.tolist())], bool)
    left, right, same = left[mine], right[mine], same[mine]
    order = np.argsort(-same, kind="stable")
    return left[order], right[order], same[order]


def _open_members(rows: pd.DataFrame, similarity: int) -> Iterator[pd.DataFrame]:
    """The members of lists that have candidate pairs of two labels."""
    left, right, _ = _across(rows, similarity)
    if len(left):
        yield rows.iloc[np.unique(np.concatenate([left, right]))][[*LIST, "block", "rep"]]


class Sets:
    """Shingle sets of packed texts; those used last are remembered, up to ``LIMIT`` numbers."""

    LIMIT = 4 << 20

    def __init__(self):
        self.unpack, self.known, self.size = zstandard.ZstdDecompressor(), {}, 0

    def get(self, key: int, packed: bytes) -> np.ndarray:
        values = self.known.get(key)
        if values is None:
            values = next(shingle_sets([self.unpack.decompress(packed)]))
            if self.size + len(values) > self.LIMIT:
                self.known, self.size = {}, 0
            self.known[key] = values
            self.size += len(values)
        return values


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two full sets are similar enough."""
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= similarity * (len(a) + len(b) - common)


def _link_members(rows: pd.DataFrame, similarity: int) -> Iterator[pd.DataFrame]:
    """The links between labels of each list, as many as it takes to connect what is connected."""
    left, right, _ = _across(rows, similarity)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    label, rep, packed, sets, out = (rows["label"].tolist(), rows["rep"].tolist(), rows["z"].tolist(), Sets(), [])
    for x, y in zip(left.tolist(), right.tolist()):
        a, b = find(label[x]), find(label[y])
        if a != b and linked(sets.get(rep[x], packed[x]), sets.get(rep[y], packed[y]), similarity):
            root[max(a, b)] = min(a, b)
            out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
    if out:
        yield pd.DataFrame(out, columns=["u", "v"])


def links_across(heads: DataFrame, packed: DataFrame, similarity: int) -> DataFrame:
    """(u, v): links between classes of different ``label``s, enough to connect all that are linked."""
    open_ = stage(lists(heads).mapInPandas(_by_list(_open_members, similarity),
                                           "token long, i long, j long, block long, rep long"), "open")
    texts = packed.select(F.col("doc_id").alias("rep"), "z")
    rows = open_.join(heads.select("rep", "n", "sig", "label", F.col("posts.token").alias("tokens")), "rep")
    return _dealt(rows.join(texts, "rep")).mapInPandas(_by_list(_link_members, similarity), "u long, v long")


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in _small(batches):
        z = [packer.compress(t) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])


def _confirm(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in _small(batches):
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            keep = [(u, v) for u, v, zu, zv in rows if linked(sets.get(u, zu), sets.get(v, zv), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in keep], pa.int64()) for c in (0, 1)], ["u", "v"])
    return run


def confirmed(pairs: DataFrame, packed: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = packed.select(F.col("doc_id").alias("u"), F.col("z").alias("zu"))
    right = packed.select(F.col("doc_id").alias("v"), F.col("z").alias("zv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "zu", "zv").mapInArrow(
        _confirm(similarity), "u long, v long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links from ``similarity`` hundredths on."""
    signed = stage(signatures(docs), "signatures")
    known = signed.filter("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                           F.first("sig").alias("sig"))
    heads = stage(prefixes(classes.select("rep", "n", "sig"), similarity), "prefixes")
    pairs = stage(candidates(heads, similarity), "pairs")
    wanted = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    texts = id_text(docs).mapInArrow(_squeeze, "doc_id long, z binary")
    packed = stage(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    links = stage(confirmed(pairs, packed, similarity), "links")
    first = components(links)

    named = heads.join(first, heads["rep"] == first["node"], "left").withColumn(
        "label", F.coalesce("component", "rep")).drop("node", "component")
    named = stage(named, "labelled")
    more = stage(links_across(named, packed, similarity), "links")
    last = components(links.union(more)) if more.take(1) else first

    reps = classes.select(F.col("set_key").alias("k"), "rep")
    reps = reps.join(last, reps["rep"] == last["node"], "left").select(
        "k", F.coalesce("component", "rep").alias("component"))
    joined = signed.join(reps, (signed["set_key"] == reps["k"]) & signed["doc_id"].isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id; all columns.

    Of rows that repeat a doc_id and text one stays."""
    plain = aside(docs)
    gone = near_duplicates(plain, similarity).filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    left = plain.join(gone, plain["doc_id"].cast("long") == F.col("id"), "left_anti")
    ids = plain.select(F.col("doc_id").cast("long").alias("id")).dropna()
    twice = stage(ids.groupBy("id").count().filter("count > 1").select("id"), "twice")
    if not twice.isEmpty():
        again = left["doc_id"].cast("long") == twice["id"]
        left = left.join(twice, again, "left_anti").union(
            left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left.toDF(*docs.columns)
