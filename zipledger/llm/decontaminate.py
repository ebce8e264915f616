"""Benchmark decontamination: windows of benchmark words found in training texts.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z. A
window is ``n`` consecutive words of a benchmark item (the whole item when it is
shorter). The hash set of benchmark word blocks is broadcast when its size is
checked to be small, and joined by shuffle otherwise. Document texts are never shuffled;
they are read once for the report and once for each distinct window length (at most ``n``).
DataFrame functions only, no Python in tasks.

A document is cut into segments that begin every ``k = n // 2`` words and reach as
far as all windows beginning in the first ``k`` words. Each of these windows holds
the second ``k``-word block of the segment, so one look-up per segment in the set of
benchmark blocks finds every segment with a hit; only those are unrolled into
windows and compared, word by word, with the benchmark.

Defined results: null and empty texts have no words and no hits. Rows that repeat a
doc_id and text are documents of their own with the same result. Null ids pass
through; a null item_id can hit but is not listed. An empty benchmark hits nothing,
empty documents give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zipledger.llm.common import aside, ascii_lower, id_text

#: What separates words once A-Z are lower case (fixed by the word rule), and before that.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A benchmark of at most this many bytes is broadcast: its blocks take about 40 times that.
BROADCAST_BYTES = 4 << 20


def normalised(text: Column) -> Column:
    """The words, lower-cased, joined by one space."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, " "))


def word_count(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), RAW_BREAKS, " "))
    return F.when(spaced == "", F.lit(0)).otherwise(
        F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(len, win, items): each distinct window and the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             normalised(F.col("text").cast("string")).alias("norm")).filter("norm != ''")
    words = items.select("item", F.split("norm", " ").alias("w")).withColumn("len", F.least(F.size("w"), F.lit(n)))
    wins = words.select("item", "len", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("len") + 1),
        lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))).alias("win"))
    return wins.groupBy("len", "win").agg(F.collect_set("item").alias("items"))


def _block(length: int) -> tuple[int, list[int]]:
    """Words in a look-up block, and the places in a window at which it can begin."""
    k = max(1, length // 2)
    return k, (list(range(1, k + 1)) if length > 1 else [0])


def _blocks(windows: DataFrame, length: int) -> DataFrame:
    k, places = _block(length)
    return windows.filter(F.col("len") == length).select(F.explode(F.array(*[
        F.xxhash64(F.concat(F.array_join(F.slice(F.split("win", " "), p + 1, k), " "), F.lit(" ")))
        for p in places])).alias("block")).distinct()


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, seg_no, seg, block): a segment's text and its look-up block."""
    k, places = _block(length)
    ahead = f"(?=((?:[^ ]++ ){{1,{length + k - 1}}}))(?:[^ ]++ ){{1,{k}}}"
    skip = f"(?:[^ ]++ ){{{places[-1]}}}" if places[-1] else ""
    second = f"^{skip}((?:[^ ]++ ){{{k}}})"
    segs = docs.select("doc_id", "text_hash", F.posexplode(
        F.regexp_extract_all(F.concat("norm", F.lit(" ")), F.lit(ahead), 1)).alias("seg_no", "seg"))
    return segs.withColumn("block", F.xxhash64(F.regexp_extract("seg", second, 1)))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, text_hash, start, stop, items): each benchmark window in each document."""
    small = (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) <= BROADCAST_BYTES
    maybe = F.broadcast if small else (lambda df: df)
    windows = item_windows(benchmark, n)
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n numbers
    base = id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"),
                                normalised(F.col("text")).alias("norm")).filter("norm != ''")
    found = None
    for length in lengths:
        k, _ = _block(length)
        near = _segments(base, length).join(maybe(_blocks(windows, length)), "block", "left_semi")
        near = near.withColumn("w", F.split(F.rtrim("seg"), " ")).filter(F.size("w") >= length)
        opened = near.select("doc_id", "text_hash", (F.col("seg_no") * k).alias("from"), F.posexplode(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(k), F.size("w") - length + 1)),
            lambda i: F.array_join(F.slice("w", i, length), " "))).alias("at", "win"))
        hits = opened.join(maybe(windows.filter(F.col("len") == length)), "win").select(
            "doc_id", "text_hash", (F.col("from") + F.col("at")).alias("start"),
            (F.col("from") + F.col("at") + length).alias("stop"), "items")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return base.select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("stop"),
                           F.array().cast("array<string>").alias("items")).limit(0)
    return found.groupBy("doc_id", "text_hash", "start", "stop").agg(F.first("items").alias("items"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit, hit_items): words covered and items found, per text."""
    order = W.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    seen = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(seen, F.lit(0))))
    return hits.withColumn("new", new).groupBy("doc_id", "text_hash").agg(
        F.sum("new").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: its words, the words hit and the items that hit it."""
    found = hit_summary(find_hits(docs, benchmark, n)).select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "hit_items")
    every = id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"),
                                 word_count(F.col("text")).alias("n_words"))
    items = F.coalesce("hit_items", F.array().cast("array<string>"))
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")),
                      "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, what: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or without the words hit (``what="spans"``).

    All columns and other rows stay as they are. With spans, a removed word takes the
    separators after it along.
    """
    if what not in ("documents", "spans"):
        raise ValueError("what is 'documents' or 'spans'")
    plain = aside(docs)
    hits = find_hits(plain, benchmark, n)
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    same = lambda right: key.eqNullSafe(right["hit_id"]) & (F.xxhash64(text) == right["hit_hash"])
    if what == "documents":
        bad = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
        return plain.join(bad, same(bad), "left_anti").toDF(*docs.columns)
    spans = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    lead = F.regexp_extract(text, f"^{RAW_BREAKS}", 0)
    parts = F.regexp_extract_all(text, F.lit(f"{RAW_WORDS}(?:{RAW_BREAKS})?"), 0)
    left = F.filter(parts, lambda _, i: ~F.exists("spans", lambda s: (s.start <= i) & (i < s.stop)))
    joined = plain.join(spans, same(spans), "left")
    new = F.when(F.col("spans").isNull(), text).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.select(*[new if c == "text" else plain[c] for c in plain.columns]).toDF(*docs.columns)
