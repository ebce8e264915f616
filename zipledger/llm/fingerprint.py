"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a run of sentences of one line that ends with the line or after a sentence
whose hash says so (``CUT``: every second one). Cuts depend on the sentence before them only,
so a sentence put in or taken out changes the paragraph it is in and at most joins it with
a neighbour or splits it; all others stay as they were. A sentence of more than ``PIECE`` characters
counts as several, cut from its beginning on: an edit changes those after it up to the sentence's end.
A digest has 48 bits of hash and 16 check bits. A sketch has ``CELLS`` cells in three rows; a digest goes
into one cell of each row, and a cell holds how many digests it has and their XOR. Equal
texts have equal sketches, which is what the fingerprint string spells out.

Two sketches are compared by subtracting cell by cell, which cancels what both have, and
peeling: a cell with one digest left that passes its check gives that digest away, and
taking it out of its other cells lays bare more. If cells are left over, the sketch was too
small for the difference, and the comparison is tried again with a larger one: as many pages
of ``CELLS`` cells as the digests need, and with new cell numbers; what pages still do not
give away goes into the next round, until nothing is left. The likeness of two documents is
their common share of digests, 2 * common / (digests of both).

All of this is column expressions on the document's own row: after the texts are brought
next to their neighbours (one shuffle by ranges of doc_id) there is no further exchange.

Defined results: a null text is empty; an empty text has no paragraphs, and two documents
without paragraphs are alike (1.0). Rows that repeat a doc_id stand next to each other,
ordered by a hash of the text; null ids come after all others. A lone document is its own
next. No documents make no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zipledger.llm.common import id_text, pieces, stage, text_bytes

PIECE = 128
#: The bit of a sentence's hash that ends a paragraph; any below 16 does, digests use those from 16 on.
CUT = 6
ROWS, WIDTH = 3, 8
CELLS = ROWS * WIDTH
#: Digests for which a page of a larger sketch is meant.
PAGE = 12
#: Texts in one range of doc_ids, and ranges at most.
RANGE_BYTES, RANGES = 8 << 20, 1024
#: Rounds of peeling tried at a time; every round takes out at least one digest.
PEELS = 24


# -- expressions over arrays of digests ------------------------------------------------

def digests(text: str) -> str:
    """Distinct paragraph digests of a text column: 48 bits of hash, 16 of check."""
    end, other = "[.!?]", "[^.!?\\\\n]"
    sentence = f"{other}{{0,{PIECE}}}{end}+|{other}{{1,{PIECE}}}"
    # no sentence has a line end inside, so one is put after each at which a paragraph ends
    ends = f"if((shiftrightunsigned(xxhash64(p), {CUT}) & 1L) = 1L, concat(p, '\\n'), p)"
    lines = f"array_join(transform(regexp_extract_all({text}, '(?:{sentence})\\n?', 0), p -> {ends}), '')"
    parts = f"filter(split({lines}, '\\n+'), p -> p <> '')"
    head = f"transform({parts}, p -> shiftrightunsigned(xxhash64(p), 16))"
    return f"array_distinct(transform({head}, h -> shiftleft(h, 16) | (xxhash64(h) & 65535L)))"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def placed(found: str, salt: int, pages: str = "1") -> str:
    """Digests with their page and their cell in each row, from a hash that the salt renews."""
    cells = ", ".join(f"'c{r}', int({r * WIDTH} + (shiftrightunsigned(h, {3 * r}) & {WIDTH - 1}L))" for r in range(ROWS))
    one = let(f"xxhash64(d, {salt})", "h", f"named_struct('p', int(pmod(shiftrightunsigned(h, 16), {pages})), 'x', d, {cells})")
    return f"transform({found}, d -> {one})"


def sketch(members: str) -> str:
    """The cells of an array of placed digests: array<struct<n: int, x: bigint>>."""
    cell = let("filter(m, s -> s.c{r} = k)", "f", "named_struct('n', size(f), 'x', aggregate(f, 0L, (a, s) -> a ^ s.x))")
    rows = [f"transform(sequence({r * WIDTH}, {(r + 1) * WIDTH - 1}), k -> {cell.replace('{r}', str(r))})"
            for r in range(ROWS)]
    return let(members, "m", f"concat({', '.join(rows)})")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (l, r) -> named_struct('n', l.n - r.n, 'x', l.x ^ r.x))"


def peel(cells: str, salt: int) -> str:
    """Peel a subtracted sketch: struct<cells, added, removed, open>; all cells are 0 if it gave all."""
    pure = "abs(s.n) = 1 AND (xxhash64(shiftrightunsigned(s.x, 16)) & 65535L) = (s.x & 65535L)"
    given = f"array_distinct(filter(st.cells, s -> {pure}))"
    at = placed("transform(g, p -> p.x)", salt)
    rest = ("transform(st.cells, (s, i) -> aggregate(filter(q, p -> p.c0 = i OR p.c1 = i OR p.c2 = i), s, "
            "(a, p) -> named_struct('n', a.n - p.n, 'x', a.x ^ p.x)))")
    rest = let(f"zip_with(g, {at}, (p, c) -> named_struct('n', p.n, 'x', p.x, 'c0', c.c0, 'c1', c.c1, 'c2', c.c2))", "q", rest)
    taken = (f"named_struct('cells', {rest}, "
             "'added', concat(st.added, transform(filter(g, p -> p.n = 1), p -> p.x)), "
             "'removed', concat(st.removed, transform(filter(g, p -> p.n = -1), p -> p.x)), 'open', true)")
    stuck = "named_struct('cells', st.cells, 'added', st.added, 'removed', st.removed, 'open', false)"
    step = let(given, "g", f"if(size(g) = 0, {stuck}, {taken})")
    start = (f"named_struct('cells', {cells}, 'added', cast(array() as array<bigint>), "
             "'removed', cast(array() as array<bigint>), 'open', true)")
    return f"aggregate(sequence(1, {PEELS}), {start}, (st, k) -> if(st.open, {step}, st))"


def spelled(cells: str) -> str:
    """The fingerprint string: every cell's count (four hex digits) and XOR (sixteen)."""
    one = "concat(lpad(hex(s.n & 65535), 4, '0'), lpad(hex(s.x), 16, '0'))"
    return f"array_join(transform({cells}, s -> {one}), '')"


EMPTY = "forall({0}.cells, s -> s.n = 0 AND s.x = 0L)"


# -- differences -----------------------------------------------------------------------

#: Begins each page of a sorted side; no digest is in a cell before the first.
MARK = "named_struct('p', int(p), 'x', -9223372036854775808L, 'c0', -1, 'c1', -1, 'c2', -1)"


def _page(side: str) -> str:
    """The digests of page ``p`` of a side, which lie between its mark and the next one."""
    return f"slice({side}, i{side}[p] + 2, i{side}[p + 1] - i{side}[p] - 1)"


def differences(pairs: DataFrame) -> DataFrame:
    """(row, pair, added, removed): digests only in ``a`` and only in ``b`` of each (row, pair, a, b).

    Each round uses larger sketches for what the last could not give away.
    """
    done, salt, pending = None, 1, pairs.select("row", "pair", "a", "b")
    while True:
        paged = pending.withColumn("pages", F.expr(f"int(greatest(1, ceil((size(a) + size(b)) / {PAGE})))"))
        marks = f"transform(sequence(0, pages - 1), p -> {MARK})"
        paged = paged.select("row", "pair", "pages", *[
            F.array_sort(F.expr(f"concat({placed(x, salt, 'pages')}, {marks})")).alias(x) for x in "ab"])
        # the places of the marks of a sorted side, and its end
        paged = paged.select("*", *[F.expr(
            f"concat(array_compact(transform({x}, (d, i) -> if(d.c0 < 0, i, null))), array(size({x})))").alias(f"i{x}")
            for x in "ab"])
        cells = [sketch(_page(x)) for x in "ab"]
        paged = paged.withColumn("tried", F.expr(
            f"transform(sequence(0, pages - 1), p -> {peel(subtract(*cells), salt)})"))
        # a page that is not empty after peeling is tried again; what it gave is not used
        tried = paged.withColumn("failed", F.expr(
            f"filter(transform(tried, (t, p) -> if({EMPTY.format('t')}, -1, p)), p -> p >= 0)"))
        got = "flatten(transform(filter(tried, t -> {0}), t -> t.{1}))"
        again = "transform(filter({0}, d -> d.c0 >= 0 AND array_contains(failed, d.p)), d -> d.x)"
        tried = stage(tried.select(
            "row", "pair", *[F.expr(got.format(EMPTY.format("t"), x)).alias(x) for x in ("added", "removed")],
            *[F.expr(again.format(x)).alias(x) for x in "ab"], (F.size("failed") > 0).alias("open")), "peeled")
        out = tried.select("row", "pair", "added", "removed")
        done = out if done is None else done.unionByName(out)
        pending = tried.filter("open")
        salt += 1
        if not pending.take(1):
            return done.groupBy("row", "pair").agg(F.flatten(F.collect_list("added")).alias("added"),
                                                   F.flatten(F.collect_list("removed")).alias("removed"))


# -- neighbours ------------------------------------------------------------------------

def _range_of(column: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds that are not above the column's value, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(column < bounds[mid], _range_of(column, bounds[:mid], first)).otherwise(
        _range_of(column, bounds[mid + 1:], first + mid + 1))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each text and that of the document with the next smaller doc_id.

    Rows are dealt into ranges of doc_ids; the last row of a range takes its next text from
    a table that holds the first row of each range.
    """
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    count = min(RANGES, pieces(text_bytes(rows), RANGE_BYTES))
    cuts = rows.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.2 / count) if count > 1 else []
    bounds = sorted({int(c) for c in cuts})
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn(
        "part", F.coalesce(F.when(F.col("doc_id").isNotNull(), _range_of(F.col("doc_id"), bounds)), F.lit(-1)))
    heads = rows.groupBy("part").agg(F.max_by("text", F.struct("doc_id", F.bitwise_not("h"))).alias("head"))
    down = W.orderBy(F.desc("part"))  # one row for each range
    heads = heads.select("part", F.coalesce(F.lead("head").over(down), F.first("head").over(
        down.rowsBetween(W.unboundedPreceding, W.currentRow))).alias("head"))
    order = W.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "h")
    return rows.withColumn("next", F.lead("text").over(order)).join(heads, "part", "left").select(
        "doc_id", "text", F.coalesce("next", "head").alias("next"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last third of its characters replaced by the beginning of the
    next document.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("take", F.expr("int(n_chars div 3)"))
    rows = rows.withColumn("edited", F.expr(
        "concat(substring(text, 1, int(n_chars - take)), substring(next, 1, take))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       *[F.expr(digests(c)).alias(d) for c, d in (("text", "dt"), ("edited", "de"), ("next", "dn"))])
    rows = rows.select("*", *[F.expr(sketch(placed(d, 0))).alias(s) for d, s in (("dt", "st"), ("de", "se"), ("dn", "sn"))])
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(spelled("st")).alias("fingerprint"),
        F.expr(spelled("se")).alias("edited_fingerprint"), "dt", "de", "dn",
        F.expr(peel(subtract("st", "se"), 0)).alias("pe"), F.expr(peel(subtract("st", "sn"), 0)).alias("pn"))
    size = "if({0}, size({1}.added) + size({1}.removed), -1)"
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "dt",
        *[F.expr(size.format(EMPTY.format(p), p)).alias(c) for p, c in (("pe", "diff_edited"), ("pn", "diff_next"))],
        F.size("de").alias("size_e"), F.size("dn").alias("size_n"),
        *[F.expr(f"if({EMPTY.format(p)}, null, {d})").alias(d) for p, d in (("pe", "de"), ("pn", "dn"))])
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    pairs = None
    for pair, d in (("edited", "de"), ("next", "dn")):
        one = rows.filter(F.col(d).isNotNull()).select("row", F.lit(pair).alias("pair"), F.col("dt").alias("a"),
                                                       F.col(d).alias("b"))
        pairs = one if pairs is None else pairs.unionByName(one)
    larger = differences(pairs).select(
        "row", "pair", (F.size("added") + F.size("removed")).alias("diff")).groupBy("row").agg(
        *[F.max(F.when(F.col("pair") == p, F.col("diff"))).alias(f"later_{p}") for p in ("edited", "next")])
    rows = rows.select("row", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       "diff_edited", "diff_next", "size_e", "size_n", F.size("dt").alias("size_t"))
    rows = rows.join(larger, "row", "left")

    def near(pair: str, other: str) -> Column:
        both = F.col("size_t") + F.col(other)
        differ = F.when(F.col(f"diff_{pair}") >= 0, F.col(f"diff_{pair}")).otherwise(F.col(f"later_{pair}"))
        return F.when(both == 0, F.lit(1.0)).otherwise(1 - differ / both).alias(f"near_{pair}")

    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       near("edited", "size_e"), near("next", "size_n"))
