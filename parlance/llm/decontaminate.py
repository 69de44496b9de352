"""Benchmark decontamination with SimHash over item-sized windows.

A window has as many word shingles as the item.  Windows and items have 64-bit
SimHashes of their shingles; multi-index blocks of bits bring together all
prints within the radius, and the exact weighted similarity of the shingles,
as multisets, decides.  DataFrame functions only.

Only a window that shares shingles with some item can be similar to one, and
sliding a window on to the next shared shingle loses none.  So a window is
fingerprinted at each place where a shared shingle begins, if there are enough
of them within its length, and nowhere else; that skips no similar window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_key, free_names, key_to_id, names_of

#: Prints that differ in at most RADIUS bits differ in at most TOLERANCE bits in one of BLOCKS blocks of 8.
#: Windows at the similarity 0.8 differ in 10 bits on average, with a deviation of 3.
RADIUS, BLOCKS = 23, 8
TOLERANCE = RADIUS // BLOCKS
#: Rows of a table (under 1 kB each) that are broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 200_000
#: Shingles of a window whose votes fit a lane of 16 bits.
MOST_VOTES = 65_535


def with_shingles(df: DataFrame, text: str, n: int, out: str = "shingles") -> DataFrame:
    """``df`` with the shingles' hashes in place of ``text``.

    Words are lower-case runs of letters and digits.  Fewer than ``n`` words
    are one shingle; no words, or a null text, have none.
    """
    rest = [c for c in df.columns if c != text]
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    hashed = df.select(*rest, F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_h"))
    size = F.size("_h")
    runs = F.transform(F.slice("_h", 1, F.greatest(size - (n - 1), F.lit(1))), lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, n)]))
    return hashed.select(*rest, F.when(size == 0, F.col("_h")).otherwise(runs).alias(out))


def with_simhash(df: DataFrame, shingles: str, out: str) -> DataFrame:
    """``df`` with the SimHash of an array of hashes: bit i is 1 if over half of them have it.

    Sums of 64-bit words hold the votes of several bits at once, in lanes of
    16 bits, or of 32 if there are more shingles than fit.
    """

    def sums(lane: int) -> str:
        mask = sum(1 << k for k in range(0, 64, lane))
        return f"transform(sequence(0, {lane - 1}), k -> aggregate({shingles}, 0L, (a, h) -> a + (shiftrightunsigned(h, k) & {mask}L)))"

    def over_half(lane: int) -> str:
        return f"(shiftrightunsigned(get(_sums, i % {lane}), {lane} * (i div {lane})) & {(1 << lane) - 1}L) * 2 > size({shingles})"

    few = f"size({shingles}) <= {MOST_VOTES}"
    summed = df.withColumn("_sums", F.expr(f"if({few}, {sums(16)}, {sums(32)})"))
    return summed.withColumn(out, F.expr(f"aggregate(sequence(0, 63), 0L, (a, i) -> a | if(if({few}, {over_half(16)}, {over_half(32)}), shiftleft(1L, i), 0L))")).drop("_sums")


def _blocks(fp: str) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(0xFF)).cast("int") for i in range(BLOCKS)])


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has no more rows than the bound; they are counted."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _with_multiset(df: DataFrame, c: str, out: str) -> DataFrame:
    """``df`` with values told apart by their occurrence, so that sets of them count repeats; in time linear in a sorted array."""
    runs = df.withColumn("_sorted", F.array_sort(c))
    first = "filter(sequence(0, size(_sorted) - 1), i -> i = 0 or get(_sorted, i) <> get(_sorted, i - 1))"
    runs = runs.withColumn("_first", F.expr(f"if(size(_sorted) = 0, cast(array() as array<int>), {first})"))
    count = "coalesce(get(_first, k + 1), size(_sorted)) - begin"
    told = F.expr(f"flatten(transform(_first, (begin, k) -> transform(sequence(1, {count}), n -> xxhash64(get(_sorted, begin), n))))")
    return runs.withColumn(out, told).drop("_sorted", "_first")


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, item, similarity, first_word, shingles): the best window of each document for each item it contains.

    A document contains an item if a window of as many shingles as the item
    has, or the whole of a shorter document, has a weighted Jaccard similarity
    (sum of the smaller counts over sum of the larger) of ``similarity`` or
    more with it.  Of equally similar windows the last one is given.  ``doc``
    is the key of :func:`common.doc_key`.  Texts without words contain nothing;
    items without words or without an id are none.  Repeated rows of a document
    or an item count once.  Other columns don't matter; an empty table on
    either side gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    named = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null")
    listed = with_shingles(named, "text", shingle, "hashes").where("size(hashes) > 0").distinct()
    listed = with_simhash(listed.withColumn("n", F.size("hashes")), "hashes", "fp")
    listed = scratch.table(_with_multiset(listed, "hashes", "of_item"))
    # The sizes of the items that have a shingle: with them, the places where windows may begin.
    sizes = listed.select("n", F.explode("hashes").alias("h")).groupBy("h").agg(F.collect_set("n").alias("sizes"))
    docs = df.select(doc_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    every = with_shingles(docs, "text", shingle)
    # The outer explode keeps Catalyst from inferring a filter on the array, which would evaluate it inside its own lambdas.
    hits = every.select("doc", F.size("shingles").alias("total"), F.posexplode_outer("shingles").alias("pos", "h")).join(_small(sizes), "h")
    hits = hits.select("doc", "total", "pos", F.explode("sizes").alias("n"))
    width = F.least("n", "total")
    # c common shingles of n and w give c / (n + w - c) >= s, so c is at least s (n + w) / (1 + s).
    needed = F.ceil((F.col("n") + width) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    found = hits.groupBy("doc", "total", "n").agg(F.sort_array(F.collect_set("pos")).alias("places")).withColumn("width", width).withColumn("needed", needed)
    found = found.where("size(places) >= needed")
    enough = F.filter(F.slice("places", F.lit(1), F.size("places") - F.col("needed") + 1), lambda p, i: F.get("places", i + F.col("needed") - 1) < p + F.col("width"))
    starts = F.array_distinct(F.transform(enough, lambda p: F.least(p, F.col("total") - F.col("width"))))
    found = scratch.table(found.select("doc", "total", "n", "width", starts.alias("starts")).where("size(starts) > 0"))
    again = with_shingles(docs.join(_small(found), "doc"), "text", shingle)
    windows = again.select("doc", "n", "width", "shingles", F.explode_outer(F.when(F.size("shingles") == F.col("total"), F.col("starts"))).alias("start"))
    windows = windows.where("start is not null").select("doc", "n", "start", F.slice("shingles", F.col("start") + 1, F.col("width")).alias("window"))
    printed = scratch.table(with_simhash(windows, "window", "window_fp"))
    windows = printed.select("*", F.posexplode(_blocks("window_fp")).alias("block", "value"))
    near = F.array(*[F.lit(x) for x in range(256) if x.bit_count() <= TOLERANCE])
    index = listed.select("item", "n", "fp", F.posexplode(_blocks("fp")).alias("block", "own")).select("item", "n", "fp", "block", "own", F.explode(near).alias("x"))
    index = index.select("item", "n", "fp", "block", F.col("own").bitwiseXOR(F.col("x")).alias("value"))
    pairs = windows.join(_small(index), ["n", "block", "value"]).where(F.bit_count(F.col("window_fp").bitwiseXOR(F.col("fp"))) <= RADIUS)
    # A pair meets in several blocks; the first of them stands for it.
    agree = F.transform(F.arrays_zip(_blocks("window_fp").alias("a"), _blocks("fp").alias("b")), lambda z: F.bit_count(z["a"].bitwiseXOR(z["b"])) <= TOLERANCE)
    pairs = pairs.where(F.array_position(agree, True) - 1 == F.col("block")).select("doc", "item", "start", "window")
    judged = _with_multiset(pairs, "window", "of_window").join(_small(listed.select("item", "of_item")), "item")
    common = F.size(F.array_intersect("of_window", "of_item"))
    judged = judged.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("of_window") + F.size("of_item") - F.col("common")))
    best = F.max(F.struct("similarity", "start", F.size("of_window").alias("size"))).alias("best")
    return judged.where(F.col("similarity") >= similarity).groupBy("doc", "item").agg(best).select("doc", "item", "best.similarity", F.col("best.start").alias("first_word"), F.col("best.size").alias("shingles"))


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """:func:`contamination` with the id in place of the key; null for documents without one.

    Nulls, empty texts and tables, repeated rows and other columns are treated as there.
    """
    return contamination(df, items, id_col, **options).select(key_to_id("doc").alias(id_col), F.col("item").alias("item_id"), "similarity", "first_word", "shingles")


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all columns, of documents that contain no item.

    All rows that share the id of a document with an item go; texts without
    words stay.  Columns of any name are kept as they are; without items all
    rows stay, and an empty table gives no rows.
    """
    (key,) = free_names(df, "key")
    bad = contamination(df, items, id_col, text_col, **options).select(F.col("doc").alias(key)).distinct()
    return df.withColumn(key, doc_key(id_col, text_col)).join(bad, key, "left_anti").select(*names_of(df))
