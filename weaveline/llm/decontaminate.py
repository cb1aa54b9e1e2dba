"""Benchmark decontamination with DataFrame functions only.

Windows of an item's size are laid over a document wherever one of its 5-word shingles also is
in an item, aligned on that shingle, and wherever it has the words of an item under five words.
A window carries the items whose shingles laid it. Each window and item has a 64-bit SimHash of its
shingles, weighted by how often they occur. Windows meet their items in multi-index Hamming
blocks: RADIUS + 1 blocks of bits, of which two fingerprints within RADIUS share at least one
unchanged. Candidates within RADIUS are verified by exact weighted-shingle similarity, the sum
of the smaller weights over the sum of the larger ones, at least THRESHOLD.

A window is as long as its item, so that similarity 0.8 means eight ninths of their shingles in
common: a distance of 64-bit fingerprints of 9.7 bits on average with a deviation below 3. RADIUS 24
lies five deviations out; under nine shingles only equal texts are that similar. As a window meets
the items that laid it and no others, the pairs grow with the shared shingles and not with the
square of the benchmark, however short the blocks are.

Defined cases: null and empty texts, on either side, match nothing; a text of fewer than five
words is one shingle; items with the same words are one item, named by the smallest id; a
document with a null id keeps its rows under null; repeated rows give one result row; of equally
similar windows the first is reported; empty tables, on either side, give no rows; very long texts
are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import publish

WORDS = 5
RADIUS = 24
THRESHOLD = 0.8
GAPS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    each = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    return F.when(F.size(w) >= WORDS, each).otherwise(whole)


def run_hashes(w: Column, m: int) -> Column:
    """Hashes of the runs of m words, as shingle_hashes has them for a text of m < WORDS words; w has m words at least."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - m), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, m), " ")))


def simhash(hashes: Column) -> Column:
    """Bit b is set when more shingle occurrences have it than not."""
    votes = lambda b: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", h, b)))
    bit = lambda b: F.when(votes(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(bit(b)))


def blocks(fingerprint: Column) -> Column:
    """(block number, bits) for the RADIUS + 1 blocks."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingle hashes; a weight is a number of occurrences."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, h: s + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))))
    return shared / (F.size(a) + F.size(b) - shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, start_word, n_words, hamming, similarity, n_windows: the best window of each document and item.

    The items' distinct shingles are broadcast only when counted to be at most broadcast_rows
    (40 bytes each); beyond, both sides are shuffled on the shingle.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    items = items.groupBy("w").agg(F.min("item").alias("item")).select("item", F.size("w").alias("m"), shingle_hashes(F.col("w")).alias("item_hashes"))
    items = publish(items.withColumn("item_print", simhash(F.col("item_hashes"))), "bench-items")
    seeds = publish(items.select("item", "m", F.posexplode("item_hashes").alias("offset", "h")).groupBy("m", "offset", "h").agg(F.collect_set("item").alias("items")), "bench-seeds")
    if (seeds.agg(F.sum(F.size("items") + 1)).first()[0] or 0) <= broadcast_rows:
        seeds = F.broadcast(seeds)

    rows = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    places = rows.select("doc", "w", F.posexplode(shingle_hashes(F.col("w"))).alias("pos", "h"))
    for (m,) in items.where(F.col("m") < WORDS).select("m").distinct().collect():
        places = places.union(rows.where(F.size("w") > m).select("doc", "w", F.posexplode(run_hashes(F.col("w"), m)).alias("pos", "h")))
    placed = places.join(seeds, "h")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.size("w") - F.col("m")))
    placed = placed.select("doc", "m", start.alias("start"), "items", F.slice("w", start + 1, F.col("m")).alias("ww"))
    windows = placed.groupBy("doc", "m", "start").agg(F.max("ww").alias("ww"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    windows = windows.select("doc", "m", "start", "items", shingle_hashes(F.col("ww")).alias("hashes"))
    windows = windows.select("doc", "m", "start", "hashes", simhash(F.col("hashes")).alias("print"), F.explode("items").alias("item"))

    left = windows.withColumn("b", F.explode(blocks(F.col("print")))).select("*", "b.block", "b.bits").drop("b")
    right = items.withColumn("b", F.explode(blocks(F.col("item_print")))).select("*", "b.block", "b.bits").drop("b")
    if items.count() * (RADIUS + 1) * 64 <= broadcast_rows:
        right = F.broadcast(right)
    near = left.join(right.drop("m"), ["item", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).where(F.col("hamming") <= RADIUS)
    # A pair meets in several blocks; it counts in the first of them.
    differs = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.array_position(F.transform(blocks(differs), lambda x: x["bits"]), F.lit(0).cast("bigint")) - 1
    sure = near.where(F.col("block") == first).withColumn("similarity", similarity(F.col("hashes"), F.col("item_hashes"))).where(F.col("similarity") >= threshold)
    best = sure.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "m", "hamming")).alias("b"), F.count("*").alias("n_windows"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("b.back")).alias("start_word"), F.col("b.m").alias("n_words"), F.col("b.hamming").alias("hamming"), F.col("b.similarity").alias("similarity"), "n_windows")
