"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame operations only."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, saved, scratch, small

LEAK_COLUMNS = ["doc_id", "item_id", "n_shared", "n_item", "containment"]


def _words(text: Column) -> Column:
    """Lower-cased words of letters and digits; marks inside or around a word are dropped."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), "")


def _shingles(width: int) -> Column:
    """Hashes of the windows of ``width`` words of the column ``_words``."""
    parts = ", ".join(f"_words[i + {k}]" for k in range(width))
    return F.expr(f"CASE WHEN size(_words) >= {width} THEN transform(sequence(0, size(_words) - {width}), i -> xxhash64({parts})) ELSE array() END")


def least_hits(functions: int, threshold: float, miss: float) -> int:
    """The most hits to ask for so that an item contained to ``threshold`` falls short with a chance of ``miss`` at most."""
    below, hits = 0.0, 0
    while hits < functions and below + comb(functions, hits) * threshold**hits * (1 - threshold) ** (functions - hits) <= miss:
        below += comb(functions, hits) * threshold**hits * (1 - threshold) ** (functions - hits)
        hits += 1
    return max(1, hits)


def item_shingles(benchmark: DataFrame, width: int = 5) -> DataFrame:
    """``number, item_id, widths, item`` (distinct shingle hashes), for items with a word; a text of fewer words than ``width`` is one shingle of them all.

    Rows with equal item_id are one item of all their shingles. Rows without an item_id have
    nothing to tell that they belong together: each set of shingles is an item. Items are numbered
    anew by each evaluation, so the table is to be written out before it is used twice.
    """
    rows = benchmark.select("item_id", _words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    out = rows.where(F.size("_words") >= width).select("item_id", F.lit(width).alias("width"), F.array_distinct(_shingles(width)).alias("item"))
    for short in range(1, width):
        out = out.unionByName(rows.where(F.size("_words") == short).select("item_id", F.lit(short).alias("width"), F.array_distinct(_shingles(short)).alias("item")))
    own = F.when(F.col("item_id").isNull(), F.array_sort("item"))
    # distinct rows first, so that a row repeated any number of times is gathered once
    whole = out.withColumn("own", own).withColumn("item", F.array_sort("item")).distinct().groupBy("item_id", "own").agg(F.array_distinct(F.flatten(F.collect_set("item"))).alias("item"), F.collect_set("width").alias("widths"))
    return whole.select(F.monotonically_increasing_id().alias("number"), "item_id", "widths", "item")


def sketches(items: DataFrame, threshold: float, functions: int, miss: float) -> DataFrame:
    """MinHash sketches by size partition: ``hash, number, votes, least_votes, least_shingles``.

    Items fall into partitions of doubling size. In each, the number of hash functions is that of
    ``functions`` or the partition's upper bound, whichever is less, and so is the number of hits
    asked for. A function picks the item's shingle of smallest hash; that one shingle is in a
    document with a probability equal to the containment, however long the document is, which the
    smallest hashes of a long document itself would not show.
    """
    sized = items.withColumn("part", F.length(F.bin(F.size("item").cast("long"))))
    bound = F.least(F.lit(functions), F.call_function("shiftleft", F.lit(1), F.col("part")) - 1)
    table = F.create_map(*(F.lit(x) for k in range(1, functions + 1) for x in (k, least_hits(k, threshold, miss))))
    picked = sized.select(
        "number", "item", bound.alias("functions"), F.explode(F.expr(f"transform(sequence(1, least({functions}, cast(shiftleft(1, part) - 1 AS int))), j -> array_min(transform(item, h -> struct(xxhash64(h, j) AS order, h AS hash))).hash)")).alias("hash")
    )
    return picked.groupBy("number", "hash", "functions", F.size("item").alias("n_item")).agg(F.count("*").alias("votes")).select(
        "hash", "number", "votes", table[F.col("functions")].alias("least_votes"), F.ceil(F.lit(threshold) * F.col("n_item")).alias("least_shingles")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, width: int = 5, functions: int = 32, miss: float = 1e-6, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct shingles it contains ``threshold`` or more.

    Returns ``doc_id, item_id, n_shared, n_item, containment``. Documents are searched whole:
    their shingles meet the sketches of the items, documents too short for an item are left out by
    size, those with enough hits are candidates, and each candidate is verified by exact
    containment of shingles. Small tables (the sketches, the ids of candidates, the items) are
    measured first and broadcast up to ``most_broadcast`` bytes; beyond, they are written out and
    joined by shuffles that Spark splits where a shingle or document is common.

    Null texts and items without words match nothing; rows with equal doc_id are one document, and
    rows with equal item_id one item, each shingle counted once; null ids are matched like any
    other, but each text with a null item_id is an item of its own; empty tables give no rows.
    """
    with scratch():
        return saved(_leaks(docs, benchmark, threshold, width, functions, miss, most_broadcast), "leaks", outlive=True)


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, width: int, functions: int, miss: float, most_broadcast: int) -> DataFrame:
    items = saved(item_shingles(benchmark, width), "benchmark-items")
    index = saved(sketches(items, threshold, functions, miss), "benchmark-index")
    widths = [r[0] for r in items.select(F.explode("widths")).distinct().collect()]  # at most ``width`` values
    if not widths:
        return docs.select("doc_id").limit(0).join(items.select("item_id"), F.lit(False)).selectExpr("doc_id", "item_id", "0 AS n_shared", "0 AS n_item", "0D AS containment")

    def shingled(rows: DataFrame) -> DataFrame:
        found = F.concat(*(_shingles(w) for w in widths)) if len(widths) > 1 else _shingles(widths[0])
        return rows.withColumn("_words", _words(F.col("text"))).withColumn("_shingles", found).withColumn("_size", F.size("_shingles"))

    # explode_outer: for explode, Spark would put a filter on the array below, and there take the text apart for every shingle again
    terms = shingled(docs.select("doc_id", "text")).select("doc_id", "_size", F.explode_outer("_shingles").alias("hash"))
    hits = terms.join(small(index, most_broadcast), "hash").where(F.col("_size") >= F.col("least_shingles"))
    hits = hits.groupBy("doc_id", "number", "hash").agg(F.first("votes").alias("votes"), F.first("least_votes").alias("least_votes"))
    found = hits.groupBy("doc_id", "number").agg(F.sum("votes").alias("votes"), F.first("least_votes").alias("least_votes"))
    pairs = saved(found.where(F.col("votes") >= F.col("least_votes")).select("doc_id", "number"), "leak-candidates")
    ids = small(saved(pairs.select("doc_id").distinct(), "leak-documents"), most_broadcast)
    again = docs.select("doc_id", "text").join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    parts = shingled(again).select("doc_id", F.explode_outer("_shingles").alias("hash")).distinct()
    wanted = pairs.withColumnRenamed("doc_id", "_id").join(small(items.select("number", "item_id", "item"), most_broadcast), "number").select("_id", "number", "item_id", F.size("item").alias("n_item"), F.explode("item").alias("_hash"))
    exact = wanted.join(parts, wanted["_id"].eqNullSafe(parts["doc_id"]) & (wanted["_hash"] == parts["hash"])).groupBy("doc_id", "number", "item_id", "n_item").agg(F.count("*").cast("int").alias("n_shared"))
    return exact.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold).select(*LEAK_COLUMNS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, most_broadcast: int = MOST_BROADCAST, **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns that they came with."""
    found = saved(leaks(docs, benchmark, most_broadcast=most_broadcast, **options).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked-ids")
    found = small(found, most_broadcast)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti")
