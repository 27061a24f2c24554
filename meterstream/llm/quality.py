"""Quality rules with thresholds that adapt to each language and source. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_BROADCAST, saved, small

SYMBOLS = "#*$%&|<>"
#: Metric, the least distance of its fences from the middle half, and its parts: a count and what it is a share of.
METRICS = [
    ("symbols", 150, "n_symbols", "n_words"),
    ("word_length", 900, "word_chars", "n_words"),
    ("repeats", 300, "n_repeat_words", "n_words"),
    ("dup_lines", 500, "n_dup_lines", "n_lines"),
    ("capitals", 150, "n_capitals", "word_chars"),
    ("marks", 150, "n_marks", "n_words"),
]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def _count(chars: str) -> Column:
    """How many of the text's characters are among these (ASCII ones, as in a regex's brackets)."""
    return F.octet_length(F.regexp_replace("_text", f"[^{chars}]+", "")).cast("long")


def _repeats(out: DataFrame, hashed: str) -> DataFrame:
    """Add ``n_repeat_words``: the words in three-word windows that occur twice or more.

    Windows are hashed and sorted with their positions, and the words of neighbours with equal
    hashes are compared. Hash and position share one 64-bit number, which sorts without boxing; the
    position takes as many bits as the text needs. If words differ under one hash, windows that
    are equal may have been sorted apart; in that text, windows are sorted by their words.
    """
    same_words = "_words[cast(x & _mask AS int) + {0}] = _words[cast(get(_packed, k - 1) & _mask AS int) + {0}]"
    windows = "transform(sequence(0, size(_words) - 3), i -> {})"
    out = out.withColumn("_bits", F.length(F.bin(F.size("_words").cast("long"))))
    out = out.withColumns(
        {
            "_mask": F.expr("shiftleft(1L, _bits) - 1"),
            "_packed": F.expr(f"CASE WHEN size(_words) < 4 THEN array() ELSE sort_array({windows.format(f'shiftleft({hashed}, _bits) | cast(i AS bigint)')}) END"),
        }
    )
    # for each window: 0 if its hash isn't that of the one before, 1 if their words agree as well, 2 if they don't
    like = f"""
        transform(_packed, (x, k) -> CASE WHEN k = 0 OR shiftright(x, _bits) != shiftright(get(_packed, k - 1), _bits) THEN 0
                                          WHEN {' AND '.join(same_words.format(o) for o in range(3))} THEN 1 ELSE 2 END)
    """
    out = out.withColumn("_like", F.expr(like))
    by_words = "array_sort(" + windows.format("struct(_words[i] AS a, _words[i + 1] AS b, _words[i + 2] AS c, cast(i AS bigint) AS i)") + ")"
    alike = "x.a = y.a AND x.b = y.b AND x.c = y.c"
    out = out.withColumn("_exact", F.expr(f"CASE WHEN array_contains(_like, 2) THEN {by_words} END"))
    before, after = (f"coalesce({alike.replace('y.', f'get(_exact, k {side} 1).')}, false)" for side in "-+")
    twice = F.expr(f"""
        CASE WHEN _exact IS NULL THEN transform(filter(_packed, (x, k) -> _like[k] = 1 OR coalesce(get(_like, k + 1), 0) = 1), x -> x & _mask)
             ELSE transform(filter(_exact, (x, k) -> {before} OR {after}), x -> x.i) END
    """)
    out = out.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2))))).cast("long"))
    return out.drop("_bits", "_mask", "_packed", "_like", "_exact")


def text_features(docs: DataFrame, text_col: str = "text", *, hashed: str = "xxhash64(_words[i], _words[i + 1], _words[i + 2])") -> DataFrame:
    """Add the columns of ``FEATURES``, counted over the whole text (null: none). ``hashed`` is the hash of the window at ``i``; no result depends on it."""
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns(
        {
            "_words": F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": _count(SYMBOLS),
            "n_capitals": _count("A-Z"),
            "n_marks": _count("!"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    return _repeats(out, hashed).drop("_text", "_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(v: Column) -> Column:
    """The bucket of a non-negative integer: its six leading bits, so within 1/32 of the value. Only integers, so any engine agrees."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(features: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches of all metrics: counts by bucket. Two sketches merge by adding their counts."""
    values = [F.struct(F.lit(name).alias("metric"), _bucket(F.expr(f"(1000 * {part}) div {whole}")).alias("bucket")) for name, _, part, whole in METRICS]
    return features.select(*keys, F.explode(F.array(*values)).alias("m")).select(*keys, "m.*").groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """Per key and metric: rows, and lower and upper fence around the middle half of the values."""
    each = Window.partitionBy(*keys, "metric")
    below = sketches.withColumn("below", F.sum("n").over(each.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(each))
    quarters = below.groupBy(*keys, "metric").agg(
        F.max("total").alias("rows"), F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("bucket"))).alias("q1"), F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("bucket"))).alias("q3")
    )
    floor = F.create_map(*(F.lit(x) for name, least, _, _ in METRICS for x in (name, least)))[F.col("metric")]
    reach = F.greatest(spread * (F.col("q3") - F.col("q1")), floor.cast("long"))
    return quarters.select(*keys, "metric", "rows", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(features: DataFrame, keys: tuple[str, str] = ("lang", "source"), *, least_rows: int = 100, spread: int = 4) -> DataFrame:
    """Fences for each language and source: ``lang, source, fences`` (map from metric to struct of low and high).

    A group of fewer than ``least_rows`` takes those of its language, and a language of fewer
    those of all; the larger sketches are merged from the smaller. Nulls in a key are a group.
    """
    lang, source = keys
    own = sketch(features, [lang, source])
    wide = merged(own, [lang])
    a, b, c = fences(own, [lang, source], spread), fences(wide, [lang], spread), fences(merged(wide, []), [], spread)
    b = b.select(F.col(lang).alias("_lang"), F.col("metric").alias("_m"), F.col("rows").alias("b_rows"), F.struct("low", "high").alias("b"))
    c = c.select(F.col("metric").alias("_mc"), F.struct("low", "high").alias("c"))
    both = a.join(b, a[lang].eqNullSafe(b["_lang"]) & (a["metric"] == b["_m"])).join(F.broadcast(c), a["metric"] == c["_mc"])  # c has a row for each metric
    chosen = F.when(F.col("rows") >= least_rows, F.struct("low", "high")).when(F.col("b_rows") >= least_rows, F.col("b")).otherwise(F.col("c"))
    return both.groupBy(lang, source).agg(F.map_from_entries(F.collect_list(F.struct("metric", chosen))).alias("fences"))


def judged(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, most_broadcast: int = MOST_BROADCAST, least_rows: int = 100, spread: int = 4) -> DataFrame:
    """Add features, ``base_failed``, ``kept`` and ``outside`` (the metrics beyond their fences) to every document.

    ``keep`` names the input columns to return (all by default). Documents that fail the fixed
    base rule aren't kept and don't shape the sketches. Null texts have no words and so fail it;
    repeated rows count and are judged alike; an empty table gives an empty one. Columns of the
    input that are called like an added one are replaced.
    """
    added = {*FEATURES, "base_failed", "kept", "outside", "fences"}
    keep = [c for c in (keep or docs.columns) if c not in added]
    needed = list(dict.fromkeys([*keep, "lang", "source"]))
    plain = docs.select(*needed, docs[text_col].alias("_body"))
    counted = saved(text_features(plain, "_body").drop("_body").withColumn("base_failed", base_failed()), "quality-features")
    limits = saved(thresholds(counted.where(~F.col("base_failed")), least_rows=least_rows, spread=spread), "quality-thresholds")
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fences")
    limits = small(limits, most_broadcast)  # beyond, a shuffled join, whose skewed groups Spark splits
    out = counted.join(limits, counted["lang"].eqNullSafe(limits["_lang"]) & counted["source"].eqNullSafe(limits["_source"]), "left")

    def beyond(name: str, part: str, whole: str) -> Column:
        value = _bucket(F.expr(f"(1000 * {part}) div {whole}"))
        return F.when(~F.col("base_failed") & ((value < F.col("fences")[name]["low"]) | (value > F.col("fences")[name]["high"])), F.lit(name))

    out = out.withColumn("outside", F.array_compact(F.array(*(beyond(name, part, whole) for name, _, part, whole in METRICS))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).select(*keep, *FEATURES, "base_failed", "kept", "outside")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns that they came with."""
    whole = docs.select(F.struct(*docs.columns).alias("_own"), "lang", "source", "text")
    return judged(whole, keep=["_own"], **options).where("kept").select("_own.*")
