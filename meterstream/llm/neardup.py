"""Near duplicates by BagMinHash: signatures of weighted shingle sets, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, arrow_rows, blank_cut, saved, scratch, slices, small
from .components import components

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _gap(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The exponential variable of rate 1 with this seed and number."""
    u = (_mix(seed + count * _A) >> np.uint64(11)).astype(np.float64)
    return -np.log1p(-u / float(1 << 53))


def shingles(text: str, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct windows of ``width`` lower-cased words, and how often each occurs. A shorter text is one window."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    hashed = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in map(bytes.split, blank_cut(raw))])
    if not len(hashed):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = max(1, len(hashed) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, len(hashed))):
        rolled = _mix(rolled * _A + hashed[k : k + n])
    return np.unique(rolled, return_counts=True)


def _first_points(h: np.ndarray, w: np.ndarray, doc: np.ndarray, bound: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The processes of some elements that have a point within their bag's bound (few do): seed, number and place of the first one, bound, where they begin, how wide they are, weight and bag."""
    owner, low, wide = [np.arange(len(h))], [np.zeros(len(h), np.int64)], [np.ones(len(h), np.int64)]
    k = 1
    while len(more := np.flatnonzero(w > k)):
        owner.append(more)
        low.append(np.full(len(more), k))
        wide.append(np.full(len(more), k))
        k *= 2
    owner, low, wide = np.concatenate(owner), np.concatenate(low), np.concatenate(wide)
    seed = _mix(h[owner] ^ (low.astype(np.uint64) * _C))
    number = np.zeros(len(seed), np.uint64)
    limit = bound[doc[owner]]
    at = _gap(seed, number) / (size * wide)
    live = at <= limit
    return tuple(x[live] for x in (seed, number, at, limit, low, wide, w[owner], doc[owner]))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures of non-empty bags of hashes with whole weights, one row of ``size`` floats each.

    Every element carries Poisson processes over its weight axis, cut at whole weights: one over
    (0, 1] and one over each (2^k, 2^(k+1)], with a rate of ``size`` a unit of weight. A process over
    more than a unit is split in halves at its first point, which falls in either with equal chance
    while the other half goes on from there; so the tree and its points depend on the element
    alone, and a bag of weight w holds just the points below w. A point updates the component
    that its hash names if it is earlier. Two components agree with a probability of the weighted
    Jaccard similarity. Points are followed in order and only up to a bound by which all
    components have one, and further for bags in which some have none yet.
    """
    out = np.full((len(bags), size), np.inf)
    todo = np.arange(len(bags))
    reach = 3.0
    while len(todo):
        lengths = [len(bags[i][0]) for i in todo]
        total = np.array([bags[i][1].sum() for i in todo], dtype=np.float64)
        bound = (np.log(size) + reach) / total
        hashes, weights, docs = np.concatenate([bags[i][0] for i in todo]), np.concatenate([bags[i][1] for i in todo]), np.repeat(np.arange(len(todo)), lengths)
        begun = [_first_points(*(x[at : at + (1 << 15)] for x in (hashes, weights, docs)), bound, size) for at in range(0, len(hashes), 1 << 15)]
        seed, number, at, limit, low, wide, w, doc = (np.concatenate(x) for x in zip(*begun))
        del hashes, weights, docs, begun
        flat = np.full(len(todo) * size, np.inf)
        while True:
            live = at <= limit
            if not live.all():
                seed, number, at, limit, low, wide, w, doc = (x[live] for x in (seed, number, at, limit, low, wide, w, doc))
            if not len(at):
                break
            leaf = wide == 1
            if leaf.all():
                pick = slice(None)
            else:
                pick = np.flatnonzero(leaf)
            label = (_mix(seed[pick] ^ (number[pick] * _B + _C)) >> np.uint64(16)) % np.uint64(size)
            np.minimum.at(flat, doc[pick] * size + label.astype(np.int64), at[pick])
            number[pick] += np.uint64(1)
            at[pick] += _gap(seed[pick], number[pick]) / size
            if not leaf.all():
                split = np.flatnonzero(~leaf)
                half = wide[split] // 2
                right = (_mix(seed[split] ^ _A) >> np.uint64(63)).astype(bool)  # where the point falls
                sides = []
                for side in (False, True):
                    own = _mix(seed[split] * _B + np.uint64(2 + side))
                    start = low[split] + half * side
                    first = np.where(right == side, at[split], at[split] + _gap(own, np.zeros(len(own), np.uint64)) / (size * half))
                    fits = start < w[split]
                    sides.append([x[fits] for x in (own, np.full(len(own), side, np.uint64) + np.uint64(7), first, limit[split], start, half, w[split], doc[split])])
                kept = np.flatnonzero(leaf)
                seed, number, at, limit, low, wide, w, doc = (np.concatenate([x[kept], a, b]) for x, a, b in zip((seed, number, at, limit, low, wide, w, doc), *sides))
        table = flat.reshape(len(todo), size)
        full = np.isfinite(table).all(axis=1)
        out[todo[full]] = table[full]
        todo = todo[~full]
        reach = reach * 2 + 1
    return out


def occurrences(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of a bag's (element, number of its occurrence): as sets, they have the bags' similarity."""
    if counts.max(initial=1) == 1:
        return hashes
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    spread = np.repeat(hashes, counts)
    return np.where(number > 0, _mix(spread + number.astype(np.uint64) * _A), spread)


def _named(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes() + counts.tobytes())


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, bag`` (128-bit name of the weighted shingle set; null without words) and ``keys``, a hash for each band."""
    kind = docs.schema["doc_id"].dataType
    weights = _mix(np.arange(1, rows + 1, dtype=np.uint64) * _A) | np.uint64(1)
    salt = _mix(np.arange(bands, dtype=np.uint64) * _C + _B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                bags = [shingles(x.as_py() or "", width) for x in part.column(1)]
                names = [_named(*bag) if len(bag[0]) else None for bag in bags]
                some = [i for i, bag in enumerate(bags) if len(bag[0])]
                keys: list = [None] * len(bags)
                if some:
                    signed = signatures([bags[i] for i in some], bands * rows).view(np.uint64).reshape(len(some), bands, rows)
                    banded = _mix((_mix(signed) * weights).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
                    for i, row in zip(some, banded):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "bag", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, bag binary, keys array<bigint>")


def _bags(docs: DataFrame, width: int) -> DataFrame:
    """``bag, members``: the hashed occurrences of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                bags = [b for x in part.column(0) if len((b := shingles(x.as_py() or "", width))[0])]
                yield pa.RecordBatch.from_arrays([pa.array([_named(*b) for b in bags], pa.binary()), pa.array([occurrences(*b).view(np.int64) for b in bags], pa.list_(pa.int64()))], names=["bag", "members"])

    return docs.select("text").mapInArrow(run, "bag binary, members array<bigint>")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For each pair (a, b): the sizes of both bags, what they share, and ``novel``, the occurrences that only a has."""
    one = sets.select(F.col("bag").alias("a"), F.col("members").alias("a_members"))
    two = sets.select(F.col("bag").alias("b"), F.col("members").alias("b_members"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("novel", F.array_except("a_members", "b_members"))
    sized = joined.select("a", "b", "novel", F.size("a_members").alias("n_a"), F.size("b_members").alias("n_b"))
    return sized.withColumn("shared", F.col("n_a") - F.size("novel"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, bands: int = 28, rows: int = 5, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the least doc_id of its class), ``class_size``, ``n_copies`` of its very shingles, ``n_links`` and ``similarity``.

    Two documents are linked if the weighted Jaccard similarity of their shingles of ``width``
    words is ``threshold`` or more; classes are what links connect. Texts with equal shingles are
    one node. A link is missed if no band of the signature agrees, which at the threshold happens
    for one of 70,000; every other step is exact:

    Within a bucket (texts that agree in a band) all are compared with its centre, the member that
    meets most others, so a group of copies costs its size, not its square. Texts similar enough
    to it are linked through it. Two others, or one of them and a linked one, can only share what
    each shares with the centre and what is novel in both; how much of a text's novel part any
    other text around the centre has is counted, and pairs for which the two don't add up to
    enough, or that are connected already, are left out. The rest is compared.

    Null texts and texts without words are classes of their own, equal ids are kept as rows, null
    ids come last as a class's name, an empty table gives no rows, other columns are ignored.
    """
    with scratch():
        return saved(_classes(docs, threshold, width, bands, rows, most_broadcast), "near-duplicates", outlive=True)


def _classes(docs: DataFrame, threshold: float, width: int, bands: int, rows: int, most_broadcast: int) -> DataFrame:
    part = threshold / (1 + threshold)  # bags are linked if they share this much of the sum of their sizes
    linked = F.col("shared") >= part * (F.col("n_a") + F.col("n_b")) - 1e-9
    with arrow_rows(docs.sparkSession):
        signed = saved(_signed(docs, width, bands, rows), "signed")
    nodes = saved(signed.where(F.col("bag").isNotNull()).groupBy("bag").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "keys")).alias("least"), F.count("*").alias("n_copies")).select("bag", "least.doc_id", "n_copies", "least.keys"), "nodes")
    spread = nodes.select(F.col("bag").alias("a"), F.explode("keys").alias("key"))
    crowded = saved(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    met = saved(spread.join(crowded, "key"), "buckets")
    # a bucket's centre is the member that meets most others in all bands: of edited copies, the text that they come from
    reach = met.groupBy("a").agg(F.sum("n").alias("reach"))
    centres = saved(met.join(reach, "a").groupBy("key").agg(F.min(F.struct(-F.col("reach"), F.xxhash64("a").alias("order"), F.col("a").alias("b"))).alias("least")).select("key", F.col("least.b").alias("b")), "centres")
    stars = saved(met.join(centres, "key").where("a != b").select("a", "b").distinct(), "stars")
    wanted = stars.select(F.col("a").alias("bag")).union(stars.select(F.col("b").alias("bag"))).distinct()
    owners = saved(nodes.join(wanted, "bag", "left_semi").select("bag", "doc_id"), "candidates")
    ids = owners.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(small(ids, most_broadcast), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    with arrow_rows(docs.sparkSession):
        sets = saved(_bags(texts, width).join(owners.select("bag"), "bag", "left_semi").dropDuplicates(["bag"]), "bags")
    around = saved(_measured(stars, sets), "measured")
    first = components(around.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def named(table: DataFrame, bag: str, name: str) -> DataFrame:
        """The table with the component of one of its bags, its own name where it has no link."""
        return table.join(first.select(F.col("node").alias(bag), F.col("component").alias(name)), bag, "left").withColumn(name, F.coalesce(name, bag))

    # what two texts around a centre share is shared with the centre too, or novel in both
    novel = around.select("a", "b", F.explode("novel").alias("h"))
    twice = novel.groupBy("b", "h").agg(F.count("*").alias("n")).where("n > 1").select("b", "h")
    common = novel.join(twice, ["b", "h"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    least = saved(around.groupBy("b").agg(F.min("n_a").alias("least")), "least-size")
    sized = around.drop("novel").join(common, ["a", "b"], "left").fillna(0, ["common"]).join(least, "b")
    able = F.col("shared") + F.col("common") >= part * (F.col("n_a") + F.greatest(F.col("least"), F.ceil(threshold * F.col("n_a")))) - 1e-9
    able = saved(named(sized.where(able).withColumn("near", linked), "a", "component"), "able")
    left = able.select("b", F.col("a").alias("x"), F.col("n_a").alias("n_x"), F.col("shared").alias("s_x"), F.col("common").alias("c_x"), F.col("component").alias("u")).where(~F.col("near"))
    right = able.select("b", F.col("a").alias("y"), F.col("n_a").alias("n_y"), F.col("shared").alias("s_y"), F.col("common").alias("c_y"), F.col("component").alias("v"), F.col("near").alias("near_y"))
    both = part * (F.col("n_x") + F.col("n_y")) - 1e-9
    fits = (F.col("u") != F.col("v")) & (F.col("near_y") | (F.col("x") < F.col("y"))) & (F.least("s_x", "s_y") + F.least("c_x", "c_y") >= both) & (F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y"))
    pairs = saved(left.join(right, "b").where(fits).select(F.col("x").alias("a"), F.col("y").alias("b"), "u", "v").distinct(), "pairs")
    likeness = (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("similarity")
    links = around.where(linked).select("a", "b", likeness)
    joined = None
    if not pairs.isEmpty():
        found = saved(_measured(pairs.select("a", "b").distinct(), sets).where(linked).select("a", "b", likeness), "further-links")
        links = links.unionByName(found)
        joined = saved(pairs.join(found.select("a", "b"), ["a", "b"]).select("u", "v").distinct(), "component-links")
    # a centre's own count is one row a task before the shuffle
    ends = links.select(F.col("a").alias("bag"), "similarity").unionByName(links.select(F.col("b").alias("bag"), "similarity")).groupBy("bag").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    whole = named(nodes.select("bag", "doc_id", "n_copies"), "bag", "component").join(ends, "bag", "left").fillna(0, ["n_links"])
    if joined is not None and not joined.isEmpty():
        second = components(joined).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        whole = whole.join(second, "component", "left").withColumn("component", F.coalesce("joined", "component"))
    whole = saved(whole, "texts")
    classes = saved(whole.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("n_copies").alias("class_size")), "classes")
    facts = ["class_id", "class_size", "n_copies", "n_links", "similarity"]
    by_bag = whole.join(classes, "component").select("bag", *facts)
    found = signed.where(F.col("bag").isNotNull()).select("doc_id", "bag").join(by_bag, "bag").select("doc_id", *facts)
    one = F.lit(1).cast("long")
    alone = signed.where(F.col("bag").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), one.alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("similarity"))
    return found.unionByName(alone)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the least doc_id (of rows that tie on it, one of them; null ids come last), with the columns that it came with.

    Ids may repeat or be null, so classes are made of rows: each has a number that is written out
    with it first, and a row is dropped by that number alone. Rows without words all stay.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with scratch():
        found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), **options)
        members = found.where("class_size > 1").select(F.col("doc_id").alias("_member"), "class_id")
        members = saved(members.join(numbered.select("doc_id", row), F.col("_member") == F.col(row)).select("_member", "class_id", "doc_id"), "members")
        first = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_member")).alias("least")).select(F.col("least._member").alias("_member"))
        drop = saved(members.select("_member").join(first, "_member", "left_anti"), "duplicates", outlive=True)
    drop = small(drop, options.get("most_broadcast", MOST_BROADCAST))
    return numbered.join(drop, numbered[row] == drop["_member"], "left_anti").select(*docs.columns)
