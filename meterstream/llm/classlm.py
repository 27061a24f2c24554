"""Class-based bigram language model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blank_cut, forget, saved, scratch, slices
from .langid import fold

#: Hash and form of the token that ends every text.
END = -0x5851F42D4C957F2D
END_FORM = 0
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


class Tokens:
    """Splits lower-cased texts into words: a 64-bit hash of each and its form, a number below ``forms`` made from its last letters."""

    def __init__(self, forms: int, piece: int = 1 << 18):
        self.forms, self.piece = forms, piece

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and forms of the words of some texts, and how many each has."""
        words = [x.split() for x in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())).view(np.int64)
        del words
        # two blanks in front, one behind: every word's last three bytes and what is before it can be looked at
        b = np.frombuffer(b"  " + b"\n".join(texts) + b" ", np.uint8)
        blank = _BLANK[b]
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        tail, inside = b[last].astype(np.uint32), np.ones(len(last), bool)
        for back in (1, 2):
            inside &= ~blank[last - back]
            tail |= np.where(inside, b[last - back], np.uint8(0)).astype(np.uint32) << np.uint32(8 * back)
        form = (tail * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(self.forms - 1)
        return hashes, form.astype(np.int32) + np.int32(1), counts

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The texts' tokens, each text closed by the end token, in pieces: the number of a piece's first text, hashes and forms, and the tokens that each of its texts has there.

        A long text takes several pieces.
        """

        def closed(first: int, hashes: np.ndarray, form: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
            at = np.cumsum(counts)
            return first, np.insert(hashes, at, END), np.insert(form, at, END_FORM), counts + 1

        first, size = 0, 0
        for k, raw in enumerate(texts):
            if k > first and size + len(raw) > self.piece:
                yield closed(first, *self._words(texts[first:k]))
                first, size = k, 0
            size += len(raw)
            if len(raw) > self.piece:
                parts = list(blank_cut(raw, self.piece))
                for part in parts[:-1]:
                    yield k, *self._words([part])
                yield closed(k, *self._words([parts[-1]]))
                first, size = k + 1, 0
        if first < len(texts):
            yield closed(first, *self._words(texts[first:]))


def _blocks(batches: Iterator[pa.RecordBatch], forms: int, tokens: int = 1 << 19) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of a partition's texts (the first column) in blocks of about ``tokens``: for each text or part of one its number in the partition, the values of the second column and its number of tokens, and the tokens' hashes and forms."""
    split = Tokens(forms)
    waiting, before = 0, 0
    numbers, keys, parts = [], [], []

    def block() -> tuple:
        return np.concatenate(numbers), keys, *(np.concatenate(x) for x in zip(*parts))

    for batch in batches:
        for part in slices(batch, 0):
            own = part.column(1).to_pylist() if part.num_columns > 1 else []
            for first, hashes, form, counts in split.of([(x.as_py() or "").encode("utf-8", "surrogatepass").lower() for x in part.column(0)]):
                numbers.append(before + first + np.arange(len(counts)))
                keys += own[first : first + len(counts)]
                parts.append((counts, hashes, form))
                waiting += len(hashes)
                if waiting >= tokens:
                    yield block()
                    numbers, keys, parts, waiting = [], [], [], 0
            before += part.num_rows
    if parts:
        yield block()


def count_words(texts: DataFrame, forms: int) -> DataFrame:
    """``word, form, c`` of all tokens of the column ``text``; each task sums its blocks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, hashes, form in _blocks(batches, forms):
            word, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(form[first]), pa.array(n)], names=["word", "form", "n"])

    return texts.select("text").mapInArrow(run, "word long, form int, n long").groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("c"))


@dataclass
class Units:
    """What clusters are made of: each frequent word is a unit, and so are the other words of each form."""

    words: np.ndarray  # sorted hashes of the frequent words
    forms: int

    def of(self, hashes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each token (forms first), and whether it is a frequent word."""
        at = np.searchsorted(self.words, hashes).astype(np.int32)
        at[at == len(self.words)] = 0
        frequent = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return np.where(frequent, at + np.int32(self.forms), form), frequent

    def end(self) -> int:
        """Unit of the end token."""
        return int(self.of(np.array([END]), np.array([END_FORM], np.int32))[0][0])


def count_bigrams(texts: DataFrame, units: Units) -> DataFrame:
    """``u, v, n``: how often unit v follows unit u. A text begins after an end token."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        last = own.end()  # what follows an end token follows the end of a text
        for _, _, _, hashes, form in _blocks(batches, own.forms):
            unit, _ = own.of(hashes, form)
            pair, n = np.unique(np.concatenate([[last], unit[:-1]]).astype(np.int64) << 32 | unit, return_counts=True)
            last = unit[-1]
            yield pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["u", "v", "n"])

    return texts.select("text").mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training log likelihood that depends on the classes; ``pairs`` counts class bigrams.

    Texts begin and end with the end token, so a class has as many followers as predecessors.
    """
    return float(_xlogx(pairs).sum() - 2 * _xlogx(pairs.sum(1)).sum())


def best_moves(of: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the class where an exchange puts it with all other units fixed, and what that gains.

    ``after[u, c]`` and ``before[u, c]`` count the followers and predecessors of u by class, and
    ``itself[u]`` how often u follows itself.
    """
    to, gain = of.copy(), np.zeros(len(of))
    base, totals = likelihood(pairs), pairs.sum(1)
    for u in np.flatnonzero(after.sum(1)):
        a, own = of[u], itself[u]
        out, into = after[u].copy(), before[u].copy()
        out[a] -= own
        into[a] -= own
        rest = pairs.copy()  # all bigrams without u
        rest[a] -= out
        rest[:, a] -= into
        rest[a, a] -= own
        count = after[u].sum()
        left = totals.copy()
        left[a] -= count
        whole = _xlogx(rest)
        score = whole.sum() + (_xlogx(rest + out) - whole).sum(1) + (_xlogx(rest + into[:, None]) - whole).sum(0)
        corner = np.diagonal(rest)  # a class's own cell stands in its row and in its column
        score += _xlogx(corner + out + into + own) - _xlogx(corner + out) - _xlogx(corner + into) + _xlogx(corner)
        held = _xlogx(left)
        score -= 2 * (held.sum() - held + _xlogx(left + count))
        b = int(score.argmax())
        if score[b] > score[a] + 1e-9:
            to[u], gain[u] = b, score[b] - base
    return to, gain


def _units(bigrams: DataFrame, of: np.ndarray) -> DataFrame:
    """The class of each unit, to be broadcast: a row for each unit."""
    return F.broadcast(bigrams.sparkSession.createDataFrame(pa.table({"unit": pa.array(np.arange(len(of), dtype=np.int32)), "class": pa.array(of.astype(np.int32))})))


def _class_bigrams(bigrams: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """How often a class follows another."""
    table = _units(bigrams, of)
    after = bigrams.join(table.select(F.col("unit").alias("u"), F.col("class").alias("a")), "u").join(table.select(F.col("unit").alias("v"), F.col("class").alias("b")), "v")
    pairs = np.zeros((classes, classes))
    for row in after.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        pairs[row["a"], row["b"]] = row["n"]
    return pairs


def _profiles(bigrams: DataFrame, of: np.ndarray, classes: int) -> tuple[DataFrame, np.ndarray]:
    """Followers (side 0) and predecessors (side 1) of each unit by class, written out, and class bigrams."""
    table = _units(bigrams, of)
    after = bigrams.join(table, F.col("v") == F.col("unit")).select(F.col("u").alias("unit"), F.lit(0).alias("side"), "class", "n")
    before = bigrams.join(table, F.col("u") == F.col("unit")).select(F.col("v").alias("unit"), F.lit(1).alias("side"), "class", "n")
    found = saved(after.unionByName(before).groupBy("unit", "side", "class").agg(F.sum("n").alias("n")), "profiles")
    pairs = np.zeros((classes, classes))
    own = table.withColumnRenamed("class", "own")
    for row in found.where("side = 0").join(own, "unit").groupBy("own", "class").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        pairs[row["own"], row["class"]] = row["n"]
    return found, pairs


def _moves(profiles: DataFrame, of: np.ndarray, itself: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_moves`` of all units, each worked out where its profile is; a class and a gain for each come back."""
    shared = profiles.sparkSession.sparkContext.broadcast((of, itself, pairs))  # bounded by units and classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        unit, side, cls, n = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(4))
        own_of, own_itself, own_pairs = shared.value
        units, at = np.unique(unit, return_inverse=True)
        for first in range(0, len(units), 1 << 14):
            some = (at >= first) & (at < first + (1 << 14))
            which = units[first : first + (1 << 14)]
            counts = np.zeros((2, len(which), len(own_pairs)))
            counts[side[some], at[some] - first, cls[some]] = n[some]
            to, gain = best_moves(own_of[which], counts[0], counts[1], own_itself[which], own_pairs)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(to.astype(np.int64)), pa.array(gain)], names=["unit", "to", "gain"])

    found = profiles.repartition("unit").mapInArrow(run, "unit long, to long, gain double").toArrow()
    to, gain = of.copy(), np.zeros(len(of))
    at = found["unit"].to_numpy()
    to[at], gain[at] = found["to"].to_numpy(), found["gain"].to_numpy()
    return to, gain


def exchange(bigrams: DataFrame, units: int, classes: int, rounds: int, start: np.ndarray | None = None, least_gain: float = 2e-4) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each unit, class bigram counts, and the likelihood before each round.

    A round works out every unit's best class against the classes of the round before; of the
    units that want to move, a different half does each round, so that they don't all chase each
    other. A round that lowers the likelihood is taken back and half as many move. It ends when a
    round gains less than ``least_gain`` of the likelihood, none wants to move, or after ``rounds``.
    Without classes to ``start`` from, units are dealt out by their frequency; with them, all that
    want to move do at first.
    """

    def by_unit(table: DataFrame) -> np.ndarray:
        out, found = np.zeros(units), table.toArrow()  # a row for each unit at most
        out[found["u"].to_numpy()] = found["n"].to_numpy()
        return out

    itself = by_unit(bigrams.where("u = v").select("u", "n"))
    of = start
    if of is None:
        of = np.empty(units, np.int64)
        of[np.argsort(-by_unit(bigrams.groupBy("u").agg(F.sum("n").alias("n"))), kind="stable")] = np.arange(units) % classes
    profiles, pairs = _profiles(bigrams, of, classes)
    history = [likelihood(pairs)]
    rng = np.random.default_rng(11)
    share, to = 0.5 if start is None else 1.0, None
    for left in range(rounds, 0, -1):
        if to is None:
            to, _ = _moves(profiles, of, itself, pairs)
        chosen = (to != of) & (rng.random(units) < share)
        if not chosen.any():
            break
        tried = np.where(chosen, to, of)
        found = _profiles(bigrams, tried, classes) if left > 1 else (profiles, _class_bigrams(bigrams, tried, classes))
        reached = likelihood(found[1])
        if reached <= history[-1]:
            if found[0] is not profiles:
                forget(found[0])
            share /= 2
            continue
        if found[0] is not profiles:
            forget(profiles)
        of, to, (profiles, pairs) = tried, None, found
        history.append(reached)
        if reached - history[-2] < least_gain * abs(history[-2]):
            break
    forget(profiles)
    return of, pairs, history


def coarse(bigrams: DataFrame, to: np.ndarray) -> DataFrame:
    """Bigrams of the units that each unit goes ``to``."""
    spark = bigrams.sparkSession
    table = spark.createDataFrame(pa.table({"unit": pa.array(np.arange(len(to), dtype=np.int32)), "to": pa.array(to.astype(np.int32))}))

    def named(column: str) -> DataFrame:
        return F.broadcast(table.select(F.col("unit").alias(column), F.col("to").alias(f"to_{column}")))  # a row for each unit

    return bigrams.join(named("u"), "u").join(named("v"), "v").groupBy(F.col("to_u").alias("u"), F.col("to_v").alias("v")).agg(F.sum("n").alias("n"))


@dataclass
class Scorer:
    """What scoring a token needs but for the counts of infrequent words."""

    units: Units
    of: np.ndarray  # class by unit
    step: np.ndarray  # log10 of class transitions
    frequent: np.ndarray  # counts of the frequent words, as ordered in units
    mass: np.ndarray  # by class: log10 of what counts are divided by


def _scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """In one table, rows for each document or part of a long one (its tokens and what is known of its scores) and rows for infrequent words (where a block holds them: documents, counted from ``number``)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by units and classes
    names = ["number", "doc_id", "held_out", "n_tokens", "n_known", "counted", "classes", "word", "places"]
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [pa.int64(), to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32())]
        own = shared.value
        last = own.of[own.units.end()]
        base = TaskContext.get().partitionId() << 40
        log_frequent = np.log10(own.frequent + 0.5)
        for numbers, keys, counts, hashes, form in _blocks(batches, own.units.forms):
            n = len(counts)
            doc = np.repeat(np.arange(n, dtype=np.int32), counts)
            unit, frequent = own.units.of(hashes, form)
            cls = own.of[unit]
            classes = np.bincount(doc, own.step[np.concatenate([[last], cls[:-1]]), cls] - own.mass[cls], n)
            last = cls[-1]
            often = np.flatnonzero(frequent)
            counted = np.bincount(doc[often], log_frequent[unit[often] - own.units.forms], n).astype(float)  # of no frequent word, bincount gives whole numbers
            known = np.bincount(doc[often], minlength=n)
            del cls, unit, form, often
            none = pa.nulls(n)
            columns = [pa.array(base + numbers), pa.array([k["doc_id"] for k in keys], types[1]), pa.array([k["held_out"] for k in keys]), pa.array(counts), pa.array(known.astype(np.int64)), pa.array(counted), pa.array(classes), none.cast(types[7]), none.cast(types[8])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            rare = np.flatnonzero(~frequent)
            order = rare[np.argsort(hashes[rare], kind="stable")]
            words, first = np.unique(hashes[order], return_index=True)
            del rare, frequent
            places = (numbers[doc[order]] - numbers[0]).astype(np.int32)
            for at in range(0, len(words), 1 << 14):
                to = min(len(words), at + (1 << 14))
                cuts = np.append(first, len(order))[at : to + 1]
                lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(places[cuts[0] : cuts[-1]]))
                none = pa.nulls(to - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, base + numbers[0])), *(none.cast(t) for t in types[1:7]), pa.array(words[at:to]), lists], names=names)

    return docs.select("text", F.struct("doc_id", "held_out").alias("key")).mapInArrow(run, f"number long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, counted double, classes double, word long, places array<int>")


def score(docs: DataFrame, *, classes: int = 64, forms: int = 256, share: float = 2e-6, frequent: float = 5e-5, rounds: int = 30, later_rounds: int = 1, smooth: float = 50.0) -> DataFrame:
    """Score every whole text by a class bigram model learned from the documents whose fold modulo 5 isn't 1.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.
    Tokens are lower-cased (A-Z) words and one end per text. ``base_score`` is the smoothed unigram
    model's. In ``score``, a token costs its class's transition from the class before, mixed with
    the classes' own shares, and its emission, its count among those of its class, with half a
    count added to each known word and to one that stands for the unknown.

    Classes hold units: a word that makes up ``share`` of the training tokens or more is a unit (so
    there are 1/share of these at most, whatever the corpus), and all other words with the same
    last letters are one unit of the ``forms``; so every word, unseen ones too, has a class. The
    exchange goes in two steps, as late rounds over all bigrams cost most: for ``rounds`` or until it
    settles with words of a ``frequent`` share for units, and from there ``later_rounds`` with all.
    Counts cover all training tokens. The counts of infrequent words come by a shuffle on the
    word, in which a row has a word and all its places in a block of texts.

    Null texts count as empty (the end token alone); repeated rows are scored alike; a null doc_id
    trains; without training documents every word is unknown; other columns are ignored.
    """
    with scratch():
        return saved(_scores(docs, classes, forms, share, frequent, rounds, later_rounds, smooth), "class-scores", outlive=True)


def _scores(docs: DataFrame, classes: int, forms: int, share: float, most: float, rounds: int, later_rounds: int, smooth: float) -> DataFrame:
    folded = docs.select("doc_id", "text", (fold(docs, 5) == 1).alias("held_out"))
    training = folded.where(~F.col("held_out"))
    with arrow_rows(docs.sparkSession):
        vocabulary = saved(count_words(training, forms), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = vocabulary.where(F.col("c") >= share * total).select("word", "form", "c").toPandas().sort_values("word")  # 1 / share rows at most
    units = Units(head["word"].to_numpy(np.int64), forms)
    frequent = head["c"].to_numpy(np.float64)
    n_units = forms + len(units.words)
    with arrow_rows(docs.sparkSession):
        bigrams = saved(count_bigrams(training, units), "bigrams")
    to = np.arange(n_units)  # the units of the first step: frequent words, and the forms of all others
    shift = np.cumsum(frequent >= most * total) + forms - 1
    to[forms:] = np.where(frequent >= most * total, shift, head["form"].to_numpy(np.int64))
    first = saved(coarse(bigrams, to), "coarse-bigrams")
    of, _, _ = exchange(first, int(to.max()) + 1, classes, rounds)
    of, pairs, _ = exchange(bigrams, n_units, classes, later_rounds, start=of[to])
    # tokens and distinct words of each class
    mass, kinds = np.zeros(classes), np.zeros(classes)
    np.add.at(mass, of[forms:], frequent)
    np.add.at(kinds, of[forms:], 1)
    for row in vocabulary.where(F.col("c") < share * total).groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row for each form
        mass[of[row["form"]]] += row["c"]
        kinds[of[row["form"]]] += row["n"]
    prior = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * classes)
    step = np.log10((pairs + smooth * prior) / (pairs.sum(1, keepdims=True) + smooth))
    scorer = Scorer(units, of, step, frequent, np.log10(mass + 0.5 * (kinds + 1)))
    forget(bigrams)
    with arrow_rows(docs.sparkSession):
        parts = saved(_scored(folded, scorer), "scored-parts")
    value = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    places = parts.where(F.col("word").isNotNull()).select("number", "word", "places").join(vocabulary.select("word", "c"), "word", "left")
    at = places.select("number", F.explode("places").alias("at"), value.alias("counted"), F.when(F.col("c") > 0, 1).otherwise(0).cast("long").alias("n_known")).select((F.col("number") + F.col("at")).alias("number"), "n_known", "counted")
    nothing = {name: F.lit(None).cast(parts.schema[name].dataType) for name in ("doc_id", "held_out", "n_tokens", "classes")}
    rows = parts.where(F.col("word").isNull()).select("number", "doc_id", "held_out", "n_tokens", "n_known", "counted", "classes").unionByName(at.withColumns(nothing))
    # parts of a document agree in the columns of which the largest is taken
    found = rows.groupBy("number").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "counted", "classes")))
    scored = F.col("classes") + F.col("counted")
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"),
        scored.alias("score"),
        F.pow(F.lit(10.0), -scored / F.col("n_tokens")).alias("perplexity"),
    )
