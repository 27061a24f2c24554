"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
#: Multipliers that mix the code points of a subword (odd constants).
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point of the basic plane: whether it is a letter or mark of a word."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with one zero for each run of anything else and one at either end; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(points) == 0:
        return points
    letter = _letters()[np.minimum(points, 0xFFFF)]
    if points.max() > 0xFFFF:
        far = points > 0xFFFF
        letter = letter.copy()
        letter[far] = [chr(c).isalpha() for c in points[far]]
    if not letter.any():
        return points[:0]
    edge = np.flatnonzero(letter)
    keep = letter.copy()
    keep[edge[1:][np.diff(edge) > 1] - 1] = True  # the last of each gap stands for it
    inner = np.where(letter, points, 0)[keep].astype(np.uint32)
    return np.concatenate([[0], inner, [0]]).astype(np.uint32)


def subwords(points: np.ndarray, bits: int, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """Buckets of all subwords: runs of letters of the given sizes, word boundaries included."""
    out = []
    for size in sizes:
        n = len(points) - size + 1
        if n <= 0:
            continue
        mixed = np.full(n, size * 0x1000193 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(size):
            mixed ^= points[k : k + n] * _MIX[k]
            mixed = (mixed << np.uint32(13)) | (mixed >> np.uint32(19))
        mixed *= np.uint32(0x9E3779B1)
        if size > 2:  # nothing but its ends may be a boundary
            inside = points[1 : 1 + n] != 0
            for k in range(2, size - 1):
                inside &= points[k : k + n] != 0
            mixed = mixed[inside]
        out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


@dataclass
class Model:
    """Languages, each bucket's contribution to each language's score, biases, temperature and the least confidence."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    bits: int

    def logits(self, text: str, piece: int = 1 << 18) -> np.ndarray | None:
        """Scores before the softmax; null for a text without letters.

        Long texts go in pieces, cut at a blank or line end where their second half has one.
        """
        total, count, at = np.zeros(len(self.languages)), 0, 0
        while at < len(text):
            to = len(text) if len(text) - at <= piece else max(text.rfind(" ", at + piece // 2, at + piece), text.rfind("\n", at + piece // 2, at + piece))
            to = at + piece if to <= at else to
            found = subwords(code_points(text[at:to]), self.bits)
            at = to
            if len(found) > len(self.table):
                total += np.bincount(found, minlength=len(self.table)) @ self.table
            else:
                total += self.table[found].sum(axis=0, dtype=np.float64)
            count += len(found)
        return total / count + self.bias if count else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it falls short of the least confidence.

        A model without languages knows none of a text with letters, and rejects none either.
        """
        logits = self.logits(text) if text else None
        if logits is None:
            return UNKNOWN, 0.0, True
        if not self.languages:
            return UNKNOWN, 0.0, False
        scaled = logits / self.temperature
        p = np.exp(scaled - scaled.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def train(texts: list[str], langs: list[str], *, bits: int = 16, dims: int = 16, epochs: int = 12, rate: float = 2.0, seed: int = 7, quantile: float = 0.002) -> Model:
    """Fit by stochastic gradient descent; a fifth of the rows calibrates.

    The temperature minimises the log loss of the rows set aside, two in a hundred labels being doubted, and the least confidence is
    what all but ``quantile`` of the rightly classified ones among them reach, but no more than a
    fifth of the way from an even guess to certainty, so that texts in two languages stay.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    label = {x: k for k, x in enumerate(languages)}
    data = []
    for text, lang in zip(texts, langs):
        found = subwords(code_points(text), bits)
        if len(found):
            ids, counts = np.unique(found, return_counts=True)
            data.append((ids, (counts / counts.sum()).astype(np.float32), label[lang]))
    emb = rng.normal(0, 0.1, (1 << bits, dims)).astype(np.float32)
    out, bias = np.zeros((dims, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    order = rng.permutation(len(data))
    aside, fit = order[: len(data) // 5], order[len(data) // 5 :]
    for epoch in range(epochs if len(languages) > 1 else 0):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(fit):
            ids, share, y = data[k]
            rows = emb[ids]
            mean = share @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            emb[ids] = rows - step * share[:, None] * back * 4
    table = (emb @ out).astype(np.float32)
    scores = np.array([share @ table[ids] + bias for ids, share, _ in (data[k] for k in aside)]).reshape(len(aside), len(languages))
    truth = np.array([data[k][2] for k in aside], dtype=int)
    temperature, least = 1.0, 0.0
    if len(aside) and len(languages) > 1:

        def probabilities(t: float) -> np.ndarray:
            p = np.exp(scores / t - (scores / t).max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)

        # a few rows in a hundred may be labelled wrongly: without that allowance, rows that are all told apart would be taken for certain
        aim = np.full(scores.shape, 0.02 / len(languages))
        aim[np.arange(len(truth)), truth] += 0.98
        losses = {t: -(aim * np.log(np.maximum(probabilities(t), 1e-12))).sum(axis=1).mean() for t in np.geomspace(0.02, 8, 60)}
        temperature = float(min(losses, key=losses.get))
        p = probabilities(temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        even = 1 / len(languages)
        least = min(float(np.quantile(right, quantile)) if len(right) else 1.0, even + (1 - even) / 5)
    return Model(languages, table, bias, temperature, least, bits)


def sample(docs: DataFrame, *, per_language: int = 400, longest: int = 20_000, most_languages: int = 500) -> tuple[list[str], list[str]]:
    """Labelled texts to fit on: ``per_language`` different ones for each language (all where there are fewer), of ``longest`` characters at most.

    These bounds are the operator's only ones; of more languages than ``most_languages``, those
    with most texts are learned. Texts are chosen by the least hashes, each language by itself and
    each text once, however often it occurs: a share worked out from the language's number of
    different texts comes first, so that little more than what is chosen is shuffled.
    """
    hashed = F.xxhash64("text", F.lit("language sample"))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= longest)).select("lang", "text", hashed.alias("order"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("order", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return [], []
    # half as many again and a few more, so that the share falls short of none
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, (1.5 * per_language + 20) / max(1, r["n"])))))
    draw = F.pmod("order", F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = labelled.where(draw < shares[F.col("lang")]).dropDuplicates(["lang", "order"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 20)), "order"))
    rows = sorted((r["lang"], r["text"]) for r in drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text").collect())
    return [t for _, t in rows], [x for x, _ in rows]


def identify(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to each document; ``keep`` names the input columns to return.

    The whole text is used and nothing else. A text that is null or has no letter gets ``und``
    with score 0 and is rejected; so does any text, without being rejected, from a model that has
    learned no language. Repeated texts get equal results; an empty table gives an empty one;
    input columns called like an added one are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "rejected")]
    plain = docs.select(*keep, docs[text_col].alias("_body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the buckets, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    kinds = plain.select(*keep).schema
    out = kinds.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return plain.mapInArrow(run, out)


def fold(docs: DataFrame, n: int):
    """Checksum of doc_id as text, modulo n; 0 for a null id."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(n))


def fitted(docs: DataFrame, **options) -> Model:
    """A model learned from the labelled documents whose fold modulo 3 isn't 1; without any, it knows no language."""
    return train(*sample(docs.where(fold(docs, 3) != 1)), **options)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised with enough confidence, with the columns that they came with.

    Needs the columns ``doc_id``, ``text`` and ``lang``. Where no document has a label, there is
    nothing to judge by, and only texts that are null or have no letter go.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_own"), "text")
    return identify(whole, fitted(docs), keep=["_own"]).where(~F.col("rejected")).select("_own.*")
