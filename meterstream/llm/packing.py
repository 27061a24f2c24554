"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LONG_BLANK = 20_000
_LONG_BLANK = re.compile(rf"(?<!\s)\s{{{LONG_BLANK}}}")
_CUT = re.compile(r"\S(?= \S)")
PIECES = "length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A byte-level BPE encoder for a ``tokenizers`` JSON file.

    In such a vocabulary ids follow the order of the merges, so its ids serve as ranks and the
    faster of the installed encoders gives the same ids (a test holds the two against each other).
    Its splitter backtracks through white space and breaks down on very long runs of it; texts
    that hold one of ``LONG_BLANK`` characters are left to the other. Long texts go in pieces, cut
    before a blank between two other characters: there the splitter begins anew anyway.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    shown |= {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}
    byte_of = {c: b for b, c in shown.items()}
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @lru_cache(maxsize=1)
    def steady() -> Tokenizer:  # loaded by the first text that needs it
        out = Tokenizer.from_file(vocabulary)
        out.encode_special_tokens = True  # in a text, their names are text
        return out

    def one(text: str) -> np.ndarray:
        long = len(text) >= LONG_BLANK and _LONG_BLANK.search(text)
        return np.array(steady().encode(text, add_special_tokens=False).ids if long else fast(text), "<u4")

    def encode(text: str, piece: int = 1 << 20) -> np.ndarray:
        parts, at = [], 0
        while len(text) - at > piece and (cut := _CUT.search(text, at + piece)):
            parts.append(one(text[at : cut.end()]))
            at = cut.end()
        return np.concatenate([*parts, one(text[at:])])

    return encode


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Place pieces into sequences; returns (piece, start in piece, length, sequence, offset) and each sequence's cost.

    A piece of n tokens costs ``linear * n + quadratic * n * n``. Pieces come longest first, and
    each goes to the sequence of lowest cost that has room for all of it; where none has, as much
    as fits goes to the sequence with most room and the rest is placed again. There are as many
    full sequences as the tokens fill, and the rest that fills none gets sequences whose
    capacities are its powers of two, so that every sequence ends up full.
    """
    total = sum(lengths)
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)
    used, cost = np.zeros(len(room), dtype=np.int64), np.zeros(len(room))
    placed = []
    whole = 0
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            if left == capacity and used[whole] == 0:  # an empty sequence is the cheapest there is
                at, whole = whole, whole + 1
                n = left
            else:
                fits = room >= left
                at = int(np.argmin(np.where(fits, cost, np.inf)))
                if not fits[at]:
                    at = int(np.argmax(room))
                n = min(left, int(room[at]))
            placed.append((piece, start, n, at, int(used[at])))
            used[at] += n
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return placed, cost


def _pack_partition(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, vocabulary: str, end_id: int, capacity: int, block: int, linear: float, quadratic: float, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    first = TaskContext.get().partitionId() << 40
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"] + ["ids"] * with_ids
    docs: list[tuple[object, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        nonlocal first
        pieces = [(d, at, min(capacity, len(ids) - at)) for d, (_, ids) in enumerate(docs) for at in range(0, len(ids), capacity)]
        placed, cost = assign([n for _, _, n in pieces], capacity, linear, quadratic)
        rows = []
        for piece, skip, n, sequence, offset in sorted(placed, key=lambda x: (x[3], x[4])):
            d, at, _ = pieces[piece]
            key, ids = docs[d]
            own = ids[at + skip : at + skip + n]
            rows.append((key, at + skip, n, zlib.crc32(own.tobytes()), len(ids), first + sequence, offset, float(cost[sequence])) + ((own,) if with_ids else ()))
        first += len(cost)
        types = [id_type] + [pa.int64()] * 6 + [pa.float64()] + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names=names)

    waiting = 0
    for batch in batches:
        keys, texts = batch.columns
        for i in range(batch.num_rows):
            ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id))
            docs.append((keys[i].as_py(), ids))
            waiting += len(ids)
            if waiting >= block:
                yield packed()
                docs, waiting = [], 0
    if docs:
        yield packed()


def pack(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, block_tokens: int = 1 << 19, linear: float = 1.0, quadratic: float = 1 / 1024, with_ids: bool = True) -> DataFrame:
    """Tokenise documents and pack them; one row per piece of a document.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost``
    and, unless ``with_ids`` is off, the piece's ``ids``. Every document is followed by ``end_id``.

    The packing goes block by block (``block_tokens`` at a time) over each input partition in one
    pass: nothing is shuffled, a task holds one block, and a lost task is repeated alone. A block
    leaves no padding: what doesn't fill whole sequences gets sequences of power-of-two length.

    A null text counts as empty and gives a single ``end_id``; null ids stay null; repeated rows
    are packed as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    if vocabulary is None:
        from public_tokenizers import path

        vocabulary = path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, start long, {PIECES}" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _pack_partition(batches, to_arrow_type(kind), vocabulary, end_id, capacity, block_tokens, linear, quadratic, with_ids)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
