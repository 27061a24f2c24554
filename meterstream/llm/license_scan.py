"""License scan: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import GAP, Rule, rules

_RUN = re.compile(rb"  +")
#: Bytes of words become ``a`` and all others blanks, so that splitting counts words. Bytes from 0x80 on belong to words.
_WORDS = bytes(97 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes of words stay and all others become blanks.
_GAPS = bytes(b if _WORDS[b] == 97 else 32 for b in range(256))

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_BASE = [(label, phrase.split()[0].encode(), re.compile(rf"(?<![0-9a-z\x80-\xff]){GAP.join(phrase.split())}(?![0-9a-z\x80-\xff])".encode("latin-1"))) for phrase, label in BASE.items()]


def spaced(lowered: bytes) -> str:
    """The words with one blank for each gap between them, as a string of a character a byte: however a notice is wrapped, it reads the same."""
    return _RUN.sub(b" ", lowered.translate(_GAPS)).strip(b" ").decode("latin-1")


@lru_cache(maxsize=1)
def _gate():
    """The automaton that finds keywords in a text made by ``spaced``, and the rules that each of them opens."""
    import ahocorasick

    opened: dict[str, list[int]] = {}
    ordered = rules()
    for n, rule in enumerate(ordered):
        for word in rule.keywords:
            opened.setdefault(spaced(word.encode()), []).append(n)
    automaton = ahocorasick.Automaton()
    for word, numbers in opened.items():
        automaton.add_word(word, (word, tuple(numbers)))
    automaton.make_automaton()
    return automaton, ordered


def count_words(lowered: bytes) -> int:
    marks = lowered.translate(_WORDS)
    return marks.count(b" a") + marks.startswith(b"a")


def detect(lowered: bytes) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) in lower-cased UTF-8 bytes, without those that a better or equal one contains.

    A rule is better by a lower priority; of equals on the same interval the earlier rule stays,
    and an interval within a longer one of the same priority goes.
    """
    automaton, ordered = _gate()
    open_rules = sorted({n for _, (_, numbers) in automaton.iter(spaced(lowered)) for n in numbers})
    found = sorted(((m.start(), -m.end(), rule.priority, n) for n in open_rules for rule in (ordered[n],) for m in rule.pattern.finditer(lowered)))
    kept: list[tuple[int, int, Rule]] = []
    furthest: dict[int, int] = {}  # by priority: the end reached by an interval that starts no later
    for start, minus_end, priority, n in found:  # what contains an interval comes before it, and so does the same one by a better or earlier rule
        if not any(p <= priority and reach >= -minus_end for p, reach in furthest.items()):
            kept.append((start, -minus_end, ordered[n]))
        furthest[priority] = max(furthest.get(priority, -1), -minus_end)
    return kept


#: Bytes of UTF-8 that go on with a character.
_INNER = bytes(range(0x80, 0xC0))


def characters(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """How many code points stand before each byte offset."""
    out, last, n = {}, 0, 0
    for at in sorted(set(offsets)):
        n += len(raw[last:at].translate(None, _INNER))
        out[at], last = n, at
    return out


def _scan(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass").lower()
    places, base_labels = [], set()
    for label, first, pattern in _BASE:
        if first in raw:
            hits = [m.start() for m in pattern.finditer(raw)]
            places += hits
            base_labels |= {label} if hits else set()
    found = detect(raw)
    labels = base_labels | {rule.label for _, _, rule in found}
    score = 0.0
    for weight in (rule.weight for _, _, rule in found):
        score = score + weight - score * weight
    if base_labels:
        score = max(score, 0.6)
    at = characters(raw, [x for s, e, _ in found for x in (s, e)])
    spans = [{"start": at[s], "end": at[e], "label": r.label, "rule": r.name} for s, e, r in found]
    first, last = (count_words(raw[: min(places)]), count_words(raw[: max(places)])) if places else (None, None)
    return count_words(raw), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, score), spans


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,rule:string>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named or quoted in each text; one row per document.

    Columns: ``doc_id``, the word count, the places of the base phrases (all, first and last by
    word number), their labels, all labels, a confidence from 0 to 1 and the ``detections``
    (code-point intervals with label and rule). Whole texts are scanned, of any length; a null
    text counts as empty; repeated rows are scanned alike; other columns are ignored. There is no
    shuffle.
    """
    kind = docs.schema[id_col].dataType
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detection = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string())]))
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), detection]
        for batch in batches:
            rows = [_scan(text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), type=t) for x, t in zip(columns, types))], names=names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {SCHEMA}")
