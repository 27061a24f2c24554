"""The corpus operators on small tables: against brute force, round trips, and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterstream.llm import boosting, chat, classlm, common, components, decontaminate, html_extract, langid, license_scan, neardup, packing, quality, warc
from meterstream.llm.dom import Page, features

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (id, text) or (id, text, lang, source)."""
    full = [(*r, *(None, None)[: 4 - len(r)]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, la, so, None) for i, t, la, so in full], DOCS)


def prose(rng, n, words="the of and lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor incididunt".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def odd(rng):
    """Rows that every operator must take: nulls, empty, blank, repeated, very long, and one of a single character."""
    long = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (5, "x"), (None, "a b c"), (None, None), (6, "é" * 50_000)]


# --- packing


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = odd(rng) + [(k, prose(rng, rng.randrange(1, 900)) + " </s> 日本語 <|endoftext|>") for k in range(10, 60)]
    df = docs(spark, rows).withColumn("start", F.lit(1)).repartition(3)
    found = packing.pack(df, block_tokens=20_000).collect()
    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    want = collections.Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for pieces in by.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0
    one = {i: ids for (i, ids) in want if i not in (4, None)}
    for i, ids in one.items():
        got = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
        assert tuple(x for r in got for x in r["ids"]) == ids and all(r["doc_tokens"] == len(ids) for r in got)
    assert sum(r["length"] for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_of_long_runs(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    runs = [" " * 2_000_000, "a" * 2_000_000, "é" * 1_000_000, "\n" * 300_000 + "x", "x" + " \t" * 200_000 + "y", "." * 500_000, "\u3000" * 100_000, "<|endoftext|>" + " " * 30_000 + "</s>"]
    got = packing.pack(docs(spark, list(enumerate(runs))), with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r["doc_id"]: (r["n"], r["d"]) for r in got} == {k: (n, n) for k, t in enumerate(runs) for n in [len(exact.encode(t, add_special_tokens=False).ids) + 1]}
    encode = packing.encoder(path("byte_bpe_50k.json"))
    for length in (packing.LONG_BLANK - 1, packing.LONG_BLANK, packing.LONG_BLANK + 1):
        text = "one" + " " * length + "two </s>"
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    rng = random.Random(25)
    for _ in range(200):  # pieces are cut where tokens end
        text = "".join(rng.choice(["a", "it's", "'s", "'", " ", "  ", "\n", "\t ", " \n", "9", "42", "é", "日本", "!?", " x", "</s>", "\u3000"]) for _ in range(60))
        assert encode(text, rng.randrange(1, 40)).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_pieces_go_to_the_cheapest_sequence():
    """Against a plain search of all sequences, with fractions for costs."""
    from fractions import Fraction

    rng = random.Random(18)
    for _ in range(40):
        capacity = 64
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))]
        placed, cost = packing.assign(lengths, capacity, 1.0, 0.5)
        total = sum(lengths)
        rooms = [capacity] * (total // capacity) + [1 << b for b in range(6, -1, -1) if (total % capacity) >> b & 1]
        costs, used, want = [Fraction(0)] * len(rooms), [0] * len(rooms), []
        for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            start, left = 0, lengths[piece]
            while left:
                able = [k for k in range(len(rooms)) if rooms[k] - used[k] >= left]
                k = min(able, key=lambda k: (costs[k], k)) if able else max(range(len(rooms)), key=lambda k: (rooms[k] - used[k], -k))
                n = min(left, rooms[k] - used[k])
                want.append((piece, start, n, k, used[k]))
                costs[k] += n + Fraction(n * n, 2)
                used[k] += n
                start, left = start + n, left - n
        assert placed == want and used == rooms and [float(c) for c in costs] == cost.tolist()


def test_packing_balances_cost():
    placed, cost = packing.assign([900, 800, 300, 200, 124, 700, 48], 1024, 1.0, 1 / 1024)
    used = collections.Counter()
    for _, _, n, at, offset in placed:
        assert offset == used[at]
        used[at] += n
    assert sorted(used.values()) == [1024, 1024, 1024] and cost.max() < 2048


# --- WARC


def test_warc_round_trip(spark):
    body = "<p>é</p>" * 200
    rows = [(1, "http://a/", body), (2, None, body), (3, "http://c/", body), (4, "http://d/", "short"), (5, "http://e/", "short"), (6, "u", None), (7, "u", ""), (None, "n", body), (8, "x\r\ny", "WARC/1.1\r\n\r\n" * 3), (4, "http://d/", "short")]
    found = warc.page_digests(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ref = 3 if html == body and i != 3 else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if ref else "response", ref, 1, 1))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert warc.page_digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_references_resolve(spark, tmp_path):
    """Every Refers-To and Concurrent-To names a record of the archive, and a Refers-To one with that very payload."""
    body = "<p>é</p>" * 200
    rows = [(k % 7 or None, "u", body if k % 2 else body + str(k % 3)) for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages")
    warc.write_pages(spark.read.parquet(f"{tmp_path}/pages"), f"{tmp_path}/a")
    found = warc.read(spark, f"{tmp_path}/a").collect()
    by = {r["record_id"]: r for r in found}
    assert len(found) == len(by) == 180
    for r in found:
        assert all(by[x]["record_type"] in ("response", "revisit") for x in r["concurrent_to"]) and len(r["concurrent_to"]) == (r["record_type"] in ("request", "metadata"))
        if r["record_type"] == "revisit":
            main = by[r["refers_to"]]
            assert main["record_type"] == "response" and main["payload_digest"] == r["payload_digest"]
        else:
            assert r["refers_to"] is None


def test_warc_assembly(spark):
    rec = lambda i, kind, to=(): (i, kind, "u", list(to), None, None, 0, 0, None, None)
    df = spark.createDataFrame([rec("r", "response"), rec("q", "request", ["r"]), rec("m", "metadata", ["q"]), rec("lost", "metadata", ["gone"]), rec(None, "response"), rec("w", "warcinfo")], warc.RECORDS)
    got = {r["capture_id"]: r for r in warc.assemble(df).collect()}
    assert [x["record_id"] for x in got["r"]["requests"]] == ["q"] and [x["record_id"] for x in got["r"]["metadata"]] == ["m"]
    assert got["gone"]["response"] is None and got[None]["response"] is not None and len(got) == 3


def test_warc_chains_of_any_length_and_either_direction(spark):
    rec = lambda i, kind, to=(): (i, kind, "u", list(to), None, None, 0, 0, None, None)
    rows = [rec("r", "response", ["q"]), rec("q", "request"), rec("m0", "metadata", ["q"])]  # the response names its request
    rows += [rec(f"m{k}", "metadata", [f"m{k - 1}"]) for k in range(1, 7)]
    rows += [rec("v", "revisit"), rec("both", "metadata", ["v", "m6"])]  # part of two captures
    rows += [rec("a", "metadata", ["b"]), rec("b", "metadata", ["a"]), rec("s", "request", ["s"]), rec("n", "request"), rec(None, "request", ["v"])]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows + rows[:3], warc.RECORDS)).collect()}
    name = lambda r, side: [x["record_id"] for x in r[side]]
    assert name(got["r"], "requests") == ["q"] and name(got["r"], "metadata") == ["both", *(f"m{k}" for k in range(7))]
    assert name(got["v"], "metadata") == ["both"] and name(got["s"], "requests") == ["s"] and name(got["n"], "requests") == ["n"]
    assert {x for k in ("a", "b") if k in got for x in name(got[k], "metadata")} == {"a", "b"} and got[None]["response"] is None


def test_warc_parses_member_per_record(spark, tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    raw = gzip.compress(one) + gzip.compress(one.replace(b"<a>", b"<b>"))
    for piece in (1 << 18, 7, 1):
        assert [(r[0], r[-1]) for r in warc.parse(warc.inflated(raw, piece))] == [("<a>", b"abc"), ("<b>", b"abc")]
    rng = random.Random(23)
    want = []
    for name, pack in (("x.warc.gz", lambda parts: b"".join(map(gzip.compress, parts))), ("y.warc", b"".join), ("z.gz", lambda parts: gzip.compress(b"".join(parts)))):
        parts = []
        for k in range(300):  # blocks of line ends in all mixes, and of bytes that are no text
            block = b"".join(rng.choice([b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"WARC/1.0\r\n", b"\xff\x00", b"ab"]) for _ in range(rng.randrange(40)))
            want.append((f"<{name}{k}>", block))
            parts.append(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%s%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name.encode(), k, len(block), block))
        (tmp_path / name).write_bytes(pack(parts))
    for most_whole in (32 << 20, 0):  # whole, and inflated by Spark
        got = warc.read(spark, str(tmp_path), most_whole=most_whole).collect()
        assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == sorted(want)
    assert all(r["payload_digest"] == "sha1:" + hashlib.sha1(bytes(r["payload"])).hexdigest() for r in got)


def test_warc_of_long_pages(spark):
    rows = [(k, "u", chr(97 + k % 3) * 3_000_000) for k in range(6)] + [(9, "u", "\r\n\r\n" * 100_000)]
    got = {r["page_id"]: r for r in warc.page_digests(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: (r["payload_bytes"], r["record_type"], r["refers_to"]) for i, r in got.items()} == {**{k: (3_000_000, "revisit", k + 3) for k in range(3)}, **{k: (3_000_000, "response", None) for k in range(3, 6)}, 9: (400_000, "response", None)}
    assert all(got[i]["payload_digest"] == hashlib.sha1(t.encode()).hexdigest() for i, _, t in rows)


# --- chat


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <|end|>\n <\\|x|> [\\INST]"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, None, None), (2, 1, "assistant", ""), (None, 1, "assistant", "z"), (None, None, "user", "y"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "we\\ird\nrole", "t")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(0))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["rewrites"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), False)


def test_chat_detects_rewriting():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))

    turns = [("user", "hi there"), ("assistant", "well"), ("user", "so")]
    assert chat.locate(last_only, turns)[2] and not chat.locate(chat.turn_tags, turns)[2]

    many = [("user", f"word {k}") for k in range(80)]

    def shortens(turns):  # the first turn loses its text once there are 50
        return "".join(f"[{r}]{t if k or len(turns) < 50 else '...'};" for k, (r, t) in enumerate(turns))

    for segment in (32, None, 1000):
        assert chat.locate(shortens, many, segment)[2] and not chat.locate(chat.turn_tags, many, segment)[2]
    assert chat.locate(chat.turn_tags, many) == chat.locate(chat.turn_tags, many, None)

    def looks_back(turns):  # the first turn shows up in every other one: segments can't render it alone
        return "".join(f"<{r}:{turns[0][1]}>{t};" for r, t in turns)

    text, spans, _ = chat.locate(looks_back, many)
    assert all(text[a:b] == t for (_, _, a, b), (_, t) in zip(spans[1:], many[1:]))  # the first stands in two places


# --- licenses


def test_license_base_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["cc", "by", "CC", "BY", "general", "Public", "license", "all", "rights", "reserved", "ab", "é", "licenseé", "x9"]
    rows = odd(rng) + [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ". ", "", "_"]) for _ in range(60))) for k in range(20, 80)]
    got = license_scan.scan(docs(spark, rows).withColumn("labels", F.lit("x"))).collect()
    assert len(got) == len(rows)

    def brute(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in hits]
        return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    want = sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa-3.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
        ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted", "bsd"),
        ("mit der Zeit und mit Geduld", ""),
    ],
)
def test_license_rules(text, labels):
    assert license_scan._scan(text)[5] == labels


@pytest.mark.parametrize(
    "text, labels",
    [
        ("the GNU General\n * Public License, version 2", "gpl,gpl-2.0"),
        ("Permission is hereby\ngranted, free of charge, to any person obtaining a copy", "mit"),
        ("Creative\n# Commons Attribution 4.0", "cc-by-4.0"),
        ("under the MIT  License", "mit"),
        ("licensed under MIT", "mit"),
        ("GNU Library General Public License", "gpl,lgpl"),
        ("CC 0 1.0", "cc0-1.0"),
    ],
)
def test_license_keywords_across_gaps(text, labels):
    assert license_scan._scan(text)[5] == labels


def test_license_keywords_open_their_rules():
    """Texts made from each rule's own regex, with all kinds of gaps, open that rule."""
    from re import _constants as op
    from re import _parser

    rng = random.Random(13)

    def made(part):
        kind, arg = part
        if kind is op.LITERAL:
            return bytes([arg])
        if kind is op.SUBPATTERN:
            return several(arg[-1])
        if kind is op.BRANCH:
            return several(rng.choice(arg[1]))
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            if most == op.MAXREPEAT:
                return rng.choice([b" ", b"\n * ", b"  ", b"-", b"_", b"\n\n", b"/"])
            return b"".join(several(inner) for _ in range(rng.randint(least, min(most, 3))))
        if kind is op.IN:
            if arg[0][0] is op.CATEGORY:
                return b"7"
            return bytes([rng.choice([x for name, x in arg if name is op.LITERAL])])
        assert kind in (op.ANY, op.ASSERT, op.ASSERT_NOT), kind
        return b"z" if kind is op.ANY else b""

    def several(parts):
        return b"".join(map(made, parts))

    automaton, ordered = license_scan._gate()
    tried, closed = 0, []
    for n, rule in enumerate(ordered):
        for _ in range(40):
            text = several(_parser.parse(rule.pattern.pattern, rule.pattern.flags))
            if rule.pattern.search(text):
                tried += 1
                if not any(n in numbers for _, (_, numbers) in automaton.iter(license_scan.spaced(text))):
                    closed.append((rule.name, text))
    assert not closed
    assert tried > 30 * len(ordered)


def test_license_detections_against_brute_force():
    rng = random.Random(17)
    phrases = ["GNU General Public License, version 2", "the GNU Lesser General Public License", "Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0", "cc by", "Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "All rights reserved", "Copyright (c) 2020", "the MIT License", "BSD 3-Clause", "mit", "é"]
    _, ordered = license_scan._gate()
    kept = 0
    for _ in range(60):
        text = "".join(rng.choice(phrases) + rng.choice([" ", "\n# ", ", ", "  "]) for _ in range(rng.randrange(1, 25)))
        raw = text.lower().encode()
        found = [(m.start(), m.end(), rule.priority, n) for n, rule in enumerate(ordered) for m in rule.pattern.finditer(raw)]

        def gone(s, e, p, n):
            return any(a <= s and e <= b and (q < p or q == p and ((a, b) != (s, e) or k < n)) for a, b, q, k in found if (a, b, q, k) != (s, e, p, n))

        want = sorted((s, e, ordered[n].name) for s, e, p, n in found if not gone(s, e, p, n))
        assert sorted((s, e, r.name) for s, e, r in license_scan.detect(raw)) == want
        spans = license_scan._scan(text)[7]
        assert sorted((x["start"], x["end"], x["rule"]) for x in spans) == sorted((len(raw[:s].decode()), len(raw[:e].decode()), name) for s, e, name in want)
        assert license_scan._scan(text)[5] == ",".join(sorted({label for label, phrase, pattern in license_scan._BASE if pattern.search(raw)} | {r.label for _, _, r in license_scan.detect(raw)}))
        kept += len(want)
    assert kept > 300


def test_license_scan_is_linear():
    """Runs of gaps between a rule's words, and very many detections in one text."""
    for start in ("creative commons attribution", "gnu general public license", "mozilla public license", "copyright", "mulan psl", "licensed under the"):
        for gap in (" ", "-", ". "):
            license_scan._scan(start + gap * 500_000 + "x")
    many = "é the MIT License. " * 30_000
    spans = license_scan._scan(many)[7]
    assert len(spans) == 30_000 and many[spans[-1]["start"] : spans[-1]["end"]] == "the MIT License"


def test_license_rules_are_many():
    assert len(license_scan.rules()) > 200


# --- language


def test_language(spark):
    rng = random.Random(4)
    make = {"aa": "salto perro gato luna sol".split(), "bb": "hund katze mond sonne haus".split()}
    rows = [(k, prose(rng, 40, make[lang]).translate(str.maketrans("", "", "0123456789")), lang, "s") for k in range(300) for lang in [rng.choice("ab") * 2]]
    df = docs(spark, rows + [(900, None, "aa", "s"), (901, "12 ?!", "aa", "s"), (902, "", None, None)])
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fitted(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    kept = langid.kept_documents(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, *_ in rows}
    none = docs(spark, [(1, "abc", None, None)])
    assert langid.identify(none, langid.Model(["aa"], np.zeros((1 << 16, 1), np.float32), np.zeros(1), 1.0, 0.0, 16)).first()["lang_pred"] == "aa"


def test_subwords_stay_within_words():
    assert langid.code_points("Ab-c ").tolist() == [0, 97, 98, 0, 99, 0]
    assert langid.code_points("12").size == 0
    assert len(langid.subwords(langid.code_points("ab"), 16)) == 3 + 2 + 1


def test_language_without_labels(spark):
    """No label at all, labels in the held-out fold alone, an empty table."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    for rows in ([(1, "abc def", None, None), (2, None, None, None), (3, "12", None, None), (None, "x y", None, None)], [(held, "abc def", "en", None)], []):
        df = docs(spark, rows)
        model = langid.fitted(df)
        got = langid.identify(df, model).collect()
        assert len(got) == len(rows) and all((r["lang_pred"], r["score"]) == ("und", 0.0) and r["rejected"] == (r["text"] in (None, "12")) for r in got)
        assert langid.kept_documents(df).count() == sum(t not in (None, "12") for _, t, *_ in rows)
    assert langid.sample(docs(spark, [(1, "abc", None, None)])) == ([], [])


def test_language_sample_behind_a_hot_text(spark):
    rng = random.Random(19)
    rows = [(k, "uno dos tres", "es", "s") for k in range(4000)] + [(5000 + k, prose(rng, 12), "de", "s") for k in range(4000)] + [(9999, "rare one", "nl", "s")]
    df = docs(spark, rows).repartition(3)
    texts, langs = langid.sample(df, per_language=50)
    assert collections.Counter(langs) == {"es": 1, "de": 50, "nl": 1} and len(set(texts)) == 52
    assert langid.sample(df.coalesce(1), per_language=50) == (texts, langs)
    assert set(langid.sample(df, per_language=50, most_languages=2)[1]) < {"es", "de", "nl"}


def test_language_scores_against_brute_force():
    """The averaged embedding of all subwords, one by one, under the linear layer, for short and long texts and very odd ones."""
    rng = random.Random(20)
    texts, langs = zip(*((prose(rng, 30, w), lang) for _ in range(60) for lang, w in (("aa", "salto perro gato".split()), ("bb", "hund katze mond".split()))))
    model = langid.train(list(texts), list(langs), epochs=3, bits=12)
    assert sum(model.predict(t)[0] == lang for t, lang in zip(texts, langs)) == len(texts)
    for text in ["perro", "Hund, GATO! 日本 \U0001d51e", "x" * 5000, prose(rng, 20_000), "é", texts[0] + "\n" * 3 + texts[1]]:
        low = [c if c.isalpha() else " " for c in text.lower()]
        points = [0]
        for c in low:
            if c != " " or points[-1] != 0:
                points.append(0 if c == " " else ord(c))
        points += [0] * (points[-1] != 0)
        found = [langid.subwords(np.array(points[k : k + n], np.uint32), 12, (n,)) for n in (2, 3, 4) for k in range(len(points) - n + 1)]
        total = sum(model.table[x.astype(int)].sum(axis=0, dtype=np.float64) for x in found)
        n = sum(map(len, found))
        for piece in (1 << 18, 64):
            if piece > 64 or " " in text:
                assert np.allclose(model.logits(text, piece), total / n + model.bias, atol=1e-6)
    assert model.logits("1 2 3" * 100, 64) is None and model.logits("x" * 500, 64) is not None


def test_language_of_odd_rows(spark):
    rng = random.Random(22)
    rows = odd(rng) + [(k, prose(rng, 20), "en" if k % 2 else None, None) for k in range(20, 60)]
    df = docs(spark, rows).withColumn("score", F.lit("x"))
    got = langid.identify(df, langid.fitted(df)).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in got)
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got if r["doc_id"] == 1 or r["text"] in ("", " \n\t ")} == {("und", 0.0, True)}


# --- quality


def brute_quality(text):
    words, text = WORDS.findall(text or ""), text or ""
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + o for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_features(spark):
    rng = random.Random(5)
    rows = odd(rng) + [(k, " ".join(rng.choice("abcd|") for _ in range(rng.randrange(90))) + "\n x\n x") for k in range(20, 70)] + [(99, "a a a a"), (98, "a b a b"), (97, "a a a")]
    got = quality.judged(docs(spark, rows).withColumn("n_words", F.lit(-1))).collect()
    want = sorted(((i, *brute_quality(t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=repr) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.judged(docs(spark, [])).count() == 0


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 120), "en", f"s{k % 2}") for k in range(300)] + [(k, " | ".join(prose(rng, 120).split()), "en", "s1") for k in range(900, 910)] + [(950, prose(rng, 90), None, None)]
    df = docs(spark, rows).withColumn("kept", F.lit(7))
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows if not 900 <= i < 910}


def test_quality_of_very_many_words(spark):
    rng = random.Random(8)
    long = " ".join(f"{rng.getrandbits(60):x}" for _ in range(1 << 20)) + " p q r p q r"
    assert quality.text_features(docs(spark, [(1, long)])).first()["n_repeat_words"] == 6


def test_repeats_do_not_depend_on_the_hash(spark):
    """With a hash of a few values nearly all windows collide; the words decide."""
    rng = random.Random(16)
    rows = odd(rng) + [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200)))) for k in range(20, 80)]
    rows = [(i, t and t[:3000]) for i, t in rows]
    for hashed in ("1L", "cast(length(_words[i]) % 3 AS bigint)", "xxhash64(_words[i]) % 5", "-1L"):
        got = quality.text_features(docs(spark, rows), hashed=hashed).collect()
        assert sorted(((r["doc_id"], r["n_repeat_words"]) for r in got), key=repr) == sorted(((i, brute_quality(t)[4]) for i, t in rows), key=repr)


def test_sketches_merge(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("lang"), (F.col("id") % 5).alias("source"), *(F.lit(0).cast("long").alias(c) for c in quality.FEATURES)).withColumn("n_words", F.lit(100).cast("long")).withColumn("n_symbols", F.col("source") * 100).withColumn("n_lines", F.lit(1).cast("long")).withColumn("word_chars", F.lit(500).cast("long"))
    whole, parts = quality.sketch(df, ["lang"]), quality.merged(quality.sketch(df, ["lang", "source"]), ["lang"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


# --- near duplicates


def jaccard(a, b):
    bag = lambda t: collections.Counter(tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4)))
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def classes_of(rows, threshold=0.8):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1 :]:
            if jaccard(a, b) >= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, 120).split()
        chain = list(base)
        for _ in range(8):  # each a few words further from the first
            rows.append((n, " ".join(chain)))
            n += 1
            for _ in range(rng.randrange(0, 4)):
                chain[rng.randrange(len(chain))] = f"w{rng.getrandbits(30)}"
    rows += [(1000, "tiny"), (1001, "Tiny"), (1002, "a b c"), (1003, rows[0][1])]
    got = neardup.near_duplicates(docs(spark, rows).withColumn("class_id", F.lit(0))).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_of(rows)
    for r in got:  # links hold classes of several texts together, and are as similar as they say
        others = [jaccard(dict(rows)[r["doc_id"]], t) for _, t in rows if jaccard(dict(rows)[r["doc_id"]], t) < 1]
        assert (r["n_links"] > 0) == (r["class_size"] > r["n_copies"]) == (r["similarity"] is not None)
        assert r["similarity"] is None or 0.8 <= r["similarity"] < 1 and min(abs(r["similarity"] - x) for x in others) < 1e-9
        assert r["n_links"] <= sum(x >= 0.8 for x in others)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd(random.Random(8))
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r["class_size"] for r in got if r["doc_id"] == 4] == [2, 2] and all(r["class_size"] == 1 for r in got if r["doc_id"] in (1, 2, 3, 5))
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    kept = neardup.kept_documents(docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


@pytest.mark.parametrize("most_broadcast", [64 << 20, 0])
def test_kept_rows_of_repeated_and_null_ids(spark, most_broadcast):
    rng = random.Random(14)
    a, b, c, d, e, f = (prose(rng, 40) for _ in range(6))
    rows = [(7, a), (7, a), (7, a)]  # repeated rows: one stays
    rows += [(1, b), (None, b + " more"), (None, c)]  # a null id among others: only the copy goes
    rows += [(3, d), (9, d), (9, e)]  # an id with two texts: only the copy goes
    rows += [(None, f), (None, f)]  # null ids only: one stays
    rows += [(20, None), (20, None), (None, ""), (None, "")]  # without words: all stay
    df = docs(spark, rows).withColumn("_row", F.lit("own")).repartition(3)
    kept = neardup.kept_documents(df, most_broadcast=most_broadcast)
    assert kept.columns == df.columns and {r["_row"] for r in kept.collect()} == {"own"}
    want = [(7, a), (1, b), (None, c), (3, d), (9, e), (None, f), (20, None), (20, None), (None, ""), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert neardup.kept_documents(docs(spark, []), most_broadcast=most_broadcast).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(20):
        keys = rng.integers(1, 2**62, 200).astype(np.uint64)
        keys.sort()
        a, b = rng.choice([1, 1, 2, 3, 40], 200), rng.choice([1, 1, 2, 5, 33], 200)
        s = neardup.signatures([(keys, a), (keys, b)], 512)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.035


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in range(100, 140)} == {100}


def test_tables_go_with_their_scope(spark):
    import os

    def there(df):
        return os.path.exists(df._saved_at.removeprefix("file:"))

    with common.scratch():
        outer = common.saved(spark.range(3), "outer")
        with common.scratch():
            inner, kept = common.saved(spark.range(3), "inner"), common.saved(spark.range(3), "kept", outlive=True)
            assert there(inner) and there(kept)
        assert not there(inner) and there(kept) and kept.count() == 3
    assert not there(outer) and not there(kept)
    assert there(common.saved(spark.range(3), "free"))


def test_broadcasts_are_of_measured_bytes(spark):
    df = spark.range(1000).select("id", F.sequence(F.lit(0), F.lit(99)).alias("a"), F.create_map(F.lit("k"), F.struct(F.lit("text" * 10))).alias("m"), F.lit(None).cast("string").alias("n"))
    assert 800_000 < common.weight(df) < 1_200_000 and common.weight(df.limit(0)) == 0
    plan = lambda most: df.join(common.small(spark.range(500), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1 << 20) and "strategy=broadcast" not in plan(100)


# --- decontamination


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.choice([3, 5, 8, 20, 60, 200]))) for k in range(40)] + [(90, None), (91, ""), (92, "!!")]
    rows = odd(rng)
    for k in range(100, 160):
        own = rng.choice(items[:40])[1].split()
        if rng.random() < 0.4 and len(own) > 10:
            own[rng.randrange(len(own))] = "changed"
        rows.append((k, prose(rng, rng.randrange(0, 400)) + " " + " ".join(own).upper() + "!\n" + prose(rng, 30)))
    norm = lambda t: [w for w in (re.sub(r"[^\w]|_", "", x) for x in WORDS.findall((t or "").lower())) if w]
    want = set()
    for d, t in rows:
        w = norm(t)
        for i, s in items:
            x = norm(s)
            k = min(5, len(x))
            if k:
                own = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)}
                if len(own & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}) / len(own) >= 0.8:
                    want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs(spark, rows).withColumn("item_id", F.lit(0)), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 40
    joined = decontaminate.leaks(docs(spark, rows), bench, most_broadcast=0)
    assert {(r["doc_id"], r["item_id"]) for r in joined.collect()} == want
    clean = decontaminate.clean_documents(docs(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("most_broadcast", [64 << 20, 0])
def test_leaks_of_repeated_and_null_items(spark, most_broadcast):
    rng = random.Random(15)
    a, b, c, d, e, f = (prose(rng, 44) for _ in range(6))
    items = [(1, a)] * 3 + [(None, b), (None, c), (None, c)] + [(2, d), (2, e)] + [(3, "one two three"), (3, f)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    part = " ".join(a.split()[:20])  # 16 of 40 shingles
    rows = [(10, a), (11, part), (12, b), (13, c), (14, d), (15, d + " " + e), (16, f + " one two three"), (None, a), (17, None)]
    found = decontaminate.leaks(docs(spark, rows), bench, most_broadcast=most_broadcast).collect()
    want = [(10, 1), (12, None), (13, None), (15, 2), (16, 3), (None, 1)]
    assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r["n_shared"] == r["n_item"] and r["containment"] == 1.0 for r in found)
    assert {r["n_item"] for r in found if r["item_id"] == 2} == {80} and {r["n_item"] for r in found if r["item_id"] == 3} == {41}
    clean = decontaminate.clean_documents(docs(spark, rows), bench, most_broadcast=most_broadcast)
    assert {r["doc_id"] for r in clean.collect()} == {11, 14, 17}


# --- class model


def test_class_scores_against_brute_force(spark):
    rng = random.Random(10)
    rows = odd(rng) + [(k, prose(rng, rng.randrange(0, 200)).replace("the", "THE")) for k in range(10, 60)]
    got = classlm.score(docs(spark, rows).withColumn("score", F.lit(0)), classes=8, forms=16, share=5e-3, frequent=1e-2, rounds=3).collect()
    tokens = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows]
    tokens = [(i, [*WORDS.findall(t), None]) for i, t in tokens]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(w for i, ws in tokens for w in ws if not held(i))
    total, distinct = sum(count.values()), len(count)
    want = sorted(((i, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 5)) for i, ws in tokens), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=repr) == want
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)
    assert classlm.score(docs(spark, [])).count() == 0


def test_exchange_over_tables_equals_one_in_memory(spark):
    """Moves worked out where profiles are, and coarse bigrams, against dense matrices; the likelihood never falls."""
    rng = np.random.default_rng(3)
    units, classes = 40, 5
    sequence = rng.integers(0, units, 4000) // rng.integers(1, 4, 4000)
    full = np.zeros((units, units))
    np.add.at(full, (sequence, np.roll(sequence, -1)), 1)
    rows = [(int(u), int(v), int(full[u, v])) for u, v in zip(*full.nonzero())]
    bigrams = spark.createDataFrame(rows, "u int, v int, n long").repartition(4)
    of, pairs, history = classlm.exchange(bigrams, units, classes, 10)
    one = np.eye(classes)[of]
    assert (pairs == one.T @ full @ one).all() and history == sorted(history) and abs(history[-1] - classlm.likelihood(pairs)) < 1e-9
    start = np.arange(units) % classes
    again, _, later = classlm.exchange(bigrams, units, classes, 10, start=of)
    assert later[0] == history[-1] and len(later) <= 2
    profiles, counted = classlm._profiles(bigrams, start, classes)
    to, gain = classlm._moves(profiles, start, np.diagonal(full).copy(), counted)
    one = np.eye(classes)[start]
    want = classlm.best_moves(start, full @ one, full.T @ one, np.diagonal(full), one.T @ full @ one)
    assert (to == want[0]).all() and np.allclose(gain, want[1])
    group = rng.integers(0, 7, units)
    got = {(r["u"], r["v"]): r["n"] for r in classlm.coarse(bigrams, group).collect()}
    half = np.eye(7)[group]
    assert got == {(u, v): n for (u, v), n in np.ndenumerate(half.T @ full @ half) if n}


def test_class_scores_are_the_models(spark):
    """Scores against the model's formula from its own classes, token by token, and held-out text better than by single words."""
    rng = random.Random(24)
    a, b = [[f"{x}{k}" for k in range(40)] for x in "ab"]
    rows = [(k, " ".join(rng.choice(a if j % 2 else b) for j in range(120))) for k in range(120)]
    kept = {}
    plain = classlm._scored
    classlm._scored = lambda docs, scorer: kept.setdefault("scorer", scorer) and plain(docs, scorer)
    try:
        got = {r["doc_id"]: r for r in classlm.score(docs(spark, rows), classes=4, forms=8, share=2e-3, frequent=1e-2).collect()}
    finally:
        classlm._scored = plain
    scorer = kept["scorer"]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for t in train for w in t.split())
    tokens = classlm.Tokens(8)
    for i, text in rows[:20]:
        parts = list(tokens.of([text.encode()]))
        hashes, form = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        unit, _ = scorer.units.of(hashes, form)
        cls, last, total = scorer.of[unit], scorer.of[scorer.units.end()], 0.0
        for c, w in zip(cls, [*text.split(), None]):
            n = count[w] if w else len(train)
            total += scorer.step[last, c] + math.log10(n + 0.5) - scorer.mass[c]
            last = c
        assert abs(total - got[i]["score"]) < 1e-6
        assert abs(got[i]["perplexity"] - 10 ** (-total / (len(cls)))) < 1e-6
    assert np.allclose((10**scorer.step).sum(1), 1, atol=1e-6)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_exchange_moves_gain_what_they_say():
    rng = np.random.default_rng(1)
    units, classes = 12, 4
    sequence = rng.integers(0, units, 3000)
    full = np.zeros((units, units))
    np.add.at(full, (sequence, np.roll(sequence, -1)), 1)
    of = np.arange(units) % classes
    one = np.eye(classes)[of]

    def pairs(o):
        m = np.eye(classes)[o]
        return m.T @ full @ m

    to, gain = classlm.best_moves(of, full @ one, full.T @ one, np.diagonal(full), pairs(of))
    for u in range(units):
        each = []
        for b in range(classes):
            moved = of.copy()
            moved[u] = b
            each.append(classlm.likelihood(pairs(moved)))
        assert to[u] == int(np.argmax(each)) or abs(max(each) - each[to[u]]) < 1e-6
        assert abs(gain[u] - (max(each) - each[of[u]])) < 1e-6


def test_tokens_in_pieces_agree():
    rng = random.Random(11)
    texts = [prose(rng, 500).encode(), b"", b"  ", b"one", prose(rng, 3000).encode(), b" x" * 400]

    def whole(piece):
        counts, parts = np.zeros(len(texts), np.int64), []
        for first, hashes, form, n in classlm.Tokens(64, piece).of(texts):
            counts[first : first + len(n)] += n
            assert len(hashes) == len(form) == n.sum()
            parts.append((hashes, form))
        return counts.tolist(), *(np.concatenate(x).tolist() for x in zip(*parts))

    assert whole(1 << 20) == whole(100) and whole(7)[0] == [501, 1, 1, 2, 3001, 401]
    forms = whole(1 << 20)[2][501 + 1 + 1 + 2 + 3001 :]
    assert len(set(forms[:400])) == 1 and forms[0] != classlm.END_FORM and forms[400] == classlm.END_FORM


def test_words_of_constructed_texts_differ():
    """Thue-Morse words collide under any polynomial hash modulo a power of two."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    (_, hashes, _, _), = classlm.Tokens(64).of([f"{a} {b}".encode()])
    assert hashes[0] != hashes[1]


# --- HTML


def test_html_reader():
    page = Page("<p>a&amp;b<b>c<br>d<p>e<script>x='</p>'</script><ul><li>f<li>g</ul>h<!-- no --><table><tr><td>i<td>j</table>")
    assert page.text(np.array([t != "script" for t in page.tags])) == "a&bc d\n\ne\n\nf\n\ng\n\nh\n\ni\n\nj"
    for source in ("", "<", "<<<>>>", "<p", '<a href="x', "</p></p>", "&#xfffff;&bogus;", "<script>", "<!-- "):
        page = Page(source)
        assert features(page).shape[0] == len(page.tags)


def test_boosting_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500], trees=30, depth=3)
    assert ((model.scores(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_html_extraction(spark):
    rng = random.Random(12)
    made = []
    for k in range(60):
        text = [prose(rng, rng.randrange(3, 60)) for _ in range(3)]
        body = "".join(f"<p>{t} &amp; <b>more</b></p>" for t in text)
        made.append((k, "u", f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>menu {k}</a></li></ul></nav><div class='cookie-notice'>we use</div><article><h1>Head {k}</h1>{body}<div class='comments'><p>{prose(rng, 20)}</p></div></article><aside class='sidebar'><p>{prose(rng, 30)}</p></aside><footer>&copy; x</footer></body></html>", "\n\n".join([f"Head {k}", *(f"{t} & more" for t in text)])))
    pages = spark.createDataFrame([m[:3] for m in made] + [(99, None, None), (98, "x", "")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert all(got[k]["text"] == want and got[k]["n_chars"] == len(want) for k, _, _, want in made)
    assert got[99]["text"] == "" and got[98]["text"] == "" and got[99]["n_chars"] == 0


def test_html_of_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "<p>in</p>" + "</div>" * 100_000
    pages = [deep, "<p>" * 100_000, "<b>" * 50_000 + "x" + "</i>" * 50_000, "<ul><li>" * 30_000 + "y", "<table><tr><td>" * 20_000 + "z", "<a '>" * 50_000, "</script " * 50_000, "<script>" + "</script " * 50_000, "<a b=" + " " * 300_000 + ">t</a>", "text " * 200_000]
    rows = [(k, "u", html) for k, html in enumerate(pages)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and len({(r["page_id"], r["text"]) for r in got}) == len(pages)
    page = Page(deep)
    assert max(page.depths) == 100_001 and page.text(np.ones(len(page.tags), bool)) == "in"


def test_html_reader_ends_what_it_must():
    """Implied ends reach as far as the limits between."""
    shown = lambda source: Page(source).text(np.ones(len(Page(source).tags), bool))
    depth = lambda source, tag: [Page(source).depths[k] for k, t in enumerate(Page(source).tags) if t == tag]
    assert depth("<p>a<p>b", "p") == [1, 1] and depth("<p><button><p>b", "p") == [1, 3]
    assert depth("<ul><li>a<ul><li>b</ul><li>c</ul>", "li") == [2, 4, 2]
    assert depth("<table><tr><td>a<table><tr><td>b</table><td>c<tr><td>d</table>", "tr") == [2, 5, 2]
    assert depth("<div><table><tr><td></div><p>x", "p") == [5] and shown("a</div></p>b<br/>c") == "ab c"


def test_html_of_an_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_keeps_no_child_of_a_dropped_element():
    page = Page("<div><p>one</p><p>two</p></div><p>three</p>")
    for seed in range(20):
        keep = html_extract.decode(page, np.random.default_rng(seed).normal(size=len(page.tags)), html_extract._weights(page))
        assert all(keep[page.parents[k]] for k in range(1, len(page.tags)) if keep[k])
