"""The registered query of each operator, over its whole table, and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classlm, decontaminate, html_extract, langid, license_scan, neardup, packing, quality, warc
from .common import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(table(spark, sf_dir, "pages"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(talks.unionByName(own)))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fitted(docs), keep=["doc_id"])
    return found.select("doc_id", (langid.fold(found, 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("outside", ",").alias("outside"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op6_near_duplicates``."""
    return op6_near_duplicates(spark, sf_dir).drop("n_links", "similarity")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op4_licenses``."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def packing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op9_packing``: each document's pieces, and sequences without gaps or padding."""
    pieces = saved(op9_packing(spark, sf_dir), "pieces")  # both sides of the join read them, and would each encode every text
    ends = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("starts"), F.count("*").alias("pieces"))
    good = ends.select("sequence_id", ((F.col("n") == F.col("end")) & (F.col("starts") == F.col("pieces")) & (F.col("n") <= 1024) & (F.bit_count("n") == 1)).alias("full"))
    whole = (F.sum("length") == F.sum_distinct("doc_tokens") * F.count_if(F.col("start") == 0)) & (F.min("start") == 0) & (F.max(F.col("start") + F.col("length")) == F.max("doc_tokens"))
    return pieces.join(good, "sequence_id").groupBy("doc_id").agg(whole.alias("covered"), F.bool_and("full").alias("sequences_full"), F.count_if(F.col("start") == 0).alias("n_rows"))


QUERIES = {"op1_warc": op1_warc, "op2_class_lm": op2_class_lm, "op3_chat": op3_chat, "op4_licenses": op4_licenses, "op5_language": op5_language, "op6_near_duplicates": op6_near_duplicates, "op7_decontamination": op7_decontamination, "op8_quality": op8_quality, "op9_packing": op9_packing, "op10_html": op10_html, "near_duplicate_classes": near_duplicate_classes, "license_phrases": license_phrases, "packing_coverage": packing_coverage}

ORACLES = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), r AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to,
               1::BIGINT AS n_requests, 1::BIGINT AS n_metadata
        FROM p LEFT JOIN r USING (payload_digest)
    """,
    # a backslash goes behind the first character of each control string, of those that hold some as well
    "op3_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (SELECT *, '<\\*\||\|\\*>|<\\*/s>|<\\*s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*start_of_turn>|<\\*end_of_turn>' AS p, replace(replace(role, '\', '\\'), chr(10), '\n') AS name FROM c),
        t AS (SELECT *, length(text) + len(regexp_extract_all(text, p)) AS text_chars, length(name) + len(regexp_extract_all(name, p)) AS name_chars FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(8 + name_chars + 1 + text_chars + 8)::BIGINT AS formatted_chars, false AS rewrites
        FROM t GROUP BY conv_id
    """,
    "license_phrases": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT r, i - 1 AS place, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        b AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN b USING (r)
    """,
    "near_duplicate_classes": r"""
        WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT r, s, count(*) AS c FROM (SELECT r, array_to_string(w[i:i + 4], chr(10)) AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY 1, 2),
        bag AS (SELECT r, sum(c) AS n, md5(string_agg(s || c, chr(11) ORDER BY s)) AS bag FROM g GROUP BY 1),
        node AS (SELECT bag, min(r) AS node, any_value(n) AS n FROM bag GROUP BY 1),
        h AS (SELECT g.r AS node, s, c FROM g JOIN node ON node.node = g.r),
        l AS (SELECT a.node AS u, b.node AS v, sum(least(a.c, b.c)) AS shared FROM h a JOIN h b ON a.s = b.s AND a.node <> b.node GROUP BY 1, 2),
        e AS (SELECT u, v FROM l JOIN node x ON x.node = u JOIN node y ON y.node = v WHERE shared >= 0.8 / 1.8 * (x.n + y.n) - 1e-9),
        reach AS (SELECT node, node AS root FROM node UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node),
        comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
        m AS (SELECT d.doc_id, bag.bag, comp.root FROM d JOIN bag USING (r) JOIN node USING (bag) JOIN comp ON comp.node = node.node)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size, count(*) OVER (PARTITION BY bag) AS n_copies FROM m
        UNION ALL SELECT doc_id, doc_id, 1, 1 FROM d WHERE len(w) = 0
    """,
    # no tokens in SQL: every document must be covered by its pieces, and every sequence be full
    "packing_coverage": "SELECT doc_id, true AS covered, true AS sequences_full, count(*) AS n_rows FROM documents GROUP BY doc_id",
    "op8_quality": r"""
        WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
        w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        p AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1),
        rep AS (SELECT r, count(DISTINCT i + o) AS n FROM g, range(3) AS s(o) GROUP BY r),
        f AS (
            SELECT d.*, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
                   (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
                   (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals, (length(t) - length(translate(t, '!', '')))::BIGINT AS n_marks
            FROM d JOIN w USING (r) LEFT JOIN rep USING (r)
        ), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
        m AS (
            SELECT r, lang, source, metric, v, greatest(length(bin(v)) - 6, 0)::INT AS s FROM (
                SELECT r, lang, source, unnest(['symbols', 'word_length', 'repeats', 'dup_lines', 'capitals', 'marks']) AS metric,
                       unnest([1000 * n_symbols // n_words, 1000 * word_chars // n_words, 1000 * n_repeat_words // n_words, 1000 * n_dup_lines // n_lines, 1000 * n_capitals // word_chars, 1000 * n_marks // n_words]) AS v
                FROM b WHERE NOT base_failed)
        ), k AS (SELECT r, lang, source, metric, (v >> s) << s AS bucket FROM m),
        floors AS (SELECT unnest(['symbols', 'word_length', 'repeats', 'dup_lines', 'capitals', 'marks']) AS metric, unnest([150, 900, 300, 500, 150, 150]) AS least),
        q1 AS (SELECT lang, source, metric, count(*) AS rows, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM k GROUP BY ALL),
        q2 AS (SELECT lang, metric, count(*) AS rows, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM k GROUP BY ALL),
        q3 AS (SELECT metric, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM k GROUP BY ALL),
        c AS (
            SELECT q1.lang, q1.source, q1.metric, least,
                   CASE WHEN q1.rows >= 100 THEN q1.q1 WHEN q2.rows >= 100 THEN q2.q1 ELSE q3.q1 END AS a, CASE WHEN q1.rows >= 100 THEN q1.q3 WHEN q2.rows >= 100 THEN q2.q3 ELSE q3.q3 END AS z
            FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.metric = q2.metric JOIN q3 ON q1.metric = q3.metric JOIN floors ON floors.metric = q1.metric
        ), o AS (
            SELECT r, string_agg(k.metric, ',' ORDER BY list_position(['symbols', 'word_length', 'repeats', 'dup_lines', 'capitals', 'marks'], k.metric)) AS outside
            FROM k JOIN c ON k.lang IS NOT DISTINCT FROM c.lang AND k.source IS NOT DISTINCT FROM c.source AND k.metric = c.metric
            WHERE bucket < a - greatest(4 * (z - a), least) OR bucket > z + greatest(4 * (z - a), least) GROUP BY r
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside IS NULL AS kept, coalesce(outside, '') AS outside
        FROM b LEFT JOIN o USING (r)
    """,
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bs),
        ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        n AS (SELECT item_id, count(*)::INT AS n_item FROM bs GROUP BY 1)
        SELECT doc_id, item_id, count(*)::INT AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
        FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*)::DOUBLE / n_item >= 0.8
    """,
    # for pages as these tables have them: blocks of an article element, with few kinds of references
    "op10_html": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
        b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(h1|p)>'),
                     lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))),
                     lambda x: x <> '') AS b FROM a)
        SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text, length(array_to_string(b, chr(10) || chr(10)))::BIGINT AS n_chars FROM b
    """,
}
