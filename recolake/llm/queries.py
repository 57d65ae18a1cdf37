"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import (ann, exact_dedup, language_id, license_scan, line_dedup, mixing, ngram_join, prefix_trie, quality, sentencepiece_codec,
               spelling, token_output, warc)
from .common import documents, scratch_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_dedup.line_decisions(docs, line_dedup.new_index(docs))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(table, table.filter("vec_id % 50 = 0"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op4_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.token_digests(spark, path)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_decisions(documents(spark, sf_dir))


def op7_source_mixing_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document belongs to its source and to its language: the flow decides which of the two its words count for."""
    docs = documents(spark, sf_dir)
    sources = F.array_compact(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")))
    return mixing.mix_overlapping(docs.withColumn("source", sources)).withColumn("sources", F.concat_ws(",", "sources"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), license_scan.templates(spark), short=license_scan.short_templates(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_predictions(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0), f"{path}/monolithic")
    return warc.page_table(warc.read_records(warc.normalise(spark, f"{path}/monolithic", path)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(spelling.slipped_runs(documents(spark, sf_dir), every=31, least=7), least=2)
    return spelling.variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return prefix_trie.trie(prefix_trie.grafted(own, F.col("conv_id") - F.col("conv_id") % 5, head, longest=8))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_nearest_neighbours, op3_exact_dedup, op4_ngram_jaccard_join, op4_ngram_jaccard_links, op5_token_output,
                               op6_sentencepiece, op7_source_mixing, op7_source_mixing_overlapping, op8_quality_classifier, op9_license_scan,
                               op10_language_id, op11_warc, op12_spelling_variants, op13_prefix_trie)}

OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
heavy AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone
  FROM keyed k LEFT JOIN heavy h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id
"""

# the same with the number of links
OP4_LINKS_SQL = OP4_SQL.replace("AS component_id\n", "AS component_id,\n       coalesce(any_value(k.n_links), 0) AS n_links\n").replace(
    "\nGROUP BY d.doc_id\n", "\n  LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = d.doc_id\nGROUP BY d.doc_id\n")

# crc32 over the UTF-8 bytes of a text column: the table from its rule, then a byte at a time
CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(strlen({text})), lambda k: "
            f"('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS marked, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {_crc('marked')} AS h FROM counted, crc_table),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY ALL),
v AS MATERIALIZED (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
cut AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM v, (SELECT unnest(range(0, (SELECT max(length(word)) FROM v))) AS p)
  WHERE p < length(word)),
near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
form AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n,
         CASE WHEN top >= 10 * v.n THEN (SELECT min(o.other) FROM near o WHERE o.word = v.word AND o.other_n = top) END AS form
  FROM v LEFT JOIN best ON best.word = v.word),
chain(word, last_form, step) AS (
  SELECT word, word, 0 FROM form UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN form f ON f.word = c.last_form WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM form f JOIN (SELECT word, arg_max(last_form, step) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""

OP13_SQL = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list(turn_id ORDER BY turn NULLS FIRST, turn_id) AS steps, list(size ORDER BY turn NULLS FIRST, turn_id) AS sizes
  FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id,
               strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
marked AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc('conv_id::VARCHAR')} % 9 AS h, steps, sizes FROM own, crc_table),
whole AS (
  SELECT m.conv_id, coalesce(b.steps[1:m.h], []) || m.steps[m.h + 1:] AS steps, coalesce(b.sizes[1:m.h], []) || m.sizes[m.h + 1:] AS sizes
  FROM marked m LEFT JOIN own b ON b.conv_id = m.base),
prefixes AS MATERIALIZED (
  SELECT conv_id, d AS depth, array_to_string(steps[1:d], '') AS node, array_to_string(steps[1:d - 1], '') AS parent,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(steps) AS ends
  FROM whole, (SELECT unnest(range(0, (SELECT max(len(steps)) + 1 FROM whole))) AS d) WHERE d <= len(steps)),
nodes AS MATERIALIZED (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (
  SELECT p.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens
  FROM nodes u LEFT JOIN kids k ON k.parent = u.node JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes a ON a.node = n.parent AND n.depth > 0 LEFT JOIN kids k ON k.parent = n.node JOIN below b ON b.node = n.node
"""

ORACLES = {"op1_line_dedup": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op4_ngram_jaccard_links": OP4_LINKS_SQL,
           "op11_warc": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_prefix_trie": OP13_SQL}
