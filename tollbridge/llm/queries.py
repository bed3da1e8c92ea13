"""One query per operator, over its whole table and with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbridge.llm import (
    bpe, decontaminate, fill_middle, html_text, language, licenses, lines, passages, prefix_trie, quality, secrets, simhash, token_store,
)
from tollbridge.queries.registry import table
from tollbridge.session import fresh_folder

TOKENIZER = "byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = docs.select("doc_id", "lang", quality.counts(F.col("text")).alias("of"))
    judged = quality.judge_measured(measured, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", *[F.col("of")[c].alias(c) for c in quality.COUNTS], F.col("failed").alias("base_failed"), "kept"
    )


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op8_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, pos, (last IS NOT NULL AND doc_id <> last) AS gone FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "tokens")
    tokenizer = bpe.read_file(public_tokenizers.path(TOKENIZER))
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer)
    return token_store.read_tokens(spark, path)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_near(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
        F.size(of(secrets.MODEL_KIND)).cast("bigint").alias("n_random"),
    )


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


# The text is put together again from the output's parts, found by their markers.
ORACLES["op12_fill_in_middle"] = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), hashed AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT *, coalesce(array_to_string(list_filter(u, lambda x, i: i <= a), ''), '') AS p,
         coalesce(array_to_string(list_filter(u, lambda x, i: i > a AND i <= b), ''), '') AS m,
         coalesce(array_to_string(list_filter(u, lambda x, i: i > b), ''), '') AS s
  FROM placed
), written AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form
         WHEN 'plain' THEN output
         WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3)
           || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
         ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3)
           || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END) AS restored_sha256
FROM written
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node_id", "parent_id")


# The crc32 is worked out bit by bit: a byte goes in, then eight shifts.
ORACLES["op13_prefix_trie"] = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s // 2, 3988292384 * (s % 2)) END), 4294967295) % 4 AS h
  FROM own GROUP BY conv_id
), based AS (
  SELECT c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) AS nb FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), rebuilt AS (
  SELECT c.conv_id, b.pos AS d, b.role, b.text FROM based c JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos <= c.h
  UNION ALL
  SELECT o.conv_id, o.pos - c.h + c.nb, o.role, o.text FROM own o JOIN based c USING (conv_id) WHERE o.pos > c.h
), spelled AS (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS words,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS id
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), path AS (
  SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY conv_id) AS last FROM spelled
), node AS (
  SELECT id, min(conv_id) AS conv_id, min(d) AS d, min(parent) AS parent, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM path GROUP BY id
), children AS (
  SELECT parent AS id, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent
), valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN children USING (id)
), total AS (
  SELECT p.id, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM valued n JOIN path p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.id
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM valued n JOIN total USING (id) LEFT JOIN valued p ON p.id = n.parent
"""


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf_dir, "documents"), keep_text=False)


ORACLES["op11_substring_dedup"] = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents
), starts AS (
  SELECT r, unnest(range(1, greatest(len(w) - 33, 1))) AS k FROM split
), windows AS (
  SELECT r, k, md5(array_to_string(list_slice(w, k, k + 34), ' ')) AS h FROM starts JOIN split USING (r)
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(k, k + 35)) AS j FROM windows JOIN again USING (h)
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM split
), kept AS (
  SELECT words.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.j) AS kept FROM words ANTI JOIN gone USING (r, j) GROUP BY words.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""
