"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact, line_dedup, manifest, mixing, near_dups, pii, secrets, substring, token_files, toxicity, tries


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.simhash_components(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_documents(spark, sf_dir), digests=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(_documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity, op2_secrets, op3_simhash, op4_substring_dedup, op5_line_dedup, op6_decontamination, op7_exact_dedup, op8_bpe, op9_token_files, op10_pii,
        op11_prefix_trie, op12_mixing, op13_manifest,
    )
    return {f.__name__: f for f in found}


OP4_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS w FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS dup FROM g),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM m, (SELECT unnest(range(0, 13)) AS o) WHERE dup),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
w AS (SELECT d.doc_id, p, ws[p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p)),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, p) GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM d),
e AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines)
        OR (i > 1 AND (hs[i - 1] * 31 + hs[i]) % 3 = 0)) AS ends FROM h),
c AS (SELECT doc_id, k, CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END AS b, ends[k] AS e, lines
      FROM e, LATERAL (SELECT unnest(range(1, len(ends) + 1)) AS k)),
t AS (SELECT doc_id, k, e - b AS n_lines, array_to_string(lines[b + 1 : e], chr(10)) AS body FROM c),
r AS (SELECT *, n_lines >= 2 AND length(body) >= 40
        AND row_number() OVER (PARTITION BY body, n_lines >= 2 ORDER BY doc_id, k) > 1 AS gone FROM t)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


#: crc32 of an ASCII text ``s``, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

OP11_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS base, ({crc}) % 9 AS h FROM (SELECT c, c::VARCHAR AS s FROM ids)),
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
re AS (SELECT c, list_concat(coalesce(b.ts[1 : h], []), a.ts[h + 1 :]) AS ts FROM k JOIN o a ON a.conv_id = c LEFT JOIN o b ON b.conv_id = base),
m AS (SELECT c, d, ts[1 : d] AS p, d = len(ts) AS ends FROM re, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS d)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].t) END AS own FROM m GROUP BY p, d),
u AS (SELECT p[1 : d - 1] AS up, d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u ON u.up = n.p AND u.d = n.d + 1),
s AS (SELECT p[1 : e] AS top, e, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM l, LATERAL (SELECT unnest(range(0, d + 1)) AS e) GROUP BY ALL)
SELECT l.conv_id, l.d AS depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM l JOIN s ON s.top = l.p AND s.e = l.d LEFT JOIN n q ON l.d > 0 AND q.p = l.p[1 : l.d - 1] AND q.d = l.d - 1
"""

OP13_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, ({crc}) % 5 = 0 AS hit FROM (SELECT *, doc_id::VARCHAR AS s FROM documents)),
f AS (SELECT doc_id, source, hit, {fields} AS body, coalesce(strlen(text) || ':' || text, '-') AS whole, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS small FROM d),
l AS (SELECT doc_id, source, sha256(body || whole) AS leaf, CASE WHEN hit THEN sha256(body || small) ELSE sha256(body || whole) END AS now FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
r AS (SELECT 0 AS lv, source, list(leaf ORDER BY pos) AS nodes FROM k GROUP BY source
  UNION ALL SELECT lv + 1, source, list_transform(range(0, ceil(len(nodes) / 16)::BIGINT), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], ''))) FROM r WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM r WHERE len(nodes) = 1),
t AS (SELECT 0 AS lv, list(subroot ORDER BY spot) AS nodes FROM s
  UNION ALL SELECT lv + 1, list_transform(range(0, ceil(len(nodes) / 16)::BIGINT), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], ''))) FROM t WHERE len(nodes) > 1),
h AS (SELECT source, max(lv) AS top FROM r GROUP BY source),
w AS (SELECT doc_id, leaf, k.source, subroot, spot, top, pos, 0 AS lv, now, '' AS sib FROM k JOIN s ON s.source IS NOT DISTINCT FROM k.source JOIN h ON h.source IS NOT DISTINCT FROM k.source
  UNION ALL SELECT doc_id, leaf, w.source, subroot, spot, top, CASE WHEN w.lv + 1 = top THEN spot ELSE pos // 16 END, w.lv + 1,
    sha256(array_to_string(list_concat(run[1 : o], [now], run[o + 2 :]), '')), sib || array_to_string(list_concat(run[1 : o], run[o + 2 :]), '')
    FROM (SELECT w.*, pos % 16 AS o, x.nodes[pos // 16 * 16 + 1 : pos // 16 * 16 + 16] AS run FROM w JOIN (
      SELECT false AS upper_tree, lv, source, nodes FROM r WHERE len(nodes) > 1 UNION ALL SELECT true, lv, NULL, nodes FROM t WHERE len(nodes) > 1) x
      ON x.upper_tree = (w.lv >= top) AND x.lv = CASE WHEN w.lv >= top THEN w.lv - top ELSE w.lv END AND (x.upper_tree OR x.source IS NOT DISTINCT FROM w.source)) w)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, now AS folded_root, now = root AS verified
FROM w, (SELECT nodes[1] AS root FROM t WHERE len(nodes) = 1) WHERE w.lv = top + (SELECT max(lv) FROM t)
"""


def oracle_sql() -> dict[str, str]:
    found = {"op4_substring_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL}
    found["op11_prefix_trie"] = OP11_SQL.format(crc=CRC32_SQL)
    fields = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    return found | {"op13_manifest": OP13_SQL.format(crc=CRC32_SQL, fields=fields)}
