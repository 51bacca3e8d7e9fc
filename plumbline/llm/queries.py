"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import preference_pairs
from .embedding_dedup import embedding_components
from .exact_dedup import exact_duplicates
from .language_id import identify, page_parts, train
from .license_scan import BASE, TEMPLATES, license_scan
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import ngram_components
from .packing import pack
from .token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by its text and source, and every page, by its text, markup, address and host."""
    docs, pages = _table(spark, sf_dir, "documents"), page_parts(_table(spark, sf_dir, "pages"))
    none = F.lit(None).cast("string")
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    rows = rows.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("page_text").alias("text"), "declared", "suffix", "host", "domain"))
    return identify(rows, train(docs), keep=["doc_id", "page_id"], declared_col="declared", suffix_col="suffix", host_col="host", domain_col="domain")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair, the first of them chosen; one without a partner is paired with none."""
    turns = _table(spark, sf_dir, "conversations")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    side = lambda odd: F.max(F.when(F.pmod("conv_id", F.lit(2)) == odd, F.col("conv_id")))
    pairs = turns.filter(F.col("conv_id").isNotNull()).groupBy(pair.alias("pair_id")).agg(side(0).alias("chosen_id"), side(1).alias("rejected_id"))
    return preference_pairs(turns, pairs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_chat_format": op10_chat_format,
}
def _license_sql() -> str:
    """Every place of every base and key phrase; each place of a key phrase proposes one alignment of its template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    base = ", ".join(f"('{p}', {quoted(p)}, '{label}')" for p, label in BASE)
    keys = []
    for t in TEMPLATES:
        own = t.words.split()
        for phrase in t.phrases:
            n = len(phrase.split())
            at = next(i for i in range(len(own)) if own[i : i + n] == phrase.split())
            keys.append(f"('{t.label}', {quoted(t.words)}, {quoted(phrase)}, {at})")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b(phrase, p, label) AS (VALUES {base}), k(label, own, p, place) AS (VALUES {', '.join(keys)}),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
places AS (SELECT doc_id, i.i - 1 AS i, label FROM i JOIN b ON w[i.i] = p[1] AND w[i.i:i.i + len(p) - 1] = p),
aligned AS (SELECT doc_id, w, label, own, i.i - 1 - place AS off FROM i JOIN k ON w[i.i] = p[1] AND w[i.i:i.i + len(p) - 1] = p),
shares AS (SELECT doc_id, label, len(list_filter(range(1, len(own) + 1), lambda j: off + j >= 1 AND w[greatest(off + j, 1)] = own[j]))::DOUBLE / len(own) AS share FROM aligned),
found AS (SELECT * FROM shares WHERE share >= 0.75),
bases AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a AS first_word, b.z AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
       coalesce(s.share, CASE WHEN b.n > 0 THEN 0.5 END, 0.0)::DOUBLE AS score
FROM w LEFT JOIN bases b USING (doc_id) LEFT JOIN every e USING (doc_id) LEFT JOIN best s USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS un, any_value(b.n) AS vn, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * k >= 75 * (un + vn - k)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS c FROM r GROUP BY u)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.c AS component_id FROM s JOIN c ON s.doc_id = c.u""",
    "op8_license_scan": _license_sql(),
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
per AS (SELECT source, sum(size)::HUGEINT AS s FROM sized GROUP BY source),
named AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM per),
filled AS (
  SELECT *, sum(s) OVER () AS t,
         3 * coalesce(sum(s) OVER (ORDER BY s::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY s::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l
  FROM named),
marked AS (SELECT *, 3 * s * l < (t - c) * w AS full_ FROM filled),
shared AS (SELECT *, first_value(t - c) OVER x AS rest, first_value(l) OVER x AS shares FROM marked
           WINDOW x AS (ORDER BY full_, s::DOUBLE / w, source IS NULL, source)),
aimed AS (SELECT source, s::BIGINT AS s, CASE WHEN full_ THEN (3 * s)::DOUBLE ELSE (rest * w)::DOUBLE / shares::DOUBLE END AS target FROM shared),
whole AS (SELECT *, CASE WHEN s > 0 THEN floor(target)::BIGINT // s ELSE 0 END AS e FROM aimed),
placed AS (
  SELECT d.doc_id, d.size, a.s, a.target, a.e, floor(a.target)::BIGINT - a.e * a.s AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN whole a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, s AS source_size, target, (e * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM placed""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d,
       LATERAL (SELECT unnest(s) AS line, generate_subscripts(s, 1) AS i) u),
first AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, f.keeper IS NOT NULL AND f.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN first f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op9_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                       AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.c AS component_id, e.vec_id = l.c AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.u LEFT JOIN degree d ON e.vec_id = d.u""",
    "op10_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'user'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT (conv_id // 2)::BIGINT AS pair_id, max(conv_id) FILTER (WHERE conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (WHERE conv_id % 2 = 1) AS rejected_id
      FROM t GROUP BY 1),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
differ AS (SELECT p.pair_id, min(a.i) AS i FROM p JOIN t a ON a.conv_id = p.chosen_id JOIN t b ON b.conv_id = p.rejected_id AND a.i = b.i
           WHERE a.role <> b.role OR a.text <> b.text GROUP BY p.pair_id),
shared AS (SELECT p.*, coalesce(d.i - 1, least(coalesce(c.n, 0), coalesce(r.n, 0)))::BIGINT AS n_shared
           FROM p LEFT JOIN differ d USING (pair_id) LEFT JOIN sizes c ON c.conv_id = p.chosen_id LEFT JOIN sizes r ON r.conv_id = p.rejected_id),
said AS (SELECT s.pair_id, t.conv_id, t.i, t.role, t.text, t.i <= s.n_shared AS before, '<|' || t.role || '|>' || chr(10) AS head,
                '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS whole
         FROM shared s JOIN t ON t.conv_id = s.chosen_id OR t.conv_id = s.rejected_id),
placed AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY pair_id, conv_id, before ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM said),
sides AS (
  SELECT pair_id, conv_id, coalesce(string_agg(whole, '' ORDER BY i) FILTER (WHERE before), '') AS prompt, coalesce(string_agg(whole, '' ORDER BY i) FILTER (WHERE NOT before), '') AS rest,
         coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(text) + 7), ' ' ORDER BY i) FILTER (WHERE NOT before AND role = 'assistant'), '') AS spans
  FROM placed GROUP BY pair_id, conv_id)
SELECT s.pair_id, s.chosen_id, s.rejected_id, s.n_shared, CASE WHEN s.n_shared > 0 THEN c.prompt ELSE '' END AS prompt,
       coalesce(c.rest, '') AS chosen, coalesce(c.spans, '') AS chosen_spans, coalesce(r.rest, '') AS rejected, coalesce(r.spans, '') AS rejected_spans
FROM shared s LEFT JOIN sides c ON c.pair_id = s.pair_id AND c.conv_id = s.chosen_id LEFT JOIN sides r ON r.pair_id = s.pair_id AND r.conv_id = s.rejected_id""",
}
