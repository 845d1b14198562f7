"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from healthwatch.llm import (exact_dedup, laesa, lattice_lm, mixing, near_dup, pii, quality, recompression, secrets, spelling, spm, token_counts,
                             warc)
from healthwatch.llm.common import RID, read


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), ("source", "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents")).drop(*RID)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages")).drop("verified")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(read(spark, sf_dir, "documents"))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents")).drop(*RID)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.clustered(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_surrogates, op2_secret_scan, op3_token_counts, op4_sentencepiece, op5_exact_dedup,
                                   op6_warc, op7_lattice_lm, op8_dart_minhash, op9_quality_rules, op10_mixing, op11_recompression,
                                   op12_spelling_variants, op13_laesa_clusters)}

_LOWER = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"

_OP5 = f"""
WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""

_OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest AS d, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target IS NOT NULL AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN target <> page_id THEN target END AS refers_to
FROM p LEFT JOIN g ON payload_digest = d AND payload_bytes >= 1000
"""


def _op9_sql() -> str:
    """The same measures in DuckDB; windows are compared as joined words."""
    stop = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)
    marks = "length(regexp_replace(text, '[^{}]', '', 'g'))"
    rules = " OR ".join(f"(n_words >= {r.from_words} AND {r.measure} {r.op} {r.bound})" for r in quality.RULES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8) q),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) q WHERE n > 1),
cov AS (SELECT rid, sum(least(8, i - coalesce(p, i - 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM dup) q GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST({marks.format('#*$%&|<>')} AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             {marks.format('!')} AS bangs, len(list_filter(w, lambda x: x IN ({stop}))) AS stops, len(l) AS lines,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echoes
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbol_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars,
             bangs / greatest(n_words, 1) AS bang_ratio, stops / greatest(n_words, 1) AS stop_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
             echoes / greatest(n_words, 1) AS echo_ratio, n_dup_lines / greatest(lines, 1) AS dup_line_ratio,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rules}) AS kept FROM r
"""


_OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM t),
s AS (SELECT rid, i, word, n, sha256(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {recompression.WINDOW - 1} FOLLOWING)) AS h FROM u),
r AS (SELECT rid, i, word, i + {recompression.WINDOW - 1} <= n AND count(*) FILTER (WHERE i + {recompression.WINDOW - 1} <= n) OVER (PARTITION BY h) > 1 AS rep FROM s),
c AS (SELECT rid, i, word, bool_or(rep) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {recompression.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.rid = k.rid
"""


def _op13_sql() -> str:
    """Rounds of assignment and integer means; floors by exact remainders."""
    dims, k = laesa.DIMS, laesa.CLUSTERS

    def assign(name: str, centroids: str) -> str:
        d = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
        return (f"{name} AS (SELECT rid, min(struct_pack(d := CAST({d} AS BIGINT), c := c.c)) AS m FROM v, {centroids} c GROUP BY rid)")

    parts = [f"""e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({laesa.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             "v AS MATERIALIZED (SELECT * FROM e)",
             f"c0 AS MATERIALIZED (SELECT q, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT q, sha256('{laesa.SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}) z)"]
    for r in range(laesa.ROUNDS):
        parts += [assign(f"a{r}", f"c{r}").replace(" AS (", " AS MATERIALIZED (", 1),
                  f"u{r} AS (SELECT m.c AS c, unnest(q) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r} JOIN v USING (rid))",
                  f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{r} GROUP BY c, i)",
                  f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY c)",
                  f"c{r + 1} AS MATERIALIZED (SELECT coalesce(m{r}.q, c{r}.q) AS q, c{r}.c AS c FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)"]
    last = f"c{laesa.ROUNDS}"
    parts += [assign("f", last).replace(" AS (", " AS MATERIALIZED (", 1)]
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string({last}.q, ',')) AS centroid_sha256
FROM f JOIN v USING (rid) JOIN {last} ON m.c = {last}.c"""


ORACLE = {"op5_exact_dedup": _OP5, "op6_warc": _OP6, "op9_quality_rules": _op9_sql(), "op11_recompression": _OP11,
          "op13_laesa_clusters": _op13_sql()}
