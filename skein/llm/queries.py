"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, langid, lines, quality, repeats, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS total, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM pairs WHERE 100 * common >= 90 * (total - common)),
reach AS (SELECT a AS doc_id, a AS node FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.node = l.a),
least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, begin, end: one row for each pair of a document and an item found in it."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    documents = _table(spark, sf_dir, "documents")
    trees = langid.learn(documents.where(~langid.held_out()))
    out = langid.predict(documents, trees)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return bpe.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
each AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sound),
scores AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(sum(q.x * e.x) AS BIGINT) AS score FROM each q JOIN each e ON q.i = e.i AND q.vec_id <> e.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels.where(quality.learning_row()))
    out = quality.score(documents, model)
    return out.select("doc_id", F.coalesce(~quality.learning_row(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left)."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = """
WITH each AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
gone AS (SELECT line FROM each WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
listed AS (SELECT coalesce(list(line), []) AS g FROM gone),
cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(g, trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM documents CROSS JOIN listed)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_removed, array_to_string(kept, chr(10)) AS text FROM cut
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_runs."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH whole AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents),
starts AS (SELECT doc_id, data, unnest(range(0, octet_length(data) - 399)) AS i FROM whole),
windows AS (SELECT doc_id, i, md5(data[i + 1:i + 400]) AS w FROM starts),
repeated AS (SELECT doc_id, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM repeated),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS b, max(i) + 400 AS e FROM numbered GROUP BY 1, 2),
ends AS (SELECT doc_id, b, e FROM spans UNION ALL SELECT doc_id, octet_length(data), NULL FROM whole),
rest AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e NULLS LAST), 0) AS before FROM ends),
kept AS (
  SELECT doc_id, coalesce(sum(e - b), 0) AS n_removed, count(e) AS n_spans, string_agg(CASE WHEN b > before THEN hex(data[before + 1:b]) ELSE '' END, '' ORDER BY b, e NULLS LAST) AS left_
  FROM rest JOIN whole USING (doc_id) GROUP BY 1),
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, len(w) AS n, i, {'word': w[i], 'i': i} AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) - 30)) AS i FROM words WHERE len(w) >= 51)),
least AS (SELECT doc_id, w, n, i, struct_extract(min(place) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), 'i') AS p FROM places),
chosen AS (SELECT doc_id, substr(md5(array_to_string(w[p:p + 31], ' ')), 1, 16) AS h FROM (SELECT DISTINCT doc_id, w, p FROM least WHERE i <= n - 50)),
shared AS (SELECT h FROM chosen GROUP BY h HAVING count(*) > 1),
told AS (SELECT doc_id, count(DISTINCT h) AS n_shared_runs FROM chosen WHERE h IN (SELECT h FROM shared) GROUP BY 1)
SELECT doc_id, CAST(octet_length(data) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(left_)) AS kept_sha256,
  CAST(coalesce(n_shared_runs, 0) AS BIGINT) AS n_shared_runs
FROM whole JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
"""


#: Fixed values of the query: verdict, host, path.
URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return urls.url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT host, path, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(r.h || r.p) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM parts) k JOIN rules r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM judged WHERE n = 1) USING (host, path)
"""

QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_decontamination, op3_language_id, op4_token_counts, op5_url_filter, op6_top_k, op7_quality, op8_line_dedup, op9_byte_bpe, op10_suffix_dedup)}

ORACLE: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_top_k": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_suffix_dedup": OP10_SQL}
