"""One query for every operator of this subpackage, with DuckDB text where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import table
from .exact_topk import exact_top_k
from .lexical import ranked_documents
from .licences import oracle as licence_oracle
from .licences import scan_licences
from .lm_scoring import quality_scores
from .mixing import mixed_counts
from .near_dedup import near_duplicates
from .packing import pack_documents
from .personal import personal_data
from .simple8b import coded_round_trip
from .tokens import count_tokens
from .toxicity import toxicity
from .vector_codes import coded_vectors


def _hundredth(vec_id):
    return vec_id % 100 == 0


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), _hundredth)


def op9_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), _hundredth)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_round_trip(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_impact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_vectors(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_token_counts, op3_licence_scan, op4_simple8b_ids, op5_lm_scoring, op6_toxicity, op7_source_mixing, op8_best_fit_packing, op9_anisotropic_ann, op10_minhash_near_dedup, op11_impact_ordered, op12_yinyang_codes, op13_personal_data)}


def _codes_oracle() -> str:
    """Plain Lloyd rounds: every part against every entry, the smaller number among equals."""
    gap = "list_sum(list_transform(list_zip(a.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    text = """
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT r, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, r - 1 AS e, x FROM a WHERE r <= 64)"""
    for n in range(3):
        text += f""",
n{n} AS (SELECT a.r, a.p, min({gap} * 64 + c.e) AS key FROM a JOIN c{n} c ON a.p = c.p GROUP BY 1, 2)"""
        if n < 2:
            text += f""",
m{n} AS (SELECT p, e, list(floor(total / n) ORDER BY i) AS x FROM (SELECT p, e, i, sum(a) AS total, count(*) AS n FROM
  (SELECT a.p, n{n}.key % 64 AS e, unnest(a.x) AS a, unnest(range(len(a.x))) AS i FROM a JOIN n{n} USING (r, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{n + 1} AS (SELECT c.p, c.e, coalesce(list_transform(m.x, lambda t: CAST(t AS BIGINT)), c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.p = c.p AND m.e = c.e)"""
    return text + """,
o AS (SELECT r, string_agg(lpad(lower(to_hex(key % 64)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(key // 64) AS BIGINT) AS error FROM n2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM h) AS codebooks_sha256 FROM v JOIN o USING (r)"""


#: DuckDB text by query.
SQL: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_licence_scan": licence_oracle(),
    "op11_impact_ordered": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
c AS (SELECT count(*) FILTER (len(t) > 0) AS documents, CAST(sum(len(t)) AS BIGINT) AS total FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY term),
m AS (SELECT doc_id, 100 - 75 + (75 * len(t) * documents) // total AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_yinyang_codes": _codes_oracle(),
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id, w.doc_id = coalesce(c.least, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
