"""The thin queries over the operators of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import conversation_repair, decontamination, fingerprints, language_id, line_dedup, mixing, near_dedup, packing, pii, quality, token_planes, url_filters, vector_codes


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(C.table(spark, sf_dir, "documents"), width=2, threshold=0.8)


#: The rules of op10: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(C.table(spark, sf_dir, "documents"))


def op2_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents"), repetition_limit=2.0)


def op4_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    own = language_id.identify(docs, model)
    return own.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{C.shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    token_planes.write(C.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_planes.read(spark, path)


def op7_densified_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(C.table(spark, sf_dir, "documents"))


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(C.table(spark, sf_dir, "documents"))
    of = lambda n: lambda s: s["kind"] == n
    counts = [F.size(F.filter("base", of(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.BASE)]
    spans = pii.joined(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op10_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(C.table(spark, sf_dir, "pages"), rules)


def op11_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    coded, _ = C.materialise(vector_codes.encode(vectors, books, carry=("label",)), "vector-codes")
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op12_tight_arc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = C.table(spark, sf_dir, "conversations")
    return conversation_repair.audit(conversation_repair.damaged(conversations), conversations)


def op13_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_weak_label_quality, op2_wand_decontamination, op3_temperature_mixing, op4_word_first_language, op5_line_window_dedup, op6_token_planes, op7_densified_fingerprints, op8_boosted_pii, op9_minmax_near_dedup, op10_url_sweep, op11_va_file_codes, op12_tight_arc_repair, op13_configuration_packing)
}

OP10_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rh, rp, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), u AS (SELECT DISTINCT host, path FROM q
), m AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (host, path)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s
), e AS (SELECT doc_id, unnest(sh) AS g FROM s
), f AS (SELECT g, count(*) AS c FROM e GROUP BY g
), k AS (
  SELECT e.doc_id, e.g, n.n, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.c, e.g) AS pos FROM e JOIN f USING (g) JOIN n USING (doc_id)
), pre AS (SELECT * FROM k WHERE pos <= n - ceil(0.8 * n) + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.sh, y.sh)) >= 80 * (len(x.sh) + len(y.sh) - len(list_intersect(x.sh, y.sh)))
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id
), comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN comp ON id = n.doc_id
"""

OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, text, i - 1 AS i, parts[i] AS line, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS s
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(parts) + 1)) AS t(i)
), b AS (
  SELECT doc_id, i, s, lead(s, 1) OVER o AS s2, lead(s, 2) OVER o AS s3, lead(i, 2) OVER o AS last FROM l WHERE s <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), w AS (SELECT doc_id, i AS first, last, row_number() OVER (PARTITION BY s, s2, s3 ORDER BY doc_id, i) AS k FROM b WHERE s3 IS NOT NULL
), gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN w ON l.doc_id = w.doc_id AND w.k > 1 AND l.i BETWEEN w.first AND w.last
), c AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
)
SELECT documents.doc_id, c.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN c USING (doc_id)
"""



def _op11_sql(rounds: int = 4) -> str:
    """k-means of the parts, a table of assignments and one of codebooks a round; the distances are whole numbers that a double holds."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, p.part, p.s, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
    SELECT vec_id, p.part, p.s, e, list_dot_product(p.s, p.s) - 2 * list_dot_product(p.s, b.s) + list_dot_product(b.s, b.s) AS d FROM p JOIN b{k} b ON b.part = p.part
  ) p GROUP BY vec_id, p.part, p.s
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT part, e, list(m ORDER BY i) AS s FROM (
    SELECT part, e, i, CAST((t - ((t % n) + n) % n) // n AS DOUBLE) AS m FROM (
      SELECT part, e, i, sum(CAST(s[i] AS BIGINT)) AS t, count(*) AS n FROM a{k}, range(1, 17) AS r(i) GROUP BY part, e, i)) GROUP BY part, e
), b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.s, b.s) AS s FROM b{k} b LEFT JOIN m{k} m USING (part, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (SELECT vec_id, k AS part, v[16 * k + 1 : 16 * k + 16] AS s FROM kept, range(4) AS r(k)
), b0 AS MATERIALIZED (SELECT part, e, s FROM (SELECT part, s, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 256
), {", ".join(steps)}, c AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), h AS (SELECT sha256(string_agg(CAST(CAST(s[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM b{rounds}, range(1, 17) AS r(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN kept USING (vec_id), h
"""


ORACLE_SQL: dict[str, str] = {"op11_va_file_codes": _op11_sql(), "op5_line_window_dedup": OP5_SQL, "op9_minmax_near_dedup": OP9_SQL, "op10_url_sweep": OP10_SQL}
