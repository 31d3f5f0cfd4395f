"""The registered queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, codes, exactdedup, html, language, lmscore, neardup, neighbours, packing, pieces, quality, sharding, suffixdedup
from .frames import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.op3(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op8(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op9(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.op11(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.classes(table(spark, sf_dir, "documents"), digests=True)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


_WORDS = "list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _lloyd(rounds: int = 2) -> str:
    """Product codes by the rule: every distance, in integers."""
    part = f"(embedding[1 + p * (len(embedding) // {codes.PARTS}) : (p + 1) * (len(embedding) // {codes.PARTS})])"
    steps = [
        f"""v AS (SELECT vec_id, label, CAST(p AS INT) AS p, list_transform({part}, lambda x: CAST(floor({codes.SCALE} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings, unnest(range({codes.PARTS})) u(p)
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"e0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INT) AS c, x AS e FROM v QUALIFY c < {codes.ENTRIES})",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        steps.append(f"a{k} AS (SELECT vec_id, label, p, x, min({{'d': {distance}::BIGINT, 'c': c}}) AS best FROM v JOIN e{k} USING (p) GROUP BY vec_id, label, p, x)")
        if k < rounds:
            floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
            steps.append(f"m{k} AS (SELECT p, best.c AS c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k}, unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL)")
            steps.append(f"n{k} AS (SELECT p, c, list({floor} ORDER BY i) AS e FROM m{k} GROUP BY ALL)")
            steps.append(f"e{k + 1} AS (SELECT p, c, coalesce(n{k}.e, e{k}.e) AS e FROM e{k} LEFT JOIN n{k} USING (p, c))")
    return f"""WITH {", ".join(steps)},
      coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.c), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
      SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) FROM e{rounds}) AS codebooks_sha256 FROM coded"""


#: Near-duplicates by plain sets and plain reachability, codes by all distances, equal texts by grouping. The others train models, hash as DuckDB can't (crc32), use tokenizers or follow greedy rules: tests/llm has their brute force.
SQL = {
    "op6_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
      n AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY ALL),
      shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
      links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
      ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN ways ON r = a)
      SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op11_vector_codes": _lloyd(),
    "op12_exact_dedup": """WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
      SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
