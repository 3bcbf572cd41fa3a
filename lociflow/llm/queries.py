"""Queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import embedding_dedup, hilbert_shards, hmm_scoring, license_scan, merkle_manifest, mixing, packing, quality_qda, simhash_dedup, token_counts, topk_search, url_rules, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.assign(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify(table(spark, sf_dir, "documents"))


def op13_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.score(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_embedding_dedup, op3_topk_search, op4_simhash_dedup, op5_quality_classifier,
        op6_license_scan, op7_url_filter, op8_packing, op9_sharding, op10_mixing,
        op11_whitening, op12_merkle_manifest, op13_hmm_scoring,
    )
}

ORACLE_SQL = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT t.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links,
               coalesce(least.component_id, t.vec_id) AS component_id,
               coalesce(least.component_id, t.vec_id) = t.vec_id AS kept
        FROM embeddings t LEFT JOIN least ON least.a = t.vec_id LEFT JOIN deg ON deg.a = t.vec_id""",
    "op3_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # Levels of the sources' trees and of the one over their roots climb in two recursive tables; ways hold for each leaf
    # the texts before and after its node at each level, and folding is a list_reduce over them.
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS id FROM documents),
        enc AS (
            SELECT rid, doc_id, source, id, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
                   text, replace(text, chr(10), '') AS short FROM f),
        l AS (
            SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(short) || ':' || short, '-')) AS other,
                   list_reduce([ascii(c) FOR c IN string_split(id, '')],
                       lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295) % 2 = 1 AS even
            FROM enc),
        o AS (
            SELECT *, coalesce('1' || source, '0') AS k, count(*) OVER (PARTITION BY source) AS n,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM l),
        t AS (
            SELECT 0 AS lev, k, pos, n, leaf AS h FROM o
            UNION ALL
            SELECT lev + 1, k, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lev, k, pos // 3),
        sub AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
            SELECT 0 AS lev, pos, n, subroot AS h FROM sub
            UNION ALL
            SELECT lev + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lev, pos // 3),
        way AS (
            SELECT o.rid, t.lev, o.pos // CAST(3 ** t.lev AS BIGINT) AS me, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < o.pos // CAST(3 ** t.lev AS BIGINT)), '') AS b,
                   coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > o.pos // CAST(3 ** t.lev AS BIGINT)), '') AS a
            FROM o JOIN t ON o.k = t.k AND t.n > 1 AND t.pos // 3 = o.pos // CAST(3 ** (t.lev + 1) AS BIGINT) GROUP BY ALL),
        top AS (
            SELECT s.k, u.lev + 100 AS lev, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos // CAST(3 ** u.lev AS BIGINT)), '') AS b,
                   coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos // CAST(3 ** u.lev AS BIGINT)), '') AS a
            FROM sub s JOIN u ON u.n > 1 AND u.pos // 3 = s.pos // CAST(3 ** (u.lev + 1) AS BIGINT) GROUP BY s.k, s.pos, u.lev),
        both_ AS (SELECT rid, lev, b, a FROM way UNION ALL SELECT o.rid, top.lev, top.b, top.a FROM o JOIN top ON o.k = top.k),
        p AS (SELECT rid, string_agg(b || a, '' ORDER BY lev) AS sib, list({'b': b, 'a': a} ORDER BY lev) AS w FROM both_ GROUP BY rid),
        r AS (
            SELECT o.doc_id, o.leaf, sub.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(p.sib, '')) AS proof_sha256,
                   list_reduce(coalesce(p.w, []), lambda s, x: {'b': '', 'a': sha256(x.b || s.a || x.a)},
                       {'b': '', 'a': CASE WHEN coalesce(o.even, false) THEN o.other ELSE o.leaf END}).a AS folded_root
            FROM o JOIN sub ON o.k = sub.k LEFT JOIN p ON o.rid = p.rid)
        SELECT *, folded_root = root AS verified FROM r""",
}
