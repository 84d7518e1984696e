"""The registered queries of this subpackage and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, html_text, language, lsh_forest, mtree, packing, simhash, token_files, toxicity, url_filter
from siftwell.llm.shared import spread


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "documents"))


def op1_mtree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth vector."""
    return mtree.top_k(_table(spark, folder, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack_documents(_documents(spark, folder))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's span and checksum, read back from the token files."""
    return token_files.write_and_read(spark, _documents(spark, folder))


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.round_trip(_documents(spark, folder))


def op5_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest found of every fiftieth vector."""
    return lsh_forest.neighbours(_table(spark, folder, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(_documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.filter_urls(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = _table(spark, folder, "documents")
    return toxicity.score(spread(docs), toxicity.fit(docs, _table(spark, folder, "labels")))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's language, by models fitted on the documents."""
    return language.identify_pages(_table(spark, folder, "pages"), language.fit(_table(spark, folder, "documents")))


def op10_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(_table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree_top_k": op1_mtree_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_lsh_forest": op5_lsh_forest,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_html_main_text": op10_html_main_text,
}



def _url_filter_sql() -> str:
    """The rules, the host graph and each round of propagation as one WITH query."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r.name), r.name))
    name = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in rules) + " END"
    own = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in rules) + " END"
    host = lambda rest: f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    rest = lambda url: f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    share = lambda v: f"coalesce(avg(CASE WHEN own IS NOT NULL THEN CASE WHEN own = '{v}' THEN 1.0 ELSE 0.0 END END), 0.0)::DOUBLE"
    d = url_filter.DAMPING
    steps = [
        f"""k{i + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
            SELECT host, trust, distrust FROM k0
            UNION ALL SELECT target, trust * down * {d}, 0.0 FROM edges JOIN k{i} ON host = source
            UNION ALL SELECT source, 0.0, distrust * up * {d} FROM edges JOIN k{i} ON host = target) GROUP BY host)"""
        for i in range(url_filter.ROUNDS)
    ]
    links = url_filter.LINKS.replace("'", "''")
    return f"""
        WITH r AS (SELECT page_id, html, {rest("url")} AS rest FROM pages),
        h AS (SELECT page_id, html, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        ruled AS MATERIALIZED (SELECT *, {name} AS rule, {own} AS own FROM h),
        raw AS (SELECT host AS source, unnest(regexp_extract_all(html, '{links}', 1)) AS link FROM h),
        full_links AS (SELECT source, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS link FROM raw),
        ends AS (SELECT source, {host(rest("link"))} AS target FROM full_links),
        links AS MATERIALIZED (SELECT source, target, count(*) AS n FROM ends WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2),
        edges AS MATERIALIZED (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS down, n / sum(n) OVER (PARTITION BY target) AS up FROM links),
        seeds AS (SELECT host, {share("allow")} AS trust, {share("block")} AS distrust FROM ruled WHERE host <> '' GROUP BY host),
        nodes AS (SELECT * FROM seeds UNION ALL SELECT host, 0.0, 0.0 FROM (SELECT source AS host FROM links UNION SELECT target FROM links) WHERE host NOT IN (SELECT host FROM seeds)),
        k0 AS MATERIALIZED (SELECT host, trust * {1 - d} AS trust, distrust * {1 - d} AS distrust FROM nodes), {", ".join(steps)}
        SELECT page_id, host, path, rule, coalesce(own, CASE WHEN distrust - trust > {url_filter.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled LEFT JOIN k{url_filter.ROUNDS} USING (host)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_mtree_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s
        QUALIFY rank <= 10
    """,
    "op7_url_filter": _url_filter_sql(),
}
