"""Registered queries over the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import money, paths, rules, text
from siftwell.operators import annotate, budget, dedupe, extract, folds, listings, metrics, ocr, outputs, ranking, rollups, scoring, selection
from siftwell.plans import oracles as O
from siftwell.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return folds.results_latest(A.log(spark, folder))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return folds.decisions_latest(A.decisions(spark, folder))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return A.files(spark, folder).withColumn("dir", paths.parent(F.col("path")))


_SHORTLIST = f"""
    WITH {O.LATEST}, kept AS (SELECT *, {O.LABEL} AS label FROM latest WHERE {O.VALID} AND {O.included()}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY value_score DESC, first_seq) AS pos, count(*) OVER (PARTITION BY dir) AS n FROM kept)
    SELECT dedupe_key, path, label, value_score, CASE WHEN pos > 3 THEN n - 3 ELSE 0 END AS hidden
    FROM placed WHERE pos <= 4 ORDER BY value_score DESC, first_seq LIMIT 25
"""


@_query(_SHORTLIST)
def salvage_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: log, fold, inclusion, collapse of siblings, top 25."""
    rows = _latest(spark, folder).filter(rules.is_valid() & rules.is_included()).withColumn("dir", paths.parent(F.col("path"))).withColumn("label", rules.verified_label(F.col("extraction_status")))
    order = [F.desc("value_score"), F.col("first_seq")]
    return ranking.collapse_siblings(rows, [], order).orderBy(*order).limit(S.REPORT_TOP).select("dedupe_key", "path", "label", "value_score", "hidden")


@_query(f"WITH {O.LATEST} SELECT dedupe_key, path, value_score, error, extraction_status, rubric_version, seq, first_seq FROM latest")
def results_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder).select("dedupe_key", "path", "value_score", "error", "extraction_status", "rubric_version", "seq", "first_seq")


@_query(f"WITH {O.DECISIONS} SELECT path, worth_scanning, seq FROM decisions")
def decisions_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder).select("path", "worth_scanning", "seq")


@_query(f"WITH {O.OCR_LOG} SELECT dedupe_key, excerpt, seq FROM excerpts")
def ocr_excerpts_latest(spark: SparkSession, folder: str) -> DataFrame:
    return folds.ocr_excerpts(A.ocr_log(spark, folder)).select("dedupe_key", "excerpt", "seq")


@_query(f"WITH {O.LOG} SELECT DISTINCT dedupe_key FROM log WHERE error IS NULL")
def resumed_keys(spark: SparkSession, folder: str) -> DataFrame:
    return folds.resolved_keys(A.log(spark, folder))


@_query(f"WITH {O.INVENTORY} SELECT seq, path, size, ext, category, dedupe_key, dup_of FROM inventory")
def inventory_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return A.inventory(spark, folder).select("seq", "path", "size", "ext", "category", "dedupe_key", "dup_of")


@_query(f"WITH {O.INVENTORY} SELECT count(*) FILTER (dup_of IS NOT NULL) AS duplicates, coalesce(sum(size) FILTER (dup_of IS NOT NULL), 0)::BIGINT AS duplicate_bytes FROM inventory")
def dedupe_savings(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.savings(A.inventory(spark, folder))


@_query(f"WITH {O.FILES} SELECT category, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY category")
def categorize_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.category_counts(A.files(spark, folder))


@_query(f"WITH {O.FILES} SELECT source AS top_level, count(*) AS files FROM files GROUP BY source")
def top_level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.top_level_counts(A.files(spark, folder))


@_query(f"WITH {O.FILES} SELECT path, size FROM files WHERE size >= {S.MIN_SIZE}")
def size_floor(spark: SparkSession, folder: str) -> DataFrame:
    return selection.size_floor(A.files(spark, folder)).select("path", "size")


_NAMES = ("node_modules", ".git", "AppData", "Local", "var", "mail", "log", "Src", "tmp", "docs", "usr", "Cache")
_DIR_SQL = f"SELECT o_orderkey AS id, {O._pick(_NAMES, 'o_orderkey')} AS up, {O._pick(_NAMES, 'o_orderkey // 12')} AS name FROM orders"


@_query(f"""
    SELECT id, up, name,
        lower(name) IN {O._in([*rules.SKIPPED_DIRS, *rules.SKIPPED_LINUX_DIRS])} OR (lower(up) = 'appdata' AND lower(name) IN ('local', 'locallow'))
        OR (lower(up) = 'var' AND lower(name) <> 'mail') AS skipped FROM ({_DIR_SQL})
""")
def skip_dirs(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = A.table(spark, folder, "orders").select(n.alias("id"), A._pick(_NAMES, n).alias("up"), A._pick(_NAMES, F.floor(n / 12)).alias("name"))
    return rows.withColumn("skipped", rules.is_skipped_dir(F.col("name"), F.array("up")))


_BUILDS = ("target", "dist", "obj", "build", "vendor", "src", "Library")
_BESIDE = ("Cargo.toml", "package.json", "app.csproj", "go.mod", "readme.md", "Assets", "gradlew")
_MARKED = " OR ".join(
    f"(lower(name) IN {O._in(dirs)} AND (" + " OR ".join([f"lower(beside) IN {O._in(marks)}"] * bool(marks) + [f"ends_with(lower(beside), '{e}')" for e in ends]) + "))" for dirs, marks, ends in rules.MARKERS
)


@_query(f"SELECT id, name, beside, ({_MARKED}) AS skipped FROM (SELECT o_orderkey AS id, {O._pick(_BUILDS, 'o_orderkey')} AS name, {O._pick(_BESIDE, 'o_orderkey // 7')} AS beside FROM orders)")
def marker_skip(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = A.table(spark, folder, "orders").select(n.alias("id"), A._pick(_BUILDS, n).alias("name"), A._pick(_BESIDE, F.floor(n / 7)).alias("beside"))
    return rows.withColumn("skipped", rules.is_skipped_beside(F.col("name"), F.array(F.lower("beside"))))


@_query(f"""
    WITH {O.KEYED} SELECT seq, path, dedupe_key FROM inventory
    WHERE dup_of IS NULL AND category <> 'generated' AND ext NOT IN ('py') AND dedupe_key NOT IN (SELECT dedupe_key FROM keyed_log WHERE error IS NULL)
""")
def eligible_records(spark: SparkSession, folder: str) -> DataFrame:
    resolved = folds.resolved_keys(A.keyed_log(spark, folder))
    return selection.eligible(A.inventory(spark, folder), resolved, exclude_exts=selection.parse_exts(".PY")).select("seq", "path", "dedupe_key")


@_query(f"""
    WITH {O.KEYED}, last AS (SELECT * FROM inventory QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1),
    readable AS (SELECT dedupe_key FROM last
        WHERE category IN ('text', 'code') OR ext IN {O._in(rules.READABLE_DOCS)} OR (category = 'binary' AND ext NOT IN {O._in(rules.NEVER_SNIFFED)} AND size <= {S.SNIFF_CEILING}))
    SELECT seq, path, dedupe_key FROM inventory
    WHERE dup_of IS NULL AND category <> 'generated'
      AND dedupe_key IN (SELECT dedupe_key FROM keyed_latest WHERE error IS NULL AND rubric_version IS DISTINCT FROM {S.RUBRIC_VERSION})
      AND dedupe_key IN (SELECT dedupe_key FROM keyed_latest WHERE error IS NULL
            AND CASE WHEN extraction_status IS NOT NULL THEN extraction_status <> 'ok' ELSE category NOT IN {O._in(rules.HASHED_CATEGORIES)} END)
      AND dedupe_key IN (SELECT dedupe_key FROM readable)
""")
def rescan_only_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys judged by name alone under another rubric, taken again although they are resolved."""
    inventory, log = A.inventory(spark, folder), A.keyed_log(spark, folder)
    latest = folds.results_latest(log)
    only = selection.all_of(selection.outdated_keys(latest), selection.name_only_keys(latest, inventory))
    return selection.eligible(inventory, folds.resolved_keys(log), only).select("seq", "path", "dedupe_key")


@_query(f"""
    WITH {O.JUDGED} SELECT DISTINCT dedupe_key FROM latest
    WHERE error IS NULL AND CASE WHEN extraction_status IS NOT NULL THEN extraction_status <> 'ok' ELSE category NOT IN {O._in(rules.HASHED_CATEGORIES)} END
      AND (category IN ('text', 'code') OR ext IN {O._in(rules.READABLE_DOCS)} OR (category = 'binary' AND ext NOT IN {O._in(rules.NEVER_SNIFFED)} AND size <= {S.SNIFF_CEILING}))
""")
def name_only_keys(spark: SparkSession, folder: str) -> DataFrame:
    inventory = A.files(spark, folder).withColumn("dedupe_key", F.concat(F.lit("d"), "seq"))
    return selection.name_only_keys(A.judged(spark, folder), inventory)


@_query(f"WITH {O.LATEST} SELECT dedupe_key FROM latest WHERE error IS NULL AND rubric_version IS DISTINCT FROM {S.RUBRIC_VERSION}")
def outdated_rubric(spark: SparkSession, folder: str) -> DataFrame:
    return selection.outdated_keys(_latest(spark, folder))


@_query(f"WITH {O.LATEST}, {O.OCR_LOG} SELECT DISTINCT dedupe_key FROM excerpts WHERE dedupe_key NOT IN (SELECT dedupe_key FROM latest WHERE error IS NULL AND extraction_status = 'ocr')")
def fresh_ocr_keys(spark: SparkSession, folder: str) -> DataFrame:
    return selection.fresh_ocr_keys(folds.ocr_excerpts(A.ocr_log(spark, folder)), _latest(spark, folder))


@_query(f"""
    WITH {O.LATEST}, {O.OCR_LOG} SELECT dedupe_key, coalesce(e.excerpt, 'own') AS excerpt, CASE WHEN e.excerpt IS NOT NULL THEN 'ocr' ELSE extraction_status END AS extraction_status
    FROM latest LEFT JOIN (SELECT dedupe_key, excerpt FROM excerpts) e USING (dedupe_key)
""")
def ocr_override(spark: SparkSession, folder: str) -> DataFrame:
    rows = _latest(spark, folder).withColumn("excerpt", F.lit("own"))
    return selection.with_excerpts(rows, folds.ocr_excerpts(A.ocr_log(spark, folder))).select("dedupe_key", "excerpt", "extraction_status")


@_query("""
    SELECT count(*) AS files, sum(850 + greatest(1, chars // 4))::BIGINT AS tokens, sum(850 + greatest(1, greatest(1, chars // 4) * 2))::BIGINT AS worst_tokens,
           sum(850 + greatest(1, chars // 4))::DOUBLE * 0.042::DOUBLE / 1e6::DOUBLE AS cost,
           sum(850 + greatest(1, greatest(1, chars // 4) * 2))::DOUBLE * 0.042::DOUBLE / 1e6::DOUBLE AS worst_cost
    FROM (SELECT least(length(text), 3000) AS chars FROM documents)
""")
def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return budget.estimate(A.files(spark, folder).select(text.excerpt(F.col("text")).alias("excerpt")))


@_query(f"""
    WITH b AS (SELECT o_orderkey // 100 AS batch, sum(850 + o_orderkey % 500)::BIGINT AS tokens, sum(850 + 2 * (o_orderkey % 500))::BIGINT AS worst_tokens FROM orders GROUP BY 1),
    s AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
    m AS (SELECT *, ({O.spent("before + worst_tokens")} > 0.3)::INT AS over FROM s)
    SELECT batch, tokens, worst_tokens, {O.spent("before")} AS spent_before FROM m QUALIFY sum(over) OVER (ORDER BY batch) = 0
""")
def budget_cut(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey")
    batches = A.table(spark, folder, "orders").groupBy(F.floor(n / 100).alias("batch")).agg(F.sum(n % 500 + 850).alias("tokens"), F.sum(n % 500 * 2 + 850).alias("worst_tokens"))
    return budget.cut_at_cap(batches, cap=0.3)


@_query(f"""
    WITH {O.LOG}, r AS (SELECT *, coalesce(http_status IN (401, 402, 403), false) AS bad FROM log),
    s AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY dedupe_key ORDER BY seq) AS run FROM r)
    SELECT dedupe_key, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS length FROM s WHERE bad GROUP BY dedupe_key, run
""")
def error_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return budget.error_streaks(A.log(spark, folder), "dedupe_key")


@_query(f"""
    WITH {O.LOG}, r AS (SELECT *, coalesce(http_status IN (401, 402, 403), false) AS bad FROM log),
    s AS (SELECT *, sum((NOT bad)::INT) OVER (ORDER BY seq) AS run FROM r)
    SELECT min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS length FROM s WHERE bad GROUP BY run
""")
def log_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """The streaks that open the breaker: over the whole log, whatever file a call was for."""
    return budget.error_streaks(A.log(spark, folder))


@_query(f"""
    WITH {O.LOG} SELECT seq, CASE WHEN error IS NOT NULL THEN 0 ELSE CASE WHEN seq % 3 = 0 THEN 900 ELSE input_tokens END END::BIGINT AS billed FROM log
""")
def billing(spark: SparkSession, folder: str) -> DataFrame:
    reported = F.when(F.col("seq") % 3 != 0, F.col("input_tokens"))
    return A.log(spark, folder).select("seq", money.billed_tokens(F.col("error"), reported, F.lit(900).cast("long")).alias("billed"))


@_query(f"""
    WITH {O.FILES}, big AS (SELECT dir FROM files GROUP BY dir HAVING count(*) >= 10),
    c AS (SELECT dir, ext, count(*) AS n, min(seq) AS first FROM files WHERE dir IN (SELECT dir FROM big) GROUP BY dir, ext)
    SELECT dir AS path, (SELECT count(*) FROM files f WHERE f.dir = c.dir) AS file_count, (SELECT sum(size) FROM files f WHERE f.dir = c.dir)::BIGINT AS total_bytes,
           ext, n FROM c QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, first) <= 15
""")
def prefilter_listing(spark: SparkSession, folder: str) -> DataFrame:
    files = A.files(spark, folder)
    found = listings.listings(files, files)
    return found.select("path", "file_count", "total_bytes", F.explode("extensions").alias("ext", "n"))


@_query(f"WITH {O.FILES} SELECT '/' AS path, source AS child FROM files UNION SELECT '/' || source AS path, lang AS child FROM files")
def child_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return listings.child_dirs(_files(spark, folder)).select("path", F.explode("children").alias("child"))


@_query(f"""
    WITH {O.DECISIONS} SELECT seq, path FROM files
    WHERE dir NOT IN (SELECT d.path FROM decisions d JOIN (SELECT dir FROM files GROUP BY dir HAVING count(*) >= 10) b ON d.path = b.dir WHERE worth_scanning < {S.SKIP_BELOW})
""")
def prefilter_apply(spark: SparkSession, folder: str) -> DataFrame:
    files = A.files(spark, folder)
    asked = files.groupBy(paths.parent(F.col("path")).alias("path")).count().filter(F.col("count") >= S.LISTING_FLOOR)
    return selection.apply_decisions(files, asked, _decisions(spark, folder)).select("seq", "path")


@_query(f"""
    WITH {O.DECISIONS}, asked AS (SELECT dir, count(*) AS n FROM files GROUP BY dir HAVING count(*) >= 10)
    SELECT count(*) AS asked, count(*) FILTER (w < {S.SKIP_BELOW}) AS skipped_dirs, coalesce(sum(n) FILTER (w < {S.SKIP_BELOW}), 0)::BIGINT AS skipped_files
    FROM asked LEFT JOIN (SELECT path, worth_scanning AS w FROM decisions) d ON d.path = asked.dir
""")
def prefilter_outcome(spark: SparkSession, folder: str) -> DataFrame:
    asked = A.files(spark, folder).groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= S.LISTING_FLOOR)
    skipped = F.coalesce(F.col("worth_scanning") < S.SKIP_BELOW, F.lit(False))
    return asked.join(_decisions(spark, folder).select("path", "worth_scanning"), "path", "left").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(skipped).alias("skipped_dirs"), F.coalesce(F.sum(F.when(skipped, F.col("n"))), F.lit(0)).alias("skipped_files"),
    )


_TOP = f"SELECT *, row_number() OVER (ORDER BY value_score DESC, first_seq) AS rank FROM latest WHERE {O.VALID} ORDER BY value_score DESC, first_seq LIMIT 25"


@_query(f"WITH {O.JUDGED} SELECT rank::INTEGER AS rank, path, value_score FROM ({_TOP})")
def overall_topn(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.overall_top(A.judged(spark, folder)).select("rank", "path", "value_score")


@_query(f"WITH {O.JUDGED} SELECT rank::INTEGER AS rank, path, CASE WHEN {O.LABEL} = 'content' THEN 'verified' ELSE 'unverified' END AS section FROM ({_TOP})")
def verified_split_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.split_sections(ranking.overall_top(A.judged(spark, folder))).select("rank", "path", "section")


@_query(f"WITH {O.JUDGED} SELECT category_name, path, probability, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category_name ORDER BY probability DESC, first_seq) AS rank FROM {O.by_category(0.6)}) WHERE rank <= 20")
def category_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.category_top(A.judged(spark, folder)).select("category_name", "path", "probability", "rank")


@_query(f"""
    WITH {O.JUDGED} SELECT dedupe_key FROM ({_TOP})
    UNION SELECT dedupe_key FROM (SELECT *, row_number() OVER (PARTITION BY category_name ORDER BY probability DESC, first_seq) AS rank FROM {O.by_category(0.6)}) WHERE rank <= 20
""")
def surfaced_keys(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.surfaced_keys(A.judged(spark, folder))


_TOP_CATEGORY = "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(S.CATEGORIES)}) THEN '{c}'" for c in S.CATEGORIES) + " ELSE '-' END"


@_query(f"WITH {O.JUDGED} SELECT path, {_TOP_CATEGORY} AS top_category FROM latest")
def top_category(spark: SparkSession, folder: str) -> DataFrame:
    return A.judged(spark, folder).select("path", rules.top_category().alias("top_category"))


@_query(f"WITH {O.JUDGED} SELECT path, {O.LABEL} AS label, {O.included()} AS included FROM latest")
def manifest_inclusion(spark: SparkSession, folder: str) -> DataFrame:
    return A.judged(spark, folder).select("path", rules.verified_label(F.col("extraction_status")).alias("label"), F.coalesce(rules.is_included(), F.lit(False)).alias("included"))


@_query(f"WITH {O.JUDGED} SELECT lower(dir) AS dir_key, lower(split_part(path, '/', 4)) AS name_key, path FROM latest WHERE {O.included()} ORDER BY dir_key, name_key, first_seq")
def copy_list(spark: SparkSession, folder: str) -> DataFrame:
    directory, name, first = ranking.copy_order()
    return outputs.manifest_rows(A.judged(spark, folder)).orderBy(directory, name, first).select(directory.alias("dir_key"), name.alias("name_key"), "path")


@_query(f"""
    WITH {O.JUDGED} SELECT count(*) AS files, count(*) FILTER ({O.VERIFIED}) AS verified, count(*) FILTER (NOT {O.VERIFIED}) AS name_only, coalesce(sum(size), 0)::BIGINT AS bytes,
    {", ".join(f"count(*) FILTER ({c} >= {S.MANIFEST_MIN_PROB}) AS {c}" for c in S.CATEGORIES)} FROM latest WHERE {O.included()}
""")
def manifest_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.manifest_totals(outputs.manifest_rows(A.judged(spark, folder)))


@_query(f"WITH {O.JUDGED} SELECT path, credentials AS credential_prob FROM latest WHERE error IS NULL AND credentials >= {S.CREDENTIAL_WARNING}")
def credentials_warning(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.credential_warnings(A.judged(spark, folder)).select("path", "credential_prob")


@_query(f"WITH {O.JUDGED} SELECT dir, count(*) AS files FROM latest WHERE {O.included()} GROUP BY dir ORDER BY files DESC, min(first_seq) LIMIT 30")
def directory_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.directory_rollup(outputs.manifest_rows(A.judged(spark, folder)))


_NOTABLE = O.included(S.MIN_VALUE, S.REPORT_MIN_PROB)


@_query(f"""
    WITH {O.JUDGED}, v AS (SELECT *, coalesce({_NOTABLE}, false) AS notable FROM latest WHERE {O.VALID}),
    a AS (SELECT *, '/' AS up FROM v UNION ALL SELECT *, '/' || source AS up FROM v UNION ALL SELECT *, dir AS up FROM v)
    SELECT up AS dir, count(*) AS scanned_subtree, count(*) FILTER (notable) AS notable_subtree, count(*) FILTER (notable AND dir = up) AS notable_direct,
    {", ".join(f"count(*) FILTER (notable AND {c} >= {S.REPORT_MIN_PROB}) AS {c}" for c in S.CATEGORIES)},
    max(value_score) FILTER (notable) AS max_value, coalesce(sum(size) FILTER (notable), 0)::BIGINT AS notable_bytes FROM a GROUP BY up
""")
def subtree_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.subtree_rollup(A.judged(spark, folder))


@_query(f"WITH {O.FILES} SELECT seq, unnest(['/', '/' || source, '/' || source || '/' || lang]) AS dir FROM files")
def ancestor_paths(spark: SparkSession, folder: str) -> DataFrame:
    return A.files(spark, folder).select("seq", F.explode(paths.ancestors(F.col("path"))).alias("dir"))


@_query(f"""
    WITH {O.LATEST} SELECT count(*) AS scanned, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER ({O.VALID} AND {_NOTABLE}) AS notable,
    {", ".join(f"count(*) FILTER ({O.VALID} AND {O.LABEL} = '{v}') AS label_{v.replace('-', '_')}" for v in S.VERIFIED_LABELS)},
    count(*) FILTER ({O.VALID} AND credentials >= {S.REPORT_MIN_PROB}) AS credential_hits, {O.spent("sum(coalesce(input_tokens, 0))")} AS spend FROM latest
""")
def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.report_summary(_latest(spark, folder))


@_query(f"WITH {O.JUDGED} SELECT category_name, count(*) AS files, count(*) FILTER ({O.VERIFIED}) AS verified, count(*) FILTER (NOT {O.VERIFIED}) AS name_only FROM {O.by_category(S.REPORT_MIN_PROB)} GROUP BY category_name")
def category_tallies(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.category_tallies(A.judged(spark, folder))


@_query(f"""
    WITH {O.JUDGED}, o AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY value_score DESC, first_seq) AS pos, count(*) OVER (PARTITION BY dir) AS n FROM latest WHERE {O.VALID})
    SELECT dir, path, CASE WHEN pos > 3 THEN n - 3 ELSE 0 END AS hidden FROM o WHERE pos <= 4
""")
def sibling_collapse(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.judged(spark, folder).filter(rules.is_valid()).withColumn("dir", paths.parent(F.col("path")))
    return ranking.collapse_siblings(rows, [], [F.desc("value_score"), F.col("first_seq")]).select("dir", "path", "hidden")


@_query(f"""
    WITH {O.FILES}, o AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY lower(name), seq) - 1 AS i, count(*) OVER (PARTITION BY dir) AS n FROM files)
    SELECT dir AS path, name FROM o WHERE n <= 40 OR list_contains(list_transform(range(40), lambda k: floor(k * (n / 40.0::DOUBLE))::BIGINT), i)
""")
def even_name_sample(spark: SparkSession, folder: str) -> DataFrame:
    return listings.name_sample(_files(spark, folder)).select("path", "name")


@_query(f"""
    WITH {O.JUDGED} SELECT path, value_score, {O.LABEL} AS verified FROM latest WHERE {O.VALID} AND contains(lower(path), 'src1') AND personal >= 0.6 AND {O.LABEL} = 'content'
    ORDER BY value_score DESC, first_seq LIMIT 100
""")
def html_table_filter(spark: SparkSession, folder: str) -> DataFrame:
    return outputs.table_filter(A.judged(spark, folder), "SRC1", "personal", 0.6, "content").select("path", "value_score", "verified")


@_query(f"""
    WITH {O.JUDGED} SELECT path, value_score FROM latest
    WHERE error IS NULL AND CASE WHEN extraction_status IS NOT NULL THEN extraction_status <> 'ok' ELSE category NOT IN {O._in(rules.HASHED_CATEGORIES)} END
      AND ((category = 'image' AND ext IN {O._in(rules.OCR_IMAGES)}) OR (ext = 'pdf' AND extraction_status = 'no_text')) AND value_score >= {S.MIN_VALUE}
    ORDER BY value_score DESC, first_seq LIMIT 200
""")
def ocr_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ocr_candidates(A.judged(spark, folder)).select("path", "value_score")


@_query(f"WITH {O.OCR_LOG}, k AS (SELECT unnest({O._list(S.OCR_STATUSES)}) AS ocr_status) SELECT k.ocr_status, count(l.seq) AS files FROM k LEFT JOIN ocr_log l USING (ocr_status) GROUP BY 1")
def ocr_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.status_counts(A.ocr_log(spark, folder))


@_query(f"""
    WITH {O.JUDGED}, p AS (SELECT credentials AS a, personal AS b FROM latest),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p)
    SELECT floor(corr(ra, rb) * 1e6 + 0.5)::BIGINT AS spearman_millionths, count(*) AS pairs FROM r
""")
def spearman_ranks(spark: SparkSession, folder: str) -> DataFrame:
    pairs = A.judged(spark, folder).select(rules.probability("credentials").alias("a"), rules.probability("personal").alias("b"))
    return metrics.spearman(pairs).select(F.floor(F.col("spearman") * 1e6 + 0.5).alias("spearman_millionths"), "pairs")


@_query(f"""
    WITH {O.JUDGED}, {O.DECISIONS.replace(O.FILES + ",", "")} SELECT count(*) AS files, count(*) FILTER (w) AS wanted, count(*) FILTER (w AND k) AS kept, count(*) FILTER (NOT k) AS saved,
    (count(*) FILTER (w AND k))::DOUBLE / nullif(count(*) FILTER (w), 0) AS recall
    FROM (SELECT coalesce({O.included()}, false) AS w, coalesce(d.worth_scanning, 1.0) >= 0.05 AS k FROM latest LEFT JOIN (SELECT path AS dir, worth_scanning FROM decisions) d USING (dir))
""")
def threshold_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.judged(spark, folder).withColumn("dir", paths.parent(F.col("path")))
    return metrics.threshold_recall(rows, _decisions(spark, folder), S.SKIP_BELOW)


@_query(f"""
    WITH {O.JUDGED} SELECT avg(CASE WHEN (value_score >= 2.0) <> (credentials >= 0.6) THEN 1.0 ELSE 0.0 END)::DOUBLE AS flip_rate, count(*) AS pairs FROM latest WHERE value_score IS NOT NULL
""")
def flip_rate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.flips(A.judged(spark, folder).filter("value_score is not null"), F.col("value_score") >= 2.0, rules.probability("credentials") >= 0.6)


@_query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def strip_tags_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@_query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'), ' ') AS runs FROM documents")
def printable_runs(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "documents").select("doc_id", text.printable_runs(F.col("text")).alias("runs"))


@_query("""
    SELECT doc_id, regexp_replace(regexp_replace('{\\rtf1\\b0 ' || text || '\\par }', '\\\\[a-zA-Z]+-?[0-9]* ?|\\\\''[0-9a-fA-F]{2}', ' ', 'g'), '[{}]', '', 'g') AS plain FROM documents
""")
def rtf_salvage(spark: SparkSession, folder: str) -> DataFrame:
    rich = F.concat(F.lit("{\\rtf1\\b0 "), "text", F.lit("\\par }"))
    return A.table(spark, folder, "documents").select("doc_id", text.salvage_rtf(rich).alias("plain"))


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field_extract(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query(f"""
    WITH {O.JUDGED}, now AS (SELECT dedupe_key, CASE WHEN seq % 2 = 0 THEN 'ok' ELSE 'no_text' END AS now FROM latest)
    SELECT dedupe_key, now AS extraction_status, now <> 'ok' AS metadata_only FROM latest JOIN now USING (dedupe_key) WHERE error IS NULL AND extraction_status IS NULL
""")
def annotate_backfill(spark: SparkSession, folder: str) -> DataFrame:
    latest, inventory = A.judged(spark, folder), A.files(spark, folder).withColumn("dedupe_key", F.concat(F.lit("d"), "seq"))
    now = latest.select("dedupe_key", (F.col("seq") % 2 != 0).alias("metadata_only"), F.when(F.col("seq") % 2 == 0, "ok").otherwise("no_text").alias("extraction_status"))
    appended, _ = annotate.backfill(annotate.annotation_targets(latest, inventory, take_all=True), now)
    return appended.select("dedupe_key", "extraction_status", "metadata_only")


@_query(f"""
    WITH {O.JUDGED} SELECT dedupe_key FROM latest
    WHERE error IS NULL AND extraction_status <> 'ok' AND seq % 2 = 0
""")
def annotate_rescan(spark: SparkSession, folder: str) -> DataFrame:
    latest, inventory = A.judged(spark, folder), A.files(spark, folder).withColumn("dedupe_key", F.concat(F.lit("d"), "seq"))
    now = latest.select("dedupe_key", (F.col("seq") % 2 != 0).alias("metadata_only"), F.when(F.col("seq") % 2 == 0, "ok").otherwise("no_text").alias("extraction_status"))
    return annotate.backfill(annotate.annotation_targets(latest, inventory, take_all=True), now)[1].select("dedupe_key")


@_query(f"""
    WITH {O.JUDGED} SELECT path, size, category, value_score, {_TOP_CATEGORY} AS top_category, {O.LABEL} AS verified, error, {", ".join(S.CATEGORIES)} FROM latest
""")
def report_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    return outputs.report_csv(A.judged(spark, folder)).select("path", "size", "category", "value_score", "top_category", "verified", "error", *S.CATEGORIES)


@_query(f"""
    WITH {O.JUDGED}, c AS (SELECT * FROM {O.by_category(S.MANIFEST_MIN_PROB)} WHERE {O.included()}),
    o AS (SELECT *, row_number() OVER (PARTITION BY category_name, dir ORDER BY probability DESC, first_seq) AS pos, count(*) OVER (PARTITION BY category_name, dir) AS n FROM c),
    k AS (SELECT *, CASE WHEN pos > 3 THEN n - 3 ELSE 0 END AS hidden FROM o WHERE pos <= 4)
    SELECT category_name, path, hidden, CASE WHEN hidden = 0 THEN row_number() OVER (PARTITION BY category_name, hidden > 0 ORDER BY probability DESC, first_seq) END::INTEGER AS rank FROM k
""")
def manifest_categories(spark: SparkSession, folder: str) -> DataFrame:
    return outputs.manifest_categories(A.judged(spark, folder)).select("category_name", "path", "hidden", "rank")


@_query("""
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3
""")
def top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The top-k machinery at the size of lineitem."""
    best = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return A.table(spark, folder, "lineitem").withColumn("r", F.row_number().over(best)).filter("r <= 3").select("l_orderkey", "l_linenumber", "l_extendedprice")


_SIZES = " ".join(f"WHEN n < {1024 ** (p + 1)} THEN round_even(n / {1024**p}.0::DOUBLE, 0)::BIGINT || '{u}'" for p, u in enumerate(("B", "KB", "MB", "GB")))


@_query(f"""
    WITH {O.FILES}, steps AS (SELECT seq, step, size * (1::BIGINT << step) AS n FROM files, (SELECT unnest([0, 10, 19, 30]) AS step))
    SELECT seq, step, CASE {_SIZES} ELSE round_even(n / {1024**4}.0::DOUBLE, 0)::BIGINT || 'TB' END AS shown FROM steps
""")
def format_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Every size, and its multiples by which all units come up."""
    rows = A.files(spark, folder).withColumn("step", F.explode(F.array(*map(F.lit, (0, 10, 19, 30)))))
    return rows.select("seq", "step", rules.format_size(F.col("size") * F.expr("shiftleft(1L, step)")).alias("shown"))


@_query("""
    SELECT page_id, parts[-1] AS name, lower(regexp_extract(parts[-1], '^.+\\.([^.]+)$', 1)) AS ext FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages)
""")
def split_names(spark: SparkSession, folder: str) -> DataFrame:
    """What stands behind the last slash, which may be nothing."""
    name = F.element_at(F.split("url", "/"), -1)
    return A.table(spark, folder, "pages").select("page_id", name.alias("name"), paths.extension(name).alias("ext"))


@_query(f"WITH {O.FILES} SELECT seq, substr(path, length('/src1/') + 1) AS below FROM files WHERE starts_with(path, '/src1/')")
def under_directory(spark: SparkSession, folder: str) -> DataFrame:
    path, top = F.col("path"), F.lit("/src1")
    return A.files(spark, folder).filter(paths.is_under(path, top)).select("seq", paths.relative(path, top).alias("below"))


@_query(f"WITH {O.LATEST} SELECT {O.spent('coalesce(sum(input_tokens), 0)')} AS spend FROM latest")
def estimated_spend(spark: SparkSession, folder: str) -> DataFrame:
    return budget.spend(_latest(spark, folder))


@_query(f"WITH {O.DECISIONS} SELECT dir AS path FROM files GROUP BY dir HAVING count(*) >= 10 AND dir NOT IN (SELECT path FROM decisions WHERE worth_scanning >= 0.1)")
def undecided_directories(spark: SparkSession, folder: str) -> DataFrame:
    asked = A.files(spark, folder).groupBy(paths.parent(F.col("path")).alias("path")).count().filter(F.col("count") >= S.LISTING_FLOOR)
    return selection.undecided(asked.select("path"), _decisions(spark, folder).filter("worth_scanning >= 0.1"))


@_query(f"WITH {O.FILES} SELECT seq, path FROM files WHERE category = 'binary' OR (ext = 'pdf' AND size > 500) UNION ALL SELECT seq, path FROM files WHERE lang = 'de'")
def union_of_roots(spark: SparkSession, folder: str) -> DataFrame:
    rows = _files(spark, folder)
    first = rows.filter((F.col("category") == "binary") | ((F.col("ext") == "pdf") & (F.col("size") > 500)))
    return first.unionByName(rows.filter(paths.name(F.col("dir")) == "de")).select("seq", "path")


@_query(f"""
    WITH {O.JUDGED} SELECT least(floor(value_score), 2)::BIGINT AS bucket, row_number() OVER (PARTITION BY least(floor(value_score), 2) ORDER BY md5(dedupe_key || '{S.SAMPLE_SEED}'), dedupe_key)::INTEGER AS pick, path, value_score
    FROM latest WHERE value_score IS NOT NULL QUALIFY pick <= 20
""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.stratified_sample(A.judged(spark, folder), 20).select("bucket", "pick", "path", "value_score")


@_query()
def local_score_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document judged by the local rules."""
    rows = A.inventory(spark, folder).select("dedupe_key", "path", "size", "mtime", "ext", "category", "seq", text.excerpt(F.col("text")).alias("excerpt"), F.lit(False).alias("metadata_only"), F.lit("ok").alias("extraction_status"))
    return scoring.judge_files(rows, scoring.LocalJudge()).select("seq", "path", "value_score", "input_tokens", "error", "rubric_version")


_STORED = f"""
    WITH {O.FILES}, stored AS (
        SELECT *, row_number() OVER (ORDER BY dir, path) - 1 AS place,
               CASE WHEN category IN {O._in(rules.HASHED_CATEGORIES)} THEN md5(text) || size ELSE 'meta:' || size || ':' || lower(name) END AS key
        FROM files WHERE size >= {S.MIN_SIZE})
"""


@_query(f"{_STORED} SELECT path, size, ext, category, CASE WHEN row_number() OVER w > 1 THEN first_value(path) OVER w END AS dup_of, place AS seq FROM stored WINDOW w AS (PARTITION BY key ORDER BY place)")
def walk_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` written as files and walked: read, hashed and numbered anew."""
    from siftwell.sources import filesystem

    base = A.stored(spark, folder)
    found = filesystem.inventory(spark, [base])[0]
    return found.select(*(F.substring(c, len(base) + 1, 1 << 20).alias(c) for c in ("path",)), "size", "ext", "category", F.expr(f"substring(dup_of, {len(base) + 1})").alias("dup_of"), "seq")


@_query(f"""
    {_STORED}, told AS (SELECT path, CASE WHEN category IN ('text', 'code') THEN 'ok' WHEN ext = 'pdf' THEN 'error' ELSE 'unsupported' END AS extraction_status, text FROM stored)
    SELECT path, extraction_status, extraction_status <> 'ok' AS metadata_only, CASE WHEN extraction_status = 'ok' THEN least(length(text), {S.EXCERPT_CHARS}) END::INTEGER AS chars FROM told
""")
def extract_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts of ``documents`` written as files; those named .pdf are none, and fail."""
    from siftwell.sources import filesystem

    base = A.stored(spark, folder)
    rows = selection.size_floor(filesystem.listed(spark, [base]).filter("error is null")).withColumn("ext", paths.extension(F.col("name"))).withColumn("category", rules.categorize(F.col("ext")))
    return extract.with_excerpts(rows).select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), "extraction_status", "metadata_only", F.length("excerpt").alias("chars"))


_WINDOWS = "'C:\\Data\\' || source || '\\' || lang || '\\' || name"


@_query(f"""
    WITH {O.FILES} SELECT seq, 'C:\\Data\\' || source || '\\' || lang AS up, name, 'C:\\Data\\' || source AS second, '\\\\server\\share\\' || source AS unc_up, {_WINDOWS} AS plain FROM files
""")
def windows_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Drive and network paths taken apart: parent, name, an ancestor, the long prefix stripped."""
    drive = F.concat(F.lit("C:\\Data\\"), F.col("source"), F.lit("\\"), F.col("lang"), F.lit("\\"), F.col("name"))
    share = F.concat(F.lit("\\\\server\\share\\"), F.col("source"), F.lit("\\"), F.col("name"))
    rows = A.files(spark, folder).withColumn("source", F.split("path", "/")[1]).withColumn("lang", F.split("path", "/")[2])
    return rows.select(
        "seq", paths.parent(drive).alias("up"), paths.name(drive).alias("name"), paths.ancestors(drive)[2].alias("second"), paths.parent(share).alias("unc_up"),
        paths.strip_extended(F.concat(F.lit("\\\\?\\"), drive)).alias("plain"),
    )


@_query(f"""
    WITH {O.FILES}, sizes AS (SELECT dir, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY dir HAVING count(*) >= {S.LISTING_FLOOR})
    SELECT dir AS path, n AS file_count, bytes AS total_bytes, least(n, {S.LISTING_NAMES})::INTEGER AS names, 0 AS subdirectories FROM sizes
""")
def listing_state(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON a directory judge is asked with, parsed again."""
    files = A.files(spark, folder)
    kinds = "path string, file_count bigint, total_bytes bigint, file_names_sample array<string>, subdirectory_count int"
    parsed = listings.state(listings.listings(files, files)).select(F.from_json("state", kinds).alias("s"))
    return parsed.select("s.path", "s.file_count", "s.total_bytes", F.size("s.file_names_sample").alias("names"), F.col("s.subdirectory_count").alias("subdirectories"))


@_query(f"""
    WITH {O.JUDGED} SELECT path, split_part(path, '/', 4) AS name, ext, size, CASE WHEN seq % 5 <> 0 THEN 'The content could not be read; judge by name and place.' ELSE 'text of ' || path END AS excerpt,
    seq % 5 <> 0 AS metadata_only, seq % 5 = 0 AS content_readable FROM latest
""")
def file_state(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON a file judge is asked with, parsed again."""
    rows = A.judged(spark, folder).withColumn("excerpt", F.concat(F.lit("text of "), "path")).withColumn("mtime", F.lit(0.0))
    kinds = "path string, name string, ext string, size bigint, excerpt string, metadata_only boolean, content_readable boolean"
    return rows.select(F.from_json(scoring.file_state(), kinds).alias("s")).select("s.*")


@_query(f"""
    WITH {O.JUDGED}, r AS (SELECT value_score AS a, credentials * 3.0::DOUBLE AS b FROM latest WHERE value_score IS NOT NULL)
    SELECT count(*) AS pairs, count(*) FILTER (a >= 2.0 AND b < 2.0) AS lost, count(*) FILTER (a < 2.0 AND b >= 2.0) AS gained,
           (count(*) FILTER (a >= 2.0 AND b >= 2.0))::DOUBLE / nullif(count(*) FILTER (b >= 2.0), 0) AS "precision",
           (count(*) FILTER (a >= 2.0 AND b >= 2.0))::DOUBLE / nullif(count(*) FILTER (a >= 2.0), 0) AS recall FROM r
""")
def threshold_crossings(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.judged(spark, folder).filter("value_score is not null").select(F.col("value_score").alias("a"), (rules.probability("credentials") * 3.0).alias("b"))
    return metrics.crossings(rows, F.col("a") >= S.MIN_VALUE, F.col("b") >= S.MIN_VALUE)


@_query(f"WITH {O.DECISIONS} SELECT 'owner_code' AS kind, count(*) AS directories, sum(file_count)::BIGINT AS files FROM decisions HAVING count(*) > 0")
def kind_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.kinds(_decisions(spark, folder))


@_query(f"""
    WITH {O.JUDGED}, kept AS (SELECT * FROM latest WHERE {O.VALID} AND coalesce({_NOTABLE}, false)),
    dirs AS (SELECT dir AS up, row_number() OVER (ORDER BY min(first_seq)) - 1 AS place FROM kept GROUP BY dir)
    SELECT place AS dir, up || '/' AS dir_path, split_part(path, '/', 4) AS name, size, format('{{:.2f}}', value_score)::DOUBLE AS value, verified,
           {", ".join(f"format('{{:.2f}}', {c})::DOUBLE AS {c}" for c in S.CATEGORIES)}
    FROM (SELECT *, {O.LABEL} AS verified FROM kept) k JOIN dirs ON dirs.up = k.dir
""")
def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files a report page reads, their directories as numbers."""
    return outputs.page_rows(A.judged(spark, folder)).select("dir", "dir_path", "name", "size", "value", "verified", "probs.*")


@_query("SELECT l_orderkey AS id, l_linenumber AS line, format('{:.2f}', n / 800.0::DOUBLE)::DOUBLE AS ties, format('{:.2f}', n / 200.0::DOUBLE)::DOUBLE AS halves FROM (SELECT *, l_orderkey * 7 + l_linenumber AS n FROM lineitem)")
def two_places(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding by exact value: exact ties go to even, other halves the way their binary value lies."""
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return A.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), text.two_places(n / 800).alias("ties"), text.two_places(n / 200).alias("halves"))
