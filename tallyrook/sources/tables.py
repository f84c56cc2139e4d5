"""Tables of a folder, and the records, feedback and graph that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.functions import lifecycle, text
from tallyrook.operators.store import small
from tallyrook.schemas import DAY_MS, KINDS, NOW_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document; what a document lacks follows from its id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    by10 = F.pmod(i, F.lit(10))
    rows = d.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("content"),
        F.array("lang", "source").alias("tags"),
        F.get(F.array(*map(F.lit, KINDS)), F.pmod(i, F.lit(6)).cast("int")).alias("kind"),
        F.when(by10 == 0, "session").when(by10 == 1, "agent").when(by10 == 2, "repository").otherwise("project").alias("scope"),
        F.when(by10 == 0, F.concat(F.lit("s"), F.pmod(i, F.lit(7)))).when(by10 == 1, F.concat(F.lit("a"), F.pmod(i, F.lit(3)))).alias("scope_key"),
        (by10 / 10).alias("importance"),
        (F.pmod(i, F.lit(7)) / 7).alias("confidence"),
        (F.lit(NOW_MS) - F.pmod(i, F.lit(900)) * DAY_MS).alias("updated_ms"),
        ((F.pmod(i, F.lit(53)) == 0) & (by10 != 2)).alias("pinned"),
        ((F.pmod(i, F.lit(77)) == 0) & (by10 != 2)).alias("locked"),
    )
    return rows.withColumns({"title": text.title(F.col("content")), "expires_ms": lifecycle.expires_at(F.col("kind"), F.col("scope"), F.col("updated_ms")), "taxonomy": lifecycle.taxonomy(F.col("scope"), F.col("kind"), F.pmod(i, F.lit(4)) == 0)})


def superseded(records_: DataFrame) -> DataFrame:
    """doc_id and superseded_by: of records with equal content, the one with the largest id supersedes the others.

    Contents meet as digests, aggregated before they are exchanged.
    """
    digests = records_.select("doc_id", F.sha2("content", 256).alias("digest"))
    heads = digests.groupBy("digest").agg(F.max("doc_id").alias("superseded_by"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Few texts have copies: their heads are broadcast after a check, so that a text of very many copies is no hot key.
    return digests.join(small(heads), "digest").filter("doc_id < superseded_by").select("doc_id", "superseded_by")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of feedback by owner: a record's owner is its id modulo 150."""
    kinds = {"injected": "view", "used": "purchase", "ignored": "click", "error": "error"}
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()]
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("owner")).agg(*counts)


def visible(rows: DataFrame, session: str, agent: str) -> DataFrame:
    """Records of a session or an agent are seen with its key only; others always."""
    scope, key = F.col("scope"), F.col("scope_key")
    return rows.filter((~scope.isin("session", "agent")) | ((scope == "session") & key.eqNullSafe(session)) | ((scope == "agent") & key.eqNullSafe(agent)))


def pending_deletes(rows: DataFrame) -> DataFrame:
    """doc_id of records whose deletion is under way."""
    return rows.filter(F.pmod("doc_id", F.lit(61)) == 5).select("doc_id")


def anchors(rows: DataFrame) -> DataFrame:
    """doc_id, path and sha256 of the files that anchored records were learned from: two a record."""
    i = F.col("doc_id")
    path = F.explode(F.array_distinct(F.array(*(F.concat(F.lit("src/"), (F.pmod(n, F.lit(3000)) + 1).cast("string")) for n in (i, i * 7)))))
    own = rows.filter(F.pmod(i, F.lit(4)) == 0).select("doc_id", path.alias("path"))
    return own.withColumn("sha256", F.sha2(F.concat("path", F.lit(" v1")), 256))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, sha256 and bytes of the files as they are now: one a part, every fifth changed, some too large."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), key.cast("string")).alias("path"), F.when(key % 5 == 0, " v2").otherwise(" v1").alias("v"), (F.col("p_size") * 45_000).cast("long").alias("bytes"))
    return rows.select("path", F.sha2(F.concat("path", "v"), 256).alias("sha256"), "bytes")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


# --- the same in SQL ---------------------------------------------------------------------------------------------
_MAP = lambda column, table_: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table_.items()) + " END"

RECORDS_SQL = rf"""
raw AS (
  SELECT doc_id, coalesce(text, '') AS content, [lang, source] AS tags,
    CASE doc_id % 6 {' '.join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS))} END AS kind,
    CASE doc_id % 10 WHEN 0 THEN 'session' WHEN 1 THEN 'agent' WHEN 2 THEN 'repository' ELSE 'project' END AS scope,
    CASE doc_id % 10 WHEN 0 THEN 's' || (doc_id % 7) WHEN 1 THEN 'a' || (doc_id % 3) END AS scope_key,
    CAST(doc_id % 10 AS DOUBLE) / 10 AS importance, CAST(doc_id % 7 AS DOUBLE) / 7 AS confidence,
    {NOW_MS} - (doc_id % 900) * {DAY_MS} AS updated_ms,
    doc_id % 53 = 0 AND doc_id % 10 <> 2 AS pinned, doc_id % 77 = 0 AND doc_id % 10 <> 2 AS locked
  FROM documents
), lined AS (
  SELECT *, coalesce(regexp_replace(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\t-\r \x{{85}}\p{{Z}}]'))[1], '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g'), 'Memory') AS line FROM raw
), mem AS (
  SELECT *, CASE WHEN length(line) > 96 THEN substr(line, 1, 80) || chr(10) || '...[truncated]' ELSE line END AS title,
    updated_ms + CASE WHEN scope = 'session' THEN 7 WHEN kind = 'fact' THEN 365 WHEN kind = 'pattern' THEN 540 WHEN kind = 'gotcha' THEN 730 WHEN kind = 'summary' THEN 30 END * {DAY_MS}::BIGINT AS expires_ms,
    CASE WHEN scope = 'repository' AND kind IN ('decision', 'fact') THEN 'project_standard' WHEN scope = 'repository' THEN 'team_convention'
      WHEN kind = 'decision' THEN 'decision' WHEN kind = 'preference' THEN 'workflow_pref'
      WHEN kind = 'fact' THEN CASE WHEN doc_id % 4 = 0 THEN 'codebase_fact' ELSE 'architecture_fact' END
      WHEN kind = 'pattern' AND doc_id % 4 = 0 THEN 'code_template' WHEN kind IN ('pattern', 'gotcha') THEN 'fix_pattern' ELSE 'session_summary' END AS taxonomy
  FROM lined
), heads AS (SELECT sha256(content) AS digest, max(doc_id) AS head, count(*) AS n FROM mem GROUP BY 1
), superseded AS (SELECT doc_id, head AS superseded_by FROM mem JOIN heads ON digest = sha256(content) WHERE doc_id < head
), feedback AS (
  SELECT user_id AS owner, count(*) FILTER (event_type = 'view') AS injected, count(*) FILTER (event_type = 'purchase') AS used,
    count(*) FILTER (event_type = 'click') AS ignored, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1
), anchor AS (SELECT DISTINCT doc_id, path, sha256(path || ' v1') AS sha256 FROM (SELECT doc_id, 'src/' || (unnest([doc_id, doc_id * 7]) % 3000 + 1) AS path FROM mem WHERE doc_id % 4 = 0)
), file AS (SELECT 'src/' || p_partkey AS path, sha256('src/' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN ' v2' ELSE ' v1' END) AS sha256, p_size * 45000 AS bytes FROM part
), stale AS (SELECT DISTINCT doc_id FROM anchor LEFT JOIN file USING (path) WHERE file.sha256 IS NULL OR file.sha256 <> anchor.sha256 OR bytes > 2097152
)"""
