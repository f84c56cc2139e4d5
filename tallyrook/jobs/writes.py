"""Queries on writes: storing, deleting, purging, optimising; files and snapshots written and read again; generations of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tallyrook.functions import ids
from tallyrook.jobs.catalog import query
from tallyrook.jobs.records import _COLLAPSE
from tallyrook.operators import channels, records, store
from tallyrook.schemas import DAY_MS, KINDS, NOW_MS
from tallyrook.sources import files, generations, tables, versions
from tallyrook.sources.tables import RECORDS_SQL, table

c = F.col
_MID = lambda kind, scope, key, content: f"'mem_' || substr(sha256(concat_ws(chr(0), {kind}, {scope}, coalesce({key}, ''), {content})), 1, 32)"
_FP = lambda kind, scope, key, content: f"sha256(concat_ws(chr(0), {kind}, {scope}, coalesce({key}, ''), {_COLLAPSE.format(content)}))"
_OWN = ("kind", "scope", "scope_key", "content")
_KINDS = ", ".join(f"'{k}'" for k in KINDS)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three records as a store has them: one row an id."""
    rows = tables.records(spark, sf_dir)
    own = rows.filter("doc_id % 3 != 1").join(tables.superseded(rows), "doc_id", "left").withColumn("id", ids.memory_id(*map(c, _OWN)))
    fields = ("kind", "scope", "scope_key", "content", "importance", "tags", (c("updated_ms") - DAY_MS).alias("created_ms"), "updated_ms", "pinned", "locked", c("superseded_by").cast("string").alias("superseded_by"))
    return own.groupBy("id").agg(F.min_by(F.struct(*fields), "doc_id").alias("x")).select("id", "x.*")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request to store a document, now and then one that is not in order."""
    i = c("doc_id")
    rows = tables.records(spark, sf_dir)
    content = F.when(i % 8 == 0, "  ").when(i % 8 == 1, F.concat("content", F.lit(" again"))).otherwise(c("content"))
    title = F.when(i % 17 == 0, F.repeat(F.lit("t"), 200)).otherwise("a title")
    kind = F.when(i % 19 == 0, "rumour").otherwise(c("kind"))
    tags = F.when(i % 29 == 0, F.array_repeat(F.lit("tag"), 13)).otherwise(F.array(F.lit("tag")))
    return rows.select(i.alias("request"), kind.alias("kind"), "scope", "scope_key", content.alias("content"), title.alias("title"), F.when(i % 23 == 0, 1.5).otherwise(c("importance")).alias("importance"), tags.alias("tags"), (i % 5 == 0).alias("revive"))


_STORE_SQL = f"""{RECORDS_SQL}, held AS (
  SELECT {_MID(*_OWN)} AS id, updated_ms - {DAY_MS} AS created_ms, updated_ms, pinned, locked, superseded_by FROM mem LEFT JOIN superseded USING (doc_id) WHERE doc_id % 3 <> 1
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1
), dead AS (SELECT DISTINCT {_FP(*_OWN)} AS fp FROM mem WHERE doc_id % 9 = 0
), req AS (
  SELECT doc_id AS request, CASE WHEN doc_id % 19 = 0 THEN 'rumour' ELSE kind END AS kind, scope, scope_key, CASE WHEN doc_id % 8 = 0 THEN '  ' WHEN doc_id % 8 = 1 THEN content || ' again' ELSE content END AS content,
    doc_id % 17 = 0 AS long_title, doc_id % 23 = 0 AS bad_importance, doc_id % 29 = 0 AS bad_tags, doc_id % 5 = 0 AS revive FROM mem
), told AS (
  SELECT request, {_MID(*(f"req.{x}" for x in _OWN))} AS id, CASE WHEN trim(content) = '' THEN 'empty_content' WHEN length(content) > 6000 THEN 'content_too_long' WHEN contains(content, chr(0)) THEN 'nul' WHEN long_title THEN 'title_too_long'
    WHEN kind NOT IN ({_KINDS}) THEN 'unknown_kind' WHEN bad_importance THEN 'importance_out_of_range' WHEN bad_tags THEN 'bad_tags' WHEN {_FP(*(f"req.{x}" for x in _OWN))} IN (SELECT fp FROM dead) AND NOT revive THEN 'tombstoned' WHEN scope = 'repository' THEN 'repository_managed' END AS code FROM req
), met AS (
  SELECT request, told.id, CASE WHEN code IS NOT NULL THEN code WHEN locked THEN 'locked' WHEN superseded_by IS NOT NULL THEN 'superseded' END AS refused, held.id IS NOT NULL AS known, created_ms, pinned FROM told LEFT JOIN held ON held.id = told.id
), firsts AS (SELECT id, min(request) AS first, max(request) AS last FROM met WHERE refused IS NULL GROUP BY id)"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.records(spark, sf_dir)
    dead = rows.filter("doc_id % 9 = 0").select(ids.fingerprint(*map(c, _OWN)).alias("fingerprint"))
    return records.stored(requests(spark, sf_dir), held(spark, sf_dir), dead, NOW_MS)


@query(f"WITH {_STORE_SQL} SELECT request, met.id, CASE WHEN refused IS NOT NULL THEN refused WHEN known OR request > first THEN 'updated' ELSE 'inserted' END AS outcome FROM met LEFT JOIN firsts USING (id)")
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of requests to store: refused by rules, tombstones or locks, inserted, or updated."""
    return _stored(spark, sf_dir)[0]


@query(f"WITH {_STORE_SQL} SELECT fp AS fingerprint FROM dead WHERE fp NOT IN (SELECT {_FP(*(f'req.{x}' for x in _OWN))} FROM req JOIN met USING (request) WHERE refused IS NULL AND revive)")
def tombstones_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tombstones that are left when requests have revived records."""
    dead = tables.records(spark, sf_dir).filter("doc_id % 9 = 0").select(ids.fingerprint(*map(c, _OWN)).alias("fingerprint")).distinct()
    return records.tombstones_left(requests(spark, sf_dir), _stored(spark, sf_dir)[0], dead)


def _changeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records by id (of copies that share one, the first), with successors."""
    rows = tables.records(spark, sf_dir).withColumn("id", ids.memory_id(*map(c, _OWN)))
    head = tables.superseded(rows).join(rows.select(c("doc_id").alias("superseded_by"), c("id").alias("successor")), "superseded_by").select("doc_id", "successor")
    whole = rows.join(head, "doc_id", "left").select(
        "doc_id", "id", "kind", "scope", "scope_key", "content", "title", "importance", "tags", (c("updated_ms") - DAY_MS).alias("created_ms"), "updated_ms", "pinned", "locked",
        F.when(c("locked"), "held").alias("lock_reason"), F.when(c("successor") != c("id"), c("successor")).alias("superseded_by"), F.array().cast("array<string>").alias("supersedes"),
    )
    return whole.groupBy("id").agg(F.min_by(F.struct(*(x for x in whole.columns if x != "id")), "doc_id").alias("x")).select("id", "x.*")


def _update_requests(rows: DataFrame) -> DataFrame:
    """Two requests for some records: other content, kind, pins, locks, with the revision that was read or an older one; and some for none."""
    i = c("doc_id")
    never = lambda kind: F.lit(None).cast(kind)
    first = rows.select(
        i.alias("request"), F.when(i % 31 == 30, "mem_none").otherwise(c("id")).alias("id"), F.when(i % 7 == 0, c("updated_ms") - 1).when(i % 7 < 5, c("updated_ms")).alias("revision"),
        F.when(i % 11 == 1, "lock").when(i % 11 == 2, "unlock").alias("action"), F.when(i % 11 == 1, "asked for").alias("reason"), F.when(i % 3 == 0, F.concat("content", F.lit(" updated"))).when(i % 3 == 1, "one text").alias("content"),
        never("string").alias("title"), F.when(i % 5 == 0, "fact").when(i % 37 == 1, "rumour").alias("kind"), F.when(i % 4 == 0, 0.75).alias("importance"), never("array<string>").alias("tags"), F.when(i % 13 == 0, True).alias("pinned"),
    )
    again = rows.filter(i % 6 == 0).select(
        (i + 10_000_000).alias("request"), "id", c("updated_ms").alias("revision"), never("string").alias("action"), never("string").alias("reason"), F.concat("content", F.lit(" later")).alias("content"),
        F.lit("later").alias("title"), never("string").alias("kind"), never("double").alias("importance"), never("array<string>").alias("tags"), never("boolean").alias("pinned"),
    )
    return first.unionByName(again)


def _updated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes, the table after the updates, and the one that they have read."""
    rows = store.written(_changeable(spark, sf_dir))
    dead = rows.filter("doc_id % 9 = 0").select(ids.fingerprint(c("kind"), c("scope"), c("scope_key"), F.concat("content", F.lit(" later"))).alias("fingerprint"))
    return *records.updated(_update_requests(rows), rows.drop("doc_id"), dead, NOW_MS), rows.drop("doc_id")


_UPDATE_SQL = f"""{RECORDS_SQL}, ided AS (SELECT *, {_MID(*_OWN)} AS id FROM mem
), whole AS (
  SELECT i.doc_id, i.id, i.kind, i.scope, i.scope_key, i.content, i.title, i.importance, i.updated_ms - {DAY_MS} AS created_ms, i.updated_ms, i.pinned, i.locked, CASE WHEN h.id <> i.id THEN h.id END AS superseded_by
  FROM ided i LEFT JOIN superseded s ON s.doc_id = i.doc_id LEFT JOIN ided h ON h.doc_id = s.superseded_by QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY i.doc_id) = 1
), asked AS (
  SELECT doc_id AS request, CASE WHEN doc_id % 31 = 30 THEN 'mem_none' ELSE id END AS id, CASE WHEN doc_id % 7 = 0 THEN updated_ms - 1 WHEN doc_id % 7 < 5 THEN updated_ms END AS revision,
    CASE WHEN doc_id % 11 = 1 THEN 'lock' WHEN doc_id % 11 = 2 THEN 'unlock' END AS action, CASE WHEN doc_id % 3 = 0 THEN content || ' updated' WHEN doc_id % 3 = 1 THEN 'one text' END AS n_content, NULL AS n_title,
    CASE WHEN doc_id % 5 = 0 THEN 'fact' WHEN doc_id % 37 = 1 THEN 'rumour' END AS n_kind, CASE WHEN doc_id % 4 = 0 THEN 0.75 END AS n_importance, CASE WHEN doc_id % 13 = 0 THEN true END AS n_pinned FROM whole
  UNION ALL SELECT doc_id + 10000000, id, updated_ms, NULL, content || ' later', 'later', NULL, NULL, NULL FROM whole WHERE doc_id % 6 = 0
), m AS (
  SELECT request, asked.id, revision, action, n_content, n_kind, n_title, n_importance, n_pinned, w.id IS NULL AS missing, w.updated_ms, w.superseded_by, w.scope, w.scope_key, w.locked, w.pinned, w.created_ms,
    coalesce(n_content, w.content) AS content, coalesce(n_kind, w.kind) AS kind, coalesce(n_title, w.title) AS title, coalesce(n_importance, w.importance) AS importance FROM asked LEFT JOIN whole w ON w.id = asked.id
), t AS (SELECT *, {_MID("kind", "scope", "scope_key", "content")} AS target, {_FP("kind", "scope", "scope_key", "content")} AS fp FROM m
), dead AS (SELECT {_FP("kind", "scope", "scope_key", "content || ' later'")} AS fp FROM whole WHERE doc_id % 9 = 0
), r AS (
  SELECT *, CASE WHEN missing THEN 'not_found' WHEN revision <> updated_ms THEN 'conflict' WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN scope = 'repository' THEN 'repository_managed'
    WHEN action = 'unlock' AND (n_content IS NOT NULL OR n_title IS NOT NULL OR n_kind IS NOT NULL OR n_importance IS NOT NULL OR n_pinned IS NOT NULL) THEN 'unlock_with_changes'
    WHEN locked AND coalesce(action, '') <> 'unlock' AND (n_content IS NOT NULL OR n_kind IS NOT NULL OR n_pinned IS NOT NULL) THEN 'locked'
    WHEN trim(content) = '' THEN 'empty_content' WHEN length(content) > 6000 THEN 'content_too_long' WHEN contains(content, chr(0)) THEN 'nul' WHEN kind NOT IN ({_KINDS}) THEN 'unknown_kind'
    WHEN fp IN (SELECT fp FROM dead) THEN 'tombstoned' WHEN target <> id AND target IN (SELECT id FROM whole) THEN 'exists' END AS code FROM t
), r1 AS (SELECT * REPLACE (CASE WHEN code IS NULL AND request <> min(CASE WHEN code IS NULL THEN request END) OVER (PARTITION BY id) THEN 'conflict' ELSE code END AS code) FROM r
), r2 AS (SELECT * REPLACE (CASE WHEN code IS NULL AND request <> min(CASE WHEN code IS NULL THEN request END) OVER (PARTITION BY target) THEN 'exists' ELSE code END AS code) FROM r1
), ok AS (SELECT * FROM r2 WHERE code IS NULL)"""


@query(f"WITH {_UPDATE_SQL} SELECT request, id, coalesce(code, CASE WHEN target <> id THEN 'superseded_by_new' ELSE 'in_place' END) AS outcome, CASE WHEN code IS NULL AND target <> id THEN target END AS new_id FROM r2")
def record_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by revision: refused, in conflict with a newer revision, in place, or as a new record that supersedes the old."""
    return _updated(spark, sf_dir)[0]


@query(
    f"""WITH {_UPDATE_SQL} SELECT target AS id, kind, title, importance, created_ms, {NOW_MS}::BIGINT AS updated_ms, coalesce(n_pinned, pinned) AS pinned, CASE action WHEN 'lock' THEN true WHEN 'unlock' THEN false ELSE locked END AS locked, NULL AS superseded_by, CASE WHEN target <> id THEN id ELSE '' END AS supersedes FROM ok
UNION ALL SELECT w.id, w.kind, w.title, w.importance, w.created_ms, CASE WHEN ok.id IS NOT NULL THEN {NOW_MS}::BIGINT ELSE w.updated_ms END, w.pinned, w.locked, coalesce(ok.target, w.superseded_by), '' FROM whole w LEFT JOIN ok ON ok.id = w.id WHERE ok.id IS NULL OR ok.target <> ok.id"""
)
def updated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the updates, committed after the version that they have read."""
    _, table, before = _updated(spark, sf_dir)
    base = store.fresh_path(spark, "store")
    read = versions.commit(before, base)
    versions.commit(table, base, after=read)
    return versions.read(spark, base, table.schema).select("id", "kind", "title", "importance", "created_ms", "updated_ms", "pinned", "locked", "superseded_by", F.array_join("supersedes", ",").alias("supersedes"))


@query(
    f"""WITH {_STORE_SQL}, new AS (SELECT met.id, coalesce(created_ms, {NOW_MS}) AS created_ms, {NOW_MS}::BIGINT AS updated_ms, coalesce(pinned, false) AS pinned FROM met JOIN firsts USING (id) WHERE refused IS NULL AND request = last)
SELECT id, created_ms, updated_ms, pinned, false AS superseded FROM new UNION ALL SELECT id, created_ms, updated_ms, pinned, superseded_by IS NOT NULL FROM held WHERE id NOT IN (SELECT id FROM new)"""
)
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the requests, committed as a version and read again."""
    base = store.fresh_path(spark, "store")
    before = held(spark, sf_dir)
    first = versions.commit(before, base)
    versions.commit(_stored(spark, sf_dir)[1], base, after=first)
    return versions.read(spark, base, before.schema).select("id", "created_ms", "updated_ms", "pinned", c("superseded_by").isNotNull().alias("superseded"))


_DELETE_SQL = f"""{RECORDS_SQL}, linked AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND doc_id + 100 IN (SELECT doc_id FROM mem) THEN doc_id + 100 END AS next FROM mem
), gone AS (SELECT * FROM linked WHERE (doc_id // 100 + doc_id) % 3 = 1 AND scope <> 'repository' AND NOT locked
), walk(node, next, depth) AS (
  SELECT doc_id, next, 0 FROM linked WHERE next IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM gone)
  UNION ALL SELECT node, l.next, depth + 1 FROM walk JOIN gone l ON l.doc_id = walk.next WHERE l.next IS NOT NULL
), ends AS (SELECT node, next FROM walk WHERE next NOT IN (SELECT doc_id FROM gone)
), said AS (SELECT doc_id AS a, doc_id + 3 AS b FROM mem WHERE doc_id % 6 = 1 AND doc_id + 3 IN (SELECT doc_id FROM mem))"""


@query(
    f"""WITH RECURSIVE {_DELETE_SQL}
SELECT 'record' AS part, doc_id, next AS other, NULL AS fingerprint FROM (SELECT doc_id FROM linked WHERE doc_id NOT IN (SELECT doc_id FROM gone)) LEFT JOIN ends ON node = doc_id
UNION ALL SELECT 'conflict', a, b, NULL FROM (SELECT a, b FROM said UNION SELECT b, a FROM said) WHERE a NOT IN (SELECT doc_id FROM gone) AND b NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT DISTINCT 'tombstone', NULL::BIGINT, NULL::BIGINT, {_FP(*_OWN)} FROM gone"""
)
def record_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, conflicts and tombstones after a deletion: predecessors are bridged, conflicts dropped, locked and managed records stay."""
    rows = tables.records(spark, sf_dir)
    known = rows.select("doc_id")
    i = c("doc_id")
    later = known.select((i - 100).alias("doc_id"), i.alias("superseded_by")).filter("doc_id % 4 = 0")
    said = known.filter("doc_id % 6 = 1").select(i.alias("a"), (i + 3).alias("b")).join(known.withColumnRenamed("doc_id", "b"), "b", "left_semi")
    targets = known.filter((F.expr("doc_id div 100") + i) % 3 == 1)
    left, conflicts, dead = records.deleted(rows.join(later, "doc_id", "left"), targets, store.symmetric(said, "a", "b"), NOW_MS)
    none, text_ = F.lit(None).cast("long"), F.lit(None).cast("string")
    return store.union(
        left.select(F.lit("record").alias("part"), "doc_id", c("superseded_by").alias("other"), text_.alias("fingerprint")),
        conflicts.select(F.lit("conflict").alias("part"), c("a").alias("doc_id"), c("b").alias("other"), text_.alias("fingerprint")),
        dead.select(F.lit("tombstone").alias("part"), none.alias("doc_id"), none.alias("other"), "fingerprint"),
    )


@query(f"WITH {RECORDS_SQL} SELECT DISTINCT {_FP(*_OWN)} AS fingerprint, kind, scope, {NOW_MS}::BIGINT AS deleted_ms, 'purge' AS reason FROM mem")
def record_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tombstones that a purge leaves: it takes all records, locked ones too."""
    return records.purged(tables.records(spark, sf_dir), NOW_MS)[1]


@query(f"WITH {RECORDS_SQL} SELECT doc_id, updated_ms FROM mem WHERE NOT (NOT locked AND NOT pinned AND coalesce(expires_ms <= {NOW_MS}, false))")
def record_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an optimisation leaves, written as a new version in fewer files and read again."""
    rows = tables.records(spark, sf_dir)
    base = store.fresh_path(spark, "store")
    kept = records.optimised(rows, NOW_MS).select("doc_id", "updated_ms")
    versions.commit(kept, base, files=max(1, kept.rdd.getNumPartitions() // 4))
    return versions.read(spark, base, kept.schema)


_REQ_SQL = """r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 13 = 0 THEN repeat('q', 2001) WHEN event_id % 17 = 0 THEN 'a' || chr(0) ELSE event_type END AS query, CASE WHEN event_id % 3 = 0 THEN event_id % 25 END AS lim, event_id % 24 AS results, (event_id * 37) % 30000 AS budget, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value / 100 END AS least FROM events)"""


@query(
    f"""WITH {_REQ_SQL} SELECT event_id, CASE WHEN trim(query) = '' THEN 'empty_query' WHEN length(trim(query)) > 2000 THEN 'query_too_long' WHEN contains(query, chr(0)) THEN 'nul' WHEN lim IS NOT NULL AND NOT lim BETWEEN 1 AND 20 THEN 'limit_out_of_range'
  WHEN NOT results BETWEEN 1 AND 20 THEN 'results_out_of_range' WHEN NOT budget BETWEEN 512 AND 24000 THEN 'budget_out_of_range' WHEN least IS NULL OR isnan(least) OR NOT least BETWEEN 0 AND 1 THEN 'score_out_of_range' END AS reject,
  CASE WHEN event_id % 5 = 0 THEN 'no_ids' WHEN event_id % 5 = 1 THEN 'too_many_ids' WHEN event_id % 5 = 2 THEN 'invalid_id' END AS ids_reject FROM r"""
)
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why searches and lists of ids are refused."""
    i = c("event_id")
    text_ = F.when(i % 11 == 0, "  ").when(i % 13 == 0, F.repeat(F.lit("q"), 2001)).when(i % 17 == 0, "a\0").otherwise(c("event_type"))
    good = F.concat(F.lit("mem_"), F.substring(F.sha2(i.cast("string"), 256), 1, 32))
    asked = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array_repeat(good, 101)).when(i % 5 == 2, F.array(good, F.lit("mem_xyz"))).otherwise(F.array(good))
    least = F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(c("value") / 100)
    reject = records.search_reject(text_, F.when(i % 3 == 0, i % 25), i % 24, (i * 37) % 30000, least)
    return table(spark, sf_dir, "events").select("event_id", reject.alias("reject"), records.ids_reject(asked).alias("ids_reject"))


@query(
    f"""WITH {RECORDS_SQL}, id AS (SELECT doc_id, {_MID(*_OWN)} AS id FROM mem), held AS (
  SELECT id, superseded_by IS NULL AS live FROM id LEFT JOIN superseded USING (doc_id) WHERE doc_id % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1
), cand AS (SELECT a.doc_id, a.id, CASE WHEN a.doc_id % 7 = 0 THEN b.id END AS conflict, CASE WHEN a.doc_id % 5 = 0 THEN CASE WHEN a.doc_id % 10 = 0 THEN a.id ELSE d.id END END AS super FROM id a LEFT JOIN id b ON b.doc_id = a.doc_id + 1 LEFT JOIN id d ON d.doc_id = a.doc_id + 2
), checked AS (SELECT doc_id, min(CASE WHEN target = c.id THEN 'self' WHEN h.id IS NULL THEN 'missing' WHEN NOT live THEN 'superseded' END) AS target_reject FROM (SELECT doc_id, id, unnest([conflict, super]) AS target FROM cand) c LEFT JOIN held h ON h.id = target WHERE target IS NOT NULL GROUP BY doc_id)
SELECT cand.doc_id AS candidate, CASE WHEN coalesce(live, false) THEN 'duplicate' WHEN conflict IS NOT NULL THEN 'conflicts' WHEN super IS NOT NULL THEN 'supersedes' ELSE 'novel' END AS novelty, target_reject FROM cand LEFT JOIN held USING (id) LEFT JOIN checked USING (doc_id)"""
)
def capture_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What captured candidates are to the store, and targets that they may not name."""
    rows = tables.records(spark, sf_dir).withColumn("id", ids.memory_id(*map(c, _OWN)))
    i = c("doc_id")
    after = lambda n, name: rows.select((i - n).alias("doc_id"), c("id").alias(name))
    met = rows.join(after(1, "next"), "doc_id", "left").join(after(2, "second"), "doc_id", "left")
    some = lambda x, on: F.when(on & x.isNotNull(), F.array(x))
    asked = met.select(i.alias("candidate"), *_OWN, some(c("next"), i % 7 == 0).alias("conflicts"), some(F.when(i % 10 == 0, c("id")).otherwise(c("second")), i % 5 == 0).alias("supersedes"))
    return records.captured(asked, held(spark, sf_dir)).select("candidate", "novelty", "target_reject")


@query(
    f"""WITH {RECORDS_SQL}, up AS (SELECT doc_id FROM mem WHERE doc_id % 3 = 0
), back AS (SELECT doc_id - 1 AS doc_id, doc_id AS successor FROM up WHERE doc_id - 1 IN (SELECT doc_id FROM mem)
), said AS (SELECT doc_id AS a, doc_id + 4 AS b FROM up WHERE doc_id % 2 = 0 AND doc_id + 4 IN (SELECT doc_id FROM mem)
), n AS (SELECT a AS doc_id, array_to_string(list_sort(list_distinct(list(b))), ',') AS conflict_with FROM (SELECT a, b FROM said UNION SELECT b, a FROM said) GROUP BY a)
SELECT doc_id, round(CASE WHEN conflict_with IS NOT NULL THEN least(confidence, 0.5) ELSE confidence END, 9) AS confidence, coalesce(successor, superseded_by) AS superseded_by, conflict_with, CASE WHEN successor IS NOT NULL OR conflict_with IS NOT NULL OR doc_id % 3 = 0 THEN {NOW_MS} ELSE updated_ms END AS updated_ms
FROM mem LEFT JOIN superseded USING (doc_id) LEFT JOIN back USING (doc_id) LEFT JOIN n USING (doc_id)"""
)
def batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after a batch of upserts that name predecessors and conflicts."""
    rows = tables.records(spark, sf_dir)
    i = c("doc_id")
    known = rows.select("doc_id")
    there = lambda n, name: known.select((i - n).alias("doc_id"), i.alias(name))
    met = known.filter("doc_id % 3 = 0").join(there(-1, "before"), "doc_id", "left").join(there(4, "other"), "doc_id", "left")
    some = lambda x, on: F.when(on & x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<long>"))
    said = met.select("doc_id", some(c("before"), F.lit(True)).alias("supersedes"), some(c("other"), i % 2 == 0).alias("conflicts"))
    out = records.linked(rows.select("doc_id", "confidence", "updated_ms").join(tables.superseded(rows), "doc_id", "left"), said.select("doc_id"), said, NOW_MS)
    return out.withColumns({"conflict_with": F.array_join("conflict_with", ","), "confidence": F.round("confidence", 9)})


_UPDATE_SQL = f"""{RECORDS_SQL}, u AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'lock' WHEN 1 THEN 'unlock' END AS action, CASE WHEN doc_id % 6 = 0 OR doc_id % 11 = 2 THEN 'why' END AS reason, CASE doc_id % 5 WHEN 0 THEN ['content'] WHEN 1 THEN ['importance', 'pinned'] WHEN 2 THEN ['tags'] ELSE [] END AS changes, doc_id % 5 = 1 AS pin FROM mem)"""


@query(
    f"""WITH {_UPDATE_SQL} SELECT doc_id, CASE WHEN reason IS NOT NULL AND action IS DISTINCT FROM 'lock' THEN 'reason_without_lock' WHEN action = 'unlock' AND len(changes) > 0 THEN 'unlock_with_changes'
  WHEN locked AND action IS DISTINCT FROM 'unlock' AND list_has_any(changes, ['content', 'scope', 'kind', 'expiry', 'code_paths', 'pinned']) THEN 'locked' WHEN scope = 'repository' AND (pin OR coalesce(action = 'lock', false)) THEN 'repository_managed' END AS reject FROM u"""
)
def update_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why updates of fields, pins and locks are refused."""
    i = c("doc_id")
    changes = F.when(i % 5 == 0, F.array(F.lit("content"))).when(i % 5 == 1, F.array(F.lit("importance"), F.lit("pinned"))).when(i % 5 == 2, F.array(F.lit("tags"))).otherwise(F.array().cast("array<string>"))
    reject = records.update_reject(F.when(i % 4 == 0, "lock").when(i % 4 == 1, "unlock"), F.when((i % 6 == 0) | (i % 11 == 2), "why"), changes, c("locked"), c("scope"), i % 5 == 1)
    return tables.records(spark, sf_dir).select("doc_id", reject.alias("reject"))


_VERDICT_SQL = """o AS (SELECT o_orderkey AS node, o_custkey, lead(o_orderkey) OVER w AS later, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), link AS (SELECT node, CASE WHEN node % 97 = 0 THEN node WHEN node % 89 = 0 THEN -node WHEN later IS NOT NULL THEN later WHEN o_custkey % 10 = 0 THEN first END AS target FROM o
), real AS (SELECT node, target FROM link WHERE target IS NOT NULL AND target <> node AND target IN (SELECT o_orderkey FROM orders)
), walk(node, here, depth) AS (SELECT node, target, 1 FROM real UNION ALL SELECT walk.node, real.target, depth + 1 FROM walk JOIN real ON real.node = walk.here WHERE depth < 120
), round AS (SELECT DISTINCT node FROM walk WHERE depth = 120)"""


@query(f"WITH RECURSIVE {_VERDICT_SQL} SELECT node, target, CASE WHEN node = target THEN 'self' WHEN target < 0 THEN 'dangling' WHEN node IN (SELECT node FROM round) THEN 'cycle' ELSE 'ok' END AS verdict FROM link WHERE target IS NOT NULL")
def supersession_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of versions that lead to themselves, to nothing, in circles, or to an end."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = c("node")
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("node"), "o_custkey", F.lead("o_orderkey").over(w).alias("later"), F.first("o_orderkey").over(w).alias("first"))
    target = F.when(k % 97 == 0, k).when(k % 89 == 0, -k).when(c("later").isNotNull(), c("later")).when(c("o_custkey") % 10 == 0, c("first"))
    links = store.cut(o.select("node", target.alias("target")).filter("target IS NOT NULL"))
    return records.violations(links, o.select("node"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), h AS (SELECT l_orderkey, l_linenumber, sha256(CASE WHEN l_orderkey % 6 = 0 AND l_linenumber = 2 THEN 'new ' || l_partkey ELSE '' || l_partkey END) AS now, CASE WHEN l_orderkey % 9 <> 0 OR l_linenumber < 3 THEN sha256('' || l_partkey) END AS then_ FROM l)
SELECT 'doc/' || l_orderkey AS path, bool_and(coalesce(now = then_, false)) AS reuse, count(*) AS chunks FROM h GROUP BY l_orderkey"""
)
def ingest_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose chunks are all held as they are: nothing of them is embedded again."""
    k, n, own = c("l_orderkey"), c("l_linenumber"), c("l_partkey").cast("string")
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    lines = parts.withColumns({"path": F.concat(F.lit("doc/"), k.cast("string")), "kind": F.lit("summary")})
    chunks = lines.select("path", n.alias("chunk"), "kind", F.sha2(F.when((k % 6 == 0) & (n == 2), F.concat(F.lit("new "), own)).otherwise(own), 256).alias("content_hash"))
    old = lines.filter((k % 9 != 0) | (n < 3)).select("path", n.alias("chunk"), "kind", F.sha2(own, 256).alias("content_hash"))
    return records.reusable(chunks, old)


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v)
SELECT vec_id, 'g2' AS generation, len(v) AS dimensions, round(v[1] / norm, 6) AS first_value, round(list_inner_product(list_transform(v, lambda x: x / norm), list_transform(v, lambda x: x / norm)), 6) AS norm FROM n"""
)
def generation_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new generation of vectors (the first 32 dimensions, at norm 1), in a switch that is taken up anew before each of its steps."""
    base, schema = _with_vectors(spark, sf_dir)
    _switch(spark, base, "to_g2", 32).begin("g2", schema, "vec_id", 32)
    while _switch(spark, base, "to_g2", 32).step() not in generations.TERMINAL:
        pass
    now = generations.vectors(spark, base).withColumn("generation", F.lit(generations.active(spark, base)["generation"]))
    return now.select("vec_id", "generation", F.size("vector").alias("dimensions"), F.round(F.get("vector", 0), 6).alias("first_value"), F.round(channels.dot(c("vector"), c("vector")), 6).alias("norm"))


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[str, StructType]:
    """A versioned table of the vectors, in a few files, and its schema."""
    base = store.fresh_path(spark, "vectors")
    old = tables.embeddings(spark, sf_dir).select("vec_id", "vector")
    versions.commit(old.repartition(3), base)
    return base, old.schema


def _switch(spark: SparkSession, base: str, name: str, dimensions: int) -> generations.Switch:
    return generations.Switch(spark, base, name, lambda rows: rows.select("vec_id", channels.renormalised(c("vector"), dimensions).alias("vector")))


_PATH = "queued,validating,reindexing,reindexing,reindexing,verifying"


@query(
    f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 50 <> 3) AS kept FROM embeddings)
SELECT 'finished' AS run, '{_PATH},committing,succeeded' AS phases, CAST(NULL AS VARCHAR) AS code, 'g2' AS active, n AS vectors FROM n
UNION ALL SELECT 'same_generation', 'queued,validating,failed', 'SAME_GENERATION', 'g2', n FROM n
UNION ALL SELECT 'unsound', '{_PATH},failed', 'TARGET_VECTOR_INVALID', 'g2', n FROM n
UNION ALL SELECT 'incomplete', '{_PATH},failed', CASE WHEN kept < n THEN 'TARGET_INCOMPLETE' END, 'g2', n FROM n
UNION ALL SELECT 'cancelled', 'queued,validating,reindexing,cancel_requested,cancelled', NULL, 'g2', n FROM n
UNION ALL SELECT 'second', '{_PATH},committing,succeeded', NULL, 'g3', n FROM n
UNION ALL SELECT 'rolled_back', '', NULL, 'g2', n FROM n
UNION ALL SELECT 'written_meanwhile', 'queued,validating,reindexing,failed', 'SOURCE_CHANGED', 'g2', n FROM n"""
)
def generation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of one table, one after the other: their phases, why they failed, the generation that is active after each, and its vectors."""
    base, schema = _with_vectors(spark, sf_dir)
    out = []

    def report(run: str, switch: generations.Switch | None) -> None:
        path = switch.history() if switch else []
        now = generations.active(spark, base)["generation"]
        out.append(generations.vectors(spark, base).agg(F.lit(run).alias("run"), F.lit(",".join(x["phase"] for x in path)).alias("phases"), F.lit(path[-1].get("code") if path else None).cast("string").alias("code"), F.lit(now).alias("active"), F.count("*").alias("vectors")))

    def begun(run: str, generation: str, embed: generations.Embed | None = None) -> generations.Switch:
        own = _switch(spark, base, run, 32)
        own.embed = embed or own.embed
        return own.begin(generation, schema, "vec_id", 32, batch_bytes=1)

    half = lambda rows: rows.select("vec_id", F.transform(channels.renormalised(c("vector"), 32), lambda x: x / 2).alias("vector"))
    less = lambda rows: rows.filter("vec_id % 50 <> 3").select("vec_id", channels.renormalised(c("vector"), 32).alias("vector"))
    for run, generation, embed in (("finished", "g2", None), ("same_generation", "g2", None), ("unsound", "g3", half), ("incomplete", "g3", less)):
        own = begun(run, generation, embed)
        own.run()
        report(run, own)
    own = begun("cancelled", "g3")
    while own.now().content["phase"] != "reindexing":
        own.step()
    own.cancel()
    own.run()
    report("cancelled", own)
    own = begun("second", "g3")
    own.run()
    report("second", own)
    generations.roll_back(spark, base)
    report("rolled_back", None)
    own = begun("written_meanwhile", "g4")
    while own.now().content["phase"] != "reindexing":
        own.step()
    at = versions.current_version(spark, base)
    versions.commit(versions.read(spark, base, schema), base, after=at)
    own.run()
    report("written_meanwhile", own)
    return store.union(*out)


_SNAPSHOT = "id string, doc_id long, kind string, scope string, scope_key string, title string, content string, tags array<string>, updated_ms long, superseded_by long"


@query(
    f"""WITH {RECORDS_SQL}, out_ AS (SELECT * FROM mem LEFT JOIN superseded USING (doc_id) WHERE doc_id % 2 = 0 OR scope <> 'session'), dead AS (SELECT DISTINCT {_FP(*_OWN)} AS fp FROM mem WHERE doc_id % 9 = 0)
SELECT doc_id, {_MID(*_OWN)} AS id, CASE WHEN superseded_by IN (SELECT doc_id FROM out_) THEN superseded_by END AS superseded_by, CASE WHEN {_FP(*_OWN)} IN (SELECT fp FROM dead) THEN 'tombstoned' ELSE 'imported' END AS verdict, sha256(title || chr(10) || content) AS sha256 FROM out_"""
)
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written as JSON lines beside its tombstones, read with a schema, its ids derived again, and what an import makes of each row."""
    rows = tables.records(spark, sf_dir)
    out = rows.filter("doc_id % 2 = 0 OR scope != 'session'")
    links = tables.superseded(rows).join(out.select(c("doc_id").alias("superseded_by")), "superseded_by", "left_semi")
    own = ids.memory_id(*map(c, _OWN))
    base = store.fresh_path(spark, "snapshot")
    snapshot = out.join(links, "doc_id", "left").select(own.alias("id"), "doc_id", "kind", "scope", "scope_key", "title", "content", "tags", "updated_ms", "superseded_by")
    files.write_lines(snapshot, f"{base}/records")
    files.write_lines(rows.filter("doc_id % 9 = 0").select(ids.fingerprint(*map(c, _OWN)).alias("fingerprint"), "kind").distinct(), f"{base}/tombstones")
    back = files.read_lines(spark, f"{base}/records", _SNAPSHOT, files.manifest(spark, f"{base}/records"), "doc_id")
    dead = spark.read.schema("fingerprint string, kind string").json(f"{base}/tombstones").select("fingerprint", F.lit(True).alias("dead")).distinct()
    met = back.withColumn("fingerprint", ids.fingerprint(*map(c, _OWN))).join(dead, "fingerprint", "left")
    there = back.select(c("doc_id").alias("superseded_by"), F.lit(True).alias("there"))
    met = met.join(there, "superseded_by", "left")
    verdict = F.when(c("id") != own, "id_mismatch").when(c("superseded_by").isNotNull() & c("there").isNull(), "missing_relation").when(c("dead"), "tombstoned").otherwise("imported")
    return met.select("doc_id", "id", "superseded_by", verdict.alias("verdict"), F.sha2(F.concat("title", F.lit("\n"), "content"), 256).alias("sha256"))


_LINE = lambda x: f"regexp_replace(coalesce({x}, ''), '[\\t-\\r ]+', ' ', 'g')"


@query(
    f"""WITH {RECORDS_SQL}, f AS (SELECT doc_id, kind, {_LINE("title")} AS title, content, '---' || chr(10) || 'title: ' || {_LINE("title")} || chr(10) || 'kind: ' || kind || chr(10) || 'tags: ' || array_to_string(tags, ', ') || chr(10) || '---' || chr(10) || content AS file FROM mem WHERE scope = 'repository')
SELECT 'record-' || doc_id AS name, octet_length(encode(file)) AS bytes, sha256(file) AS sha256, CASE WHEN octet_length(encode(file)) > 65536 THEN 'too_large' WHEN trim(title) = '' THEN 'title_missing' ELSE 'ok' END AS verdict, {_MID("kind", "'repository'", "NULL", "content")} AS id FROM f"""
)
def shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository records promoted to Markdown files, discovered, inspected and parsed again."""
    rows = tables.records(spark, sf_dir).filter("scope = 'repository'")
    folder = store.fresh_path(spark, "shared")
    files.promote(rows.select(F.concat(F.lit("record-"), "doc_id").alias("name"), files.markdown(c("title"), c("kind"), c("tags"), c("content")).alias("file")), folder)
    name = F.regexp_extract("path", r"path=([^/]+)/", 1)
    # the text writer ends each file with its separator, a zero byte
    found = files.discovered(spark, folder, "*.txt").withColumns({"content": F.expr("substring(content, 1, length(content) - 1)"), "bytes": c("bytes") - 1})
    held_ = files.inspected(found, files.SHARED_BYTES).withColumn("text", c("content").cast("string"))
    done = files.parsed(held_)
    return done.select(name.alias("name"), "bytes", "sha256", F.coalesce("reject", "verdict").alias("verdict"), files.shared_id(c("kind"), c("body")).alias("id"))


@query("SELECT item_id, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS sha256 FROM benchmark")
def corpus_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as JSON lines with a manifest of hashes, read again: files that differ, or an item that stands twice, are errors."""
    folder = store.fresh_path(spark, "corpus")
    files.write_lines(table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")), folder)
    pinned = store.cut(files.manifest(spark, folder))
    return files.read_lines(spark, folder, "item_id long, text string", pinned, "item_id").select("item_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))
