"""Writes of records as transitions of tables: validation, storing, deleting, purging, optimising, capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.functions import ids, lifecycle
from tallyrook.operators import store
from tallyrook.schemas import BUDGET, CONTENT_CHARS, IDS, KINDS, MAX_BUDGET_CHARS, MIN_BUDGET_CHARS, QUERY_CHARS, RESULTS, STORED_TITLE_CHARS, TAG_CHARS, TAGS

c = F.col


def request_reject(content: Column, title: Column, kind: Column, importance: Column, tags: Column) -> Column:
    """Why a request to store is refused, or null."""
    long_tag = F.exists(tags, lambda t: (F.length(F.trim(t)) == 0) | (F.length(t) > TAG_CHARS))
    return (
        F.when(F.coalesce(F.trim(content), F.lit("")) == "", "empty_content")
        .when(F.length(content) > CONTENT_CHARS, "content_too_long")
        .when(content.contains("\0") | F.coalesce(title.contains("\0"), F.lit(False)), "nul")
        .when(F.length(title) > STORED_TITLE_CHARS, "title_too_long")
        .when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown_kind")
        .when(importance.isNull() | F.isnan(importance) | (importance < 0) | (importance > 1), "importance_out_of_range")
        .when(F.coalesce((F.size(tags) > TAGS) | long_tag, F.lit(False)), "bad_tags")
    )


def search_reject(query: Column, limit: Column, results: Column, budget: Column, least: Column) -> Column:
    """Why a search is refused, or null."""
    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", "empty_query")
        .when(F.length(F.trim(query)) > QUERY_CHARS, "query_too_long")
        .when(query.contains("\0"), "nul")
        .when(limit.isNotNull() & ~limit.between(1, RESULTS), "limit_out_of_range")
        .when(~results.between(1, RESULTS), "results_out_of_range")
        .when(~budget.between(MIN_BUDGET_CHARS, MAX_BUDGET_CHARS), BUDGET)
        .when(least.isNull() | F.isnan(least) | ~least.between(0.0, 1.0), "score_out_of_range")
    )


def ids_reject(asked: Column) -> Column:
    """Why a list of record ids is refused, or null."""
    bad = F.exists(asked, lambda x: ~F.coalesce(x.rlike("^mem_[0-9a-fA-F]{32}$"), F.lit(False)))
    return F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, "no_ids").when(F.size(asked) > IDS, "too_many_ids").when(bad, "invalid_id")


def stored(requests: DataFrame, records: DataFrame, tombstones: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The outcome of each request, and the table of records after all of them.

    requests: request (their order), kind, scope, scope_key, content, title, importance, tags, revive; records: id, kind, scope, scope_key,
    content, importance, tags, created_ms, updated_ms, pinned, locked, superseded_by; tombstones: fingerprint. A record that is written again
    keeps when it was made and whether it is pinned; of several requests for one id the last stays.
    """
    own = (c("kind"), c("scope"), c("scope_key"), c("content"))
    asked = requests.withColumns({"id": ids.memory_id(*own), "fingerprint": ids.fingerprint(*own), "invalid": request_reject(c("content"), c("title"), c("kind"), c("importance"), c("tags"))})
    dead = tombstones.select("fingerprint", F.lit(True).alias("dead")).distinct()
    known = records.select("id", F.lit(True).alias("known"), c("created_ms").alias("made"), c("pinned").alias("was_pinned"), c("locked").alias("was_locked"), c("superseded_by").alias("successor"))
    met = asked.join(dead, "fingerprint", "left").join(known, "id", "left")
    refused = (
        F.when(c("invalid").isNotNull(), c("invalid"))
        .when(c("dead") & ~c("revive"), "tombstoned")
        .when(c("scope") == "repository", "repository_managed")
        .when(c("was_locked"), "locked")
        .when(c("successor").isNotNull(), "superseded")
    )
    told = store.cut(met.withColumn("refused", refused))
    taken = told.filter("refused IS NULL")
    first = taken.groupBy("id").agg(F.min("request").alias("first"), F.max("request").alias("last"))
    outcome = F.when(c("refused").isNotNull(), c("refused")).when(c("known").isNotNull() | (c("request") > c("first")), "updated").otherwise("inserted")
    outcomes = told.join(first, "id", "left").select("request", "id", outcome.alias("outcome"))
    new = taken.join(first, "id").filter("request = last").select(
        "id", "kind", "scope", "scope_key", "content", "importance", "tags", F.coalesce("made", F.lit(now_ms)).alias("created_ms"),
        F.lit(now_ms).cast("long").alias("updated_ms"), F.coalesce("was_pinned", F.lit(False)).alias("pinned"), F.lit(False).alias("locked"), F.lit(None).cast("string").alias("superseded_by"),
    )
    return outcomes, records.join(new, "id", "left_anti").select(*new.columns).unionByName(new)


def tombstones_left(requests: DataFrame, outcomes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """tombstones (fingerprint, ...) without those that requests with revive, as stored() has taken them, have lifted."""
    own = ids.fingerprint(c("kind"), c("scope"), c("scope_key"), c("content"))
    taken = outcomes.filter(c("outcome").isin("inserted", "updated")).select("request")
    lifted = requests.filter("revive").join(taken, "request", "left_semi").select(own.alias("fingerprint")).distinct()
    return tombstones.join(lifted, "fingerprint", "left_anti")


_RECORD = ("id", "kind", "scope", "scope_key", "content", "title", "importance", "tags", "created_ms", "updated_ms", "pinned", "locked", "lock_reason", "superseded_by", "supersedes")
_PATCH = ("content", "title", "kind", "importance", "tags", "pinned")


def updated(requests: DataFrame, records: DataFrame, tombstones: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The outcome (request, id, outcome, new_id) of each request to change a record, and the table of records after all of them.

    requests: request (their order), id, revision (the updated_ms that was read; null: whatever there is), action (lock, unlock or null),
    reason, and new values, null where there is none; records: _RECORD; tombstones: fingerprint. Rows are merged whole. A record whose
    identity changes is a new one that keeps when it was made, and supersedes the old one, which points to it and is touched. Of several
    requests for one record the first that can be granted is; for the others it has changed since it was read. A new identity that is
    there already, or that an earlier request takes, is refused.
    """
    asked = requests.select("request", "id", "revision", "action", "reason", *(c(x).alias(f"new_{x}") for x in _PATCH))
    met = asked.join(records.select(*_RECORD, F.lit(True).alias("there")), "id", "left")
    changes = F.filter(F.array(*(F.when(c(f"new_{x}").isNotNull(), F.lit(x)) for x in _PATCH)), lambda x: x.isNotNull())
    merged = met.withColumn("changes", changes).withColumns({x: F.coalesce(f"new_{x}", x) for x in _PATCH if x != "pinned"})
    own = (c("kind"), c("scope"), c("scope_key"), c("content"))
    named = merged.withColumns({"target": ids.memory_id(*own), "fingerprint": ids.fingerprint(*own)})
    dead = tombstones.select("fingerprint", F.lit(True).alias("dead")).distinct()
    known = records.select(c("id").alias("target"), F.lit(True).alias("taken"))
    wrong = update_reject(c("action"), c("reason"), c("changes"), F.coalesce("locked", F.lit(False)), c("scope"), c("new_pinned"))
    bad = request_reject(c("content"), c("title"), c("kind"), c("importance"), c("tags"))
    alone = (
        F.when(c("there").isNull(), "not_found")
        .when(c("revision").isNotNull() & (c("revision") != c("updated_ms")), "conflict")
        .when(c("superseded_by").isNotNull(), "superseded")
        .when(c("scope") == "repository", "repository_managed")
        .when(wrong.isNotNull(), wrong)
        .when(bad.isNotNull(), bad)
    )
    # Whole rows are merged and written once; what becomes of a request is found from its keys, and granted ones meet their rows at the end.
    whole = store.written(named.withColumn("alone", alone).select("request", "action", "reason", "target", "fingerprint", "alone", "new_pinned", *_RECORD))
    refused = F.when(c("alone").isNotNull(), c("alone")).when(c("dead"), "tombstoned").when((c("target") != c("id")) & c("taken"), "exists")
    keys = whole.select("request", "id", "target", "fingerprint", "alone")
    told = store.cut(keys.join(dead, "fingerprint", "left").join(known, "target", "left").select("request", "id", "target", refused.alias("refused")))
    first = told.filter("refused IS NULL").groupBy("id").agg(F.min("request").alias("first"))
    one = told.join(first, "id", "left").withColumn("refused", F.when(c("refused").isNull() & (c("request") != c("first")), "conflict").otherwise(c("refused"))).drop("first")
    owner = one.filter("refused IS NULL").groupBy("target").agg(F.min("request").alias("owner"))
    last = store.cut(one.join(owner, "target", "left").withColumn("refused", F.when(c("refused").isNull() & (c("request") != c("owner")), "exists").otherwise(c("refused"))))
    moved = c("target") != c("id")
    outcome = F.when(c("refused").isNotNull(), c("refused")).when(moved, "superseded_by_new").otherwise("in_place")
    outcomes = last.select("request", "id", outcome.alias("outcome"), F.when(c("refused").isNull() & moved, c("target")).alias("new_id"))
    granted = whole.join(last.filter("refused IS NULL").select("request", "id"), ["request", "id"], "left_semi")
    locked = F.when(c("action") == "lock", True).when(c("action") == "unlock", False).otherwise(c("locked"))
    reason = F.when(c("action") == "lock", c("reason")).when(c("action") == "unlock", F.lit(None)).otherwise(c("lock_reason"))
    now = F.lit(now_ms).cast("long")
    given = {
        "id": c("target"), "updated_ms": now, "pinned": F.coalesce("new_pinned", "pinned"), "locked": locked, "lock_reason": reason,
        "superseded_by": F.lit(None).cast("string"), "supersedes": F.when(moved, F.array("id")).otherwise(c("supersedes")),
    }
    new = granted.select(*(given.get(x, c(x)).alias(x) for x in _RECORD))
    back = granted.select("id", F.when(moved, c("target")).alias("successor"))
    held = records.select(*_RECORD).join(back, "id", "left").join(new.select("id", F.lit(True).alias("replaced")), "id", "left").filter("replaced IS NULL")
    touched = {"superseded_by": F.coalesce("successor", "superseded_by"), "updated_ms": F.when(c("successor").isNotNull(), now).otherwise(c("updated_ms"))}
    return outcomes, held.select(*(touched.get(x, c(x)).alias(x) for x in _RECORD)).unionByName(new)


def delete_refused(scope: Column, locked: Column) -> Column:
    return lifecycle.lock_rule(F.lit("delete"), scope, locked)


def deleted(records: DataFrame, targets: DataFrame, conflicts: DataFrame, now_ms: int, reason: str = "user") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, conflicts and new tombstones after targets (doc_id) are deleted, but for those that may not be.

    records: doc_id, kind, scope, scope_key, content, locked, superseded_by; conflicts: a, b, both ways. What was superseded by a deleted
    record is superseded by its successor; conflicts with it are dropped.
    """
    gone = store.cut(records.join(targets, "doc_id", "left_semi").filter(delete_refused(c("scope"), c("locked")).isNull()))
    dead = gone.select("doc_id")
    links = records.filter("superseded_by IS NOT NULL").select(c("doc_id").alias("node"), c("superseded_by").alias("next"))
    repaired = store.bridged(links, dead.withColumnRenamed("doc_id", "node")).select(c("node").alias("doc_id"), c("next").alias("superseded_by"))
    left = records.drop("superseded_by").join(dead, "doc_id", "left_anti").join(repaired, "doc_id", "left")
    for side in ("a", "b"):
        conflicts = conflicts.join(dead.withColumnRenamed("doc_id", side), side, "left_anti")
    print_ = ids.fingerprint(c("kind"), c("scope"), c("scope_key"), c("content"))
    tombstones = gone.select(print_.alias("fingerprint"), "kind", "scope", F.lit(now_ms).cast("long").alias("deleted_ms"), F.lit(reason).alias("reason")).dropDuplicates(["fingerprint"])
    return left, conflicts.select("a", "b"), tombstones


def purged(records: DataFrame, now_ms: int, tombstones: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nothing, locks or not, and the tombstones of what there was, if they are wanted."""
    print_ = ids.fingerprint(c("kind"), c("scope"), c("scope_key"), c("content"))
    dead = records.select(print_.alias("fingerprint"), "kind", "scope", F.lit(now_ms).cast("long").alias("deleted_ms"), F.lit("purge").alias("reason")).dropDuplicates(["fingerprint"])
    return records.limit(0), dead if tombstones else dead.limit(0)


def optimised(records: DataFrame, now_ms: int) -> DataFrame:
    """What is left when expired records go that are not locked."""
    return records.filter(~(~c("locked") & lifecycle.expired(c("pinned"), c("expires_ms"), now_ms)))


def novelty(duplicate: Column, conflicts: Column, supersedes: Column) -> Column:
    """What a captured candidate is to what is stored: the first that holds."""
    some = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    return F.when(duplicate, "duplicate").when(some(conflicts), "conflicts").when(some(supersedes), "supersedes").otherwise("novel")


def captured(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """candidates (candidate, kind, scope, scope_key, content, conflicts, supersedes) with novelty and target_reject: targets that are not
    there, are the candidate itself, or are superseded already may not be named."""
    own = ids.memory_id(c("kind"), c("scope"), c("scope_key"), c("content"))
    live = records.select("id", c("superseded_by").isNull().alias("live"))
    met = candidates.withColumn("id", own).join(live, "id", "left")
    named = met.select("candidate", "id", F.explode(F.array_union(F.coalesce("conflicts", F.array().cast("array<string>")), F.coalesce("supersedes", F.array().cast("array<string>")))).alias("target"))
    at = named.join(live.select(c("id").alias("target"), c("live").alias("target_live")), "target", "left")
    code = F.when(c("target") == c("id"), "self").when(c("target_live").isNull(), "missing").when(~c("target_live"), "superseded")
    worst = at.groupBy("candidate").agg(F.min(code).alias("target_reject"))
    return met.join(worst, "candidate", "left").withColumn("novelty", novelty(F.coalesce("live", F.lit(False)), c("conflicts"), c("supersedes")))


def linked(records: DataFrame, upserts: DataFrame, said: DataFrame, now_ms: int) -> DataFrame:
    """records (doc_id, confidence, superseded_by, updated_ms) after upserts, with conflicts: of them said (doc_id, supersedes, conflicts:
    arrays of ids) names predecessors and conflicts. Predecessors point back; conflicts hold both ways and bound both confidences; what
    changes on the other side gets the time of the write."""
    own = said.join(upserts, "doc_id", "left_semi")
    back = own.select(F.explode("supersedes").alias("doc_id"), c("doc_id").alias("by")).groupBy("doc_id").agg(F.max("by").alias("by"))
    pairs = store.symmetric(own.select(c("doc_id").alias("a"), F.explode("conflicts").alias("b")), "a", "b")
    n = pairs.groupBy(c("a").alias("doc_id")).agg(F.array_sort(F.collect_set("b")).alias("conflict_with"))
    met = records.join(back, "doc_id", "left").join(n, "doc_id", "left").join(upserts.select("doc_id", F.lit(True).alias("new")), "doc_id", "left")
    touched = c("by").isNotNull() | c("conflict_with").isNotNull() | c("new").isNotNull()
    bound = F.when(c("conflict_with").isNotNull(), F.least("confidence", F.lit(0.5))).otherwise(c("confidence"))
    return met.select("doc_id", bound.alias("confidence"), F.coalesce("by", "superseded_by").alias("superseded_by"), "conflict_with", F.when(touched, F.lit(now_ms)).otherwise(c("updated_ms")).alias("updated_ms"))


def update_reject(action: Column, reason: Column, changes: Column, locked: Column, scope: Column, pinned: Column) -> Column:
    """Why an update is refused: action lock, unlock or null; the reason of a lock; changes, the fields that it names; pinned as asked for."""
    pins, locks = F.coalesce(pinned, F.lit(False)), F.coalesce(action == "lock", F.lit(False))
    forbidden = F.arrays_overlap(changes, F.array(*map(F.lit, ("content", "scope", "kind", "expiry", "code_paths", "pinned"))))
    return (
        F.when(reason.isNotNull() & ~locks, "reason_without_lock")
        .when((action == "unlock") & (F.size(changes) > 0), "unlock_with_changes")
        .when(locked & ~F.coalesce(action == "unlock", F.lit(False)) & forbidden, "locked")
        .when((scope == "repository") & (pins | locks), "repository_managed")
    )


def violations(links: DataFrame, known: DataFrame) -> DataFrame:
    """node, target and verdict of links (node, target) between known nodes (node): to itself, to nothing, on a cycle or before one, or well."""
    chains = store.chain_heads(links.join(known.withColumnRenamed("node", "target"), "target", "left_semi").filter("node != target").select("node", c("target").alias("next")))
    met = links.join(known.select(c("node").alias("target"), F.lit(True).alias("there")), "target", "left").join(chains.select("node", c("head").isNull().alias("cycle")), "node", "left")
    verdict = F.when(c("node") == c("target"), "self").when(c("there").isNull(), "dangling").when(c("cycle"), "cycle").otherwise("ok")
    return met.select("node", "target", verdict.alias("verdict"))


def reusable(chunks: DataFrame, held: DataFrame) -> DataFrame:
    """path and reuse of documents in chunks (path, chunk, content_hash, kind): whether every chunk is held as it is (so nothing is embedded again)."""
    same = held.select("path", "chunk", c("content_hash").alias("h"), c("kind").alias("k"))
    met = chunks.join(same, ["path", "chunk"], "left")
    return met.groupBy("path").agg(F.bool_and(F.coalesce((c("content_hash") == c("h")) & (c("kind") == c("k")), F.lit(False))).alias("reuse"), F.count("*").alias("chunks"))
