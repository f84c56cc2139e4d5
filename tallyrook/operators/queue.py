"""Extraction jobs as a table: lost leases recovered, commands applied, old receipts pruned. One row a job, one command a job and pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.operators import store
from tallyrook.schemas import RETRY_MOST_MS, RETRY_MS, TERMINAL_JOBS

c = F.col
ACTIVE, TERMINAL = ("claimed", "running"), ("completed", "failed", "cancelled")


def backoff_ms(attempts: Column) -> Column:
    """Doubles with each attempt, up to a minute."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6))
    return F.least(RETRY_MS * F.pow(F.lit(2), doublings).cast("long"), F.lit(RETRY_MOST_MS))


def _retried(now_ms: int) -> tuple[Column, Column]:
    """State and next time of a job whose attempt failed."""
    again = c("attempts") < c("max_attempts")
    return F.when(again, "queued").otherwise("failed"), F.when(again, F.lit(now_ms) + backoff_ms(c("attempts")))


def recovered(jobs: DataFrame, now_ms: int) -> DataFrame:
    """jobs (job, state, attempts, max_attempts, lease_ms, token, cancel, next_ms, error) after expired leases are given up."""
    lost = c("state").isin(*ACTIVE) & (c("lease_ms") <= now_ms)
    state, due = _retried(now_ms)
    new = {
        "state": F.when(lost, F.when(c("cancel"), "cancelled").otherwise(state)).otherwise(c("state")),
        "next_ms": F.when(lost, F.when(~c("cancel"), due)).otherwise(c("next_ms")),
        "error": F.when(lost, F.when(c("cancel"), "cancelled").otherwise("lease_expired")).otherwise(c("error")),
        "lease_ms": F.when(lost, None).otherwise(c("lease_ms")),
        "token": F.when(lost, None).otherwise(c("token")),
        "cancel": c("cancel") & ~(lost & ~c("cancel")),
    }
    return jobs.select(*(new.get(x, c(x)).alias(x) for x in jobs.columns))


def claimable(now_ms: int) -> Column:
    return (c("state") == "queued") & ~c("cancel") & (c("attempts") < c("max_attempts")) & (c("next_ms").isNull() | (c("next_ms") <= now_ms))


def applied(jobs: DataFrame, commands: DataFrame, now_ms: int) -> DataFrame:
    """jobs after commands (job, command, given: the token given, ttl_ms, material: a digest), with outcome.

    Commands: enqueue, claim, renew, complete, retry, fail, cancel, source_changed. What needs a lease needs its token, unexpired.
    """
    met = recovered(jobs, now_ms).join(commands, "job", "full_outer")
    known, command = c("state").isNotNull(), c("command")
    active, ended = c("state").isin(*ACTIVE), c("state").isin(*TERMINAL)
    leased = command.isin("renew", "complete", "retry", "fail")
    finish = command.isin("complete", "retry", "fail")
    refused = (
        F.when(command.isNull(), None)
        .when((command == "enqueue") & known, F.when(c("material").eqNullSafe(c("digest")), "already_queued").otherwise("id_reused"))
        .when(command == "enqueue", None)
        .when(~known, "not_found")
        .when(command == "claim", F.when(~claimable(now_ms), "not_claimable"))
        .when((command == "complete") & (c("state") == "completed"), F.when(c("material").eqNullSafe(c("digest")), "already_completed").otherwise("material_changed"))
        .when(leased & ~active, "not_active")
        .when(leased & ~c("token").eqNullSafe(c("given")), "stale_token")
        .when(command.isin("cancel", "source_changed") & ended, "already_terminal")
    )
    outcome = (
        F.when(refused.isNotNull(), refused).when(command.isNull(), "kept").when(finish & c("cancel"), "cancelled").when(command == "enqueue", "queued").when(command == "claim", "claimed")
        .when(command == "renew", "renewed").when(command == "complete", "completed").when(command == "retry", "requeued").when(command == "fail", "failed")
        .when(command == "cancel", F.when(active, "cancel_requested").otherwise("cancelled")).when(command == "source_changed", "source_changed").otherwise("unknown_command")
    )
    state, due = _retried(now_ms)
    done = met.withColumn("outcome", outcome)
    is_ = lambda *x: c("outcome").isin(*x)
    new_state = (
        F.when(is_("queued"), "queued").when(is_("claimed"), "claimed").when(is_("renewed"), "running").when(is_("completed", "cancelled", "failed"), c("outcome"))
        .when(is_("requeued"), state).when(is_("source_changed"), "failed").otherwise(c("state"))
    )
    free = is_("completed", "cancelled", "failed", "requeued", "source_changed")
    return done.select(
        "job",
        new_state.alias("state"),
        F.when(is_("queued"), 0).when(is_("claimed"), c("attempts") + 1).otherwise(c("attempts")).alias("attempts"),
        F.coalesce("max_attempts", F.lit(3)).alias("max_attempts"),
        F.when(is_("claimed"), now_ms + c("ttl_ms")).when(is_("renewed"), F.greatest("lease_ms", now_ms + c("ttl_ms"))).when(~free, c("lease_ms")).alias("lease_ms"),
        F.when(is_("requeued"), due).when(~(free | is_("claimed")), c("next_ms")).alias("next_ms"),
        F.when(is_("cancel_requested"), True).when(is_("requeued", "source_changed"), False).otherwise(F.coalesce("cancel", F.lit(False))).alias("cancel"),
        F.when(is_("queued", "completed", "claimed"), None).when(is_("cancelled", "source_changed", "cancel_requested"), c("outcome")).when(is_("requeued", "failed"), "worker_failure").otherwise(c("error")).alias("error"),
        "outcome",
    )


def pruned(jobs: DataFrame, most: int = TERMINAL_JOBS) -> DataFrame:
    """jobs (job, state, updated_ms) without the oldest ended ones, if there are `most` or more: so many as leave room for one."""
    over = jobs.count() - most + 1
    if over <= 0:
        return jobs
    ended = store.numbered(jobs.filter(c("state").isin(*TERMINAL)).select("job", "updated_ms"), "updated_ms", "job")
    return jobs.join(ended.filter(c("n") < over).select("job"), "job", "left_anti")


def roots(sessions: DataFrame, hops: int = 32) -> DataFrame:
    """session and root of sessions (session, parent or null): the ancestor at most `hops` up, the first that is met twice on a circle;
    the session itself where an ancestor is not known. Rows leave the loop as soon as they are done."""
    parents = sessions.select(c("session").alias("at"), c("parent"))
    front = sessions.select("session", c("session").alias("at"), F.array("session").alias("path"))
    done = []
    for hop in range(hops):
        met = front.join(parents.withColumn("known", F.lit(True)), "at", "left")
        end = F.when(c("known").isNull(), c("session")).when(c("parent").isNull(), c("at")).when(F.array_contains("path", c("parent")), c("parent"))
        if hop == hops - 1:
            end = F.coalesce(end, c("parent"))
        told = store.cut(met.withColumn("root", end))
        done.append(told.filter("root IS NOT NULL").select("session", "root"))
        front = told.filter("root IS NULL").select("session", c("parent").alias("at"), F.array_append("path", c("parent")).alias("path"))
        if front.isEmpty():
            break
    return store.union(*done)
