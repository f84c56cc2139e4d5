"""Lifecycle rules as columns: expiry, retention, feedback, quality, taxonomy."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrook.schemas import DAY_MS, EXPIRY, HALF_LIFE, PROFILE, SESSION_TTL_DAYS, WEIGHTS


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*table.items())))[key]


def expires_at(kind: Column, scope: Column, created_ms: Column, days: Column | None = None) -> Column:
    """Explicit days, else a week for a session's record, else the kind's default."""
    given = F.lit(None).cast("long") if days is None else days.cast("long")
    session = F.when(scope == "session", F.lit(SESSION_TTL_DAYS))
    return created_ms + F.coalesce(given, session, lookup(EXPIRY, kind)).cast("long") * DAY_MS


def expired(pinned: Column, expires_ms: Column, now_ms: int) -> Column:
    return ~pinned & F.coalesce(expires_ms <= now_ms, F.lit(False))


def retention(pinned: Column, kind: Column, updated_ms: Column, now_ms: int) -> Column:
    """Half after each half-life, by whole days."""
    days = F.least(F.floor(F.greatest(F.lit(now_ms) - updated_ms, F.lit(0)) / DAY_MS), F.lit(65_535))
    return F.when(pinned, 1.0).otherwise(F.pow(F.lit(2.0), -days.cast("double") / F.greatest(lookup(HALF_LIFE, kind), F.lit(1))))


def feedback_factor(injected: Column, used: Column, ignored: Column, error: Column) -> Column:
    change = 0.1 * (used - ignored - error) / F.greatest(injected, F.lit(1))
    return F.when(injected < 3, 1.0).otherwise(F.least(F.greatest(1 + change, F.lit(0.9)), F.lit(1.1)))


def quality(importance: Column, confidence: Column) -> Column:
    return 0.9 + 0.1 * (importance + confidence) / 2


def taxonomy(scope: Column, kind: Column, anchored: Column) -> Column:
    shared = scope == "repository"
    return (
        F.when(shared & kind.isin("decision", "fact"), "project_standard")
        .when(shared, "team_convention")
        .when(kind == "decision", "decision")
        .when(kind == "preference", "workflow_pref")
        .when((kind == "fact") & anchored, "codebase_fact")
        .when(kind == "fact", "architecture_fact")
        .when((kind == "pattern") & anchored, "code_template")
        .when(kind.isin("pattern", "gotcha"), "fix_pattern")
        .otherwise("session_summary")
    )


def weight(taxonomy_: Column, i: int) -> Column:
    """Of dense score, reciprocal rank, lexical score and agreement (i from 0 to 3)."""
    return lookup({t: WEIGHTS[p][i] for t, p in PROFILE.items()}, taxonomy_)


def lock_rule(action: Column, scope: Column, locked: Column) -> Column:
    """Why an action on a record is refused, or null."""
    return (
        F.when((scope == "repository") & action.isin("pin", "lock", "update", "delete"), "repository_managed")
        .when(locked & action.isin("update", "delete"), "locked")
        .when(locked & (action == "lock"), "already_locked")
        .when(~locked & (action == "unlock"), "not_locked")
    )
