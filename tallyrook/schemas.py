"""Constants of the data model, and tables of fixed values."""

from __future__ import annotations

DAY_MS = 86_400_000
#: The fixed clock of all queries: 2026-01-01T00:00:00Z.
NOW_MS = 1_767_225_600_000

# Limits of texts.
CONTENT_CHARS, TITLE_CHARS, EXCERPT_CHARS = 6000, 96, 1600
TRUNCATED, TRUNCATED_ROOM = "\n...[truncated]", 16
STORED_TITLE_CHARS, QUERY_CHARS, TAGS, TAG_CHARS = 160, 2000, 12, 64
# Limits of requests.
RESULTS, IDS, MIN_BUDGET_CHARS, MAX_BUDGET_CHARS = 20, 100, 512, 24_000
BUDGET = "budget_out_of_range"
# Ranking.
CANDIDATES, ABSTAIN_BELOW, RANK_OFFSET = 1000, 0.42, 61.0
DENSE_SHARE, LEXICAL_SHARE, GRAPH_WEIGHT, GRAPH_ONLY_WEIGHT = 0.65, 0.35, 0.25, 0.45
MMR_RELEVANCE, RECORD_OVERHEAD, MAX_RESULTS, BUDGET_CHARS = 0.75, 320, 10, 6000
# Capture.
SIGNIFICANT, ACTIONABLE, COMPACTED_CONFIDENCE = 0.5, 0.5, 0.6
# Graph.
FANOUT, EVIDENCE, SAME_ENTITY = 32, 8, 0.9

#: What a graph search returns at most, its depth, attempts and leases of jobs, receipts kept.
GRAPH_RESULTS, GRAPH_DEPTH, ATTEMPTS, LEASE_MS, TERMINAL_JOBS, RETRY_MS, RETRY_MOST_MS = 64, 2, 3, 60_000, 1024, 1000, 60_000
#: Candidates of a run at most, characters of names and quotes, predicates.
MOST, NAME_CHARS, QUOTE_CHARS = 64, 512, 1024
PREDICATES = ("uses", "depends_on", "implements", "causes", "related_to", "supports", "contradicts")
#: The extraction policy that revisions are bound to.
POLICY = "policy-v1"
# Kinds of records.
KINDS = ("decision", "preference", "fact", "pattern", "gotcha", "summary")
#: Half-life and default expiry in days, by kind.
HALF_LIFE = {"decision": 730, "preference": 365, "fact": 180, "pattern": 270, "gotcha": 365, "summary": 14}
EXPIRY = {"fact": 365, "pattern": 540, "gotcha": 730, "summary": 30}
SESSION_TTL_DAYS = 7
#: Precedence of scopes.
PRECEDENCE = {"session": 4, "agent": 3, "project": 2, "repository": 1}
#: Weights of the dense channel, reciprocal rank, lexical score and agreement, by profile.
WEIGHTS = {"semantic": (0.45, 0.25, 0.20, 0.10), "episodic": (0.45, 0.25, 0.20, 0.10), "procedural": (0.35, 0.25, 0.30, 0.10), "preference": (0.25, 0.20, 0.45, 0.10)}
#: Profile of each inferred taxonomy.
PROFILE = {
    "project_standard": "semantic",
    "team_convention": "semantic",
    "decision": "semantic",
    "workflow_pref": "preference",
    "codebase_fact": "semantic",
    "architecture_fact": "semantic",
    "code_template": "procedural",
    "fix_pattern": "procedural",
    "session_summary": "episodic",
}
