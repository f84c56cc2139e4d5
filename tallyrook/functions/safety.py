"""Safety predicates and the capture gate, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrook.schemas import ACTIONABLE, COMPACTED_CONFIDENCE, SIGNIFICANT

# Shapes of known credentials.
KNOWN_CREDENTIAL = (
    r"(?i)gh[pousr]_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|sk-proj-[a-z0-9_-]{16,}|sk_(?:live|test)_[a-z0-9]{16,}|sk-[a-z0-9]{20,}"
    r"|xox[baprs]-[a-z0-9-]{16,}|akia[0-9a-z]{16}|eyj[a-z0-9_-]{5,}\.eyj[a-z0-9_-]{5,}\.[a-z0-9_-]{10,}"
)
# A line that is an assignment to a credential's name.
ASSIGNMENT = (
    r"(?i)^\s*(?:export\s+|set\s+|(?:const|let|var)\s+|\$env:)?[\"']?(?:[a-z0-9]+[_-])*"
    r"(?:api[_-]?key|access[_-]?key|access[_-]?token|auth[_-]?token|bearer[_-]?token|client[_-]?secret|secret[_-]?access[_-]?key"
    r"|(?:app|application|api|auth|oauth|jwt|shared|signing|webhook)[_-]?secret|password|passwd|private[_-]?key|token)"
    r"[\"']?\s*[:=]\s*([\"']?[a-z0-9_./+=-]{16,}[\"']?)\s*[,;]?\s*$"
)
# Parts of a value that show that it stands for another.
PLACEHOLDERS = ("redacted", "placeholder", "example", "sample", "dummy", "fake", "not-a-secret", "not_a_secret", "your_", "your-", "replace", "change-me", "changeme", "insert_", "insert-")
# Openings of a protocol's envelope, and instructions.
ENVELOPES = ("<memory-policy", "<project-memory", "<system", "<developer")
INSTRUCTIONS = (
    "ignore previous instruction",
    "ignore all instruction",
    "disregard previous instruction",
    "reveal the system prompt",
    "reveal the developer message",
    "follow these instruction",
    "you must execute",
    "execute this tool",
    "call this tool",
    "act as system",
)
# Spans of code.
CODE_SPAN = r"(?s)```.*?```|``[^`\r\n]+``|`[^`\r\n]+`"


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of the parts stands in the text: one pass, so that a text that is computed is computed once."""
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))


def has_secret(text: Column) -> Column:
    key = text.rlike("(?iu)-----begin ") & text.rlike("(?iu)private key-----")

    def assigned(line: Column) -> Column:
        value = F.regexp_replace(F.lower(F.regexp_extract(line, ASSIGNMENT, 1)), "^[\"']+|[\"']+$", "")
        return (F.length(value) >= 16) & ~_any(value, PLACEHOLDERS)

    # Few lines name a credential at all: the regular expression runs on those.
    named = text.rlike("(?i)key|token|secret|passw")
    return key | text.rlike(KNOWN_CREDENTIAL) | (named & F.exists(F.split(text, "\n"), assigned))


def has_injection(text: Column) -> Column:
    lower = F.lower(text)
    plain = F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")
    # Spans of code may quote the envelope; they are masked only where there is one.
    enveloped = F.when(_any(lower, ENVELOPES), _any(F.regexp_replace(lower, CODE_SPAN, " "), ENVELOPES)).otherwise(F.lit(False))
    return enveloped | _any(plain, INSTRUCTIONS)


def safety_class(text: Column, trusted: Column, evidence: Column) -> Column:
    return F.when(has_secret(text), "secret_leak").when(has_injection(text), "injection").when(~trusted & ~evidence, "untrusted_claim").otherwise("safe")


def actionability(importance: Column, impact: Column, rarity: Column) -> Column:
    return 0.4 * importance + 0.3 * impact + 0.3 * rarity


def capture_decision(safety: Column, trusted: Column, evidence: Column, novelty: Column, significance: Column, actionability_: Column) -> Column:
    return (
        F.when(safety == "secret_leak", "quarantine:secret_leak")
        .when(safety == "injection", "quarantine:injection")
        .when((safety == "untrusted_claim") & ~trusted & ~evidence, "quarantine:untrusted_claim_without_evidence")
        .when(novelty == "duplicate", "skip:duplicate")
        .when(significance < SIGNIFICANT, "skip:low_significance")
        .when(actionability_ < ACTIONABLE, "skip:low_actionability")
        .otherwise("accept")
    )


def capture_confidence(importance: Column, trusted: Column) -> Column:
    return F.when(trusted, importance).otherwise(F.least(importance, F.lit(COMPACTED_CONFIDENCE)))
