"""Candidates that a model proposes inside markers of its message: parsed strictly, each refused with a code or accepted; and quotes found in texts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tallyrook.operators.store import small
from tallyrook.schemas import KINDS

c = F.col
# Markers, white space, keys, limits (of UTF-16 units), taxonomies.
OPEN, CLOSE = "<durable-memory-candidates>", "</durable-memory-candidates>"
SPACE = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
KEYS = ("title", "content", "kind", "taxonomy", "importance", "tags", "code_paths", "evidence_quote")
ACCEPTED, TITLE, CONTENT, IMPORTANCE, ITEMS, TAG, PATH, QUOTE = 3, 160, 6000, 0.6, 12, 64, 512, (3, 500)
TAXONOMIES = (
    "task_attempt", "tool_call", "session_summary", "architecture_fact", "codebase_fact", "user_fact", "user_identity", "user_behavior", "user_preference", "user_goal",
    "user_relationship", "fix_pattern", "code_template", "tool_heuristic", "code_style", "library_pref", "workflow_pref", "decision", "team_convention", "project_standard",
)
OF_USERS = ("user_identity", "user_behavior", "user_preference", "user_goal", "user_relationship")

_BLANKS = re.compile(f"[{SPACE}]+")
_ENDS = re.compile(rf"\A[{SPACE}]+|[{SPACE}]+\Z")
_SCHEMA = "n int, code string, title string, content string, kind string, taxonomy string, importance double, tags array<string>, code_paths array<string>, quote string"


class _Repeated:
    """An object that says a key twice."""


def _twice(x: object) -> bool:
    return x is _Repeated or (isinstance(x, list) and any(map(_twice, x)))


def _object(pairs: list[tuple]) -> dict | type[_Repeated]:
    found = dict(pairs)
    return _Repeated if len(found) < len(pairs) or any(map(_twice, found.values())) else found


def _constant(name: str) -> None:
    raise ValueError(name)


def _units(text: str) -> int:
    return len(text) + sum(x > "\uffff" for x in text)


def _text(x: object, most: int) -> bool:
    return isinstance(x, str) and 0 < _units(x) <= most


def _texts(x: object, most: int) -> bool:
    return isinstance(x, list) and len(x) <= ITEMS and all(_text(y, most) for y in x)


def refusal(x: object) -> str | None:
    """Why a candidate is refused for what it says; None: it is sound, but for evidence."""
    if x is _Repeated:
        return "repeated_key"
    if not isinstance(x, dict):
        return "not_object"
    taxonomy, kind, importance = x.get("taxonomy"), x.get("kind"), x.get("importance")
    of_user = isinstance(taxonomy, str) and taxonomy in OF_USERS
    number = isinstance(importance, int | float) and not isinstance(importance, bool)
    quote = x.get("evidence_quote")
    rules = (
        ("unknown_key", not x.keys() <= set(KEYS)),
        ("taxonomy", "taxonomy" in x and not (isinstance(taxonomy, str) and taxonomy in TAXONOMIES)),
        ("kind", not isinstance(kind, str) or kind not in KINDS or kind == "summary" or (of_user and kind != ("preference" if taxonomy == "user_preference" else "fact"))),
        ("title", not _text(x.get("title"), TITLE)),
        ("content", not _text(x.get("content"), CONTENT)),
        ("importance", not (number and 0 <= importance <= IMPORTANCE)),
        ("tags", not _texts(x.get("tags"), TAG)),
        ("code_paths", not _texts(x.get("code_paths"), PATH)),
        ("no_anchor", kind == "fact" and not of_user and not x.get("code_paths")),
        ("evidence", of_user and not (isinstance(quote, str) and QUOTE[0] <= _units(_plain(quote)) <= QUOTE[1])),
    )
    return next((code for code, broken in rules if broken), None)


def _plain(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ")


def plain(text: Column) -> Column:
    """White space as one blank, none at the ends: how quotes and what was said are compared."""
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]+", " "), "^ | $", "")


def _parsed(message: str | None) -> Iterator[tuple]:
    """n, code and fields of what stands between the last opening marker and the first closing one after it."""
    start = (message or "").rfind(OPEN)
    if start < 0:
        return
    end = message.find(CLOSE, start)
    nothing = (None,) * 8
    if end < 0:
        yield None, "unclosed", *nothing
        return
    try:
        said = json.loads(_ENDS.sub("", message[start + len(OPEN) : end]), object_pairs_hook=_object, parse_constant=_constant)
    except (ValueError, RecursionError):
        yield None, "not_json", *nothing
        return
    if not isinstance(said, list):
        yield None, "not_array", *nothing
        return
    for n, x in enumerate(said):
        if code := refusal(x):
            yield n, code, *nothing
        else:
            quote = _plain(x["evidence_quote"]) if x.get("taxonomy") in OF_USERS else None
            fields = [x["title"], x["content"], x["kind"], x.get("taxonomy"), float(x["importance"]), x["tags"], x["code_paths"], quote]
            # A lone half of a surrogate pair has no UTF-8: it is kept as the replacement character.
            clean = lambda v: v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) else v
            yield n, None, *([clean(y) for y in v] if isinstance(v, list) else clean(v) for v in fields)


def parsed(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, n (place in the payload; null for a payload refused whole), code and fields of the candidates in messages (keys, text).

    Messages without an opening marker, null ones too, give no row. An object that says a key twice, at any depth, isn't taken for one of its
    readings: its candidate is refused. A message is read whole, in the task that holds it.
    """
    schema = messages.select(*keys).schema
    for field in StructType.fromDDL(_SCHEMA).fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*key, *x) for b in batches for *key, text in zip(*(v.to_pylist() for v in b.columns), strict=True) for x in _parsed(text))
        while some := list(islice(rows, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), kinds, strict=True)], schema.fieldNames())

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    return messages.select(*keys, "text").filter(c("text").contains(OPEN)).mapInArrow(run, schema)


#: Quotes that a task looks for at once, and texts of a group that it reads.
QUOTES, TEXTS = 2_000, 20_000


def quoted(quotes: DataFrame, texts: DataFrame, group: str, spread: tuple[str, ...] = ()) -> DataFrame:
    """The distinct (group, quote) of quotes that stand in a text of their group, byte for byte.

    No pair of a quote and a text is formed: a task gets up to about QUOTES of a group's quotes, then reads texts one by one, each once for all
    of them. A group of more quotes or texts is dealt to several tasks by their hashes (`spread`: columns that tell copies of a
    text apart). Nulls and empty quotes stand nowhere.
    """
    q = quotes.filter(c(group).isNotNull() & (c("quote") != "")).select(group, "quote").distinct()
    t = texts.filter(c(group).isNotNull() & (c("text") != "")).join(q.select(group).distinct(), group, "left_semi")
    parts = lambda rows, most, name: rows.groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias(name)).filter(c(name) > 1)
    large = small(parts(q, QUOTES, "lists").join(parts(t, TEXTS, "ranges"), group, "full_outer"))
    one = lambda rows: rows.join(large, group, "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in ("lists", "ranges")})
    every = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    part = lambda n, *of: F.pmod(F.xxhash64(*of), c(n)).cast("int")
    asked = one(q).select(group, part("lists", "quote").alias("a"), every("ranges").alias("b"), F.lit(0).alias("last"), c("quote").alias("value"))
    said = one(t).select(group, every("lists").alias("a"), part("ranges", "text", *spread).alias("b"), F.lit(1).alias("last"), c("text").alias("value"))
    key = [group, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, look, left = None, None, set()
        for batch in batches:
            out = []
            for g, a, b, last, value in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (g, a, b) != at:
                    at, look, left = (g, a, b), ahocorasick.Automaton(), set()
                if not last:
                    look.add_word(value, value)
                    left.add(value)
                elif left:
                    if look.kind == ahocorasick.TRIE:
                        look.make_automaton()
                    met = {x for _, x in look.iter(value)} & left
                    left -= met
                    out += [(g, x) for x in met]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], batch.schema.types[4 * i]) for i in (0, 1)], [group, "quote"])

    rows = asked.unionByName(said).repartition(*key).sortWithinPartitions(*key, "last")
    return rows.mapInArrow(run, q.schema).distinct()


def judged(found: DataFrame, said: DataFrame, keys: list[str], group: str, spread: tuple[str, ...] = ()) -> DataFrame:
    """parsed() rows with their verdicts: what is about users must quote a text of its group (said: group, text), and the first ACCEPTED sound
    candidates of a message are accepted; later ones have the code `beyond`. `accepted` tells which."""
    texts = said.select(group, plain(c("text")).alias("text"), *spread)
    proven = quoted(found.filter("quote IS NOT NULL").select(group, "quote"), texts, group, spread).withColumn("proven", F.lit(True))
    met = found.join(proven, [group, "quote"], "left")
    code = F.when(c("code").isNull() & c("quote").isNotNull() & c("proven").isNull(), "evidence").otherwise(c("code"))
    so_far = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("code", code).withColumn("place", F.count_if(c("code").isNull()).over(so_far))
    last = F.when(c("code").isNull() & (c("place") > ACCEPTED), "beyond").otherwise(c("code"))
    return placed.withColumn("code", last).withColumn("accepted", c("code").isNull()).drop("place", "proven")
