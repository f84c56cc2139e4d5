"""What an extraction brings to a graph: evidence checked, entities, relations, facts and observations accepted or refused, and merged.

Candidates are rows; a refusal is a code beside the candidate, never an error of the job. What comes one after another in a run (facts may
name earlier accepted ones) is folded over the run's own candidates, of which there are at most MOST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.functions import canonical, ids, safety
from tallyrook.operators import store
from tallyrook.schemas import EVIDENCE, MOST, NAME_CHARS, PREDICATES, QUOTE_CHARS

c = F.col


def name_reject(name: Column) -> Column:
    """Whether a name is missing, too long, or holds a control character."""
    return (F.coalesce(F.trim(name), F.lit("")) == "") | (F.length(name) > NAME_CHARS) | F.coalesce(name.rlike(r"\p{Cntrl}"), F.lit(False))


def unsound(confidence: Column) -> Column:
    return confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1)


def checked_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """evidence (candidate, unit, quote, occurrence, utf8_start, utf8_end) with its source's binding and a code where it does not hold.

    With both offsets, the bytes of the text between them must be those of the quote; else the text must contain it.
    """
    met = evidence.join(sources.select("unit", "doc_id", "content_hash", "revision", "scope", "scope_key", "text"), "unit", "left")
    raw, start, end = F.encode("text", "UTF-8"), c("utf8_start"), c("utf8_end")
    both = start.isNotNull() & end.isNotNull()
    code = (
        F.when((F.coalesce(F.length("quote"), F.lit(0)) == 0) | (F.length("quote") > QUOTE_CHARS), "bad_quote")
        .when(c("doc_id").isNull(), "unknown_unit")
        .when(both & ((start < 0) | (start > end) | (end > F.length(raw))), "bad_offsets")
        .when(both & (F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")) != F.encode("quote", "UTF-8")), "offset_mismatch")
        .when(~both & ~c("text").contains(c("quote")), "quote_absent")
    )
    return met.withColumn("code", code).drop("text")


def distinct_evidence(evidence: DataFrame, key: str, keep: int = EVIDENCE) -> DataFrame:
    """Of each key, its different evidence (record, unit, quote, occurrence) in order, `keep` at most."""
    order = ("doc_id", "unit", "quote", "occurrence")
    once = evidence.groupBy(key, *order).agg(F.count("*").alias("times"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).filter(c("place") < keep).drop("times")


def evidence_reject(checked: DataFrame, key: str = "candidate") -> DataFrame:
    """Of each candidate with evidence: how much, its scope if that is one, and a code: too much, the first fault, or several scopes."""
    scope = F.concat_ws("\0", "scope", F.coalesce("scope_key", F.lit("")))
    of = checked.groupBy(key).agg(F.count("*").alias("evidence"), F.min("code").alias("fault"), F.min(scope).alias("scope"), F.max(scope).alias("other"), F.min("doc_id").alias("doc_id"))
    code = F.when(c("evidence") > EVIDENCE, "too_much_evidence").when(c("fault").isNotNull(), c("fault")).when(c("scope") != c("other"), "crosses_scopes")
    return of.select(key, "evidence", "scope", "doc_id", code.alias("evidence_reject"))


def upserted_entities(candidates: DataFrame, known: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The outcome of each candidate, and the entities after all of them.

    candidates: candidate, scope, name, type, aliases (all normal), sources, reject; known: entity, scope, name, type, aliases, sources,
    first_ms. A candidate is the entity of its scope and type whose name or alias is its name, if there is one; of two or more it is refused
    as ambiguous; else it is new, under the id of its scope, type and name.
    """
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    called = known.select("entity", "scope", "type", F.explode(names).alias("name"))
    sound_ = candidates.filter("reject IS NULL")
    hits = sound_.join(called, ["scope", "type", "name"]).groupBy("candidate").agg(F.count_distinct("entity").alias("matches"), F.min("entity").alias("match"))
    own = ids.entity_id(F.lit("project"), c("scope"), F.lit(""), c("type"), c("name"))
    met = candidates.join(hits, "candidate", "left")
    code = F.when(c("reject").isNotNull(), c("reject")).when(c("matches") > 1, "ambiguous")
    told = store.cut(met.withColumns({"code": code, "entity": F.when(code.isNull(), F.coalesce("match", own))}))
    outcome = F.when(c("code").isNotNull(), c("code")).when(c("match").isNotNull(), "merged").otherwise("new")
    new = told.filter("code IS NULL").groupBy("entity").agg(F.min_by(F.struct("scope", "name", "type"), "candidate").alias("x"), F.flatten(F.collect_set("aliases")).alias("more"), F.sum("sources").alias("added"))
    every = known.join(new.select("entity", "more", "added"), "entity", "left")
    merged = every.select("entity", "scope", "name", "type", _aliases("aliases", "more"), (c("sources") + F.coalesce("added", F.lit(0))).alias("sources"), "first_ms", F.when(c("added").isNotNull(), F.lit(now_ms)).alias("last_ms"))
    fresh = new.join(known.select("entity"), "entity", "left_anti").select("entity", "x.*", _aliases(None, "more"), c("added").alias("sources"), F.lit(now_ms).alias("first_ms"), F.lit(now_ms).alias("last_ms"))
    return told.select("candidate", "entity", outcome.alias("outcome")), merged.unionByName(fresh)


def _aliases(old: str | None, more: str) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(c(old), none) if old else none, F.coalesce(c(more), none))).alias("aliases")


def named_once(mentions: DataFrame, entities: DataFrame, mention: str = "mention") -> DataFrame:
    """Of each (scope, mention) the entity that it names, by name or alias, in whatever type, if it is the only one."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    called = entities.select("entity", "scope", F.explode(names).alias(mention)).distinct()
    once = called.groupBy("scope", mention).agg(F.count("*").alias("n"), F.min("entity").alias("entity")).filter("n = 1").drop("n")
    return mentions.select("scope", mention).distinct().join(once, ["scope", mention])


def relation_status(invalid_ms: Column, now_ms: int) -> Column:
    return F.when(invalid_ms <= now_ms, "invalidated").otherwise("active")


def upserted_relations(candidates: DataFrame, entities: DataFrame, known: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The outcome of each candidate, and the relations after all of them.

    candidates: candidate, scope, subject, predicate, object (mentions, normal), type, valid_ms, invalid_ms, confidence, reject; known: relation,
    valid_ms, invalid_ms, confidence. One base id (scope, ends, predicate, type) belongs to the validity that came first; others get an id of
    their own. Equal ones merge at the greater confidence.
    """
    ends = candidates.select("scope", c("subject").alias("mention")).unionByName(candidates.select("scope", c("object").alias("mention")))
    of = named_once(ends, entities)
    met = candidates.join(of.select("scope", c("mention").alias("subject"), c("entity").alias("subject_id")), ["scope", "subject"], "left").join(of.select("scope", c("mention").alias("object"), c("entity").alias("object_id")), ["scope", "object"], "left")
    code = (
        F.when(c("reject").isNotNull(), c("reject")).when(~c("predicate").isin(*PREDICATES), "unsupported_predicate").when(unsound(c("confidence")), "bad_confidence")
        .when(c("invalid_ms") <= c("valid_ms"), "bad_range").when(c("subject_id").isNull(), "unknown_subject").when(c("object_id").isNull(), "unknown_object")
    )
    base = ids.relation_id(c("scope"), c("subject_id"), c("predicate"), c("object_id"), c("type"))
    told = met.withColumn("code", code).withColumn("base", F.when(c("code").isNull(), base))
    when = F.struct("valid_ms", "invalid_ms")
    held = known.select(c("relation").alias("base"), when.alias("holder"), F.lit(-1).cast("long").alias("order"))
    first = told.filter("base IS NOT NULL").select("base", when.alias("holder"), c("candidate").cast("long").alias("order")).unionByName(held).groupBy("base").agg(F.min_by("holder", "order").alias("holder"))
    own = F.when(when.eqNullSafe(c("holder")), c("base")).otherwise(ids.version_id(c("base"), c("valid_ms"), c("invalid_ms")))
    done = store.cut(told.join(first, "base", "left").withColumn("relation", F.when(c("code").isNull(), own)))
    outcomes = done.select("candidate", "relation", F.coalesce("code", F.lit("accepted")).alias("outcome"))
    new = done.filter("code IS NULL").select("relation", "valid_ms", "invalid_ms", "confidence")
    every = known.select("relation", "valid_ms", "invalid_ms", "confidence").unionByName(new).groupBy("relation", "valid_ms", "invalid_ms").agg(F.max("confidence").alias("confidence"), F.count("*").alias("assertions"))
    return outcomes, every.withColumn("status", relation_status(c("invalid_ms"), now_ms))


def fact_reject(text: Column, type_: Column, context: Column, confidence: Column, start_ms: Column, end_ms: Column) -> Column:
    return (
        F.when(name_reject(text), "bad_text").when(safety.has_secret(text), "secret").when(safety.has_injection(text), "injection")
        .when(~F.coalesce(type_.isin("world", "experience"), F.lit(False)), "bad_type").when(F.length(context) > NAME_CHARS, "context_too_long")
        .when(unsound(confidence), "bad_confidence").when(start_ms > end_ms, "bad_range")
    )


def accepted_facts(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """candidates (run, index, scope, causes: indexes; reject) with code: a cause must be an accepted earlier fact of the run, in its scope.

    A run of more than `most` candidates is refused whole; others are folded in the order of their indexes.
    """
    sizes = candidates.groupBy("run").agg(F.count("*").alias("size"))
    large = sizes.filter(c("size") > most).select("run")
    over = candidates.join(large, "run", "left_semi").withColumn("code", F.lit("too_many_facts"))
    rest = candidates.join(large, "run", "left_anti")
    item = F.struct("index", "scope", "causes", c("reject").isNull().alias("sound"))
    runs = rest.groupBy("run").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most `most` each

    def step(done: Column, x: Column) -> Column:
        known = lambda i: F.exists(done, lambda d: (d["index"] == i) & d["ok"] & (d["scope"] == x["scope"]))
        ok = x["sound"] & F.forall(x["causes"], lambda i: (i < x["index"]) & known(i))
        return F.array_append(done, F.struct(x["index"].alias("index"), x["scope"].alias("scope"), ok.alias("ok")))

    empty = F.array().cast("array<struct<index:int,scope:string,ok:boolean>>")
    told = runs.select("run", F.explode(F.aggregate("items", empty, step)).alias("x")).select("run", c("x.index").alias("index"), c("x.ok").alias("ok"))
    code = F.when(c("reject").isNotNull(), c("reject")).when(~c("ok"), "bad_cause")
    return rest.join(told, ["run", "index"]).withColumn("code", code).drop("ok").unionByName(over)


def merged_facts(accepted: DataFrame) -> DataFrame:
    """Facts of accepted candidates (scope, type, text, unit, revision, confidence, at_ms, run, index): equal ones merge at the greater confidence."""
    units = F.array(F.concat_ws(":", "unit", "revision"))
    own = accepted.withColumn("fact", ids.fact_id(c("scope"), c("type"), c("text"), units))
    return own.groupBy("fact").agg(F.max("confidence").alias("confidence"), F.min("at_ms").alias("mentioned_ms"), F.count("*").alias("assertions"))


def upserted_observations(new: DataFrame, known: DataFrame, now_ms: int) -> DataFrame:
    """Observations after new ones (observation, scope, order, facts: sorted, confidence) meet known ones (with freshness).

    Facts unite. What is invalidated or retired stays so; else it is current. A new observation on just the facts of an older current one
    of its scope, under another id, retires that; of several new ones the last.
    """
    own = new.groupBy("observation", "scope").agg(F.max("order").alias("order"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("facts")))).alias("facts"), F.max("confidence").alias("confidence"))
    old = known.select("observation", "scope", c("facts").alias("old_facts"), c("freshness").alias("was"), c("confidence").alias("old_confidence"))
    both = own.join(old, ["observation", "scope"], "full_outer")
    none = F.array().cast("array<long>")
    facts = F.array_sort(F.array_union(F.coalesce("old_facts", none), F.coalesce("facts", none)))
    kept = F.when(c("was").isin("invalidated", "retired"), c("was")).otherwise("current")
    # An observation that was there already retires nothing: only new ones do.
    rows = store.cut(both.select("observation", "scope", facts.alias("facts"), kept.alias("kept"), F.greatest("confidence", "old_confidence").alias("confidence"), F.when(c("was").isNull(), c("order")).alias("made"), F.coalesce("order", F.lit(-1).cast("long")).alias("order")))
    key = F.array_join(F.transform("facts", lambda x: x.cast("string")), ",")
    last = rows.filter("made IS NOT NULL").groupBy("scope", key.alias("key")).agg(F.max("made").alias("last"))
    met = rows.withColumn("key", key).join(last, ["scope", "key"], "left")
    newer = c("last").isNotNull() & (F.coalesce("made", F.lit(-1).cast("long")) < c("last"))
    freshness = F.when((c("kept") == "current") & newer, "retired").otherwise(c("kept"))
    return met.select("observation", "scope", "facts", "confidence", F.size("facts").alias("proofs"), freshness.alias("freshness"), F.lit(now_ms).alias("updated_ms"))


def observation_outcome(action: Column, statement: Column, found: Column, restorable: Column) -> Column:
    """What an action on an observation comes to: a new state, or why it is refused."""
    said = F.coalesce(F.trim(statement), F.lit(""))
    edit = F.when(said == "", "refused:no_statement").when(name_reject(said), "refused:bad_statement").when(safety.has_secret(said), "refused:secret").when(safety.has_injection(said), "refused:injection").otherwise("edited")
    return (
        F.when(~found, "refused:not_found").when(action == "review", "reviewed").when(action == "edit", edit).when(action == "invalidate", "invalidated")
        .when(action == "restore", F.when(restorable, "restored").otherwise("refused:no_active_facts")).otherwise("refused:unknown_action")
    )


#: Parts of a run that are digested as one list, at most.
FEW_PARTS = 32


def run_digests(material: DataFrame, unordered: tuple[str, ...] = ()) -> DataFrame:
    """run, parts, digest and reject of runs' material (run, section, json): one digest however its parts are ordered, dealt to rows or written.

    A part that is said twice counts twice. Where any part is refused there is no digest, and reject is the least of the codes; a null part is
    `missing`; parts without a run are left out. Runs may have any number of parts: those of more than FEW_PARTS are digested level by level,
    by exchanges, others in one exchange of their parts.
    """
    material = material.filter(c("run").isNotNull())
    many = store.small(material.groupBy("run").count().filter(c("count") > FEW_PARTS).select("run"))

    def parts(rows: DataFrame) -> DataFrame:
        told = rows.withColumn("__told", canonical.canonical(c("json"), unordered))
        reject = F.when(c("json").isNull(), "missing").otherwise(c("__told.reject"))
        part = F.sha2(F.concat_ws("\0", "section", "__told.json"), 256)
        return told.select("run", part.alias("h"), reject.alias("reject"))

    counts = F.count("*").alias("parts"), F.min("reject").alias("reject")
    some = not many.isEmpty()
    listed = parts(material.join(many, "run", "left_anti") if some else material).groupBy("run").agg(*counts, F.collect_list("h").alias("hs"))
    met = store.stable_digest_of(c("hs"), listed, "digest").drop("hs")
    if some:
        large = store.written(parts(material.join(many, "run", "left_semi")))
        met = met.unionByName(large.groupBy("run").agg(*counts).join(store.stable_digest(large, "run", "h"), "run"))
    return met.select("run", "parts", F.when(c("reject").isNull(), c("digest")).alias("digest"), "reject")


def run_receipts(runs: DataFrame, known: DataFrame) -> DataFrame:
    """run, order and outcome of runs (run, order, digest): a run id stands for one material. Equal material is committed once, other is an error."""
    first = runs.groupBy("run").agg(F.min_by("digest", "order").alias("first"), F.min("order").alias("first_order"))
    held = known.select("run", c("digest").alias("held"))
    met = runs.join(first, "run").join(held, "run", "left")
    owner = F.coalesce("held", "first")
    new = c("held").isNull() & (c("order") == c("first_order"))
    return met.select("run", "order", F.when(c("digest") != owner, "id_reused").when(new, "committed").otherwise("already_committed").alias("outcome"))


def packets(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of each query: citations (the distinct records of what it found, in order of first place, as an array) and whether it has no answer.

    found: qid, place, kind, id; evidence: kind, id, doc_id. A query has a bounded number of results, each with at most EVIDENCE citations.
    """
    some = evidence.groupBy("kind", "id", "doc_id").count().withColumn("n", F.row_number().over(Window.partitionBy("kind", "id").orderBy("doc_id"))).filter(c("n") <= EVIDENCE)
    first = found.filter("kind IS NOT NULL").join(some, ["kind", "id"]).groupBy("qid", "doc_id").agg(F.min(F.struct("place", "n")).alias("first"))
    cited = first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "doc_id"))), lambda x: x["doc_id"]).alias("citations"))
    asked = found.groupBy("qid").agg((F.count("kind") == 0).alias("no_answer"))
    return asked.join(cited, "qid", "left").select("qid", F.coalesce("citations", F.array().cast("array<long>")).alias("citations"), "no_answer")


def broken(entities: DataFrame, relations: DataFrame, facts: DataFrame, observations: DataFrame, mentions: DataFrame) -> DataFrame:
    """What refers to nothing: section, id and target. A sound graph has none."""
    e, f = entities.select("entity"), facts.select("fact")
    miss = lambda rows, section, key, target, known, of: rows.select(F.lit(section).alias("section"), c(key).cast("string").alias("id"), c(target).alias(of)).filter(c(of).isNotNull()).join(known, of, "left_anti").select("section", "id", c(of).cast("string").alias("target"))
    return store.union(
        miss(relations, "relation_subject", "relation", "subject", e, "entity"),
        miss(relations, "relation_object", "relation", "object", e, "entity"),
        miss(facts, "fact_cause", "fact", "cause", f, "fact"),
        miss(observations, "observation_fact", "observation", "fact", f, "fact"),
        miss(mentions, "mention", "entity", "entity", e, "entity"),
    )
