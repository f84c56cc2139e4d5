"""From candidates to results: merge, score, calibrate, fuse, collapse duplicates, diversify, pack, abstain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.functions import ids, lifecycle, text
from tallyrook.operators.channels import query_words
from tallyrook.schemas import ABSTAIN_BELOW, DENSE_SHARE, GRAPH_ONLY_WEIGHT, GRAPH_WEIGHT, LEXICAL_SHARE, MMR_RELEVANCE, PRECEDENCE, RANK_OFFSET, RECORD_OVERHEAD

c = F.col


def merge(dense: DataFrame | None, lexical: DataFrame | None) -> DataFrame:
    """qid, doc_id, similarity, dense_rank, lexical_rank: a full outer join of the channels that there are."""
    if dense is not None:
        dense = dense.select("qid", "doc_id", "similarity", c("rank").alias("dense_rank"))
    if lexical is not None:
        lexical = lexical.select("qid", "doc_id", c("rank").alias("lexical_rank"))
    if dense is None:
        return lexical.select("qid", "doc_id", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("dense_rank"), "lexical_rank")
    if lexical is None:
        return dense.withColumn("lexical_rank", F.lit(None).cast("int"))
    return dense.join(lexical, ["qid", "doc_id"], "full_outer")


def haystack(title: Column, tags: Column, content: Column) -> Column:
    return F.lower(F.concat(title, F.lit("\n"), F.array_join(tags, " "), F.lit("\n"), content))


def lexical_scores(pairs: DataFrame, queries: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """pairs (qid, doc_id, ...) with lexical: 1 where the query stands in the record, else the share of its words that do.

    found: doc_id and token of words that records have (see sources/text_index.py); records: doc_id, title, kind, tags, content. Words are
    counted by joins. Texts are read only for pairs where all words meet but the first and the last, which may be parts of longer ones.
    """
    words = query_words(queries)
    met = pairs.select("qid", "doc_id").join(words, "qid").join(found.select("doc_id", "token"), ["doc_id", "token"])
    n = met.groupBy("qid", "doc_id").agg(F.count("*").alias("matched"))
    sizes = queries.select("qid", F.lower("text").alias("query"), F.size(text.tokens(c("text"))).alias("words"))
    counted = pairs.join(n, ["qid", "doc_id"], "left").join(sizes, "qid").withColumn("matched", F.coalesce("matched", F.lit(0)))
    whole = counted.filter(c("matched") >= c("words") - 2).select("qid", "doc_id", "query")
    hay = records.select("doc_id", haystack(c("title"), c("tags"), c("content")).alias("hay"))
    held = whole.join(hay, "doc_id").filter(c("hay").contains(c("query"))).select("qid", "doc_id", F.lit(True).alias("whole"))
    score = F.when(c("whole"), 1.0).when(c("words") == 0, 0.0).otherwise(c("matched") / c("words"))
    return counted.join(held, ["qid", "doc_id"], "left").withColumn("lexical", score).drop("matched", "words", "query", "whole")


def reciprocal(rank: Column) -> Column:
    return F.coalesce(RANK_OFFSET / (RANK_OFFSET + rank), F.lit(0.0))


def raw_score(mode: str) -> Column:
    """Over similarity, ranks, lexical (score) and taxonomy."""
    dense_rr, lexical_rr = reciprocal(c("dense_rank")), reciprocal(c("lexical_rank"))
    w = [lifecycle.weight(c("taxonomy"), i) for i in range(4)]
    similarity = F.coalesce(c("similarity"), F.lit(0.0))
    if mode == "lexical":
        return (w[1] * lexical_rr + w[2] * c("lexical")) / (w[1] + w[2])
    if mode == "dense":
        return (w[0] * similarity + w[1] * dense_rr) / (w[0] + w[1])
    both = (c("dense_rank").isNotNull() & c("lexical_rank").isNotNull()).cast("double")
    return w[0] * similarity + w[1] * (DENSE_SHARE * dense_rr + LEXICAL_SHARE * lexical_rr) + w[2] * c("lexical") + w[3] * both


def calibrated(raw: Column) -> Column:
    return 1 / (1 + F.exp(-10 * (raw - 0.55)))


def scored(candidates: DataFrame, mode: str, now_ms: int, least: float = 0.0, digits: int = 9) -> DataFrame:
    """candidates with score; those below the threshold go. It is never lower than the abstention threshold."""
    kept = lifecycle.retention(c("pinned"), c("kind"), c("updated_ms"), now_ms)
    told = lifecycle.feedback_factor(c("injected"), c("used"), c("ignored"), c("error"))
    whole = calibrated(raw_score(mode)) * kept * told * lifecycle.quality(c("importance"), c("confidence"))
    return candidates.withColumn("score", F.round(F.least(F.greatest(whole, F.lit(0.0)), F.lit(1.0)), digits)).filter(c("score") >= max(least, ABSTAIN_BELOW))


def fused(score: Column, graph_rank: Column, digits: int = 9) -> Column:
    """The score with the rank of a graph search, null where either is missing."""
    rrf = reciprocal(graph_rank)
    found = F.when(score.isNull(), GRAPH_ONLY_WEIGHT * rrf).when(graph_rank.isNull(), score).otherwise((1 - GRAPH_WEIGHT) * score + GRAPH_WEIGHT * rrf)
    return F.round(found, digits)


def with_graph(rows: DataFrame, graph_ranks: DataFrame, eligible: DataFrame, digits: int = 9) -> DataFrame:
    """rows (qid, doc_id, score, ...) fused with the ranks of a graph search (qid, doc_id, rank).

    What only the graph found comes in with its rank alone, if it is eligible; the threshold holds for all again.
    """
    ranks = graph_ranks.select("qid", "doc_id", c("rank").alias("graph_rank"))
    known = rows.join(ranks, ["qid", "doc_id"], "left")
    alone = ranks.join(rows.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(eligible, "doc_id").withColumn("score", F.lit(None).cast("double"))
    every = known.unionByName(alone, allowMissingColumns=True)
    return every.withColumn("score", fused(c("score"), c("graph_rank"), digits)).filter(c("score") >= ABSTAIN_BELOW)


def collapse_layers(rows: DataFrame) -> DataFrame:
    """Of a query's rows with one dedup key (kind and content as shown), the one of the scope that comes first, then score, time, id."""
    order = Window.partitionBy("qid", "dedup").orderBy(F.desc("precedence"), F.desc("score"), F.desc("updated_ms"), "doc_id")
    keyed = rows.withColumn("precedence", lifecycle.lookup(PRECEDENCE, c("scope")))
    return keyed.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("precedence", "place")


def _diversify(rows: pd.DataFrame, results: int, budget: int) -> pd.DataFrame:
    """Greedy: the best of relevance less likeness to what is chosen; what does not fit the budget is passed over."""
    rows = rows.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    sets = [frozenset(x) for x in rows["words"]]
    score, size = rows["score"].to_numpy(), rows["size"].to_numpy()
    alike, left, chosen, spent = np.zeros(len(rows)), np.ones(len(rows), bool), [], 0
    while left.any() and len(chosen) < results:
        value = np.where(left, np.round(MMR_RELEVANCE * score - (1 - MMR_RELEVANCE) * alike, 12), -np.inf)
        i = int(value.argmax())
        left[i] = False
        if spent + size[i] > budget:
            continue
        chosen.append(i)
        spent += int(size[i])
        for j in np.flatnonzero(left):
            union = len(sets[i] | sets[j])
            alike[j] = max(alike[j], len(sets[i] & sets[j]) / union if union else 0.0)
    out = rows.loc[chosen, ["qid", "doc_id", "score", "size"]]
    return out.assign(place=np.arange(len(out)))


def diversified(rows: DataFrame, results: int, budget: int) -> DataFrame:
    """qid, doc_id, score, size, place. A query has at most as many rows as its channels have candidates, a fixed number."""
    size = F.length("title") + F.length("shown") + F.aggregate("tags", F.lit(0), lambda s, x: s + F.length(x)) + RECORD_OVERHEAD
    words = text.tokens(F.concat_ws(" ", c("title"), F.array_join("tags", " "), c("shown")))
    slim = rows.select("qid", "doc_id", "score", size.cast("long").alias("size"), words.alias("words"))

    return slim.groupBy("qid").applyInPandas(lambda pdf: _diversify(pdf, results, budget), "qid long, doc_id long, score double, size long, place int")


def outcome(queries: DataFrame, results: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """qid, results, and why there are none: nothing is stored, no channel found anything, or nothing found was good enough."""
    n = results.groupBy("qid").agg(F.count("*").alias("results"))
    seen = candidates.select("qid").distinct().withColumn("seen", F.lit(True))
    empty = F.lit(records.isEmpty())
    reason = F.when(c("results").isNull(), F.when(empty, "empty_store").when(c("seen").isNull(), "no_candidates").otherwise("low_relevance_or_ineligible"))
    return queries.select("qid").join(n, "qid", "left").join(seen, "qid", "left").select("qid", F.coalesce("results", F.lit(0)).cast("long").alias("results"), reason.alias("abstained"))


def score_version(mode: str, graph: bool = False) -> str:
    """What a score was made by: those of different versions are not comparable."""
    return f"{mode}{'+graph' if graph else ''}-v1"


def retrievals(queries: DataFrame, packed: DataFrame, now_ms: int, generation: str, version: str) -> DataFrame:
    """A row for each query that got results: retrieval_id, qid, doc_ids in order, at_ms, version."""
    lists = packed.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    own = ids.retrieval_id(c("text"), F.lit(now_ms), F.lit(generation), c("doc_ids"))
    return lists.join(queries, "qid").select(own.alias("retrieval_id"), "qid", "doc_ids", F.lit(now_ms).cast("long").alias("at_ms"), F.lit(version).alias("version"))
