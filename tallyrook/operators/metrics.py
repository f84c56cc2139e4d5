"""Quality of rankings: precision, recall, hits, reciprocal rank, discounted gain, abstention."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def per_query(graded: DataFrame, queries: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """A row for each mode and query with hits, gains and first hit, from graded (mode, qid, doc_id, place from 0, grade or null).

    queries: qid, answerable, relevant (how many records are) and high (how many of those have grade 2, the others 1). All is joins and
    sums: no ranking is collected, and what is relevant is counted, not listed.
    """
    c = F.col
    hit, gain = c("grade").isNotNull(), lambda grade, place: (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 2.0)
    aggs = [F.count_if(hit & (c("place") < k)).alias(f"hits_{k}") for k in KS] + [F.count_if(c("place") < k).alias(f"returned_{k}") for k in KS]
    dcg = F.sum(F.when(hit & (c("place") < max(KS)), gain(c("grade"), c("place"))))
    got = graded.groupBy("mode", "qid").agg(*aggs, F.min(F.when(hit, c("place"))).alias("first_hit"), dcg.alias("dcg"), F.count("*").alias("returned"))
    ideal = reduce(add, (F.when(c("relevant") > p, gain(F.when(c("high") > p, 2).otherwise(1), F.lit(p))).otherwise(0.0) for p in range(max(KS))))
    every = queries.withColumns({"ideal": ideal, "mode": F.explode(F.array(*map(F.lit, modes)))})
    return every.join(got, ["mode", "qid"], "left").fillna(0)


def summary(rows: DataFrame, by: str = "mode", digits: int = 9) -> DataFrame:
    """Means over answerable queries; empty denominators give 0."""
    c = F.col
    answerable, out = c("answerable"), []
    mean = lambda x: F.round(F.coalesce(F.avg(F.when(answerable, x)), F.lit(0.0)), digits)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    for k in KS:
        out += [mean(ratio(c(f"hits_{k}"), c(f"returned_{k}"))).alias(f"precision_{k}"), mean(ratio(c(f"hits_{k}"), c("relevant"))).alias(f"recall_{k}"), mean((c(f"hits_{k}") > 0).cast("double")).alias(f"hit_{k}")]
    out.append(mean(F.when((c("hits_10") > 0), 1 / (c("first_hit") + 1.0)).otherwise(0.0)).alias("mrr_10"))
    out.append(mean(ratio(c("dcg"), c("ideal"))).alias("ndcg_10"))
    out.append(mean((c("returned") > 0).cast("double")).alias("answerable_coverage"))
    out.append(mean((c("returned") == 0).cast("double")).alias("false_abstention"))
    out.append(F.round(F.coalesce(F.avg(F.when(~answerable, (c("returned") == 0).cast("double"))), F.lit(0.0)), digits).alias("specificity"))
    return rows.groupBy(by).agg(F.count("*").alias("queries"), *out)
