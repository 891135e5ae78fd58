"""Measures of answers against known ones: the rank of the first hit that matches, recall, correctness, unsupported answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule import params
from ferrule.functions import python_udfs
from ferrule.functions import text as T

# Fixed value: the least ratio of matching blocks at which two texts count as the same.
ALIKE = 0.72


def _plain(x: Column) -> Column:
    return F.lower(T.squash(x))


def match_ranks(hits: DataFrame, targets: DataFrame, least: float = ALIKE) -> DataFrame:
    """(query_id, match_rank): the first of hits (query_id, rank, text) that holds a target (query_id, target), lies in one, or is alike.

    The ratio is told only for pairs of one question whose lengths allow it: with lengths a and b it is 2 min(a, b) / (a + b) at most.
    """
    t = targets.select("query_id", _plain(F.col("target")).alias("_t")).where("_t <> ''").distinct()
    pairs = hits.select("query_id", "rank", _plain(F.col("text")).alias("_c")).where("_c <> ''").join(t, "query_id")
    holds = F.contains("_c", F.col("_t")) | F.contains("_t", F.col("_c"))
    pairs = pairs.withColumn("_holds", holds).withColumn("_may", 2 * F.least(F.length("_c"), F.length("_t")) >= least * (F.length("_c") + F.length("_t")))
    sure = pairs.where("_holds").select("query_id", "rank")
    alike = pairs.where("not _holds and _may").where(python_udfs.similarity("_c", "_t") >= least).select("query_id", "rank")
    return sure.unionByName(alike).groupBy("query_id").agg(F.min("rank").alias("match_rank"))


def details(hits: DataFrame, answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, match_rank, answer_correctness, hallucinated, status) of answers (query_id, status, answer), for truth (query_id, ground_truth, context).

    An answer is right if it holds the truth, else as far as the two are alike. It counts as made up if it isn't a refusal and none of the hits supports its words.
    """
    targets = truth.select("query_id", F.explode(F.concat(F.array("ground_truth"), F.coalesce("context", F.array().cast("array<string>")))).alias("target"))
    x = truth.select("query_id", "ground_truth").join(answers, "query_id", "left").join(match_ranks(hits, targets), "query_id", "left")
    seen = hits.groupBy("query_id").agg(F.array_join(F.collect_list("text"), " ").alias("_seen"))
    x = x.join(seen, "query_id", "left").withColumn("_a", _plain(F.col("answer"))).withColumn("_g", _plain(F.col("ground_truth")))
    right = F.when(F.col("_g") == "", 0.0).when(F.contains("_a", F.col("_g")), 1.0).otherwise(python_udfs.similarity("_a", "_g"))
    words = F.filter(T.token_set(F.col("answer")), lambda t: ~t.isin(*params.GROUNDING_STOPWORDS))
    made_up = (F.col("_a") != "") & (F.col("_a") != params.REFUSAL.lower()) & (F.size(F.array_except(words, T.token_set(F.col("_seen")))) > 0)
    return x.select("query_id", "match_rank", F.round(right, 4).alias("answer_correctness"), made_up.alias("hallucinated"), "status")


def summary(details_: DataFrame) -> DataFrame:
    """One row: samples, recall at 3, 5 and 10, mean reciprocal rank, correctness and the share of made-up answers; zeros without samples."""
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    at = lambda k: share(F.when(F.col("match_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall{k}")
    return details_.agg(
        F.count("*").alias("samples"), at(3), at(5), at(10), share(F.when(F.col("match_rank") <= 10, 1 / F.col("match_rank")).otherwise(0.0)).alias("mrr10"), share(F.col("answer_correctness")).alias("answer_correctness"),
        share(F.col("hallucinated").cast("double")).alias("hallucination_rate"),
    )
