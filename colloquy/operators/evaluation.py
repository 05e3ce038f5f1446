"""Graded ranking metrics, abstention, and ranker comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.operators.ordered import Ordered


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def query_scores(ranked: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """recall@k, reciprocal rank and nDCG@k per question.

    `ranked`: `query_id, uuid, rank` from 1; `labels`: `query_id, uuid, grade`; `queries`: every `query_id`, so that
    a question nothing was found for still counts.
    """
    mine = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "uuid")
    ideal = labels.withColumn("_i", F.row_number().over(mine)).groupBy("query_id").agg(
        F.least(F.count(F.lit(1)), F.lit(k)).alias("reachable"),
        F.sum(F.when(F.col("_i") <= k, _gain(F.col("grade")) / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("idcg"),
    )
    found = ranked.where(F.col("rank") <= k).join(labels, ["query_id", "uuid"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(_gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    return queries.select("query_id", *[c for c in ("kind", "ask") if c in queries.columns]).join(ideal, "query_id", "left").join(
        found, "query_id", "left"
    ).withColumns(
        {
            "recall": F.coalesce(F.col("hits") / F.col("reachable"), F.lit(0.0)),
            "reciprocal_rank": F.coalesce(1 / F.col("first"), F.lit(0.0)),
            "ndcg": F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)),
        }
    ).drop("reachable", "idcg", "hits", "first", "dcg")


def summarise(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Means over all questions; with `by`, one more row per value of it."""
    means = [
        F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall_at_k"), F.avg("reciprocal_rank").alias("mrr"),
        F.avg("ndcg").alias("ndcg_at_k"),
    ]
    if by is None:
        return scores.agg(*means)
    return scores.rollup(by).agg(F.grouping(by).alias("_all"), *means).withColumn(
        by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by))
    ).drop("_all")


def abstention(outcomes: DataFrame) -> DataFrame:
    """One row: unanswerable questions answered, answerable ones withheld, and the score's AUC.

    `outcomes`: `answerable, best, abstained`. The AUC comes from counts per distinct score and their running
    total, not from pairing every answerable question with every other.
    """
    rows = outcomes.withColumns(
        {"_score": F.coalesce("best", F.lit(0.0)), "_answer": F.col("best").isNotNull() & ~F.col("abstained")}
    )
    yes, no = F.col("answerable"), ~F.col("answerable")
    levels = rows.groupBy("_score").agg(F.count_if(yes).alias("p"), F.count_if(no).alias("u"))
    below = Ordered.of(levels, [], ["_score"]).running_sum("_cum", F.col("u")).done()
    wins = below.agg(F.sum(F.col("p") * (F.col("_cum") - F.col("u") + F.col("u") / 2)).alias("w")).scalar()
    counts = rows.agg(
        F.count_if(no).alias("queries"), F.count_if(yes).alias("_p"), F.count_if(no & F.col("_answer")).alias("_a"),
        F.count_if(yes & ~F.col("_answer")).alias("_w"),
    )
    one = F.lit(1)
    return counts.withColumn("_wins", wins).select(
        "queries", (F.col("_a") / F.greatest("queries", one)).alias("answered"), (F.col("_w") / F.greatest("_p", one)).alias("withheld"),
        (F.coalesce("_wins", F.lit(0.0)) / F.greatest(F.col("_p") * F.col("queries"), one)).alias("auc"),
    )


def ranked_rows(lists: DataFrame) -> DataFrame:
    """`{id, ranked[]}` lines as `query_id, uuid, rank`."""
    return lists.select(F.col("id").alias("query_id"), F.posexplode("ranked").alias("pos", "uuid")).select(
        "query_id", "uuid", (F.col("pos") + 1).alias("rank")
    )


def agreement(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Per question answered by both: top-k overlap and the rank correlation of what they share."""
    a = left.where(F.col("rank") <= k).select("query_id", "uuid", F.col("rank").alias("ra"))
    b = right.where(F.col("rank") <= k).select("query_id", "uuid", F.col("rank").alias("rb"))
    sizes = a.groupBy("query_id").agg(F.count(F.lit(1)).alias("na")).join(
        b.groupBy("query_id").agg(F.count(F.lit(1)).alias("nb")), "query_id"
    )
    both = a.join(b, ["query_id", "uuid"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("shared"), F.corr("ra", "rb").alias("rho"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb")
    )
    flat = (F.col("va") == 0) | (F.col("vb") == 0)
    return sizes.join(both, "query_id", "left").select(
        "query_id", (F.coalesce("shared", F.lit(0)) / F.greatest("na", "nb")).alias("overlap"),
        F.when(F.col("shared") >= 2, F.when(flat, 1.0).otherwise(F.col("rho"))).alias("spearman"),
    )


def compare(queries: DataFrame, labels: DataFrame, left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Both rankers' means, their overlap and correlation, over the questions both answered."""
    shared = queries.join(left.select("query_id").distinct(), "query_id", "left_semi").join(
        right.select("query_id").distinct(), "query_id", "left_semi"
    )
    sides = []
    for name, rows in (("left", left), ("right", right)):
        means = summarise(query_scores(rows, labels, shared, k))
        sides.append(means.select(*[F.col(c).alias(f"{name}_{c}") for c in ("recall_at_k", "mrr", "ndcg_at_k")]))
    both = agreement(left, right, k).join(shared.select("query_id"), "query_id", "left_semi").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("overlap").alias("overlap_at_k"), F.avg("spearman").alias("spearman"),
        F.count("spearman").alias("spearman_queries"),
    )
    return both.withColumns({c: side.select(c).scalar() for side in sides for c in side.columns})


def evidence_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' evidence side by side: rank and score of each, and whether a turn is shared, moved or in one only."""
    left = a.select("query_id", "uuid", F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    right = b.select("query_id", "uuid", F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    state = F.when(F.col("rank_b").isNull(), "only a").when(F.col("rank_a").isNull(), "only b").when(
        F.col("rank_a") == F.col("rank_b"), "shared"
    ).otherwise("moved")
    return left.join(right, ["query_id", "uuid"], "full_outer").withColumn("state", state)


def tokens_per_answer(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    total = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    return evidence.agg((F.coalesce(F.sum(text.token_estimate(F.col("text"))), F.lit(0)) / total).alias("tokens_per_answer"))


def is_right(labeled: Column, verdict: Column) -> Column:
    """A question nothing answers is right when declined."""
    return F.when(labeled == 0, verdict == "abstained").otherwise(verdict == "correct")


def references(labels: DataFrame) -> DataFrame:
    """The turns an answer is graded against: those graded 2 or more, else all that are labeled."""
    best = labels.groupBy("query_id").agg(F.max("grade").alias("_best"))
    return labels.join(best, "query_id").where((F.col("_best") < 2) | (F.col("grade") >= 2)).drop("_best")


def verdict_summary(results: DataFrame) -> DataFrame:
    """Counts per verdict and means, per kind of question and over all (`ask = 'all'`)."""
    verdicts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("wrong", "abstained", "unjudged")]
    rows = results.rollup("ask").agg(
        F.grouping("ask").alias("_all"), F.count(F.lit(1)).alias("questions"), F.count_if("right").alias("right"), *verdicts,
        F.count_if(F.col("verdict") == "error").alias("errors"), F.count_if("cut_off").alias("cut_off"),
        F.avg("tool_calls").alias("tool_calls_mean"), F.avg("prompt_tokens").alias("prompt_tokens_mean"),
    )
    judged = F.col("questions") - F.col("errors")
    return rows.withColumns(
        {
            "ask": F.when(F.col("_all") == 1, "all").otherwise(F.col("ask")),
            "accuracy": F.when(judged == 0, 0.0).otherwise(F.col("right") / judged),
        }
    ).drop("_all")


def history_line(summary: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """A recording: the summary with the probe metrics that exist for it."""
    return summary.join(probes, keys, "left")


def history_pivot(runs: DataFrame, metric: str, series: list[str] | None = None) -> DataFrame:
    """One row per recording, one column per profile and embedder."""
    named = runs.withColumn("series", F.concat_ws(" · ", "profile", "embedder"))
    grouped = named.groupBy("recorded_at", "commit")
    pivoted = grouped.pivot("series", series) if series else grouped.pivot("series")
    return pivoted.agg(F.first(metric))
