"""Retrieval metrics, comparison of runs and token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_relevant_rank(questions: DataFrame, ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """``query_id, first_rank`` for every question; null when nothing relevant was found.

    ``questions``: ``query_id``; ``ranking``: ``query_id, doc, rank``; ``relevant``:
    ``query_id, doc``. Repeated questions and judgements count once.
    """
    hits = ranking.join(relevant.select("query_id", "doc").distinct(), ["query_id", "doc"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return questions.select("query_id").distinct().join(hits, "query_id", "left")


def hit_metrics(ranks: DataFrame, cutoffs: tuple[int, ...] = (5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rates at cut-offs and mean reciprocal rank over all questions; null ranks are misses."""
    r = F.col("first_rank")
    aggs = [F.count(F.lit(1)).alias("n_questions")]
    aggs += [F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in cutoffs]
    aggs.append(F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))
    return ranks.groupBy(*by).agg(*aggs)


def source_recall(expected: DataFrame, ranking: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per question: first rank of an expected source, and the part of them found at cut-offs.

    ``expected``: ``query_id, expected`` (distinct rows); ``ranking``: ``query_id, group,
    rank``, where several rows may belong to one group (a method's chunks).
    """
    e = expected.distinct()
    total = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    best = ranking.groupBy("query_id", "group").agg(F.min("rank").alias("rank"))
    found = e.join(best, (e["query_id"] == best["query_id"]) & (e["expected"] == best["group"])).select(e["query_id"], "rank")
    per = found.groupBy("query_id").agg(F.min("rank").alias("first_rank"), *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"n_{k}") for k in cutoffs))
    return total.join(per, "query_id", "left").select(
        "query_id", "n_expected", "first_rank", *(F.round(F.coalesce(f"n_{k}", F.lit(0)) / F.col("n_expected"), 6).alias(f"source_recall_at_{k}") for k in cutoffs)
    )


def source_metrics(recall: DataFrame, questions: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row over :func:`source_recall`: hit rates, mean source recall, reciprocal rank, and skipped questions.

    ``questions``: ``query_id``; those without an expected source are skipped and only
    counted. No question left is an error, raised when the row is read.
    """
    r, n = F.col("first_rank"), F.count(F.lit(1))
    means = recall.agg(
        F.when(n > 0, n).otherwise(F.raise_error("no question expects a source").cast("long")).alias("n_questions"),
        *(F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}") for k in cutoffs),
        *(F.round(F.avg(f"source_recall_at_{k}"), 6).alias(f"source_recall_at_{k}") for k in cutoffs),
        F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"),
    )
    all_ = questions.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    # two frames of one row
    return means.join(F.broadcast(all_)).withColumn("n_skipped", F.col("n_all") - F.col("n_questions")).drop("n_all")


def prefix_metrics(recall: DataFrame) -> DataFrame:
    """One row over :func:`prefix_recall`: questions, hit rate and mean source recall."""
    return recall.agg(F.count(F.lit(1)).alias("n_questions"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("source_recall"), 6).alias("source_recall"))


def rubric(graded: DataFrame, criteria: tuple[str, ...], best: int = 2) -> DataFrame:
    """``model``, the sum of each criterion, and the total with its share of what could be had.

    ``graded``: ``model`` and a grade from 0 to ``best`` per criterion; a row with a null
    grade is not graded yet and left out.
    """
    done = graded.dropna(subset=list(criteria))
    total = sum((F.col(c) for c in criteria), F.lit(0))
    out_of = best * len(criteria)
    return done.groupBy("model").agg(
        *(F.sum(c).cast("long").alias(c) for c in criteria), F.sum(total).cast("long").alias("score"), (out_of * F.count(F.lit(1))).cast("long").alias("out_of"), F.round(F.sum(total) / (out_of * F.count(F.lit(1))), 6).alias("share")
    )


def prefix_recall(expected: DataFrame, ranking: DataFrame, separator: str = "::") -> DataFrame:
    """Per question: expected sources found by id or by a leading part of an id.

    Ids are exploded into their leading parts, so the prefix match is an equi-join.
    """
    from marram.operators.references import leading_parts

    e = expected.distinct()
    keys = ranking.select("query_id", F.explode(F.array_union(F.array("id"), leading_parts(F.col("id"), separator))).alias("expected")).distinct()
    found = e.join(keys, ["query_id", "expected"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))
    total = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    n = F.coalesce("n_found", F.lit(0))
    return total.join(found, "query_id", "left").select(
        "query_id", "n_expected", n.cast("long").alias("n_found"), (n > 0).cast("long").alias("hit"), F.round(n / F.col("n_expected"), 6).alias("source_recall")
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often run ``a`` is better, worse or equal to ``b`` on ``query_id, first_rank``; null is last."""
    far = F.lit(float("inf"))
    x, y = F.coalesce(F.col("ra").cast("double"), far), F.coalesce(F.col("rb").cast("double"), far)
    j = a.select("query_id", F.col("first_rank").alias("ra")).join(b.select("query_id", F.col("first_rank").alias("rb")), "query_id")
    return j.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count(F.when(x < y, 1)).alias("a_better"),
        F.count(F.when(x > y, 1)).alias("b_better"),
        F.count(F.when(x == y, 1)).alias("equal"),
    )


def length_statistics(lengths: DataFrame, limit: int) -> DataFrame:
    """One row over ``id, tokens``: mean, quantiles (linear between ranks), extremes and what exceeds ``limit``."""
    t = F.col("tokens")
    q = F.percentile(t, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    # a length occurs often: the exact quantiles keep one entry a distinct length
    s = lengths.agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("mean"), q.alias("q"), F.min(t).alias("min"), F.max(t).alias("max"), F.count(F.when(t > limit, 1)).alias("over_limit")
    )
    return s.select(
        "n",
        F.round("mean", 6).alias("mean"),
        F.round(F.get("q", 0), 6).alias("median"),
        F.round(F.get("q", 1), 6).alias("p95"),
        F.round(F.get("q", 2), 6).alias("p99"),
        "min",
        "max",
        F.lit(limit).cast("long").alias("model_limit"),
        "over_limit",
        F.round(F.try_divide(100.0 * F.col("over_limit"), F.col("n")), 6).alias("percentage_over_limit"),
    )


def longest(lengths: DataFrame, limit: int, n: int = 30) -> DataFrame:
    """The ``n`` longest rows of ``id, tokens`` above ``limit``; ties go to the smaller id."""
    w = Window.orderBy(F.col("tokens").desc(), F.col("id"))
    top = lengths.where(F.col("tokens") > limit).orderBy(F.col("tokens").desc(), F.col("id")).limit(n)
    return top.withColumn("position", F.row_number().over(w).cast("long"))
