"""Metrics of retrieval, refusal and generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlwork.functions.text import holds_any, stripped, tokens

#: What the reward looks for in a response. Fixed values.
CITING = ["section ea-", "employment act section", "section", "act", "provision", "subsection"]
GROUNDED = ["employment act", "according to", "based on", "under", "specified", "states"]
LEGAL = ["entitled", "rights", "compensation", "leave", "notice", "termination", "salary"]
INVENTED = ["triple compensation", "section ea-99", "section ea-999"]
GENERIC = ["consult", "check with", "speak to hr", "contact"]


def retrieval(hits: DataFrame, gold: DataFrame, ks=(1, 3, 5, 8, 10), ndcg_ks=(5, 8, 10)) -> DataFrame:
    """Recall, reciprocal rank and discounted gain of each query.

    hits: query_id, rank, relevant; gold: query_id, n_gold. Recall counts relevant rows, capped at 1; the gain of rank 1
    is 1, that of rank i is 1/log2(i), so that the first two ranks weigh alike.
    """
    rank, relevant = F.col("rank"), F.col("relevant")
    weight = F.when(rank == 1, F.lit(1.0)).otherwise(1.0 / F.log2(F.greatest(rank, F.lit(2)).cast("double")))
    sums = [F.sum(F.when((rank <= k) & relevant, 1).otherwise(0)).alias(f"r{k}") for k in ks]
    gains = [F.sum(F.when((rank <= k) & relevant, weight).otherwise(F.lit(0.0))).alias(f"g{k}") for k in ndcg_ks]
    found = hits.groupBy("query_id").agg(*sums, *gains, F.min(F.when(relevant, rank)).alias("first"))
    joined = gold.join(found, "query_id", "left")

    def ideal(k: int) -> Column:
        at = F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int"))
        return F.aggregate(at, F.lit(0.0), lambda s, i: s + F.when(i == 1, F.lit(1.0)).otherwise(1.0 / F.log2(F.greatest(i, F.lit(2)).cast("double"))))

    recalls = [F.round(F.least(F.coalesce(f"r{k}", F.lit(0)) / F.col("n_gold"), F.lit(1.0)), 6).alias(f"recall_{k}") for k in ks]
    gained = [F.round(F.coalesce(f"g{k}", F.lit(0.0)) / ideal(k), 6).alias(f"ndcg_{k}") for k in ndcg_ks]
    return joined.select("query_id", *recalls, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), *gained)


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of rows (predicted, actual) for each value of `by` and in total."""
    flag = lambda p, a: F.sum(F.when((F.col("predicted") == p) & (F.col("actual") == a), 1).otherwise(0))
    out = rows.rollup(by).agg(flag(True, True).alias("tp"), flag(True, False).alias("fp"), flag(False, True).alias("fn"), flag(False, False).alias("tn"))
    safe = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = out.withColumn("p", safe(tp, tp + fp)).withColumn("r", safe(tp, tp + fn))
    return out.select(by, "tp", "fp", "fn", "tn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(safe(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"), F.round(safe(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"))


def overlap_match(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """1 if the sets share a member, and their intersection over union; 0 for two empty sets."""
    common, union = F.size(F.array_intersect(predicted, gold)), F.size(F.array_union(predicted, gold))
    return (common > 0).cast("double"), F.when(union == 0, F.lit(0.0)).otherwise(common / union)


def exact_match(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """1 if the sets are equal, and their intersection over union, which is 1 where nothing was to be found."""
    common, union = F.size(F.array_intersect(predicted, gold)), F.size(F.array_union(predicted, gold))
    none = F.size(gold) == 0
    return F.when(none, F.size(predicted) == 0).otherwise(common == union).cast("double"), F.when(none, F.lit(1.0)).otherwise(common / union)


def reward(response: Column) -> Column:
    """A response's heuristic reward."""
    low, words = F.lower(response), tokens(response)
    add = lambda ok, value: F.when(ok, F.lit(value)).otherwise(F.lit(0.0))
    return F.round(
        add((F.length(stripped(response)) > 20) & ~low.startswith("i cannot"), 0.5)
        + add(holds_any(low, CITING), 1.0)
        + add(holds_any(low, GROUNDED), 1.0)
        + add(holds_any(low, LEGAL), 0.3)
        + add(holds_any(low, INVENTED), -2.0)
        + add(holds_any(low, GENERIC), -3.0)
        + add(F.length(response) > 400, -0.2)
        + add((F.size(words) > 10) & (F.size(F.array_distinct(words)) / F.size(words) < 0.6), -0.5),
        6,
    )


def reward_rates(rows: DataFrame, reward: str) -> DataFrame:
    """One row: n, mean, sample deviation, how many rewards are above, at and below 0, and their shares."""
    r = F.col(reward)
    count = lambda ok: F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0))
    out = rows.agg(F.count(r).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_samp(r), 6).alias("deviation"), count(r > 0).alias("positive"), count(r == 0).alias("neutral"), count(r < 0).alias("negative"))
    return out.select("*", *(F.round(F.coalesce(F.try_divide(F.col(x), F.col("n")), F.lit(0.0)), 6).alias(f"{x}_rate") for x in ("positive", "neutral", "negative")))


def normalised_rewards(rows: DataFrame, reward: str) -> DataFrame:
    """rows with `normal`: the reward less its mean, by its deviation; 0 everywhere for a single row."""
    total = rows.agg(F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("deviation"))  # one row
    return rows.crossJoin(F.broadcast(total)).withColumn("normal", (F.col(reward) - F.col("mean")) / (F.col("deviation") + 1e-8)).drop("mean", "deviation")


def histogram(rows: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """by, bound (null: none) and n: how many values are at most the bound, as cumulative buckets."""
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(by).agg(*counts, F.count("*").alias("every"))
    buckets = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    last = F.struct(F.lit(None).cast("double").alias("bound"), F.col("every").alias("n"))
    return wide.select(by, F.explode(F.array(*buckets, last)).alias("x")).select(by, "x.bound", "x.n")
