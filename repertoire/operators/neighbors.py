"""Nearest-neighbour scores, interpolated ranks and ROC areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def neighbor_scores(nearest: DataFrame, percentiles: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """(.., percentile, nbrdist, wtd_nbrdist) of the sorted (d, n) counts that ``nearest_distances`` gives, or of
    sorted arrays of distances.

    The plain score is the mean of the smallest ``pct`` percent (at least one; a negative percentile is
    a count); the weighted one falls linearly from weight one. Both are 0 where there is no distance.
    """
    if nearest.schema["nearest"].dataType.elementType.typeName() != "struct":
        nearest = nearest.withColumn("nearest", F.transform("nearest", lambda x: F.struct(x.cast("double").alias("d"), F.lit(1).cast("long").alias("n"))))
    rows = nearest.withColumn("percentile", F.explode(F.array(*[F.lit(p) for p in percentiles])))
    p, n = F.col("percentile"), F.col("n")
    asked = F.when(p < 0, F.least(n, -p)).otherwise(F.floor(p * n / 100))
    rows = rows.withColumn("k", F.greatest(F.lit(1), asked).cast("double"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("seen"), zero.alias("plain"), zero.alias("top"))

    def add(t: Column, x: Column) -> Column:
        # of the values in order, those from number t.seen on; the i-th has weight 1 - i / k
        take = F.least(x["n"].cast("double"), F.col("k") - t["seen"])
        weight = take - (t["seen"] * take + take * (take - 1) / 2) / F.col("k")
        return F.struct((t["seen"] + take).alias("seen"), (t["plain"] + x["d"] * take).alias("plain"), (t["top"] + x["d"] * weight).alias("top"))

    rows = rows.withColumn("__s", F.aggregate("nearest", start, add))
    none = F.col("n") == 0
    keys = [c for c in nearest.columns if c not in ("n", "nearest")]
    return rows.select(
        *keys, "percentile", F.when(none, 0.0).otherwise(F.col("__s.plain") / F.col("k")).alias("nbrdist"), F.when(none, 0.0).otherwise(F.col("__s.top") / ((F.col("k") + 1) / 2)).alias("wtd_nbrdist")
    )


def interpolated_rank(scores: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Adds the percentile rank of each value among the values of its group, interpolated between the
    nearest different values. Values are distinct after rounding to six decimals, so groups of ties are
    counted once and the window runs over distinct values."""
    v = F.round(value, 6)
    counts = scores.groupBy(*keys, v.alias("__v")).agg(F.count(F.lit(1)).alias("__e"))
    w = Window.partitionBy(*keys).orderBy("__v")
    lower = F.coalesce(F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__e").over(Window.partitionBy(*keys))
    ranked = counts.select(*keys, "__v", "__e", lower.alias("__l"), total.alias("__t"), F.lag("__v").over(w).alias("__ln"), F.lead("__v").over(w).alias("__un"))
    inside = 100.0 * (F.col("__l") + (F.col("__v") - F.col("__ln")) / (F.col("__un") - F.col("__ln")) * (1 + F.col("__e"))) / F.col("__t")
    rank = F.when(F.col("__un").isNull(), 100.0).when(F.col("__ln").isNull(), 0.0).otherwise(inside)
    ranked = ranked.select(*keys, "__v", rank.alias(out))
    return scores.withColumn("__v", v).join(ranked, [*keys, "__v"]).drop("__v")


def roc_area(scores: DataFrame, keys: list[str], score: Column, positive: Column) -> DataFrame:
    """(keys, auc): area under the step curve, lower scores better, ties count false positives first;
    0 without positives, 1 without negatives. Positives and negatives are pre-summed by score."""
    binned = scores.groupBy(*keys, score.alias("__s")).agg(F.sum(positive.cast("long")).alias("__p"), F.sum((~positive).cast("long")).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    steps = binned.withColumn("__before", F.coalesce(F.sum("__p").over(w), F.lit(0)))
    area = steps.groupBy(*keys).agg(F.sum(F.col("__before") * F.col("__n")).alias("__a"), F.sum("__p").alias("__tp"), F.sum("__n").alias("__tn"))
    auc = F.when(F.col("__tp") == 0, 0.0).when(F.col("__tn") == 0, 1.0).otherwise(F.col("__a") / (F.col("__tp") * F.col("__tn")))
    return area.select(*keys, auc.alias("auc"))


def rank_against(values: DataFrame, reference: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """``values`` with the interpolated rank of each value within the key's reference values.

    100 if no reference value is above, else 0 if none is below, else the values below plus the share of
    the gap, in per cent of all. Equal values are counted first, so a window holds distinct values only.
    """
    v = F.col(value)
    marked = values.select(*keys, v, F.lit(0).alias("__r")).unionAll(reference.select(*keys, v, F.lit(1).alias("__r")))
    counts = marked.groupBy(*keys, value).agg(F.sum("__r").alias("e"))
    order, back = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys).orderBy(F.desc(value))
    # a frame up to the end of a group is gone through for every row, one from its start is not
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("e") > 0, v)
    placed = counts.select(
        *keys, value, "e", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("l"), F.max(known).over(before).alias("ln"),
        F.min(known).over(after).alias("un"), F.sum("e").over(Window.partitionBy(*keys)).alias("t"),
    )
    share = F.col("l") + (v - F.col("ln")) / (F.col("un") - F.col("ln")) * (1 + F.col("e"))
    rank = F.when(F.col("un").isNull(), 100.0).when(F.col("ln").isNull(), 0.0).otherwise(100.0 * share / F.col("t"))
    return values.join(placed.select(*keys, value, rank.alias(out)), [*keys, value])


def symmetrised(ranks: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a1 <= a2, value): the mean of a value both ways."""
    back = ranks.select(F.col(b).alias(a), F.col(a).alias(b), F.col(value).alias("__v"))
    both = ranks.join(back, [a, b]).where(F.col(a) <= F.col(b))
    return both.select(F.col(a).alias(f"{a}1"), F.col(b).alias(f"{a}2"), ((F.col(value) + F.col("__v")) / 2).alias(value))


def repertoire_closeness(histogram: DataFrame, threshold: float, percent: int = 10) -> DataFrame:
    """(epitope1, epitope2, chains, wtd_nbrdist, closeness) from counts of all distances between two repertoires:
    the weighted score of the smallest ``percent`` of them, and the fourth root of the mean of
    (limit - d) / limit, 0 above the limit, which is ``threshold`` a chain."""
    keys = ["epitope1", "epitope2", "chains"]
    lists = histogram.groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "n"))).alias("nearest"))
    score = neighbor_scores(lists, (percent,)).select(*keys, "wtd_nbrdist")
    limit = F.lit(threshold) * F.length("chains")
    near = F.greatest(F.lit(0.0), (limit - F.col("d")) / limit) * F.col("n")
    close = histogram.groupBy(*keys).agg(F.pow(F.sum(near) / F.sum("n"), F.lit(0.25)).alias("closeness"))
    return score.join(close, keys)
