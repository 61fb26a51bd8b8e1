"""Statistics: correlations, tests, densities. Special functions run in small Arrow UDFs over summed rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repertoire.operators.distance import in_own_blocks


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@F.pandas_udf(_doubles("low", "high"))
def binomial_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Smallest interval of a grid of log probabilities (step 0.01) around k/n with 95% of the likelihood."""
    low, high = [], []
    for a, b in zip(k.astype(float), n.astype(float), strict=True):
        if not a or not b:
            low.append(0.0)
            high.append(0.0)
            continue
        center = math.log(a / b)
        grid = center + 0.01 * np.arange(-1000, 1001)
        grid = grid[grid < 0]
        like = a * grid + (b - a) * np.log1p(-np.exp(grid))
        w = np.exp(like - like.max()) * np.exp(grid)
        order = np.argsort(-w, kind="stable")
        take = order[: int(np.searchsorted(np.cumsum(w[order]) / w.sum(), 0.95)) + 1]
        low.append(float(np.exp(grid[take].min())))
        high.append(float(np.exp(grid[take].max())))
    return pd.DataFrame({"low": low, "high": high})


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def _hypergeometric(k: int, total: int, marked: int, drawn: int, upper: bool) -> float:
    """P(X >= k) or P(X <= k) of marked items among those drawn."""
    ks = range(k, min(marked, drawn) + 1) if upper else range(max(0, drawn + marked - total), k + 1)
    base = _log_choose(total, drawn)
    return min(1.0, sum(math.exp(_log_choose(marked, x) + _log_choose(total - marked, drawn - x) - base) for x in ks))


@F.pandas_udf(_doubles("enriched", "depleted"))
def hypergeometric_tails(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.DataFrame:
    rows = [(int(a), int(t), int(m), int(d)) for a, t, m, d in zip(k, total, marked, drawn, strict=True)]
    return pd.DataFrame({"enriched": [_hypergeometric(*r, True) for r in rows], "depleted": [_hypergeometric(*r, False) for r in rows]})


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of a 2x2 table: all tables no likelier than the observed one."""
    out = []
    for w, x, y, z in zip(a, b, c, d, strict=True):
        w, x, y, z = int(w), int(x), int(y), int(z)
        total, marked, drawn = w + x + y + z, w + x, w + y
        logs = [_log_choose(marked, k) + _log_choose(total - marked, drawn - k) - _log_choose(total, drawn) for k in range(max(0, drawn + marked - total), min(marked, drawn) + 1)]
        own = _log_choose(marked, w) + _log_choose(total - marked, drawn - w) - _log_choose(total, drawn)
        out.append(min(1.0, sum(math.exp(v) for v in logs if v <= own + 1e-7)))
    return pd.Series(out)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([1.0 if v != v else _incomplete_beta(n / 2, 0.5, n / (n + v * v)) for v, n in zip(t.astype(float), df.astype(float), strict=True)])


def t_test(df: DataFrame, keys: list[str], value: Column, flag: Column, *, welch: bool = False) -> DataFrame:
    """(keys, t, p) of a score between flagged and other rows, pooled or Welch."""
    one = lambda f, k: [g(F.when(f, value)).alias(f"{n}{k}") for n, g in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    s = df.groupBy(*keys).agg(*one(flag, 1), *one(~flag, 0))
    m1, m0, v1, v0, n1, n0 = (F.col(c) for c in ("m1", "m0", "v1", "v0", "n1", "n0"))
    if welch:
        e1, e0 = v1 / n1, v0 / n0
        t, f = (m1 - m0) / F.sqrt(e1 + e0), F.pow(e1 + e0, 2) / (F.pow(e1, 2) / (n1 - 1) + F.pow(e0, 2) / (n0 - 1))
    else:
        f = (n1 + n0 - 2).cast("double")
        t = (m1 - m0) / F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / f * (1 / n1 + 1 / n0))
    rows = s.where((n1 > 1) & (n0 > 1)).select(*keys, t.alias("t"), f.alias("f"))
    return rows.select(*keys, "t", student_p("t", "f").alias("p"))


def mann_whitney(df: DataFrame, keys: list[str], value: Column, flag: Column) -> DataFrame:
    """(keys, u, z) of the rank-sum test; tied ranks are averaged over distinct values."""
    counts = df.groupBy(*keys, value.alias("__v")).agg(F.sum(flag.cast("long")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2
    s = counts.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.col("__r") * F.col("__p")).alias("r"), F.sum("__p").alias("a"), F.sum("__n").alias("t"), F.sum(F.pow("__n", F.lit(3)) - F.col("__n")).alias("ties"))
    a, b = F.col("a"), F.col("t") - F.col("a")
    u = F.col("r") - a * (a + 1) / 2
    var = a * b / 12 * (F.col("t") + 1 - F.col("ties") / (F.col("t") * (F.col("t") - 1)))
    return s.select(*keys, u.alias("u"), F.when(var > 0, (u - a * b / 2) / F.sqrt(var)).alias("z"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the rank of a value in its group, ties averaged."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(out, rank + (ties - 1) / 2)


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, pearson, spearman, slope, intercept)."""
    rows = average_ranks(average_ranks(df, keys, x, "__rx"), keys, y, "__ry")
    return rows.groupBy(*keys).agg(
        F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def density(df: DataFrame, keys: list[str], value: str, points: int = 100, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(keys, x, density): Gaussian kernel density on a grid, bandwidth n^(-1/5) times the sample deviation.

    The grid is constant and small; values are counted before they meet it.
    """
    counts = df.groupBy(*keys, F.round(value, 6).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    size = df.groupBy(*keys).agg(F.stddev_samp(value).alias("__sd"), F.count(F.lit(1)).alias("__t"))
    h = F.col("__sd") * F.pow(F.col("__t").cast("double"), F.lit(-0.2))
    rows = counts.join(size, keys).withColumn("__h", h).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(low) + F.col("i") * F.lit((high - low) / (points - 1))
    k = F.exp(-F.pow((x - F.col("__v")) / F.col("__h"), 2) / 2) / (F.col("__h") * F.sqrt(F.lit(2 * math.pi)))
    return rows.groupBy(*keys, "i").agg((F.sum(k * F.col("__n")) / F.max("__t")).alias("density"))


def empirical_cdf(df: DataFrame, keys: list[str], value: str, origin: bool = False) -> DataFrame:
    """(keys, value, share of rows at or below it) over distinct values, after (0, 0) if ``origin``."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    steps = counts.select(*keys, value, (F.sum("__n").over(w.orderBy(value)) / F.sum("__n").over(w)).alias("cdf"))
    if not origin:
        return steps
    zero = df.select(*keys).distinct().select(*keys, F.lit(0).cast(df.schema[value].dataType).alias(value), F.lit(0.0).alias("cdf"))
    return zero.unionAll(steps)


def kendall(df: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """(unit, tau): Kendall's tau-b of two columns. Equal points are counted first; pairs of different points are compared in
    blocks, weighted by their counts, and only sums leave a task."""
    points = df.select(unit, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).groupBy(unit, "__x", "__y").agg(F.count(F.lit(1)).alias("__w"))
    rows = points.withColumn("clone_id", F.xxhash64("__x", "__y"))

    def work(q: pd.DataFrame, r: pd.DataFrame, mask: np.ndarray) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame(columns=[unit, "s", "nx", "ny"])
        dx, dy = (np.sign(q[c].to_numpy()[:, None] - r[c].to_numpy()[None, :]).astype(np.int64) * mask for c in ("__x", "__y"))
        pairs = lambda m: int(q["__w"].to_numpy() @ m @ r["__w"].to_numpy())
        return pd.DataFrame({unit: [q[unit].iloc[0]], "s": [pairs(dx * dy)], "nx": [pairs(np.abs(dx))], "ny": [pairs(np.abs(dy))]})

    sums = in_own_blocks(rows, unit, work, f"{unit} {df.schema[unit].dataType.simpleString()}, s long, nx long, ny long").groupBy(unit)
    sums = sums.agg(*[F.sum(c).cast("double").alias(c) for c in ("s", "nx", "ny")])
    return sums.select(unit, F.when(F.col("nx") * F.col("ny") > 0, F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def score_matrix(scores: DataFrame, id_col: str, name: str, value: str) -> DataFrame:
    """(name1 <= name2, pearson) of every two named scores over the rows that have both."""
    side = lambda k: scores.select(id_col, F.col(name).alias(f"name{k}"), F.col(value).cast("double").alias(f"__v{k}"))
    return side(1).join(side(2), id_col).where("name1 <= name2").groupBy("name1", "name2").agg(F.corr("__v1", "__v2").alias("pearson"))


def expected_mutual_information(joint: np.ndarray) -> tuple[float, float, float, float]:
    """(mi, expected mi, entropy of rows, entropy of columns) of a contingency table, in nats."""
    n = joint.sum()
    a, b = joint.sum(1), joint.sum(0)
    p = joint[joint > 0] / n
    mi = float((p * np.log(p / (np.outer(a, b)[joint > 0] / n / n))).sum())
    h = lambda c: float(-(c / n * np.log(c / n)).sum())
    lf = np.array([math.lgamma(k + 1) for k in range(int(n) + 1)])
    emi = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
            logp = lf[x] + lf[y] + lf[int(n) - x] + lf[int(n) - y] - lf[int(n)] - lf[k] - lf[x - k] - lf[y - k] - lf[int(n) - x - y + k]
            emi += float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    return mi, emi, h(a), h(b)


def adjusted_mutual_information(labels: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, ami) of two label columns, from their joint counts (one small table for each group)."""

    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        joint = pieces.pivot_table(index="a", columns="b", values="n", fill_value=0, aggfunc="sum").to_numpy().astype(float)
        mi, emi, ha, hb = expected_mutual_information(joint)
        top = max((ha + hb) / 2 - emi, 1e-15)
        return pd.DataFrame({group: [key[0]], "ami": [1.0 if ha == 0 and hb == 0 else (mi - emi) / top]})

    counts = labels.groupBy(group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).applyInPandas(run, f"{group} string, ami double")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
