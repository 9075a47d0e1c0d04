"""Aggregations over experiment results and rank statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.defaults import GRID_MEMORY, GRID_PAYLOAD_BYTES, GRID_TOP_K, NEMENYI_Q05
from spark_analog.operators.ordered import quantiles
from spark_analog.operators.staging import stage


# --- rows --------------------------------------------------------------------------------
def latest(rows: DataFrame, keys, order) -> DataFrame:
    """The last row per key in ``order`` (struct maximum: no sort, map-side combined)."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*[F.col(o) for o in order], F.struct(*rest).alias("__row"))).alias("__m")
    return rows.groupBy(*keys).agg(top).select(
        *keys, *[F.col(f"__m.__row.{c}").alias(c) for c in rest])


def duplicates(rows: DataFrame, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def flatten(rows: DataFrame, paths: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(p).alias(n) for n, p in paths.items()])


# --- means over entities, families, seeds ----------------------------------------------------
def family_seed(rows: DataFrame, metrics=("auprc",), keys=("family", "method", "seed")
                ) -> DataFrame:
    return rows.where("status = 'ok'").groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in metrics], F.countDistinct("dataset").alias("members"))


def family_complete(per_family: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected``: ``family, expected``."""
    return per_family.join(expected, "family").withColumn(
        "complete", F.col("members") == F.col("expected"))


def macro_rows(per_family: DataFrame, families: int, metrics=("auprc",),
               keys=("method", "seed")) -> DataFrame:
    """Equal-family mean, only where every family is complete."""
    return per_family.where("complete").groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in metrics],
        F.countDistinct("family").alias("__f")).where(F.col("__f") == families).select(
        F.lit("MACRO").alias("family"), *keys, *metrics)


def mean_std(rows: DataFrame, keys=("family", "method"), metric: str = "auprc") -> DataFrame:
    """Mean, sample deviation (0 for one seed), count and the seeds as text."""
    return rows.groupBy(*keys).agg(
        F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
        F.count(metric).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_set("seed")),
                                 lambda s: s.cast("string")), ";").alias("seeds"))


def component_effect(summary: DataFrame, full: str, keys=("family",), level: str = "method"
                     ) -> DataFrame:
    base = summary.where(F.col(level) == full).select(*keys, F.col("mean").alias("full_mean"),
                                                      F.col("n").alias("full_n"))
    rest = summary.where(F.col(level) != full)
    relative = F.when(F.col("mean") != 0, 100.0 * (F.col("full_mean") / F.nullif(
        "mean", F.lit(0.0)) - 1.0))
    return rest.join(base, list(keys)).select(
        *keys, F.col(level).alias("removed"), F.least("n", "full_n").alias("seed_count"),
        "full_mean", F.col("mean").alias("ablated_mean"),
        (F.col("full_mean") - F.col("mean")).alias("gain"), relative.alias("relative_percent"))


def design_balance(rows: DataFrame, axes=("method", "seed")) -> DataFrame:
    """Cells of the family x entity x method x seed design that are missing.

    Methods and seeds are taken from the whole ledger, entities from their family.
    """
    ok = rows.where("status = 'ok'")
    expected = ok.select("family", "dataset").distinct()
    for a in axes:
        expected = expected.withColumn(a, F.explode(ok.agg(F.collect_set(a)).scalar()))
    cell = ["family", "dataset", *axes]
    return expected.join(ok.select(*cell).distinct(), cell, "left_anti")


# --- ranks ----------------------------------------------------------------------------------
def complete_table(per_family: DataFrame, metric: str = "auprc") -> DataFrame:
    """``family, method, value`` for families that have every method."""
    cells = per_family.groupBy("family", "method").agg(F.avg(metric).alias("value"))
    methods = cells.agg(F.countDistinct("method")).scalar()
    full = cells.groupBy("family").agg(F.count("*").alias("__n")).where(F.col("__n") == methods)
    return cells.join(full.select("family"), "family", "left_semi")


def pivot_methods(cells: DataFrame, methods) -> DataFrame:
    return cells.groupBy("family").pivot("method", list(methods)).agg(F.first("value"))


def block_ranks(cells: DataFrame, digits: int = 9) -> DataFrame:
    """Rank 1 = largest value inside a family, ties share the average rank."""
    v = F.round("value", digits)
    by = Window.partitionBy("family").orderBy(F.desc("__v"))
    tie = Window.partitionBy("family", "__v")
    return cells.withColumn("__v", v).withColumn(
        "rank", F.rank().over(by) + (F.count("*").over(tie) - 1) / 2.0).drop("__v")


def average_rank(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("method").agg(F.avg("rank").alias("avg_rank"),
                                       F.count("*").alias("n"))


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution, closed form for integer ``dof``."""
    if x <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        return math.exp(-h) * math.fsum(h ** i / math.factorial(i) for i in range(dof // 2))
    tail = math.erfc(math.sqrt(h))
    return tail + math.exp(-h) * math.fsum(
        h ** (i + 0.5) / math.gamma(i + 1.5) for i in range((dof - 1) // 2))


def friedman(ranks: DataFrame) -> DataFrame:
    """Friedman statistic with tie correction; 0 and p = 1 when every block is constant."""
    blocks = ranks.groupBy("family").agg(F.count("*").alias("k"))
    shape = blocks.agg(F.count("*").alias("n"), F.max("k").alias("k"))
    ties = ranks.groupBy("family", "rank").agg(F.count("*").alias("c")).agg(
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    spread = ranks.groupBy("method").agg(F.sum("rank").alias("s")).agg(
        F.sum(F.col("s") * F.col("s")).alias("ss"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    one = shape.select(
        "n", "k", F.lit(ties.scalar()).alias("ties"), F.lit(spread.scalar()).alias("ss"))
    c = F.lit(1.0) - F.col("ties") / (k * (k * k - 1) * n)
    raw = (F.lit(12.0) / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1))
    stat = one.select("n", "k", F.when(c > 0, raw / c).otherwise(F.lit(0.0)).alias("statistic"))
    tail = F.pandas_udf(lambda s, d: pd.Series([chi2_sf(a, int(b)) for a, b in zip(s, d)]),
                        "double")
    return stat.withColumn("p", tail(F.col("statistic"), F.col("k") - 1))


def signed_rank_p(n: int, w: float, ranks: list[float]) -> float:
    """Two-sided Wilcoxon p: exact over all signs up to 50 pairs, else normal with ties."""
    if n == 0:
        return 1.0
    if n <= 50:
        doubled = [int(round(2 * r)) for r in ranks]
        ways = [1] + [0] * sum(doubled)
        for r in doubled:
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        below = sum(ways[:int(round(2 * w)) + 1])
        return min(1.0, 2.0 * below / 2 ** n)
    groups = pd.Series(ranks).value_counts().to_numpy(dtype=float)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ((groups ** 3 - groups).sum()) / 48.0
    z = (w - n * (n + 1) / 4.0) / math.sqrt(var)
    return math.erfc(abs(z) / math.sqrt(2.0))


def wilcoxon(cells: DataFrame, digits: int = 9) -> DataFrame:
    """Paired signed-rank test for every method pair over families; zeros are dropped."""
    a = cells.select("family", F.col("method").alias("left"), F.col("value").alias("a"))
    b = cells.select("family", F.col("method").alias("right"), F.col("value").alias("b"))
    pairs = a.join(b, "family").where("left < right").select(
        "left", "right", F.round(F.col("a") - F.col("b"), digits).alias("d"))
    named = pairs.select("left", "right").distinct()
    size = F.abs("d")
    by = Window.partitionBy("left", "right").orderBy("__s")
    tie = Window.partitionBy("left", "right", "__s")
    ranked = pairs.where("d <> 0").withColumn("__s", size).withColumn(
        "__r", F.rank().over(by) + (F.count("*").over(tie) - 1) / 2.0)
    sums = ranked.groupBy("left", "right").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("__r")).otherwise(0.0)).alias(
            "__plus"), F.sum(F.when(F.col("d") < 0, F.col("__r")).otherwise(0.0)).alias("__minus"),
        F.collect_list("__r").alias("__ranks"))
    full = named.join(sums, ["left", "right"], "left").select(
        "left", "right", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.least("__plus", "__minus"), F.lit(0.0)).alias("w"), "__ranks")
    p = F.pandas_udf(lambda n, w, r: pd.Series([
        signed_rank_p(int(i), j, [] if k is None else list(k)) for i, j, k in zip(n, w, r)]),
        "double")
    return full.withColumn("p", p("n", "w", "__ranks")).drop("__ranks")


def holm(tests: DataFrame, p: str = "p", keys=(), tie=("left", "right")) -> DataFrame:
    """Step-down adjustment over one family of tests, monotone and capped at 1."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = part.orderBy(p, *tie)
    m = F.count("*").over(part)
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    stepped = tests.withColumn("__raw", raw)
    return stepped.withColumn("p_holm", F.max("__raw").over(order.rowsBetween(
        Window.unboundedPreceding, Window.currentRow))).drop("__raw")


def range_quantile(k: int, level: float = 0.95) -> float:
    """Upper quantile of the range of ``k`` standard normals, divided by sqrt(2).

    The published table up to its end, beyond it by bisection on the range's
    distribution ``k * integral of pdf(z) (cdf(z) - cdf(z - q)) ^ (k - 1)``."""
    if level == 0.95 and k in NEMENYI_Q05:
        return NEMENYI_Q05[k]
    z = np.linspace(-9.0, 9.0, 4001)
    step = z[1] - z[0]
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)))
    pdf, here = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), cdf(z)
    low, high = 0.0, 20.0
    while high - low > 1e-9:
        q = (low + high) / 2
        below = k * float((pdf * (here - cdf(z - q)) ** (k - 1)).sum()) * step
        low, high = (q, high) if below < level else (low, q)
    return low / math.sqrt(2.0)


def critical_difference(k: int, n: Column) -> Column:
    """For the number of methods of the table at hand."""
    return F.lit(range_quantile(k) if k > 1 else None).cast("double") * F.sqrt(
        F.lit(k * (k + 1) / 6.0) / n)


def nemenyi(avg_ranks: DataFrame) -> DataFrame:
    """Rank gap of every pair against the critical difference at 0.05."""
    ranks = stage(avg_ranks.select("method", "avg_rank", "n"))
    others = ranks.agg(F.collect_list(F.struct("method", "avg_rank"))).scalar()
    cd = critical_difference(ranks.count(), F.col("n"))
    pairs = ranks.withColumn("others", others).withColumn("o", F.explode("others")).where(
        F.col("method") < F.col("o.method"))
    gap = F.abs(F.col("avg_rank") - F.col("o.avg_rank"))
    return pairs.select(F.col("method").alias("left"), F.col("o.method").alias("right"),
                        gap.alias("rank_difference"), cd.alias("critical_difference"),
                        (gap > cd).alias("exceeds"))


def cd_groups(avg_ranks: DataFrame) -> DataFrame:
    """Maximal runs of methods whose ranks lie within the critical difference.

    Over methods in rank order the right end of a run never moves back, so a run
    is maximal when it is the first with its right end.
    """
    ranks = stage(avg_ranks.select("method", "avg_rank", "n"))
    every = ranks.agg(F.array_sort(F.collect_list(F.struct("avg_rank", "method", "n")))).scalar()
    row = ranks.select(every.alias("m")).limit(1).withColumn(
        "cd", critical_difference(ranks.count(), F.element_at("m", 1)["n"]))
    ends = F.posexplode(F.transform("m", lambda a: F.size(F.filter(
        "m", lambda b: b["avg_rank"] - a["avg_rank"] <= F.col("cd"))))).alias("p", "last")
    runs = row.select(ends).select((F.col("p") + 1).alias("first"), "last")
    return runs.where("last > first").groupBy("last").agg(F.min("first").alias("first")).select(
        "first", "last")


# --- plans and status ------------------------------------------------------------------------
def variant_plan(levels: DataFrame, entities: DataFrame, backbones) -> DataFrame:
    """Jobs = levels x entities x backbones; identical settings merge, memberships stay.

    ``levels``: ``analysis, settings STRUCT``; ``entities``: ``dataset, family``.
    """
    members = levels.agg(F.collect_list(F.struct("analysis", "settings"))).scalar()
    every = entities.withColumn("__l", F.explode(members)).withColumn(
        "backbone", F.explode(F.array(*[F.lit(b) for b in backbones])))
    job = F.sha2(F.to_json(F.struct("dataset", "backbone", F.col("__l.settings").alias("s"))), 256)
    return every.withColumn("execution_id", job).groupBy(
        "execution_id", "family", "dataset", "backbone").agg(
        F.array_sort(F.collect_set("__l.analysis")).alias("analyses"),
        F.first("__l.settings").alias("settings"))


def pending(planned: DataFrame, done: DataFrame, keys, retry_errors: bool = True) -> DataFrame:
    finished = done.where("status = 'ok'") if retry_errors else done
    return planned.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def job_status(planned: DataFrame, done: DataFrame, keys) -> DataFrame:
    """``planned`` has ``expected`` rows per key."""
    seen = done.groupBy(*keys).agg(
        F.count("*").alias("recorded"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("error"))
    j = planned.join(seen, list(keys), "left").na.fill(0, ["recorded", "ok", "error"])
    return j.withColumn("complete", (F.col("recorded") == F.col("expected"))
                        & (F.col("error") == 0))


def grid_integrity(rows: DataFrame) -> DataFrame:
    """Violations per benchmark id in a K x M measurement grid.

    Missing, foreign or repeated cells, K above M, a payload that depends on K
    or differs from the known size.
    """
    cell = ["benchmark_id", "k", "m"]
    have = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    want = rows.select("benchmark_id").distinct()
    for name, values in (("k", GRID_TOP_K), ("m", GRID_MEMORY)):
        want = want.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    say = lambda df, text: df.select(*cell, F.lit(text).alias("violation"))
    per_m = rows.groupBy("benchmark_id", "m").agg(
        F.countDistinct("payload").alias("__d"), F.min("payload").alias("__p"))
    known = F.create_map(*[F.lit(x) for p in GRID_PAYLOAD_BYTES.items() for x in p])[F.col("m")]
    no_k = per_m.withColumn("k", F.lit(None).cast("int"))
    out = say(want.join(have, cell, "left_anti"), "missing")
    for df, text in ((have.join(want, cell, "left_anti"), "foreign"),
                     (have.where("n > 1"), "repeated"), (have.where("k > m"), "k_above_m"),
                     (no_k.where("__d > 1"), "payload_varies"),
                     (no_k.where((F.col("__d") == 1) & (known != F.col("__p"))), "payload_size")):
        out = out.unionByName(say(df, text))
    return out


def time_rollup(rows: DataFrame, keys=("method",)) -> DataFrame:
    """Total seconds = base + adaptation: mean of family means, median over entities."""
    total = rows.withColumn("total", F.col("base_seconds") + F.col("adapt_seconds"))
    per_family = total.groupBy(*keys, "family").agg(F.avg("total").alias("m"))
    means = per_family.groupBy(*keys).agg(F.avg("m").alias("family_mean"),
                                          F.count("*").alias("families"))
    medians = quantiles(total, keys, "total", [0.5], ["median"])
    return means.join(medians, list(keys)).join(
        total.groupBy(*keys).agg(F.count("*").alias("entities")), list(keys))


def latency_summary(samples: DataFrame, keys, value: str = "ms", batch: int = 1) -> DataFrame:
    """Median, 95th percentile and windows per second at the median."""
    q = quantiles(samples, keys, value, [0.5, 0.95], ["median_ms", "p95_ms"])
    return q.withColumn("windows_per_second", F.lit(1000.0 * batch) / F.col("median_ms"))
