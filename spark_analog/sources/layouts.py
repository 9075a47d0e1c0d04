"""Common dataset layouts as ``(train, test, labels)`` long tables.

``train`` and ``test``: ``entity, t, channel, value``; ``labels``: ``entity, t,
label`` of the test part.  ``scale.join_halves`` makes one series of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_analog.operators import clean
from spark_analog.sources import files

Parts = tuple[DataFrame, DataFrame, DataFrame]
STEP = "__t"


def _quoted(df: DataFrame, names) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names], STEP)


def _long(df: DataFrame, entity: str) -> DataFrame:
    channels = [c for c in df.columns if c != STEP]
    return clean.to_long(df, [STEP], channels).select(
        F.lit(entity).alias("entity"), F.col(STEP).alias("t"), "channel", "value")


def _aligned(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test columns named like the training ones; the step column comes along."""
    have, want = [[c for c in d.columns if c != STEP] for d in (test, train)]
    return test.select(*[F.col(f"`{a}`").alias(b) for a, b in clean.column_pairs(have, want)], STEP)


def csv_with_label_file(spark: SparkSession, train: str, test: str, labels: str, entity: str
                        ) -> Parts:
    """Time in the first column; labels in their own file, row by row with the test file."""
    tr, te, lb = [files.read_wide_csv(spark, p, row_number=STEP) for p in (train, test, labels)]

    def sensors(df):
        rest = [c for c in df.columns[1:] if c != STEP]
        return _quoted(df, [c for c in rest if c not in clean.time_columns(rest)])

    a, b = sensors(tr), sensors(te)
    names = [c for c in lb.columns if c != STEP]
    gone = set(clean.time_columns(names)) | ({names[0]} if len(names) > 1 else set())
    marks = lb
    kept = [c for c in names if c not in gone]
    for i, c in enumerate(kept):
        rule = clean.label_rule(lb.select(F.col(f"`{c}`").alias("v")), "v")
        marks = marks.withColumn(f"__l{i}", F.coalesce(
            clean.label_value(F.col(f"`{c}`"), rule),
            F.raise_error(F.lit("unknown label")).cast("int")))
    marks = marks.select(F.lit(entity).alias("entity"), F.col(STEP).alias("t"),
                         clean.any_label([f"__l{i}" for i in range(len(kept))]).alias("label"))
    return _long(a, entity), _long(_aligned(a, b), entity), marks


def csv_with_label_column(spark: SparkSession, train: str, test: str, entity: str) -> Parts:
    """The label is a column of the test file; a separate label file is never trusted."""
    tr, te = [files.read_wide_csv(spark, p, row_number=STEP) for p in (train, test)]
    label = clean.label_column([c for c in te.columns if c != STEP])
    if label is None:
        raise ValueError("the test file has no label column")

    def sensors(df):
        names = [c for c in df.columns if c != STEP]
        gone = set(clean.time_columns(names)) | {clean.label_column(names)}
        return _quoted(df, [c for c in names if c not in gone])

    a, b = sensors(tr), sensors(te)
    marked = te.select(F.col(f"`{label}`").alias("raw"), F.col(STEP).alias("t"))
    marks = clean.normalise_labels(marked, "raw").select(
        F.lit(entity).alias("entity"), "t", "label")
    return _long(a, entity), _long(_aligned(a, b), entity), marks


def text_per_entity(spark: SparkSession, train: str, test: str, labels: str, pattern: str
                    ) -> Parts:
    """Headerless text, one file per entity and role; any non-zero label column is an anomaly."""
    tr, te, lb = [files.read_headerless(spark, p, None, pattern) for p in (train, test, labels)]
    marks = lb.groupBy("entity", "t").agg(
        F.max((F.coalesce("value", F.lit(0.0)) != 0).cast("int")).alias("label"))
    return tr, te, marks


def arrays_with_intervals(spark: SparkSession, train: str, test: str, manifest: str, family: str
                          ) -> Parts:
    """NPY files per entity and a CSV of inclusive anomaly intervals for one family.

    Exactly one manifest row per entity and intervals inside the test series are
    required; violations raise when the labels are read.
    """
    pattern = "/([^/]+)[.]npy$"
    tr, te = [files.read_npy(spark, p, pattern) for p in (train, test)]
    rows = spark.read.option("header", True).option("quote", '"').csv(manifest)
    spans = rows.where(F.upper("spacecraft") == family).select(
        F.col("chan_id").alias("entity"), "anomaly_sequences")
    points = te.select("entity", "t").distinct()
    n = points.groupBy("entity").agg((F.max("t") + 1).alias("n"))
    known = spans.join(n.select("entity"), "entity", "left_semi")
    missing = n.join(spans, "entity", "left_anti").select(
        "entity", F.lit("records").alias("violation"))
    bad = files.manifest_checks(known, n).unionByName(missing)
    if not bad.isEmpty():
        raise ValueError(f"invalid anomaly manifest: {[tuple(r) for r in bad.limit(5).collect()]}")
    name = F.concat(F.lit(f"{family}@"), "entity")
    tag = lambda df: df.withColumn("entity", name)
    return tag(tr), tag(te), tag(files.interval_labels(points, known))
