"""Files to long tables, and staged results back to files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.functions.columns import finite
from spark_analog.operators.clean import number
from spark_analog.operators.intervals import open_intervals
from spark_analog.operators.ordered import running_sums

ENCODINGS = ("utf-8", "ISO-8859-1")
BOM = "\ufeff"


def read_wide_csv(spark: SparkSession, path: str, encoding: str | None = None,
                  row_number: str | None = None) -> DataFrame:
    """Header CSV with unknown encoding and ``,`` or ``;`` as separator; all columns text.

    The separator comes from a header line alone.  Unless the caller names the
    encoding, one pass looks for bytes that are not UTF-8.  ``row_number`` names
    an extra column with the position in the file.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).first()
    line = (head[0] if head else "").lstrip(BOM)
    if encoding is None:
        encoding = ENCODINGS[lines.where(~F.is_valid_utf8("value")).limit(1).count()]
    sep = ";" if ";" in line and "," not in line else ","
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
          .option("mode", "PERMISSIVE").csv(path))
    names = [c.lstrip(BOM) for c in df.columns]
    if row_number is None:
        return df.toDF(*names)
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)],
                      "_metadata")
    return row_number_in_file(plain, row_number).drop("__f").toDF(*names, row_number)


def row_number_in_file(df: DataFrame, out: str = "t") -> DataFrame:
    """Row order of line files as time, for files of any size.

    ``df`` still carries ``_metadata``.  Splits of a file are ranked by their
    start offset, so one file is numbered by many tasks.
    """
    cols = [c for c in df.columns if c != "_metadata"]
    tagged = df.select(*cols, F.col("_metadata.file_path").alias("__f"),
                       F.col("_metadata.file_block_start").alias("__p"),
                       F.monotonically_increasing_id().alias("__i"),
                       F.lit(1).cast("bigint").alias("__one"))
    ranked = running_sums(tagged, ["__f"], ["__p"], ["__i"], {out: "__one"}, inclusive=False)
    return ranked.select("__f", *cols, out)


def read_headerless(spark: SparkSession, path: str, channels: int | None, entity_pattern: str
                    ) -> DataFrame:
    """Comma-separated numbers without a header, one series per file, long form.

    The entity is group 1 of ``entity_pattern`` in the file's path; the row
    number is time.  Every file has its own width; a line that is wider or
    narrower than the first of its file (or than ``channels``, if given) raises
    when it is read.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = row_number_in_file(lines.select("value", "_metadata"))
    cells = rows.select("__f", "t", F.split("value", ",").alias("cells"))
    if channels is None:
        widths = cells.where("t = 0").select("__f", F.size("cells").alias("wide"))
        cells = cells.join(widths, "__f")
    else:
        cells = cells.withColumn("wide", F.lit(channels))
    checked = F.when(F.size("cells") == F.col("wide"), F.col("cells")).otherwise(F.raise_error(
        F.concat(F.lit("line "), F.col("t"), F.lit(" of "), "__f", F.lit(" has "), F.size("cells"),
                 F.lit(" values, not "), "wide")).cast("array<string>"))
    long = cells.select(F.regexp_extract("__f", entity_pattern, 1).alias("entity"), "t",
                        F.posexplode(checked).alias("c", "text"))
    return long.select("entity", "t", F.concat(F.lit("channel_"), "c").alias("channel"),
                       number("text").alias("value"))


def time_major(array: np.ndarray, time_axis: int = 0) -> np.ndarray:
    """Steps in rows, channels in columns; one channel if the array has one dimension.

    Which axis is time is for the caller to say; it can't be told from sizes."""
    if array.ndim not in (1, 2):
        raise ValueError(f"array must be 1-D or 2-D, got {array.ndim}-D")
    return np.moveaxis(array.reshape(len(array), -1), time_axis, 0) if array.ndim == 2 else array[:, None]


def decode_npy(files: DataFrame, entity_pattern: str, rows: int = 4096, time_axis: int = 0
               ) -> DataFrame:
    """``(path, content)`` of NPY files to ``entity, t, channel, value``, in bounded batches."""
    named = files.select(F.regexp_extract("path", entity_pattern, 1).alias("entity"), "content")

    def unpack(batches):
        for pdf in batches:
            for entity, content in zip(pdf["entity"], pdf["content"]):
                a = time_major(np.load(io.BytesIO(content), allow_pickle=False), time_axis).astype(float)
                names = np.array([f"channel_{c}" for c in range(a.shape[1])])
                for s in range(0, len(a), rows):
                    part = a[s:s + rows]
                    yield pd.DataFrame({
                        "entity": entity,
                        "t": np.repeat(np.arange(s, s + len(part)), a.shape[1]),
                        "channel": np.tile(names, len(part)), "value": part.reshape(-1)})

    long = named.mapInPandas(unpack, "entity string, t bigint, channel string, value double")
    return long.withColumn("value", finite("value"))


def read_npy(spark: SparkSession, path: str, entity_pattern: str, time_axis: int = 0) -> DataFrame:
    """One task per file, which holds the file whole."""
    return decode_npy(spark.read.format("binaryFile").load(path).select("path", "content"),
                      entity_pattern, time_axis=time_axis)


def discover(spark: SparkSession, path: str, pattern: str,
             roles=("train", "test", "test_label")) -> DataFrame:
    """Entities named by files below ``path`` and whether each has every role.

    ``pattern`` has groups (role, entity).  Contents are never read.
    """
    paths = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path"))
    found = paths.select(F.regexp_extract("path", pattern, 1).alias("role"),
                         F.regexp_extract("path", pattern, 2).alias("entity")).where(
        F.col("role").isin(*roles)).distinct()
    return found.groupBy("entity").agg(
        F.count("*").alias("roles"), (F.count("*") == len(roles)).alias("complete"))


def interval_labels(points: DataFrame, manifest: DataFrame, key: str = "entity") -> DataFrame:
    """Inclusive ``[[start, end], ...]`` texts per entity to a label per point.

    A sweep over borders and points counts the intervals that are open at a point.
    """
    spans = manifest.select(key, F.explode(F.from_json(
        "anomaly_sequences", "array<array<bigint>>")).alias("__s")).select(
        key, F.col("__s")[0].alias("start"), F.col("__s")[1].alias("stop"))
    return open_intervals(points, spans, [key], out="__open").select(
        *points.columns, (F.col("__open") > 0).cast("int").alias("label"))


def manifest_checks(manifest: DataFrame, lengths: DataFrame) -> DataFrame:
    """Entities with other than one record, or an interval outside ``[0, n)``."""
    many = manifest.groupBy("entity").agg(F.count("*").alias("c")).where("c <> 1").select(
        "entity", F.lit("records").alias("violation"))
    spans = manifest.select("entity", F.explode(F.from_json(
        "anomaly_sequences", "array<array<bigint>>")).alias("s")).join(lengths, "entity")
    outside = spans.where((F.col("s")[0] < 0) | (F.col("s")[0] > F.col("s")[1])
                          | (F.col("s")[1] >= F.col("n"))).select(
        "entity", F.lit("interval").alias("violation")).distinct()
    return many.unionByName(outside)


# --- ledgers ---------------------------------------------------------------------------------
def read_ledger(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of a JSON-lines ledger; bad lines never stop the read."""
    full = f"{schema}, _bad string"
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    names = [c for c in parsed.columns if c != "_bad"]
    return (parsed.where("_bad is null").select(*names),
            parsed.where("_bad is not null").select(F.col("_bad").alias("line")))


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def _json_value(c, kind):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(kind, T.StructType):
        parts = F.struct(*[_json_value(c[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(c.isNotNull(), parts)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _json_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _json_value(x, kind.valueType))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL at any depth, as JSON has neither."""
    return df.select(*[_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append through Spark's commit protocol: readers see whole writes only."""
    writer = json_safe(df).write.mode("append")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
