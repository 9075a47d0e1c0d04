"""A bounded sample of labelled texts for fitting a classifier on the driver.

Bounded are its ids (``per_class``), its rows (one per id) and its bytes (``most_bytes``). All tasks
together hand on little more than the sample, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_analog.llm.common import fold


def training_ids(labels: DataFrame, label: str, per_class: dict[int, int], folds: int = 5,
                 doc_id: str = "doc_id") -> DataFrame:
    """At most ``per_class[y]`` ids of every label ``y`` in 0 and 1, from the folds that are
    not 0: those with the smallest hashes of the id. Rows without id or label are left
    out; an id labelled twice takes the larger label.

    Ids are counted first, so that a task passes on only hashes below a limit under which
    the sample lies, give or take the count's spread."""
    one = (labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
           .filter(F.col("id").isNotNull() & F.col("y").isin(*per_class))
           .filter(fold("id", folds) != 0)
           .groupBy("id").agg(F.max("y").alias("y")))
    count = dict(map(tuple, one.groupBy("y").count().collect()))
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    parts = [one.filter(F.col("y") == y).filter(digest < _hash_limit(most, count.get(y, 0)))
             .orderBy(digest, "id").limit(most) for y, most in sorted(per_class.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hash_limit(wanted: int, of: int) -> str:
    """First digits of the hex hashes below which ``wanted`` of ``of`` lie, with a margin of ten
    standard deviations; past all hashes if that is all of them."""
    share = (wanted + 10 * wanted ** 0.5 + 100) / max(1, of)
    return "g" if share >= 1 else f"{int(share * 2 ** 48):012x}"


def training_texts(docs: DataFrame, ids: DataFrame, row_bytes: int, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(id, y, text) of the sampled ids, one row each: of several texts of an id the one with the
    smallest hash. A text of more than ``row_bytes`` is left out of the sample as a whole, never
    cut. The ids are few (the sample's documented bound), so they go to every task and only
    their texts are shuffled."""
    picked = (docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
              .filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= row_bytes))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return (picked.join(F.broadcast(ids), "id").groupBy("id", "y").agg(first.alias("row"))
            .select("id", "y", F.col("row.text").alias("text")))


def label_share(labels: DataFrame, label: str, folds: int = 5, doc_id: str = "doc_id") -> float:
    """Share of label 1 among the rows that training may see: with an id, not in fold 0."""
    row = (labels.filter(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isin(0, 1))
           .filter(fold(F.col(f"`{doc_id}`"), folds) != 0)
           .agg(F.avg(F.col(f"`{label}`").cast("double"))).first())
    return 0.5 if row[0] is None else float(row[0])
