"""Merkle manifest of a dataset by a nested-struct rollup.

Rows are leaves. The leaves of a tree (a source) are ranked, and the rank is written as digits
to the base of the fan-out. Within a block of ``fan ** levels`` leaves the digit columns are
grouped away one after the other: rows that agree on all higher digits become one array of
structs, ordered by the digit that went, under the hash of its members. So a block ends as one
row that nests structs ``levels`` deep. Blocks are the nodes of the next round, until every tree
has one node; the trees' tops are ranked and rolled up in the same way under one root.

Then proofs come down. A block's row and the row with the way from the block to the root meet in
one grouping by block (a row for ``fan ** levels`` leaves); ``transform`` gives every struct what
stands left and right of it in its run, and ``explode`` sets its members free. No leaf is joined
with anything.

A hash is the lower-case hex SHA-256 of its inputs put together, digests as hex text. A level in
which a tree has more than one node is hashed, a run of one node too; a tree of one leaf has no
levels, its leaf is its top.

Results in special cases: a field is ``-`` where null, so null and the empty text (``0:``) differ;
a null tree name is a tree of its own and comes first; null ids come first in their tree; rows of
one tree and id are ordered by their leaf, equal rows take neighbouring places and have proofs of
their own; an empty table gives no rows; other columns are carried only where ``keep`` names them,
inside a struct, so their names can't clash; long texts are hashed where they are read and
never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_analog.llm.ordinals import deal, place
from spark_analog.operators.staging import stage


@dataclass(frozen=True)
class Settings:
    """``fan``: nodes hashed together; ``levels``: digits grouped away before a block is written."""
    fan: int = 16
    levels: int = 2


#: One step on the way to the root: the digests before and after the node in its run.
STEPS = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Hash of a row: each field as byte count, colon and value, or ``-`` if null."""
    def said(c):
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return digest(F.concat(*[said(c) for c in fields]))


def fold(start: Column, steps: Column) -> Column:
    """Hash at the root that a leaf and the digests beside its way lead to."""
    return F.aggregate(steps, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_text(steps: Column) -> Column:
    """All digests of a proof from the leaf up, left to right."""
    return F.aggregate(steps, F.lit(""), lambda text, s: F.concat(text, s["before"], s["after"]))


def _many(s: Settings, level: int) -> Column:
    """Whether a tree of n nodes still has several after ``level`` levels."""
    return F.col("n") > s.fan ** level


def _rollup(nodes: DataFrame, s: Settings) -> DataFrame:
    """One row per block: tree, n, block, hash, kids (structs nested ``levels`` deep)."""
    digits = [F.expr(f"cast(rank div {s.fan ** k} % {s.fan} as int)").alias(f"d{k}") for k in range(s.levels)]
    now = nodes.select("tree", "n", F.expr(f"rank div {s.fan ** s.levels}").alias("block"), *digits,
                       F.struct("hash", "kids").alias("node")).repartition("tree", "block")
    for k in range(s.levels):
        member = F.struct(F.col(f"d{k}").alias("digit"), F.col("node.hash").alias("hash"), F.col("node.kids").alias("kids"))
        run = (now.groupBy("tree", "n", "block", *[f"d{j}" for j in range(k + 1, s.levels)])
               .agg(F.array_sort(F.collect_list(member)).alias("kids")))
        joined = F.when(_many(s, k), digest(F.array_join("kids.hash", ""))).otherwise(F.col("kids.hash")[0])
        now = run.select(*[c for c in run.columns if c != "kids"], F.struct(joined.alias("hash"), "kids").alias("node"))
    return now.select("tree", "n", "block", "node.hash", "node.kids")


def _rounds(nodes: DataFrame, s: Settings) -> list[DataFrame]:
    """The block tables from the leaves up; the last has one block per tree."""
    done = []
    while True:
        done.append(stage(_rollup(nodes, s)))
        if (done[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return done
        width = s.fan ** s.levels
        nodes = done[-1].select("tree", F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("block").alias("rank"), "hash",
                                F.lit(None).cast("int").alias("kids"))


def _free(blocks: DataFrame, ways: DataFrame, s: Settings) -> DataFrame:
    """tree, rank, inside, top and way of every node of the blocks; ``ways`` has them for the blocks."""
    kids = blocks.schema["kids"].dataType
    told = ways.select("tree", F.col("rank").alias("block"), F.lit(None).cast("long").alias("n"),
                       F.lit(None).cast(kids).alias("kids"), "top", "way")
    rows = (blocks.select("tree", "block", "n", "kids", F.lit(None).cast(ways.schema["top"].dataType).alias("top"),
                          F.lit(None).cast(STEPS).alias("way"))
            .unionByName(told).groupBy("tree", "block")
            .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "top", "way")])
            .withColumn("rank", F.col("block")))
    for k in reversed(range(s.levels)):
        hashes = F.col("kids.hash")
        beside = F.transform("kids", lambda kid, i: F.struct(
            kid["digit"].alias("digit"), kid["kids"].alias("kids"),
            F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"),
            F.array_join(F.slice(hashes, i + 2, F.lit(s.fan)), "").alias("after")))
        rows = rows.select("tree", "n", "rank", "top", "way", F.explode(beside).alias("kid"))
        step = F.array(F.struct(F.col("kid.before").alias("before"), F.col("kid.after").alias("after")))
        rows = rows.select("tree", "n", (F.col("rank") * s.fan + F.col("kid.digit")).alias("rank"), "top",
                           F.when(_many(s, k), F.concat(step, "way")).otherwise(F.col("way")).alias("way"),
                           F.col("kid.kids").alias("kids"))
    return rows.select("tree", "rank", F.col("kids").alias("inside"), "top", "way")


def _descend(rounds: list[DataFrame], ways: DataFrame, s: Settings) -> DataFrame:
    for k in reversed(range(len(rounds))):
        ways = _free(rounds[k], ways, s)
        if k:
            ways = stage(ways.select("tree", "rank", "top", "way"))
    return ways


def manifest(rows: DataFrame, tree: str, order: str, fields: list[str], keep: dict[str, Column] | None = None,
             settings: Settings = Settings()) -> DataFrame:
    """One row per row: tree, rank, leaf, subroot, root, way (steps to the root, leaf first) and
    ``kept``, a struct of the columns of ``keep``.

    ``fields`` are hashed, in this order; trees are named by the column ``tree`` (a text) and
    ordered by its bytes, leaves by ``order``."""
    s = settings
    kept = F.struct(*[c.alias(n) for n, c in (keep or {"leaf": F.lit(None).cast("string")}).items()])
    hashed = rows.select(F.col(f"`{tree}`").cast("string").alias("tree"), F.col(f"`{order}`").alias("sort"),
                         leaf([F.col(f"`{c}`") for c in fields]).alias("hash"), kept.alias("kept"))
    ranked = place(*deal(hashed, "tree", ["sort", "hash"]), "tree")
    leaves = ranked.select("tree", "n", "rank", "hash", F.struct(F.col("hash").alias("leaf"), "kept").alias("kids"))
    low = _rounds(leaves, s)
    # the trees' tops are the leaves of one more tree
    tops = low[-1].select(F.lit(0).alias("all"), "tree", "hash")
    ranked = place(*deal(tops, "all", ["tree"]), "all")
    high = _rounds(ranked.select(F.col("all").alias("tree"), "n", "rank", "hash",
                                 F.struct("tree", F.col("hash").alias("subroot")).alias("kids")), s)
    start = high[-1].select("tree", F.lit(0).cast("long").alias("rank"), F.col("hash").alias("top"),
                            F.array().cast(STEPS).alias("way"))
    ways = _descend(high, start, s)
    ways = stage(ways.select("inside.tree", F.lit(0).cast("long").alias("rank"),
                             F.struct("inside.subroot", F.col("top").alias("root")).alias("top"), "way"))
    return _descend(low, ways, s).select("tree", "rank", "inside.leaf", "top.subroot", "top.root", "way", "inside.kept")
