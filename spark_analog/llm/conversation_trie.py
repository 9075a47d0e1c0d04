"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns; its members are the conversations that start with
it. No text is shuffled: a turn is the digest of its role and text, and a number of words.

1. Turns are numbered in ranges of the global order (no conversation is sorted in one task).
2. Each conversation is cut into blocks of ``turns`` turns, the last one shorter. A prefix is known
   by the exclusive or, in two independent lanes of 64 bits, of the hashes of its (place, digest)
   pairs. That runs along pieces of a conversation and is carried over their borders, so a
   conversation may be of any length.
3. Conversations are grouped block by block: those with the same prefix before a block and the
   same block are one edge. Where all that go on from a prefix share one block, each turn in it
   is a node with the same members. Only blocks in which siblings diverge are refined, turn by
   turn, from one row per edge, not per conversation.
4. Sums over subtrees need no walk. The nodes whose smallest member is c are the last ones on the
   way of c, up to its end. So every node is owned by one conversation, and a sum over the nodes
   of a subtree is one over its members of what they own. With A(c) the words of c before the
   nodes that it owns, the tokens saved below a node of depth d with owner o are the sum of
   A(c) - words of the first d - 1 turns over members c other than o; its leaves are the members
   that own a leaf. Both are added up along the edges like the members themselves.

Results in special cases: a null role or text counts as empty; turns are ordered by their number,
nulls first, and turns of one number by the digest of role and text, so repeated rows are turns
next to each other; rows without a conversation id belong to none and make no node; a conversation
without turns ends at the root; an empty table has no root and gives no rows; other columns are
ignored, whatever their names; a long text is digested where it is read. A prefix is known by its 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.llm.common import WORD
from spark_analog.llm.ordinals import deal, place
from spark_analog.operators.staging import stage


@dataclass(frozen=True)
class Settings:
    """``turns``: turns in a block; ``piece``: blocks of a conversation whose running sums one task
    takes; ``ids``: width of the ranges of conversation ids that are joined into one text."""
    turns: int = 8
    piece: int = 512
    ids: int = 65_536


PREFIX = ["k", "p1", "p2"]
EDGE = [*PREFIX, "b1", "b2", "len"]
NODE = ["depth", "q1", "q2"]


def number_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What ``ordinals.deal`` gives for (conv, turn, digest, words), by conversation."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"))
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                                digest.alias("digest"), F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"))
    return deal(rows.filter("conv is not null"), "conv", ["turn", "digest"])


def as_they_are(dealt: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, words) of every turn, and every conversation."""
    rows = place(dealt, starts, "conv").select("conv", F.col("rank").alias("pos"), "digest", "words")
    return rows, starts.select("conv").distinct()


def with_openings(dealt: DataFrame, starts: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, but conversation c opens with the first h turns of c - c % ``family`` (all
    if fewer, none if absent) and goes on after its own first h; h = crc32(c as text) % (most + 1)."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    leads = starts.filter((F.col("conv") % family == 0) & (F.col("skip") < most))
    first = (place(dealt.filter(F.col("conv") % family == 0), leads, "conv").filter(F.col("rank") < most)
             .groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "words"))).alias("first")))
    members = stage(starts.groupBy("conv").agg(F.max("n").alias("n")).withColumn("h", h)
                    .withColumn("base", F.col("conv") - F.col("conv") % family).join(first, "base", "left")
                    .select("conv", "h", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.expr("slice(array(named_struct('rank', 0L, 'digest', '', 'words', 0L)), 1, 0)")).alias("lead")))
    told = starts.join(members.select("conv", "h", F.size("lead").cast("long").alias("lead")), "conv")
    own = (place(dealt, told, "conv").filter(F.col("rank") >= F.col("h"))
           .select("conv", (F.col("rank") - F.col("h") + F.col("lead")).alias("pos"), "digest", "words"))
    led = members.select("conv", F.posexplode("lead").alias("pos", "t")) \
        .select("conv", F.col("pos").cast("long"), "t.digest", "t.words")
    return own.unionByName(led), members.select("conv")


def _blocks(turns: DataFrame, s: Settings) -> DataFrame:
    """conv, block k, prefix lanes p1, p2 and words ``wb`` before it, block lanes b1, b2, its words
    ``bw``, len and turns."""
    lanes = [F.xxhash64(F.lit(k), "pos", "digest").alias(f"x{k}") for k in (1, 2)]
    dealt = turns.select("conv", "pos", "words", *lanes, F.expr(f"pos div {s.turns}").alias("k"),
                         F.expr(f"pos div {s.turns * s.piece}").alias("piece")).repartition("conv", "piece")
    made = dealt.groupBy("conv", "piece", "k").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "words"))).alias("turns"), F.bit_xor("x1").alias("b1"),
        F.bit_xor("x2").alias("b2"), F.sum("words").alias("bw"), F.count("*").alias("len"))
    total = {"p1": F.bit_xor("b1"), "p2": F.bit_xor("b2"), "wb": F.sum("bw")}
    inside = Window.partitionBy("conv", "piece").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    run = stage(made.select("*", *[F.coalesce(v.over(inside), F.lit(0)).alias(c) for c, v in total.items()]))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = run.groupBy("conv", "piece").agg(F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.sum("bw").alias("bw"))
    carried = stage(pieces.select("conv", "piece", *[v.over(earlier).alias(f"{c}_") for c, v in total.items()]).filter("piece > 0"))
    zero = lambda c: F.coalesce(F.col(f"{c}_"), F.lit(0))
    return stage(run.join(carried, ["conv", "piece"], "left")
                 .select("conv", "k", F.col("p1").bitwiseXOR(zero("p1")).alias("p1"), F.col("p2").bitwiseXOR(zero("p2")).alias("p2"),
                         (F.col("wb") + zero("wb")).alias("wb"), "b1", "b2", "bw", "len", "turns"))


def _nodes(edges: DataFrame, sums: dict, s: Settings) -> DataFrame:
    """depth, q1, q2, parent lanes, words before the last turn, and ``sums`` of every node below the
    root; ``sums`` tells how a column of the edges is put together over edges."""
    only = edges.groupBy(*PREFIX).count().filter("count = 1").select(*PREFIX, F.lit(True).alias("alone"))
    told = edges.join(only, PREFIX, "left")

    def lane(c, i):
        return F.aggregate(F.slice("turns", F.lit(1), i), F.col(f"p{c}"), lambda x, t: x.bitwiseXOR(t[f"x{c}"]))

    def words(i):
        return F.aggregate(F.slice("turns", F.lit(1), i), F.col("wb"), lambda x, t: x + t["words"])

    steps = F.transform(F.sequence(F.lit(1), F.col("len").cast("int")), lambda i: F.struct(
        (F.col("k") * s.turns + i).alias("depth"), lane(1, i).alias("q1"), lane(2, i).alias("q2"),
        lane(1, i - 1).alias("up1"), lane(2, i - 1).alias("up2"), words(i - 1).alias("before")))
    each = told.select("alone", *sums, F.explode(steps).alias("node")).select("alone", "node.*", *sums)
    straight = each.filter("alone").drop("alone")
    same = [F.min(c).alias(c) for c in ("up1", "up2", "before")]
    refined = each.filter("alone is null").groupBy(*NODE).agg(*same, *[v.alias(c) for c, v in sums.items()])
    return straight.unionByName(refined.select(*straight.columns))


def _root(members: DataFrame, sums: dict) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (members.agg(*[v.alias(c) for c, v in sums.items()], F.count("*").alias("_all")).filter("_all > 0")
            .select(*[zero.alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in ("up1", "up2")],
                    zero.alias("before"), *sums))


def _ends_hash(ends: DataFrame, s: Settings) -> DataFrame:
    """SHA-256 of the ids that end at each node, in order and joined by commas."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = (ends.withColumn("part", F.floor(F.col("conv") / s.ids)).groupBy(*NODE, "part").agg(ids.alias("ids"))
             .repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)]
                + [pa.array([d[1].hexdigest() for d in done], pa.string())], names=[*NODE, "sha"])

        node, state = None, None
        for batch in batches:
            done = []
            for *at, ids_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state))
                    node, state = at, hashlib.sha256()
                state.update(ids_.encode())
            yield rows(done)
        if node is not None:
            yield rows([(node, state)])

    return parts.mapInArrow(run, "depth long, q1 long, q2 long, sha string")


def trie(turns: DataFrame, members: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; the node is the first ``depth`` turns of ``conv_id``.

    ``turns``: (conv, pos from 0, digest, words); ``members``: every conv once."""
    s = settings
    blocks = _blocks(turns, s)
    whole = blocks.groupBy("conv").agg(F.sum("len").alias("depth"), F.bit_xor("b1").alias("q1"),
                                       F.bit_xor("b2").alias("q2"), F.sum("bw").alias("words"))
    ends = stage(members.join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*NODE, "words")]))

    edges = stage(blocks.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min("conv").alias("owner"),
                                            F.first("turns").alias("turns"), F.min("wb").alias("wb")))
    sums = {"n": F.sum("n"), "owner": F.min("owner")}
    first = stage(_nodes(edges, sums, s).unionByName(_root(members, {"n": F.count("*"), "owner": F.min("conv")})))
    nothing = F.lit(None).cast("long")
    below = first.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("q1"),
                                             F.col("up2").alias("q2"), nothing.alias("owner"), nothing.alias("before"),
                                             F.lit(1).alias("child"))
    known = (first.select(*NODE, "owner", "before", F.lit(0).alias("child")).unionByName(below)
             .groupBy(*NODE).agg(F.max("owner").alias("owner"), F.max("before").alias("before"), F.sum("child").alias("children")))
    owned = known.groupBy(F.col("owner").alias("conv")).agg(
        F.min_by("before", "depth").alias("shared"), F.max_by((F.col("children") == 0).cast("long"), "depth").alias("leaf"))
    own = stage(ends.join(owned, "conv", "left").select("conv", F.coalesce("shared", "words").alias("shared"),
                                                        F.coalesce("leaf", F.lit(0)).alias("leaf")))

    more = blocks.select("conv", *EDGE).join(own, "conv").groupBy(*EDGE).agg(
        F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves"), F.min_by("shared", "conv").alias("owners"))
    sums |= {"shared": F.sum("shared"), "leaves": F.sum("leaves"), "owners": F.min_by("owners", "owner")}
    top = {"n": F.count("*"), "owner": F.min("conv"), "shared": F.sum("shared"), "leaves": F.sum("leaf"),
           "owners": F.min_by("shared", "conv")}
    nodes = stage(_nodes(stage(edges.join(more, EDGE)), sums, s).unionByName(_root(own, top)))

    # a node's row, its children's and its ends' meet in one grouping
    kept = ["up1", "up2", "before", "n", "owner", "shared", "leaves", "owners"]
    none = [nothing.alias(c) for c in kept]
    here = nodes.select(*NODE, *kept, F.lit(0).alias("child"), F.lit(None).cast("string").alias("sha"))
    child = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("q1"),
                                             F.col("up2").alias("q2"), *none, F.lit(1).alias("child"),
                                             F.lit(None).cast("string").alias("sha"))
    ended = _ends_hash(ends, s).select(*NODE, *none, F.lit(0).alias("child"), "sha")
    full = stage(here.unionByName(child).unionByName(ended).groupBy(*NODE).agg(
        *[F.max(c).alias(c) for c in kept], F.sum("child").alias("n_children"), F.max("sha").alias("sha")))
    up = full.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("up1"), F.col("q2").alias("up2"),
                     F.col("owner").alias("parent_conv_id"))
    saved = F.col("shared") - F.col("owners") - (F.col("n") - 1) * F.col("before")
    return full.join(up, ["depth", "up1", "up2"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
