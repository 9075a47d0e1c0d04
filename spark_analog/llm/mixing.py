"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source asks for its share of the budget by weight. A source is clamped at
``cap`` times its own size (its maximum of epochs) and what it can't take is
dealt again by weight to the others until no target is above its clamp. The
water level is found in closed form: with sources in the order of cap / weight,
the level is the largest ``(budget - caps before) / (weights from here on)``.

A target is met by whole repetitions of every document plus a fractional one:
documents are placed by a seeded hash of their id on [0, 1), and those below a
cut are taken once more. The cut is the last point where their words don't exceed
the fraction asked for; the room that is left, less than the document at the cut
holds, is filled in the same way by documents beyond the cut that fit it, up to the
point where their words come nearest to it; unless taking what lies at the cut instead
comes nearer still. A cut is found digit by digit: the
hash is read as hexadecimal digits, sizes are summed per source and digit
group, and only the group where the sum crosses is opened further. No window
ever holds more than 4,096 rows, no matter how many rows a source has.

Results in special cases: null text has size 0; null sources are one source,
ordered last; an empty table gives no rows; repeated rows with one doc_id share
one place and so are taken or left together; a source of size 0 has target 0
and its documents take 0. Extra columns are ignored by :func:`plan` and kept by
:func:`apply`. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.llm.common import WORD, free_name
from spark_analog.operators.staging import stage

#: Hexadecimal digits read at a time, and how often.
DIGITS, ROUNDS = 3, 3


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    cap: float = 3.0
    seed: int = 0


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)),
                      F.lit(0)).cast("long")


def place(doc_id: str, seed: int) -> Column:
    """Where a document lies on [0, 1), as hexadecimal digits."""
    return F.substring(F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
        .cast("binary")), 1, DIGITS * ROUNDS)


def targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """One row per source: source, source_size, target (sizes: source, size)."""
    totals = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in settings.weights])
    weighed = totals.withColumn(
        "weight", F.element_at(kinds, (
            (F.row_number().over(names) - 1) % len(settings.weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * settings.cap)
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything)
              - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    return (weighed.withColumn("level", level)
            .withColumn("level", F.max("level").over(everything))
            .select("source", "source_size",
                    F.least("most", F.col("weight") * F.col("level")).alias("target")))


def plan(docs: DataFrame, settings: Settings = Settings(), text: str = "text",
         source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(sources, documents).

    sources: source, source_size, target, whole (repetitions of every document),
    and cut, at_cut, room, fill and at_fill (see :func:`copies`). documents: doc_id, source,
    size, place.
    """
    placed = stage(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        size_of(text).alias("size"), place(doc_id, settings.seed).alias("place")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = (targets(placed, settings)
               .withColumn("whole", F.floor(ratio).cast("int"))
               .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
               .withColumn("after", F.lit("")).withColumn("room", F.lit(float("inf")))
               .withColumn("edge", F.lit(0).cast("long")))
    sources = _find_cut(placed, sources)
    sources = (sources.withColumn("after", F.col("cut"))
               .withColumn("room", F.col("wanted") - F.col("below"))
               .withColumn("edge", F.col("inside"))
               .withColumn("wanted", F.col("room")))
    sources = _find_cut(placed, sources)
    near = (F.col("below") + F.col("inside") - F.col("wanted")) < (F.col("wanted") - F.col("below"))
    short = F.abs(F.col("room") - F.col("below") - F.when(near, F.col("inside")).otherwise(0))
    over = F.col("edge") - F.col("room")
    return stage(sources.select("source", "source_size", "target", "whole", F.col("after").alias("cut"),
                                (over < short).alias("at_cut"), "room", F.col("cut").alias("fill"),
                                near.alias("at_fill"))), placed


def _find_cut(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """cut, below and inside of every source: among its documents placed beyond ``after`` and
    no larger than ``room``, the place where their summed sizes reach ``wanted``, the sum
    below it and the size of what lies at it. A source without such documents has a null cut."""
    sources = (sources.drop("cut", "below", "inside").withColumn("cut", F.lit(""))
               .withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.lit(0).cast("long")))
    for k in range(1, ROUNDS + 1):
        sources = _open(placed, stage(sources), k)
    return stage(sources)


def _open(placed: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Move every source's cut one group of digits further."""
    known = sources.select(*[F.col(c).alias(f"_{c}") for c in ("source", "cut", "after", "room")])
    groups = (placed.join(known, F.col("source").eqNullSafe(F.col("_source")))
              .filter((F.substring("place", 1, DIGITS * (k - 1)) == F.col("_cut"))
                      & (F.col("place") > F.col("_after")) & (F.col("size") <= F.col("_room")))
              .groupBy("source", F.substring("place", 1, DIGITS * k).alias("group"))
              .agg(F.sum("size").alias("mass")))
    upto = Window.partitionBy("source").orderBy("group")
    whole = Window.partitionBy("source")
    summed = (groups.withColumn("upto", F.sum("mass").over(upto))
              .withColumn("last", F.max("group").over(whole))
              .select(F.col("source").alias("_source"), "group", "mass", "upto", "last"))
    wanted = F.col("wanted") - F.col("below")
    crossing = (sources.join(summed, F.col("source").eqNullSafe(F.col("_source")))
                .filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("mass") < wanted)
                        | (F.col("upto") < wanted) & (F.col("group") == F.col("last"))
                        | (wanted <= 0) & (F.col("upto") == F.col("mass"))))
    at = crossing.groupBy("_source").agg(F.min(F.struct("group", "upto", "mass")).alias("at"))
    return (sources.join(at, F.col("source").eqNullSafe(F.col("_source")) & F.col("at").isNotNull(), "left")
            .select("source", "source_size", "target", "whole", "wanted", "after", "room", "edge",
                    F.col("at.group").alias("cut"),
                    (F.col("below") + F.coalesce(F.col("at.upto") - F.col("at.mass"), F.lit(0))).alias("below"),
                    F.coalesce("at.mass", F.lit(0)).cast("long").alias("inside")))


def copies(size: Column, placed: Column, at: dict[str, str] | None = None) -> Column:
    """How often a document is taken, from the columns of its source's plan."""
    of = lambda c: F.col((at or {}).get(c, c))
    filled = ((placed > of("cut")) & (size <= of("room"))
              & ((placed < of("fill")) | ((placed == of("fill")) & of("at_fill"))))
    beyond = F.when(of("at_cut"), placed == of("cut")).otherwise(filled)
    return of("whole") + F.coalesce((placed < of("cut")) | beyond, F.lit(False)).cast("int")


def mix(docs: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sources, placed = plan(docs, settings, **columns)
    sources = sources.withColumnRenamed("source", "_source")
    joined = placed.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    return (joined.withColumn("copies", copies(F.col("size"), F.col("place")))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def apply(docs: DataFrame, settings: Settings = Settings(), text: str = "text",
          source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed table: every row as often as its source's plan says, same columns."""
    sources, _ = plan(docs, settings, text, source, doc_id)
    names = ("source", "whole", "cut", "at_cut", "room", "fill", "at_fill")
    own = {c: free_name(docs, f"_mix_{c}") for c in names}
    side = sources.select(*[F.col(c).alias(name) for c, name in own.items()])
    n = free_name(docs, "_mix_n")
    return (docs.join(side, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(own["source"])))
            .withColumn(n, copies(size_of(text), place(doc_id, settings.seed), own))
            .filter(F.col(n) > 0)
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


#: Same rows in DuckDB; table ``documents``.
SQL = r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 9) as place
  from documents),
totals as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight
  from sized group by source),
levels as (
  select *, (sum(source_size) over ()
    - coalesce(sum(3.0 * source_size) over (order by 3.0 * source_size / weight, source nulls last
        rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 3.0 * source_size / weight, source nulls last
        rows between current row and unbounded following) as level
  from totals),
targets as (
  select source, source_size,
         least(3.0 * source_size, weight * max(level) over ())::double as target from levels),
plans as (
  select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as whole
  from targets),
wishes as (select *, target - whole * source_size as wanted from plans),
cells as (
  select source, place, sum(size) as mass,
         sum(sum(size)) over (partition by source order by place) as upto,
         max(place) over (partition by source) as last
  from sized group by source, place),
cuts as (
  select w.source, min(struct_pack(place := c.place, below := c.upto - c.mass, mass := c.mass)) as at
  from wishes w join cells c on w.source is not distinct from c.source
  where c.upto >= wanted and c.upto - c.mass < wanted or c.upto < wanted and c.place = c.last
     or wanted <= 0 and c.upto = c.mass group by w.source),
rooms as (
  select w.*, c.at.place as cut, w.wanted - c.at.below as room, c.at.mass as edge
  from wishes w join cuts c on w.source is not distinct from c.source),
cells2 as (
  select s.source, s.place, r.room, sum(s.size) as mass,
         sum(sum(s.size)) over (partition by s.source order by s.place) as upto,
         max(s.place) over (partition by s.source) as last
  from sized s join rooms r on s.source is not distinct from r.source
  where s.place > r.cut and s.size <= r.room group by s.source, s.place, r.room),
fills as (
  select source, min(struct_pack(place := place, near := upto - room < room - (upto - mass),
                                 below := upto - mass, mass := mass)) as at
  from cells2 where upto >= room and upto - mass < room or upto < room and place = last
     or room <= 0 and upto = mass group by source),
ready as (
  select r.*, f.at.place as fill, f.at.near as at_fill,
         edge - room < abs(room - coalesce(f.at.below + case when f.at.near then f.at.mass else 0 end, 0))
           as at_cut
  from rooms r left join fills f on r.source is not distinct from f.source)
select s.doc_id, s.size, t.source_size, t.target,
       (s.size * (t.whole + coalesce(s.place < t.cut or case when t.at_cut then s.place = t.cut
          else s.place > t.cut and s.size <= t.room
               and (s.place < t.fill or (s.place = t.fill and t.at_fill)) end, false)::int))::bigint as taken
from sized s join ready t on s.source is not distinct from t.source
"""
