"""Order-dependent results without an unbounded group in one task.

``running_sums`` cuts every key into ordered pieces: totals per piece are
aggregated map-side, offsets run over the (small) table of pieces, and only
rows of one piece are ever sorted together.  Quantiles, ranks, empirical
distributions and precision-recall curves are all built on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.operators.staging import largest_group, stage

PIECE_ROWS = 500_000
DIRECT_ROWS = 1_000_000
#: Pieces of a key at most, a power of two; a key with more rows than so many pieces hold has larger ones.
CUTS = 1_024


def running_sums(df: DataFrame, keys, piece, order, sums: dict[str, str],
                 inclusive: bool = True) -> DataFrame:
    """Add ``{out: input column}`` cumulative sums along ``(piece, order)`` per key.

    ``piece`` columns must be non-decreasing in ``order``.  Rows with equal
    ``order`` are peers and receive the same (inclusive) sum.
    """
    keys, piece, order = list(keys), list(piece), list(order)
    totals = df.groupBy(*keys, *piece).agg(
        *[F.sum(c).alias(f"__tot_{o}") for o, c in sums.items()])
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        *piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *piece,
        *[F.coalesce(F.sum(f"__tot_{o}").over(before), F.lit(0)).alias(f"__off_{o}")
          for o in sums])
    inside = Window.partitionBy(*keys, *piece).orderBy(*order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"__in_{o}") for o, c in sums.items()])
    joined = local.join(offsets, keys + piece)
    out = [(F.col(f"__off_{o}") + F.col(f"__in_{o}")
            - (F.lit(0) if inclusive else F.col(c))).alias(o) for o, c in sums.items()]
    return joined.select(*df.columns, *out)


def time_rank(df: DataFrame, keys, time: str, out: str, span: int = 65_536) -> DataFrame:
    """0-based position in time order per key; time is unique per key."""
    cut = df.withColumn("__one", F.lit(1).cast("bigint")).withColumn(
        "__piece", F.floor(F.col(time) / span))
    ranked = running_sums(cut, keys, ["__piece"], [time], {out: "__one"}, inclusive=False)
    return ranked.drop("__one", "__piece")


def value_cuts(df: DataFrame, keys, value: str, rows: int = PIECE_ROWS) -> DataFrame:
    """``__cuts`` per key: ascending values with about ``rows`` rows, or a ``CUTS``-th of the key's
    rows if that is more, from one to the next.  A value with more rows than that is a cut itself.

    The sketch is staged, so every branch of a plan cuts alike; where the cuts lie decides the
    balance only.
    """
    probs = [i / CUTS for i in range(1, CUTS)]
    sketch = df.groupBy(*keys).agg(F.count("*").alias("__n"),
                                   F.percentile_approx(value, probs, 20 * CUTS).alias("__all"))
    pieces = F.least(F.lit(CUTS), F.ceil(F.col("__n") / rows)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get(
        F.col("__all"), F.floor(i * CUTS / pieces).cast("int") - 1))
    none = F.slice("__all", 1, 0)
    return stage(sketch.select(
        *keys, F.when(pieces > 1, F.array_distinct(picked)).otherwise(none).alias("__cuts")))


def cuts_below(x: Column, cuts: Column) -> Column:
    """Number of cuts less than ``x``: a binary search that halves its step."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((CUTS - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(cuts, at + step - 1) < x, at + step).otherwise(at))


def value_pieces(df: DataFrame, keys, value: str, rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``__piece``: value-ordered pieces of about ``rows`` rows each, cut at measured ranks.

    ``df`` is staged and has one row per (key, value).
    """
    keys = list(keys)
    return df.join(value_cuts(df, keys, value, rows), keys).select(
        *df.columns, cuts_below(F.col(value), F.col("__cuts")).alias("__piece"))


def _placed(df: DataFrame, cuts: DataFrame, keys: list) -> DataFrame:
    """Piece ``__p`` of ``__x`` and whether it lies ``__on`` the cut that ends the piece; missing: -1."""
    at = F.coalesce(cuts_below(F.col("__x"), F.col("__cuts")), F.lit(0))
    own = df.join(cuts, keys, "left").withColumn(
        "__p", F.when(F.col("__x").isNull(), F.lit(-1)).otherwise(at))
    on = (F.col("__p") >= 0) & (F.get("__cuts", "__p") == F.col("__x"))
    return own.withColumn("__on", F.coalesce(on, F.lit(False))).drop("__cuts")


def _dealt(values: DataFrame, reference: DataFrame, keys: list, value: str, rows: int
           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values and reference rows dealt to (piece, salt) in one frame, the reference by piece, and the
    table of pieces: reference rows before, inside and on the end of a piece, all of the key, values."""
    ref = reference.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__x"))
    cuts = value_cuts(ref, keys, "__x", rows)
    refs = _placed(ref, cuts, keys)
    own = _placed(values.withColumn("__x", F.col(value)), cuts, keys)
    marks = refs.select(*keys, "__p", "__on", F.lit(True).alias("__r")).unionByName(
        own.select(*keys, "__p", "__on", F.lit(False).alias("__r")))
    count = marks.groupBy(*keys, "__p").agg(
        F.count_if(F.col("__r") & ~F.col("__on")).alias("__in"),
        F.count_if(F.col("__r") & F.col("__on")).alias("__end"),
        F.count_if(~F.col("__r")).alias("__v"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    both = F.col("__in") + F.col("__end")
    book = stage(count.select(
        "*", F.coalesce(F.sum(both).over(before), F.lit(0)).alias("__base"),
        F.sum(both).over(whole).alias("__n"), F.ceil(F.col("__v") / rows).alias("__salts")))
    plain = [c for c, kind in values.dtypes if not kind.startswith(("array", "map", "struct"))]
    salt = F.when(F.col("__salts") > 1, F.pmod(F.xxhash64(*plain), F.col("__salts"))).otherwise(F.lit(0))
    dealt = own.join(book, keys + ["__p"], "left").withColumn("__salt", salt.cast("bigint")).withColumn(
        "__ref", F.lit(0))
    met = refs.where(~F.col("__on")).join(book.where("__v > 0"), keys + ["__p"]).select(
        *keys, "__p", "__x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1)).alias("__salt"),
        F.lit(1).alias("__ref"))
    return dealt.unionByName(met, allowMissingColumns=True), refs, book


def ranks_among(values: DataFrame, reference: DataFrame, keys, value: str, rank: str, size: str,
                rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``rank``, the reference rows of the key that are at most the value, and ``size``, all of
    them (NULL if there are none).  A missing value ranks as the upper median of the reference.

    Only the reference is ranked.  It is cut at measured ranks; values are dealt by the same cuts
    and sorted with their piece, so values are shuffled once, by piece and never by value.  Reference
    rows on a cut, which may be very many, are counted and don't travel.  A piece with many values is
    salted: its values are dealt by a hash of the row, its reference rows go to every salt.  As a salt
    has ``rows`` values, the copies are at most as many as values and reference rows together while
    pieces keep to ``rows``.
    """
    keys = list(keys)
    dealt, refs, book = _dealt(values, reference, keys, value, rows)
    upto = Window.partitionBy(*keys, "__p", "__salt").orderBy("__x").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    done = dealt.withColumn("__below", F.sum("__ref").over(upto)).where("__ref = 0")
    found = F.col("__base") + F.when(
        F.col("__on"), F.col("__in") + F.col("__end")).otherwise(F.col("__below"))
    missing = book.where("__p = -1 and __n > 0").select(*keys)
    if missing.isEmpty():
        middle = F.lit(None).cast("bigint")
    else:
        done, middle = done.join(_upper_median_rank(refs, book, missing, keys), keys, "left"), F.col("__mid")
    return done.select(*values.columns, F.when(F.col("__x").isNull(), middle).otherwise(found).alias(rank),
                       F.nullif("__n", F.lit(0)).alias(size))


def _upper_median_rank(refs: DataFrame, book: DataFrame, wanted: DataFrame, keys: list) -> DataFrame:
    """``__mid``: reference rows at most the upper median; only the piece that holds it is read."""
    spot = book.where("__base <= __n div 2 and __n div 2 < __base + __in + __end").join(
        wanted, keys, "left_semi")
    at_end = spot.where("__n div 2 >= __base + __in").select(
        *keys, (F.col("__base") + F.col("__in") + F.col("__end")).alias("__mid"))
    counted = refs.where(~F.col("__on")).join(spot.where("__n div 2 < __base + __in"), keys + ["__p"]).groupBy(
        *keys, "__base", "__n", "__x").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy("__x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = counted.withColumn("__mid", F.col("__base") + F.sum("__c").over(upto)).where(
        "__mid > __n div 2").groupBy(*keys).agg(F.min("__mid").alias("__mid"))
    return stage(at_end.unionByName(inside))


def running_by_value(df: DataFrame, keys, value: str, sums: dict[str, str],
                     rows: int = PIECE_ROWS, descending: bool = False) -> DataFrame:
    """Cumulative sums in value order per key.

    ``df`` is staged and has one row per (key, value).  Groups measured to fit a
    task use a plain window, larger ones are cut into value pieces.
    """
    if largest_group(df, keys) <= rows:
        order = F.col(value).desc() if descending else F.col(value).asc()
        run = Window.partitionBy(*keys).orderBy(order).rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(run).alias(o) for o, c in sums.items()])
    src = df.withColumn("__v", -F.col(value) if descending else F.col(value))
    pieces = value_pieces(src, keys, "__v", rows)
    return running_sums(pieces, keys, ["__piece"], ["__v"], sums).drop("__piece", "__v")


def quantiles(df: DataFrame, keys, value: str, probs, out, direct_rows: int = DIRECT_ROWS,
              most: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, NULL values ignored.

    The built-in ``percentile`` keeps every distinct value of a group, so it is
    used only when the largest group (measured, or ``most`` where the caller
    already knows a bound) is at most ``direct_rows``.  Larger groups are bracketed by a bounded sketch; a second scan counts what
    lies outside the brackets and keeps values inside, about 1e-4 of the rows.
    """
    keys, probs, out = list(keys), list(probs), list(out)
    kept = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if (largest_group(kept, keys) if most is None else most) <= direct_rows:
        grouped = kept.groupBy(*keys).agg(
            F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("__q"))
        return grouped.select(*keys, *[F.col("__q")[i].alias(o) for i, o in enumerate(out)])
    return _bracketed_quantiles(kept, keys, probs, out)


def _bracketed_quantiles(kept: DataFrame, keys, probs, out, margin: float = 5e-5,
                         accuracy: int = 100_000, exact_below: int = 100_000) -> DataFrame:
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    asked = [max(0.0, probs[i] - margin) for i in order] + [
        min(1.0, probs[i] + margin) for i in order]
    sketch = kept.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__mn"), F.max("__v").alias("__mx"),
        F.percentile_approx("__v", asked, accuracy).alias("__a"))
    small = F.col("__n") <= exact_below
    low = [F.when(small | F.lit(probs[i] <= margin), F.col("__mn")).otherwise(F.col("__a")[k])
           for k, i in enumerate(order)]
    high = [F.when(small | F.lit(probs[i] >= 1 - margin), F.col("__mx")).otherwise(
        F.col("__a")[k + len(order)]) for k, i in enumerate(order)]
    brackets = stage(sketch.select(*keys, "__n", F.array(*low).alias("__lo"),
                                   F.array(*high).alias("__hi")))
    rows = kept.join(brackets, keys)
    inside = F.exists(F.arrays_zip("__lo", "__hi"),
                      lambda b: (F.col("__v") >= b["__lo"]) & (F.col("__v") <= b["__hi"]))
    passed = F.size(F.filter("__hi", lambda h: h < F.col("__v")))
    counted = rows.groupBy(*keys, "__n", passed.alias("__gap"),
                           F.when(inside, F.col("__v")).alias("__cv")).agg(
        F.count("*").alias("__c"))
    run = Window.partitionBy(*keys).orderBy("__gap", F.asc_nulls_first("__cv")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = counted.withColumn("__end", F.sum("__c").over(run)).where("__cv is not null")
    picks = []
    for p, o in zip(probs, out):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        for edge, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank)
            picks.append(F.max(F.when(hit, F.col("__cv"))).alias(f"__{edge}_{o}"))
    chosen = cum.groupBy(*keys, "__n").agg(*picks)
    def interpolate(p, o):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo = F.coalesce(F.col(f"__lo_{o}"), F.raise_error(F.lit("quantile bracket missed")))
        hi = F.coalesce(F.col(f"__hi_{o}"), F.raise_error(F.lit("quantile bracket missed")))
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(o)
    return chosen.select(*keys, *[interpolate(p, o) for p, o in zip(probs, out)])
