"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word 5-grams. Documents with the same set
are one. Similar documents are put into groups, and for each group the union of
its members' tokens is kept; a document can only be similar to a member if
enough of its tokens are in that union, so only such groups are opened.

1. Tokens get one global order: those in few documents first, those known to be
   in many last. (The order steers the work, any order gives the same result.)
2. A group holds documents with the same smallest token by value, which similar texts
   share as often as they share any token. A crowded one is dealt over several groups by a hash,
   each of bounded total size; its smallest set joins all of them, which ties the
   copies of a large family together. Members are compared within each group.
   Twice more, by other orders of value, one set of every component found so far is grouped and
   compared in the same way, so few pieces of a large family are left.
3. The matrix: a document of n tokens shares at least 75 n / 100 with any similar
   one, so two similar documents share a token among the first
   n - ceil(75 n / 100) + 1 of each. Only those tokens are stored for the search, one row per token
   and component with the sizes of the members that search it. Two components count the
   tokens they share; the sizes bound that count from below.
   A token's place in a member also bounds the size of a partner: what comes from the first shared
   token on must hold the whole overlap. A token that very many components search counts only
   where the places allow it, and what that may leave out is taken off the bound. Rows too
   late in their sets for a partner of their size meet early rows only, so a passage that many
   documents share at the end of their order makes no rows at all.
4. Where two components reach the bound, the members of the smaller one ask the groups of the
   larger one. In an opened group the overlap with its whole union is computed; documents that
   pass are compared with the members, until one link ties them.

Sets travel only for documents that need a comparison. Those are picked in the
scan with bitmaps of fixed size, so texts are never shuffled; a hit by chance
costs some rows and changes nothing.

Results in special cases: fewer words than five are one shingle; null texts and
texts without words have an empty set, n_shingles 0 and no links; repeated rows
of an id give a row each, and every different text of an id is compared: its rows are one
component, with the links of all its texts; a null id has a null
component and ties nothing; an empty table gives no rows; extra columns are ignored. Tokens are
64-bit hashes of the words' hashes, and a set is known by 63 bits of its tokens' sum and number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.llm.common import WordHashes, annotate, chain, mix, release
from spark_analog.llm.components import components
from spark_analog.operators.staging import stage


@dataclass(frozen=True)
class Settings:
    """``percent``: least Jaccard similarity; ``group_tokens``: tokens a group holds;
    ``rounds``: orders of value by which sets are grouped; ``crowded``: components that search a
    token from which on places count; ``local_hot``, ``hot``: documents in one task and overall that make a token common;
    ``most_hot``: common tokens that are broadcast at most (16 bytes each): those above the
    lowest power of two that leaves no more;
    ``bitmap_bits``: size of the bitmaps; ``askers``: documents held against one group in
    one task."""
    width: int = 5
    percent: int = 75
    group_tokens: int = 100_000
    rounds: int = 3
    crowded: int = 32
    local_hot: int = 3
    hot: int = 6
    most_hot: int = 500_000
    bitmap_bits: int = 1 << 25
    askers: int = 512
    slice_tokens: int = 4_000_000


#: Bytes of text hashed together; a longer text is a slice of its own.
SLICE = 1 << 20


def token_sets(texts: list[bytes | None], hashes: WordHashes, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of each whole text."""
    at = 0
    while at < len(texts):
        start, size = at, 0
        while at < len(texts) and (size < SLICE or at == start):
            size += len(texts[at] or b"")
            at += 1
        found, ends = hashes.of([t and t.lower() for t in texts[start:at]])
        runs = chain(found, width)
        begin = 0
        for end in ends.tolist():
            n = end - begin
            if n >= width:
                t = np.sort(runs[begin:end - width + 1])
                yield t[np.append(True, t[1:] != t[:-1])]
            elif n:
                yield mix(chain(found[begin:end], n) + np.uint64(n))
            else:
                yield np.empty(0, np.uint64)
            begin = end


def least_overlap(n, percent: int):
    """Tokens of a set of n that a similar set must hold."""
    return -(-percent * n // 100)


def searched(ordered: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens, of which any similar set searches one as well."""
    return ordered[:len(ordered) - least_overlap(len(ordered), percent) + 1]


def similar(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


class Order:
    """Tokens by how common they are, then by value."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens, kind="stable")
        self.tokens, self.rank = tokens[at], np.log2(counts[at]).astype(np.int64) + 1

    def _ranks(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.rank[at], 0)

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens that come sorted by value, in this order."""
        if not len(self.tokens):
            return tokens
        rank = self._ranks(tokens)
        common = np.flatnonzero(rank)
        if not len(common):
            return tokens
        common = common[np.argsort(rank[common], kind="stable")]
        return np.concatenate([tokens[rank == 0], tokens[common]])


def intersections(one: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Tokens that a sorted set shares with each of n sets laid end to end."""
    if not len(one):
        return np.zeros(n, np.int64)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.bincount(owner[hit], minlength=n)


def _flat(sets: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    picked = [sets[i] for i in at]
    return np.concatenate(picked), np.repeat(np.arange(len(at)), [len(x) for x in picked])


def group_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For every set of a group, the first set of its component."""
    size = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    open_ = np.arange(len(sets))
    flat, owner = _flat(sets, open_)
    while len(open_):
        first = open_[0]
        queue = [first]
        drop = np.zeros(len(open_), bool)
        drop[0] = True
        while True:
            if drop.any():
                open_ = open_[~drop]
                if not len(open_):
                    return root
                live = ~drop[owner]
                flat, owner = flat[live], (np.cumsum(~drop) - 1)[owner[live]]
            if not queue:
                break
            p = queue.pop()
            inter = intersections(sets[p], flat, owner, len(open_))
            drop = similar(inter, size[p], size[open_], percent)
            root[open_[drop]] = first
            queue += open_[drop].tolist()
    return root


def asker_links(askers: list, members: list[np.ndarray], percent: int) -> list[int]:
    """Of askers (component, set), one per component, the places of those that are similar to a member
    of an opened group."""
    union = np.unique(np.concatenate(members))
    size = np.array([len(x) for x in members])
    flat, owner = _flat(members, np.arange(len(members)))
    linked, out = set(), []
    for k, (component, own) in enumerate(askers):
        if component in linked or np.isin(own, union, assume_unique=True).sum() < least_overlap(len(own), percent):
            continue  # tied already, or the group stays closed for this document
        if similar(intersections(own, flat, owner, len(members)), len(own), size, percent).any():
            linked.add(component)
            out.append(k)
    return out


def set_id(tokens: np.ndarray) -> int:
    """63 bits that name a set."""
    return int(mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0] >> np.uint64(1))


def _by_value(tokens: np.ndarray, k: int) -> int:
    """Smallest token in the k-th order of values."""
    return int((tokens[0] if not k else mix(tokens ^ np.uint64(k)).min()).view(np.int64))


def name_sets(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> tuple[DataFrame, str]:
    """The rows with a struct (n, sid): tokens of each text and the name of its set; returns the name too."""
    def make():
        hashes = WordHashes()

        def kernel(texts):
            sets = list(token_sets(texts, hashes, settings.width))
            return {"n": np.array([len(x) for x in sets], np.int64),
                    "sid": np.array([set_id(x) for x in sets], np.int64)}
        return kernel
    fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("sid", T.LongType())])
    return annotate(docs, make, fields, text, into="token_set")


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bitmap of a long column, modulo ``bits``; at most bits / 48 numbers reach the driver."""
    rows = (keys.select(F.pmod(F.col(key), F.lit(bits)).alias("p")).groupBy(F.floor(F.col("p") / 48).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 48 as int))")).alias("m"))
            .toArrow())
    out = np.zeros(-(-bits // 48), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("m").to_numpy()
    return out


def in_bitmap(known: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = np.mod(keys, bits)
    return (known[at // 48] >> (at % 48)) & 1 > 0


def _scan(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(id, n, sid, leads) of every row, leads being its smallest tokens, and (token, count) of tokens common within a task."""
    def run(batches):
        release()
        hashes = WordHashes()
        held, size = [], 0

        def common():
            nonlocal held, size
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= s.local_hot
            held, size = [], 0
            m = int(keep.sum())
            return rows([None] * m, count[keep], tokens[keep].view(np.int64), [None] * m, [True] * m)

        def rows(ids, n, key, leads, common_):
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.int64()),
                 pa.array(leads, pa.list_(pa.int64())), pa.array(common_, pa.bool_())],
                names=["id", "n", "key", "leads", "common"])

        for b in batches:
            n, key, leads = [], [], []
            for t in token_sets(b.column("text").to_pylist(), hashes, s.width):
                n.append(len(t))
                leads.append([_by_value(t, k) for k in range(s.rounds)] if len(t) else None)
                key.append(set_id(t))
                held.append(t)
                size += len(t)
                if size >= s.slice_tokens:
                    yield common()
            yield rows(b.column("id"), n, key, leads, [False] * len(n))
        if size:
            yield common()

    out = stage(docs.mapInArrow(run, "id long, n long, key long, leads array<long>, common boolean"))
    return (out.filter("not common").select("id", "n", F.col("key").alias("sid"), "leads"),
            out.filter("common").select(F.col("key").alias("token"), F.col("n").alias("count")))


def _common(counts: DataFrame, s: Settings) -> Order:
    """The order that puts common tokens last; at most ``most_hot`` tokens reach the driver."""
    hot = stage(counts.groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") >= s.hot))
    level = F.floor(F.log2("count")).cast("int")
    least, held = None, 0
    for b, n in sorted(map(tuple, hot.groupBy(level.alias("b")).count().collect()), reverse=True):  # a row per power of two
        if held + n > s.most_hot:
            break
        least, held = b, held + n
    if least is None:
        return Order(np.empty(0, np.uint64), np.empty(0, np.int64))
    found = hot.filter(level >= least).toArrow()
    return Order(found.column("token").to_numpy().astype(np.int64).view(np.uint64), found.column("count").to_numpy())


def _some_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """``wanted`` (sid, id, ...) with the sorted set as bytes, from the text of the row with this id and set."""
    some = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("id"), "id", s.bitmap_bits))

    def run(batches):
        release()
        hashes = WordHashes()
        for b in batches:
            ids, sids, sets = [], [], []
            picked = in_bitmap(some.value, b.column("id").to_numpy(), s.bitmap_bits)
            some_rows = b.filter(pa.array(picked))
            found = token_sets(some_rows.column("text").to_pylist(), hashes, s.width)
            for id_, t in zip(some_rows.column("id").to_pylist(), found, strict=True):
                if len(t):
                    ids.append(id_)
                    sids.append(set_id(t))
                    sets.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sids, pa.int64()),
                                              pa.array(sets, pa.binary())], names=["id", "sid", "tokens"])
    return docs.mapInArrow(run, "id long, sid long, tokens binary").join(wanted, ["id", "sid"])


def classes(docs: DataFrame, settings: Settings = Settings(), text: str = "text",
            doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, n, sid) of every row, and (sid, class) of every set that is similar to another: classes
    of texts, whatever the ids of their rows; rows without an id take no part."""
    s = settings
    sc = docs.sparkSession.sparkContext
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                        F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    scanned, common = _scan(given, s)
    order = sc.broadcast(_common(common, s))
    full = scanned.filter("n > 0 and id is not null")
    sets = stage(full.groupBy("sid").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("leads").alias("leads"),
                                         F.count("*").alias("rows")))
    known = given.filter("id is not null")
    units = _groups(sets.select("sid", "id", "n", F.col("leads")[0].alias("lead"), "rows"), s)
    links, groups, matrix = _within(known, sets, units, order, s)
    parts = stage(components(links))
    for k in range(1, s.rounds):
        links = links.unionByName(_again(known, sets, parts, k, s))
        parts = stage(components(links))
    links = links.unionByName(_across(known, sets, groups, matrix, parts, s))
    return scanned.select("id", "n", "sid"), stage(components(links).select(F.col("id").alias("sid"), F.col("component").alias("class")))


def duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, found = classes(docs, settings, text, doc_id)
    named = rows.join(found, "sid", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("class", "sid")))
    named = stage(named.filter("id is not null").select("id", "class").filter("class is not null").distinct())
    # different texts of one id tie their classes
    several = named.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
    tied = components(named.join(several.select("id", "a"), "id").select("a", F.col("class").alias("b")))
    whole = stage(named.join(tied.withColumnRenamed("id", "class"), "class", "left")
                  .select("id", F.coalesce("component", "class").alias("class")).distinct())
    least = whole.groupBy("class").agg(F.min("id").alias("component_id"), F.count("*").alias("ids")).filter("ids > 1")
    own = stage(whole.join(least.drop("ids"), "class").select("id", "component_id").distinct())
    return (rows.join(own, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id")))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each class of similar texts the one with the smallest id, and of
    that id's texts in the class the one whose set has the smallest name. Among rows of this id and set the
    smallest stays, columns compared from left to right. Texts without words are similar to nothing: each
    id keeps one. Rows without an id all stay."""
    rows, found = classes(docs, settings, text, doc_id)
    named = (rows.filter("id is not null").select("id", "n", "sid").distinct().join(found, "sid", "left")
             .withColumn("class", F.coalesce("class", "sid")))
    kept = stage(named.filter("n > 0").groupBy("class").agg(F.min(F.struct("id", "sid")).alias("one")).select("one.*")
                 .unionByName(named.filter("n = 0").select("id", "sid")))
    labelled, at = name_sets(docs, settings, text)
    own = labelled.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"{at}.sid").alias("sid"),
                          F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = own.filter("id is not null").groupBy("id", "sid").agg(F.min("row").alias("row")).join(kept, ["id", "sid"], "left_semi")
    return first.unionByName(own.filter("id is null").select("id", "sid", "row")).select("row.*")


def _groups(sets: DataFrame, s: Settings) -> DataFrame:
    """sid, id, lead, rows (with this lead) and group of every set; the smallest set
    of a crowded lead is in all its groups."""
    crowd = (sets.groupBy("lead").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"), F.min("sid").alias("pivot"),
                                      F.sum("rows").alias("all_rows")).filter("all_rows > 1")
             .withColumn("parts", F.least("sets", F.ceil(F.col("tokens") / s.group_tokens))))
    told = sets.join(stage(crowd), "lead", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = F.when(F.col("sid") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) \
        .otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("parts"))))
    return stage(told.withColumn("part", F.explode(spread))
                 .select("sid", "id", "lead", F.coalesce("all_rows", F.lit(1)).alias("rows"),
                         # negative; a group of one goes by its set, which is not
                         F.xxhash64("lead", "part").bitwiseOR(F.lit(-(1 << 63))).alias("group")))


def _by_group(frame: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    runs = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(runs, *keys).sortWithinPartitions(*keys, *then, "sid")


def _grouped(batches, columns: tuple[str, ...]):
    """(group, members) of rows sorted by group and sid, each set once; members are (sid, tokens)."""
    current, members = None, []
    for b in batches:
        names = {c: i for i, c in enumerate(b.schema.names)}
        for sid, tokens, group in zip(*(b.column(names[c]).to_pylist() for c in columns), strict=True):
            if group != current and members:
                yield current, members
                members = []
            current = group
            if not members or members[-1][0] != sid:
                members.append((sid, np.frombuffer(tokens, np.uint64)))
    if members:
        yield current, members


def largest_partner(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a similar set holds at most, if the first shared token is at ``place`` of a set of n."""
    return (n - place) * (100 + percent) // percent - n


def _within(docs: DataFrame, sets: DataFrame, units: DataFrame, order, s: Settings):
    """links (a, b) within groups; groups (group, sid); matrix rows (token, root, lo, hi, cap): of the members
    of a group that are one component and search a token that others search too, the sizes and the largest partner."""
    sc = docs.sparkSession.sparkContext
    crowded = sc.broadcast(bitmap(units.filter("rows > 1"), "lead", s.bitmap_bits))
    # a set alone with its smallest token needs no comparison within a group
    single = _sorted_sets(docs, order, crowded, True, s)
    shared = _sorted_sets(docs, order, crowded, False, s)
    grouped = _by_group(shared.select("sid", "id", "tokens").join(units.select("sid", "id", "group"), ["sid", "id"])
                        .select("sid", "tokens", "group"), "group")
    names = ["group", "sid", "root", "token", "lo", "hi", "cap"]

    def batch(n, **columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in names], names=names)

    def compare(batches):
        for group, members in _grouped(batches, ("sid", "tokens", "group")):
            ids = np.array([i for i, _ in members])
            size = np.array([len(x) for _, x in members])
            root = group_roots([np.sort(x) for _, x in members], s.percent)
            yield batch(len(ids), group=[group] * len(ids), sid=ids, root=ids[root])
            first = [searched(x, s.percent) for _, x in members]
            owner = np.repeat(np.arange(len(ids)), [len(f) for f in first])
            flat, of = np.concatenate(first), root[owner]
            place = np.concatenate([np.arange(len(f)) for f in first])
            by = np.lexsort((of, flat))
            flat, of, owner, place = flat[by], of[by], owner[by], place[by]
            start = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])))
            yield batch(len(start), token=flat[start].view(np.int64), root=ids[of[start]],
                        lo=np.minimum.reduceat(size[owner], start), hi=np.maximum.reduceat(size[owner], start),
                        cap=np.maximum.reduceat(largest_partner(size[owner], place, s.percent), start))

    done = stage(grouped.mapInArrow(compare, ", ".join(f"{c} long" for c in names)))
    links = done.filter("sid is not null and sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    n, place = F.col("n"), F.col("place")
    cap = F.floor((n - place) * (100 + s.percent) / s.percent) - n
    alone = (single.select("sid", "n", F.posexplode("first").alias("place", "token"))
             .select("token", F.col("sid").alias("root"), n.alias("lo"), n.alias("hi"), cap.alias("cap")))
    per = Window.partitionBy("token")
    matrix = stage(done.filter("token is not null").select("token", "root", "lo", "hi", "cap").unionByName(alone)
                   .withColumn("low", F.min("root").over(per)).withColumn("high", F.max("root").over(per))
                   .filter("low < high").drop("low", "high"))
    groups = done.filter("sid is not null").select("group", "sid").unionByName(
        units.filter("rows = 1").select(F.col("sid").alias("group"), "sid"))
    return links, groups, matrix


def _sorted_sets(docs: DataFrame, order, crowded, alone: bool, s: Settings) -> DataFrame:
    """Of documents alone with their smallest token: id, sid, n and the searched tokens; of the
    others: id, sid, n and the whole set in order, as bytes."""
    def run(batches):
        release()
        hashes = WordHashes()
        for b in batches:
            ids, sids, sets = [], [], []
            found = token_sets(b.column("text").to_pylist(), hashes, s.width)
            for id_, t in zip(b.column("id").to_pylist(), found, strict=True):
                if len(t):
                    if in_bitmap(crowded.value, t[:1].view(np.int64), s.bitmap_bits)[0] != alone:
                        ids.append(id_)
                        sids.append(set_id(t))
                        sets.append(order.value.sort(t))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array([len(t) for t in sets], pa.int64()),
                 pa.nulls(n, pa.binary()) if alone else pa.array([t.tobytes() for t in sets], pa.binary()),
                 pa.array([searched(t, s.percent).view(np.int64) for t in sets], pa.list_(pa.int64()))
                 if alone else pa.nulls(n, pa.list_(pa.int64()))], names=["id", "sid", "n", "tokens", "first"])
    return docs.mapInArrow(run, "id long, sid long, n long, tokens binary, first array<long>")


def _component(frame: DataFrame, parts: DataFrame, sid: str = "sid") -> DataFrame:
    """``frame`` with ``comp``, the component that the set is known to be in."""
    told = parts.select(F.col("id").alias(sid), F.col("component"))
    return frame.join(told, sid, "left").withColumn("comp", F.coalesce("component", sid)).drop("component")


def _again(docs: DataFrame, sets: DataFrame, parts: DataFrame, k: int, s: Settings) -> DataFrame:
    """links (a, b) between components, found by one set of each that has a smallest token in the k-th order."""
    one = (_component(sets.select("sid", "id", "n", F.col("leads")[k].alias("lead")), parts)
           .groupBy("lead", "comp").agg(F.min(F.struct("sid", "id", "n")).alias("one")).select("lead", "one.*")
           .withColumn("rows", F.lit(1)))
    units = _groups(one, s).filter("rows > 1")
    grouped = _by_group(_some_sets(docs, units.select("sid", "id", "group"), s).select("sid", "tokens", "group"), "group")

    def compare(batches):
        for _, members in _grouped(batches, ("sid", "tokens", "group")):
            ids = np.array([i for i, _ in members])
            root = ids[group_roots([x for _, x in members], s.percent)]
            tied = root != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(root[tied])], names=["a", "b"])

    return stage(grouped.mapInArrow(compare, "a long, b long"))


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """Searched tokens that similar sets of n and m tokens share at least, at the ends of ranges of sizes: what
    they share must be so much, and what the larger one doesn't search holds only so many of it."""
    return (n + m) * percent / (100 + percent) - F.greatest(n, m) * percent / 100


def _pairs(matrix: DataFrame, parts: DataFrame, s: Settings) -> DataFrame:
    """Components (a, b) that share enough searched tokens to hold similar sets."""
    rows = stage(_component(matrix, parts, "root").groupBy("token", "comp")
                 .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("cap").alias("cap")))
    several = (rows.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1")
               .select("token", (F.col("rows") > s.crowded).alias("crowded")))
    live = stage(rows.join(stage(several), "token"))
    many = stage(live.filter("crowded").groupBy("comp").agg(F.count("*").alias("lost")))
    left = (live.join(many, "comp", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
            .withColumn("early", F.col("cap") >= F.col("lo")))
    right = left.filter("early or not crowded").select("token", *[F.col(c).alias(f"{c}2") for c in ("comp", "lo", "hi", "cap", "lost")])
    once = F.when(F.col("crowded") & ~F.col("early"), F.col("comp") != F.col("comp2")).otherwise(F.col("comp") < F.col("comp2"))
    sizes = (F.col("hi2") * 100 >= F.col("lo") * s.percent) & (F.col("hi") * 100 >= F.col("lo2") * s.percent)
    places = ~F.col("crowded") | ((F.col("lo2") <= F.col("cap")) & (F.col("lo") <= F.col("cap2")))
    first = F.col("comp") < F.col("comp2")
    met = left.join(right, "token").filter(once & sizes & places).select(
        F.least("comp", "comp2").alias("a"), F.greatest("comp", "comp2").alias("b"), F.least("lost", "lost2").alias("lost"),
        *[F.when(first, F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}")).alias(f"{c}_{z}")
          for c in ("lo", "hi") for x, y, z in (("", "2", "a"), ("2", "", "b"))])
    found = met.groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.max("lost").alias("lost"), F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"),
        F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b"))
    need = F.least(least_shared(F.col("hi_a"), F.col("lo_b"), s.percent), least_shared(F.col("lo_a"), F.col("hi_b"), s.percent))
    return stage(found.filter(F.col("shared") >= F.floor(need - 1e-6) - F.col("lost")).select("a", "b"))


def _across(docs: DataFrame, sets: DataFrame, groups: DataFrame, matrix: DataFrame, parts: DataFrame, s: Settings) -> DataFrame:
    """links (a, b) between documents of different components."""
    pairs = _pairs(matrix, parts, s)
    told = _component(sets.select("sid", "id", "n"), parts)
    asked = stage(pairs.select(F.col("a").alias("comp")).unionByName(pairs.select(F.col("b").alias("comp"))).distinct())
    some = stage(told.join(asked, "comp", "left_semi"))
    count = stage(some.groupBy("comp").agg(F.count("*").alias("sets")))
    sized = (pairs.join(count.select(F.col("comp").alias("a"), F.col("sets").alias("n_a")), "a")
             .join(count.select(F.col("comp").alias("b"), F.col("sets").alias("n_b")), "b"))
    swap = F.col("n_a") > F.col("n_b")
    wish = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("comp"),
                        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("goal"))
    inside = stage(groups.join(some, "sid").select("group", "comp", "sid", "id", "n"))
    opened = inside.groupBy(F.col("comp").alias("goal"), "group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (F.col("n") * 100 >= F.col("lo") * s.percent) & (F.col("hi") * 100 >= F.col("n") * s.percent)
    ask = stage(wish.join(some, "comp").join(opened, "goal").filter(fits).select("sid", "id", "comp", "goal", "group"))
    # a group that many ask is opened in several tasks, each with some of those who ask
    copies = stage(ask.groupBy("goal", "group").agg(F.ceil(F.count("*") / s.askers).alias("parts")))
    wanted = ask.join(copies, ["goal", "group"]).select(
        "sid", "id", "comp", "goal", "group", F.lit(0).alias("side"), F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part"))
    held = (inside.withColumnRenamed("comp", "goal").join(copies, ["goal", "group"])
            .select("sid", "id", F.col("goal").alias("comp"), "goal", "group", F.lit(1).alias("side"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    rows = _by_group(_some_sets(docs, stage(wanted.unionByName(held)), s), "goal", "group", "part", then=("side",))
    columns = ("goal", "group", "part", "side", "sid", "comp", "tokens")

    def verify(batches):
        def close(goal, held):
            found = asker_links([x[1:] for x in held[0]], [x[2] for x in held[1]], s.percent) if held[0] and held[1] else []
            return pa.RecordBatch.from_arrays([pa.array([held[0][k][0] for k in found], pa.int64()),
                                               pa.array([goal] * len(found), pa.int64())], names=["a", "b"])

        current, held = None, ([], [])
        for b in batches:
            names = {c: i for i, c in enumerate(b.schema.names)}
            for *at, side, sid, comp, tokens in zip(*(b.column(names[c]).to_pylist() for c in columns), strict=True):
                if at != current and current is not None:
                    yield close(current[0], held)
                    held = ([], [])
                current = at
                if not held[side] or held[side][-1][0] != sid:
                    held[side].append((sid, comp, np.frombuffer(tokens, np.uint64)))
        if current is not None:
            yield close(current[0], held)

    return stage(rows.mapInArrow(verify, "a long, b long"))
