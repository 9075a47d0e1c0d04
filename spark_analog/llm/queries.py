"""The operators as named queries on the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_analog.llm import (cnn_toxicity, conversation_trie, deleted_interpolation, grid_order_join, knn_quality,
                              line_dedup, merkle, mixing, packing, quality_rules, token_groups, url_filters, warc)
from spark_analog.llm.common import fold

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_near_dedup")
def op1(spark, sf):
    return grid_order_join.near_duplicates(table(spark, sf, "embeddings"))


@query("op2_best_fit_packing")
def op2(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op3_deleted_interpolation")
def op3(spark, sf):
    taught = fold("doc_id", 10) != 0
    held = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/weights"))
                   .cast("binary")) % 10 == 0
    scored = deleted_interpolation.score(table(spark, sf, "documents"), taught, held)
    return scored.withColumn("held_out", fold("doc_id", 10) == 0)


@query("op4_quality_knn")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    model = knn_quality.fit(docs, table(spark, sf, "labels"))
    scored, at = knn_quality.classify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), f"{at}.score",
                         f"{at}.predicted")


@query("op5_jaccard_join")
def op5(spark, sf):
    return token_groups.duplicates(table(spark, sf, "documents"))


@query("op6_toxicity_cnn")
def op6(spark, sf):
    docs = table(spark, sf, "documents")
    net = cnn_toxicity.fit(docs, table(spark, sf, "labels"))
    scored, at = cnn_toxicity.classify(docs, net, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), f"{at}.score",
                         f"{at}.predicted", f"{at}.language")


#: Largest page id per payload; digests by DuckDB's own SHA-1.
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p),
t as (select payload_digest, max(page_id) as first, count(*) as n from d
      where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest,
       case when t.n > 1 and t.first <> page_id then 'revisit' else 'response' end as record_type,
       case when t.n > 1 and t.first <> page_id then t.first end as refers_to
from d left join t on d.payload_digest = t.payload_digest
"""


@query("op7_warc_round_trip", WARC_SQL)
def op7(spark, sf):
    found = warc.round_trip(table(spark, sf, "pages"))
    return found.select(F.expr("try_cast(page as bigint)").alias("page_id"), "payload_bytes",
                        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
                        F.expr("try_cast(refers as bigint)").alias("refers_to"))


@query("op8_url_filters", url_filters.SQL)
def op8(spark, sf):
    rules = spark.createDataFrame(list(url_filters.RULES), "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf, "pages"), rules)


@query("op9_quality_rules")
def op9(spark, sf):
    judged, at = quality_rules.clean(table(spark, sf, "documents"), keep=["doc_id"], with_text=False)
    return judged.select("doc_id", *[f"{at}.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_bad_lines", "n_lost_words", "kept")])


@query("op10_mixing", mixing.SQL)
def op10(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def crc_sql(column: str, source: str) -> str:
    """Table crcs (id, crc) of the unsigned CRC-32 of every id as text: byte by byte with the table of the checksum."""
    return f"""bits as (select i, i::bigint as v, 0 as k from range(256) t(i)
    union all select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
lookup as materialized (select list(v order by i) as crc from bits where k = 8),
walk as (select id, id::varchar as said, 4294967295::bigint as v, 0 as k
        from (select distinct {column} as id from {source} where {column} is not null)
    union all select id, said, xor(v // 256, crc[xor(v % 256, ascii(said[k + 1])) + 1]), k + 1
        from walk, lookup where k < length(said)),
crcs as materialized (select id, xor(v, 4294967295) as crc from walk where k = length(said))"""


#: Levels of a source's tree and of the tree over sources that the SQL spells out (16 ** 6 and 16 ** 4 nodes).
MERKLE_LEVELS, MERKLE_TOP_LEVELS = 6, 4


def _merkle_sql() -> str:
    """Levels one by one: runs of 16 by string_agg, siblings by a join of a level with itself."""
    def said(c):
        return f"coalesce(strlen({c}::varchar) || ':' || ({c}::varchar), '-')"

    fields = ("doc_id", "source", "lang", "n_chars", "text")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = []
    whole = " || ".join(said(c) for c in fields)
    bent = " || ".join([*[said(c) for c in fields[:-1]], said(f"translate(text, '{upper}', '{lower}')")])
    steps.append(crc_sql("doc_id", "documents"))
    steps.append("picked as materialized (select id from crcs where crc % 5 = 0)")
    steps.append(f"""doc as materialized (select doc_id, source as tree, sha256({whole}) as h,
        case when doc_id in (select id from picked) then sha256({bent}) else sha256({whole}) end as bent from documents)""")
    steps.append("""a0 as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as r,
        count(*) over (partition by tree) as n from doc)""")

    def level(name, k, last):
        here, above = f"{name}{k}", f"{name}{k + 1}"
        steps.append(f"""{here}_way as materialized (select x.tree, x.r, any_value(x.n) as n,
            coalesce(string_agg(y.h, '' order by y.r) filter (where y.r < x.r), '') as before,
            coalesce(string_agg(y.h, '' order by y.r) filter (where y.r > x.r), '') as after
            from {here} x join {here} y on x.tree is not distinct from y.tree and x.r // 16 = y.r // 16
            group by x.tree, x.r)""")
        if not last:
            steps.append(f"""{above} as materialized (select tree, r // 16 as r, (n + 15) // 16 as n,
                case when n > 1 then sha256(string_agg(h, '' order by r)) else min(h) end as h from {here}
                group by tree, r // 16, n)""")

    for k in range(MERKLE_LEVELS):
        level("a", k, False)
    steps.append(f"""b0 as materialized (select 0 as tree, tree as source, h,
        row_number() over (order by tree nulls first) - 1 as r, count(*) over () as n from a{MERKLE_LEVELS})""")
    for k in range(MERKLE_TOP_LEVELS):
        level("b", k, False)
    steps.append("""f0 as (select a0.doc_id, a0.tree, a0.h as leaf, a0.r, b0.r as top, b0.h as subroot, a0.bent as folded, '' as proof
        from a0 join b0 on a0.tree is not distinct from b0.source)""")
    done = 0
    for name, levels, place, tree in (("a", MERKLE_LEVELS, "r", "f.tree"), ("b", MERKLE_TOP_LEVELS, "top", "0")):
        for k in range(levels):
            steps.append(f"""f{done + 1} as (select f.* replace (
                case when w.n > 1 then sha256(w.before || f.folded || w.after) else f.folded end as folded,
                f.proof || w.before || w.after as proof)
                from f{done} f join {name}{k}_way w on w.tree is not distinct from {tree} and w.r = f.{place} // {16 ** k})""")
            done += 1
    return "with recursive " + ",\n".join(steps) + f"""
select doc_id, leaf, subroot, (select h from b{MERKLE_TOP_LEVELS}) as root, sha256(proof) as proof_sha256,
       folded as folded_root, folded = (select h from b{MERKLE_TOP_LEVELS}) as verified from f{done}"""


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark, sf):
    docs = table(spark, sf, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf([*[F.col(c) for c in fields[:-1]], lowered])
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(docs, "source", "doc_id", fields,
                           {"doc_id": F.col("doc_id"), "tampered": F.when(picked, tampered)})
    folded = merkle.fold(F.coalesce("kept.tampered", "leaf"), F.col("way"))
    return made.select("kept.doc_id", "leaf", "subroot", "root",
                       merkle.digest(merkle.proof_text(F.col("way"))).alias("proof_sha256"),
                       folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


LINES_SQL = r"""
with lines as (select doc_id, pos, unnest(parts) as line, unnest(range(len(parts))) as i
    from (select doc_id, row_number() over () as pos, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
heavy as (select key, max(doc_id) as keeper from keyed where length(key) >= 20
          group by key having count(distinct coalesce(doc_id::varchar, 'none')) >= 3),
judged as (select k.doc_id, pos, line, i, h.key is not null and k.doc_id is distinct from keeper as gone
           from keyed k left join heavy h on k.key = h.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id, pos
"""


@query("op12_line_dedup", LINES_SQL)
def op12(spark, sf):
    cleaned, at = line_dedup.clean(table(spark, sf, "documents"), keep=["doc_id"])
    return cleaned.select("doc_id", f"{at}.n_lines", f"{at}.n_dropped",
                          F.sha2(F.col(f"{at}.text").cast("binary"), 256).alias("kept_sha256"))


TRIE_SQL = "with recursive " + crc_sql("conv_id", "conversations") + r""",
convs as materialized (select id as c, id - id % 20 as base, crc % 4 as h from crcs),
said as (select conv_id as c, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as body,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as words from conversations where conv_id is not null),
own as materialized (select *, row_number() over (partition by c order by turn nulls first, md5(body)) - 1 as r from said),
led as (select convs.c, o.r as pos, o.body, o.words from convs join own o on o.c = convs.base and o.r < convs.h),
turns as materialized (select * from led union all
    select o.c, o.r - convs.h + (select count(*) from led where led.c = o.c), o.body, o.words
    from own o join convs on o.c = convs.c where o.r >= convs.h),
paths as materialized (select c, pos + 1 as d, words,
    md5(string_agg(md5(body), '' order by pos) over (partition by c order by pos)) as key from turns
    union all select c, 0, 0, '' from convs),
last as (select c, max(d) as d from paths group by c),
nodes as materialized (select p.d, p.key, min(p.c) as conv_id, count(*) as n_convs, min(p.words) as words,
    coalesce(string_agg(p.c::varchar, ',' order by p.c) filter (p.d = last.d), '') as ended
    from paths p join last on p.c = last.c group by p.d, p.key),
links as materialized (select distinct x.d, x.key, y.key as parent from paths x join paths y on x.c = y.c and y.d = x.d - 1),
kids as materialized (select d - 1 as d, parent as key, count(*) as n from links group by all),
above as (select n.n_convs, n.words, k.n is null as leaf, p.d, p.key
    from nodes n join paths p on p.c = n.conv_id and p.d <= n.d left join kids k on k.d = n.d and k.key = n.key),
sums as (select d, key, count(*) filter (leaf) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens
    from above group by d, key)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0)::bigint as n_children,
       n_leaves, saved_tokens, sha256(n.ended) as ends_sha256
from nodes n join sums s on s.d = n.d and s.key = n.key left join kids k on k.d = n.d and k.key = n.key
     left join links l on l.d = n.d and l.key = n.key left join nodes u on u.d = n.d - 1 and u.key = l.parent
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark, sf):
    numbered = conversation_trie.number_turns(table(spark, sf, "conversations"))
    return conversation_trie.trie(*conversation_trie.with_openings(*numbered))
