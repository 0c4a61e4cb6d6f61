"""Queries that exercise the operators on tables of the same shape, with equivalent SQL where there is such."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cigar, sequence
from ..kernels import align, placement, poa, splitting, variants
from ..operators import absent, chain, clips, folds, genotype, relational
from ..session import shared_root
from ..sources import bam, reports, sequences, strings_text
from . import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts") -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("""
select event_id, user_id, event_type from (
  select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
where before is distinct from event_type or before is null""")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return relational.consecutive_dedup(events, ["user_id"], ["ts", "event_id"], ["event_type"]).drop("ts")


@query("""
select event_id, user_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls)
  over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as purchase_id
from events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("p"))
    return relational.forward_fill(events, ["user_id"], ["ts", "event_id"], "p", "purchase_id").select("event_id", "user_id", "purchase_id")


@query("""
select c.event_id, c.user_id, (select min(p.event_id) from events p where p.user_id = c.user_id and p.event_type = 'purchase'
    and p.ts = (select min(q.ts) from events q where q.user_id = c.user_id and q.event_type = 'purchase' and q.ts > c.ts)) as next_purchase
from events c where c.event_type = 'click'""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").drop("event_type")
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return relational.asof_forward(clicks, purchases, ["user_id"], "ts", ["purchase"]).select("event_id", "user_id", "next_purchase")


CIGAR_SQL = """
with o as (select l_orderkey, l_linenumber, cast(l_quantity as integer) as len,
    case l_linenumber % 4 when 0 then 'M' when 1 then 'I' when 2 then 'D' else 'S' end as op,
    row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as k from lineitem),
w as (select *, cast(coalesce(sum(case when op in ('M','I','S') then len else 0 end) over p, 0) as bigint) as q,
    cast(coalesce(sum(case when op in ('M','D') then len else 0 end) over p, 0) as bigint) as r
  from o window p as (partition by l_orderkey order by k rows between unbounded preceding and 1 preceding))
"""


def _order_cigars(spark: SparkSession, sf_dir: str, letters: str = "MIDS") -> DataFrame:
    """An alignment for each order: lines are operations in order of line number and length."""
    op = F.element_at(F.array(*map(F.lit, letters)), (F.col("l_linenumber") % len(letters) + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("len"), op.alias("op")).alias("line"))
    ops = F.transform(F.array_sort(F.collect_list("line")), lambda x: F.struct(x["len"].alias("len"), x["op"].alias("op")))
    return lines.groupBy("l_orderkey").agg(ops.alias("ops"))


VARIANT_OPS = "(array['M','I','D'])[l_linenumber % 3 + 1]"


@query(f"""
with o as (select l_orderkey, cast(l_quantity as integer) as n, {VARIANT_OPS} as op, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as k from lineitem),
w as (select *, cast(5 + coalesce(sum(case when op <> 'I' then n else 0 end) over p, 0) as integer) as r, cast(coalesce(sum(case when op <> 'D' then n else 0 end) over p, 0) as integer) as c
  from o window p as (partition by l_orderkey order by k rows between unbounded preceding and 1 preceding)),
t as (select *, substr(repeat('TGCA', 500), r - 4, 1) as anchor from w where op <> 'M' and n >= 25)
select l_orderkey, case op when 'I' then 'INS' else 'DEL' end as kind, r as s, case op when 'I' then anchor else anchor || substr(repeat('TGCA', 500), r - 3, n) end as ref,
  case op when 'I' then anchor || substr(repeat('ACGT', 500), c + 1, n) else anchor end as alt, n as l from t""")
def cigar_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment for each order, and what its gaps are as variants."""
    ref, consensus = "TGCA" * 500, "ACGT" * 500

    def found(order: int, ops: list) -> list[tuple]:
        return [(order, *v) for v in variants.variants_of([(o["len"], o["op"]) for o in ops], 5, ref, 4, consensus, 25)]

    return stages.map_rows(_order_cigars(spark, sf_dir, "MID"), ["l_orderkey", "ops"], found, "l_orderkey long, kind string, s int, ref string, alt string, l int")


@query(CIGAR_SQL + """, m as (select *, count(*) over (partition by l_orderkey) as n, case when op = lag(op) over (partition by l_orderkey order by k) then 0 else 1 end as fresh from w),
g as (select *, sum(fresh) over (partition by l_orderkey order by k) as run from m),
merged as (select l_orderkey, string_agg(len || op, '' order by run) as merged from (select l_orderkey, run, any_value(op) as op, sum(len) as len from g group by 1, 2) group by 1),
clipped as (select l_orderkey, coalesce(string_agg(case when k not in (1, n) then len || op when op = 'D' then null when op = 'I' then len || 'S' else len || op end, '' order by k), '*') as clipped from m group by 1)
select l_orderkey, string_agg(len || op, '' order by k) as cigar, cast(sum((op in ('I','D'))::int) as integer) as gaps,
  cast(sum(case when op in ('M','I','S') then len else 0 end) as integer) as read_length, cast(sum(case when op in ('M','D') then len else 0 end) as integer) as ref_length, any_value(merged) as merged, any_value(clipped) as clipped
from w join merged using (l_orderkey) join clipped using (l_orderkey) group by 1""")
def cigar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _order_cigars(spark, sf_dir).select("l_orderkey", cigar.cigar_string(F.col("ops")).alias("cigar"))
    ops = cigar.decode_cigar(cigar.encode_cigar(cigar.parse_cigar(F.col("cigar"))))
    parsed = text.select("l_orderkey", "cigar", ops.alias("ops"))
    parsed = parsed.select("*", cigar.merge_runs("ops").alias("merged"))
    return parsed.select(
        "l_orderkey", "cigar", cigar.gap_count(F.col("ops")).alias("gaps"), cigar.read_length(F.col("ops")).alias("read_length"), cigar.reference_length(F.col("ops")).alias("ref_length"),
        cigar.cigar_string(F.col("merged")).alias("merged"), cigar.cigar_string(cigar.fix_clips(F.col("ops"))).alias("clipped"),
    )


@query(CIGAR_SQL + """, e as (select l_orderkey, op, q, r, unnest(range(len)) as i from w)
select l_orderkey, cast(count(*) as bigint) as pairs, cast(count(*) filter (op = 'M') as bigint) as placed,
  cast(max(case when op = 'M' then q + i end) as integer) as last_q, cast(max(case when op = 'M' then r + i end) as integer) as last_r,
  cast(sum(case when op in ('M','I','S') then q + i else 0 end) as bigint) as sum_q, cast(sum(case when op in ('M','D') then r + i else 0 end) as bigint) as sum_r
from e group by 1""")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _order_cigars(spark, sf_dir).select("l_orderkey", F.explode(cigar.aligned_pairs(F.col("ops"), F.lit(0))).alias("p"))
    both = F.col("p.q").isNotNull() & F.col("p.r").isNotNull()
    return pairs.groupBy("l_orderkey").agg(
        F.count("*").alias("pairs"), F.count(F.when(both, 1)).alias("placed"), F.max(F.when(both, F.col("p.q"))).alias("last_q"), F.max(F.when(both, F.col("p.r"))).alias("last_r"),
        F.coalesce(F.sum("p.q"), F.lit(0)).alias("sum_q"), F.coalesce(F.sum("p.r"), F.lit(0)).alias("sum_r"),
    )


@query("""
with r as (select event_id as ord, 'r' || event_id as qname, 'u' || (user_id % 20) as chrom, cast(event_id % 2000 as integer) as pos, substr(repeat('ACGTTGCA', 10), 1 + event_id % 8, 45) as seq, event_id % 3 as hp, event_type,
  case when event_id % 17 = 0 then 256 else 0 end as flag, 10 + event_id % 40 as mapq from events),
c as (select chrom, pos // 50 as b, cast((pos // 50) * 50 + 10 as integer) as s, cast((pos // 50) * 50 + 18 as integer) as e, list(distinct qname) as names from r where event_type = 'purchase' group by all),
h as (select c.chrom || ':' || b as cluster_id, s, e, ord, pos, qname, hp, list_contains(names, qname) as mine, seq from c join r on r.chrom = c.chrom and r.pos <= e - 1 and s - 1 <= r.pos + 44 where flag & 2308 = 0 and mapq >= 20),
p as (select *, case when mine and pos <= s and pos + 44 >= e then substr(seq, s - pos + 1, e - s + 1) end as sub from h)
select cluster_id, s, e, cast(count(*) filter (hp = 0) as integer) as cov0, cast(count(*) filter (hp = 1) as integer) as cov1, cast(count(*) filter (hp = 2) as integer) as cov2, cast(count(*) as integer) as cov,
  string_agg((case when mine then '1' else '0' end) || ':' || (case when hp = 0 then 3 else hp end), '-' order by pos, ord) as rvec, string_agg(qname || ':' || sub, ',' order by pos, ord) as subreads
from p group by all having count(sub) >= 2""")
def haplotype_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters filled: events are reads of 45 bases, clusters the purchases of a bin, which their alignments overlap."""
    place = (F.col("event_id") % 2000).cast("int")
    reads = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("r"), "event_id").alias("qname"), F.when(F.col("event_id") % 17 == 0, 256).otherwise(0).alias("flag"),
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("chrom"), place.alias("pos"), (10 + F.col("event_id") % 40).cast("int").alias("mapq"), F.lit("45M").alias("cigar"),
        F.substring(F.repeat(F.lit("ACGTTGCA"), 10), (1 + F.col("event_id") % 8).cast("int"), F.lit(45)).alias("seq"), F.nullif((F.col("event_id") % 3).cast("int"), F.lit(0)).alias("hp"), "event_type",
    )
    b = F.floor(F.col("pos") / 50).cast("int")
    clusters = reads.where("event_type = 'purchase'").groupBy("chrom", b.alias("b")).agg(F.collect_set("qname").alias("names"))
    clusters = clusters.select(F.concat_ws(":", "chrom", F.col("b").cast("string")).alias("cluster_id"), "chrom", (F.col("b") * 50 + 10).alias("s"), (F.col("b") * 50 + 18).alias("e"), "names")
    filled = stages.fill(clusters, reads, width=64)
    return filled.select(
        "cluster_id", "s", "e", "cov0", "cov1", "cov2", "cov", F.array_join(F.transform("rvec", lambda v: F.concat_ws(":", v["has_sfs"], v["hp"])), "-").alias("rvec"),
        F.array_join(F.transform("subreads", lambda x: F.concat_ws(":", x["name"], x["seq"])), ",").alias("subreads"),
    )



def _overlaps(lines: DataFrame) -> DataFrame:
    """Pairs of returned and accepted lines of a supplier whose spans of parts overlap."""
    end = F.col("l_partkey") + F.col("l_quantity").cast("long")
    a = lines.where("l_returnflag = 'R'").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("s"), end.alias("e"))
    b = lines.where("l_returnflag = 'A'").select("l_suppkey", F.col("l_orderkey").alias("other_order"), F.col("l_partkey").alias("other_s"), end.alias("other_e"))
    pairs = relational.interval_join(a, b, ["l_suppkey"], ("s", "e"), ("other_s", "other_e"), width=64)
    return pairs.select("l_suppkey", "l_orderkey", "l_linenumber", "other_order", (F.least("e", "other_e") - F.greatest("s", "other_s")).alias("overlap"))


@query("""
select a.l_suppkey, a.l_orderkey, a.l_linenumber, b.l_orderkey as other_order, cast(least(a.l_partkey + cast(a.l_quantity as bigint), b.l_partkey + cast(b.l_quantity as bigint)) - greatest(a.l_partkey, b.l_partkey) as bigint) as overlap
from lineitem a join lineitem b on a.l_suppkey = b.l_suppkey and a.l_partkey <= b.l_partkey + cast(b.l_quantity as bigint) and b.l_partkey <= a.l_partkey + cast(a.l_quantity as bigint)
where a.l_returnflag = 'R' and b.l_returnflag = 'A'""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(table(spark, sf_dir, "lineitem"))


GROUPS_SQL = """
with recursive n as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as integer) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_partkey) as k from lineitem),
f as (select l_orderkey, k, [{'total': n::bigint, 'count': 1::bigint}] as groups, 0::bigint as sub_id from n where k = 1
  union all select n.l_orderkey, n.k,
    case when g.at is null or g.at = 0 then list_append(groups, {'total': n.n::bigint, 'count': 1::bigint}) else list_transform(groups, lambda x, i: case when i = g.at then {'total': x.total + n.n, 'count': x.count + 1} else x end) end,
    case when g.at is null or g.at = 0 then len(groups) else g.at - 1 end
  from f join n on n.l_orderkey = f.l_orderkey and n.k = f.k + 1,
    lateral (select list_position(list_transform(f.groups, lambda x: x.total // x.count = n.n or least(x.total // x.count, n.n)::double / greatest(x.total // x.count, n.n) >= 0.97), true) as at) g)
"""


@query(GROUPS_SQL + """, c as (select l_orderkey, sub_id, count(*) as reads, sum(n) as total from f join n using (l_orderkey, k) group by 1, 2)
select l_orderkey, cast(rank - 1 as integer) as sub_id, cast(reads as integer) as reads, cast(total as integer) as total from (select *, row_number() over (partition by l_orderkey order by reads desc, sub_id) as rank from c) where rank <= 2""")
def top2_subclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-clusters of an order's lines, taken for reads without haplotypes."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("n"), "l_partkey"))).alias("lines"))

    def found(order: int, rows: list) -> list[tuple]:
        sizes = [x["n"] for x in rows]
        return [(order, k, len(members), sum(sizes[i] for i in members)) for k, (members, _) in enumerate(splitting.split(sizes, [0] * len(sizes)))]

    return stages.map_rows(lines, ["l_orderkey", "lines"], found, "l_orderkey long, sub_id int, reads int, total int")


@query("""
select l_orderkey, l_suppkey, n, cast(rank as integer) as rank from (select *, row_number() over (partition by l_orderkey order by n desc, l_suppkey) as rank
  from (select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2)) where rank <= 2""")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    return relational.top_k(counts, ["l_orderkey"], [F.desc("n"), "l_suppkey"], 2)


@query("""
with k as (select item_id, cast(i - 1 as integer) as i, substr(text, cast(i as bigint), 7) as kmer from (select item_id, text, unnest(range(1, greatest(length(text) - 5, 1))) as i from benchmark) where length(text) >= 7),
n as (select *, count(*) over (partition by item_id, kmer) as n from k)
select item_id, coalesce(max(i) filter (n = 1), min(i)) as before, coalesce(min(i) filter (n = 1), max(i)) as after from n group by 1""")
def unique_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of strings before and after which a whole text is placed without gaps."""

    def found(item: int, text: str) -> list[tuple]:
        pairs = [(i, i) for i in range(len(text))]
        before, after = (placement.unique_anchor(pairs, 7, last, text, 0) for last in (True, False))
        return [(item, before[1], after[1])] if before else []

    return stages.map_rows(table(spark, sf_dir, "benchmark").where("text is not null"), ["item_id", "text"], found, "item_id long, before int, after int")


@query("""
with k as (select substr(text, cast(i as bigint), 7) as kmer from (select text, unnest(range(1, greatest(length(text) - 5, 1))) as i from benchmark))
select kmer from k group by 1 having count(*) = 1""")
def kmers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select(F.explode(sequence.kmers(F.col("text"), 7)).alias("kmer"))
    return found.groupBy("kmer").agg(F.count("*").alias("n")).where("n = 1").select("kmer")


def _clips(spark: SparkSession, sf_dir: str, users: int, place: F.Column) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), F.col("event_id") % 5000).alias("name"), F.concat(F.lit("u"), F.col("user_id") % users).alias("chrom"), place.cast("int").alias("p"),
        (F.col("event_id") % 1000).cast("int").alias("l"), (F.col("event_type") < "d").alias("starting"),
    )


def _contigs(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("u"), "id").alias("chrom"))


CLIPS_SQL = """
clips as (select 'r' || (event_id % 5000) as name, 'u' || (user_id % {users}) as chrom, cast({place} as integer) as p, cast(event_id % 1000 as integer) as l, event_type < 'd' as starting from events),
once as (select * from clips qualify row_number() over (partition by name, starting order by chrom, p, l) = 1),
combined as (select chrom, p, starting, max(l) as l, count(*) as w from once where cast(substr(chrom, 2) as integer) < {contigs} group by 1, 2, 3 having count(*) >= 2)"""


@query("with " + CLIPS_SQL.format(users=50, place="event_id % 97", contigs=40) + " select * from combined")
def clip_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.combine_clips(_clips(spark, sf_dir, 50, F.col("event_id") % 97), _contigs(spark, 40))


IMPRECISE_PLACE = "((event_id * 37) % 61) * 700 + event_id % 2"


@query("with recursive " + CLIPS_SQL.format(users=4, place=IMPRECISE_PLACE, contigs=3) + """,
svs as (select 'u' || (p_partkey % 3) as chrom, cast(p_partkey * 450 as integer) as s, cast(p_partkey * 450 + p_size as integer) as e from part where p_size < 12),
far as (select * from combined c where not exists (select 1 from svs v where v.chrom = c.chrom and c.p between v.s - 1000 and v.e + 1000)),
n as (select *, row_number() over (partition by chrom, starting order by p) as k from far),
f as (select chrom, starting, k, p as centre, p, l, w from n where k = 1
  union all select n.chrom, n.starting, n.k, case when n.p - f.centre <= 1000 then f.centre else n.p end, n.p, n.l, n.w from f join n on n.chrom = f.chrom and n.starting = f.starting and n.k = f.k + 1),
centres as (select chrom, starting, centre as p, max(l) as l, cast(sum(w) as bigint) as w from f group by 1, 2, 3),
near as (select a.chrom, a.starting, a.p, a.l, a.w, b.p as next_p, b.l as next_l, b.w as next_w from centres a join centres b on b.chrom = a.chrom and b.starting <> a.starting and b.p > a.p
  qualify row_number() over (partition by a.chrom, a.starting, a.p order by b.p) = 1)
select chrom, case when w > next_w then p else next_p end as s, case when w > next_w then p else next_p end as e, 'INS' as kind, greatest(l, next_l) as l, greatest(w, next_w) as w from near where starting and next_p - p < 1000
union all select chrom, p, next_p, 'DEL', next_p - p + 1, greatest(w, next_w) from near where not starting and next_p - p between 2000 and 50000 and greatest(w, next_w) >= 5""")
def imprecise_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    svs = table(spark, sf_dir, "part").where("p_size < 12").select(F.concat(F.lit("u"), F.col("p_partkey") % 3).alias("chrom"), (F.col("p_partkey") * 450).cast("int").alias("s"), (F.col("p_partkey") * 450 + F.col("p_size")).cast("int").alias("e"))
    return clips.imprecise_variants(_clips(spark, sf_dir, 4, F.expr(IMPRECISE_PLACE)), _contigs(spark, 3), svs)


@query("""
select o_orderkey, o_totalprice from orders where not exists (select 1 from part where o_totalprice / 100 between p_retailprice - 1 and p_retailprice + 1)""")
def range_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 100).alias("p"))
    spans = table(spark, sf_dir, "part").select((F.col("p_retailprice") - 1).alias("lo"), (F.col("p_retailprice") + 1).alias("hi")).distinct()
    return relational.interval_anti_join(orders, spans, [], "p", ("lo", "hi"), width=16.0).drop("p")


def minimal_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest strings of whole documents that no benchmark text holds: no SQL, for that would be quadratic."""
    return absent.specific_strings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], "text", "text")


QUERIES["minimal_absent"] = minimal_absent


ABSENT_SQL = """
with refs as (select '$' || string_agg(distinct p_name, '$') || '$' as r from part where p_size > 25),
reads as (select p_partkey, p_name || ' ' || lower(p_type) as t from part),
subs as (select p_partkey, t, b, unnest(range(1, length(t) - b + 1)) as l from (select p_partkey, t, unnest(range(length(t))) as b from reads)),
gone as (select p_partkey, b, min(l) as l from subs, refs where not contains(r, substr(t, b + 1, l)) group by 1, 2),
strings as (select p_partkey, b as qs, l from gone qualify coalesce(b + l < lead(b + l) over (partition by p_partkey order by b), true))
"""


def _part_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    reads = parts.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("t"))
    return absent.specific_strings(reads, parts.where("p_size > 25"), ["p_partkey"], "t", "p_name")


@query(ABSENT_SQL + "select p_partkey, qs, l from strings")
def minimal_absent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_strings(spark, sf_dir)


@query(ABSENT_SQL + """, b as (select *, max(qs + l) over (partition by p_partkey order by qs, l rows between unbounded preceding and 1 preceding) as reach from strings),
i as (select *, sum(case when reach <= qs then 1 else 0 end) over (partition by p_partkey order by qs, l rows unbounded preceding) as island from b)
select p_partkey, min(qs) as qs, max(qs + l) - min(qs) as l from i group by p_partkey, island""")
def assembled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absent.assemble(_part_strings(spark, sf_dir), ["p_partkey"])


def assembled_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole documents, as minimal_absent: no SQL."""
    return absent.assemble(minimal_absent(spark, sf_dir), ["doc_id"])


QUERIES["assembled_strings"] = assembled_strings


def _genotype_sql(logs: bool) -> str:
    def likelihood(g: str) -> str:
        parts = []
        for h, a in enumerate(g, 1):
            parts.append(f"(case when s = 1 then {genotype.READ_GIVEN_ALLELE[1, int(a)]}::double else {genotype.READ_GIVEN_ALLELE[0, int(a)]}::double end) * (case when hap = 3 then 0.5::double when hap = {h} then 0.95::double else 0.05::double end)")
        return " + ".join(parts)

    sums = ", ".join(f"sum({f'ln({likelihood(g)})' if logs else likelihood(g)}) + ln({p}::double) as s{g}" for g, p in genotype.PRIOR.items())
    total = " + ".join(f"exp(s{g} - m)" for g in genotype.PRIOR)
    return f"""with r as (select user_id, (event_type = 'purchase')::int as s, case when event_id % 3 = 0 then 3 else event_id % 3 end as hap from events),
t as (select user_id, {sums} from r group by 1), u as (select *, greatest({", ".join("s" + g for g in genotype.PRIOR)}) as m from t)
select user_id, {", ".join(f"round(exp(s{g} - m) / ({total}), 6) as p{g}" for g in genotype.PRIOR)} from u"""


def _posteriors(spark: SparkSession, sf_dir: str, logs: bool) -> DataFrame:
    hap = F.when(F.col("event_id") % 3 == 0, 3).otherwise(F.col("event_id") % 3)
    reads = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("support"), hap.alias("hap"))
    found = genotype.posteriors(reads, ["user_id"], sum_of_logs=logs)
    return found.select("user_id", *(F.round(f"p{g}", 6).alias(f"p{g}") for g in genotype.GENOTYPES))


@query(_genotype_sql(False))
def genotype_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the formula that sums likelihoods in place of their logs."""
    return _posteriors(spark, sf_dir, False)


@query(_genotype_sql(True))
def genotype_posterior_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posteriors(spark, sf_dir, True)


@query("""
with recursive x as (select user_id, event_id, cast(floor(epoch_us(ts) / 60000000) as bigint) as s, cast(floor(epoch_us(ts) / 60000000) + floor(value * 10) as bigint) as e from events),
d as (select cast(floor(1.1::double * max(e - s)) as bigint) as dist from x),
n as (select x.*, d.dist, row_number() over (partition by user_id order by s, e, event_id) as k from x, d),
f as (select user_id, event_id, k, s, dist, e as anchor, cast(0 as bigint) as win from n where k = 1
  union all select n.user_id, n.event_id, n.k, n.s, n.dist, case when n.s - f.anchor > n.dist then n.e else f.anchor end, f.win + (n.s - f.anchor > n.dist)::bigint
  from f join n on n.user_id = f.user_id and n.k = f.k + 1)
select user_id, event_id, win as "window" from f""")
def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(micros() / 60_000_000)
    spans = table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("s"), (s + F.floor(F.col("value") * 10)).alias("e"))
    distance = spans.agg(F.floor(F.max(F.col("e") - F.col("s")) * F.lit(1.1)).alias("dist"))
    rows = spans.crossJoin(F.broadcast(distance))  # one row
    return folds.anchored_windows(rows, ["user_id"], "s", "e", ["s", "e", "event_id"], "dist").select("user_id", "event_id", "window")


@query("""
with x as (select l_suppkey, l_partkey as s, l_partkey + cast(l_quantity as bigint) as e from lineitem),
b as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
i as (select *, sum(case when s > reach then 1 else 0 end) over (partition by l_suppkey order by s, e rows unbounded preceding) as island from b)
select l_suppkey, min(s) as s, max(e) as e, cast(count(*) as bigint) as n from i group by l_suppkey, island""")
def overlap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    return relational.merge_islands(spans, ["l_suppkey"], "s", "e").select("l_suppkey", "s", "e", "n")


@query("select round(quantile_cont(l_extendedprice, 0.98), 6) as threshold from lineitem")
def accuracy_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.percentile("l_extendedprice", 0.98), 6).alias("threshold"))


@query("""
with o as (select l_orderkey, cast(l_quantity as integer) as n, l_returnflag = 'R' as bad, (array['M','I','D','S'])[l_linenumber % 4 + 1] as op, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_returnflag) as k from lineitem),
m as (select l_orderkey, sum(case when op = 'M' and not bad then n else 0 end) as same, sum(case when op = 'M' and bad then n else 0 end) as other, bool_or(op = 'S' or (op in ('I', 'D') and n > 20)) as long,
  string_agg(n || op, '' order by k) as cigar, coalesce(string_agg(repeat(case op when 'M' then 'A' when 'I' then 'G' else 'T' end, n), '' order by k) filter (op <> 'D'), '') as seq from o group by 1),
r as (select *, case when same > 0 then other / same::double when other > 0 then 'infinity'::double end as ratio from m where length(seq) >= 2),
t as (select quantile_cont(ratio, 0.5) as threshold from r where ratio is not null),
x as (select *, case when ratio > threshold then 1 when not long then 2 else 0 end as xf from r, t),
kept as (select l_orderkey, k, n, case when op = 'D' and n <= 20 then 'M' else op end as op, case when op = 'S' then 'T' when op = 'I' then 'G' when op = 'D' and n > 20 then '' when bad then 'C' else 'A' end as letter from o where not (op = 'I' and n <= 20)),
runs as (select *, sum(fresh) over (partition by l_orderkey order by k) as run from (select *, case when op = 'M' and lag(op) over (partition by l_orderkey order by k) = 'M' then 0 else 1 end as fresh from kept)),
merged as (select l_orderkey, string_agg(n || op, '' order by run) as cigar from (select l_orderkey, run, any_value(op) as op, sum(n) as n from runs group by 1, 2) group by 1),
bases as (select l_orderkey, string_agg(repeat(letter, n), '' order by k) as seq from kept group by 1)
select l_orderkey, cast(xf as integer) as xf, case when xf = 0 then coalesce(merged.cigar, '*') else x.cigar end as cigar, md5(case when xf = 0 then coalesce(bases.seq, '') else x.seq end) as seq
from x left join merged using (l_orderkey) left join bases using (l_orderkey)""")
def read_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders smoothed as alignments: lines are operations, those of returned lines mismatches."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("n"), "l_returnflag").alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def written(value: Callable[[F.Column, F.Column], F.Column]) -> F.Column:
        op = lambda x: F.element_at(F.array(*map(F.lit, "MIDS")), (x["l_linenumber"] % 4 + 1).cast("int"))
        return F.array_join(F.transform("lines", lambda x: value(x, op(x))), "")

    rows = lines.select(
        F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("qname"), F.lit(0).alias("flag"), F.lit("c").alias("chrom"), F.lit(0).alias("pos"), F.lit(60).alias("mapq"),
        written(lambda x, op: F.concat(x["n"].cast("string"), op)).alias("cigar"),
        written(lambda x, op: F.repeat(F.when(op == "M", "A").when(op == "I", "G").when(op == "S", "T").otherwise(""), x["n"])).alias("seq"),
        F.lit(None).cast("binary").alias("qual"), F.lit(None).cast("int").alias("hp"),
        written(lambda x, op: F.repeat(F.when(~op.isin("M", "D"), "").when(x["l_returnflag"] == "R", "C").otherwise("A"), x["n"])).alias("ref"),
    ).where(F.length("seq") >= 2)
    config = Config(accuracy_quantile=0.5)
    smoothed = stages.smooth_rows(rows.crossJoin(F.broadcast(stages.ratio_threshold(rows, config))), config)  # one row
    return smoothed.select(F.col("ord").alias("l_orderkey"), "xf", "cigar", F.md5("seq").alias("seq"))



@query("""
select o_orderkey, cast(o_orderkey % 60 as integer) as mapq, strings from orders join (select l_orderkey, string_agg(l_linenumber || ':' || l_quantity::integer, ',' order by l_linenumber, l_quantity::integer) as strings
  from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey where (case o_orderstatus when 'F' then 4 when 'P' then 2048 else 0 end) & 2308 = 0 and o_orderkey % 60 >= 20""")
def semi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are alignments, flagged by their status; their returned lines are strings."""
    flag = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "P", 2048).otherwise(0)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qname"), flag.alias("flag"), (F.col("o_orderkey") % 60).cast("int").alias("mapq"))
    strings = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("qs"), F.col("l_quantity").cast("int").alias("l"))
    found = stages.specific_alignments(orders, strings, Config())
    return found.select(F.col("qname").alias("o_orderkey"), "mapq", F.array_join(F.transform("strings", lambda x: F.concat_ws(":", x["qs"], x["l"])), ",").alias("strings"))


@query("""
select concat_ws(chr(9), 'c' || l_suppkey, l_partkey, kind || '_c' || l_suppkey || ':' || l_partkey || '-' || (l_partkey + n) || '_' || n, l_returnflag, l_linestatus, '.', 'PASS',
  concat_ws(';', 'VARTYPE=SV', 'SVTYPE=' || kind, 'SVLEN=' || case kind when 'DEL' then -n else n end, 'END=' || (l_partkey + n), 'WEIGHT=' || l_linenumber, 'COV=' || (l_linenumber + 9), 'COV0=.', 'COV1=1', 'COV2=.', 'AS=' || -n, 'NV=1',
    'CIGAR=' || n || 'M', 'READS=r' || l_orderkey, 'RVEC=1:3-0:1', case when l_linenumber = 7 then 'IMPRECISE' end), 'GT:GQ', '0/1:100') as line
from (select *, cast(l_quantity as integer) as n, case l_linestatus when 'O' then 'INS' else 'DEL' end as kind from lineitem)""")
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("int")
    svs = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "INS").otherwise("DEL").alias("kind"), F.concat(F.lit("c"), "l_suppkey").alias("chrom"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + n).alias("e"),
        F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), n.alias("l"), F.col("l_linenumber").alias("w"), (F.col("l_linenumber") + 9).alias("cov"), F.lit(None).cast("int").alias("cov0"),
        F.lit(1).alias("cov1"), F.lit(None).cast("int").alias("cov2"), (-n).alias("score"), F.lit(1).alias("nv"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.concat(F.lit("r"), "l_orderkey").alias("reads"),
        F.lit("1:3-0:1").alias("rvec"), (F.col("l_linenumber") == 7).alias("imprecise"),
    )
    return reports.vcf_lines(svs).select(F.col("value").alias("line"))


@query("select item_id, translate(regexp_replace(reverse(text), '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA') as seq from benchmark")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", sequence.reverse_complement(F.col("text")).alias("seq"))


@query(GROUPS_SQL + "select l_orderkey, l_linenumber, l_partkey, n, sub_id from f join n using (l_orderkey, k)")
def greedy_length_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("n"))
    return folds.greedy_length_split(lines, ["l_orderkey"], "n", ["l_linenumber", "n", "l_partkey"])


@query("""
with recursive n as (select l_orderkey, l_partkey as s, l_partkey + cast(l_quantity as bigint) * 20 as e, row_number() over (partition by l_orderkey order by l_partkey, l_quantity) as k from lineitem),
f as (select l_orderkey, k, [{'s': s, 'e': e, 'n': 1::bigint}] as groups from n where k = 1
  union all select n.l_orderkey, n.k, case when g.at is null or g.at = 0 then list_append(groups, {'s': n.s, 'e': n.e, 'n': 1::bigint})
    else list_transform(groups, lambda x, i: case when i = g.at then {'s': least(x.s, n.s), 'e': greatest(x.e, n.e), 'n': x.n + 1} else x end) end
  from f join n on n.l_orderkey = f.l_orderkey and n.k = f.k + 1, lateral (select list_position(list_transform(f.groups, lambda x: n.s <= x.e and x.s <= n.e), true) as at) g),
w as (select l_orderkey, unnest(groups) as g from f qualify k = max(k) over (partition by l_orderkey))
select l_orderkey, g.s as s, g.e as e, g.n as n_merged from w""")
def merge_into_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long") * 20).alias("e"))
    return folds.merge_into_first(spans, ["l_orderkey"], "s", "e", ["s", "e"])


@query("""
with recursive n as (select l_suppkey, l_partkey * 10 as p, cast(l_quantity as bigint) as l, row_number() over (partition by l_suppkey order by l_partkey, l_quantity) as k from lineitem),
f as (select l_suppkey, k, p as centre, p, l from n where k = 1
  union all select n.l_suppkey, n.k, case when n.p - f.centre <= 1000 then f.centre else n.p end, n.p, n.l from f join n on n.l_suppkey = f.l_suppkey and n.k = f.k + 1)
select l_suppkey, centre as p, count(*) as w, max(l) as l from f group by 1, 2""")
def proximity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10).alias("p"), F.lit(1).cast("long").alias("w"), F.col("l_quantity").cast("long").alias("l"))
    return folds.proximity_clusters(clips, ["l_suppkey"], "p", "w", "l", ["p", "l"])


@query("""
with recursive t as (select p_partkey, p_name as a, p_type || ' ' || p_brand as b from part),
f as (select p_partkey, 0 as i, list_transform(range(length(b) + 1), lambda j: 0) as h from t
  union all select f.p_partkey, f.i + 1, list_transform(range(len(x.g)), lambda j: list_max(x.g[1:j + 1]))
  from f join t on t.p_partkey = f.p_partkey and f.i < length(t.a),
    lateral (select list_transform(range(length(t.b) + 1), lambda j: case when j > 0 and substr(t.a, f.i + 1, 1) = substr(t.b, j, 1) then f.h[j] + 1 else f.h[j + 1] end) as g) x)
select t.p_partkey, round(200.0::double * h[-1] / (length(a) + length(b)), 6) as ratio from f join t on t.p_partkey = f.p_partkey and f.i = length(t.a)""")
def string_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("other"))
    return parts.select("p_partkey", F.round(sequence.string_ratio("p_name", "other"), 6).alias("ratio"))


@query("""
select chrom, s, ref, alt, w, cluster_id, sub_id from (select l_suppkey as chrom, l_partkey as s, l_returnflag as ref, l_linestatus as alt, l_quantity as w, l_orderkey as cluster_id, l_linenumber as sub_id,
  row_number() over (partition by l_suppkey, l_partkey, l_returnflag, l_linestatus order by l_quantity desc, l_orderkey, l_linenumber) as k from lineitem) where k = 1""")
def dedup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"l_suppkey": "chrom", "l_partkey": "s", "l_returnflag": "ref", "l_linestatus": "alt", "l_quantity": "w", "l_orderkey": "cluster_id", "l_linenumber": "sub_id"}
    return chain.dedup_variants(table(spark, sf_dir, "lineitem").select(*(F.col(c).alias(n) for c, n in names.items())))


@query("""
with recursive v as (select l_suppkey as chrom, case l_linestatus when 'O' then 'INS' else 'DEL' end as kind, l_partkey * 10 as s, l_partkey * 10 + 1 as e, cast(l_quantity as integer) as l, l_linenumber as w,
  repeat(l_returnflag, cast(l_quantity as integer)) as ref, l_orderkey as cluster_id, l_linenumber as sub_id from lineitem),
d as (select * from v qualify row_number() over (partition by chrom, s, ref order by w desc, cluster_id, sub_id, kind) = 1),
n as (select *, row_number() over (partition by chrom order by s, e, kind, ref, w, cluster_id, sub_id) as k, count(*) over (partition by chrom) as size from d),
f as (select chrom, k, size, {'k': k, 'kind': kind, 's': s, 'e': e, 'l': l, 'w': w, 'ref': ref} as before, null::bigint as told from n where k = 1
  union all select n.chrom, n.k, n.size, case when before is not null and x.alike then null else {'k': n.k, 'kind': n.kind, 's': n.s, 'e': n.e, 'l': n.l, 'w': n.w, 'ref': n.ref} end,
    case when before is null then null when x.alike and before.w < n.w then n.k else before.k end
  from f join n on n.chrom = f.chrom and n.k = f.k + 1, lateral (select coalesce(f.before.kind = n.kind and n.s - f.before.e < 2 * n.l and n.s - f.before.s < 100 and least(f.before.w, n.w) >= 0.9::double * greatest(f.before.w, n.w)
    and least(f.before.l, n.l) >= 0.97::double * greatest(f.before.l, n.l) and case when f.before.ref[1] = n.ref[1] then 200.0::double * least(f.before.l, n.l) / (f.before.l + n.l) else 0 end > 70, false) as alike) x),
kept as (select chrom, told as k from f where told is not null union all select chrom, before.k from f where k = size and before is not null)
select n.chrom, kind, s, e, l, w, ref, ref as alt, cluster_id, sub_id from n join kept using (chrom, k)""")
def chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    allele = F.repeat(F.col("l_returnflag"), F.col("l_quantity").cast("int"))
    rows = lines.select(F.col("l_suppkey").alias("chrom"), F.when(F.col("l_linestatus") == "O", "INS").otherwise("DEL").alias("kind"), (F.col("l_partkey") * 10).alias("s"), (F.col("l_partkey") * 10 + 1).alias("e"), F.col("l_quantity").cast("int").alias("l"), F.col("l_linenumber").alias("w"), allele.alias("ref"), allele.alias("alt"), F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("sub_id"))
    # kind last: rows that are equal but for it are told apart
    return chain.chain_filter(relational.full_dedup(rows, ["chrom", "s", "ref", "alt"], [F.desc("w"), "cluster_id", "sub_id", "kind"]))


@query("""
with recursive x as (select 's' || l_suppkey as chrom, 'o' || l_orderkey as qname, cast(l_partkey as integer) as rs, cast(l_partkey + l_quantity as integer) as re from lineitem),
d as (select cast(floor(1.1::double * max(re - rs)) as bigint) as dist from x),
n as (select x.*, dist, row_number() over (partition by chrom order by rs, re, qname) as k from x, d),
f as (select chrom, k, qname, rs, re, re as anchor, 0::bigint as win from n where k = 1
  union all select n.chrom, n.k, n.qname, n.rs, n.re, case when n.rs - f.anchor > n.dist then n.re else f.anchor end, f.win + (n.rs - f.anchor > n.dist)::bigint from f join n on n.chrom = f.chrom and n.k = f.k + 1),
b as (select *, max(re) over (partition by chrom, win order by rs, re, qname rows between unbounded preceding and 1 preceding) as reach from f),
i as (select *, sum(case when rs > reach then 1 else 0 end) over (partition by chrom, win order by rs, re, qname rows unbounded preceding) as island from b)
select chrom, min(rs) as s, max(re) as e, cast(count(distinct qname) as integer) as reads from i group by chrom, win, island having count(distinct qname) >= 2""")
def cluster_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("chrom"), F.concat(F.lit("o"), "l_orderkey").alias("qname"), F.col("l_partkey").cast("int").alias("rs"),
        (F.col("l_partkey") + F.col("l_quantity")).cast("int").alias("re"), F.lit(False).alias("clip"),
    )
    return stages.cluster(spans, Config()).select("chrom", "s", "e", F.size("names").alias("reads"))


@query("""
select qname, value from (select cast(user_id as varchar) as qname, case when row_number() over w = 1 then cast(user_id as varchar) else '*' end || chr(9) || event_id || chr(9) || (event_id % 50 + 1) || chr(9) || (event_id % 3) || chr(9) as value
from events window w as (partition by user_id order by event_id))""")
def string_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("qname"), F.col("event_id").alias("qs"), (F.col("event_id") % 50 + 1).alias("l"), (F.col("event_id") % 3).alias("htag"))
    return strings_text.string_lines(strings).drop("k")


@query("""
select cast(user_id as varchar) as qname, cast(event_id as integer) as qs, cast(event_id % 50 + 1 as integer) as l, cast(event_id % 3 as integer) as htag from events""")
def parsed_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = string_lines(spark, sf_dir)
    # each read's lines together and in order, its name first, as files of them are
    first = F.when(F.col("value").startswith("*"), 1).otherwise(0)
    lines = lines.repartitionByRange(4, "qname").sortWithinPartitions("qname", first).select(F.monotonically_increasing_id().alias("ord"), "value")
    return strings_text.parse_strings(lines)


@query("""
with c as (select item_id, i, j, case when i % 5 = j then '#' else substr(text, cast(i as bigint) + 1, 1) end as c from (select item_id, text, unnest(range(length(text))) as i from benchmark where length(text) > 0), range(5) r(j)),
n as (select item_id, i, c, count(*) as n from c group by all)
select item_id, string_agg(c, '' order by i) as consensus from (select * from n qualify row_number() over (partition by item_id, i order by n desc) = 1) group by 1""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five copies of a text, in each of which every fifth letter is another: the letters of most, which none has."""

    def found(item: int, text: str) -> list[tuple]:
        return [(item, poa.consensus(["".join("#" if i % 5 == j else c for i, c in enumerate(text)) for j in range(5)]))]

    items = table(spark, sf_dir, "benchmark").where(F.length("text") > 0).repartition(spark.sparkContext.defaultParallelism, "item_id")  # dear rows of a small file
    return stages.map_rows(items, ["item_id", "text"], found, "item_id long, consensus string")


@query("""
with recursive t as (select p_partkey, upper(p_name) as a, upper(p_type || p_name) as b from part),
c as (select list_transform(range(64), lambda k: case when k = 0 then 0 else least(16 + 2 * k, 41 + k) end) as cost),
f as (select p_partkey, 0 as i, [list_transform(range(length(b) + 1), lambda j: -cost[j + 1])] as rows from t, c
  union all select f.p_partkey, f.i + 1, list_append(f.rows, list_transform(range(len(x.best)), lambda j: list_max(list_transform(range(j + 1), lambda k: x.best[k + 1] - cost[j - k + 1]))))
  from f join t on t.p_partkey = f.p_partkey and f.i < length(t.a), c,
    lateral (select list_transform(range(length(t.b) + 1), lambda j: greatest(list_max(list_transform(range(f.i + 1), lambda k: f.rows[k + 1][j + 1] - cost[f.i + 1 - k + 1])),
      case when j = 0 then -1000000 else f.rows[f.i + 1][j] + case when 'N' in (substr(t.a, f.i + 1, 1), substr(t.b, j, 1)) then 0 when substr(t.a, f.i + 1, 1) = substr(t.b, j, 1) then 1 else -9 end end)) as best) x)
select t.p_partkey, cast(f.rows[-1][-1] as integer) as score, cast(length(a) as integer) as ref_length, cast(length(b) as integer) as query_length from f join t on t.p_partkey = f.p_partkey and f.i = length(t.a)""")
def global_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts against longer ones: the score, by dynamic programming in SQL, and what the operations cover."""

    def found(part: int, a: str, b: str) -> list[tuple]:
        score, ops = align.global_align(a, b)
        return [(part, score, sum(n for n, op in ops if op in "MD"), sum(n for n, op in ops if op in "MI"))]

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_type", "p_name").alias("other")).repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return stages.map_rows(rows, ["p_partkey", "p_name", "other"], found, "p_partkey long, score int, ref_length int, query_length int")


@query(CIGAR_SQL + """, ops as (select *, r + 10 as place, count(*) over (partition by l_orderkey) as n_ops from w),
x as (select l_orderkey, cast(sum(case when op <> 'D' then len else 0 end) as bigint) as size, 10 + sum(case when op in ('M', 'D') then len else 0 end) as end_pos, max(len) filter (k = 1 and op = 'S') as left_clip, max(len) filter (k = n_ops and op = 'S') as right_clip from ops group by 1),
s as (select *, (l_orderkey * 7) % size as s, (l_orderkey * 7) % size + l_orderkey % 30 as e from x where size > 0),
p as (select s.l_orderkey, max(least(q + len - 1, s - 1)) filter (op = 'M' and q < s) as qa, max(place + least(q + len - 1, s - 1) - q) filter (op = 'M' and q < s) as ra,
  min(greatest(q, e + 1)) filter (op = 'M' and q + len - 1 > e) as qb, min(place + greatest(q, e + 1) - q) filter (op = 'M' and q + len - 1 > e) as rb, any_value(end_pos) as end_pos, any_value(left_clip) as left_clip, any_value(right_clip) as right_clip from s join ops using (l_orderkey) group by 1)
select l_orderkey::varchar as qname, cast(ra as integer) as rs, cast(rb + 7 as integer) as re, cast(qa as integer) as qs, cast(qb + 7 as integer) as qe, false as clip, null::boolean as starting from p where qa is not null and qb is not null and ra <= rb + 7
union all select l_orderkey::varchar, 10, cast(left_clip as integer), null, null, true, true from p where qa is null and qb is not null and left_clip is not null
union all select l_orderkey::varchar, cast(end_pos as integer), cast(right_clip as integer), null, null, true, false from p where qa is not null and qb is null and right_clip is not null""")
def placed_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string of each order's read placed by its alignment, without flanks, so that the fallbacks decide."""
    ops = _order_cigars(spark, sf_dir).select(F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("qname"), "ops")
    reads = ops.select("ord", "qname", cigar.cigar_string(F.col("ops")).alias("cigar"), cigar.read_length(F.col("ops")).alias("size")).where("size > 0")
    alignments = reads.select("ord", "qname", F.lit(0).alias("flag"), F.lit("c").alias("chrom"), F.lit(10).alias("pos"), F.lit(60).alias("mapq"), "cigar", F.lit(None).cast("int").alias("hp"))
    strings = reads.select("qname", ((F.col("ord") * 7) % F.col("size")).cast("int").alias("qs"), (F.col("ord") % 30 + 1).cast("int").alias("l"))
    contigs = spark.range(1).select(F.lit("c").alias("chrom"), F.repeat(F.lit("ACGT"), 1000).alias("seq"))
    return stages.place(alignments, strings, contigs, Config(flank=0)).drop("chrom", "htag")


@query("""
select concat_ws(chr(9), 's' || l_suppkey || ':' || (l_partkey + 1) || '-' || (l_partkey + l_linenumber + 1), '0', 's' || l_suppkey, l_partkey + 1, '60', l_linenumber || 'M', '*', '0', '0', repeat(l_returnflag, l_linenumber), '*') as line from lineitem""")
def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("chrom"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + n).alias("e"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.repeat("l_returnflag", n).alias("seq")
    )
    return reports.sam_lines(rows).select(F.col("value").alias("line"))


@query("""
select concat_ws(chr(9), 's' || l_suppkey || ':' || (min(l_partkey) + 1) || '-' || (max(l_partkey) + 1), count(*), string_agg('r' || l_orderkey || ':' || l_returnflag, chr(9) order by l_orderkey, l_returnflag)) as line from lineitem group by l_suppkey""")
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_returnflag"))), lambda x: F.struct(F.concat(F.lit("r"), x["l_orderkey"]).alias("name"), x["l_returnflag"].alias("seq")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("s"), F.max("l_partkey").alias("e"), members.alias("subreads"))
    return reports.cluster_lines(rows.withColumn("chrom", F.concat(F.lit("s"), "l_suppkey"))).select(F.col("value").alias("line"))


READS_SQL = "select 'r' || event_id as qname, 'u' || (user_id % 4) as chrom, cast(event_id % 3000 as integer) as pos, substr(repeat('ACGTN', 30), cast(1 + event_id % 5 as bigint), cast(1 + event_id % 90 as bigint)) as seq"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (1 + F.col("event_id") % 90).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("r"), "event_id").alias("qname"), F.concat(F.lit("u"), F.col("user_id") % 4).alias("chrom"), (F.col("event_id") % 3000).cast("int").alias("pos"),
        F.substring(F.repeat(F.lit("ACGTN"), 30), (1 + F.col("event_id") % 5).cast("int"), n).alias("seq"), n.alias("n"), "event_id", "event_type",
    )


@query(READS_SQL + """, cast(event_id % 4096 as integer) as flag, cast(event_id % 61 as integer) as mapq, (1 + event_id % 90) || (case when event_id % 2 = 0 then 'M' else 'S' end) as cigar,
  repeat('I', cast(1 + event_id % 90 as integer)) as qual, case when event_id % 3 > 0 then cast(event_id % 3 as integer) end as hp, cast(event_id % 4 as integer) as xf, row_number() over (order by event_id) as number from events""")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as BAM and read again, numbered in the order of the file."""
    reads = _reads(spark, sf_dir).withColumns({
        "flag": (F.col("event_id") % 4096).cast("int"), "mapq": (F.col("event_id") % 61).cast("int"), "cigar": F.concat(F.col("n").cast("string"), F.when(F.col("event_id") % 2 == 0, "M").otherwise("S")),
        "qual": F.repeat(F.lit("I"), F.col("n")).cast("binary"), "hp": F.nullif((F.col("event_id") % 3).cast("int"), F.lit(0)), "xf": (F.col("event_id") % 4).cast("int"),
    })
    path = f"{shared_root(spark)}/reads-{uuid.uuid4().hex}.bam"
    bam.write_bam(reads, [(f"u{k}", 4000) for k in range(4)], path.removeprefix("file://"))
    back = bam.read_bam(spark, path.removeprefix("file://"))
    number = F.row_number().over(Window.orderBy("ord"))  # of a table that was written in one file
    return back.select("qname", "chrom", "pos", "seq", "flag", "mapq", "cigar", F.col("qual").cast("string").alias("qual"), "hp", "xf", number.cast("long").alias("number"))


@query(READS_SQL.replace("'u' || (user_id % 4) as chrom, cast(event_id % 3000 as integer) as pos, ", "") + """, case when event_type = 'click' then repeat('#', cast(1 + event_id % 90 as integer)) else 'r' || event_id end as qual from events""")
def fastx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ, or FASTA for those without qualities, and read again in parts."""
    reads = _reads(spark, sf_dir)
    fastq = F.concat(F.lit("@"), "qname", F.lit(" x\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("#"), F.col("n")))
    fasta = F.concat(F.lit(">"), "qname", F.lit("\n"), "seq")
    path = f"{shared_root(spark)}/reads-{uuid.uuid4().hex}"
    for rows, line, kind in ((reads.where("event_type = 'click'"), fastq, "fq"), (reads.where("event_type <> 'click'"), fasta, "fa")):
        rows.select(line.alias("value")).write.text(f"{path}/{kind}")
    found = [sequences.read_fastx(spark, f"{path}/{kind}", split_bytes=4096).select("qname", "seq", "qual") for kind in ("fq", "fa")]
    return found[0].unionByName(found[1])
