"""Queries of the iterative graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from . import twins
from .registry import query
from .twins import HEAP_SQL, PROGRESS_SQL


def transitions(t):
    """A cyclic graph: event types that follow one another for a user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").distinct()


@query("g1_cycle_members", "with e as (select distinct event_type as src, nxt as dst from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null) select distinct src as node from e where src in (select dst from e)")
def g1(t):
    return G.cycle_members(transitions(t))


@query("g1_cycles", "with recursive e as (select distinct event_type as src, nxt as dst from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null), r(a, b) as (select src, dst from e union select a, dst from r join e on b = src), m as (select x.a as node, x.b as other from r x join r y on x.a = y.b and x.b = y.a), c as (select node, min(other) as component from m group by 1) select component, list(node order by node) as nodes from c group by 1")
def g1c(t):
    return G.components(transitions(t)).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


# a way back from every seventh node to the parent of its parent closes a cycle of three; those that share a node are one component
LOOPS_SQL = ", tri as (select p_partkey as a, (p_partkey - 1) // 2 as b, ((p_partkey - 1) // 2 - 1) // 2 as c from part where p_partkey > 2 and p_partkey % 7 = 3), link as (select a as x, b as y from tri union select b, a from tri union select b, c from tri union select c, b from tri), r(node, other) as (select x, y from link union select node, y from r join link on other = x)"


def looped(t):
    h = twins.heap(t)
    up = (F.floor((F.col("src") - 1) / 2)).alias("dst")
    return h.union(h.where("dst > 2 and dst % 7 = 3").select(F.col("dst").alias("src"), up))


@query("g1_cycles_in_hierarchy", HEAP_SQL.replace("with ", "with recursive ") + LOOPS_SQL + " select node, least(node, min(other)) as component from r group by 1")
def g1d(t):
    return G.components(looped(t)).select("node", "component")


@query("g1_acyclic_residue", HEAP_SQL + " select count(*) as n from heap where dst <= src")  # each edge leads to a larger key, so no cycle can be
def g1b(t):
    return G.peel(twins.heap(t)).agg(F.count("*").alias("n"))


DEPTH_SQL = HEAP_SQL.replace("with ", "with recursive ") + ", d(node, depth) as (select 0::bigint, 0 union all select dst, depth + 1 from d join heap on node = src)"


@query("g2_g9_depth", DEPTH_SQL + " select node, depth from d")
def g2(t):
    return G.depth(twins.heap(t))


MANY_SQL = HEAP_SQL.replace("with ", "with recursive ") + ", e as (select * from heap union select p_partkey // 3, p_partkey from part where p_partkey > 0 and p_partkey % 4 = 0 union select p_partkey - 1, p_partkey from part where p_partkey % 5 = 2), d(node, depth) as (select 0::bigint, 0 union select dst, depth + 1 from d join e on node = src)"


@query("g2_depth_many_ways", MANY_SQL + " select node, max(depth) as depth from d group by 1")
def g2d(t):
    # several ways of different lengths lead to a node
    k = F.col("p_partkey")
    third = t.part.where("p_partkey > 0 and p_partkey % 4 = 0").select(F.floor(k / 3).alias("src"), k.alias("dst"))
    before = t.part.where("p_partkey % 5 = 2").select((k - 1).alias("src"), k.alias("dst"))
    return G.depth(twins.heap(t).union(third).union(before))


@query("g2_chain_length", DEPTH_SQL.replace("p_partkey > 0", "p_partkey > 0") + ", up(node, h) as (select dst, 0 from heap where dst not in (select src from heap) union all select src, h + 1 from up join heap on node = dst), m as (select node, max(h) as h from up group by 1 having max(h) > 0) select round(avg(h), 6) as avg_chain_length, max(h) as longest from m")
def g2b(t):
    return G.chain_length(twins.heap(t))


@query("g3_l2_ancestors", HEAP_SQL.replace("with ", "with recursive ") + ", r(seed, node, dist) as (select p_partkey, p_partkey, 0 from part union all select seed, src, dist + 1 from r join heap on node = dst) select * from r")
def g3(t):
    up = twins.heap(t).select(F.col("dst").alias("node"), F.col("src").alias("parent"))
    return G.ancestors(up, t.part.select(F.col("p_partkey").alias("seed")))


@query("g3_ancestor_pairs", HEAP_SQL.replace("with ", "with recursive ") + ", r(seed, node, dist) as (select p_partkey, p_partkey, 0 from part union all select seed, src, dist + 1 from r join heap on node = dst), pairs as (select p_partkey as a, p_partkey // 5 as b from part union select p_partkey, (p_partkey - 7) // 8 from part where p_partkey >= 7) select a, b, dist from pairs join r on a = seed and b = node")
def g3b(t):
    k = F.col("p_partkey")
    pairs = t.part.select(k.alias("a"), F.floor(k / 5).alias("b")).union(t.part.where("p_partkey >= 7").select(k, F.floor((k - 7) / 8)))
    return G.ancestor_pairs(twins.heap(t).select(F.col("dst").alias("node"), F.col("src").alias("parent")), pairs)


@query("g4_g6_descendants", HEAP_SQL.replace("with ", "with recursive ") + ", r(seed, node, dist) as (select p_partkey, p_partkey, 0 from part union all select seed, dst, dist + 1 from r join heap on node = src where dist < 3) select * from r")
def g4(t):
    return G.expand(twins.heap(t), t.part.select(F.col("p_partkey").alias("seed")), 3)


@query("g5_siblings", "select p_partkey as node, case when p_size = 50 then 0 else 1 end as layer from part where p_name in (select p_name from part where p_size = 50)")
def g5(t):
    return G.siblings(t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("cls")), t.part.where("p_size = 50").select(F.col("p_partkey").alias("node")))


@query("g7_propagated_tags", HEAP_SQL.replace("with ", "with recursive ") + ", r(node, subject) as (select p_partkey, p_name from part where p_size = 50 union all select dst, subject from r join heap on node = src where dst not in (select p_partkey from part where p_size = 50)) select p_partkey as node, coalesce(subject, 'unknown') as subject from part left join r on p_partkey = node")
def g7(t):
    seeds = t.part.where("p_size = 50").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("subject"), F.col("p_partkey").alias("ord"))
    return G.propagate(twins.heap(t), seeds, t.part.select(F.col("p_partkey").alias("node")))


@query("g8_bounded_paths", HEAP_SQL + " select src, dst, 1 as hops, [src, dst] as path from heap union all select a.src, b.dst, 2, [a.src, a.dst, b.dst] from heap a join heap b on a.dst = b.src union all select a.src, c.dst, 3, [a.src, a.dst, b.dst, c.dst] from heap a join heap b on a.dst = b.src join heap c on b.dst = c.src")
def g8(t):
    return G.bounded_paths(twins.heap(t), 3)


@query("g9_roots", HEAP_SQL + " select p_partkey as node from part where p_partkey not in (select dst from heap)")
def g9(t):
    return G.roots(t.part.select(F.col("p_partkey").alias("node")), twins.heap(t))


def _pairs(t):
    return t.part.where("p_partkey >= 7").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 7).alias("b"))


LCA_SQL = HEAP_SQL.replace("with ", "with recursive ") + ", pairs as (select p_partkey as a, p_partkey - 7 as b from part where p_partkey >= 7), r(seed, node, dist) as (select s, s, 0 from (select a as s from pairs union select b from pairs) union all select seed, src, dist + 1 from r join heap on node = dst), c as (select a, b, x.node as ancestor, x.dist as da, y.dist as db, row_number() over (partition by a, b order by greatest(x.dist, y.dist)) as n, min(greatest(x.dist, y.dist)) over (partition by a, b) as best from pairs join r x on a = x.seed join r y on b = y.seed and x.node = y.node)"


@query("g11_lowest_common", LCA_SQL + " select a, b, ancestor, da, db from c where greatest(da, db) = best")
def g11(t):
    return G.lowest_common(twins.heap(t), _pairs(t))


@query("g12_common_scores", LCA_SQL + ", d(node, depth) as (select 0::bigint, 0 union all select dst, depth + 1 from d join heap on node = src), kids as (select src, count(*) as kids from heap group by 1) select ancestor, round(sum(169.0::double / (da * db) * ln(depth::double) / kids), 6) as score from c join d on ancestor = d.node join kids on ancestor = src where greatest(da, db) = best and da > 0 and db > 0 and depth > 0 group by 1")
def g12(t):
    return G.common_scores(twins.heap(t), _pairs(t))


@query("g13_weighted_common", LCA_SQL + " select a, b, ancestor, round(sqrt((da * db)::double), 6) as score from c where greatest(da, db) = best")
def g13(t):
    return G.weighted_common(twins.heap(t).select(F.col("dst").alias("node"), F.col("src").alias("parent")), _pairs(t))


@query("g14_hierarchy_codes", HEAP_SQL.replace("with ", "with recursive ") + ", k as (select src, dst, row_number() over (partition by src order by dst)::varchar as k from heap), c(node, code) as (select 0::bigint, '1' union all select dst, code || '-' || k from c join k on node = src) select node, code from c")
def g14(t):
    f = t.part.where("p_partkey = 0").select(F.col("p_partkey").alias("node"), F.lit(None).cast("long").alias("parent"))
    return G.hierarchy_codes(f.union(twins.heap(t).select("dst", "src")))


@query("g15_network", "select distinct 'http://kg.example/source/' || source as node from documents union select distinct 'http://kg.example/' || case when doc_id % 3 = 0 then 'statement' else 'instance' end || '/' || lang || '#' || doc_id::varchar from documents")
def g15(t):
    return G.network(twins.triples(t), "http://kg.example/p/source")[0]


@query("g16_l11_learning_path", HEAP_SQL.replace("with ", "with recursive ") + ", r(target, node) as (select p_partkey, p_partkey from part union all select target, src from r join heap on node = dst) select target, node, row_number() over (partition by target order by node) as step from r where node not in (select p_partkey from part where p_size < 10)")
def g16(t):
    return G.learning_path(twins.heap(t), t.part.select(F.col("p_partkey").alias("target")), t.part.where("p_size < 10").select(F.col("p_partkey").alias("node")))


@query("g17_central", "select l_orderkey as grp, l_partkey as uri from lineitem group by 1, 2 having count(*) = (select count(*) from lineitem x where x.l_orderkey = lineitem.l_orderkey)")
def g17(t):
    return G.central(t.lineitem.select(F.col("l_orderkey").alias("grp"), F.struct(*t.lineitem.columns).alias("row"), F.col("l_partkey").alias("s"), (-1 - F.col("l_suppkey")).alias("o"))).where("uri >= 0")


@query("l4_difficulty", DEPTH_SQL + ", deg as (select l_partkey as node, count(distinct l_suppkey) as related from lineitem group by 1) select d.node, d.depth + least(coalesce(related, 0), 10) as difficulty from d left join deg using (node)")
def l4(t):
    deg = twins.related(t).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("related"))
    return G.depth(twins.heap(t)).join(deg, "node", "left").select("node", (F.col("depth") + F.least(F.coalesce("related", F.lit(0)), F.lit(10))).alias("difficulty"))


@query("l6_teaching_sequence", HEAP_SQL.replace("with ", "with recursive ") + ", big as (select p_partkey from part where p_size > 10), inner_ as (select * from heap where src in (select p_partkey from big) and dst in (select p_partkey from big)), up(node, h) as (select p_partkey, 1 from part where p_size > 10 and p_partkey not in (select dst from inner_) union all select dst, h + 1 from up join inner_ on node = src) select node, max(h) as step from up group by 1")
def l6(t):
    return G.teaching_sequence(twins.heap(t), t.part.where("p_size > 10").select(F.col("p_partkey").alias("node")))


@query("l12_neighbourhood", HEAP_SQL.replace("with ", "with recursive ") + ", e as (select src, dst from heap union all select dst, src from heap), r(node, dist) as (select p_partkey, 0 from part where p_size = 50 union select e.dst, dist + 1 from r join e on node = src where dist < 3) select count(*) as n from heap where src in (select node from r) and dst in (select node from r)")
def l12(t):
    return G.neighbourhood(twins.heap(t), t.part.where("p_size = 50").select(F.col("p_partkey").alias("seed")), 3)[1].agg(F.count("*").alias("n"))


@query("l13_subject_tree", HEAP_SQL + ", two as (select src, '[' || string_agg('{\"node\":' || dst::varchar || '}', ',' order by dst) || ']' as kids from heap group by 1), one as (select h.src, '[' || string_agg('{\"node\":' || dst::varchar || ',\"children\":' || coalesce(kids, '[]') || '}', ',' order by dst) || ']' as kids from heap h left join two on two.src = dst group by 1) select p_partkey as node, '{\"node\":' || p_partkey::varchar || ',\"children\":' || coalesce(kids, '[]') || '}' as tree from part left join one on src = p_partkey")
def l13(t):
    return G.nested_tree(twins.heap(t), t.part.select(F.col("p_partkey").alias("node")), 2).select("node", F.to_json("tree").alias("tree"))


@query("g2_depth_with_cycles", "with recursive h as (select (p_partkey - 1) // 2 as src, p_partkey as dst from part where p_partkey > 0), bad(node) as (select p_partkey from part where p_partkey % 50 = 1 and p_partkey * 2 + 1 in (select p_partkey from part) union select dst from bad join h on node = src), d(node, depth) as (select 0::bigint, 0 union all select dst, depth + 1 from d join h on node = src) select d.node, case when bad.node is null then depth end as depth from d left join bad on d.node = bad.node")
def g2c(t):
    # some parts' first child leads back to them: these, their child and all below have no longest path
    h = twins.heap(t)
    back = h.where("src % 50 = 1 and dst = src * 2 + 1").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.depth(h.union(back))


@query("t1_progress_upsert", PROGRESS_SQL + ' select "user", entity, status, score from latest')
def t1(t):
    from ..streaming import progress as ST

    return ST.upsert_stream(t._spark, f"{t._dir}/events.parquet")


@query("t4_running_cost", "select event_type as provider, count(*) as calls, sum(floor(value)::bigint)::bigint as cents, sum(floor(value)::bigint) > 5000 as over from events group by 1")
def t4(t):
    from ..streaming import progress as ST

    return ST.cost_stream(t._spark, f"{t._dir}/events.parquet", 5000)


@query("t5_progress_windows", "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events group by 1, 2")
def t5(t):
    from ..streaming import progress as ST

    return ST.window_stream(t._spark, f"{t._dir}/events.parquet").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("t2_resume", "select event_id from events where event_type <> 'purchase'")
def t2(t):
    from ..streaming import progress as ST

    return ST.pending(t.events.select("event_id"), t.events.where("event_type = 'purchase'").select("event_id"), "event_id")


@query("t2_resumed_stream", "select distinct user_id, event_type from events")
def t2b(t):
    from ..streaming import progress as ST

    return ST.resumed(t._spark, f"{t._dir}/events.parquet", ["user_id", "event_type"])


@query("t3_purge", "select count(*) filter (where ts > (select max(ts) from events) - interval 7 days) as kept, count(*) filter (where ts <= (select max(ts) from events) - interval 7 days) as removed from events")
def t3b(t):
    from ..streaming import progress as ST

    kept, counts = ST.purge(t.events, "ts", "7 days")
    return kept.agg(F.count("*").alias("kept")).join(counts, "kept")  # what was written is what was counted


@query("t3_cache_ttl", "select event_id, value from events where ts > (select max(ts) from events) - interval 7 days")
def t3(t):
    from ..streaming import progress as ST

    return ST.alive(t.events, "ts", "7 days").select("event_id", "value")


_CACHE = """select event_id, case when last_ts is not null and ts - last_ts < interval 2 hours then 'hit' else 'miss' end as outcome, case when last_ts is not null and ts - last_ts < interval 2 hours then last_value end as answer
from (select event_id, ts, event_type, last(case when event_type = 'purchase' then ts end ignore nulls) over w as last_ts, last(case when event_type = 'purchase' then value end ignore nulls) over w as last_value from events where user_id is not null and ts is not null window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) where event_type <> 'purchase'"""


@query("t3_cache_stream", _CACHE)
def t3c(t):
    from ..streaming import progress as ST

    return ST.cache_stream(t._spark, f"{t._dir}/events.parquet", "event_type = 'purchase'", "2 hours").where("outcome <> 'expired'").select("event_id", "outcome", "answer")
