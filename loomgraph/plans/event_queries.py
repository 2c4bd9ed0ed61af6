"""Temporal tables: splits, batches, latest neighbours, memories, windows; streaming twins."""
from pyspark.sql import functions as F

from ..operators import temporal as T
from ..streaming import jobs as J
from .catalog import query


@query("ev", "select max(greatest(src, dst)) + 1 as num_nodes, count(*) as num_events from ev")
def event_counts(t):
    return T.event_counts(t.ev)


@query("ev", """with o as (select *, row_number() over (order by t, e_id) - 1 as pos from ev), q as (select quantile_cont(t::double, 0.7) a, quantile_cont(t::double, 0.85) b from ev),
  c as (select count(*) filter (where t <= a) + 1 v, count(*) filter (where t <= b) + 1 w from ev, q)
  select e_id, pos, case when pos < v then 'train' when pos < w then 'val' else 'test' end as split from o, c""")
def temporal_split(t):
    return T.time_split(t.ev).select("e_id", "pos", "split")


@query("ev", "select e_id, (row_number() over (order by t, e_id) - 1) // 200 as batch from ev")
def sequential_batches(t):
    return T.sequential_batches(t.ev, 200).select("e_id", "batch")


@query("ln", "select graph_id, (row_number() over (order by graph_id) - 1) // 64 as batch from (select distinct graph_id from ln)")
def data_loader(t):
    return T.batch_ids(t.lines, 64)


@query("ln", "with g as (select graph_id, count(*) n from ln group by 1), o as (select graph_id, coalesce(sum(n) over (order by graph_id rows between unbounded preceding and 1 preceding), 0) as ptr from g) select ln.graph_id, id, (ptr + row_number() over (partition by ln.graph_id order by id) - 1)::bigint as global_id, ptr::bigint as ptr from ln join o using (graph_id)")
def batch_offsets(t):
    """global ids are positions over (graph, node); a graph's offset is its first position"""
    from ..core.ranges import global_index
    from ..core.session import cut
    g = cut(global_index(t.lines.select("graph_id", "id"), [F.col("graph_id"), F.col("id")], "global_id"))
    return g.join(g.groupBy("graph_id").agg(F.min("global_id").alias("ptr")), "graph_id")


BOTH = "b as (select src as node, dst as other, e_id, t, msg from ev union all select dst, src, e_id, t, msg from ev)"


@query("ev", "with " + BOTH + " select node, other, e_id from (select *, row_number() over (partition by node order by e_id desc) r from b) where r <= 5")
def last_k_neighbors(t):
    return T.last_neighbors(t.ev, 5)


@query("ev", "with " + BOTH + " select node, t, msg from (select *, row_number() over (partition by node order by t desc, e_id desc) r from b) where r = 1")
def latest_message(t):
    return T.last_message(t.ev)


@query("ev", "with " + BOTH + " select node, round(avg(msg), 8) as msg from b group by 1")
def mean_message(t):
    return T.mean_message(t.ev).select("node", F.round("msg", 8).alias("msg"))


@query("ev", """with s as (select *, (row_number() over (order by t, e_id) - 1) // 100 as batch from ev), b as (select src as node, batch, t, e_id, msg from s union all select dst, batch, t, e_id, msg from s),
  l as (select node, batch, arg_max(msg, t) as msg, max(t) as t from b group by 1, 2), r as (select *, row_number() over (partition by node order by batch desc) - 1 as a from l)
  select node, round(sum(msg * pow(0.8, a)), 6) as memory, max(t) as last_t from r group by 1""")
def node_memory(t):
    return T.memory_after_batches(t.ev, 100, 0.8).select("node", F.round("memory", 6).alias("memory"), "last_t")


DAY = 86_400_000_000


@query("ev", f"""with m as (select min(t) t0, max(t) t1 from ev), b as (select e_id, src, dst, floor((t-t0)/{2 * DAY})::bigint as bucket, floor((t1-t0)/{2 * DAY})::bigint as last from ev, m)
  select e_id, src, dst, unnest(range(bucket, least(bucket + 2, last) + 1)) as graph_id from b""")
def time_window_graphs(t):
    return T.time_window_graphs(t.ev, 2 * DAY, 3).select("e_id", "src", "dst", "graph_id")


@query("ev", f"""with h as (select e_id, src, dst as rel, (floor(msg)::bigint % 20) as dst, t // {DAY} as step from ev)
  select distinct h.e_id, (h.step - p.step)::int as lag, p.dst as other from h join h p on p.src = h.src and p.rel = h.rel and p.step between h.step - 3 and h.step - 1""")
def relation_history(t):
    h = t.ev.select("e_id", "src", F.col("dst").alias("rel"), (F.floor("msg") % 20).alias("dst"), F.floor(F.col("t") / DAY).alias("step"))
    return T.relation_history(h, 3)


# streaming twins: the stream runs to the end of its input and must equal the batch answer ----------------

@query("ev", f"""select t // {DAY} as day, dst, count(*) as n, round(sum(msg), 4) as total from ev group by 1, 2""")
def stream_tumbling(t):
    got = J.run_tumbling(t.spark, t.path, "1 day")
    return got.select(F.floor(F.unix_micros("start") / DAY).alias("day"), "dst", "n", F.round("total", 4).alias("total"))


@query("ev", f"""with w as (select unnest([t // {DAY // 2}, t // {DAY // 2} - 1]) as half, dst from ev) select half, dst, count(*) as n from w group by 1, 2""")
def stream_sliding(t):
    got = J.run_tumbling(t.spark, t.path, "1 day", "12 hours")
    return got.select(F.floor(F.unix_micros("start") / (DAY // 2)).alias("half"), "dst", "n")


@query("ev", """with g as (select src, t, case when t - lag(t) over (partition by src order by t) < 7200000000 then 0 else 1 end as brk from ev),
  s as (select src, t, sum(brk) over (partition by src order by t) as s from g) select src, min(t) as start_us, count(*) as n from s group by src, s""")
def stream_sessions(t):
    got = J.run_sessions(t.spark, t.path, "2 hours")
    return got.select("src", F.unix_micros("start").alias("start_us"), "n")


@query("ev", "with " + BOTH + " select node, other, e_id from (select *, row_number() over (partition by node order by t desc, e_id desc) r from b) where r <= 5")
def stream_last_k_neighbors(t):
    return J.run_last_k(t.spark, t.path, 5)


@query("ev", "with " + BOTH + " select node, count(*) as n from b group by 1")
def stream_degrees(t):
    return J.run_degrees(t.spark, t.path)


@query("ev", "with " + BOTH + ", r as (select *, row_number() over (partition by node order by t desc, e_id desc) - 1 as a from b) select node, round(sum(msg * pow(0.9, a)), 5) as memory, max(t) as last_t from r group by 1")
def stream_memory(t):
    got = J.run_memory(t.spark, t.path, 0.9)
    return got.select("node", F.round("memory", 5).alias("memory"), "last_t")
