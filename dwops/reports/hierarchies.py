"""Hierarchies, parts lists and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.operators import graph
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import PART_TREE

WALK = f"""{PART_TREE},
walk as (
  select id, parent, name, price, 1 as level, [id] as path, name as name_path from part_tree where parent is null
  union all
  select p.id, p.parent, p.name, p.price, w.level + 1, list_append(w.path, p.id), w.name_path || ' > ' || p.name
  from part_tree p join walk w on p.parent = w.id where not list_contains(w.path, p.id))"""


@report("hierarchy_walk", f"with recursive {WALK} select id, parent, cast(level as bigint) as level, array_to_string(path, '/') as id_path, name_path, repeat('  ', level - 1) || name as indented_name from walk")
def hierarchy_walk(t: Tables) -> DataFrame:
    walked = graph.walk_hierarchy(inputs.part_tree(t), "id", "parent", "name")
    return walked.select("id", "parent", "level", F.array_join(F.col("path").cast("array<string>"), "/").alias("id_path"), "name_path",
                         v.indent("name", "level").alias("indented_name"))


@report("hierarchy_level", f"with recursive {WALK} select cast(level as bigint) as level, count(*) as nodes from walk group by 1")
def hierarchy_level(t: Tables) -> DataFrame:
    return graph.walk_hierarchy(inputs.part_tree(t), "id", "parent", "name").groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


@report("subtree_totals", f"""with recursive {WALK}
select a.id, cast(sum(cast(w.price as decimal(18,2))) as double) as subtree_total, count(*) as subtree_nodes
from (select unnest(path) as id, price from walk) w join part_tree a on a.id = w.id group by 1""")
def subtree_totals(t: Tables) -> DataFrame:
    tree = inputs.part_tree(t)
    walked = graph.walk_hierarchy(tree, "id", "parent", "name")
    return graph.subtree_totals(walked, tree.withColumn("price", v.money("price")), "price")


@report("bom_explosion", """
with recursive bom as (select p_partkey // 3 as part_id, p_partkey as component_id, 1 + p_partkey % 3 as quantity from part where p_partkey > 0),
x as (select component_id, cast(quantity as bigint) as quantity, 1 as level, [part_id, component_id] as path from bom where part_id = 0 and component_id <> 0
  union all
  select b.component_id, x.quantity * b.quantity, x.level + 1, list_append(x.path, b.component_id) from x join bom b on x.component_id = b.part_id where not list_contains(x.path, b.component_id))
select component_id, cast(sum(quantity) as bigint) as total_quantity, cast(max(level) as bigint) as max_depth from x group by 1""")
def bom_explosion(t: Tables) -> DataFrame:
    return graph.explode_bom(inputs.bom(t), 0)


@report("hierarchy_check", f"""with recursive {WALK}, stored as (
  select p_partkey as id, cast(case when p_partkey = 0 then 1 else 1 + length(cast(p_partkey as varchar)) end + case when p_type = 'PROMO' then 1 else 0 end as bigint) as stored_level from part)
select s.id, stored_level, cast(level as bigint) as true_level from stored s left join walk on s.id = walk.id where stored_level is distinct from level""")
def hierarchy_check(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    level = F.when(key == 0, 1).otherwise(1 + F.length(key.cast("string"))) + F.when(F.col("p_type") == "PROMO", 1).otherwise(0)
    stored = t.part.select(key.alias("id"), F.when(key > 0, F.expr("p_partkey div 10")).alias("parent"), level.cast("long").alias("stored"))
    return graph.check_levels(stored, "id", "parent", "stored")


EDGES = """edges as (
  select 'o:' || o_orderkey as src, 'c:' || o_custkey as dst, 'order_customer' as via from orders union
  select 'p:' || l_partkey, 'o:' || l_orderkey, 'part_order' from lineitem union
  select 's:' || l_suppkey, 'p:' || l_partkey, 'supplier_part' from lineitem)"""


@report("lineage_upstream", f"""with recursive {EDGES},
up as (select 'c:' || c_custkey as node, 0 as round, cast(null as varchar) as via from customer where c_mktsegment = 'BUILDING'
  union select e.src, up.round + 1, e.via from up join edges e on e.dst = up.node )
select node, cast(min(round) as bigint) as round, min(via) as via from up group by 1""")
def lineage_upstream(t: Tables) -> DataFrame:
    start = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.trace_lineage(inputs.lineage_edges(t), start, "up")


@report("lineage_downstream", f"""with recursive {EDGES},
down as (select 's:' || s_suppkey as node, 0 as round, cast(null as varchar) as via from supplier where s_acctbal > 9500
  union select e.dst, down.round + 1, e.via from down join edges e on e.src = down.node)
select node, cast(min(round) as bigint) as round, min(via) as via from down group by 1""")
def lineage_downstream(t: Tables) -> DataFrame:
    start = t.supplier.where("s_acctbal > 9500").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.trace_lineage(inputs.lineage_edges(t), start, "down")
