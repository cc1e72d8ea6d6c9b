"""DuckDB SQL of the operators that SQL can express: plain Lloyd rounds and plain all-anchors search."""

from __future__ import annotations

from shelfwise.llm import clustering as c
from shelfwise.llm import negatives as n

_FINITE = "embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"


def _floor_div(total: str, count: str) -> str:
    """floor(total / count) of whole numbers, count > 0, also for negative totals."""
    return f"(({total}) - ((({total}) % ({count})) + ({count})) % ({count})) // ({count})"


def clusters() -> str:
    """Every round assigns all vectors to all centroids; no bounds."""
    parts = [f"""kept as materialized (
  select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = {c.COMPONENTS} and {_FINITE}),
cells as materialized (
  select r, unnest(generate_series(1, {c.COMPONENTS})) as p, cast(floor({c.SCALE} * cast(unnest(embedding) as double)) as bigint) as x from kept),
c0 as materialized (
  select s.j, cells.p, cells.x from cells join (
    select r, row_number() over (order by sha256('{c.SEED}:' || cast(vec_id as varchar)) nulls last, cast(embedding as double[])) - 1 as j
    from kept qualify j < {c.K}) s on s.r = cells.r)"""]

    def near(t: int) -> str:
        return f"""a{t} as materialized (
  select r, j, d from (select cells.r, c{t}.j, sum((cells.x - c{t}.x) * (cells.x - c{t}.x)) as d from cells join c{t} on c{t}.p = cells.p group by 1, 2)
  qualify row_number() over (partition by r order by d, j) = 1)"""

    for t in range(c.ROUNDS):
        parts += [near(t), f"""c{t + 1} as materialized (
  select c{t}.j, c{t}.p, coalesce(m.x, c{t}.x) as x from c{t} left join (
    select a{t}.j, cells.p, cast({_floor_div('sum(cells.x)', 'count(*)')} as bigint) as x from a{t} join cells on cells.r = a{t}.r group by 1, 2) m
  on m.j = c{t}.j and m.p = c{t}.p)"""]
    return "with " + ",\n".join([*parts, near(c.ROUNDS), f"""hashes as (
  select j, sha256(string_agg(cast(x as varchar), ',' order by p)) as h from c{c.ROUNDS} group by j)"""]) + f"""
select kept.vec_id, cast(a.j as integer) as cluster, cast(a.d as bigint) as distance,
  cast(sum(a.d) over (partition by a.j) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, hashes.h as centroid_sha256
from a{c.ROUNDS} a join kept on kept.r = a.r join hashes on hashes.j = a.j"""


def hard_negatives() -> str:
    """Every anchor against every row; no tree."""
    return f"""with rows as materialized (
  select vec_id, case when vec_id % {n.RELABEL_EVERY} = 0 then (label + 1) % {n.LABELS} else label end as label,
    [floor({n.SCALE} * cast(x as double)) for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and {_FINITE}),
anchors as (select vec_id as a, label, v from rows where vec_id % {n.ANCHOR_EVERY} = 0),
scores as materialized (
  select a, vec_id, rows.label = anchors.label as same, cast(list_dot_product(anchors.v, rows.v) as bigint) as s
  from anchors join rows on len(rows.v) = len(anchors.v) and rows.vec_id <> a),
positives as (
  select a, vec_id, s from scores where same qualify row_number() over (partition by a order by s desc, vec_id) <= {n.POSITIVES})
select p.a as anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.a, p.vec_id order by o.s desc, o.vec_id) as integer) as rank,
  o.vec_id as negative_id, p.s as positive_score, o.s as negative_score
from positives p join scores o on o.a = p.a and not o.same and {n.LOWEST_PERCENT} * p.s <= 100 * o.s and 100 * o.s <= {n.HIGHEST_PERCENT} * p.s
qualify rank <= {n.NEGATIVES}"""


ORACLE_SQL = {"op11_ns_bounds_clusters": clusters(), "op12_cover_tree_negatives": hard_negatives()}
