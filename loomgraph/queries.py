"""A query for each operator over graphs from the driver's tables, and SQL of the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .gen import graphs
from .graph import Graph
from .operators import balls, belief, centrality, components, factors, rank, scan, sets, traversal
from .plans.loop import passing, shared_dir
from .plans.program import VertexProgram, run
from .sources import binary, text
from .streaming import feeder, online_cc

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _both(graph: Graph) -> Graph:
    return graph.simple()


def _cc_online(spark: SparkSession, d: str) -> DataFrame:
    """The ratings' edges as a stream of four files, then the labels."""
    g = fixtures.ratings(spark, d)
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = feeder.feed(g.edges, f"{at}/edges")
    query = online_cc.online_cc(feeder.stream(spark, f"{at}/edges", files), f"{at}/labels", g.num_vertices).trigger(availableNow=True).start()
    query.awaitTermination()
    return online_cc.labels(spark, f"{at}/labels", g.num_vertices)


def _written(spark: SparkSession, d: str, kind: int, compressed: bool = False) -> DataFrame:
    """The flow of users, written as a binary edge list with its descriptor, and read back."""
    ini = binary.write_graph(fixtures.user_flow(spark, d), f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}", "flow", kind, compressed=compressed)
    return binary.read_graph(spark, ini, compressed=compressed).edges


def _matrix_market(spark: SparkSession, d: str) -> DataFrame:
    g, at = fixtures.user_flow(spark, d), f"{shared_dir(spark)}/market-{uuid.uuid4().hex}"
    text.write_matrix_market(g.edges, g.num_vertices, g.num_vertices, at)
    return text.matrix_market(spark, at, weighted=True)[0]


def _pegasus(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_dir(spark)}/pegasus-{uuid.uuid4().hex}"
    text.write_pegasus(fixtures.user_flow(spark, d).edges, at)
    return text.snap(spark, at, both_ways=False).select("src", "dst")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """What each generator promises, a row for each."""
    n, v = 1 << 14, 1 << 10
    lower = lambda c, m: F.avg((F.col(c) < m).cast("double"))
    # name, graph, whether loops may be, ids of either end, and a share with its expected value
    made = [
        ("rmat", graphs.rmat(spark, 10, n), (0, v), (0, v), F.avg(((F.col("src") < v / 2) & (F.col("dst") < v / 2)).cast("double")), 0.57),
        ("erdos_renyi", graphs.erdos_renyi(spark, v, n), (0, v), (0, v), lower("dst", v / 4), 0.25),
        ("bipartite", graphs.bipartite(spark, 600, 400, n), (0, 600), (600, 1000), lower("dst", 700), 0.25),
    ]
    rows = []
    for name, g, left, right, share, expected in made:
        inside = F.min(F.col("src").between(left[0], left[1] - 1) & F.col("dst").between(right[0], right[1] - 1))
        drawn = F.min(F.col("weight").between(0, 1) & (F.col("weight") < 1))
        rows.append(g.edges.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("edges"), inside.alias("ids_inside"), drawn.alias("weights_inside"), (F.count_if(F.col("src") == F.col("dst")) == 0).alias("no_loops"), (F.abs(share - expected) < 0.02).alias("share_as_expected")))
    out = rows[0].withColumn("no_loops", F.lit(True))  # R-MAT promises nothing about loops
    return out.unionByName(rows[1]).unionByName(rows[2])


def _symmetric(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a symmetric R-MAT graph whose reverse, with its weight, isn't there: none; and how many edges there are."""
    e = graphs.rmat(spark, 10, 1 << 14, symmetric=True).edges.groupBy("src", "dst", "weight").agg(F.count(F.lit(1)).alias("n"))
    back = e.toDF("dst", "src", "weight", "_n")
    met = e.join(back, ["src", "dst", "weight"], "left")
    return met.agg(F.sum("n").alias("edges"), F.count_if(~F.col("n").eqNullSafe(F.col("_n"))).alias("without_reverse"))


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketches' estimates lie near the exact counts: the neighbourhood function's within a fifth at each hop (six standard errors of a sum), the triangles' within a half, and ALS's error below that of the mean rating."""

    def hyperanf() -> DataFrame:
        buy = fixtures.purchase_flow(spark, d)
        exact = balls.hyperanf_exact(buy, run_to_completion=True).select("t", "n")
        sketch = balls.hyperanf(buy, run_to_completion=True).select("t", F.col("n").alias("_n"))
        return exact.join(sketch, "t").agg(F.min(F.abs(F.col("_n") / F.col("n") - 1) < 0.2).alias("within"))

    def triangles() -> DataFrame:
        flow = fixtures.user_flow(spark, d)
        with passing(spark):
            exact = sets.triangles_total(sets.triangles(flow)).first()[0] or 0
        return sets.triangles_total(sets.triangles_minhash(flow)).select((F.abs(F.coalesce("triangles", F.lit(0.0)) - exact) <= 0.5 * exact).alias("within"))

    def als() -> DataFrame:
        rated = factors.dealt(fixtures.ratings(spark, d))
        mean = rated.edges.agg(F.stddev_pop("weight").alias("spread"))
        fitted = factors.als_rmse(rated, factors.als(rated)).crossJoin(mean)
        return fitted.select((F.col("rmse") < F.col("spread")).alias("within"))

    rows = []
    for part in (hyperanf, triangles, als):
        with passing(spark):  # disk holds what one part needs, not all
            rows.append((part.__name__, part().first()[0]))
    return spark.createDataFrame(rows, "name string, within boolean")


def _program_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Levels from vertex 0 by a vertex program."""
    none = F.lit(None).cast("long")
    program = VertexProgram(
        init={"level": F.when(F.col("id") == 0, F.lit(0).cast("long")).otherwise(none)},
        starts=F.col("id") == 0,
        messages={"hop": F.col("level") + 1},
        gather={"hop": F.min("hop")},
        apply={"level": F.coalesce("level", "hop")},
        active=F.col("level").isNotNull() & F.col("old_level").isNull(),
    )
    return run(fixtures.purchase_flow(spark, d), program).state.filter("level is not null").select(F.col("id").alias("vertex"), "level")


def _program_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds of ranks by a vertex program."""
    g = fixtures.user_flow(spark, d)
    shares = Graph(rank._shares(g).select("src", "dst", F.col("share").alias("weight")), g.num_vertices)
    program = VertexProgram(
        init={"rank": F.lit(1.0)},
        messages={"part": F.col("rank") * F.col("weight")},
        gather={"got": F.sum("part")},
        apply={"rank": F.lit(0.15) + 0.85 * F.coalesce("got", F.lit(0.0))},
        active=F.lit(True),
        fixed_steps=4,
    )
    return rounded(run(shares, program).state.select(F.col("id").alias("vertex"), "rank"), "rank")


def _scalar_cc(spark: SparkSession, d: str) -> DataFrame:
    return components.cc_count(components.cc(fixtures.ratings(spark, d)))


def _mcst_summary(spark: SparkSession, d: str) -> DataFrame:
    g = fixtures.purchase_flow(spark, d)
    return rounded(sets.mcst_summary(g, sets.mcst(g)), "weight", places=4)


def queries() -> dict[str, Query]:
    buy, flow, rate = fixtures.purchase_flow, fixtures.user_flow, fixtures.ratings
    beliefs = lambda s, d: fixtures.likelihoods(buy(s, d))
    return {
        "degree_cnt": lambda s, d: scan.degree_cnt(flow(s, d)),
        "pagerank": lambda s, d: rounded(rank.pagerank(flow(s, d)), "rank"),
        "pagerank_ddf": lambda s, d: rounded(rank.pagerank_ddf(buy(s, d)), "rank", "delta"),
        "conductance": lambda s, d: rounded(scan.conductance(flow(s, d)), "value"),
        "range_check": lambda s, d: scan.range_check(flow(s, d)),
        "reverse": lambda s, d: scan.reverse(flow(s, d)),
        "spmv": lambda s, d: rounded(scan.spmv(flow(s, d)), "value", places=3),
        "checkbip": lambda s, d: scan.checkbip(rate(s, d)),
        "checkbip_mixed": lambda s, d: scan.checkbip(_both(flow(s, d))),
        "bfs": lambda s, d: traversal.bfs(buy(s, d)),
        "bfs_async": lambda s, d: traversal.bfs(buy(s, d)),
        "bfs_counters": lambda s, d: traversal.bfs_counters(g := buy(s, d), traversal.bfs(g)),
        "bfs_forest": lambda s, d: traversal.bfs_forest(buy(s, d)),
        "sssp": lambda s, d: rounded(traversal.sssp(buy(s, d)), "distance", places=4),
        "sssp_forest": lambda s, d: rounded(traversal.sssp_forest(buy(s, d)), "distance", places=4),
        "cc": lambda s, d: components.cc(rate(s, d)),
        "cc_flow": lambda s, d: components.cc(buy(s, d), symmetrize=True),
        "cc_count": _scalar_cc,
        "cc_online": _cc_online,
        "scc": lambda s, d: components.scc(buy(s, d)),
        "scc_count": lambda s, d: components.scc_count(components.scc(buy(s, d))),
        "mis": lambda s, d: sets.mis(_both(buy(s, d))),
        "mcst": lambda s, d: rounded(sets.mcst(buy(s, d)), "weight", places=4),
        "mcst_summary": _mcst_summary,
        "triangles": lambda s, d: sets.triangles(flow(s, d)),
        "triangles_total": lambda s, d: sets.triangles_total(sets.triangles(flow(s, d))).select(F.col("triangles").cast("long")),
        "triangles_minhash": lambda s, d: sets.triangles_total(sets.triangles_minhash(flow(s, d))),
        "hyperanf": lambda s, d: balls.hyperanf_exact(buy(s, d), run_to_completion=True).select("t", "n"),
        "hyperanf_sketch": lambda s, d: balls.hyperanf(buy(s, d), run_to_completion=True).select("t", "n"),
        "bc": lambda s, d: rounded(centrality.bc(buy(s, d)), "centrality", places=4),
        "bc_best": lambda s, d: rounded(centrality.bc_best(centrality.bc(buy(s, d))), "centrality", places=4),
        "belief_propagation": lambda s, d: rounded(belief.belief_propagation(beliefs(s, d)), "b0", "b1"),
        "belief_propagation_graphchi": lambda s, d: rounded(belief.belief_propagation_graphchi(buy(s, d)), "belief0"),
        "als": lambda s, d: factors.als_rmse(g := factors.dealt(rate(s, d)), factors.als(g)),
        "als_async": lambda s, d: factors.als(rate(s, d)),
        "program_bfs": _program_bfs,
        "program_pagerank": _program_pagerank,
        "sort_edges": lambda s, d: scan.sort_edges(flow(s, d)),
        "rmat": lambda s, d: graphs.rmat(s, 10, 1 << 14).edges,
        "erdos_renyi": lambda s, d: graphs.erdos_renyi(s, 1 << 10, 1 << 14).edges,
        "bipartite": lambda s, d: graphs.bipartite(s, 600, 400, 1 << 14).edges,
        "generated": _generated,
        "generated_symmetric": _symmetric,
        "estimates": _estimates,
        "binary_type1": lambda s, d: _written(s, d, 1),
        "binary_type2": lambda s, d: _written(s, d, 2).select("src", "dst"),
        "compressed_type1": lambda s, d: _written(s, d, 1, compressed=True),
        "matrix_market": _matrix_market,
        "pegasus": _pegasus,
    }


_FLOW = "SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value AS weight FROM events"
_WITH = f"""WITH RECURSIVE
v AS (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS vertex),
flow AS (SELECT * FROM ({_FLOW}) WHERE dst IS NOT NULL),
buy AS (SELECT * FROM ({_FLOW} WHERE event_type = 'purchase') WHERE dst IS NOT NULL),
np AS (SELECT count(*) AS n FROM part),
tv AS (SELECT unnest(range(0, (SELECT n FROM np) + (SELECT count(*) FROM supplier))) AS vertex),
tp AS (SELECT DISTINCT l_partkey AS src, l_suppkey + (SELECT n FROM np) AS dst FROM lineitem),
trade AS (SELECT src, dst FROM tp UNION ALL SELECT dst, src FROM tp),
pairs AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(weight) AS weight FROM buy WHERE src <> dst GROUP BY ALL),
deg AS (SELECT src AS vertex, count(*) AS degree FROM flow GROUP BY ALL)"""
_MANY = 1 << 30
_BFS = """,
walk AS (SELECT 0::BIGINT AS vertex, 0::BIGINT AS level UNION SELECT b.dst, w.level + 1 FROM walk w JOIN buy b ON b.src = w.vertex WHERE w.level < 60),
lv AS (SELECT vertex, min(level) AS level FROM walk GROUP BY vertex),
bfs AS (SELECT l.vertex, l.level, CASE WHEN l.vertex = 0 THEN 0 ELSE (SELECT min(b.src) FROM buy b JOIN lv p ON p.vertex = b.src WHERE b.dst = l.vertex AND p.level = l.level - 1) END AS parent FROM lv l)"""
_REACH = """,
reach AS (SELECT vertex AS a, vertex AS b FROM v UNION SELECT r.a, e.dst FROM reach r JOIN buy e ON e.src = r.b),
root AS (SELECT b AS vertex, min(a) AS component FROM reach GROUP BY b),
strong AS (SELECT r.b AS vertex, min(r.a) AS component FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.b)"""
_DIST = """,
relax AS (SELECT vertex, CASE WHEN vertex = 0 THEN 0.0::DOUBLE END AS d, 0 AS i FROM v
  UNION ALL
  SELECT x.vertex, min(x.d), min(x.i) + 1 FROM (SELECT vertex, d, i FROM relax UNION ALL SELECT b.dst, r.d + b.weight, r.i FROM relax r JOIN buy b ON b.src = r.vertex) x WHERE x.i < 60 GROUP BY x.vertex),
dist AS (SELECT vertex, d FROM relax WHERE i = 60)"""
_TCC = """,
step AS (SELECT vertex, vertex AS component, 0 AS i FROM tv
  UNION ALL
  SELECT x.vertex, min(x.component), min(x.i) + 1 FROM (SELECT vertex, component, i FROM step UNION ALL SELECT t.dst, s.component, s.i FROM step s JOIN trade t ON t.src = s.vertex) x WHERE x.i < 40 GROUP BY x.vertex),
tcc AS (SELECT vertex, component FROM step WHERE i = 40)"""


def _pagerank(rounds: int) -> str:
    return f"""{_WITH},
r AS (SELECT vertex, 1.0::DOUBLE AS rank, 0 AS i FROM v
  UNION ALL
  SELECT x.vertex, 0.15 + 0.85 * sum(x.got), min(x.i) + 1 FROM (SELECT vertex, 0.0::DOUBLE AS got, i FROM r UNION ALL SELECT f.dst, r.rank / d.degree, r.i FROM r JOIN deg d ON d.vertex = r.vertex JOIN flow f ON f.src = r.vertex) x WHERE x.i < {rounds} GROUP BY x.vertex)
SELECT vertex, round(rank, 6) AS rank FROM r WHERE i = {rounds}"""


def _ddf(rounds: int) -> str:
    """The delta form, a step of two tables at a time."""
    out = f"{_WITH},\nbd AS (SELECT src AS vertex, count(*) AS degree FROM buy GROUP BY ALL),\ns0 AS (SELECT v.vertex, 0.15::DOUBLE AS rank, 1.0::DOUBLE AS delta, coalesce(degree, 0) AS degree FROM v LEFT JOIN bd USING (vertex))"
    for k in range(rounds):
        out += f""",
p{k} AS (SELECT vertex, delta / degree AS part FROM s{k} WHERE degree > 0 AND delta / degree > 0.5),
g{k} AS (SELECT b.dst AS vertex, sum(part) AS got FROM p{k} p JOIN buy b ON b.src = p.vertex GROUP BY ALL),
s{k + 1} AS (SELECT s.vertex, s.rank + CASE WHEN p.vertex IS NULL THEN 0 ELSE s.delta END AS rank, CASE WHEN p.vertex IS NULL THEN s.delta ELSE 0 END + 0.85 * coalesce(got, 0) AS delta, degree FROM s{k} s LEFT JOIN p{k} p USING (vertex) LEFT JOIN g{k} USING (vertex))"""
    return out + f"\nSELECT vertex, round(rank, 6) AS rank, round(delta, 6) AS delta FROM s{rounds}"


def _bp(rounds: int) -> str:
    w = "(0.1 + 0.8 * (((src * 31 + dst * 17) % 97) / 97.0::DOUBLE))"
    out = f"{_WITH},\nbe AS (SELECT src, dst, {w} AS w FROM buy),\nb_0 AS (SELECT src, dst, w AS b0, w AS b1, w AS up, 1 - w AS down FROM be UNION ALL SELECT dst, src, w, w, w, 1 - w FROM be)"
    for k in range(rounds):
        out += f""",
q_{k} AS (SELECT dst, product(b0) AS p0, product(b1) AS p1 FROM b_{k} GROUP BY dst),
a_{k} AS (SELECT b.dst AS src, b.src AS dst, up, down, 0.5 * CASE WHEN b.dst < b.src THEN up ELSE down END * (p0 / b0 + p1 / b1) AS r FROM b_{k} b JOIN q_{k} q ON q.dst = b.dst),
b_{k + 1} AS (SELECT src, dst, CASE WHEN 2 * r > 0 THEN r / (2 * r) ELSE r END AS b0, CASE WHEN 2 * r > 0 THEN r / (2 * r) ELSE r END AS b1, up, down FROM a_{k})"""
    return out + f"\nSELECT src, dst, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM b_{rounds}"


def _bp_vertex(rounds: int) -> str:
    h = "((17 + vertex) * 3428971) % 100"
    out = f"""{_WITH},
pr AS (SELECT vertex, CASE {h} WHEN 0 THEN 0.05 WHEN 1 THEN 0.95 ELSE 0.5 END::DOUBLE AS prior FROM v),
m_0 AS (SELECT e.src, e.dst, prior AS m FROM (SELECT src, dst FROM buy UNION ALL SELECT dst, src FROM buy) e JOIN pr ON pr.vertex = e.src)"""
    for k in range(rounds):
        out += f""",
l_{k} AS (SELECT vertex, prior, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1 FROM pr LEFT JOIN (SELECT dst AS vertex, sum(ln(m)) AS l0, sum(ln(1 - m)) AS l1 FROM m_{k} GROUP BY dst) USING (vertex)),
r_{k} AS (SELECT vertex, prior, greatest(prior * exp(l0 - greatest(l0, l1)), 1e-4) AS r0, greatest((1 - prior) * exp(l1 - greatest(l0, l1)), 1e-4) AS r1 FROM l_{k}),
b_{k} AS (SELECT vertex, CASE WHEN prior <> 0.5 THEN prior ELSE r0 / (r0 + r1) END AS b FROM r_{k}),
n_{k} AS (SELECT e.dst AS src, e.src AS dst, b * 0.95 / m + (1 - b) * 0.5 / (1 - m) AS m0, b * 0.05 / m + (1 - b) * 0.5 / (1 - m) AS m1 FROM m_{k} e JOIN b_{k} ON b_{k}.vertex = e.dst),
m_{k + 1} AS (SELECT src, dst, least(greatest(m0 / (m0 + m1), 1e-4), 0.9999) AS m FROM n_{k})"""
    return out + f"\nSELECT vertex, round(b, 6) AS belief0 FROM b_{rounds - 1}"


_MIS = f"""{_WITH},
sym AS (SELECT src, dst FROM pairs),
m AS (SELECT vertex, true AS in_mis, 0 AS i FROM v
  UNION ALL
  SELECT x.vertex, NOT bool_or(x.hit), min(x.i) + 1 FROM (SELECT vertex, false AS hit, i FROM m UNION ALL SELECT s.dst, true, m.i FROM m JOIN sym s ON s.src = m.vertex WHERE m.in_mis) x WHERE x.i < 60 GROUP BY x.vertex)
SELECT vertex, in_mis FROM m WHERE i = 60"""

#: An edge is in the forest unless its ends are linked by edges before it in the order.
_MCST = f"""{_WITH},
ranked AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k FROM pairs),
two AS (SELECT src, dst, k FROM ranked UNION ALL SELECT dst, src, k FROM ranked),
bottle AS (SELECT src AS a, dst AS b, k, 0 AS i FROM (SELECT src, dst, min(k) AS k FROM two GROUP BY ALL)
  UNION ALL
  SELECT a, b, min(k), min(i) + 1 FROM (SELECT a, b, k, i FROM bottle UNION ALL SELECT x.a, y.b, greatest(x.k, y.k), x.i FROM bottle x JOIN bottle y ON x.b = y.a) WHERE i < 7 GROUP BY a, b),
forest AS (SELECT r.src, r.dst, r.weight FROM ranked r JOIN bottle b ON b.a = r.src AND b.b = r.dst AND b.i = 7 AND b.k = r.k)"""

_TRIANGLES = f"""{_WITH},
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM flow WHERE src <> dst),
t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b),
tn AS (SELECT vertex, count(*) AS n FROM (SELECT a AS vertex FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY vertex)"""

_BC = f"""{_WITH}{_DIST},
dag AS (SELECT b.src, b.dst FROM buy b JOIN dist x ON x.vertex = b.src JOIN dist y ON y.vertex = b.dst WHERE abs(x.d + b.weight - y.d) <= 1e-9 AND b.src <> b.dst),
paths AS (SELECT 0::BIGINT AS vertex, 1.0::DOUBLE AS n, 0 AS i UNION ALL SELECT d.dst, sum(p.n), min(p.i) + 1 FROM paths p JOIN dag d ON d.src = p.vertex WHERE p.i < 150 GROUP BY d.dst),
sigma AS (SELECT vertex, sum(n) AS sigma FROM paths GROUP BY vertex),
back AS (SELECT vertex, 1 / sigma AS x, 0 AS i FROM sigma UNION ALL SELECT d.src, sum(b.x), min(b.i) + 1 FROM back b JOIN dag d ON d.dst = b.vertex WHERE b.i < 150 GROUP BY d.src),
bc AS (SELECT s.vertex, s.sigma * coalesce(sum(b.x) FILTER (b.i > 0), 0) AS centrality FROM sigma s LEFT JOIN back b ON b.vertex = s.vertex GROUP BY s.vertex, s.sigma)"""


def oracle_sql() -> dict[str, str]:
    bfs = f"{_WITH}{_BFS}\nSELECT vertex, level, parent FROM bfs"
    return {
        "degree_cnt": f"{_WITH}\nSELECT v.vertex, coalesce(degree, 0) AS degree FROM v LEFT JOIN deg USING (vertex)",
        "pagerank": _pagerank(5),
        "program_pagerank": _pagerank(4),
        "pagerank_ddf": _ddf(5),
        "conductance": f"{_WITH}\nSELECT round(count(*) FILTER (src % 2 <> dst % 2) / greatest(count(*) FILTER (src % 2 = 1), count(*) FILTER (src % 2 = 0)), 6) AS value FROM flow",
        "range_check": f"{_WITH}\nSELECT count(*) AS bad_edges FROM flow WHERE greatest(src, dst) > (SELECT max(vertex) FROM v)",
        "reverse": f"{_WITH}\nSELECT dst AS src, src AS dst, weight FROM flow",
        "sort_edges": f"{_WITH}\nSELECT src, dst, weight FROM flow",
        "spmv": f"{_WITH}\nSELECT v.vertex, round(coalesce(y, 0), 3) AS value FROM v LEFT JOIN (SELECT dst AS vertex, sum(weight * src) AS y FROM flow GROUP BY dst) USING (vertex)",
        "checkbip": f"{_WITH},\nrt AS (SELECT DISTINCT l_partkey AS src, l_suppkey + (SELECT n FROM np) AS dst FROM lineitem), rb AS (SELECT src, dst FROM rt UNION ALL SELECT dst, src FROM rt)\nSELECT NOT bool_or(bad) AS is_bipartite FROM (SELECT bool_or(src < dst) AND bool_or(src > dst) OR bool_or(src = dst) AS bad FROM rb GROUP BY src)",
        "checkbip_mixed": f"{_WITH},\nrb AS (SELECT src, dst FROM flow WHERE src <> dst UNION SELECT dst, src FROM flow WHERE src <> dst)\nSELECT NOT bool_or(bad) AS is_bipartite FROM (SELECT bool_or(src < dst) AND bool_or(src > dst) AS bad FROM rb GROUP BY src)",
        "bfs": bfs,
        "bfs_async": bfs,
        "program_bfs": f"{_WITH}{_BFS}\nSELECT vertex, level FROM bfs",
        "bfs_counters": f"{_WITH}{_BFS}\nSELECT count(*) - 1 AS vertices_discovered, sum((SELECT count(*) FROM buy b WHERE b.src = l.vertex))::BIGINT AS edges_explored FROM lv l",
        "bfs_forest": f"""{_WITH},
f AS (SELECT vertex, vertex AS component, vertex AS parent, 0::BIGINT AS level, 0 AS i FROM v
  UNION ALL
  SELECT vertex, least(old, coalesce(got // {_MANY}, old)), CASE WHEN got // {_MANY} < old THEN got % {_MANY} ELSE parent END, CASE WHEN got // {_MANY} < old THEN i + 1 ELSE level END, i + 1
  FROM (SELECT vertex, min(component) AS old, min(parent) AS parent, min(level) AS level, min(got) AS got, min(i) AS i
    FROM (SELECT vertex, component, parent, level, NULL::BIGINT AS got, i FROM f UNION ALL SELECT b.dst, NULL, NULL, NULL, f.component * {_MANY} + f.vertex, f.i FROM f JOIN buy b ON b.src = f.vertex) x WHERE i < 60 GROUP BY vertex))
SELECT vertex, component, parent, level FROM f WHERE i = 60""",
        "sssp": f"{_WITH}{_DIST}\nSELECT vertex, round(d, 4) AS distance, CASE WHEN vertex <> 0 THEN (SELECT min(b.src) FROM buy b JOIN dist p ON p.vertex = b.src WHERE b.dst = x.vertex AND b.src <> b.dst AND b.weight > 0 AND p.d + b.weight = x.d) END AS predecessor FROM dist x",
        "sssp_forest": f"""{_WITH}{_REACH},
f AS (SELECT r.vertex, r.component, CASE WHEN r.vertex = r.component THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS d, 0 AS i FROM root r
  UNION ALL
  SELECT x.vertex, min(x.component), min(x.d), min(x.i) + 1 FROM (SELECT vertex, component, d, i FROM f UNION ALL SELECT b.dst, f.component, f.d + b.weight, f.i FROM f JOIN buy b ON b.src = f.vertex JOIN root t ON t.vertex = b.dst AND t.component = f.component) x WHERE x.i < 60 GROUP BY x.vertex)
SELECT x.vertex, x.component, round(x.d, 4) AS distance,
  CASE WHEN x.vertex <> x.component THEN (SELECT min(b.src) FROM buy b JOIN f p ON p.vertex = b.src AND p.i = 60 AND p.component = x.component WHERE b.dst = x.vertex AND b.src <> b.dst AND b.weight > 0 AND p.d + b.weight = x.d) END AS predecessor
FROM f x WHERE x.i = 60""",
        "cc": f"{_WITH}{_TCC}\nSELECT vertex, component FROM tcc",
        "cc_flow": f"""{_WITH},
step AS (SELECT vertex, vertex AS component, 0 AS i FROM v
  UNION ALL
  SELECT x.vertex, min(x.component), min(x.i) + 1 FROM (SELECT vertex, component, i FROM step UNION ALL SELECT e.dst, s.component, s.i FROM step s JOIN (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs) e ON e.src = s.vertex) x WHERE x.i < 60 GROUP BY x.vertex)
SELECT vertex, component FROM step WHERE i = 60""",
        "cc_online": f"{_WITH}{_TCC}\nSELECT vertex, component FROM tcc",
        "cc_count": f"{_WITH}{_TCC}\nSELECT count(*) FILTER (vertex = component) AS cc_count FROM tcc",
        "scc": f"{_WITH}{_REACH}\nSELECT vertex, component FROM strong",
        "scc_count": f"{_WITH}{_REACH}\nSELECT count(*) FILTER (vertex = component) AS scc_count FROM strong",
        "mis": _MIS,
        "mcst": f"{_MCST}\nSELECT src, dst, round(weight, 4) AS weight FROM forest",
        "mcst_summary": f"{_MCST}\nSELECT count(*) AS tree_edges, (SELECT count(*) FROM v) - count(*) AS cc_count, round(sum(weight), 4) AS weight FROM forest",
        "triangles": f"{_TRIANGLES}\nSELECT v.vertex, coalesce(n, 0) AS triangles FROM v LEFT JOIN tn USING (vertex)",
        "triangles_total": f"{_TRIANGLES}\nSELECT count(*) AS triangles FROM t",
        "hyperanf": f"""{_WITH},
hop AS (SELECT vertex AS a, vertex AS b, 0 AS t FROM v UNION SELECT h.a, e.dst, h.t + 1 FROM hop h JOIN buy e ON e.src = h.b WHERE h.t < 40),
near AS (SELECT a, b, min(t) AS t FROM hop GROUP BY a, b)
SELECT s.t::BIGINT AS t, (SELECT count(*) FROM near n WHERE n.t <= s.t) AS n FROM (SELECT DISTINCT t FROM near) s""",
        "estimates": "SELECT * FROM (VALUES ('hyperanf', true), ('triangles', true), ('als', true)) t(name, within)",
        "generated": "SELECT name, 16384::BIGINT AS edges, true AS ids_inside, true AS weights_inside, true AS no_loops, true AS share_as_expected FROM (VALUES ('rmat'), ('erdos_renyi'), ('bipartite')) t(name)",
        "generated_symmetric": "SELECT 32768::BIGINT AS edges, 0::BIGINT AS without_reverse",
        "binary_type1": f"{_WITH}\nSELECT src, dst, weight::FLOAT::DOUBLE AS weight FROM flow",
        "binary_type2": f"{_WITH}\nSELECT src, dst FROM flow",
        "compressed_type1": f"{_WITH}\nSELECT src, dst, weight::FLOAT::DOUBLE AS weight FROM flow",
        "matrix_market": f"{_WITH}\nSELECT src, dst, weight FROM flow",
        "pegasus": f"{_WITH}\nSELECT src, dst FROM flow",
        "bc": f"{_BC}\nSELECT vertex, round(centrality, 4) AS centrality FROM bc",
        "bc_best": f"{_BC}\nSELECT vertex, round(centrality, 4) AS centrality FROM bc WHERE vertex <> 0 ORDER BY round(centrality, 9) DESC, vertex LIMIT 1",
        "belief_propagation": _bp(4),
        "belief_propagation_graphchi": _bp_vertex(4),
    }
