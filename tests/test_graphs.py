"""Hand-made graphs with answers by hand, seeded random graphs against plain Python, and invariants."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import from_edges
from loomgraph.operators import balls, belief, centrality, components, factors, rank, scan, sets, traversal
from loomgraph.plans import loop
from loomgraph.plans.loop import NotConverged


def graph(spark, n, edges):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
    return from_edges(spark.createDataFrame(rows, "src long, dst long, weight double"), n)


def two_way(edges):
    return [e for a, b, *w in edges for e in ((a, b, *w), (b, a, *w))]


def table(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 2 else r[1] for r in df.select(*columns).collect()}


EMPTY, LOOP = (3, []), (1, [(0, 0)])
PATH = (5, [(0, 1), (1, 2), (2, 3), (3, 4)])
CYCLE = (6, [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4)])
DIAMOND = (4, [(0, 1), (0, 2), (1, 3), (2, 3)])
CLIQUES = (7, two_way([(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6)]))
STAR = (5, two_way([(0, k) for k in range(1, 5)]))
MULTI = (2, [(0, 1, 1), (0, 1, 2)])
SQUARE = (4, two_way([(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 0, 2)]))


def test_bfs(spark):
    assert table(traversal.bfs(graph(spark, *PATH)), "vertex", "level", "parent") == {0: (0, 0), 1: (1, 0), 2: (2, 1), 3: (3, 2), 4: (4, 3)}
    assert table(traversal.bfs(graph(spark, *DIAMOND)), "vertex", "level", "parent")[3] == (2, 1)
    assert table(traversal.bfs(graph(spark, *EMPTY)), "vertex", "level") == {0: 0}
    assert traversal.bfs(graph(spark, *PATH), 9).count() == 0
    g = graph(spark, *CYCLE)
    assert tuple(traversal.bfs_counters(g, traversal.bfs(g)).first()) == (4, 5)
    assert table(traversal.bfs_forest(g), "vertex", "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}


def test_components(spark):
    assert table(components.cc(graph(spark, *CLIQUES)), "vertex", "component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 3}
    labels = components.cc(graph(spark, *PATH), symmetrize=True)
    assert components.cc_count(labels).first()[0] == 1
    assert components.cc_count(components.cc(graph(spark, *EMPTY))).first()[0] == 3
    assert table(components.scc(graph(spark, *CYCLE)), "vertex", "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}
    assert components.scc_count(components.scc(graph(spark, 2, [(0, 1)]))).first()[0] == 2
    assert table(components.scc(graph(spark, *LOOP)), "vertex", "component") == {0: 0}


def test_scans(spark):
    assert table(scan.degree_cnt(graph(spark, *MULTI)), "vertex", "degree") == {0: 2, 1: 0}
    assert scan.conductance(graph(spark, *EMPTY)).first()[0] is None
    assert scan.conductance(graph(spark, *PATH)).first()[0] == 4 / 2
    assert scan.range_check(graph(spark, 4, PATH[1])).first()[0] == 1
    with pytest.raises(ValueError, match="leave the domain"):
        scan.range_check(graph(spark, 4, PATH[1]), fail=True)
    assert table(scan.spmv(graph(spark, 3, [(1, 0, 2), (2, 0, 3)])), "vertex", "value") == {0: 8.0, 1: 0.0, 2: 0.0}
    g = graph(spark, *MULTI)
    assert sorted(map(tuple, scan.reverse(from_edges(scan.reverse(g), 2)).collect())) == sorted(map(tuple, g.edges.collect()))
    bip = lambda n, e: scan.checkbip(graph(spark, n, e)).first()[0]
    assert bip(*STAR) and bip(*EMPTY)
    assert not bip(3, two_way([(0, 1), (1, 2)])) and not bip(3, two_way([(0, 1), (1, 2), (0, 2)])) and not bip(*LOOP)
    assert [tuple(r)[:2] for r in scan.sort_edges(graph(spark, 3, [(2, 0), (1, 2), (1, 0)])).collect()] == [(1, 0), (1, 2), (2, 0)]


def test_pagerank(spark):
    close = lambda got, want: all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert close(table(rank.pagerank(graph(spark, *MULTI), 1), "vertex", "rank"), {0: 0.15, 1: 1.0})
    assert close(table(rank.pagerank(graph(spark, *CYCLE), 0), "vertex", "rank"), dict.fromkeys(range(6), 1.0))
    assert close(table(rank.pagerank(graph(spark, *EMPTY), 3), "vertex", "rank"), dict.fromkeys(range(3), 0.15))
    ddf = table(rank.pagerank_ddf(graph(spark, 2, [(0, 1)]), 5), "vertex", "rank", "delta")
    assert close({k: v[0] for k, v in ddf.items()}, {0: 1.15, 1: 0.15}) and close({k: v[1] for k, v in ddf.items()}, {0: 0.0, 1: 1.85})


def test_shortest_paths(spark):
    assert table(traversal.sssp(graph(spark, *MULTI)), "vertex", "distance", "predecessor") == {0: (0.0, None), 1: (1.0, 0)}
    got = table(traversal.sssp(graph(spark, *SQUARE)), "vertex", "distance", "predecessor")
    assert got == {0: (0.0, None), 1: (1.0, 0), 2: (3.0, 1), 3: (2.0, 0)}
    assert table(traversal.sssp(graph(spark, *EMPTY)), "vertex", "distance") == {0: 0.0, 1: None, 2: None}
    with pytest.raises(NotConverged):
        traversal.sssp(graph(spark, 2, [(0, 1, -1), (1, 0, -1)]))
    assert table(traversal.sssp_forest(graph(spark, *CYCLE)), "vertex", "component", "distance") == {0: (0, 0.0), 1: (0, 1.0), 2: (0, 2.0), 3: (0, 3.0), 4: (0, 4.0), 5: (5, 0.0)}


def test_sets(spark):
    assert {v for v, i in table(sets.mis(graph(spark, *CLIQUES)), "vertex", "in_mis").items() if i} == {0, 3}
    assert {v for v, i in table(sets.mis(graph(spark, *STAR)), "vertex", "in_mis").items() if i} == {0}
    assert sets.mis(graph(spark, *EMPTY)).filter("in_mis").count() == 3
    assert sorted(map(tuple, sets.mcst(graph(spark, *SQUARE)).collect())) == [(0, 1, 1.0), (0, 3, 2.0), (2, 3, 1.0)]
    assert sets.mcst(graph(spark, *EMPTY)).count() == 0
    counts = sets.triangles(graph(spark, *CLIQUES))
    assert table(counts, "vertex", "triangles") == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3}
    assert sets.triangles_total(counts).first()[0] == 5
    about = sets.triangles_total(sets.triangles_minhash(graph(spark, *CLIQUES), 200)).first()[0]
    assert 3.5 < about < 6.5


def written(spark, run):
    """What run returns, and the records that shuffles wrote on the way."""
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (all_.apply(k) for all_ in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for k in range(all_.size()))}
    before = seen()
    out = run()
    return out, sum(n for k, n in seen().items() if k not in before)


def test_triangles_move_lists_not_paths(spark, monkeypatch):
    random.seed(7)
    n = 120
    pairs = {(a, b) for a in range(n) for b in range(a) if random.random() < 0.6}
    g = graph(spark, n, list(pairs))
    near = {k: {a for p in pairs if k in p for a in p if a != k} for k in range(n)}
    want = {k: sum(len(near[k] & near[b]) for b in near[k]) // 2 for k in range(n)}
    monkeypatch.setattr(sets, "HELD", 1000)
    monkeypatch.setattr(sets, "AT_ONCE", 500)
    got, moved = written(spark, lambda: table(sets.triangles(g), "vertex", "triangles"))
    assert got == want
    assert moved < 20 * len(pairs)  # paths of two edges are 22 times the edges


def test_minhash_moves_minima_once_a_block(spark, monkeypatch):
    random.seed(8)
    n = 90
    pairs = sorted({(a, b) for a in range(n) for b in range(a) if random.random() < 0.5})
    g = graph(spark, n, pairs)
    monkeypatch.setattr(sets, "MINIMA", 5000)
    got, moved = written(spark, lambda: table(sets.triangles_minhash(g, 60), "vertex", "triangles"))
    e = g.simple().edges
    minima = {r.src: r.m for r in e.groupBy("src").agg(F.array(*(F.min(F.xxhash64(F.lit(0xDEADBEEF + t), F.lit(t), F.col("dst"))) for t in range(60))).alias("m")).collect()}
    near = {k: sum(k in p for p in pairs) for k in range(n)}
    want = dict.fromkeys(range(n), 0.0)
    for a, b in pairs:
        z = sum(x == y for x, y in zip(minima[a], minima[b], strict=True))
        for k in (a, b):
            want[k] += z / (z + 60) * (near[a] + near[b]) / 2
    assert all(abs(got[k] - want[k]) < 1e-9 for k in range(n))
    assert sets.triangles_minhash(g, 0).filter("triangles is not null").isEmpty()
    assert moved < 8 * len(pairs)


def test_balls(spark):
    got = balls.hyperanf_exact(graph(spark, *PATH), run_to_completion=True).collect()
    assert [(r.t, r.n) for r in got] == [(0, 5), (1, 9), (2, 12), (3, 14), (4, 15)]
    assert (got[0].seed, got[0].seed_reach) == (4, 5)
    about = balls.hyperanf(graph(spark, *PATH), run_to_completion=True).collect()
    assert all(abs(a.n - b.n) < 0.2 * b.n for a, b in zip(about, got, strict=True))


def test_balls_of_blocks_hold_no_pairs(spark, monkeypatch):
    random.seed(11)
    n, edges = 300, [(random.randrange(290), random.randrange(290)) for _ in range(500)]
    g = graph(spark, n, edges)
    reach = [{k: {k} for k in range(n)}]
    while len(reach) < 2 or reach[-1] != reach[-2]:
        reach.append({k: x | set().union(*(reach[-1][a] for a, b in edges if b == k)) for k, x in reach[-1].items()})
    series = [(t, sum(map(len, x.values()))) for t, x in enumerate(reach[:-1])]
    rows = []
    kept = balls.cut
    monkeypatch.setattr(balls, "cut", lambda df: (out := kept(df), rows.append(out.count()))[0])
    monkeypatch.setattr(balls, "SOURCES", 64)
    monkeypatch.setattr(balls, "TASKS", 2)
    monkeypatch.setattr(balls, "STEP", 7)
    got = balls.hyperanf_exact(g, run_to_completion=True).collect()
    assert [(r.t, r.n) for r in got] == series
    best = max(range(n), key=lambda k: (len(reach[-1][k]), -k))
    assert (got[0].seed, got[0].seed_reach) == (best, len(reach[-1][best]))
    assert max(rows) <= n + len(series) < series[-1][1]
    short = balls.hyperanf_exact(g, epsilon=0.2).collect()
    last = next(t for t in range(1, len(series)) if series[t][1] - series[t - 1][1] < 0.2 * series[t][1])
    assert [(r.t, r.n) for r in short] == series[: last + 1] and short[0].seed_reach == max(map(len, reach[last].values()))


def test_centrality(spark):
    assert table(centrality.bc(graph(spark, *DIAMOND)), "vertex", "centrality") == {0: 3.0, 1: 0.5, 2: 0.5, 3: 0.0}
    assert tuple(centrality.bc_best(centrality.bc(graph(spark, *DIAMOND))).first()) == (1, 0.5)
    assert table(centrality.bc(graph(spark, *EMPTY)), "vertex", "centrality") == {0: 0.0}


def test_beliefs(spark):
    g = graph(spark, 3, [(0, 1, 0.3), (1, 2, 0.6)])
    assert all(abs(r.b0 - 0.5) < 1e-12 for r in belief.belief_propagation(g, 3).collect())
    assert {r.b0 for r in belief.belief_propagation(g, 1).collect()} == {0.3, 0.6}
    assert table(belief.belief_propagation_graphchi(g, 1), "vertex", "belief0") == {0: 0.5, 1: 0.5, 2: 0.5}
    assert all(0 < b < 1 for b in table(belief.belief_propagation_graphchi(g, 4), "vertex", "belief0").values())


def test_als(spark):
    random.seed(3)
    u, v = [[random.random() for _ in range(2)] for _ in range(30)], [[random.random() for _ in range(2)] for _ in range(20)]
    edges = [(i, 30 + j, 1 + sum(a * b for a, b in zip(u[i], v[j]))) for i in range(30) for j in range(20) if random.random() < 0.7]
    g = graph(spark, 50, two_way(edges))
    found = factors.als(g, 8, reg=1e-4)
    assert found.count() == 50
    assert factors.als_rmse(g, found).first().rmse < 0.02


def test_als_is_plain_least_squares(spark):
    rng = np.random.default_rng(5)
    left, right, rank, reg, rounds = 25, 15, 5, 0.065, 5
    some = [(i, j, float(1 + 4 * rng.random())) for i in range(left) for j in range(right) if rng.random() < 0.6]
    u = {i: np.array([((i * (7919 + 104729 * k)) % 1000 + 1) / 1000 for k in range(rank)]) for i, _, _ in some}

    def solved(ratings, other):
        out = {}
        for x in {a for a, _, _ in ratings}:
            f = np.array([other[b] for a, b, _ in ratings if a == x])
            r = np.array([r for a, _, r in ratings if a == x])
            out[x] = np.linalg.solve(f.T @ f + reg * len(r) * np.eye(rank), f.T @ r)
        return out

    for _ in range(rounds):
        v = solved([(j, i, r) for i, j, r in some], u)
        u = solved(some, v)
    g = graph(spark, left + right, two_way([(i, left + j, r) for i, j, r in some]))
    found = factors.als(g, rounds)
    got = {r.vertex: np.array(r.factor) for r in found.collect()}
    want = u | {left + j: x for j, x in v.items()}
    assert got.keys() == want.keys() and max(np.abs(got[k] - want[k]).max() for k in want) < 1e-9
    row = factors.als_rmse(g, found).first()
    assert row.ratings == len(some) and abs(row.rmse - np.sqrt(np.mean([(r - u[i] @ v[j]) ** 2 for i, j, r in some]))) < 1e-9


def test_als_moves_factors_once_a_block(spark, monkeypatch):
    edges = [(i, 60 + j, float(1 + (i * j) % 5)) for i in range(60) for j in range(50) if i == 0 or (i + j) % 3]
    g = graph(spark, 110, two_way(edges))
    whole = factors.als(g, 2)
    want = table(whole, "vertex", "factor")
    error = factors.als_rmse(g, whole).first()
    monkeypatch.setattr(factors, "HELD", 400)
    got, moved = written(spark, lambda: table(factors.als(met := factors.dealt(g), 6), "vertex", "factor") and met)
    assert got.edges.select("block").distinct().count() > 3 and got.edges.count() == len(edges)
    assert moved < 6 * len(edges)  # a row a rating each half-round would be twelve times
    monkeypatch.setattr(factors, "HELD", 20)  # now vertices are cut into parts
    assert got.edges.select("part").distinct().count() < factors.dealt(g).edges.select("part").distinct().count()
    parted = factors.als(g, 2)
    assert all(np.allclose(x, want[k], atol=1e-9) for k, x in table(parted, "vertex", "factor").items())
    row = factors.als_rmse(g, parted).first()
    assert row.ratings == error.ratings == len(edges) and abs(row.rmse - error.rmse) < 1e-9
    assert factors.als(graph(spark, *EMPTY)).count() == 0 and factors.als_rmse(graph(spark, *EMPTY), whole).first().ratings == 0


def test_spanning_forest_of_a_long_path(spark):
    n = 300  # each round halves it: many rounds and jumps
    edges = two_way([(k, k + 1, (k * 7919) % 101 + 1) for k in range(n - 1)] + [(0, n - 1, 1000)])
    assert sets.mcst(graph(spark, n, edges)).count() == n - 1


def test_estimates_stay_short_through_many_rounds(spark):
    state = loop.cut(spark.range(3).select("id", F.col("id").alias("up")))
    for _ in range(14):  # unchecked, the estimate's digits double each round
        state = loop.cut(state.join(state.toDF("up", "_u"), "up").select("id", F.col("_u").alias("up")))
        assert loop._estimate_bits(state) <= 2 * loop.LONGEST + 64
    assert sorted(map(tuple, state.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_hubs_are_cut_into_parts(spark, monkeypatch):
    edges = [(0, k, 1 + k % 3) for k in range(1, 25)] + [(k, k // 2, 2) for k in range(1, 25)] + [(3, 0, 1)] * 9
    g = graph(spark, 25, edges)
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    asked = lambda: [rows(f(g)) for f in (traversal.bfs, traversal.sssp, rank.pagerank, components.cc, components.scc)]
    want = asked()
    monkeypatch.setattr(loop, "HUB", 4)
    assert loop.Dealt(g.edges).hubs.count() == 2
    assert asked() == want


def test_tasks_of_a_loop_dont_grow(spark, monkeypatch, tmp_path):
    from loomgraph import fixtures
    from loomgraph.streaming import feeder

    monkeypatch.setattr(loop, "ROWS", 50)
    monkeypatch.setattr(feeder, "ROWS", 50)
    edges = [(a, b) for a in range(40) for b in range(a % 7, 40, 3)]
    g = graph(spark, 40, two_way(edges) * 2)
    dealt = loop.Dealt(g.edges.select("src", "dst"), distinct=True)
    assert dealt.edges.count() == len(set(two_way(edges))) and dealt.edges.rdd.getNumPartitions() >= 4 * len(edges) // 50
    assert components.cc_count(components.cc(g)).first()[0] == 1
    at = f"file://{tmp_path}"
    files = feeder.feed(g.edges, f"{at}/edges")
    assert files == -(-g.edges.count() // 200) and len(spark.read.parquet(f"{at}/edges").inputFiles()) > 8
    assert feeder.stream(spark, f"{at}/edges", files).isStreaming
    spark.range(500).selectExpr("id % 50 as l_partkey", "id % 9 as l_suppkey", "1.0d as l_quantity").write.parquet(f"{at}/lineitem.parquet")
    spark.range(50).write.parquet(f"{at}/part.parquet")
    spark.range(9).write.parquet(f"{at}/supplier.parquet")
    assert fixtures.ratings(spark, at).edges.rdd.getNumPartitions() == 10


def random_graph(seed):
    random.seed(seed)
    n = random.randint(2, 12)
    return n, [(random.randrange(n), random.randrange(n), random.randint(1, 4)) for _ in range(random.randint(0, 20))]


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_python(spark, seed):
    n, edges = random_graph(seed)
    g = graph(spark, n, edges)
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a, b, _w in edges:
            for x in range(n):
                if a in reach[x]:
                    reach[x].add(b)
    assert table(traversal.bfs_forest(g), "vertex", "component") == {b: min(a for a in range(n) if b in reach[a]) for b in range(n)}
    assert table(components.scc(g), "vertex", "component") == {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}
    dist, todo = {}, [(0.0, 0)]
    while todo:
        d, a = heapq.heappop(todo)
        if a not in dist:
            dist[a] = d
            for x, b, w in edges:
                if x == a:
                    heapq.heappush(todo, (d + w, b))
    assert table(traversal.sssp(g), "vertex", "distance") == {a: dist.get(a) for a in range(n)}
    inside = set()
    both = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    for a in range(n):
        if not any((a, b) in both for b in inside):
            inside.add(a)
    assert {v for v, i in table(sets.mis(g.simple()), "vertex", "in_mis").items() if i} == inside
    forest = sets.mcst(g).collect()
    labels = components.cc(g, symmetrize=True)
    assert len(forest) == n - components.cc_count(labels).first()[0]
    parent, weight = list(range(n)), 0
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            weight += w
    assert sum(r.weight for r in forest) == weight
    assert sum(table(scan.degree_cnt(g), "vertex", "degree").values()) == len(edges)


def test_aggregates(spark):
    from loomgraph.functions import any_of, greatest_by, least_by, sum_at_least

    df = spark.createDataFrame([(1, 2.0, 5), (1, 1.0, 7), (1, 1.0, 3), (2, 4.0, 1)], "k long, d double, n long")
    assert {r.k: (r.b.d, r.b.n) for r in df.groupBy("k").agg(least_by("d", "n").alias("b")).collect()} == {1: (1.0, 3), 2: (4.0, 1)}
    assert {r.k: (r.d, r.total) for r in sum_at_least(df, "k", "d", "n").collect()} == {1: (1.0, 10), 2: (4.0, 1)}
    assert df.agg(greatest_by("n", "d", "k").alias("x"), any_of(df.n > 6).alias("y")).first()[:] == (1, True)


def test_what_a_part_cuts_goes_at_its_end(spark):
    from pathlib import Path

    loop.checkpoint_dir(spark)
    at = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    files = lambda: {p for p in at.rglob("part-*")}
    before = files()
    with loop.passing(spark):
        g = graph(spark, *CLIQUES)
        one = loop.cut(g.edges.select("src", "dst"))
        assert files() > before
        loop.drop(one)
        assert files() == before
        assert balls.hyperanf(g, run_to_completion=True).count() > 1
        assert factors.als(factors.dealt(g), niters=2).count() > 0
        assert files() > before
    assert files() == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
