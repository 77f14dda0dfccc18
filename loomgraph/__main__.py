"""python -m loomgraph -b ALGORITHM -g GRAPH.ini [-o FOLDER]: an algorithm over a described binary edge list.

Prints the summary rows and the seconds; -o writes the vertices' (or edges')
rows as Parquet. --filename appends a line with the seconds of setting up and
of everything, with a comma between, to a local file. Paths are those of
Spark's file systems.
"""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import balls, belief, centrality, components, factors, rank, scan, sets, traversal
from .plans.loop import checkpoint_dir
from .sources.binary import read_graph, write_graph
from .streaming import feeder, online_cc

Made = tuple[DataFrame, DataFrame | None]


def _bfs(g: Graph, o: argparse.Namespace) -> Made:
    out = traversal.bfs(g, o.root)
    return out, traversal.bfs_counters(g, out)


def _online(g: Graph, o: argparse.Namespace) -> Made:
    spark = g.spark
    checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    files = feeder.feed(g.edges, f"{at}/edges", o.batches)
    online_cc.online_cc(feeder.stream(spark, f"{at}/edges", files), f"{at}/labels", g.num_vertices).trigger(availableNow=True).start().awaitTermination()
    out = online_cc.labels(spark, f"{at}/labels", g.num_vertices)
    return out, components.cc_count(out)


def _als(g: Graph, o: argparse.Namespace) -> Made:
    out = factors.als(g, o.niters)
    return out, factors.als_rmse(g, out)


def _reverse(g: Graph, o: argparse.Namespace) -> Made:
    out = g.reverse()
    if o.output and not o.parquet:
        folder, name = o.output.rsplit("/", 1)
        write_graph(out, folder, name, o.type)
    return out.edges, None


def _with(summary: Callable[[DataFrame], DataFrame], f: Callable[[Graph, argparse.Namespace], DataFrame]) -> Callable[[Graph, argparse.Namespace], Made]:
    def run(g: Graph, o: argparse.Namespace) -> Made:
        out = f(g, o)
        return out, summary(out)

    return run


def _mcst(g: Graph, o: argparse.Namespace) -> Made:
    out = sets.mcst(g)
    return out, sets.mcst_summary(g, out)


def _bc(g: Graph, o: argparse.Namespace) -> Made:
    out = centrality.bc(g, o.source)
    return out, centrality.bc_best(out, o.source)


ALGORITHMS: dict[str, Callable[[Graph, argparse.Namespace], Made]] = {
    "bfs": _bfs,
    "bfs_async": _bfs,
    "bfs_forest": lambda g, o: (traversal.bfs_forest(g), None),
    "degree_cnt": lambda g, o: (scan.degree_cnt(g), None),
    "conductance": lambda g, o: (scan.conductance(g),) * 2,
    "range_check": lambda g, o: (scan.range_check(g, fail=True),) * 2,
    "reverse": _reverse,
    "spmv": lambda g, o: (scan.spmv(g), None),
    "sssp": lambda g, o: (traversal.sssp(g, o.source), None),
    "sssp_forest": lambda g, o: (traversal.sssp_forest(g), None),
    "cc": _with(components.cc_count, lambda g, o: components.cc(g)),
    "cc_online": _online,
    "als": _als,
    "als_async": _als,
    "checkbip": lambda g, o: (scan.checkbip(g),) * 2,
    "mis": _with(lambda d: d.agg(F.count_if(~F.col("in_mis")).alias("not_in_mis")), lambda g, o: sets.mis(g)),
    "pagerank": lambda g, o: (rank.pagerank(g, o.niters), None),
    "pagerank_ddf": lambda g, o: (rank.pagerank_ddf(g, o.niters), None),
    "belief_propagation": lambda g, o: (belief.belief_propagation(g, o.niters), None),
    "belief_propagation_graphchi": lambda g, o: (belief.belief_propagation_graphchi(g, o.niters), None),
    "mcst": _mcst,
    "hyperanf": lambda g, o: (balls.hyperanf(g, o.maxiters, o.epsilon, o.rsd, o.run_to_completion),) * 2,
    "scc": _with(components.scc_count, lambda g, o: components.scc(g)),
    "triangle_counting": _with(sets.triangles_total, lambda g, o: sets.triangles_minhash(g, o.trials) if o.trials else sets.triangles(g)),
    "bc": _bc,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomgraph", description=__doc__)
    p.add_argument("-b", "--benchmark", choices=sorted(ALGORITHMS), required=True)
    p.add_argument("-g", "--graph", required=True, help="path or URI of the descriptor")
    p.add_argument("-o", "--output", help="where rows are written")
    p.add_argument("--wide", action="store_true", help="8-byte ids and weights")
    p.add_argument("--compressed", action="store_true", help="the edge list is made of zlib streams")
    p.add_argument("--filename", help="a local file that gets a line of timings")
    p.add_argument("--root", type=int, default=0)
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--niters", type=int, default=5)
    p.add_argument("--trials", type=int, default=100, help="of triangle_counting; 0 counts exactly")
    p.add_argument("--maxiters", type=int, default=100)
    p.add_argument("--epsilon", type=float, default=0.001)
    p.add_argument("--rsd", type=float, default=0.10)
    p.add_argument("--run-to-completion", action="store_true")
    p.add_argument("--batches", type=int, default=4, help="files of cc_online's stream")
    p.add_argument("--type", type=int, default=1, help="of the edge list that reverse writes")
    p.add_argument("--parquet", action="store_true", help="reverse writes Parquet")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    o = parser().parse_args(args)
    began = time.perf_counter()
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    path = o.graph if "://" in o.graph else f"file://{o.graph}"
    graph = read_graph(spark, path, o.wide, o.compressed)
    setup = time.perf_counter() - began
    out, summary = ALGORITHMS[o.benchmark](graph, o)
    if o.output and (o.benchmark != "reverse" or o.parquet):
        out.write.parquet(o.output)
    else:
        out.write.format("noop").mode("overwrite").save()
    for row in summary.collect() if summary is not None else ():
        print(o.benchmark, *(f"{k}={v}" for k, v in row.asDict().items()))
    wall = time.perf_counter() - began
    print(f"{o.benchmark} seconds={wall:.3f}")
    if o.filename:
        with open(o.filename, "a") as f:
            f.write(f"{setup:.6f},{wall:.6f}\n")
    return out


if __name__ == "__main__":
    main()
