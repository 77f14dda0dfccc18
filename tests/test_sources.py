"""Formats, generators, the stream of edges, and the queries against their SQL."""

from __future__ import annotations

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from loomgraph.gen import graphs
from loomgraph.graph import from_edges
from loomgraph.operators import components
from loomgraph.queries import oracle_sql, queries
from loomgraph.sources import binary, text
from loomgraph.streaming import online_cc

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("wide", [False, True])
def test_binary_round_trip(spark, tmp_path, kind, wide, monkeypatch):
    monkeypatch.setattr(binary, "RANGE", 100)
    g = graphs.erdos_renyi(spark, 100, 500, seed=4)
    ini = binary.write_graph(g, f"file://{tmp_path}", "g", kind, wide)
    back = binary.read_graph(spark, ini, wide)
    assert back.num_vertices == 100
    single = lambda w: None if kind == 2 else w if wide else float(np.float32(w))
    assert sorted(map(tuple, back.edges.collect()), key=str) == sorted(((a, b, single(w)) for a, b, w in g.edges.collect()), key=str)


def test_binary_refuses(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\0" * 13)
    with pytest.raises(Exception, match="number of records"):
        binary.read_edges(spark, f"file://{tmp_path}/x.bin").count()
    np.array([(1 << 63, 1)], binary.record(2, True)).tofile(tmp_path / "y.bin")
    with pytest.raises(Exception, match="ids above"):
        binary.read_edges(spark, f"file://{tmp_path}/y.bin", 2, True).count()
    assert binary.read_descriptor(binary.descriptor("g", 2, 5, 7)) == {"type": 2, "name": "g", "vertices": 5, "edges": 7}


@pytest.mark.parametrize("kind", [1, 2])
def test_compressed_round_trip(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(binary, "PIECE", 100)
    g = graphs.erdos_renyi(spark, 100, 700, seed=4)
    ini = binary.write_graph(g, f"file://{tmp_path}", "g", kind, True, compressed=True)
    parts = sorted((tmp_path / "g").glob("part-*.bin"))
    back = binary.read_graph(spark, ini, True, compressed=True)
    want = sorted(((a, b, None if kind == 2 else w) for a, b, w in g.edges.collect()), key=str)
    assert sorted(map(tuple, back.edges.collect()), key=str) == want
    whole = b"".join(p.read_bytes() for p in parts)  # streams after each other are one list
    (tmp_path / "one.bin").write_bytes(whole)
    assert sorted(map(tuple, binary.read_compressed(spark, f"file://{tmp_path}/one.bin", kind, True).collect()), key=str) == want
    (tmp_path / "short.bin").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends within a"):
        binary.read_compressed(spark, f"file://{tmp_path}/short.bin", kind, True).count()


def test_matrix_market_in_parts(spark, tmp_path):
    (tmp_path / "mm").mkdir()
    (tmp_path / "mm/b.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% made by hand\n9 9 300\n")
    (tmp_path / "mm/a.mtx").write_text("".join(f"{k % 9 + 1} {k % 7 + 1} 0.5\n" for k in range(300)))
    df, shape = text.matrix_market(spark, f"file://{tmp_path}/mm", weighted=True)
    assert shape == {"rows": 9, "columns": 9, "entries": 300} and df.count() == 300 and df.filter("src > 8 or dst > 6 or weight <> 0.5").isEmpty()


def test_text_formats(spark, tmp_path):
    ends = lambda df: sorted((r.src, r.dst) for r in df.collect())
    write = lambda name, body: (tmp_path / name).write_text(body) and f"file://{tmp_path}/{name}"
    mm = write("a.mtx", "%%MatrixMarket x\n% c\n3 3 2\n1 2 0.5\n3 1 2\n")
    df, shape = text.matrix_market(spark, mm, weighted=True)
    assert sorted(map(tuple, df.collect())) == [(0, 1, 0.5), (2, 0, 2.0)] and shape == {"rows": 3, "columns": 3, "entries": 2}
    assert all(0 <= r.weight < 1 for r in text.matrix_market(spark, mm)[0].collect())
    snap = write("b.txt", "# c\n0\t1\n1\t2\n")
    assert ends(text.snap(spark, snap)) == [(0, 1), (1, 0), (1, 2), (2, 1)] and ends(text.snap(spark, snap, False)) == [(0, 1), (1, 2)]
    assert ends(text.twitter(spark, write("c.txt", "% c\n1 2\n3 1\n"))) == [(0, 1), (2, 0)]
    assert ends(text.adjacency(spark, write("d.txt", "0 x 1 2\n3 x\n2 x 0\n"), False)) == [(0, 1), (0, 2), (2, 0)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1").write_text("1:\n70,3,2005-01-01\n9,5,2005-01-01\n")
    (tmp_path / "r/2").write_text("2:\n9,1,2005-01-01\n")
    df, users, items = text.ratings(spark, f"file://{tmp_path}/r")
    assert (users, items) == (2, 2)
    assert sorted(map(tuple, df.filter("src < dst").collect())) == [(0, 2, 5.0), (0, 3, 1.0), (1, 2, 3.0)] and df.count() == 6
    text.write_matrix_market(df, 4, 4, f"file://{tmp_path}/mm")
    assert text.matrix_market(spark, f"file://{tmp_path}/mm", weighted=True)[1]["entries"] == 6
    text.write_pegasus(df, f"file://{tmp_path}/p")
    assert ends(text.snap(spark, f"file://{tmp_path}/p", False)) == ends(df)


def test_generators(spark):
    a, b = graphs.rmat(spark, 6, 400, seed=2), graphs.rmat(spark, 6, 400, seed=2)
    assert a.edges.repartition(7).exceptAll(b.edges).isEmpty() and a.num_vertices == 64
    assert a.edges.filter("src >= 64 or dst >= 64 or src < 0 or dst < 0 or weight < 0 or weight >= 1").isEmpty()
    assert not graphs.rmat(spark, 6, 400, seed=3).edges.exceptAll(a.edges).isEmpty()
    share = a.edges.filter("src < 32 and dst < 32").count() / 400
    assert 0.45 < share < 0.7
    assert graphs.rmat(spark, 6, 50, symmetric=True).edges.count() == 100
    assert graphs.erdos_renyi(spark, 5, 300).edges.filter("src = dst").isEmpty()
    assert not graphs.erdos_renyi(spark, 5, 300, self_loops=True).edges.filter("src = dst").isEmpty()
    assert graphs.bipartite(spark, 4, 6, 100).edges.filter("src >= 4 or dst < 4 or dst >= 10").isEmpty()


def test_online_components_and_replay(spark, tmp_path):
    g = graphs.erdos_renyi(spark, 60, 50, symmetric=True, seed=5)
    g.edges.select("src", "dst").repartition(4, "weight").write.parquet(f"{tmp_path}/edges")
    stream = lambda: spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/edges")
    state = f"file://{tmp_path}/labels"
    online_cc.online_cc(stream(), state, 60).trigger(availableNow=True).start().awaitTermination()
    want = {r.vertex: r.component for r in components.cc(g).collect()}
    assert {r.vertex: r.component for r in online_cc.labels(spark, state, 60).collect()} == want
    last = max(online_cc.versions_of(spark, state))
    os.remove(f"{tmp_path}/labels/progress/commits/{last}")  # as if the last batch had failed after its write
    os.remove(f"{tmp_path}/labels/progress/commits/.{last}.crc")
    online_cc.online_cc(stream(), state, 60).trigger(availableNow=True).start().awaitTermination()
    assert {r.vertex: r.component for r in online_cc.labels(spark, state, 60).collect()} == want


def test_edges_of_a_graph(spark):
    g = from_edges(spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (1, 1, 5.0)], "src int, dst int, weight double"), 3)
    assert [tuple(r) for r in g.pairs().collect()] == [(0, 1, 1.0)]
    assert g.simple().edges.count() == 2 and g.both_ways().edges.count() == 6


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    import pandas as pd

    got, want = queries()[name](spark, D).toPandas(), duck.sql(oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda df: df[columns].sort_values(columns, ignore_index=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
