"""Every algorithm by its name, over a described edge list."""

import pytest

from loomgraph.__main__ import ALGORITHMS, main
from loomgraph.gen import graphs
from loomgraph.graph import Graph
from loomgraph.sources import binary


@pytest.fixture(scope="module")
def ini(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("cli")
    g = graphs.bipartite(spark, 12, 8, 40, symmetric=True, seed=3)
    edges = g.edges.selectExpr("src", "dst", "0.1 + 0.8 * weight as weight")
    return binary.write_graph(Graph(edges, 20), f"file://{where}", "g")


@pytest.mark.parametrize("name", sorted(ALGORITHMS))
def test_runs(spark, ini, name, capsys):
    out = main(["-b", name, "-g", ini, "--niters", "2", "--trials", "5", "--maxiters", "4"], spark)
    assert out.columns and f"{name} seconds=" in capsys.readouterr().out


def test_reverse_writes_an_edge_list(spark, ini, tmp_path):
    main(["-b", "reverse", "-g", ini, "-o", f"file://{tmp_path}/back"], spark)
    there, back = binary.read_graph(spark, ini), binary.read_graph(spark, f"file://{tmp_path}/back.ini")
    assert there.reverse().edges.exceptAll(back.edges).isEmpty() and back.edges.count() == there.edges.count()


def test_a_line_of_timings(spark, ini, tmp_path):
    for _ in range(2):
        main(["-b", "degree_cnt", "-g", ini, "--filename", str(tmp_path / "times.csv")], spark)
    rows = [list(map(float, x.split(","))) for x in (tmp_path / "times.csv").read_text().splitlines()]
    assert len(rows) == 2 and all(0 <= setup <= wall for setup, wall in rows)


def test_reads_compressed_lists(spark, ini, tmp_path):
    g = binary.read_graph(spark, ini)
    packed = binary.write_graph(g, f"file://{tmp_path}", "z", compressed=True)
    plain, out = main(["-b", "degree_cnt", "-g", ini], spark), main(["-b", "degree_cnt", "-g", packed, "--compressed"], spark)
    assert plain.exceptAll(out).isEmpty() and out.exceptAll(plain).isEmpty()
