import pytest
from helpers import A, build

from gridloom.errors import ReaderError, WriterError
from gridloom.model import Dense1D, Graph, HyperGraph
from gridloom.sources import edge_list, metis, mtx, patoh, sbff

#: The entries of the format examples.
BASE = [(1, 0, 0.1), (2, 1, 0.3), (3, 0, 0.2), (4, 2, 0.4), (4, 3, 0.5)]
VECTOR = [0, 0.1, 0, 0.3, 0.2, 0.4, 0, 0, 0.5, 0]


def triples(m):
    return sorted(map(tuple, m.nz.collect()))


@pytest.fixture
def put(tmp_path):
    def write(text):
        p = tmp_path / "file"
        p.write_text(text)
        return str(p)

    return write


def coordinate(symmetry="general", field="real", rows=BASE, extra=""):
    rows = rows if field != "pattern" else [r[:2] for r in rows]
    lines = [" ".join([str(r[0] + 1), str(r[1] + 1), *map(str, r[2:])]) for r in rows]
    return f"%%MatrixMarket matrix coordinate {field} {symmetry}\n% a comment\n\n5 5 {len(rows)}\n{extra}" + "\n".join(lines) + "\n"


def test_coordinate(spark, put):
    assert triples(mtx.read_mtx(spark, put(coordinate()))) == BASE
    assert triples(mtx.read_mtx(spark, put(coordinate(field="pattern")))) == [r[:2] for r in BASE]
    m = mtx.read_mtx(spark, put(coordinate()), zero_based=False)
    assert triples(m) == [(i + 1, j + 1, v) for i, j, v in BASE] and m.dimensions == (5, 5)


def test_an_entry_that_looks_like_the_size_line(spark, put):
    rows = [(4, 4, 3), (4, 4, 3), (0, 1, 2)]
    assert triples(mtx.read_mtx(spark, put(coordinate(field="integer", rows=rows)))) == sorted(rows)


def test_symmetries(spark, put):
    sym = [(0, 0, 0.7), *BASE]
    want = sorted(sym + [(j, i, v) for i, j, v in BASE])
    assert triples(mtx.read_mtx(spark, put(coordinate("symmetric", rows=sym)))) == want
    assert triples(mtx.read_mtx(spark, put(coordinate("symmetric", rows=sym)), upper_triangle=True)) == sorted((min(i, j), max(i, j), v) for i, j, v in sym)
    assert triples(mtx.read_mtx(spark, put(coordinate("skew-symmetric")))) == sorted(BASE + [(j, i, -v) for i, j, v in BASE])
    with pytest.raises(Exception, match="diagonal"):
        mtx.read_mtx(spark, put(coordinate("skew-symmetric", rows=sym))).nz.collect()


def test_arrays_and_vectors(spark, put):
    dense = [[0.0] * 5 for _ in range(5)]
    for i, j, v in BASE:
        dense[i][j] = v
    text = "%%MatrixMarket matrix array real general\n5 5\n" + "\n".join(str(dense[i][j]) for j in range(5) for i in range(5))
    assert triples(mtx.read_mtx(spark, put(text))) == BASE
    some = [(k, v) for k, v in enumerate(VECTOR) if v]
    forms = ["%%MatrixMarket matrix array real general\n10 1\n" + "\n".join(map(str, VECTOR)), "%%MatrixMarket matrix array real general\n1 10\n" + "\n".join(map(str, VECTOR))]
    forms += ["%%MatrixMarket matrix coordinate real general\n10 1 5\n" + "\n".join(f"{k + 1} 1 {v}" for k, v in some), "%%MatrixMarket matrix coordinate real general\n1 10 5\n" + "\n".join(f"1 {k + 1} {v}" for k, v in some)]
    for text in forms:
        x = mtx.read_mtx_vector(spark, put(text))
        assert x.length == 10 and [r["v"] for r in x.data.orderBy("idx").collect()] == VECTOR


def test_arrays_are_written_and_read_by_blocks(spark, put, tmp_path, monkeypatch):
    ordered, write = [], mtx.write_lines
    monkeypatch.setattr(mtx, "write_lines", lambda df, *a: ordered.append(df.count()) or write(df, *a))
    rows, at = [(0, 0, 1.5), (299, 217, -2.0), (299, 218, 4.0), (0, 219, 5.0), (299, 299, 3.0)], str(tmp_path / "a")
    mtx.write_mtx(build(spark, rows, 300), at, "array")
    assert ordered[0] <= 4  # the cells themselves need no ordering
    assert spark.read.text(at).count() == 300 * 300 + 2 and triples(mtx.read_mtx(spark, at)) == sorted(rows)
    body = ["0", "1.5 ", "", "% note", "0.0", "\t-2", " 3 2", "0.1", "00"]
    for step in (1, 3, 7, 1 << 24):
        monkeypatch.setattr("gridloom.sources.text.RANGE_BYTES", step)
        for end in ("\n", "\r\n", "\r"):
            for last in ("", end):
                m = mtx.read_mtx(spark, put(end.join(["%%MatrixMarket matrix array real general", "3 2", *body]) + last))
                assert triples(m) == [(0, 1, -2.0), (1, 0, 1.5), (1, 1, 0.1)]


@pytest.mark.parametrize("text", ["", "5 5 1\n1 1 1\n", "%%MatrixMarket vector coordinate real general\n5 1\n", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1\n", "%%MatrixMarket matrix coordinate real hermitian\n1 1 1\n", "%%MatrixMarket matrix array pattern general\n1 1\n", "%%MatrixMarket matrix coordinate real general\n% no size\n", "%%MatrixMarket matrix coordinate real general\n5 5\n"])
def test_bad_headers(spark, put, text):
    with pytest.raises(ReaderError):
        mtx.read_mtx(spark, put(text))


@pytest.mark.parametrize("single", [False, True])
def test_mtx_round_trips(spark, tmp_path, single):
    at = str(tmp_path / "out")
    m = build(spark, BASE, 5)
    for form in mtx.FORMATS:
        mtx.write_mtx(m, at + form, form, single=single)
        back = mtx.read_mtx(spark, at + form)
        assert triples(back) == BASE and back.dimensions == (5, 5)
    sym = build(spark, BASE + [(j, i, v) for i, j, v in BASE], 5)
    mtx.write_mtx(sym, at + "s", symmetry="symmetric", single=single)
    assert triples(mtx.read_mtx(spark, at + "s")) == triples(sym)
    skew = build(spark, BASE + [(j, i, -v) for i, j, v in BASE], 5)
    mtx.write_mtx(skew, at + "k", symmetry="skew-symmetric", single=single)
    assert triples(mtx.read_mtx(spark, at + "k")) == triples(skew)
    for bad in ({"symmetry": "symmetric"}, {"format": "array", "field": "pattern"}, {"field": "complex"}):
        with pytest.raises(WriterError):
            mtx.write_mtx(m, at + "x", **bad)


def test_edge_lists(spark, put, tmp_path):
    plain = "# head\n" + "\n".join(f"{i} {j} {v}" for i, j, v in BASE)
    m = edge_list.read_edge_list(spark, put(plain), weighted=True, undirected=False)
    assert triples(m) == BASE and m.dimensions == (5, 4)
    assert edge_list.read_edge_list(spark, put(plain), undirected=False, square=True).dimensions == (5, 5)
    assert edge_list.read_edge_list(spark, put(plain)).nnz() == 10
    dirty = put("0 1 5\n0 1 3\n2\t2 1\n1 0 9\n")
    assert triples(edge_list.read_edge_list(spark, dirty, weighted=True, remove_duplicates=True, remove_self_edges=True)) == [(0, 1, 3.0), (1, 0, 3.0)]
    assert edge_list.read_edge_list(spark, dirty).nnz() == 8
    for directed in (True, False):
        edge_list.write_edge_list(build(spark, [(1, 0, 2.0), (0, 1, 1.0), (2, 1, 4.0)], 3), str(tmp_path / "e"), directed, single=True)
        want = [["0 1 1.0", "1 0 2.0", "2 1 4.0"], ["0 1 1.0", "1 2 4.0"]][not directed]
        assert (tmp_path / "e").read_text().splitlines() == want


GRAPH = """% seven vertices
 7 11 11
4 5 1 3 2 2 1
2 1 1 3 2 4 1
5 5 3 4 2 2 2 1 2
3 2 1 3 2 6 2 7 5
1 1 1 3 3 6 2
6 5 2 4 2 7 6
2 6 6 4 5
"""


def test_metis(spark, put, tmp_path):
    g = metis.read_metis(spark, put(GRAPH))
    assert g.n == 8 and g.m() == 22
    assert [r["w"][0] for r in g.vertices.orderBy("id").collect()] == [0, 4, 2, 5, 3, 1, 6, 2]
    assert (1, 5, 1.0) in triples(g.connectivity) and (5, 1, 1.0) in triples(g.connectivity)
    z = metis.read_metis(spark, put(GRAPH), zero_based=True)
    assert z.n == 7 and triples(z.connectivity) == [(i - 1, j - 1, v) for i, j, v in triples(g.connectivity)]
    for graph, zero in ((g, False), (z, True), (Graph(z.connectivity.pattern()), True), (Graph(z.connectivity, z.vertices.selectExpr("id", "array(w[0], 7L) as w")), True)):
        metis.write_metis(graph, str(tmp_path / "g"), zero_based=zero, single=True)
        back = metis.read_metis(spark, str(tmp_path / "g"), zero_based=zero)
        assert triples(back.connectivity) == triples(graph.connectivity) and back.n == graph.n
        if graph.vertices is not None:
            assert sorted(map(tuple, back.vertices.collect())) == sorted(map(tuple, graph.vertices.collect()))
    lonely = metis.read_metis(spark, put("3 1\n2\n1\n\n"))
    assert triples(lonely.connectivity) == [(1, 2), (2, 1)] and lonely.n == 4
    for bad in ("", "a b\n", "3 1 100\n"):
        with pytest.raises(ReaderError):
            metis.read_metis(spark, put(bad))


PINS = [(0, 0), (0, 2), (1, 1), (1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("base", [0, 1])
@pytest.mark.parametrize("nets, cells", [(None, None), ([5, 6, 7], None), (None, [1, 2, 3, 4]), ([5, 6, 7], [1, 2, 3, 4])])
def test_patoh(spark, tmp_path, base, nets, cells):
    frame = lambda w, c: w and spark.createDataFrame(list(enumerate(w)), f"{c} bigint, w bigint")
    h = HyperGraph(spark.createDataFrame(PINS, "net bigint, cell bigint"), 3, 4, base, frame(nets, "net"), frame(cells, "cell"))
    patoh.write_patoh(h, str(tmp_path / "h"), single=True)
    back = patoh.read_patoh(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, back.pins.collect())) == PINS and (back.n_nets, back.n_cells, back.base) == (3, 4, base)
    for got, want in ((back.net_weights, nets), (back.cell_weights, cells)):
        assert (None if got is None else [r["w"] for r in got.orderBy(got.columns[0]).collect()]) == want
    assert back.cells().dimensions == (4, 3)
    text = (tmp_path / "h").read_text().splitlines()
    assert text[0].split()[:4] == [str(base), "4", "3", "6"]


def test_patoh_errors(spark, put, tmp_path):
    for bad in ("", "0 1 1\n", "2 1 1 1\n1\n", "0 1 1 1 4\n0\n"):
        with pytest.raises(ReaderError):
            patoh.read_patoh(spark, put(bad))
    with pytest.raises(WriterError):
        patoh.write_patoh(HyperGraph(spark.createDataFrame(PINS, "net bigint, cell bigint"), 9, 4), str(tmp_path / "x"))


@pytest.mark.parametrize("layout", ["coo", "csr"])
def test_binary_files(spark, tmp_path, layout):
    at = str(tmp_path / "m")
    for m in (build(spark, A, 3), build(spark, [r[:2] for r in BASE], 6, 5), build(spark, BASE, 5)):
        sbff.write_sbff_matrix(m, at, layout)
        back = sbff.read_sbff_matrix(spark, at)
        assert triples(back) == triples(m) and back.dimensions == m.dimensions
    top, arrays = sbff.read_headers(at)
    assert top["name"] == layout and arrays["vals"]["type"] == "float" and arrays["col"]["offset"] % 4 == 0
    x = Dense1D(spark.createDataFrame(list(enumerate([1, 2, 3])), "idx bigint, v int"), 3)
    sbff.write_sbff_array(x, at)
    assert sorted(map(tuple, sbff.read_sbff_array(spark, at).data.collect())) == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(ReaderError):
        sbff.read_sbff_matrix(spark, at)
    assert sorted(map(tuple, sbff.read_array(spark, at, "array", "v", chunk=2).collect())) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("layout", ["coo", "csr"])
def test_binary_matrices_are_read_without_joins(spark, tmp_path, layout, capsys):
    """Their arrays look tiny to Spark, which would send them through the driver to join them."""
    rows = [(i, j, float(i - j)) for i in (2, 3, 11) for j in range(0, 9, i)] + [(5, j, 1.0) for j in range(9)]
    m, at = build(spark, rows, 15, 9), str(tmp_path / "m")
    sbff.write_sbff_matrix(m, at, layout)
    for more in ({}, {"chunk": 1}, {"chunk": 4}):
        assert triples(sbff.read_sbff_matrix(spark, at, **more)) == triples(m)
    sbff.read_sbff_matrix(spark, at).nz.explain()
    assert "Join" not in capsys.readouterr().out


def test_big_endian(spark, tmp_path):
    import json

    import numpy as np

    at = tmp_path / "b"
    head = lambda x: json.dumps(x).ljust(1024).encode()
    at.write_bytes(head({"name": "array", "array_count": 1, "dimensions": [3], "endian": "big"}) + head({"name": "array", "type": "unsigned", "type_size": 4, "array_size": 3}) + np.array([1, 2, 2**32 - 1], ">u4").tobytes())
    assert sorted(map(tuple, sbff.read_sbff_array(spark, str(at)).data.collect())) == [(0, 1), (1, 2), (2, 2**32 - 1)]
