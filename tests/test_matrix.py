import math
import random
import statistics

import pytest
from helpers import A, B_COL, B_PTR, build, from_csr

from gridloom.errors import ConversionError, FeatureError, FeatureParamsError, InvalidDataMemberError, NoConverterError, ReorderError, TypeMismatchError
from gridloom.model import Dense1D, Graph, matrix
from gridloom.operators import convert, density, features, permute


def triples(m):
    return sorted(map(tuple, m.nz.collect()))


def order(spark, pos):
    return spark.createDataFrame(list(enumerate(pos)), "id bigint, pos bigint")


def test_features_of_a_small_matrix(spark):
    a = build(spark, A, 3)
    assert [tuple(r) for r in features.degrees_with_distribution(a).orderBy("id").collect()] == [(0, 2, 0.5), (1, 1, 0.25), (2, 1, 0.25)]
    got = features.scalars(a, features.SCALARS, {"off_diag_block_nnz": {"blocks_rows": 3, "blocks_cols": 3}}).first().asDict()
    want = {
        "min_degree": 1, "max_degree": 2, "avg_degree": 4 / 3, "min_degree_column": 1, "max_degree_column": 2, "avg_degree_column": 4 / 3, "median_degree_column": 1.0,
        "standard_deviation_degree_column": 0.816497, "coefficient_of_variation_degree_column": 0.612372, "geometric_avg_degree_column": 1.259921,
        "bandwidth": 3, "profile": 3, "off_diag_block_nnz": 4,
    }
    assert got == pytest.approx(want, abs=1e-6)


def test_features_with_an_empty_row(spark):
    b = build(spark, from_csr(B_PTR, B_COL), 7)
    got = features.scalars(b, features.SCALARS, {"off_diag_block_nnz": {"blocks_rows": 3, "blocks_cols": 3}, "standard_deviation_degree_column": {"normalize": True}}).first()
    deg = [2, 0, 3, 2, 2, 2, 1]
    assert (got["bandwidth"], got["profile"], got["off_diag_block_nnz"], got["min_degree"], got["geometric_avg_degree_column"]) == (4, 9, 8, 0, 0.0)
    assert got["median_degree_column"] == statistics.median(deg) and got["standard_deviation_degree_column"] == pytest.approx(statistics.pstdev(deg))


def test_features_of_nothing(spark):
    m = matrix(spark.createDataFrame([], "i bigint, j bigint"), 0, 0)
    assert m.dimensions == (0, 0)
    got = features.scalars(m, features.SCALARS).first()
    assert got["bandwidth"] == got["profile"] == 0 and got["min_degree"] is None
    assert features.scalars(matrix(m.nz, 3, 3), ["max_degree", "median_degree_column"]).first() == (0, 0.0)
    assert features.triangle_count(m).first()[0] == 0 and features.jaccard_weights(m).collect() == []


def test_triangles(spark):
    directed = from_csr([0, 0, 1, 2, 3, 4, 5, 6, 8, 10, 12], [2, 3, 1, 6, 4, 5, 8, 9, 7, 9, 7, 8])
    und = from_csr([0, 0, 2, 4, 6, 8, 10, 12, 13, 15, 16], [2, 3, 1, 3, 1, 2, 5, 6, 4, 6, 4, 5, 8, 7, 9, 8])
    both = lambda e: e + [(j, i) for i, j in e]
    assert features.triangle_count(build(spark, directed, 10), directed=True).first()[0] == 4
    assert features.triangle_count(build(spark, und, 10)).first()[0] == 2
    assert features.triangle_count(build(spark, both([(0, 1), (1, 2), (0, 2)]), 3)).first()[0] == 1
    assert features.triangle_count(build(spark, both([(1, 4), (2, 3), (3, 4)]), 5)).first()[0] == 0
    assert features.triangle_count(build(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], 2), directed=True).first()[0] == 0


def test_jaccard(spark):
    b = from_csr(B_PTR, B_COL)
    near = {i: {j for a, j in b if a == i} for i in range(7)}
    got = {(r["i"], r["j"]): r["weight"] for r in features.jaccard_weights(build(spark, b, 7)).collect()}
    assert got == {(i, j): len(near[i] & near[j]) / len(near[i] | near[j]) if near[i] & near[j] else 0.0 for i, j in b}


def test_extractor(spark):
    x = features.all_features()
    assert x.names()[0] == "degrees" and x.params("triangle_count") == {"directed": False}
    x.subtract("jaccard_weights")
    assert set(x.extract(build(spark, A, 3))) == {"degrees", "degree_distribution", "degrees_degree_distribution", "scalars", "triangle_count"}
    with pytest.raises(FeatureError):
        x.add("nothing")
    with pytest.raises(FeatureError):
        x.subtract("jaccard_weights")
    with pytest.raises(FeatureParamsError):
        x.add("bandwidth", blocks=2)


def test_custom_features(spark):
    features.register("big", lambda m, least: m.nz.where(f"v >= {least}"), least=3)
    a = build(spark, A, 3)
    assert features.Extractor("big").extract(a)["big"].count() == 2
    assert features.Extractor("big", big={"least": 4}).extract(a)["big"].count() == 1
    with pytest.raises(FeatureError):
        features.register("bandwidth", lambda m: m.nz)
    features.unregister("big")
    with pytest.raises(FeatureError):
        features.Extractor("big")


def test_layouts(spark):
    a = build(spark, A, 3)
    csr, csc = convert.coo_to_csr(a), convert.coo_to_csc(a)
    assert [tuple(r) for r in csr.orderBy("i").collect()] == [(0, [1, 2], [1.0, 2.0]), (1, [0], [3.0]), (2, [0], [4.0])]
    assert [tuple(r) for r in csc.orderBy("j").collect()] == [(0, [1, 2], [3.0, 4.0]), (1, [0], [1.0]), (2, [0], [2.0])]
    assert [r["ptr"] for r in convert.pointers(a).orderBy("id").collect()] == [0, 2, 3, 4]
    assert triples(convert.csr_to_coo(csr, 3, 3)) == triples(convert.csc_to_coo(csc, 3, 3)) == A
    p = build(spark, from_csr(B_PTR, B_COL), 7)
    assert triples(convert.csr_to_coo(convert.coo_to_csr(p), 7, 7)) == from_csr(B_PTR, B_COL)
    assert [r["ptr"] for r in convert.pointers(p).orderBy("id").collect()] == B_PTR
    wide = build(spark, [(0, 4, 1.0), (1, 2, 2.0)], 2, 5)
    assert convert.coo_to_csc(wide).count() == 5 and [r["ptr"] for r in convert.pointers(wide, "j").orderBy("id").collect()] == [0, 0, 0, 1, 1, 2]


def test_converter(spark):
    c = convert.default_converter(3, 3)
    assert c.chain("csc", "csr") == ["csc", "coo", "csr"] and c.can_convert("csr", "csc")
    assert triples(c.convert(convert.coo_to_csr(build(spark, A, 3)), "csr", "coo")) == A
    c.clear("csc")
    assert not c.can_convert("csc", "coo")
    with pytest.raises(NoConverterError):
        c.chain("csc", "csr")
    assert issubclass(NoConverterError, ConversionError)


def test_casts_are_exact_or_fail(spark):
    a = build(spark, A, 3)
    assert triples(convert.cast_values(a, "int")) == [(i, j, int(v)) for i, j, v in A]
    for v in (1.5, 1e12):
        with pytest.raises(Exception):
            convert.cast_values(build(spark, [(0, 0, v)], 1), "int").nz.collect()


def test_permutations(spark):
    a = build(spark, A, 3)
    rows, cols = order(spark, [1, 2, 0]), order(spark, [2, 0, 1])
    csr = lambda m: [tuple(r)[1:] for r in convert.coo_to_csr(m).orderBy("i").collect()]
    assert csr(permute.permute_rows(a, rows)) == [([0], [4.0]), ([1, 2], [1.0, 2.0]), ([0], [3.0])]
    assert csr(permute.permute_cols(a, cols)) == [([0, 1], [1.0, 2.0]), ([2], [3.0]), ([2], [4.0])]
    assert csr(permute.permute_2d(a, rows, cols)) == [([2], [4.0]), ([0, 1], [1.0, 2.0]), ([2], [3.0])]
    back = permute.permute_2d(permute.permute_2d(a, rows, cols), permute.inverse(rows), permute.inverse(cols))
    assert triples(back) == A
    x = Dense1D(spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 0.2)], "idx bigint, v double"), 3)
    assert [r["v"] for r in permute.permute_1d(x, cols).data.orderBy("idx").collect()] == [0.1, 0.2, 0.0]
    assert not permute.is_permutation(order(spark, [0, 0, 2]), 3).first()["valid"]


def test_heatmap_density_and_product(spark):
    a = build(spark, A, 3)
    cells = lambda df: [r[2] for r in df.orderBy("bi", "bj").collect()]
    assert cells(density.heatmap(a)) == [0, 0.25, 0.25, 0.25, 0, 0, 0.25, 0, 0]
    assert cells(density.heatmap(a, order(spark, [1, 2, 0]), order(spark, [2, 0, 1]))) == [0, 0, 0.25, 0.25, 0.25, 0, 0, 0, 0.25]
    with pytest.raises(ReorderError):
        density.heatmap(a, num_parts=4)
    assert sorted(map(tuple, density.density_grid(a, 2, weighted=True).collect())) == [(0, 0, 4.0), (0, 1, 2.0), (1, 0, 4.0)]
    x = Dense1D(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "idx bigint, v double"), 3)
    assert [r["v"] for r in density.spmv(a, x).data.orderBy("idx").collect()] == [8.0, 3.0, 4.0]
    page = density.visualize(a, {"rows": order(spark, [1, 2, 0])}, buckets=3)
    assert page.count("<figure>") == 2 and "bandwidth 3" in page


def test_objects(spark):
    with pytest.raises(TypeMismatchError):
        Graph(build(spark, A, 3, 4))
    with pytest.raises(InvalidDataMemberError):
        build(spark, from_csr(B_PTR, B_COL), 7).values()
    assert math.isclose(build(spark, A, 3).nnz(), 4)


@pytest.mark.parametrize("seed, n, m", [(1, 12, 40), (2, 40, 300), (3, 30, 25)])
def test_triangles_and_jaccard_against_loops(spark, seed, n, m):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), int(rng.paretovariate(0.8)) % n) for _ in range(m)]
    e = set(rows) - {(i, i) for i in range(n)}
    near = {i: {j for j in range(n) if (i, j) in e or (j, i) in e} for i in range(n)}
    und = sum(1 for a in range(n) for b in near[a] for c in near[a] & near[b] if a < b < c)
    cycles = sum(1 for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n) for x, y, z in ((a, b, c), (a, c, b)) if {(x, y), (y, z), (z, x)} <= e)
    g = build(spark, rows + rows[:3], n)
    assert features.triangle_count(g).first()[0] == und and features.triangle_count(g, directed=True).first()[0] == cycles
    own = {i: {j for x, j in rows if x == i} for i in range(n)}
    d = {i: sum(x == i for x, _ in rows + rows[:3]) for i in range(n)}
    want = sorted((i, j, (c := len(own[i] & own[j])) / (d[i] + d[j] - c) if own[i] & own[j] else 0.0) for i, j in rows + rows[:3])
    assert sorted(map(tuple, features.jaccard_weights(g).collect())) == want
