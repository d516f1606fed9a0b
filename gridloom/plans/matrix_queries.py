"""Queries of the operators on matrices, graphs and hypergraphs, and of the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.experiment import Experiment, load_matrix, pass_through, reordered
from gridloom.operators import convert, density, features, graphs, partition, permute, reorder
from gridloom.model import Dense1D, Graph
from gridloom.runtime import Scratch
from gridloom.sources import edge_list, metis, mtx, patoh, sbff
from gridloom.sources.objects import co_purchase, co_purchase_stored, line_order, part_supplier, pin_hypergraph, supplier_balance

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PS = """WITH m AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
dims AS (SELECT max(l_partkey) + 1 AS n, max(l_suppkey) + 1 AS k FROM lineitem),
nnz AS (SELECT count(*) AS nnz FROM m),
dr AS (SELECT r.id, coalesce(c, 0) AS degree FROM (SELECT unnest(range(n)) AS id FROM dims) r LEFT JOIN (SELECT i, count(*) AS c FROM m GROUP BY 1) ON i = r.id),
dc AS (SELECT r.id, coalesce(c, 0) AS degree FROM (SELECT unnest(range(k)) AS id FROM dims) r LEFT JOIN (SELECT j, count(*) AS c FROM m GROUP BY 1) ON j = r.id)
"""
_CP = """WITH h AS (SELECT DISTINCT a.l_partkey AS i, b.l_partkey AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
m AS (SELECT i, j FROM h UNION ALL SELECT j, i FROM h),
dims AS (SELECT max(l_partkey) + 1 AS n FROM lineitem),
ids AS (SELECT unnest(range(n)) AS id FROM dims),
dr AS (SELECT ids.id, coalesce(c, 0) AS degree FROM ids LEFT JOIN (SELECT i, count(*) AS c FROM m GROUP BY 1) ON i = ids.id)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_PS + "SELECT id, degree FROM dr")
def degrees(spark, d):
    return features.degrees(part_supplier(spark, d))


@query(_PS + "SELECT id, degree / nnz AS share FROM dr, nnz")
def degree_distribution(spark, d):
    return features.degree_distribution(part_supplier(spark, d))


@query(_PS + "SELECT id, degree, degree / nnz AS share FROM dr, nnz")
def degrees_fused(spark, d):
    return features.degrees_with_distribution(part_supplier(spark, d))


_SCALAR_SQL = {
    "min_degree": "SELECT min(degree) AS min_degree FROM dr", "max_degree": "SELECT max(degree) AS max_degree FROM dr",
    "avg_degree": "SELECT nnz / n AS avg_degree FROM nnz, dims",
    "min_degree_column": "SELECT min(degree) AS min_degree_column FROM dc", "max_degree_column": "SELECT max(degree) AS max_degree_column FROM dc",
    "avg_degree_column": "SELECT nnz / k AS avg_degree_column FROM nnz, dims",
    "median_degree_column": "SELECT median(degree) AS median_degree_column FROM dc",
    "standard_deviation_degree_column": "SELECT round(sqrt(sum(degree * degree)::DOUBLE - sum(degree)::DOUBLE * sum(degree)::DOUBLE / count(*)), 6) AS standard_deviation_degree_column FROM dc",
    "coefficient_of_variation_degree_column": "SELECT round(sqrt(sum(degree * degree)::DOUBLE - sum(degree)::DOUBLE * sum(degree)::DOUBLE / count(*)) / (sum(degree) / count(*)), 6) AS coefficient_of_variation_degree_column FROM dc",
    "geometric_avg_degree_column": "SELECT round(CASE WHEN min(degree) = 0 THEN 0.0 ELSE exp(avg(ln(greatest(degree, 1)))) END, 6) AS geometric_avg_degree_column FROM dc",
    "bandwidth": "SELECT coalesce(max(abs(i - j)) + 1, 0) AS bandwidth FROM m",
    "profile": "SELECT sum(i - least(i, l))::BIGINT AS profile FROM (SELECT i, min(j) AS l FROM m GROUP BY 1)",
}
_ROUNDED = ("standard_deviation_degree_column", "coefficient_of_variation_degree_column", "geometric_avg_degree_column")


def _scalar(name: str):
    def run(spark, d):
        out = features.scalars(part_supplier(spark, d), [name])
        return out.withColumn(name, F.round(name, 6)) if name in _ROUNDED else out

    run.__name__ = {"standard_deviation_degree_column": "stddev_degree_column", "coefficient_of_variation_degree_column": "cv_degree_column", "geometric_avg_degree_column": "geo_avg_degree_column"}.get(name, name)
    query(_PS + _SCALAR_SQL[name])(run)


for _name in _SCALAR_SQL:
    _scalar(_name)


@query(_PS + "SELECT min(degree) AS min_degree, max(degree) AS max_degree, any_value(nnz / n) AS avg_degree FROM dr, nnz, dims")
def min_max_avg_degree(spark, d):
    return features.scalars(part_supplier(spark, d), ["min_degree", "max_degree", "avg_degree"])


@query(_PS + """, b AS (SELECT i, j, n // 16 AS q, n % 16 AS r, k // 16 AS q2, k % 16 AS r2 FROM m, dims),
c AS (SELECT CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // greatest(q, 1) END AS bi,
             CASE WHEN j < r2 * (q2 + 1) THEN j // (q2 + 1) ELSE r2 + (j - r2 * (q2 + 1)) // greatest(q2, 1) END AS bj FROM b)
SELECT count(*) AS off_diag_block_nnz FROM c WHERE bi <> bj""")
def off_diag_block_nnz(spark, d):
    return features.scalars(part_supplier(spark, d), ["off_diag_block_nnz"], {"off_diag_block_nnz": {"blocks_rows": 16, "blocks_cols": 16}})


@query(_PS + "SELECT * FROM " + ", ".join(f"({_SCALAR_SQL[n]})" for n in _SCALAR_SQL))
def feature_extractor_all(spark, d):
    """Every scalar feature at once, from one aggregation by rows and one by columns."""
    out = features.scalars(part_supplier(spark, d), _SCALAR_SQL)
    return out.withColumns({n: F.round(n, 6) for n in _ROUNDED})


@query(_PS + "SELECT dr.id, degree, share, bandwidth, max_degree, double_nnz FROM dr JOIN (SELECT id, degree / nnz AS share FROM dr, nnz) USING (id), (SELECT max(abs(i - j)) + 1 AS bandwidth, 2 * count(*) AS double_nnz FROM m), (SELECT max(degree) AS max_degree FROM dr)")
def extractor(spark, d):
    """What an extractor gives for list features, scalars and a user's own feature, side by side."""
    features.register("nnz_times", lambda m, factor: m.nz.agg((F.count("*") * factor).alias("double_nnz")), factor=1)
    try:
        out = features.Extractor("degrees", "degree_distribution", "bandwidth", "max_degree", "nnz_times", nnz_times={"factor": 2}).extract(part_supplier(spark, d))
    finally:
        features.unregister("nnz_times")
    return out["degrees"].join(out["degree_distribution"], "id").join(F.broadcast(out["scalars"])).join(F.broadcast(out["nnz_times"]))


@query(_CP + "SELECT count(*) AS triangles FROM h a JOIN h b ON a.j = b.i JOIN h c ON c.i = a.i AND c.j = b.j")
def triangle_count_undirected(spark, d):
    return features.triangle_count(co_purchase(spark, d))


@query("""WITH e AS (SELECT DISTINCT a.l_partkey AS i, b.l_partkey AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey)
SELECT count(*) AS triangles FROM e x JOIN e y ON x.j = y.i AND x.i < x.j AND x.i < y.j JOIN e z ON z.i = y.j AND z.j = x.i""")
def triangle_count_directed(spark, d):
    return features.triangle_count(line_order(spark, d), directed=True)


@query(_CP + """, c AS (SELECT a.i, b.j, count(*) AS c FROM m a JOIN m b ON a.j = b.i JOIN m e ON e.i = a.i AND e.j = b.j GROUP BY 1, 2)
SELECT m.i, m.j, coalesce(c / (x.degree + y.degree - c), 0.0) AS weight FROM m LEFT JOIN c ON c.i = m.i AND c.j = m.j JOIN dr x ON x.id = m.i JOIN dr y ON y.id = m.j""")
def jaccard_weights(spark, d):
    return features.jaccard_weights(co_purchase(spark, d))


_LAYOUT = "coalesce({0}, [])::{1}[] AS {0}"


def _layout_sql(by: str, at: str, n: str) -> str:
    return _PS + f"SELECT r.id AS {by}, {_LAYOUT.format('ids', 'BIGINT')}, {_LAYOUT.format('vals', 'DOUBLE')} FROM (SELECT unnest(range({n})) AS id FROM dims) r LEFT JOIN (SELECT {by} AS b, list({at} ORDER BY {at}) AS ids, list(v ORDER BY {at}) AS vals FROM m GROUP BY 1) ON b = r.id"


@query(_layout_sql("i", "j", "n"))
def coo_to_csr(spark, d):
    return convert.coo_to_csr(part_supplier(spark, d))


@query(_layout_sql("j", "i", "k"))
def coo_to_csc(spark, d):
    return convert.coo_to_csc(part_supplier(spark, d))


@query(_layout_sql("j", "i", "k"))
def csr_to_csc(spark, d):
    m = part_supplier(spark, d)
    return convert.csr_to_csc(convert.coo_to_csr(m), *m.dimensions)


@query(_PS + "SELECT i, j, v FROM m")
def csr_to_coo(spark, d):
    m = part_supplier(spark, d)
    return convert.default_converter(*m.dimensions).convert(convert.coo_to_csr(m), "csr", "coo").nz


@query(_PS + "SELECT i, j, v FROM m")
def csc_to_coo(spark, d):
    m = part_supplier(spark, d)
    return convert.default_converter(*m.dimensions).convert(convert.coo_to_csc(m), "csc", "coo").nz


@query(_PS + "SELECT n AS id, nnz AS ptr FROM dims, nnz UNION ALL SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT FROM dr")
def row_pointers(spark, d):
    return convert.pointers(part_supplier(spark, d))


@query(_PS + "SELECT j AS i, i AS j, v FROM m")
def transpose(spark, d):
    return part_supplier(spark, d).transpose().nz


@query(_PS + "SELECT i, j, v::BIGINT AS v FROM m")
def cast_values(spark, d):
    return convert.cast_values(part_supplier(spark, d), "bigint").nz


_ORDERS_SQL = """, ro AS (SELECT id, row_number() OVER (ORDER BY degree, id DESC) - 1 AS pos FROM dr),
co AS (SELECT id, row_number() OVER (ORDER BY degree, id DESC) - 1 AS pos FROM dc)
"""


def _row_order(m):
    return reorder.degree_order(m)


@query(_PS + _ORDERS_SQL + "SELECT ro.pos AS i, co.pos AS j, v FROM m JOIN ro ON ro.id = i JOIN co ON co.id = j")
def permute2d(spark, d):
    m = part_supplier(spark, d)
    return permute.permute_2d(m, reorder.degree_order(m), reorder.degree_order(m.transpose())).nz


@query(_PS + _ORDERS_SQL + "SELECT ro.pos AS i, j, v FROM m JOIN ro ON ro.id = i")
def permute2d_row(spark, d):
    m = part_supplier(spark, d)
    return permute.permute_rows(m, reorder.degree_order(m)).nz


@query(_PS + _ORDERS_SQL + "SELECT i, co.pos AS j, v FROM m JOIN co ON co.id = j")
def permute2d_col(spark, d):
    m = part_supplier(spark, d)
    return permute.permute_cols(m, reorder.degree_order(m.transpose())).nz


@query(_PS + _ORDERS_SQL + "SELECT pos AS idx, degree AS v FROM dr JOIN ro USING (id)")
def permute1d(spark, d):
    m = part_supplier(spark, d)
    return permute.permute_1d(Dense1D(features.degrees(m).selectExpr("id as idx", "degree as v"), m.n_rows), reorder.degree_order(m)).data


@query(_PS + _ORDERS_SQL + "SELECT pos AS id, id AS pos FROM ro")
def inverse_permutation(spark, d):
    return permute.inverse(reorder.degree_order(part_supplier(spark, d)))


@query(_CP + "SELECT id, row_number() OVER (ORDER BY degree, id DESC) - 1 AS pos FROM dr")
def degree_reorder_asc(spark, d):
    return reorder.reorder("degree", co_purchase(spark, d))


@query(_CP + "SELECT id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos FROM dr")
def degree_reorder_desc(spark, d):
    return reorder.reorder("degree", co_purchase(spark, d), ascending=False)


@query(_CP + """, p AS (SELECT i, j, row_number() OVER (ORDER BY j, i) AS p FROM m),
f AS (SELECT id, min(p) AS p FROM (SELECT i AS id, p FROM p UNION ALL SELECT j, p + (SELECT count(*) FROM m) FROM p) GROUP BY 1)
SELECT ids.id, row_number() OVER (ORDER BY p NULLS LAST, ids.id) - 1 AS pos FROM ids LEFT JOIN f USING (id)""")
def boba_reorder(spark, d):
    return reorder.reorder("boba", co_purchase(spark, d))


def _gray_sql(res: int, threshold: int, group: int) -> str:
    decode = "x"
    steps = "\n".join(f"g{k} AS (SELECT * REPLACE (xor(x, x >> {1 << k}) AS x) FROM {'b' if k == 0 else f'g{k - 1}'})," for k in range(6))
    return _PS + f""", w AS (SELECT i, least(j // (k // least({res}, k)), least({res}, k) - 1) AS b, count(*) AS c FROM m, dims GROUP BY 1, 2),
t AS (SELECT i, sum(c)::BIGINT AS d FROM w GROUP BY 1),
b AS (SELECT w.i, any_value(d) AS d, bit_or(CASE WHEN c > CASE WHEN d <= {threshold} THEN 0 ELSE d // {res} END THEN (1::HUGEINT << b) ELSE 0 END) AS x FROM w JOIN t ON t.i = w.i GROUP BY 1),
{steps}
r AS (SELECT dr.id, coalesce(d, 0) AS d, coalesce({decode}, 0) AS g FROM dr LEFT JOIN g5 ON i = dr.id),
o AS (SELECT *, d > {threshold} AS dense, CASE WHEN d = 0 OR d > {threshold} THEN -1 ELSE (dense_rank() OVER (PARTITION BY d > {threshold} OR d = 0 ORDER BY d) - 1) // {group} END AS grp FROM r)
SELECT id, row_number() OVER (ORDER BY dense, CASE WHEN dense THEN 0 ELSE grp END, CASE WHEN grp % 2 = 1 THEN -g ELSE g END, id) - 1 AS pos FROM o"""


@query(_gray_sql(32, 26, 3))
def gray_reorder(spark, d):
    return reorder.reorder("gray", part_supplier(spark, d), resolution=32, nnz_threshold=26, group_size=3)


def _rcm_sql(searches: int) -> str:
    """The order as a queue would give it, with so many searches for the far end of each component."""

    def walk(name: str, roots: str, by: str) -> str:
        return f"""{name}(id, c, lev, ord) USING KEY (id) AS (
  SELECT root, c, 0, row_number() OVER (ORDER BY c) FROM {roots}
  UNION
  SELECT v, c, lev + 1, row_number() OVER (ORDER BY parent, {by} v) FROM (
    SELECT e.v, min(x.c) AS c, min(x.lev) AS lev, min(x.ord) AS parent FROM {name} x JOIN m2 e ON e.u = x.id LEFT JOIN recurring.{name} r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v)
  {"JOIN dr ON dr.id = v" if by else ""})"""

    steps = []
    for k in range(searches):
        steps.append(walk(f"b{k}", f"s{k}", ""))
        steps.append(f"""f{k} AS (SELECT c, max(lev) AS top, arg_min(b{k}.id, (-lev, degree, ord)) AS far FROM b{k} JOIN dr ON dr.id = b{k}.id GROUP BY c),
s{k + 1} AS (SELECT c, CASE WHEN going AND top > most AND size <> top + 1 THEN far ELSE root END AS root, greatest(most, top) AS most, going AND top > most AND size <> top + 1 AS going, size FROM s{k} JOIN f{k} USING (c))""")
    return _CP.replace("WITH h", "WITH RECURSIVE h") + f""", m2 AS (SELECT i AS u, j AS v FROM m),
g(id, c) USING KEY (id) AS (
  SELECT u, least(u, min(v)) FROM m2 GROUP BY u
  UNION
  SELECT e.v, min(g.c) FROM g JOIN m2 e ON e.u = g.id JOIN recurring.g h ON h.id = e.v WHERE g.c < h.c GROUP BY e.v),
comps AS (SELECT ids.id, coalesce(g.c, ids.id) AS c FROM ids LEFT JOIN g ON g.id = ids.id),
sizes AS (SELECT c, count(*) AS size FROM comps GROUP BY 1),
offs AS (SELECT c, size, sum(size) OVER (ORDER BY c) - size AS start FROM sizes),
s0 AS (SELECT c, c AS root, 0 AS most, true AS going, size FROM sizes),
{", ".join(steps)},
{walk("q", f"s{searches}", "degree,")},
w AS (SELECT id, c, row_number() OVER (PARTITION BY c ORDER BY lev, ord) AS nth FROM q)
SELECT id, (start + size - nth)::BIGINT AS pos FROM w JOIN offs USING (c)"""


@query(_rcm_sql(6))
def rcm_reorder(spark, d):
    return reorder.reorder("rcm", co_purchase(spark, d))


@query(_rcm_sql(6))
def rcm_by_levels(spark, d):
    """The same order by distributed steps alone."""
    return reorder.rcm_order(co_purchase(spark, d), task_edges=0)


@query()
def slashburn_reorder(spark, d):
    m = co_purchase_stored(spark, d)
    return reorder.reorder("slashburn", m, k_size=max(1, m.n_rows // 200), hub_order=True)


@query("WITH d AS (SELECT max(l_partkey) + 1 AS n FROM lineitem) SELECT n AS ids, n AS same FROM d")
def slashburn_agreement(spark, d):
    """How many vertices the distributed steps put where the order within a task puts them."""
    m = co_purchase_stored(spark, d)
    k = max(1, m.n_rows // 4)
    one, other = (reorder.slashburn_order(m, k, hub_order=True, **how) for how in ({}, {"task_edges": 0}))
    both = one.join(other.withColumnRenamed("pos", "at"), "id")
    return both.agg(F.count("*").alias("ids"), F.count(F.when(F.col("pos") == F.col("at"), 1)).alias("same"))


@query(_CP + """, po AS (SELECT id, row_number() OVER (ORDER BY degree, id DESC) - 1 AS pos FROM dr),
c AS (SELECT least(a.pos // (n // 8), 7) AS bi, least(b.pos // (n // 8), 7) AS bj, count(*) AS c FROM m JOIN po a ON a.id = i JOIN po b ON b.id = j, dims GROUP BY 1, 2)
SELECT x.b AS bi, y.b AS bj, coalesce(c / (SELECT count(*) FROM m), 0.0) AS share FROM (SELECT unnest(range(8)) AS b) x CROSS JOIN (SELECT unnest(range(8)) AS b) y LEFT JOIN c ON bi = x.b AND bj = y.b""")
def heatmap(spark, d):
    m = co_purchase_stored(spark, d)
    order = reorder.degree_order(m)
    return density.heatmap(m, order, order, num_parts=8)


@query(_PS + "SELECT i // 50 AS bi, j // 50 AS bj, sum(abs(v)) AS value FROM m GROUP BY 1, 2")
def density_grid(spark, d):
    return density.density_grid(part_supplier(spark, d), 50, weighted=True)


@query(_PS + "SELECT dr.id AS idx, coalesce(y, 0.0) AS v FROM dr LEFT JOIN (SELECT i, sum(v * round(s_acctbal * 100)) AS y FROM m JOIN supplier ON s_suppkey = j GROUP BY 1) ON i = dr.id")
def spmv(spark, d):
    return density.spmv(part_supplier(spark, d), supplier_balance(spark, d)).data


@query("""WITH RECURSIVE e AS (SELECT DISTINCT i AS a, j AS b FROM pair_matches WHERE i IS NOT NULL AND j IS NOT NULL AND i <> j UNION SELECT j, i FROM pair_matches WHERE i IS NOT NULL AND j IS NOT NULL AND i <> j),
g(id, comp) USING KEY (id) AS (
  SELECT a, least(a, min(b)) FROM e GROUP BY a
  UNION
  SELECT e.b, min(g.comp) FROM g JOIN e ON e.a = g.id JOIN recurring.g h ON h.id = e.b WHERE g.comp < h.comp GROUP BY e.b)
SELECT DISTINCT v.id, coalesce(g.comp, v.id) AS comp FROM vertices v LEFT JOIN g ON g.id = v.id WHERE v.id IS NOT NULL""")
def connected_components(spark, d):
    from gridloom.sources.tables import table

    links = table(spark, d, "pair_matches").where("i is not null and j is not null and i <> j")
    edges = links.select(F.col("i").alias("u"), F.col("j").alias("v")).union(links.select("j", "i")).distinct()
    return graphs.components(table(spark, d, "vertices").select("id").where("id is not null").distinct(), edges)


_EDGES = "WITH e AS (SELECT l_orderkey AS i, l_partkey AS j, l_quantity::BIGINT AS v FROM lineitem)"


def _edge_file(spark, d):
    from gridloom.model import matrix
    from gridloom.sources.tables import table

    at = Scratch(spark, "files").path + "/edges"
    nz = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    edge_list.write_edge_list(matrix(nz), at, directed=True)
    return at


@query(_EDGES + "SELECT i, j, min(v) AS v FROM (SELECT i, j, v FROM e WHERE i <> j UNION ALL SELECT j, i, v FROM e WHERE i <> j) GROUP BY 1, 2")
def edge_list_read_options(spark, d):
    return edge_list.read_edge_list(spark, _edge_file(spark, d), weighted=True, remove_duplicates=True, remove_self_edges=True, value_type="bigint").nz


@query(_EDGES + "SELECT i, j, v FROM e UNION ALL SELECT j, i, v FROM e")
def edge_list_read_undirected(spark, d):
    return edge_list.read_edge_list(spark, _edge_file(spark, d), weighted=True, value_type="bigint").nz


@query(_CP + "SELECT i || ' ' || j AS value FROM h")
def edge_list_write_undirected(spark, d):
    at = Scratch(spark, "files").path + "/undirected"
    edge_list.write_edge_list(co_purchase(spark, d), at)
    return spark.read.text(at)


@query(_PS + "SELECT i, j, v FROM m")
def mtx_round_trip(spark, d):
    at = Scratch(spark, "files").path + "/m.mtx"
    mtx.write_mtx(part_supplier(spark, d), at, single=True)
    return mtx.read_mtx(spark, at).nz


@query(_CP + "SELECT i, j FROM m")
def mtx_symmetric_round_trip(spark, d):
    at = Scratch(spark, "files").path + "/s.mtx"
    mtx.write_mtx(co_purchase(spark, d), at, field="pattern", symmetry="symmetric")
    return mtx.read_mtx(spark, at).nz


@query(_PS + "SELECT i, j, v FROM m WHERE v <> 0")
def mtx_array_round_trip(spark, d):
    at = Scratch(spark, "files").path + "/a.mtx"
    mtx.write_mtx(part_supplier(spark, d), at, format="array")
    return mtx.read_mtx(spark, at).nz


@query(_PS + "SELECT a.i, a.j, a.v FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.i = a.j AND b.j = a.i AND b.v = a.v)")
def mtx_symmetry_check(spark, d):
    return mtx.symmetry_violations(part_supplier(spark, d))


@query(_CP + "SELECT i, j FROM m")
def metis_round_trip(spark, d):
    at = Scratch(spark, "files").path + "/g.metis"
    metis.write_metis(Graph(co_purchase_stored(spark, d)), at)
    return metis.read_metis(spark, at, zero_based=True).connectivity.nz


@query("SELECT DISTINCT net, cell FROM pins WHERE net IS NOT NULL AND cell IS NOT NULL")
def patoh_round_trip(spark, d):
    h = pin_hypergraph(spark, d)
    weights = spark.range(h.n_nets).select(F.col("id").alias("net"), (F.col("id") % 7 + 1).alias("w"))
    at = Scratch(spark, "files").path + "/h.patoh"
    patoh.write_patoh(type(h)(h.pins, h.n_nets, h.n_cells, 1, weights), at)
    return patoh.read_patoh(spark, at).pins


@query(_CP + "SELECT i, j, (i * j % 9 + 1)::DOUBLE AS v, i % 5 AS w0, i % 3 + 1 AS w1 FROM m")
def metis_weighted_round_trip(spark, d):
    """Edge weights and two vertex weights."""
    m = co_purchase(spark, d)
    valued = m.with_nz(m.nz.withColumn("v", F.col("i") * F.col("j") % 9 + 1))
    weights = spark.range(m.n_rows).select("id", F.array(F.col("id") % 5, F.col("id") % 3 + 1).alias("w"))
    at = Scratch(spark, "files").path + "/w.metis"
    metis.write_metis(Graph(valued, weights), at)
    g = metis.read_metis(spark, at, zero_based=True)
    w = g.vertices.select(F.col("id").alias("i"), F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))
    return g.connectivity.nz.join(w, "i").select("i", "j", "v", "w0", "w1")


@query("SELECT DISTINCT net, cell, net % 7 + 1 AS nw, cell % 4 AS w0, cell % 6 + 1 AS w1 FROM pins WHERE net IS NOT NULL AND cell IS NOT NULL")
def patoh_weighted_round_trip(spark, d):
    """Net weights, and cell weights of two constraints."""
    h = pin_hypergraph(spark, d)
    nets = spark.range(h.n_nets).select(F.col("id").alias("net"), (F.col("id") % 7 + 1).alias("w"))
    cells = spark.range(h.n_cells).select(F.col("id").alias("cell"), F.array(F.col("id") % 4, F.col("id") % 6 + 1).alias("w"))
    at = Scratch(spark, "files").path + "/w.patoh"
    patoh.write_patoh(type(h)(h.pins, h.n_nets, h.n_cells, 1, nets, cells), at)
    back = patoh.read_patoh(spark, at)
    full = back.pins.join(back.net_weights.withColumnRenamed("w", "nw"), "net").join(back.cell_weights, "cell")
    return full.select("net", "cell", "nw", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))


@query("SELECT i::BIGINT AS idx, coalesce(round(s_acctbal * 100), 0.0) AS v FROM (SELECT unnest(range((SELECT max(l_suppkey) + 1 FROM lineitem))) AS i) LEFT JOIN supplier ON s_suppkey = i")
def sbff_array_round_trip(spark, d):
    x = supplier_balance(spark, d)
    full = spark.range(x.length).select(F.col("id").alias("idx")).join(x.data, "idx", "left").fillna(0.0, ["v"])
    at = Scratch(spark, "files").folder() + "/x.array"
    sbff.write_sbff_array(Dense1D(full, x.length), at)
    return sbff.read_sbff_array(spark, at).data


@query(_PS + "SELECT i, j, v FROM m")
def sbff_csr_round_trip(spark, d):
    at = Scratch(spark, "files").folder() + "/m.csr"
    sbff.write_sbff_matrix(part_supplier(spark, d), at, "csr")
    return sbff.read_sbff_matrix(spark, at).nz


@query(_PS + "SELECT i, j, v FROM m")
def sbff_coo_round_trip(spark, d):
    at = Scratch(spark, "files").folder() + "/m.coo"
    sbff.write_sbff_matrix(part_supplier(spark, d), at, "coo")
    return sbff.read_sbff_matrix(spark, at).nz


#: Of eight parts: all ids have one, none is empty, the balance holds, and fewer edges are cut than by runs of ids, whose cut is given.
_PARTS_SQL = _CP + """SELECT n AS ids, 8 AS parts, (SELECT count(*) FROM h WHERE least(i * 8 // n, 7) <> least(j * 8 // n, 7)) AS cut_of_runs, true AS balanced, true AS better FROM dims"""


def _valid_parts(m, balance: float, part):
    ids = m.spark.range(m.n_rows)
    runs = partition.partition_quality(m, ids.select("id", F.floor(F.col("id") * 8 / m.n_rows).cast("int").alias("part")))
    parts = Scratch(m.spark, "files").write(part(m))
    got = partition.partition_quality(m, parts).join(F.broadcast(parts.agg(F.countDistinct("id").alias("ids"))))  # one row each
    both = got.join(F.broadcast(runs.select(F.col("cut_edges").alias("cut_of_runs"))))
    most = -(-m.n_rows // 8) * balance
    return both.select("ids", F.col("parts").cast("int").alias("parts"), "cut_of_runs", (F.col("largest") <= most).alias("balanced"), (F.col("cut_edges") < F.col("cut_of_runs")).alias("better"))


@query(_PARTS_SQL)
def pulp_partition_validity(spark, d):
    return _valid_parts(co_purchase_stored(spark, d), 1.1, lambda m: partition.partition("label", m, 8))


@query(_PARTS_SQL)
def metis_partition_kway_validity(spark, d):
    return _valid_parts(co_purchase_stored(spark, d), 1.05, lambda m: partition.partition("multilevel", m, 8))


@query(_PARTS_SQL)
def metis_partition_rb_validity(spark, d):
    return _valid_parts(co_purchase_stored(spark, d), 1.05, lambda m: partition.partition("multilevel", m, 8, ptype="rb"))


@query("""WITH p AS (SELECT DISTINCT net, cell FROM pins WHERE net IS NOT NULL AND cell IS NOT NULL), dims AS (SELECT max(cell) + 1 AS n FROM p),
r AS (SELECT net, count(DISTINCT least(cell * 8 // n, 7)) AS c FROM p, dims GROUP BY 1)
SELECT n AS ids, 8 AS parts, (SELECT sum(c - 1)::BIGINT FROM r) AS reach_of_runs, true AS balanced, true AS better FROM dims""")
def patoh_partition_validity(spark, d):
    h = pin_hypergraph(spark, d)
    runs = spark.range(h.n_cells).select("id", F.floor(F.col("id") * 8 / h.n_cells).cast("int").alias("part"))
    parts = Scratch(spark, "files").write(partition.partition("hypergraph", h, 8))
    sizes = parts.agg(F.countDistinct("id").alias("ids"), F.countDistinct("part").cast("int").alias("parts"))
    got = partition.hypergraph_quality(h, parts).join(F.broadcast(sizes))  # one row each
    both = got.join(F.broadcast(partition.hypergraph_quality(h, runs).select(F.col("connectivity").alias("reach_of_runs"))))
    return both.select("ids", "parts", "reach_of_runs", (F.col("largest") <= -(-h.n_cells // 8) * 1.1).alias("balanced"), (F.col("connectivity") < F.col("reach_of_runs")).alias("better"))


@query("""WITH p AS (SELECT DISTINCT net, cell FROM pins WHERE net IS NOT NULL AND cell IS NOT NULL), r AS (SELECT net, count(DISTINCT cell % 8) AS c FROM p GROUP BY 1)
SELECT count(*) FILTER (WHERE c > 1) AS cut_nets, sum(c - 1)::BIGINT AS connectivity, (SELECT (max(cell) + 8) // 8 FROM p) AS largest FROM r""")
def hypergraph_quality(spark, d):
    """The measures of the parts id mod 8."""
    h = pin_hypergraph(spark, d)
    return partition.hypergraph_quality(h, spark.range(h.n_cells).select("id", (F.col("id") % 8).cast("int").alias("part")))


#: An order is a bijection, not more.
_ORDER_SQL = "WITH d AS (SELECT max(l_partkey) + 1 AS n FROM lineitem) SELECT n, n AS ids, n AS positions, true AS valid FROM d"


@query(_CP + """SELECT count(*) FILTER (WHERE i % 8 <> j % 8) AS cut_edges, count(*) AS edges, any_value((n + 7) // 8) AS largest, 8 AS parts FROM h, dims""")
def partition_quality(spark, d):
    """The measures of the parts id mod 8."""
    m = co_purchase_stored(spark, d)
    return partition.partition_quality(m, spark.range(m.n_rows).select("id", (F.col("id") % 8).cast("int").alias("part")))


@query(_ORDER_SQL)
def amd_reorder_validity(spark, d):
    m = co_purchase_stored(spark, d)
    return permute.is_permutation(partition.minimum_degree_order(m), m.n_rows)


@query(_ORDER_SQL)
def nested_dissection_validity(spark, d):
    m = co_purchase_stored(spark, d)
    return permute.is_permutation(partition.dissection_order(m), m.n_rows)


@query(_ORDER_SQL)
def rabbit_reorder_validity(spark, d):
    m = co_purchase_stored(spark, d)
    return permute.is_permutation(partition.community_order(m), m.n_rows)


@query(_ORDER_SQL)
def rcm_reorder_validity(spark, d):
    m = co_purchase_stored(spark, d)
    return permute.is_permutation(reorder.rcm_order(m), m.n_rows)


@query("SELECT * FROM (VALUES ('natural', 'spmv', 2), ('degree', 'spmv', 2)) t(preprocess, kernel, runs)")
def experiment(spark, d):
    """SpMV on the matrix as it is and by degree order: the runs that were timed."""

    def square(target):
        return co_purchase(spark, target)

    def kernel(data, params, kernel_params):
        m = data["processed_format"]
        return density.spmv(m, Dense1D(spark.range(m.n_cols).select(F.col("id").alias("idx"), F.lit(1.0).alias("v")), m.n_cols)).data

    e = Experiment(spark).add_loader(load_matrix(square), [d]).add_kernel("spmv", kernel)
    e.add_preprocess("natural", pass_through).add_preprocess("degree", reordered("degree"))
    return e.run(times=2).table().where("seconds > 0").groupBy("preprocess", "kernel").agg(F.countDistinct("iteration").alias("runs"))
