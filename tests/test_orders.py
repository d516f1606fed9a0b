import random

import pytest
from helpers import A, B_COL, B_PTR, as_list, build, from_csr, plain_rcm, plain_slashburn

from gridloom.errors import FunctionNotFoundError, ReorderError
from gridloom.model import HyperGraph
from gridloom.operators import features, partition, permute, reorder


def random_graph(seed, n, m, symmetric=True):
    rng = random.Random(seed)
    e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    e = {(i, j) for i, j in e if i != j}
    return sorted(e | {(j, i) for i, j in e} if symmetric else e)


def is_order(order, n):
    return permute.is_permutation(order, n).first()["valid"]


def test_known_orders(spark):
    a, b = build(spark, A, 3), build(spark, from_csr(B_PTR, B_COL), 7)
    assert as_list(reorder.degree_order(a)) == [2, 1, 0] and as_list(reorder.degree_order(a, ascending=False)) == [0, 1, 2]
    assert as_list(reorder.degree_order(b)) == [5, 0, 6, 4, 3, 2, 1] and as_list(reorder.degree_order(b, False)) == [1, 6, 0, 2, 3, 4, 5]
    assert as_list(reorder.boba_order(a)) == [2, 0, 1] and as_list(reorder.boba_order(b)) == [2, 6, 0, 1, 3, 4, 5]
    assert as_list(reorder.rcm_order(a)) == [1, 2, 0] and as_list(reorder.rcm_order(b)) == [1, 6, 2, 0, 3, 4, 5]
    moved = permute.permute_same(b, reorder.rcm_order(b))
    assert features.scalars(moved, ["bandwidth"]).first()[0] == 3


@pytest.mark.parametrize("seed, n, m", [(1, 12, 10), (2, 40, 50), (3, 60, 40), (4, 30, 200)])
def test_rcm_in_tasks_against_a_queue(spark, seed, n, m):
    e = random_graph(seed, n, m)
    assert as_list(reorder.rcm_order(build(spark, e, n))) == plain_rcm(e, n)


def test_rcm_by_levels_against_a_queue(spark):
    e = [*random_graph(6, 20, 15), (21, 22), (22, 21)]
    assert as_list(reorder.rcm_order(build(spark, e, 24), task_edges=4)) == plain_rcm(e, 24)  # one component either way


def test_rcm_of_a_path_and_of_nothing(spark):
    path = [(k, k + 1) for k in range(5)]
    e = path + [(j, i) for i, j in path]
    assert as_list(reorder.rcm_order(build(spark, e, 6))) == plain_rcm(e, 6)
    assert as_list(reorder.rcm_order(build(spark, [(0, 0)], 4))) == [0, 1, 2, 3]


@pytest.mark.parametrize("task", [0, reorder.TASK_EDGES])
@pytest.mark.parametrize("seed, n, m, k, greedy, hub", [(1, 16, 20, 2, False, False), (2, 18, 24, 3, True, True)])
def test_slashburn_against_a_plain_one(spark, seed, n, m, k, greedy, hub, task):
    e = random_graph(seed, n, m, symmetric=seed % 2 == 0)
    got = as_list(reorder.slashburn_order(build(spark, e, n), k, greedy, hub, task_edges=task))
    assert sorted(got) == list(range(n))
    assert got == plain_slashburn(e, n, k, greedy, hub)


@pytest.mark.parametrize("greedy, hub", [(False, False), (True, True)])
def test_slashburn_that_ends_in_a_task(spark, greedy, hub, monkeypatch):
    e = random_graph(9, 30, 55, symmetric=False)
    rests, rest = [], reorder._slashburn_rest
    monkeypatch.setattr(reorder, "_slashburn_rest", lambda edges, front, *a: rests.append(front) or rest(edges, front, *a))
    got = as_list(reorder.slashburn_order(build(spark, e, 30), 2, greedy, hub, task_edges=60))
    assert rests and rests[0] > 0 and got == plain_slashburn(e, 30, 2, greedy, hub)


def test_slashburn_query_takes_few_hubs_a_round(spark):
    import __spark_entry__
    from gridloom.sources.objects import co_purchase

    folder = "/root/testdata/sf0.001"
    m = co_purchase(spark, folder)
    e = [tuple(r) for r in m.nz.select("i", "j").collect()]
    got = as_list(__spark_entry__.queries()["slashburn_reorder"](spark, folder))
    assert got == plain_slashburn(e, m.n_rows, max(1, m.n_rows // 200), hub_order=True)


@pytest.mark.parametrize("seed", range(12))
def test_slashburn_in_a_task(seed):
    import numpy as np

    from gridloom.operators.in_task import slashburn_places

    rng = random.Random(seed)
    n, k = rng.randint(2, 40), rng.randint(1, 5)
    e = random_graph(seed, n, rng.randint(0, 70), symmetric=False)
    own, into = set(e), {(j, i) for i, j in e}
    rows = [(u, v, 0, v) for u, v in own] + [(u, v, 1, -v) for u, v in into - own]
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    for greedy in (False, True):
        for hub in (False, True):
            assert slashburn_places(*cols, n, k, greedy, hub).tolist() == plain_slashburn(e, n, k, greedy, hub)


def test_slashburn_in_a_task_walks_through_little(monkeypatch):
    """The largest component is not queued anew in each round."""
    import numpy as np

    from gridloom.operators import in_task

    walked, walk = [], in_task.walk
    monkeypatch.setattr(in_task, "walk", lambda *a, **k: walked.append(len((got := walk(*a, **k))[0])) or got)
    monkeypatch.setattr(in_task, "_TOGETHER", 64, raising=False)
    n, e = 150, random_graph(5, 150, 700)
    u, v = np.array(sorted(e)).T
    assert in_task.slashburn_places(u, v, np.zeros(len(u), int), v, n, 2, False, True).tolist() == plain_slashburn(e, n, 2, hub_order=True)
    assert sum(walked) <= n


def test_minimum_degree_looks_at_few_lists_again(monkeypatch):
    import numpy as np

    from gridloom.operators import in_task

    looked, of = [], in_task.Adjacency.of
    monkeypatch.setattr(in_task.Adjacency, "of", lambda self, front: looked.append(int(self.degree[front].sum())) or of(self, front))
    e = random_graph(6, 300, 3000)
    u, v = np.array(e).T
    ids, when, at = in_task.minimum_degree_rounds(u, v)
    alive, near, r = set(range(300)), {k: {j for i, j in e if i == k} for k in range(300)}, 0
    while alive:
        key = {k: (len(near[k]), k) for k in alive}
        gone = {k for k in alive if all(key[k] < key[j] for j in near[k])}
        assert {int(k) for k in ids[when == r]} == gone and all(at[k] == key[k][0] for k in gone)
        alive, r = alive - gone, r + 1
        near = {k: near[k] - gone for k in alive}
    assert 0 < sum(looked) < len(e) * r / 3  # all lists in all rounds would be several times that


def test_lists_from_batches_in_any_sequence():
    import numpy as np
    import pyarrow as pa

    from gridloom.operators.in_task import listed

    rows = [(u, v) for u in (3, 5, 2**40) for v in (2**40, 5, 3) if u != v]  # descending, as lists may be
    at = [10, 11, 12, 50, 51, 52]
    for order in ([0, 1, 2, 3, 4, 5], [4, 5, 0, 1, 2, 3], [2, 3, 4, 5, 0, 1], [3, 0, 4, 1, 5, 2]):
        for size in (1, 2, 4, 6):
            parts = [order[k : k + size] for k in range(0, 6, size)]
            batches = [pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in p]), pa.array([rows[k][1] for k in p]), pa.array([at[k] for k in p])], ["u", "v", "at"]) for p in parts]
            ids, adj = listed(batches)
            assert ids.tolist() == [3, 5, 2**40] and adj.col.tolist() == [2, 1, 2, 0, 1, 0] and np.diff(adj.ptr).tolist() == [2, 2, 2]


def plain_gray(rows, n, m, res, threshold, group):
    res0 = res
    res = min(res, m)
    width, cols = m // res, {i: [j for a, j in rows if a == i] for i in range(n)}

    def rank(i, floor):
        bits = 0
        for b in range(res):
            if sum(min(j // width, res - 1) == b for j in cols[i]) > floor:
                bits |= 1 << b
        out = 0
        while bits:
            out ^= bits
            bits >>= 1
        return out

    sparse = [i for i in range(n) if len(cols[i]) <= threshold]
    dense = [i for i in range(n) if len(cols[i]) > threshold]
    near = lambda ids: (lambda d: d and sum(abs(i - j) <= m // 128 for i in ids for j in cols[i]) / d)(sum(len(cols[i]) for i in ids))
    if near(sparse) > 0.3:
        sparse.sort(key=lambda i: (len(cols[i]), i))
    else:
        counts = sorted({len(cols[i]) for i in sparse if cols[i]})
        groups = {c: p // group for p, c in enumerate(counts)}
        key = lambda i: (groups[len(cols[i])], rank(i, 0) * (-1 if groups[len(cols[i])] % 2 else 1), i)
        sparse = [i for i in sparse if not cols[i]] + sorted((i for i in sparse if cols[i]), key=key)
    if near(dense) <= 0.2:
        dense.sort(key=lambda i: (rank(i, len(cols[i]) // res), i))
    assert res0 >= res
    return [p for _, p in sorted((i, p) for p, i in enumerate(sparse + dense))]


@pytest.mark.parametrize("seed, res, threshold, group", [(1, 16, 4, 1), (2, 32, 3, 2), (3, 64, 10, 3), (4, 64, 0, 1)])
def test_gray_against_a_plain_one(spark, seed, res, threshold, group):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(40), rng.randrange(200)) for _ in range(220)})
    assert as_list(reorder.gray_order(build(spark, rows, 42, 200), res, threshold, group)) == plain_gray(rows, 42, 200, res, threshold, group)


def test_gray_of_a_band_and_errors(spark):
    band = [(i, i) for i in range(20)] + [(3, 4), (7, 8)]
    assert as_list(reorder.gray_order(build(spark, band, 20), 16, 5, 1)) == plain_gray(band, 20, 20, 16, 5, 1)
    with pytest.raises(ReorderError):
        reorder.gray_order(build(spark, band, 20), 20)


def test_registry(spark):
    b = build(spark, from_csr(B_PTR, B_COL), 7)
    reorder.register("identity", lambda m: m.row_ids().selectExpr("i as id", "i as pos"))
    assert as_list(reorder.reorder("identity", b)) == list(range(7))
    reorder.unregister("identity")
    with pytest.raises(FunctionNotFoundError):
        reorder.reorder("identity", b)
    with pytest.raises(ReorderError):
        reorder.generic_order(b, lambda m: m.row_ids())


def test_heuristic_orders_and_partitions(spark):
    e = random_graph(7, 60, 150)
    m = build(spark, e, 60)
    for order in (partition.minimum_degree_order(m, 3), partition.dissection_order(m, 2), partition.community_order(m)):
        assert is_order(order, 60)
    parts = partition.multilevel_partition(m, 4, "rb", coarse=30)
    assert sorted(r["id"] for r in parts.collect()) == list(range(60))
    assert partition.partition_quality(m, parts).first()["largest"] <= 17
    with pytest.raises(ReorderError):
        partition.label_partition(m, 0)


def communities(seed, k, size, inside, across):
    """A graph of k communities, vertex v in community v mod k."""
    rng = random.Random(seed)
    n = k * size
    e = {(i, j) for i in range(n) for j in range(i) if rng.random() < (inside if i % k == j % k else across)}
    return sorted(e | {(j, i) for i, j in e}), n


def test_multilevel_partition_coarsens_where_matching_stalls(spark):
    """Eight stars whose leaves alternate: an edge joins few of their vertices, and of runs of ids the last two never meet a hub."""
    star = [(h, leaf) for h in range(8) for leaf in range(8 + h, 240, 8)]
    m = build(spark, star + [(j, i) for i, j in star], 240)
    q = partition.partition_quality(m, partition.multilevel_partition(m, 4, "rb", coarse=32)).first()
    assert q["parts"] == 4 and q["cut_edges"] <= 60


@pytest.mark.parametrize("ptype", ["kway", "rb"])
@pytest.mark.parametrize("coarse", [12, 4096])
def test_multilevel_partition_finds_communities(spark, ptype, coarse):
    e, n = communities(3, 4, 20, 0.6, 0.01)
    m = build(spark, e, n)
    planted = sum(i % 4 != j % 4 for i, j in e) // 2
    q = partition.partition_quality(m, partition.partition("multilevel", m, 4, ptype=ptype, coarse=coarse)).first()
    assert q["cut_edges"] <= 1.3 * planted and q["largest"] <= 22 and q["parts"] == 4


def test_partition_of_little(spark):
    nothing = build(spark, [(0, 0)], 5)
    assert sorted(r["id"] for r in partition.multilevel_partition(nothing, 2, coarse=2).collect()) == list(range(5))
    star = [(0, k) for k in range(1, 40)]
    parts = partition.multilevel_partition(build(spark, star + [(j, i) for i, j in star], 40), 2, coarse=4).collect()
    assert len(parts) == 40 and max(sum(r["part"] == p for r in parts) for p in (0, 1)) <= 21


@pytest.mark.parametrize("init", ["bfs", "block"])
def test_label_propagation_keeps_its_bounds(spark, init):
    e, n = communities(5, 2, 20, 0.7, 0.02)
    hub = [(0, k) for k in range(1, n)]
    m = build(spark, sorted(set(e) | set(hub) | {(j, i) for i, j in hub}), n)
    parts = {r["id"]: r["part"] for r in partition.label_partition(m, 2, 1.2, edge_balance=1.3, init=init).collect()}
    start = {"block": lambda v: v * 2 // n, "bfs": None}[init]
    assert max(sum(p == s for p in parts.values()) for s in (0, 1)) <= 24
    if start:
        cut = lambda of: sum(of(i) != of(j) for i, j in e)
        assert cut(parts.get) < cut(start)


@pytest.mark.parametrize("objective", ["con", "cut"])
def test_hypergraph_partition(spark, objective):
    rng = random.Random(4)
    pins = [(net, 2 * rng.randrange(15) + net % 2) for net in range(60) for _ in range(4)]
    h = HyperGraph(spark.createDataFrame(pins, "net bigint, cell bigint"), 60, 30)
    runs = spark.range(30).selectExpr("id", "cast(id div 15 as int) as part")
    got = partition.hypergraph_quality(h, partition.partition("hypergraph", h, 2, balance=1.2, objective=objective)).first()
    start = partition.hypergraph_quality(h, runs).first()
    assert got["connectivity"] < start["connectivity"] and got["cut_nets"] < start["cut_nets"] and got["largest"] <= 18


def test_partition_registry(spark):
    m = build(spark, [(0, 1), (1, 0)], 4)
    partition.register("even", lambda m, k: m.row_ids().selectExpr("i as id", f"cast(i % {k} as int) as part"))
    assert partition.partition("even", m, 2).count() == 4
    partition.unregister("even")
    for wrong in (lambda: partition.partition("even", m, 2), lambda: partition.unregister("even")):
        with pytest.raises(FunctionNotFoundError):
            wrong()
    assert {"minimum_degree", "dissection", "community"} <= set(reorder.ORDERS)
    with pytest.raises(ReorderError):
        partition.multilevel_partition(m, 3, "rb")


def test_community_order_keeps_communities_together(spark):
    e, n = communities(6, 5, 12, 0.7, 0.01)
    pos = as_list(reorder.reorder("community", build(spark, e, n)))
    by = sorted(range(n), key=pos.__getitem__)
    assert sum(by[k] % 5 != by[k + 1] % 5 for k in range(n - 1)) <= 8


def plain_minimum_degree(edges, n):
    adj = {u: {j for i, j in edges if i == u and j != u} | {i for i, j in edges if j == u and i != u} for u in range(n)}
    out, rounds = [], 0
    while adj:
        key = {u: (len(adj[u]), u) for u in adj}
        gone = [u for u in adj if all(key[u] < key[v] for v in adj[u])]
        out += sorted(gone, key=key.get)
        adj = {u: a - set(gone) for u, a in adj.items() if u not in set(gone)}
        rounds += 1
    return [p for _, p in sorted((v, p) for p, v in enumerate(out))], rounds


@pytest.mark.parametrize("n, m, task", [(60, 700, 10**6), (60, 700, 1000), (7, 9, 0)])
def test_minimum_degree_goes_on_until_no_vertex_is_left(spark, n, m, task):
    e = random_graph(11, n - 2, m)  # the last two have no edges
    want, rounds = plain_minimum_degree(e, n)
    assert n < 60 or rounds > 8
    assert as_list(partition.minimum_degree_order(build(spark, e, n), task_edges=task)) == want
    if task == 10**6:
        assert as_list(partition.minimum_degree_order(build(spark, e, n))) == want
    if task == 0:
        m = build(spark, e, n)
        assert as_list(partition.minimum_degree_order(m, 1, task_edges=0)) == as_list(partition.minimum_degree_order(m, 1))


def test_dissection_goes_on_inside_large_parts(spark, monkeypatch):
    n = 400
    halves = lambda m, parts, *a, **k: m.row_ids().selectExpr("i as id", f"cast(i * {parts} div {n} as int) as part")
    monkeypatch.setattr(partition, "multilevel_partition", halves)  # its search takes as many rounds as a path is long
    path = [(k, k + 1) for k in range(n - 1)]
    pos = as_list(partition.dissection_order(build(spark, path + [(j, i) for i, j in path], n), 1))
    assert sorted(pos) == list(range(n))
    near = {v: {w for w in (v - 1, v + 1) if 0 <= w < n} for v in range(n)}
    height = dict.fromkeys(near, 1)
    for v in sorted(near, key=pos.__getitem__):  # the height of the elimination tree
        for w in near[v]:
            near[w] = (near[w] | near[v]) - {v, w}
        if near[v]:
            up = min(near[v], key=pos.__getitem__)
            height[up] = max(height[up], height[v] + 1)
    assert max(height.values()) <= 64 + 4
