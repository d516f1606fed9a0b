"""Small objects and plain re-statements of orders, for comparison."""

from __future__ import annotations

from gridloom.model import Sparse2D

#: 3 x 3 with values, and 7 x 7 symmetric with an empty row.
A = [(0, 1, 1.0), (0, 2, 2.0), (1, 0, 3.0), (2, 0, 4.0)]
B_PTR, B_COL = [0, 2, 2, 5, 7, 9, 11, 12], [2, 3, 0, 3, 4, 0, 2, 2, 5, 4, 6, 5]


def from_csr(ptr, col):
    return [(i, col[k]) for i in range(len(ptr) - 1) for k in range(ptr[i], ptr[i + 1])]


def build(spark, rows, n, m=None):
    schema = "i bigint, j bigint" + (", v double" if rows and len(rows[0]) == 3 else "")
    return Sparse2D(spark.createDataFrame(rows, schema), n, n if m is None else m)


def as_list(order):
    got = {r["id"]: r["pos"] for r in order.collect()}
    return [got[k] for k in sorted(got)]


def adjacency(edges, n):
    own = {u: sorted({j for i, j in edges if i == u and j != u}) for u in range(n)}
    return {u: own[u] + sorted({i for i, j in edges if j == u and i != u} - set(own[u]), reverse=True) for u in range(n)}


def walk(adj, root, key=None, alive=None):
    seen, queue, level = {root}, [root], {root: 0}
    for u in queue:
        new = [v for v in adj[u] if v not in seen and (alive is None or v in alive)]
        if key:
            new.sort(key=key)
        seen.update(new)
        level.update({v: level[u] + 1 for v in new})
        queue += new
    return queue, level


def plain_rcm(edges, n):
    adj = {u: sorted({j for i, j in edges if i == u} | {i for i, j in edges if j == u} - {u}) for u in range(n)}
    adj = {u: [v for v in a if v != u] for u, a in adj.items()}
    deg, out, seen = {u: len(adj[u]) for u in adj}, [], set()
    for s in range(n):
        if s in seen:
            continue
        root, most = s, 0
        while True:
            queue, level = walk(adj, root)
            top = max(level.values())
            grew, most = top > most, max(most, top)
            if not grew or len(queue) == most + 1:
                break
            root = min((v for v in queue if level[v] == top), key=lambda v: deg[v])
        queue, _ = walk(adj, root, key=lambda v: (deg[v], v))
        seen.update(queue)
        out += queue[::-1]
    return [p for _, p in sorted((v, p) for p, v in enumerate(out))]


def plain_slashburn(edges, n, k, greedy=False, hub_order=False):
    adj = adjacency(edges, n)
    front, back, alive = [], [], set(range(n))

    def component(v):
        return set(walk(adj, v, alive=alive)[0])

    found, left = [], set(alive)
    while left:
        root = min(left)
        c = component(root)
        left -= c
        found.append((0, len(c), root, c))
    giant = max(found, key=lambda x: (x[1], x[2]), default=None)
    while giant:
        final = giant[1] < k
        order = sorted(found, key=lambda x: (x is giant, *(x[:3] if hub_order else x[1:3])))
        for x in order if final else order[:-1]:
            back += walk(adj, x[2], alive=x[3])[0]
        if final:
            break
        alive = set(giant[3])
        degree = {v: sum(u in alive for u in adj[v]) for v in alive}
        hubs = []
        if greedy:
            for _ in range(k):
                v = min(degree, key=lambda v: (-degree[v], v))
                hubs.append(v)
                del degree[v]
                for u in adj[v]:
                    if u in degree:
                        degree[u] -= 1
        else:
            hubs = sorted(degree, key=lambda v: (-degree[v], v))[:k]
        front += hubs
        alive -= set(hubs)
        found, left = [], set(alive)
        for h in range(k - 1, -1, -1):
            for v in adj[hubs[h]]:
                if v in left:
                    c = component(v)
                    left -= c
                    found.append((h, len(c), v, c))
        giant = None
        for x in found:
            if giant is None or x[1] > giant[1]:
                giant = x
    pos = {v: p for p, v in enumerate(front)} | {v: n - 1 - p for p, v in enumerate(back)}
    return [pos[v] for v in range(n)]
