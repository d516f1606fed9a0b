"""Orders of graphs that fit one task, in numpy: whole levels at a time, for many components at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Lists of about so many neighbours are looked at together; positions take eight bytes each meanwhile.
_TOGETHER = 1 << 21


class Adjacency:
    """Compressed lists of neighbours in the order of ``rank`` within each vertex."""

    def __init__(self, u: np.ndarray, v: np.ndarray, n: int, rank: tuple[np.ndarray, ...] = ()):
        order = np.lexsort((*rank[::-1], u)) if rank else np.lexsort((v, u))
        self.col = v[order]
        self.ptr = np.r_[0, np.cumsum(np.bincount(u, minlength=n))]
        self.degree = np.diff(self.ptr)
        self.n = n

    @classmethod
    def of_lists(cls, degree: np.ndarray, col: np.ndarray) -> Adjacency:
        """Of neighbours that already stand by vertex, in the order that their lists shall have."""
        adj = cls.__new__(cls)
        adj.col, adj.degree, adj.ptr, adj.n = col, degree, np.r_[0, np.cumsum(degree)], len(degree)
        return adj

    def in_pieces(self, front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vertices, their neighbours) of ``front``, bit by bit."""
        end = np.cumsum(self.degree[front])
        cuts = np.searchsorted(end, np.arange(_TOGETHER, end[-1], _TOGETHER)) if len(end) else []
        for own in np.split(front, np.unique(cuts)):
            if len(own):
                yield own, self.of(own)[1]

    def of(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in front, neighbour) of all neighbours, in order."""
        d = self.degree[front]
        place = np.repeat(np.arange(len(front)), d)
        return place, self.col[np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(self.ptr[front], d)]


def walk(adj: Adjacency, roots: np.ndarray, seen: np.ndarray, by_degree: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, levels) reached from ``roots`` in queue order, those of ``seen`` left out; marks ``seen``.

    Neighbours are queued in list order or, ``by_degree``, by (degree, id) for each vertex that reaches them.
    """
    out, levels, front = [roots], [np.zeros(len(roots), np.int64)], roots
    seen[roots] = True
    while len(front):
        place, near = adj.of(front)
        new = ~seen[near]
        place, near = place[new], near[new]
        near, first = np.unique(near, return_index=True)
        order = np.lexsort((near, adj.degree[near], place[first])) if by_degree else np.argsort(first)
        front = near[order]
        seen[front] = True
        out.append(front)
        levels.append(np.full(len(front), len(levels), np.int64))
    return np.concatenate(out), np.concatenate(levels)


def rcm_places(u: np.ndarray, v: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, comp, place) of whole components by their edges in both directions; place counts within the component."""
    ids, inner = np.unique(u, return_inverse=True)
    n = len(ids)
    adj = Adjacency(inner, np.searchsorted(ids, v), n)
    of = np.zeros(n, np.int64)
    comps, of[inner] = np.unique(comp, return_inverse=True)
    size = np.bincount(of)
    root = np.full(len(comps), n)
    np.minimum.at(root, of, np.arange(n))
    most, active = np.zeros(len(comps), np.int64), np.arange(len(comps))
    while len(active):
        queue, level = walk(adj, root[active], np.zeros(n, bool))
        top = np.zeros(len(comps), np.int64)
        np.maximum.at(top, of[queue], level)
        grew = top > most
        most = np.maximum(most, top)
        active = active[grew[active] & (size[active] != most[active] + 1)]
        last = np.flatnonzero(level == top[of[queue]])
        last = last[np.lexsort((last, adj.degree[queue[last]], of[queue[last]]))]
        owner, first = np.unique(of[queue[last]], return_index=True)
        best = np.full(len(comps), -1)
        best[owner] = queue[last[first]]
        root[active] = best[active]
    queue, _ = walk(adj, root, np.zeros(n, bool), by_degree=True)
    queue = queue[np.argsort(of[queue], kind="stable")]
    start = np.cumsum(size) - size
    place = size[of[queue]] - 1 - (np.arange(n) - start[of[queue]])
    return ids[queue], comps[of[queue]], place


def _top(degree: np.ndarray, alive: np.ndarray, k: int, greedy: bool, adj: Adjacency) -> np.ndarray:
    ids = np.flatnonzero(alive)
    if not greedy:
        return ids[np.lexsort((ids, -degree[ids]))][:k]
    degree, hubs = np.where(alive, degree, -1), []
    for _ in range(k):
        h = int(np.argmax(degree))
        hubs.append(h)
        near = adj.of(np.array([h]))[1]
        degree[near[degree[near] >= 0]] -= 1
        degree[h] = -1
    return np.array(hubs)


def listed(batches: Iterable[pa.RecordBatch], n: int | None = None) -> tuple[np.ndarray, Adjacency]:
    """(ids, lists of neighbours) from batches (u, v, at), which come in any sequence; four bytes a neighbour.

    By ``at``, u ascends and each list has its order; a stretch that is whole counts up by one. The ids are those of u, or all below ``n``.
    """
    runs = []
    for b in batches:
        if b.num_rows:
            u, v, at = (b[c].to_numpy(zero_copy_only=False) for c in ("u", "v", "at"))
            for stretch in np.split(np.arange(len(u)), np.flatnonzero(np.diff(at) != 1) + 1):
                own, low, high = slice(stretch[0], stretch[-1] + 1), int(at[stretch[0]]), v[stretch].max()
                first = np.flatnonzero(np.r_[True, u[own][1:] != u[own][:-1]])
                runs.append((low, u[own][first], np.diff(np.r_[first, len(stretch)]), v[own].astype(np.int32 if high < 2**31 else np.int64)))
    runs.sort(key=lambda r: r[0])
    ids = np.arange(n) if n is not None else np.unique(np.concatenate([r[1] for r in runs])) if runs else np.zeros(0, np.int64)
    degree, col, end = np.zeros(len(ids), np.int64), np.empty(sum(len(r[3]) for r in runs), np.int32), 0
    for k, (_, u, size, v) in enumerate(runs):
        degree[u if n is not None else np.searchsorted(ids, u)] += size
        col[end : end + len(v)] = v if n is not None else np.searchsorted(ids, v)
        end, runs[k] = end + len(v), None
    return ids, Adjacency.of_lists(degree, col)


def _reached(adj: Adjacency, root: int, gone: np.ndarray) -> np.ndarray:
    """Which vertices ``root`` reaches: each level goes on from its vertices or is looked for among what is left, whichever has fewer neighbours."""
    seen, front = gone.copy(), np.array([root])
    seen[root] = True
    while len(front):
        rest = np.flatnonzero(~seen & (adj.degree > 0))
        new = np.zeros(adj.n, bool)
        if adj.degree[front].sum() <= adj.degree[rest].sum():
            for _, near in adj.in_pieces(front):
                new[near] = True
            new &= ~seen
        else:
            there = seen & ~gone
            for own, near in adj.in_pieces(rest):
                d = adj.degree[own]
                new[own] = np.logical_or.reduceat(there[near], np.cumsum(d) - d)
        front = np.flatnonzero(new)
        seen[front] = True
    return seen & ~gone


def slashburn_places(u: np.ndarray, v: np.ndarray, side: np.ndarray, turn: np.ndarray, n: int, k: int, greedy: bool, hub_order: bool) -> np.ndarray:
    """The position of each vertex of a whole graph, by its edges in both directions and their places in the lists."""
    return slashburn_of(Adjacency(u, v, n, (side, turn)), k, greedy, hub_order)


def slashburn_of(adj: Adjacency, k: int, greedy: bool, hub_order: bool) -> np.ndarray:
    """The position of each vertex. The component of the vertex of highest degree, nearly always the largest, is walked through in order only if it is to be placed."""
    n = adj.n
    pos, front, back = np.full(n, -1), 0, n - 1
    gone, degree = np.zeros(n, bool), adj.degree.copy()

    def leave(ids: np.ndarray) -> None:
        gone[ids] = True
        for _, near in adj.in_pieces(ids):
            np.subtract(degree, np.bincount(near, minlength=n), out=degree)

    def found_from(starts: Iterable[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, np.ndarray | None]]:
        """(hub, size, root, queue) of each component, as they are met."""
        found, seen = [], gone.copy()
        if gone.all():
            return found
        big = _reached(adj, int(np.argmax(np.where(gone, -1, degree))), gone)
        for h, near in starts:
            for r in near[~seen[near]].tolist():
                if seen[r]:
                    continue
                if big[r]:
                    seen |= big
                    found.append((h, int(big.sum()), r, None))
                    continue
                queue = np.array([r])
                if degree[r]:
                    queue, _ = walk(adj, queue, seen)
                seen[r] = True
                found.append((h, len(queue), r, queue))
        return found

    found = found_from([(0, np.arange(n))])
    giant = max(found, key=lambda c: c[1:3], default=None)
    while giant is not None:
        final = giant[1] < k
        rest = sorted((c for c in found if c is not giant), key=lambda c: c[:3] if hub_order else c[1:3])
        fell = []
        for c in [*rest, giant] if final else rest:
            queue = walk(adj, np.array([c[2]]), gone.copy())[0] if c[3] is None else c[3]
            pos[queue] = back - np.arange(c[1])
            fell.append(queue)
            back -= c[1]
        if final:
            break
        if fell:
            leave(np.concatenate(fell))
        hubs = _top(degree, ~gone, k, greedy, adj)
        pos[hubs] = front + np.arange(len(hubs))
        front += len(hubs)
        leave(hubs)
        found = found_from((h, adj.of(hubs[h : h + 1])[1]) for h in range(len(hubs) - 1, -1, -1))
        giant = max(found, key=lambda c: c[1], default=None)  # the first of the largest
    return pos


def minimum_degree_rounds(u: np.ndarray, v: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, round, degree at that time) of the vertices of ``u``, by the edges in both directions."""
    ids, u = np.unique(u, return_inverse=True)
    return ids, *minimum_degree_of(Adjacency(u, np.searchsorted(ids, v), len(ids)), rounds)


def minimum_degree_of(adj: Adjacency, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(round, degree at that time) of each vertex.

    A round takes all vertices whose (degree, id) is least among their neighbours; with ``rounds``, what is left then has that number.
    A vertex is looked at again only when the neighbour that was least is gone or no longer less. Lists are cut to what is left when they have halved.
    """
    n, degree = adj.n, adj.degree.copy()
    when, at, alive, r = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), 0
    less = np.full(n, -1)
    while alive.any() and r != rounds:
        key = degree * n + np.arange(n)
        look = np.flatnonzero(alive & ((less < 0) | ~alive[less] | (key[less] > key)))
        gone = [look[adj.degree[look] == 0]]
        for own, near in adj.in_pieces(look[adj.degree[look] > 0]):
            d = adj.degree[own]
            least = np.minimum.reduceat(np.where(alive[near], key[near], n * n), np.cumsum(d) - d)
            less[own] = np.where(least < n * n, least % n, -1)
            gone.append(own[key[own] < least])
        out = np.concatenate(gone)
        when[out], at[out] = r, degree[out]
        alive[out] = False
        for _, near in adj.in_pieces(out):
            np.subtract(degree, np.bincount(near, minlength=n), out=degree)
        left = np.where(alive, degree, 0)
        if 2 * left.sum() < len(adj.col):
            adj = Adjacency.of_lists(left, np.concatenate([adj.col[:0], *(near[alive[near]] for _, near in adj.in_pieces(np.flatnonzero(left)))]))
        r += 1
    when[alive], at[alive] = r, degree[alive]
    return when, at


def dissection_places(u: np.ndarray, v: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, place) of the vertices of ``u`` by nested dissection down to ``leaf`` vertices, which stand by (degree, id).

    A breadth-first order is halved; the vertices of the second half that touch the first come after both.
    """
    ids, u = np.unique(u, return_inverse=True)
    out, todo = [], [(np.arange(len(ids)), u, np.searchsorted(ids, v), False)]
    while todo:  # what comes last is taken first
        own, u, v, whole = todo.pop()
        n, u, v = len(own), np.searchsorted(own, u), np.searchsorted(own, v)
        adj = Adjacency(u, v, n)
        if whole or n <= leaf:
            out.append(own[np.lexsort((own, adj.degree))][::-1])
            continue
        seen = adj.degree == 0
        queue = [np.flatnonzero(seen)]
        for r in range(n):
            if not seen[r]:
                queue.append(walk(adj, np.array([r]), seen)[0])
        part = np.empty(n, np.int64)
        part[np.concatenate(queue)] = np.arange(n) * 2 // n
        part[u[(part[u] == 1) & (part[v] == 0)]] = 2
        for p in range(3):
            inside = (part[u] == p) & (part[v] == p)
            todo.append((own[part == p], own[u[inside]], own[v[inside]], p == 2))
    return ids[np.concatenate(out)[::-1]], np.arange(len(ids))


def _pulls(part: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By how much less weight would be cut if each vertex changed sides."""
    return np.bincount(u, weights=np.where(part[u] != part[v], w, -w), minlength=len(part))


def _bisect(vw: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, share: float, slack: float) -> np.ndarray:
    """0 or 1 for each vertex: a breadth-first order cut where the first side has ``share`` of the weight, then batches of moves and exchanges while the cut falls."""
    n = len(vw)
    adj = Adjacency(u, v, n)
    seen = np.zeros(n, bool)
    far = np.zeros(n, bool)
    queue: list[np.ndarray] = []
    for r in range(n):
        if not seen[r]:
            reached = walk(adj, np.array([r]), seen)[0]
            queue.append(walk(adj, reached[-1:], far)[0])
    order = np.concatenate(queue)
    total = vw.sum()
    part = np.ones(n, np.int64)
    part[order[np.cumsum(vw[order]) - vw[order] / 2 <= total * share]] = 0
    most = np.array([total * share * slack + vw.max() / 2, total * (1 - share) * slack + vw.max() / 2])
    batch = max(1, n // 20)
    cut = w[part[u] != part[v]].sum()
    while batch:
        gain = _pulls(part, u, v, w)
        sides = [np.flatnonzero(part == s) for s in (0, 1)]
        tops = [x[np.argsort(-gain[x], kind="stable")][:batch] for x in sides]
        k = min(map(len, tops))
        swaps = np.concatenate([x[:k] for x in tops])
        tries = [swaps] + [x[gain[x] > 0] for x in tops]
        better = None
        for t in tries:
            new = part.copy()
            new[t] = 1 - new[t]
            size = np.bincount(new, weights=vw, minlength=2)
            if len(t) and (size <= most).all():
                now = w[new[u] != new[v]].sum()
                if now < cut * (1 - 5e-4) and (better is None or now < better[0]):
                    better = now, new
        if better is None:
            batch //= 2
        else:
            cut, part = better
    return part


def grow_parts(ids: np.ndarray, vw: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, parts: int, balance: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, part) of a weighted graph by halving it again and again; each side gets its share of the number of parts."""
    order = np.argsort(ids)
    ids, vw = ids[order], vw[order].astype(np.float64)
    u, v, w = np.searchsorted(ids, u), np.searchsorted(ids, v), w.astype(np.float64)
    part = np.zeros(len(ids), np.int32)
    slack = balance ** (1 / max(1, (parts - 1).bit_length()))
    todo = [(np.arange(len(ids)), 0, parts)]
    while todo:
        own, first, k = todo.pop()
        part[own] = first
        if k == 1 or len(own) < 2:
            continue
        inside = np.zeros(len(ids), bool)
        inside[own] = True
        e = inside[u] & inside[v]
        side = _bisect(vw[own], np.searchsorted(own, u[e]), np.searchsorted(own, v[e]), w[e], (k // 2) / k, slack)
        todo += [(own[side == 0], first, k // 2), (own[side == 1], first + k // 2, k - k // 2)]
    return ids, part
