"""Vietoris-Rips barcodes (H0, H1) of small point clouds, for use inside Spark tasks.

H0 comes from the minimum spanning tree. For H1 the edges are put in one strict
order; an edge whose lune (points nearer to both ends than the ends are to each
other) is empty opens a loop or joins two components, and only edges whose lune
falls apart into several pieces can close one. One triangle per piece suffices: the
others are sums of it and of triangles that came earlier. Many small clouds take their
edges side by side, one array operation for the k-th edge of all of them.
"""

from __future__ import annotations

import numpy as np

from skein.schema import MAX_EDGE

# Cells of one (edges x points) table held at a time.
CELLS = 300_000
#: Distances of the clouds that go side by side, the fewest such clouds and their most points.
SIDE_CELLS, SIDE_CLOUDS, SIDE_POINTS = 2_500_000, 256, 64


def distance_matrices(clouds: np.ndarray) -> np.ndarray:
    """(B, n, d) points -> (B, n, n) Euclidean distances, coordinate by coordinate."""
    total = np.zeros((clouds.shape[0], clouds.shape[1], clouds.shape[1]))
    for j in range(clouds.shape[2]):
        step = clouds[:, :, None, j] - clouds[:, None, :, j]
        total += step * step
    return np.sqrt(total)


def tree_edges(dist: np.ndarray) -> np.ndarray:
    """(B, n - 1) edge lengths of the minimum spanning trees of a batch."""
    b, n, _ = dist.shape
    rows = np.arange(b)
    reach = dist[:, 0, :].copy()
    reach[:, 0] = np.inf
    done = np.zeros((b, n), dtype=bool)
    done[:, 0] = True
    out = np.empty((b, max(n - 1, 0)))
    for step in range(n - 1):
        pick = reach.argmin(axis=1)
        out[:, step] = reach[rows, pick]
        done[rows, pick] = True
        np.minimum(reach, dist[rows, pick], out=reach)
        reach[done] = np.inf
    return out


def component_bars(dist: np.ndarray, max_edge: float = MAX_EDGE) -> list[np.ndarray]:
    """H0 deaths per cloud; components that never merge end at ``max_edge``."""
    out = []
    for lengths in tree_edges(dist):
        merged = lengths[lengths <= max_edge]
        open_ends = np.full(len(lengths) - len(merged) + 1, max_edge)
        deaths = np.concatenate([merged, open_ends])
        out.append(np.sort(deaths[deaths > 0]))
    return out


def lune_tables(
    rank: np.ndarray, ia: np.ndarray, ib: np.ndarray, number: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per edge of each cloud: is its lune empty, its innermost point, may it have pieces.

    A lune whose points are all near its innermost point is surely in one piece.
    """
    b, m = number.shape
    n = rank.shape[1]
    empty = np.empty((b, m), dtype=bool)
    apex = np.empty((b, m), dtype=np.int32)
    loose = np.empty((b, m), dtype=bool)
    linked = rank.copy()
    linked[:, np.arange(n), np.arange(n)] = -1
    step = max(1, CELLS // max(1, n * n))
    for i in range(0, b, step):
        wide = max(1, CELLS // (n * min(step, b - i)))
        for j in range(0, m, wide):
            e = slice(j, j + wide)
            at = slice(i, i + step)
            own = number[at, e]
            side = np.maximum(rank[at][:, ia[e]], rank[at][:, ib[e]])
            inner = side.argmin(axis=2)
            inside = side < own[:, :, None]
            away = linked[at][np.arange(len(own))[:, None], inner] > own[:, :, None]
            away &= inside
            empty[at, e] = ~inside.any(axis=2)
            apex[at, e] = inner
            loose[at, e] = away.any(axis=2)
    return empty, apex, loose


def _pieces(lune: int, near: list[int]) -> list[int]:
    """One point of every connected piece of a lune, lowest first."""
    seeds = []
    while lune:
        seed = (lune & -lune).bit_length() - 1
        seeds.append(seed)
        lune ^= 1 << seed
        front = near[seed] & lune
        while front:
            lune ^= front
            reach = 0
            while front and lune & ~reach:
                low = front & -front
                reach |= near[low.bit_length() - 1]
                front ^= low
            front = reach & lune
    return seeds


def _loops(
    ia: list[int],
    ib: list[int],
    rank: np.ndarray,
    empty: np.ndarray,
    apex: np.ndarray,
    loose: np.ndarray,
) -> list[tuple[int, int]]:
    """(birth edge, closing edge or -1) by edge number.

    Columns of the boundary matrix are integers whose bits are edge numbers.
    """
    n = len(rank)
    bit = [1 << i for i in range(n)]
    near = [0] * n
    root = list(range(n))
    closed: dict[int, int] = {}
    births: set[int] = set()
    pairs = []
    linked = 0
    late = int(np.flatnonzero(empty)[-1])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def sides(e: int, c: int) -> int:
        """The two other edges of the triangle of edge e and point c."""
        return 1 << int(rank[ia[e], c]) ^ 1 << int(rank[ib[e], c])

    for e in np.flatnonzero(empty | loose).tolist():
        a, b = ia[e], ib[e]
        if empty[e]:
            ra, rb = find(a), find(b)
            if ra == rb:
                births.add(e)
            else:
                root[ra] = rb
            continue
        if not births:
            if e > late:
                break
            continue
        for x, y in zip(ia[linked:e], ib[linked:e]):
            near[x] |= bit[y]
            near[y] |= bit[x]
        linked = e
        seeds = _pieces(near[a] & near[b], near)
        for c in seeds[1:]:
            column = sides(e, seeds[0]) ^ sides(e, c)
            while column:
                top = column.bit_length() - 1
                if not empty[top]:
                    column ^= 1 << top ^ sides(top, int(apex[top]))
                elif top in closed:
                    column ^= closed[top]
                else:
                    closed[top] = column
                    births.discard(top)
                    pairs.append((top, e))
                    break
    return pairs + [(e, -1) for e in births]


def _side_by_side(dist: np.ndarray, max_edge: float, word: type) -> tuple[list[np.ndarray], np.ndarray]:
    """H1 pairs per cloud, and the clouds with more open loops than ``word`` has bits (their pairs are void).

    ``table`` has, for every edge so far, the open loops that its cycle through the tree is
    made of, one bit each. The two other edges of a triangle of a new edge tell its loops; if the
    triangles of an edge disagree, the difference is a loop that ends there, and the
    youngest in it is written as the others from then on. Edges longer than the smallest
    distance from one point to all others change nothing: that point fills every loop.
    """
    b, n, _ = dist.shape
    ia, ib = np.triu_indices(n, 1)
    lengths = dist[:, ia, ib]
    order = np.argsort(lengths, axis=1)
    reach = np.minimum(dist.max(axis=2).min(axis=1), max_edge)
    within = (lengths <= reach[:, None]).sum(axis=1)
    by = np.argsort(-within)
    order, within = order[by], within[by]
    live = np.searchsorted(-within, -np.arange(len(ia)))
    first = np.arange(b) * n
    ends_a, ends_b = (np.ascontiguousarray(i.astype(np.uint8)[order].T) for i in (ia, ib))
    bits = np.iinfo(word).bits - 1
    signed, one, absent = np.dtype(f"i{bits // 8 + 1}"), word(1), word(1 << bits)
    table = np.full((b * n, n), absent, dtype=word)
    flat, square = table.reshape(-1), table.reshape(b, n, n)
    part = np.tile(np.arange(n, dtype=np.int16), (b, 1))
    used = np.zeros(b, dtype=np.int64)
    born = np.full((b, bits), -1)
    places = np.arange(bits)
    over = np.zeros(b, dtype=bool)
    ended = []
    for k in range(int(within[0])):
        a, b = ends_a[k, : live[k]], ends_b[k, : live[k]]
        at_a, at_b = first[: live[k]] + a, first[: live[k]] + b
        left, right = table.take(at_a, axis=0), table.take(at_b, axis=0)
        sides = left ^ right
        left |= right
        left &= absent
        sides |= left  # a negative number where a triangle's edge is still to come
        low, high = sides.min(axis=1), sides.view(signed).max(axis=1)
        value = low & ~absent
        i = np.flatnonzero(high < 0)
        if len(i):
            pa, pb = part[i, a[i]], part[i, b[i]]
            tree = pa != pb
            to, joined = i[tree], pb[tree, None]
            rows = part[to]
            part[to] = np.where(rows == joined, pa[tree, None], rows)
            i = i[~tree]
            spare = ~used[i] & (used[i] + 1) & ((1 << bits) - 1)
            over[i[spare == 0]] = True
            i, spare = i[spare > 0], spare[spare > 0]
            used[i] |= spare
            value[i] = spare
            born[i, np.bitwise_count(spare - 1)] = k
        i = np.flatnonzero((high >= 0) & (high != low.view(signed)))
        if len(i):
            sides, low, high = sides[i], low[i], high[i].view(word)
        while len(i):
            loop = low ^ high
            age = np.where(loop[:, None].astype(np.int64) >> places & 1, born[i], -1)
            youngest = age.argmax(axis=1)
            ended.append((i, age.max(axis=1), np.full(len(i), k)))
            used[i] &= ~(1 << youngest)
            shift = youngest.astype(word)
            held = square[i]
            held ^= (held >> shift[:, None, None] & one) * loop[:, None, None]
            square[i] = held
            sides ^= (sides >> shift[:, None] & one) * loop[:, None]
            low, high = sides.min(axis=1), sides.view(signed).max(axis=1).view(word)
            value[i] = low
            more = low != high
            i, sides, low, high = i[more], sides[more], low[more], high[more]
        flat[at_a * n + b] = value
        flat[at_b * n + a] = value
    i, place = np.nonzero(used[:, None] >> places & 1)
    ended.append((i, born[i, place], np.full(len(i), -1)))
    who, start, end = (np.concatenate(x) for x in zip(*ended))
    birth, death = (lengths[by[who], order[who, e]] for e in (start, end))
    death[end < 0] = max_edge
    real = death > birth
    who, birth, death = by[who[real]], birth[real], death[real]
    order = np.lexsort((death, birth, who))
    bars = np.stack([birth, death], axis=1)[order]
    cuts = np.searchsorted(who[order], np.arange(1, len(by)))
    return np.split(bars, cuts), by[np.flatnonzero(over)]


def loop_bars(dist: np.ndarray, max_edge: float = MAX_EDGE) -> list[np.ndarray]:
    """H1 (birth, death) pairs with positive length per cloud of a batch."""
    b, n, _ = dist.shape
    if not 4 <= n <= SIDE_POINTS or b < SIDE_CLOUDS:
        return _loop_bars_each(dist, max_edge)
    step = max(SIDE_CLOUDS, SIDE_CELLS // (n * n))
    out = []
    for at in range(0, b, step):
        block = dist[at : at + step]
        rest = np.arange(len(block))
        found: list[np.ndarray] = [np.empty((0, 2))] * len(block)
        for word in (np.uint16, np.uint32):
            if len(rest) >= SIDE_CLOUDS:
                bars, over = _side_by_side(block[rest], max_edge, word)
                for i, x in zip(rest, bars):
                    found[i] = x
                rest = rest[over]
        if len(rest):
            for i, x in zip(rest, _loop_bars_each(block[rest], max_edge)):
                found[i] = x
        out += found
    return out


def _loop_bars_each(dist: np.ndarray, max_edge: float) -> list[np.ndarray]:
    """``loop_bars``, one cloud after the other, however many points and loops it has."""
    b, n, _ = dist.shape
    none = np.empty((0, 2))
    if n < 4:
        return [none] * b
    ia, ib = np.triu_indices(n, 1)
    lengths = dist[:, ia, ib]
    order = np.argsort(lengths, axis=1, kind="stable")
    m = len(ia)
    small = np.int16 if m < 32_000 else np.int32
    number = np.empty((b, m), dtype=small)
    np.put_along_axis(number, order, np.arange(m, dtype=small)[None, :], axis=1)
    rank = np.full((b, n, n), np.iinfo(small).max, dtype=small)
    rank[:, ia, ib] = number
    rank[:, ib, ia] = number
    lune_empty, apex, loose = lune_tables(rank, ia, ib, number)
    out = []
    for i in range(b):
        seq = order[i]
        within = int(np.searchsorted(lengths[i, seq], max_edge, side="right"))
        seq = seq[:within]
        empty = lune_empty[i, seq]
        if int(empty.sum()) < 4:
            out.append(none)
            continue
        pairs = _loops(
            ia[seq].tolist(), ib[seq].tolist(), rank[i], empty, apex[i, seq], loose[i, seq]
        )
        size = lengths[i, seq]
        bars = np.array(
            [(size[e], size[f] if f >= 0 else max_edge) for e, f in pairs], dtype=float
        ).reshape(-1, 2)
        bars = bars[bars[:, 1] > bars[:, 0]]
        out.append(bars[np.lexsort((bars[:, 1], bars[:, 0]))])
    return out


def barcodes(clouds: np.ndarray, max_edge: float = MAX_EDGE, loops: bool = True) -> list[np.ndarray]:
    """(B, n, d) points -> per cloud an array of (dim, birth, death) rows; without ``loops``, H0 alone."""
    b, n, _ = clouds.shape
    if n == 0:
        return [np.empty((0, 3))] * b
    if not np.isfinite(clouds).all():
        raise ValueError("a point has a missing or infinite coordinate")
    return bars_of(distance_matrices(clouds), max_edge, loops)


def frame_distances(cloud: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(B, n, n) distances of the runs of ``n`` rows of a cloud that begin at ``starts``; each pair is computed once."""
    if not np.isfinite(cloud).all():
        raise ValueError("a point has a missing or infinite coordinate")
    dist = distance_matrices(cloud[None])[0]
    down, across = dist.strides
    runs = np.lib.stride_tricks.as_strided(dist, (len(dist) - n + 1, n, n), (down + across, down, across), writeable=False)
    return runs[starts]


def bars_of(dist: np.ndarray, max_edge: float = MAX_EDGE, loops: bool = True) -> list[np.ndarray]:
    """(B, n, n) distances -> per cloud an array of (dim, birth, death) rows."""
    out = []
    none = [np.empty((0, 2))] * len(dist)
    for h0, h1 in zip(component_bars(dist, max_edge), loop_bars(dist, max_edge) if loops else none):
        bars = np.zeros((len(h0) + len(h1), 3))
        bars[: len(h0), 2] = h0
        bars[len(h0) :, 0] = 1
        bars[len(h0) :, 1:] = h1
        out.append(bars)
    return out
