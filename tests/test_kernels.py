"""Barcode and distance kernels against brute force and known shapes."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions import barcode, matching
from skein.functions.barcode import barcodes, component_bars, distance_matrices
from skein.functions.kdtree import box_distance, build_tree, find_cells
from skein.functions.matching import wasserstein2


def bars_of(points, dim, max_edge=5.0):
    found = barcodes(np.array(points, dtype=float)[None], max_edge)[0]
    return [(b, d) for k, b, d in found if k == dim]


def boundary_reduction(points, max_edge=5.0):
    """All bars of the full complex up to triangles, by plain matrix reduction."""
    n = len(points)
    dist = distance_matrices(points[None])[0]
    simplices = [(0.0, 0, (i,)) for i in range(n)]
    for size in (2, 3):
        for s in itertools.combinations(range(n), size):
            value = max(dist[a, b] for a, b in itertools.combinations(s, 2))
            if value <= max_edge:
                simplices.append((value, size - 1, s))
    simplices.sort()
    number = {s: i for i, (_, _, s) in enumerate(simplices)}
    columns, paired, bars = {}, set(), []
    for i, (value, dim, s) in enumerate(simplices):
        column = {number[f] for f in itertools.combinations(s, dim)} if dim else set()
        while column and max(column) in columns:
            column ^= columns[max(column)]
        if column:
            low = max(column)
            columns[low] = column
            paired |= {i, low}
            if value > simplices[low][0]:
                bars.append((dim - 1, simplices[low][0], value))
    for i, (value, dim, _) in enumerate(simplices):
        if i not in paired and dim < 2 and value < max_edge:
            bars.append((dim, value, max_edge))
    return sorted(bars)


def test_known_shapes():
    square = [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert bars_of(square, 1) == [(1.0, math.sqrt(2.0))]
    assert len(bars_of([(math.cos(t), math.sin(t)) for t in np.arange(8) * math.pi / 4], 1)) == 1
    grid = list(itertools.product(range(5), range(5)))
    assert bars_of(grid, 1) == [(1.0, math.sqrt(2.0))] * 16
    assert bars_of([(0, 0), (1, 0), (2, 0)], 1) == []
    assert bars_of([(1, 1)] * 4, 0) == [(0.0, 5.0)]
    assert bars_of([(1, 1)], 0) == [(0.0, 5.0)]
    two_far = [(0, 0), (0, 1), (10, 0), (10, 1)]
    assert bars_of(two_far, 0) == [(0.0, 1.0), (0.0, 1.0), (0.0, 5.0), (0.0, 5.0)]
    assert barcodes(np.empty((1, 0, 2)))[0].shape == (0, 3)


@pytest.mark.parametrize("seed", range(60))
def test_bars_equal_boundary_reduction(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(rng.integers(1, 13), rng.integers(1, 5))) * rng.choice([0.5, 1.5, 4.0])
    if seed % 3 == 0:
        points = np.round(points)
    got = sorted(map(tuple, barcodes(points[None])[0]))
    want = boundary_reduction(points)
    assert len(got) == len(want)
    if want:
        assert np.allclose(got, want)


@pytest.mark.parametrize("n", [50, 100])
def test_components_match_tree(n):
    cloud = np.random.default_rng(n).normal(size=(1, n, 3))
    deaths = component_bars(distance_matrices(cloud))[0]
    assert len(deaths) == n and deaths.max() == 5.0


@pytest.mark.parametrize("seed", range(12))
def test_many_clouds_side_by_side_equal_each_alone(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(300, rng.integers(4, 30), rng.integers(2, 5))) * rng.choice([0.5, 1.5, 4.0])
    if seed % 3 == 0:
        points = np.round(points)
    dist = distance_matrices(points)
    together, each = barcode.loop_bars(dist), barcode._loop_bars_each(dist, 5.0)
    assert len(together) == 300 and all(np.array_equal(a, b) for a, b in zip(together, each))


def test_more_open_loops_than_bits():
    """Sixteen loops open at once: the clouds beyond a word's bits are told, and done otherwise."""
    corners = np.array([(0, 0), (0, 1), (1, 1), (1, 0)], dtype=float)
    cloud = np.concatenate([corners + (20 * i, 0) for i in range(16)])
    many = np.repeat(cloud[None], 300, axis=0)
    many[::2] += np.random.default_rng(0).normal(scale=1e-3, size=many[::2].shape)
    dist = distance_matrices(many)
    assert len(barcode._side_by_side(dist, 5.0, np.uint16)[1]) == 300
    assert len(barcode._side_by_side(dist, 5.0, np.uint32)[1]) == 0
    assert [len(x) for x in barcode.loop_bars(dist)] == [16] * 300


def test_frames_share_their_distances():
    cloud = np.random.default_rng(1).normal(size=(40, 3))
    starts = np.array([0, 3, 4, 30])
    frames = barcode.frame_distances(cloud, starts, 10)
    assert np.array_equal(frames, distance_matrices(np.stack([cloud[i : i + 10] for i in starts])))
    with pytest.raises(ValueError):
        barcode.frame_distances(np.full((20, 2), np.nan), np.array([0]), 10)


def matching_by_permutation(x, y):
    left, right = [*x, *[None] * len(y)], [*y, *[None] * len(x)]

    def cost(a, b):
        if a is None and b is None:
            return 0.0
        if a is None or b is None:
            p = b if a is None else a
            return ((p[1] - p[0]) / 2) ** 2
        return max(abs(a[0] - b[0]), abs(a[1] - b[1])) ** 2

    totals = (
        sum(cost(left[i], right[j]) for i, j in enumerate(p))
        for p in itertools.permutations(range(len(right)))
    )
    return math.sqrt(min(totals, default=0.0))


@pytest.mark.parametrize("seed", range(60))
def test_distance_equals_permutations(seed):
    rng = np.random.default_rng(seed)

    def diagram(n):
        births = rng.random(n) * rng.choice([0.0, 0.3, 1.0])
        out = np.stack([births, births + rng.random(n) * 2], axis=1)
        return np.round(out, 1) if seed % 4 == 0 else out

    x, y = diagram(rng.integers(0, 5)), diagram(rng.integers(0, 4))
    assert wasserstein2(x, y) == pytest.approx(matching_by_permutation(x, y), abs=1e-9)


bar = st.tuples(st.floats(0, 3), st.floats(0, 3)).map(lambda p: (p[0], p[0] + p[1]))
diagrams = st.lists(bar, max_size=12).map(lambda b: np.array(b, dtype=float).reshape(-1, 2))


@settings(max_examples=60, deadline=None)
@given(diagrams, diagrams)
def test_distance_is_symmetric_and_zero_on_itself(x, y):
    assert wasserstein2(x, y) == pytest.approx(wasserstein2(y, x), abs=1e-7)
    assert wasserstein2(x, x) == pytest.approx(0.0, abs=1e-6)
    half = np.sqrt((((x[:, 1] - x[:, 0]) / 2) ** 2).sum())
    assert wasserstein2(x, np.empty((0, 2))) == pytest.approx(half)


def test_large_diagrams_match_ordered_alignment():
    rng = np.random.default_rng(5)
    x = np.stack([np.zeros(40), rng.random(40) * 2], axis=1)
    y = np.stack([np.zeros(300), rng.random(300)], axis=1)
    # Births are all 0: the matched parts of an optimal matching are ordered, so a
    # sorted alignment by dynamic programming is exact.
    a, b = np.sort(x[:, 1]), np.sort(y[:, 1])
    best = np.zeros((len(a) + 1, len(b) + 1))
    best[1:, 0] = np.cumsum((a / 2) ** 2)
    best[0, 1:] = np.cumsum((b / 2) ** 2)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i, j] = min(
                best[i - 1, j] + (a[i - 1] / 2) ** 2,
                best[i, j - 1] + (b[j - 1] / 2) ** 2,
                best[i - 1, j - 1] + (a[i - 1] - b[j - 1]) ** 2,
            )
    assert wasserstein2(x, y) == pytest.approx(math.sqrt(best[-1, -1]), abs=1e-9)


def test_tree_covers_space():
    rng = np.random.default_rng(0)
    sample = np.concatenate([rng.normal(size=(200, 3)), np.ones((100, 3))])
    nodes = build_tree(sample, 16)
    cells = find_cells(nodes, sample)
    leaves = sorted(left for axis, _, left, _ in nodes if axis < 0)
    assert leaves == list(range(len(leaves))) and set(cells) <= set(leaves)
    assert len(set(cells[200:])) == 1
    inside = box_distance(sample, sample.min(axis=0)[None], sample.max(axis=0)[None])
    assert (inside == 0).all()


@pytest.mark.parametrize("k", [(1,), (2, 5), (32, 96)])
def test_few_candidates_give_the_distance_over_all(k, monkeypatch):
    """Crowded rows need more than their first candidates: the proof must notice."""
    monkeypatch.setattr(matching, "CANDIDATES", k)
    rng = np.random.default_rng(7)
    births = np.where(rng.random(120) < 0.5, 0.0, rng.random(120))
    target = np.stack([births, births + rng.random(120)], axis=1)
    many = []
    for n in (0, 1, 3, 12, 40, 130):
        start = np.where(rng.random(n) < 0.7, 0.0, rng.random(n))
        many.append(np.stack([start, start + np.round(0.9 + rng.random(n) / 5, 2)], axis=1))
    got = matching.wasserstein2_all(many, target)
    for x, found in zip(many, got):
        part, *problem = matching._savings(x, target)
        assert found == pytest.approx(math.sqrt(max(part + matching._assign_all([tuple(problem)])[0][0], 0.0)), abs=1e-9)
    assert not matching._with_few([many[4]], target, 1)[1][0]


def test_batches_begin_with_more_candidates_once_few_do_not_do(monkeypatch):
    monkeypatch.setattr(matching, "BATCH", 4)
    monkeypatch.setattr(matching, "CANDIDATES", (1, 50))
    tried, plain = [], matching._with_few
    monkeypatch.setattr(matching, "_with_few", lambda x, y, k: tried.append(k) or plain(x, y, k))
    crowded = [np.stack([np.zeros(8), np.full(8, 1.0 + i / 99)], axis=1) for i in range(12)]
    target = np.stack([np.zeros(60), np.linspace(0.1, 1.2, 60)], axis=1)
    got = matching.wasserstein2_all(crowded, target)
    assert tried == [1, 50, 50, 50]
    monkeypatch.setattr(matching, "CANDIDATES", ())
    assert np.allclose(got, matching.wasserstein2_all(crowded, target), atol=1e-9)
