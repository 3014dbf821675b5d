"""Density topics against Kruskal's forest and a tree that is split from the top."""

import numpy as np
import pytest

from papyrion.operators import density


def brute_links(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = [sorted(range(len(x)), key=lambda j: (d[i, j], ids[j]))[:k] for i in range(len(x))]
    core = [max(d[i, j] for j in near[i]) for i in range(len(x))]
    pairs = {(min(ids[i], ids[j]), max(ids[i], ids[j])): max(d[i, j], core[i], core[j]) for i in range(len(x)) for j in near[i]}
    return sorted((w, a, b) for (a, b), w in pairs.items())


def kruskal(links):
    root, out = {}, []

    def find(c):
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for w, a, b in links:
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((w, a, b))
    return out


def from_the_top(ids, forest, least):
    """{id: (cluster as a frozenset or None, density)}: the longest link is cut first; parts of fewer than
    ``least`` points fall out; of two larger ones each is a cluster of its own."""

    def component(start, links):
        near = {}
        for _, a, b in links:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen, stack = {start}, [start]
        while stack:
            for j in near.get(stack.pop(), []):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        return seen

    fell = {}

    def split(points, links, birth):
        """(own stability, best, chosen clusters) of a cluster."""
        whole, own = frozenset(points), 0.0
        links = sorted(links)
        while links:
            w, a, b = links.pop()
            density_ = 1 / max(w, density.TOUCH)
            left, right = component(a, links), component(b, links)
            if len(left) >= least and len(right) >= least:
                own += len(left | right) * (density_ - birth)
                found = [split(side, [x for x in links if x[1] in side], density_) for side in (left, right)]
                below = sum(f[0] for f in found)
                return (own, [whole]) if own >= below else (below, [c for f in found for c in f[1]])
            out = [side for side in (left, right) if len(side) < least]
            for side in out:
                own += len(side) * (density_ - birth)
                fell.update(dict.fromkeys(side, density_))
            if len(out) == 2:
                return own, [whole]
            side = left if len(left) >= least else right
            links = [x for x in links if x[1] in side]
        raise AssertionError

    trees, left = [], set(ids)
    while left:
        one = component(next(iter(left)), forest)
        left -= one
        if len(one) >= least:
            trees.append(one)
    kept = []
    for one in trees:
        own, chosen = split(one, [x for x in forest if x[1] in one], 0.0)
        if len(trees) == 1 and chosen == [frozenset(one)]:
            # The whole is never a topic: what is below it is.
            links, chosen = sorted(x for x in forest if x[1] in one), []
            points = set(one)
            while links:
                _, a, b = links.pop()
                sides = [component(a, links), component(b, links)]
                if all(len(s) >= least for s in sides):
                    w = 1 / max(_, density.TOUCH)
                    chosen = [c for s in sides for c in split(s, [x for x in links if x[1] in s], w)[1]]
                    break
                big = [s for s in sides if len(s) >= least]
                if not big:
                    break
                points = big[0]
                links = [x for x in links if x[1] in points]
        kept += chosen
    of = {i: c for c in kept for i in c}
    return {i: (of.get(i), fell.get(i)) for i in ids}


def made(seed, n=500):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 3)) * 6
    x = np.vstack([centres[i % 6] + rng.normal(size=3) * (0.3 + 0.2 * (i % 3)) if i % 10 else rng.uniform(-12, 12, 3) for i in range(n)])
    return np.arange(n) * 3 + 1, x


@pytest.mark.parametrize("seed, least, k, merged", [(1, 10, 5, 500_000), (2, 15, 3, 90), (3, 8, 8, 17)])
def test_forest_and_topics_of_500_points(spark, monkeypatch, seed, least, k, merged):
    monkeypatch.setattr(density, "MERGED", merged)
    ids, x = made(seed, 500 if merged > 50 else 150)
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, x array<double>").repartition(3)
    links = brute_links(ids.tolist(), x, k)
    forest = kruskal(links)
    got = density.spanning_forest(density.reachability(density.neighbours(points, k), k)).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for _, a, b in forest} and sum(r.w for r in got) == pytest.approx(sum(w for w, _, _ in forest))
    want = from_the_top(ids.tolist(), forest, least)
    rows = {r.id: r for r in density.density_topics(points, least, k).collect()}
    clusters = {}
    for i, r in rows.items():
        clusters.setdefault(r.topic, set()).add(i)
    assert clusters.pop(-1, set()) == {i for i, (c, _) in want.items() if c is None}
    assert {frozenset(c) for c in clusters.values()} == {c for c, _ in want.values() if c}
    assert [len(clusters[t]) for t in sorted(clusters)] == sorted(map(len, clusters.values()), reverse=True)
    for t, members in clusters.items():
        most = max(want[i][1] for i in members)
        assert all(rows[i].strength == pytest.approx(want[i][1] / most) for i in members), t


def test_query_is_that_of_all_points(spark):
    from papyrion.queries import QUERIES
    from papyrion.queries.graph import density_points

    d = "/root/testdata/sf0.01"
    points = sorted((r.id, r.x) for r in density_points(spark, d).collect())
    ids, x = [i for i, _ in points], np.array([v for _, v in points])
    want = from_the_top(ids, kruskal(brute_links(ids, x, 5)), 5)
    got, clusters = {r.id: r.topic for r in QUERIES["topic_density"](spark, d).collect()}, {}
    for i, t in got.items():
        clusters.setdefault(t, set()).add(i)
    assert clusters.pop(-1) == {i for i, (c, _) in want.items() if c is None} and len(got) == len(ids)
    assert {frozenset(c) for c in clusters.values()} == {c for c, _ in want.values() if c} and clusters


def test_cells_and_parts_find_near_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(density, "CELL", 60)
    monkeypatch.setattr(density, "PART", 25)
    ids, x = made(4, 400)
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, x array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(int(ids[i]), int(ids[j])) for i in range(400) for j in np.argsort(d[i])[:4]}
    for reach, share in ((3, 0.9), (6, 1.0)):
        got = {(r.a, r.b) for r in density.neighbours(points, 4, reach).collect()}
        assert len(got) == 1600 and len(got & want) >= share * len(want)


def test_few_equal_and_no_points(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, x array<double>")
    assert density.density_topics(df([])).count() == 0
    assert [tuple(r) for r in density.density_topics(df([(1, [0.0, 1.0])])).collect()] == [(1, -1, 0.0)]
    rows = [(i, [float(i // 10) * 5, 0.0]) for i in range(20)]
    got = {r.id: r.topic for r in density.density_topics(df(rows), 5, 3).collect()}
    assert got == {i: i // 10 for i in range(20)}
