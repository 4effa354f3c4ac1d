import itertools
import random

from addrloom.operators import communities


def _quality(edges, of):
    total = 2 * sum(w for _, _, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    inner = sum(2 * w for a, b, w in edges if of[a] == of[b])
    sums = {}
    for n, k in degree.items():
        sums[of[n]] = sums.get(of[n], 0) + k
    return inner / total - sum(s * s for s in sums.values()) / total**2


def _partitions(n):
    """Restricted growth strings: all partitions of n nodes."""
    def grow(done):
        if len(done) == n:
            yield done
        else:
            for c in range(max(done, default=-1) + 2):
                yield from grow([*done, c])
    yield from grow([])


def _sequential(edges):
    """One node after the other to its best neighbour's community, on graphs that shrink."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    of, links = {n: n for n in nodes}, list(edges)
    while True:
        names = sorted({x for a, b, _ in links for x in (a, b)} | set(of.values()))
        at, moved = {n: n for n in names}, False
        full = lambda: {n: at[of[n]] for n in nodes}  # noqa: E731, B023
        again = True
        while again:
            again = False
            for n in names:
                here, best = _quality(edges, full()), at[n]
                for c in sorted({at[b if a == n else a] for a, b, _ in links if n in (a, b)}):
                    was, at[n] = at[n], c
                    if (q := _quality(edges, full())) > here + 1e-12:
                        here, best, again, moved = q, c, True, True
                    at[n] = was
                at[n] = best
        of, links = full(), [(at[a], at[b], w) for a, b, w in links]
        if not moved:
            return _quality(edges, of)


def _found(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string, w long")
    got = communities.louvain(df)
    of = {r.node: r.community for r in got.collect()}
    assert all(of[of[n]] == of[n] and of[n] <= n for n in of)
    plain = [e for e in edges if e[0] != e[1]]
    assert abs(communities.modularity(df, got).first().modularity - _quality(plain, of)) < 1e-12
    return of


def test_two_cliques_and_a_bridge(spark):
    edges = [(a, b, 5) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "w", 1)]
    of = _found(spark, edges + [("a", "a", 9), ("b", "a", 5)])
    assert {n: c for n, c in of.items()} == {n: "a" if n in "abcd" else "w" for n in "abcdwxyz"}
    assert _found(spark, list(reversed(edges))) == of


def test_no_less_than_brute_force(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        names = "abcdefgh"[: 7 + seed % 2]
        edges = [(a, b, r.randint(1, 9)) for a, b in itertools.combinations(names, 2) if r.random() < 0.45]
        used = sorted({x for a, b, _ in edges for x in (a, b)})
        best = max(_quality(edges, dict(zip(used, p))) for p in _partitions(len(used)))
        got = _quality(edges, _found(spark, edges))
        assert got >= _sequential(edges) - 1e-12 and got >= 0.97 * best


def test_many_moves_at_once(spark, monkeypatch):
    monkeypatch.setattr(communities, "FEW", 3)
    hub = [("h", f"n{i:02}", 2) for i in range(40)]
    ring = [(f"r{g}{i}", f"r{g}{(i + 1) % 5}", 4) for g in range(6) for i in range(5)] + [(f"r{g}0", f"r{(g + 1) % 6}0", 1) for g in range(6)]
    of = _found(spark, hub + ring)
    assert {of[n] for _, n, _ in hub} == {"h"} and len({of[f"r{g}0"] for g in range(6)}) >= 2


def test_no_edges(spark):
    assert communities.louvain(spark.createDataFrame([], "a string, b string, w long")).collect() == []
