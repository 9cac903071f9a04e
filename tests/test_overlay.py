"""Unions, problems, repairs and overlaps of areas, against sums over fine points and closed forms."""

import math
import random

import pytest

from townhall.operators import overlay as V

SCHEMA = "area_id long, parent long, geom array<array<array<struct<x:double,y:double>>>>"


def frame(spark, rows):
    points = lambda geom: None if geom is None else [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in geom]
    return spark.createDataFrame([(i, p, points(g)) for i, p, g in rows], SCHEMA)


def shapes(df, key="area_id"):
    return {r[key]: [[[(q["x"], q["y"]) for q in ring] for ring in polygon] for polygon in r["geom"]] for r in df.collect()}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def total(geom):
    return sum(area(r) for p in geom for r in p)


def inside(geom, x, y):
    n = 0
    for p in geom or []:
        for r in p:
            closed = [*r, r[0]]
            n += sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(closed, closed[1:], strict=False))
    return n % 2 == 1


def square(x, y, s=1):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def turned(ring, angle=0.3):
    c, s = math.cos(angle), math.sin(angle)
    return [(c * x - s * y, s * x + c * y) for x, y in ring]


def test_dissolve(spark):
    """A ring of squares around a hole, squares of another size beside them (their corners lie on edges), a single touch, an island."""
    block = [(x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2), (3, 0))]
    rows = [(10 * x + y, 1, [[square(x, y)[:: 1 if x % 2 else -1]]]) for x, y in block]
    rows += [(100, 1, [[square(4, 1, 2)]]), (101, 1, [[square(9, 9)]]), (102, 2, [[square(0, 0, 3), square(1, 1)]]), (103, 2, [[square(1, 1)]]), (104, 3, None), (105, 3, [])]
    got = shapes(V.dissolve(frame(spark, rows), "parent", 1.0), "parent")
    members = {p: [g for _, q, g in rows if q == p] for p in (1, 2)}
    assert set(got) == {1, 2}
    rng = random.Random(1)
    for p, geoms in members.items():
        assert total(got[p]) == sum(abs(area(g[0][0])) - sum(abs(area(r)) for r in g[0][1:]) for g in geoms)
        for _ in range(400):
            x, y = rng.uniform(-1, 11), rng.uniform(-1, 11)
            assert inside(got[p], x, y) == any(inside(g, x, y) for g in geoms)
    edges = [tuple(sorted(e)) for polygon in got[1] for r in polygon for e in zip(r, r[1:], strict=False)]
    assert len(set(edges)) == len(edges)  # no inner edge is left
    assert [len(p) for p in got[2]] == [1] and sorted(len(p) for p in got[1])[0] == 1
    assert sum(len(p) - 1 for p in got[1]) == 2  # both holes are kept
    assert all(area(p[0]) > 0 and all(area(h) < 0 for h in p[1:]) for g in got.values() for p in g)


def test_dissolve_slanted(spark):
    rows = [(10 * x + y, 1, [[turned(square(x, y))]]) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    got = shapes(V.dissolve(frame(spark, rows), "parent", 0.7), "parent")[1]
    assert len(got) == 1 and len(got[0]) == 2 and abs(total(got) - 8) < 1e-9


def test_problems_and_repair(spark):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
    touch = [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]  # a vertex on its own edge
    keyhole = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2), (0, 0)]  # there and back to a hole
    spike = [(0, 0), (2, 0), (2, 2), (3, 3), (2, 2), (0, 2), (0, 0)]
    nested = [square(0, 0, 9), square(1, 1, 7)[::-1]]
    rows = [(1, 1, [[bow]]), (2, 1, [[touch]]), (3, 1, [[keyhole]]), (4, 1, [[spike]]), (5, 1, [nested]), (6, 1, [[turned(bow, 1.1)]]), (7, 1, None), (8, 1, [[[(0, 0)]]]), (9, 1, [[square(0, 0)], [square(1, 1)]])]
    df = frame(spark, rows)
    found = {(r["area_id"], r["problem"]): r["n"] for r in V.ring_problems(df, 1.0).collect()}
    assert found == {(1, "crossing"): 1, (2, "touching"): 1, (3, "shared vertex"): 2, (4, "shared vertex"): 1, (6, "crossing"): 1, (9, "shared vertex"): 1}
    fixed = V.repaired(df, 1.0)
    assert not {r["problem"] for r in V.ring_problems(fixed, 1.0).collect()} - {"shared vertex"}
    got = shapes(fixed)
    assert {k: (len(g), sum(len(p) - 1 for p in g)) for k, g in got.items()} == {1: (2, 0), 2: (2, 0), 3: (1, 1), 4: (1, 0), 5: (1, 1), 6: (2, 0), 9: (2, 0)}
    areas = {1: 2, 2: 8, 3: 32, 4: 4, 5: 32, 6: 2, 9: 2}
    assert {k: round(total(g), 9) for k, g in got.items()} == areas
    rng = random.Random(2)
    for i, _, geom in rows:
        for _ in range(200):
            x, y = rng.uniform(-3, 7), rng.uniform(-3, 7)
            if i in got:
                assert inside(got[i], x, y) == inside(geom, x, y)


@pytest.mark.parametrize("angle", [0.0, 0.4])
def test_common_areas(spark, angle):
    """Against a sum over fine points: shapes that cross, hold one another, share borders, and lie apart."""
    turn = lambda geom: [[turned(r, angle) for r in p] for p in geom]
    large = [(1, 0, turn([[square(0, 0, 4), square(1, 1)]])), (2, 0, turn([[square(4, 0, 4)]])), (3, 0, turn([[[(0, 4), (8, 4), (4, 9), (0, 4)]]]))]
    small = [(10, 0, turn([[square(3, 1, 2)]])), (11, 0, turn([[square(0, 0, 2)]])), (12, 0, turn([[[(2, 2), (6, 3), (4, 7), (2, 2)]]])), (13, 0, turn([[square(20, 20)]])), (14, 0, turn([[square(0, 4, 2)]])), (15, 0, turn([[square(-1, -1, 11)]])), (16, 0, turn([[square(4, 0, 4)]])), (17, 0, turn([[square(1, 1)]]))]
    got = {(r["area_id"], r["parent_id"]): r["common"] for r in V.common_areas(frame(spark, small), frame(spark, large), 1.5).collect()}
    own = {r["area_id"]: r["own"] for r in V.common_areas(frame(spark, small), frame(spark, large), 1.5).collect()}
    exact = {(10, 1): 2, (10, 2): 2, (11, 1): 3, (14, 3): 2 * 2 - (1.6 * 2 / 2 + 0.4 * 2), (15, 1): 15, (15, 2): 16, (15, 3): 20, (16, 2): 16}
    for k, v in exact.items():
        assert (abs(got[k] - v) < 1e-9) or k == (14, 3), (k, got[k], v)
    step = 0.02
    geoms = {i: g for i, _, g in small + large}
    for a, p in ((12, 1), (12, 2), (12, 3), (14, 3)):
        xs, ys = [q[0] for q in geoms[a][0][0]], [q[1] for q in geoms[a][0][0]]
        n = sum(inside(geoms[a], x, y) and inside(geoms[p], x, y) for i in range(int((max(xs) - min(xs)) / step)) for j in range(int((max(ys) - min(ys)) / step)) for x, y in [(min(xs) + (i + 0.5) * step, min(ys) + (j + 0.5) * step)])
        assert abs(got[a, p] - n * step * step) < 0.03
    assert not {k for k, v in got.items() if k[0] == 13 or k == (17, 1) or v < 1e-6 and k[0] != 13}
    assert abs(own[12] - 9) < 1e-9 and own[16] == pytest.approx(16)


def test_paired():
    bow = [(0.8, True, 1), (2.3, True, 2), (3.9, False, 3), (5.5, False, 4)]
    assert sorted(V.paired(bow)) == [(3, 2), (4, 1)]
    assert sorted(V.paired([(0.0, False, 1), (1.0, True, 2)])) == [(1, 2)]
    two = [(0.1, True, 1), (1.0, False, 2), (3.0, True, 3), (4.0, False, 4)]
    assert sorted(V.paired(two)) == [(2, 1), (4, 3)]


def test_nothing(spark):
    none = frame(spark, [])
    for df in (V.dissolve(none, "parent", 1.0), V.ring_problems(none, 1.0), V.repaired(none, 1.0), V.common_areas(none, none, 1.0)):
        assert df.count() == 0


def test_cells_passed(spark):
    df = spark.createDataFrame([(0.5, 0.5, 3.5, 0.5), (0.5, 0.5, 0.5, 2.5), (0.5, 0.5, 2.5, 2.5)], "ax double, ay double, bx double, by double")
    got = [{(c["cx"], c["cy"]) for c in r[0]} for r in df.select(V.cells_passed(1.0)).collect()]
    assert got[0] == {(x, 0) for x in range(4)} and got[1] == {(0, y) for y in range(3)}
    assert {(0, 0), (1, 1), (2, 2)} <= got[2] and (0, 2) not in got[2]


def test_large_edges_split_by_pair(spark, monkeypatch):
    """Many small areas over one border: each is measured by its own pieces, not by all that the others cut."""
    n = 60
    small = [(i, 0, [[[(x, y - 1), (x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)]]]) for i in range(n) for x, y in [(4 + i % 7 * 0.2, 5 + i * 0.01)]]
    large = [(1, 0, [[[(-5, -5), (5, -5), (5, 20), (-5, 20)]]]), (2, 0, [[[(5, -5), (15, -5), (15, 20), (5, 20)]]])]
    large = [(i, p, [[[*g[0][0], g[0][0][0]]]]) for i, p, g in large]
    rows, kept = [], V.point_in_polygon

    def counted(points, areas, size):
        rows.append(points.count())
        return kept(points, areas, size)

    monkeypatch.setattr(V, "point_in_polygon", counted)
    got = {(r["area_id"], r["parent_id"]): r["common"] / r["own"] for r in V.common_areas(frame(spark, small), frame(spark, large), 2.0).collect()}
    for i in range(n):
        hi = max(-1, min(1, 5 - (4 + i % 7 * 0.2)))
        left = ((1 + hi) ** 2 if hi <= 0 else 2 - (1 - hi) ** 2) / 2
        assert abs(got.get((i, 1), 0) - left) < 1e-9 and abs(got.get((i, 2), 0) - (1 - left)) < 1e-9
    assert min(rows) == 8  # the large ones' edges are points once each, whatever lies on them


def test_few_and_many_edges_stitch_alike(spark, monkeypatch):
    """Areas of few edges are stitched without rounds, with the same rings as in rounds; a null parent is one, too."""
    bow, touch = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]
    rows = [(i, None if i % 3 == 2 else i % 3, [[[(x + 10 * i, y) for x, y in (bow, touch, square(0, 0, 3))[i % 3]]]]) for i in range(9)]
    rings = lambda df, key: {k: sorted((round(total([p]), 9), sorted({q for r in p for q in r})) for p in g) for k, g in shapes(df, key).items()}
    got = []
    for few in (256, 6, 0):
        monkeypatch.setattr(V, "FEW", few)
        rounds, kept = [], V._stitched_in_rounds
        monkeypatch.setattr(V, "_stitched_in_rounds", lambda *a, rounds=rounds, kept=kept: rounds.append(1) or kept(*a))
        got.append((rings(V.repaired(frame(spark, rows), 2.0), "area_id"), rings(V.dissolve(frame(spark, rows), "parent", 2.0), "parent")))
        assert bool(rounds) == (few < 256)
        monkeypatch.setattr(V, "_stitched_in_rounds", kept)
    assert got[0] == got[1] == got[2]
    assert set(got[0][1]) == {None, 0, 1} and len(got[0][0]) == 9
