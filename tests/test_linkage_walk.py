"""The sequential linkage against a walk over the seats, and names that meet by three runs together."""

import difflib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from townhall.operators import linkage as L

SEATS = "code int, name string, base string, number int, districts array<string>, also string"
RECORDS = "record_id int, name string, base string, ordinals array<int>, districts array<string>"


def walk(seats, records, close=0.75, most=3):
    by_name, by_base, by_number = {}, {}, {}
    for rid, name, base, ordinals, districts in sorted(records, key=lambda r: r[0]):
        if name is not None:
            by_name[name] = (rid, districts)
        if base is not None:
            by_base.setdefault(base, []).append((rid, districts))
        by_number |= {o: (rid, districts) for o in ordinals}
    names, used, out = [*by_name, *by_base], set(), []
    for code, name, base, number, districts, also in sorted(seats, key=lambda s: s[0]):
        free = lambda found: [x for x in found if x[0] not in used and fits(x)]
        fits = lambda x: not x[1] or not districts or bool(set(x[1]) & set(districts))
        rec, layer = by_name.get(name) or by_name.get(also), "name"
        if rec is None and len(found := free(by_base.get(base, []))) == 1:
            rec, layer = found[0], "base name"
        if rec is None and number in by_number and fits(by_number[number]):
            rec, layer = by_number[number], "number"
        if rec is None and base is not None:
            for key in difflib.get_close_matches(base, names, n=most, cutoff=close):
                if len(found := free([by_name[key]] if key in by_name else by_base[key])) == 1:
                    rec, layer = found[0], "close name"
                    break
        if rec is None or rec[0] in used:
            out.append((code, None, None, "no record" if rec is None else "record taken"))
            continue
        used.add(rec[0])
        out.append((code, rec[0], layer, None))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_walk(spark, seed):
    """Few names for many seats, so that most of them collide."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abc", k=rng.randrange(4, 8))) for _ in range(25)]

    def pick():
        w = list(rng.choice(pool))
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice("abcx")
        return "".join(w)

    districts = lambda: rng.sample(["d1", "d2", "d3"], rng.randrange(3))
    seats = [(i, pick() + " s" * rng.randrange(2), pick(), rng.randrange(60), districts(), pick() if rng.random() < 0.3 else None) for i in range(70)]
    records = [(100 + i, None if rng.random() < 0.1 else pick() + " s" * rng.randrange(2), None if rng.random() < 0.05 else pick(), [rng.randrange(60) for _ in range(rng.randrange(3))], districts()) for i in range(60)]
    seats += [(900, None, None, None, None, None), (901, "", "", -1, [], "")]
    got = sorted(map(tuple, L.linkage_layers(spark.createDataFrame(seats, SEATS), spark.createDataFrame(records, RECORDS)).collect()))
    expected = walk(seats, records)
    assert got == expected
    assert {x[2] for x in expected} | {x[3] for x in expected} >= {"name", "base name", "number", "close name", "no record", "record taken"}


def test_walk_over_nothing(spark):
    seats, records = spark.createDataFrame([(1, "a", "a", 1, [], None)], SEATS), spark.createDataFrame([], RECORDS)
    assert [tuple(r) for r in L.linkage_layers(seats, records).collect()] == [(1, None, None, "no record")]
    assert L.linkage_layers(seats.filter("false"), records).count() == 0


@pytest.mark.parametrize("least", [0.6, 0.88])
def test_close_pairs_of_many_names(spark, monkeypatch, least):
    monkeypatch.setattr(L, "MANY_NAMES", 0)
    rng = random.Random(5)
    names = ["".join(rng.choices("abcd ", k=rng.randrange(1, 20))) for _ in range(80)]
    near = ["".join(c for c in n if rng.random() > 0.1) for n in names] + [None, ""]
    left, right = list(enumerate([*names, None, ""])), list(enumerate(near))
    got = {(r["l_id"], r["r_id"]) for r in L.close_pairs(spark.createDataFrame(left, "l_id long, l_name string"), spark.createDataFrame(right, "r_id long, r_name string"), least).collect()}
    assert got == {(i, j) for i, x in left for j, y in right if x is not None and y is not None and difflib.SequenceMatcher(None, x, y).ratio() >= least}


def test_run_plan():
    for least in (0.6, 0.75, 0.85, 0.88):
        for _, n, q, k, first in L.run_plan(list(range(21)), list(range(21)), least):
            assert 1 <= k <= first <= n - q + 1
    assert L.run_plan([17], [16], 0.85) == [(True, 17, 3, 2, 10), (False, 16, 3, 2, 9)]
    assert L.run_plan([17], [3], 0.85) == [] == L.run_plan([0], [0], 0.85)


def test_few_names_meet_by_chance():
    rng = random.Random(5)
    names = ["".join(rng.choice("aeioubdfgklmnprs") for _ in range(17)) for _ in range(2000)]
    near = [n[:3] + n[4:9] + "xx" + n[10:] for n in names]
    plan = L.part_plan(17, 17, 0.75)
    sides = []
    for side in (names, near):
        batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(side)], names=["id", "name"])
        keys = {}
        for b in L.part_keys({17: plan})(iter([batch])):
            for key, who, _, skipped in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys.setdefault(key, []).append((who, skipped))
        assert sum(map(len, keys.values())) <= 2000 * L.MOST_KEYS
        sides.append(keys)
    met = {(a, b) for key, left in sides[0].items() for a, da in left for b, db in sides[1].get(key, ()) if da + db <= 4}
    assert {(i, i) for i in range(2000)} <= met
    assert len(met) < 4000  # of 4,000,000 pairs


def test_ratio_bounds(spark):
    rng = random.Random(7)
    some = ["", "a", "ab", "abab"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string")
    rows = pairs.select("a", "b", *L._ratio_bounds(F.col("a"), F.col("b"))).collect()
    for r in rows:
        ratio = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["known"] in (None, ratio) and ratio <= r["most"] + 1e-12
    assert sum(r["known"] is not None for r in rows) > len(some)
