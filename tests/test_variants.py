"""Facts of mixed shapes: what fits its key's declared shape is read, all else is a problem."""

import json

import pytest
from pyspark.sql import functions as F

from townhall.operators import variants as V

DECLARED = {"share": "struct<count:bigint not null,total:bigint,note:string>", "votes": "bigint", "rate": "double", "party": "string", "seats": "array<bigint>", "held": "boolean"}
GOOD = {"share": [{"count": 1, "total": 2}, {"count": 1, "total": None, "more": [1]}, {"count": 3, "note": "x"}], "votes": [0, -5, 2**62], "rate": [1, 0.5, -1e300], "party": ["", "12", "é"], "seats": [[], [1, 2]], "held": [True, False]}
BAD = {"share": [{}, {"count": "1"}, {"count": 1, "total": "2"}, [1], 3, {"count": 1.5}], "votes": ["5", 1.5, {}, None, 10**30], "rate": ["0.5", True, [1]], "party": [1, ["a"], None], "seats": [[1, "2"], 1, [None], {"0": 1}], "held": ["true", 0]}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(k, json.dumps(v)) for group in (GOOD, BAD) for k, vs in group.items() for v in vs]
    rows += [("votes", None), ("votes", "{"), ("votes", ""), ("other", "1"), (None, "1"), (None, None)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "subject_id long, fact_key string, fact_value string")


@pytest.mark.parametrize("key", sorted(DECLARED))
def test_values(spark, facts, key):
    rows = V.fact_values(facts, key, DECLARED[key]).orderBy("subject_id").collect()
    got = [r["value"].asDict() if hasattr(r["value"], "asDict") else r["value"] for r in rows]
    blank = {"count": None, "total": None, "note": None}
    assert got == [blank | {k: x for k, x in v.items() if k in blank} if isinstance(v, dict) else v for v in GOOD[key]]


def test_problems(spark, facts):
    found = {(r["fact_key"], r["fact_value"]): r["problem"] for r in V.shape_problems(facts, DECLARED).collect()}
    expected = {(k, json.dumps(v)): "wrong shape" for k, vs in BAD.items() for v in vs}
    expected |= {("votes", None): "no value", ("votes", "{"): "no JSON", ("votes", ""): "no JSON", ("other", "1"): "unknown key", (None, "1"): "unknown key", (None, None): "no value"}
    assert found == expected
    assert V.shape_problems(facts.filter("false"), DECLARED).count() == 0
    assert V.shape_problems(facts.filter(F.col("subject_id") < sum(map(len, GOOD.values()))), DECLARED).count() == 0


def test_shapes():
    for ddl in ("map<string,int>", "array<array<int>>", "struct<a:struct<b:int>>", "date"):
        with pytest.raises(ValueError, match="no shape"):
            V.shape(ddl)
