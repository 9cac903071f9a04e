"""Facts whose values are JSON of any shape, as VARIANT, with a declared shape for each key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What JSON calls the kinds of values that a declared type takes, as schema_of_variant writes them.
KINDS = {
    T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.DoubleType: r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)", T.DecimalType: r"BIGINT|DECIMAL\(.*\)",
}


def shape(ddl: str) -> T.DataType:
    """A declared shape: a scalar, array<scalar>, or struct of those; fields of a struct marked NOT NULL have to be there."""
    parsed = T.DataType.fromDDL(ddl)
    for inner in parsed.fields if isinstance(parsed, T.StructType) else [parsed]:
        kind = getattr(inner, "dataType", inner)
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if type(kind) not in KINDS:
            raise ValueError(f"no shape of a fact: {ddl}")
    return parsed


def with_variant(facts: DataFrame, text: str = "fact_value") -> DataFrame:
    """facts with v, the value as VARIANT; null for a null text and for what is no JSON."""
    return facts.withColumn("v", F.try_parse_json(F.col(text)))


def _is(v: Column, kind: T.DataType) -> Column:
    """Whether a variant is a value of a scalar type, or an array of such (empty ones, too), and none of it has to be cast."""
    if isinstance(kind, T.ArrayType):
        elements = F.try_variant_get(v, "$", "array<variant>")
        return elements.isNotNull() & F.forall(elements, lambda e: _is(e, kind.elementType))
    named = F.schema_of_variant(v).rlike(f"^({KINDS[type(kind)]})$")
    return named & F.try_variant_get(v, "$", kind.simpleString()).isNotNull()


def fits(v: Column, ddl: str) -> Column:
    """Whether a variant has a declared shape. Fields that aren't declared don't matter; a declared one may be missing or
    null, unless it is NOT NULL. A JSON null is a value of no shape."""
    kind = shape(ddl)
    if not isinstance(kind, T.StructType):
        return F.coalesce(_is(v, kind), F.lit(False))
    ok = F.schema_of_variant(v).startswith("OBJECT<")
    for f in kind.fields:
        if not re.fullmatch(r"\w+", f.name):
            raise ValueError(f"no name of a field: {f.name}")
        field = F.try_variant_get(v, f"$.{f.name}", "variant")
        absent = field.isNull() | F.is_variant_null(field)
        ok = ok & (F.when(absent, F.lit(f.nullable)).otherwise(_is(field, f.dataType)))
    return F.coalesce(ok, F.lit(False))


def typed(v: Column, ddl: str) -> Column:
    """A variant as its declared shape; null if it has another."""
    return F.when(fits(v, ddl), F.try_variant_get(v, "$", shape(ddl).simpleString()))


def fact_values(facts: DataFrame, key: str, ddl: str) -> DataFrame:
    """The facts of a key whose value has the declared shape, with value of that type."""
    return with_variant(facts.filter(F.col("fact_key") == key)).withColumn("value", typed(F.col("v"), ddl)).filter("value is not null").drop("v")


def shape_problems(facts: DataFrame, declared: dict[str, str]) -> DataFrame:
    """facts with problem and found (what shape it has) for each one that can't be read by its key: no value, no JSON, a key
    that isn't declared, or another shape."""
    known = with_variant(facts)
    ok = F.lit(False)
    for key, ddl in declared.items():
        ok = F.when(F.col("fact_key") == key, fits(F.col("v"), ddl)).otherwise(ok)
    problem = (
        F.when(F.col("fact_value").isNull(), "no value").when(F.col("v").isNull(), "no JSON")
        .when(~F.coalesce(F.col("fact_key").isin(*declared), F.lit(False)), "unknown key").when(~ok, "wrong shape")
    )
    return known.withColumn("problem", problem).withColumn("found", F.schema_of_variant("v")).drop("v").filter("problem is not null")
