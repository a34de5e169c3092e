"""Results of any shape as VARIANT values: numbers that JSON lacks are tagged, so that they come back as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructField

#: The key of a tagged value, and the numbers that are tagged: JSON has no NaN and no infinities, and its readers drop the sign of zero.
TAG = "_"
NAN, PLUS, MINUS, ZERO = "nan", "inf", "-inf", "-0"


def _number(c: Column) -> Column:
    tagged = lambda name: F.lit(f'{{"{TAG}":"{name}"}}')
    inf = F.lit(float("inf"))
    sign = F.when((c == 0.0) & (F.pow(c, F.lit(-1.0)) < 0), tagged(ZERO))
    return F.when(c.isNull(), "null").when(F.isnan(c), tagged(NAN)).when(c == inf, tagged(PLUS)).when(c == -inf, tagged(MINUS)).otherwise(F.coalesce(sign, c.cast("string")))


def _text(c: Column, kind: DataType) -> Column:
    """A value as JSON text. Text and what Spark's own writer takes goes through it."""
    if isinstance(kind, (DoubleType, FloatType)):
        return _number(c.cast("double"))
    if isinstance(kind, ArrayType):
        return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _text(x, kind.elementType)), ","), F.lit("]")))
    inside = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(inside, F.lit(6), F.length(inside) - 6)  # what stands between {"x": and }


def _key(name: str) -> str:
    return name.replace("\\", "\\\\").replace('"', '\\"')


def packed(df: DataFrame, *keep: str, name: str = "result") -> DataFrame:
    """df's kept columns, and all others as one VARIANT. Doubles, arrays of them and whatever to_json takes come back by unpacked()."""
    rest = [f for f in df.schema.fields if f.name not in keep]
    parts = [F.concat(F.lit(f'"{_key(f.name)}":'), _text(F.col(f"`{f.name}`"), f.dataType)) for f in rest]
    text = F.concat(F.lit("{"), *[x for k, p in enumerate(parts) for x in ([F.lit(",")] if k else []) + [p]], F.lit("}"))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.parse_json(text).alias(name))


def _value(v: Column, path: str, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        tag = F.try_variant_get(v, f"{path}.{TAG}", "string")
        told = {NAN: float("nan"), PLUS: float("inf"), MINUS: -float("inf"), ZERO: -0.0}
        plain = F.try_variant_get(v, path, "double")
        for k, x in told.items():
            plain = F.when(tag == k, F.lit(x)).otherwise(plain)
        return plain.cast(kind)
    if isinstance(kind, ArrayType):
        return F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: _value(x, "$", kind.elementType))
    return F.try_variant_get(v, path, kind.simpleString())


def unpacked(df: DataFrame, fields: list[StructField], name: str = "result") -> DataFrame:
    """df with the named fields of its VARIANT as columns again; a field that a value lacks, or holds as another kind, is null."""
    out = [_value(F.col(name), f"$['{f.name}']", f.dataType).alias(f.name) for f in fields]
    return df.select(*[c for c in df.columns if c != name], *out)
