"""Structural comparison of nested values, field by field."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType

#: One difference: the path with places in lists, and both values as text.
DIFFERENCE = "array<struct<path:string,stored:string,computed:string>>"


def _said(value: Column, kind: DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (StructType, ArrayType, MapType)) else value.cast("string")


def differences(stored: Column, computed: Column, stored_type: DataType, computed_type: DataType, ignored: Collection[str] = (), slack: float = 0.0) -> Column:
    """All differences of two nested values, in the order of their fields.

    Structs are compared by field names, of either side; lists by place, and their lengths as ``size``; maps by key. Numbers may differ by ``slack``. ``ignored`` names paths without places in lists, such as
    ``quality.evaluatedAt``, whose whole values don't count. A null struct, list or map differs from one that is there, even an empty one.
    """
    nothing = F.array().cast(DIFFERENCE)

    def one(path: Column, a: Column, b: Column, ta: DataType, tb: DataType) -> Column:
        return F.array(F.struct(path.alias("path"), _said(a, ta).alias("stored"), _said(b, tb).alias("computed"))).cast(DIFFERENCE)

    def both(a: Column, b: Column, ta: DataType, tb: DataType, path: Column, inner: Column) -> Column:
        """``inner`` if both are there, nothing if none is, else one difference."""
        return F.when(a.isNull() & b.isNull(), nothing).when(a.isNull() | b.isNull(), one(path, a, b, ta, tb)).otherwise(inner)

    def below(path: Column, step: Column | str) -> Column:
        step = F.lit(step) if isinstance(step, str) else step
        return F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), step)

    def walk(a: Column, b: Column, ta: DataType, tb: DataType, path: Column, name: str) -> Column:
        if name in ignored:
            return nothing
        if isinstance(ta, StructType) and isinstance(tb, StructType):
            parts = []
            for field in dict.fromkeys([*ta.names, *tb.names]):
                # a field that one side lacks counts as null there
                ka, kb = (t[field].dataType if field in t.names else None for t in (ta, tb))
                va, vb = (v.getField(field) if k is not None else F.lit(None).cast(other) for v, k, other in ((a, ka, kb), (b, kb, ka)))
                parts.append(walk(va, vb, ka or kb, kb or ka, below(path, field), f"{name}.{field}".lstrip(".")))
            return both(a, b, ta, tb, path, F.concat(*parts) if parts else nothing)
        if isinstance(ta, ArrayType) and isinstance(tb, ArrayType):
            sizes = F.when(F.size(a) == F.size(b), nothing).otherwise(F.array(F.struct(below(path, "size"), F.size(a).cast("string"), F.size(b).cast("string"))).cast(DIFFERENCE))
            shared = F.least(F.size(a), F.size(b))
            places = F.when(shared > 0, F.sequence(F.lit(0), shared - 1)).otherwise(F.array().cast("array<int>"))
            items = F.flatten(F.transform(places, lambda i: walk(F.get(a, i), F.get(b, i), ta.elementType, tb.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), name)))
            return both(a, b, ta, tb, path, F.concat(sizes, items))
        if isinstance(ta, MapType) and isinstance(tb, MapType) and ta.keyType == tb.keyType:
            keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))

            def entry(k: Column) -> Column:
                at = below(path, k.cast("string"))
                va, vb = F.try_element_at(a, k), F.try_element_at(b, k)
                alone = F.map_contains_key(a, k) != F.map_contains_key(b, k)
                return F.when(alone, one(at, va, vb, ta.valueType, tb.valueType)).otherwise(walk(va, vb, ta.valueType, tb.valueType, at, name))

            return both(a, b, ta, tb, path, F.flatten(F.transform(keys, entry)))
        if isinstance(ta, NumericType) and isinstance(tb, NumericType):
            close = F.coalesce(F.abs(a - b) <= slack, F.lit(False)) if slack else F.lit(False)
            same = a.eqNullSafe(b) | close
        elif ta == tb and not isinstance(ta, MapType):
            same = a.eqNullSafe(b)
        else:
            same = _said(a, ta).eqNullSafe(_said(b, tb))
        return F.when(same, nothing).otherwise(one(path, a, b, ta, tb))

    return walk(stored, computed, stored_type, computed_type, F.lit(""), "")


def nested_drift(stored: DataFrame, computed: DataFrame, keys: list[str], ignored: Collection[str] = (), slack: float = 0.0) -> DataFrame:
    """Keys (unique on each side, null-safe) whose other columns differ, with drift (only_stored, only_computed or changed) and the differences; for keys of one side these are empty."""
    values = lambda df: [c for c in df.columns if c not in keys]
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)], F.struct(*values(df)).alias(name))
    a, b = side(stored, "stored"), side(computed, "computed")
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"stored_{i}").eqNullSafe(F.col(f"computed_{i}"))
    rows = a.join(b, same, "full_outer")
    found = differences(F.col("stored"), F.col("computed"), a.schema["stored"].dataType, b.schema["computed"].dataType, ignored, slack)
    kind = F.when(F.col("computed").isNull(), F.lit("only_stored")).when(F.col("stored").isNull(), F.lit("only_computed")).otherwise(F.lit("changed"))
    out = rows.select(*[F.coalesce(f"stored_{i}", f"computed_{i}").alias(k) for i, k in enumerate(keys)], kind.alias("drift"), F.when(kind == "changed", found).otherwise(F.array().cast(DIFFERENCE)).alias("differences"))
    return out.where((F.col("drift") != "changed") | (F.size("differences") > 0))
