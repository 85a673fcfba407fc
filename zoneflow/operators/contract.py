"""The schema contract of a batch: spelling, presence and drift of its columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.config import REQUIRED_COLUMNS, TRIP_TYPES


class SchemaContractError(ValueError):
    """A batch lacks required columns; its rows are in quarantine."""

    def __init__(self, missing: Iterable[str], batches: Iterable[str] = ()):
        self.missing, self.batches = list(missing), list(batches)
        where = f" in {', '.join(self.batches)}" if self.batches else ""
        super().__init__(f"missing required columns{where}: {', '.join(self.missing)}")


def canonical_names(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Give contract columns their contract spelling.

    ``renames`` (a source's own names) and letter case are both taken care of, so
    every later step may test column names by plain equality.
    """
    wanted = {name.lower(): name for name in TRIP_TYPES}
    wanted.update({old.lower(): new for old, new in (renames or {}).items()})
    changes = {
        name: wanted[name.lower()]
        for name in df.columns
        if wanted.get(name.lower(), name) != name
    }
    return df.withColumnsRenamed(changes) if changes else df


def missing_columns(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> list[str]:
    present = {name.lower() for name in df.columns}
    return [name for name in required if name.lower() not in present]


# Whole numbers and fractions by what they can hold; a wider type takes the narrower.
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FRACTION = ("float", "double")
_TIMES = ("date", "timestamp_ntz", "timestamp")


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds a column which is ``a`` in one batch and ``b`` in another.

    Numbers widen, dates become times, a column without a type takes the other's, and
    whatever else clashes becomes text.
    """
    one, two = a.simpleString(), b.simpleString()
    if one == two or one == "void":
        return b
    if two == "void":
        return a
    for family in (_WHOLE, _FRACTION, _TIMES):
        if one in family and two in family:
            return max((a, b), key=lambda t: family.index(t.simpleString()))
    numbers = (*_WHOLE, *_FRACTION)
    if one in numbers and two in numbers:
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    return T.StringType()


def merged_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """All columns of some schemas, by name without regard to case, in types that hold all."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema:
            known = found.get(field.name.lower())
            kind = field.dataType if known is None else merged_type(known.dataType, field.dataType)
            found[field.name.lower()] = T.StructField(known.name if known else field.name, kind)
    return T.StructType(list(found.values()))


def as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; those ``df`` lacks are NULL."""
    present = {field.name.lower(): field for field in df.schema}

    def column(wanted: T.StructField) -> Column:
        found = present.get(wanted.name.lower())
        if found is None:
            return F.lit(None).cast(wanted.dataType).alias(wanted.name)
        own = F.col(f"`{found.name}`")
        if found.dataType == wanted.dataType:
            return own.alias(wanted.name)
        if isinstance(wanted.dataType, T.StringType):
            return as_text(own, found.dataType).alias(wanted.name)
        return own.cast(wanted.dataType).alias(wanted.name)

    return df.select(*(column(field) for field in schema))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; columns that only some have, or have in other types, too."""
    if len(parts) == 1:
        return parts[0]
    whole = merged_schema(part.schema for part in parts)
    return reduce(DataFrame.union, (conform(part, whole) for part in parts))


# -- rows that can be compared, also where they hold maps


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def _walked(column: Column, kind: T.DataType, back: bool) -> Column:
    """A value with its maps as sorted lists of entries, or, ``back``, the maps again."""
    if not _has_map(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _walked(x, kind.elementType, back))
    if isinstance(kind, T.StructType):
        fields = [_walked(column[f.name], f.dataType, back).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*fields))

    def entry(e: Column) -> Column:
        key, value = _walked(e["key"], kind.keyType, back), _walked(e["value"], kind.valueType, back)
        return F.struct(key.alias("key"), value.alias("value"))

    if back:
        return F.map_from_entries(F.transform(column, entry))
    return F.array_sort(F.transform(F.map_entries(column), entry))


def without_maps(df: DataFrame) -> DataFrame:
    """The rows with every map, nested ones too, as a list of its entries in order.

    Equal maps give equal lists, so rows can be grouped and compared.
    """
    columns = {f.name: _walked(F.col(f"`{f.name}`"), f.dataType, False) for f in df.schema if _has_map(f.dataType)}
    return df.withColumns(columns) if columns else df


def with_maps(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Undo ``without_maps``; ``schema`` is that of the rows as they were."""
    known = set(df.columns)
    columns = {
        f.name: _walked(F.col(f"`{f.name}`"), f.dataType, True)
        for f in schema
        if f.name in known and _has_map(f.dataType)
    }
    return df.withColumns(columns) if columns else df


def retyped_columns(schemas: Iterable[T.StructType]) -> dict[str, list[str]]:
    """Columns that not all schemas hold in one type, and the types met."""
    types: dict[str, list[str]] = {}
    for schema in schemas:
        for field in schema:
            met = types.setdefault(field.name.lower(), [])
            if field.dataType.simpleString() not in met:
                met.append(field.dataType.simpleString())
    return {name: sorted(met) for name, met in types.items() if len(met) > 1}


def schema_check(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row per required column: is it there, and in how many rows is it filled."""
    required = list(required)
    absent = set(missing_columns(df, required))
    filled = df.agg(
        *(
            (F.lit(0).cast("bigint") if name in absent else F.count(name)).alias(name)
            for name in required
        ),
        F.count(F.lit(1)).alias("rows"),
    )
    checks = F.array(
        *(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(name not in absent).alias("present"),
                F.col(name).alias("filled_rows"),
            )
            for name in required
        )
    )
    return filled.select("rows", F.inline(checks)).select(
        "column_name", "present", "filled_rows", "rows"
    )


def schema_drift(df: DataFrame, contract: Mapping[str, str] = TRIP_TYPES) -> DataFrame:
    """Columns a zone has beyond, or lacks of, a contract, with their filled rows.

    ``kind`` is ``added`` for a column outside the contract, ``missing`` for one
    the zone lacks and ``retyped`` for one of another type than the contract's.
    """
    present = {field.name.lower(): field for field in df.schema}
    known = {name.lower() for name in contract}
    kinds: dict[str, str] = {}
    for name, wanted in contract.items():
        found = present.get(name.lower())
        if found is None:
            kinds[name] = "missing"
        elif found.dataType.simpleString() != wanted:
            kinds[found.name] = "retyped"
    kinds.update({f.name: "added" for low, f in present.items() if low not in known})
    filled = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count(name).alias(name) for name, kind in kinds.items() if kind != "missing"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("kind"),
            (F.lit(0).cast("bigint") if kind == "missing" else F.col(name)).alias("filled_rows"),
        )
        for name, kind in kinds.items()
    ]
    if not rows:
        return filled.filter(F.lit(False)).select(
            F.lit("").alias("column_name"),
            F.lit("").alias("kind"),
            F.col("_rows").alias("filled_rows"),
        )
    return filled.select(F.inline(F.array(*rows)))
