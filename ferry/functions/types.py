"""What a provider may make of a column's declared type.

Some providers lack a type and store the values in a wider one.  A copy into
such a provider is right when every declared type is the source's or what the
provider is known to make of it; anything else is a difference.  The rules hold
at every depth of arrays, maps and structs.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    ByteType,
    CharType,
    DataType,
    IntegerType,
    MapType,
    ShortType,
    StringType,
    StructField,
    StructType,
    VarcharType,
)

# Provider -> (type without its size -> the type that it stores).
# Providers that are not named keep every type.
WIDENINGS: dict[str, dict[type[DataType], DataType]] = {
    "iceberg": {VarcharType: StringType(), CharType: StringType(), ByteType: IntegerType(), ShortType: IntegerType()},
}


def stored_type(kind: DataType, provider: str | None) -> DataType:
    """The type that ``provider`` stores for ``kind``."""
    rules = WIDENINGS.get((provider or "").lower(), {})
    if isinstance(kind, ArrayType):
        return ArrayType(stored_type(kind.elementType, provider), kind.containsNull)
    if isinstance(kind, MapType):
        return MapType(stored_type(kind.keyType, provider), stored_type(kind.valueType, provider), kind.valueContainsNull)
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, stored_type(f.dataType, provider), f.nullable) for f in kind.fields])
    return rules.get(type(kind), kind)


def widened(source: str, target: str, provider: str | None) -> bool:
    """Whether the declared type ``target`` is what ``provider`` stores for
    the declared type ``source`` (both as a catalog shows them)."""
    if source == target:
        return False
    try:
        stored = stored_type(DataType.fromDDL(source), provider)
        return stored.simpleString().lower() == DataType.fromDDL(target).simpleString().lower()
    except Exception:  # a type that Spark cannot read back is compared as text
        return False


def compare_types(source: dict[str, str], target: dict[str, str], provider: str | None) -> tuple[list[str], list[str]]:
    """(differences, widenings allowed) between declared column types by name."""
    wrong, notes = [], []
    for name in sorted(source.keys() | target.keys()):
        a, b = source.get(name), target.get(name)
        if a != b:
            allowed = a is not None and b is not None and widened(a, b, provider)
            (notes if allowed else wrong).append(f"{name}: {a or 'absent'} -> {b or 'absent'}")
    return wrong, notes
