"""Strict types of JSON documents: each value held against a schema before it is cast to it.

A document is parsed as VARIANT, which keeps every value's own type, and walked along the schema by
column expressions. Each item of a list or map is taken apart once, into a struct whose fields are its
values; the types of lists and structs are looked up only where they are no such thing, since that
reads all they hold. ``from_json`` and the like make null of a value of the wrong type, so that a
default fills it and nothing shows; here it is a fault, whatever becomes of it later.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

FAULTS = "array<struct<entity:string,entity_id:string,field:string,expected:string,found:string>>"
#: What a value's own type may be, by the type that the schema wants.
_TAKES = {"string": "= 'STRING'", "boolean": "= 'BOOLEAN'", "bigint": "= 'BIGINT'", "int": "= 'BIGINT'", "double": "rlike '^(BIGINT$|DOUBLE$|FLOAT$|DECIMAL)'"}
_NONE = f"cast(array() as {FAULTS})"


def type_faults(document: str, schema: StructType, entity: str, entity_id: str, entities: dict[str, tuple[str, str]], opaque: set[str] = frozenset(), never_null: set[str] = frozenset()) -> Column:
    """``ARRAY<STRUCT<entity, entity_id, field, expected, found>>``: the values of a JSON document that are not of the schema's types.

    ``document`` and ``entity_id`` are SQL expressions. ``entities`` names what stands at a path
    (``devices.descriptor`` and so on; list items and map values have their container's path) and the
    field that identifies it; a fault belongs to the innermost one, and ``field`` is the last name on
    its path. Whole numbers are ``BIGINT`` only if written as such (not 5.0, "5" or true); a number of
    any kind is a ``double``. Fields that are absent are no faults, nor are nulls but in lists and maps
    and for the names in ``never_null``. Names in ``opaque`` take anything; fields that the schema
    doesn't name are passed over. A document that is null, no JSON, or no mapping is one fault, of the
    field ``document``.
    """

    def shape(kind: DataType) -> str:
        """The type that a value is taken apart to: structs by field, lists and maps by item, values with a type of their own."""
        if isinstance(kind, StructType):
            return f"struct<{', '.join(f'{f.name}: {shape(f.dataType)}' for f in kind.fields if f.name not in opaque)}>"
        return "array<variant>" if isinstance(kind, ArrayType) else "map<string, variant>" if isinstance(kind, MapType) else "variant"

    def apart(items: str, kind: DataType, item: str) -> str:
        """Each of ``items`` beside what it is taken apart to, once, however many fields are looked at."""
        return f"transform({items}, {item} -> named_struct('v', {item}, 's', try_variant_get({item}, '$', '{shape(kind)}')))"

    def walk(v: str, at: str, s: str, kind: DataType, field: str, needed: bool, path: str, owner: str, ident: str, depth: int = 0) -> str:
        item, container = f"x{depth}", isinstance(kind, StructType | ArrayType | MapType)
        found = f"schema_of_variant(try_variant_get({v}, '{at}', 'variant'))" if container else f"schema_of_variant({s})"
        wanted = kind.simpleString() if kind.simpleString() in _TAKES else kind.typeName()
        fault = f"cast(array(named_struct('entity', '{owner}', 'entity_id', {ident}, 'field', '{field}', 'expected', '{wanted}', 'found', coalesce(substring_index({found}, '<', 1), 'NONE'))) as {FAULTS})"
        good = f"{s} is not null" if container else f"{found} {_TAKES[kind.simpleString()]}"
        if isinstance(kind, StructType):
            if path in entities:
                owner, ident = entities[path][0], f"try_variant_get({v}, '{at}.{entities[path][1]}', 'string')"
            parts = [walk(v, f"{at}.{f.name}", f"{s}.{f.name}", f.dataType, f.name, f.name in never_null, f"{path}.{f.name}".lstrip("."), owner, ident, depth) for f in kind.fields if f.name not in opaque]
            below = f"concat({', '.join(parts)})"
        elif container:
            inside = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
            items = s if isinstance(kind, ArrayType) else f"map_values({s})"
            below = f"flatten(transform({apart(items, inside, item)}, {item} -> {walk(f'{item}.v', '$', f'{item}.s', inside, field, True, path, owner, ident, depth + 1)}))"
        else:
            below = _NONE
        nothing = f"{found if container else s} is null"
        absent = "false" if field == "document" else nothing if needed else f"{nothing} or {found} = 'VOID'"
        return f"CASE WHEN {good} THEN {below} WHEN {absent} THEN {_NONE} ELSE {fault} END"

    root = apart(f"array(try_parse_json({document}))", schema, "d")
    return F.expr(f"flatten(transform({root}, d -> {walk('d.v', '$', 'd.s', schema, 'document', True, '', entity, entity_id)}))")
