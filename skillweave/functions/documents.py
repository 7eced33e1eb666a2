"""Nested documents: fields renamed and left out by path, values translated, empty parts pruned, all from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pruned(value: Column, kind: T.DataType) -> Column:
    """Null where a part holds nothing: an empty array or map, an empty text, a struct of nulls."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(value) > 0, value)
    if isinstance(kind, T.StringType):
        return F.when(value != "", value)
    if isinstance(kind, T.StructType):
        return F.when(_any(value, kind), value)
    return value


def _any(value: Column, kind: T.StructType) -> Column:
    out = F.lit(False)
    for f in kind.fields:
        out = out | value[f.name].isNotNull()
    return out


def _renamed(kind: T.DataType, path: str, names: dict[str, str], dropped: set[str]) -> T.DataType:
    """The type that translated() gives a value of a type."""
    if isinstance(kind, T.StructType):
        kept = [(f, f"{path}.{f.name}".lstrip(".")) for f in kind.fields]
        return T.StructType([T.StructField(names.get(p, f.name), _renamed(f.dataType, p, names, dropped)) for f, p in kept if p not in dropped])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, path, names, dropped))
    return kind


def translated(value: Column, kind: T.DataType, names: dict[str, str], values: dict[str, dict[str, str]] | None = None, dropped: set[str] | None = None, path: str = "") -> Column:
    """A nested value with fields renamed by path, left out or translated, and empty parts null.

    A path is the names of the fields down to one, joined by points; arrays add nothing. values maps a path to texts and
    what they become; texts it lacks stay. The walk is over the schema, so the result is one expression.
    """
    values, dropped = values or {}, dropped or set()
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            p = f"{path}.{f.name}".lstrip(".")
            if p not in dropped:
                fields.append(translated(value[f.name], f.dataType, names, values, dropped, p).alias(names.get(p, f.name)))
        made = F.when(value.isNotNull(), F.struct(*fields))
        return _pruned(made, _renamed(kind, path, names, dropped))
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x: translated(x, kind.elementType, names, values, dropped, path))
        return _pruned(F.filter(each, lambda x: x.isNotNull()), T.ArrayType(_renamed(kind.elementType, path, names, dropped)))
    if path in values and values[path]:
        table = F.create_map(*[x for pair in values[path].items() for x in map(F.lit, pair)])
        value = F.coalesce(F.try_element_at(table, value), value)
    return _pruned(value, kind)


def translated_document(rows: DataFrame, names: dict[str, str], values: dict[str, dict[str, str]] | None = None, dropped: set[str] | None = None) -> Column:
    """The columns of rows as one JSON text, translated; empty parts are not in it."""
    dropped = dropped or set()
    parts = [translated(F.col(f"`{f.name}`"), f.dataType, names, values, dropped, f.name).alias(names.get(f.name, f.name)) for f in rows.schema.fields if f.name not in dropped]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "true"})


#: The names of a gap document's parts and of priorities in a prompt, fixed values.
PROMPT_NAMES = {
    "role": "vai_trò_mục_tiêu",
    "readiness": "điểm_sẵn_sàng",
    "strengths": "điểm_mạnh",
    "critical_gaps": "khoảng_trống_quan_trọng",
    "medium_gaps": "khoảng_trống_trung_bình",
    "actions": "hành_động_cải_thiện",
    "actions.skill": "kỹ_năng",
    "actions.priority": "mức_độ_ưu_tiên",
    "actions.action": "hành_động",
}
PROMPT_VALUES = {"actions.priority": {"High": "Cao", "Medium": "Trung bình", "Low": "Thấp"}}
#: What a prompt must not name.
PROMPT_DROPPED = {"optional_gaps", "extra_skills", "actions.rank"}
