"""Values nested in JSON: one path, all texts, and extra fields merged into those above them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values
PREFERRED = ("text", "content", "value", "title", "heading", "paragraph", "requirement", "description", "note")
# --- end of fixed values


def value_at(c: Column, path: str) -> Column:
    """The value at a path of field names with dots, as text; null where the JSON is none or the path ends early."""
    return F.get_json_object(c, "$." + path)


def texts_of(value: object, preferred: tuple[str, ...] = PREFERRED) -> list[str]:
    """Texts and numbers at any depth, each once: of an object those below preferred keys first, then the others in order.

    A subtree is walked once: a second walk, as part of all values of its object, could only repeat what it gave.
    """
    found: dict[str, None] = {}
    rest = [value]
    while rest:
        v = rest.pop()
        if isinstance(v, str):
            if text := v.strip():
                found.setdefault(text)
        elif isinstance(v, bool | int | float):
            found.setdefault(str(v))
        elif isinstance(v, list):
            rest += reversed(v)
        elif isinstance(v, dict):
            first = [x for k, x in v.items() if k.lower() in preferred]
            rest += reversed(first + [x for k, x in v.items() if k.lower() not in preferred])
    return list(found)


def nested_texts(rows: DataFrame, column: str, keep: list[str], preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """Columns ``keep`` and ``texts``, what ``texts_of`` finds in JSON; null, invalid and too deep JSON gives an empty list.

    A VARIANT column is read through its JSON form, whose keys are sorted; text keeps the order in which keys stand.
    """
    kind = rows.schema[column].dataType.simpleString()
    text = F.to_json(column) if kind == "variant" else F.col(column).cast("string")
    given = rows.select(*keep, text.alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1).to_pylist():
                try:
                    out.append(texts_of(json.loads(x), preferred) if x else [])
                except (ValueError, RecursionError):
                    out.append([])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.string()))], [*b.schema.names[:-1], "texts"])

    schema = given.drop("_json").withColumn("texts", F.array().cast("array<string>")).schema
    return given.mapInArrow(run, schema)


def merged_fields(base: Column, extra: Column) -> Column:
    """A map with the fields of ``extra`` where ``base`` has none, or a null or empty one, of that name."""
    none = F.create_map().cast("map<string,string>")
    base, extra = F.coalesce(base, none), F.coalesce(extra, none)
    kept = F.map_filter(base, lambda k, v: ~(F.map_contains_key(extra, k) & (v.isNull() | (v == ""))))
    return F.map_concat(kept, F.map_filter(extra, lambda k, _: ~F.map_contains_key(kept, k)))
