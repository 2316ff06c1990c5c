"""Which columns are privacy id, partition key and value."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class RowFunction:
    """A Python function of a row (a ``Row`` of all the frame's columns) and the type that it
    gives.  All row functions of an extraction run in one pass over Arrow batches; a column
    or its name is faster, and lets unused columns stay unread."""

    function: Callable[[Row], Any]
    type: T.DataType | str


def of_row(function: Callable[[Row], Any], type: T.DataType | str) -> RowFunction:
    return RowFunction(function, type)


#: A column, its name, a function of the frame that gives a column, or one of its rows.
Extractor = Column | str | Callable[[DataFrame], Column] | RowFunction


@dataclass
class DataExtractors:
    """``partition_extractor`` may be a sequence for keys of several columns, and
    ``value_extractor`` one for several value columns."""

    privacy_id_extractor: Extractor | None = None
    partition_extractor: Extractor | Sequence[Extractor] | None = None
    value_extractor: Extractor | Sequence[Extractor] | None = None


@dataclass
class MultiValueDataExtractors(DataExtractors):
    value_extractors: Sequence[Extractor] | None = None

    def __post_init__(self) -> None:
        if self.value_extractors is not None:
            self.value_extractor = list(self.value_extractors)


@dataclass
class PreAggregateExtractors:
    """``preaggregate_extractor``: struct or names of count, sum, n_partitions, n_contributions."""

    partition_extractor: Extractor | Sequence[Extractor]
    preaggregate_extractor: Any


def column(df: DataFrame, extractor: Extractor) -> Column:
    if isinstance(extractor, str):
        return df[extractor]
    if isinstance(extractor, RowFunction):
        raise TypeError("a function of rows stands for itself, not inside another extractor")
    return extractor if isinstance(extractor, Column) else extractor(df)


def listed(extractor: Extractor | Sequence[Extractor] | None) -> list[Extractor]:
    if extractor is None:
        return []
    return list(extractor) if isinstance(extractor, (list, tuple)) else [extractor]


def columns(df: DataFrame, extractor: Extractor | Sequence[Extractor] | None) -> list[Column]:
    return [column(df, e) for e in listed(extractor)]


def evaluated(df: DataFrame, extractors: Sequence[Extractor]) -> tuple[DataFrame, list[Column]]:
    """The extractors' columns, and the frame that they are columns of: ``df`` itself, or one
    in which the row functions were evaluated, batch by batch."""
    if not any(isinstance(e, RowFunction) for e in extractors):
        return df, [column(df, e) for e in extractors]
    names = list(df.columns)
    plain = {i: column(df, e).alias(f"_x{i}") for i, e in enumerate(extractors) if not isinstance(e, RowFunction)}
    functions = {i: e for i, e in enumerate(extractors) if isinstance(e, RowFunction)}
    # columns by place, as two may have one name
    by_place = df.toDF(*[f"_c{i}" for i in range(len(names))]) if len(set(names)) < len(names) else df
    if by_place is not df and plain:
        raise ValueError("of a frame with two columns of one name, either all extractors are functions of rows or none")
    flat = by_place.select("*", *plain.values())
    given = T.StructType([T.StructField(f"_x{i}", T.StructType.fromDDL(f"x {e.type}").fields[0].dataType if isinstance(e.type, str) else e.type) for i, e in functions.items()])
    schema = T.StructType([*[flat.schema[f"_x{i}"] for i in plain], *given.fields])
    arrow, make, calls = to_arrow_schema(given), Row(*names), [e.function for e in functions.values()]
    made_names, width = schema.names, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(*values) for values in zip(*[c.to_pylist(maps_as_pydicts="strict") for c in batch.columns[:width]])] if width else [make()] * batch.num_rows
            made = [pa.array([call(row) for row in rows], field.type) for call, field in zip(calls, arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[width:], *made], names=made_names)

    out = flat.mapInArrow(run, schema)
    return out, [out[f"_x{i}"] for i in range(len(extractors))]


def key_names(extractor: Extractor | Sequence[Extractor]) -> list[str]:
    """Output names of the key: as given by name, else partition_key (with a number)."""
    parts = list(extractor) if isinstance(extractor, (list, tuple)) else [extractor]
    many = len(parts) > 1
    return [p if isinstance(p, str) else f"partition_key{i if many else ''}" for i, p in enumerate(parts)]


def extract(df: DataFrame, e: DataExtractors, row_id: Column | None = None) -> tuple[DataFrame, list[str]]:
    """(pid, k0, k1, ..., value[, row_id]) and the key's output names.  Rows without a
    privacy id belong to nobody and go; a null key is an ordinary key."""
    parts, several = listed(e.partition_extractor), listed(e.value_extractor)
    given = [] if e.privacy_id_extractor is None else [e.privacy_id_extractor]
    df, found = evaluated(df, [*given, *parts, *several, *([] if row_id is None else [row_id])])
    if row_id is not None:
        *found, row_id = found
    pid = found.pop(0) if given else F.lit(None).cast("long")
    keys, values = found[: len(parts)], found[len(parts) :]
    if len(values) > 1:
        value = F.array(*[v.cast("double") for v in values])
    else:
        value = values[0] if values else F.lit(0.0)
    out = df.select(pid.alias("pid"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("value"), *([] if row_id is None else [row_id.alias("row_id")]))
    if out.schema["value"].dataType.typeName() != "array":
        out = out.withColumn("value", F.col("value").cast("double"))
    return (out if e.privacy_id_extractor is None else out.where("pid is not null")), key_names(e.partition_extractor)
