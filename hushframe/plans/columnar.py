"""User aggregates whose states are columns: arrays in, arrays out, merged by key in batches.

A ``ColumnarCombiner`` never sees one row at a time.  A task starts the states of a batch of
privacy units, merges them by key at once, and holds one state for each key until it has
``HELD`` of them or ends; so a key leaves a task as few states, however many rows it has.
After the shuffle rows lie sorted by key, and batches are merged again: only the last key of
a batch stays open.  States may have any Arrow type, results any columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..budget import BudgetAccountant
from ..params import AggregateParams

#: States, and bytes of them, that a task holds before it sends them.
HELD, HELD_BYTES = 1 << 14, 64 << 20

States = dict[str, pa.Array]


class ColumnarCombiner:
    """A user-defined aggregate over Arrow columns.

    ``group`` numbers the state that each row goes to, from 0 below ``n``; groups come in
    ascending order in ``start`` and in any order in ``merge``, and a group of no rows has
    the empty state."""

    def set_aggregate_params(self, params: AggregateParams) -> None:
        self._aggregate_params = params

    def request_budget(self, accountant: BudgetAccountant) -> None:
        raise NotImplementedError

    def state_schema(self) -> str:
        """The state's columns, as DDL."""
        raise NotImplementedError

    def start(self, values: pa.Array, group: np.ndarray, n: int) -> States:
        """States of ``n`` units in a partition, from their bounded rows' values."""
        raise NotImplementedError

    def merge(self, states: States, group: np.ndarray, n: int) -> States:
        raise NotImplementedError

    def output_schema(self) -> str:
        """The result's columns, as DDL."""
        raise NotImplementedError

    def compute_metrics(self, states: States) -> dict[str, Any]:
        """The protected results of many partitions, as arrays."""
        raise NotImplementedError

    def metrics_names(self) -> list[str]:
        return [f.name for f in fields(self.output_schema())]

    def explain_computation(self) -> str:
        return f"Computed custom metrics {self.metrics_names()}"


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


class RowCombiner(ColumnarCombiner):
    """A combiner of the row protocol (``CustomCombiner``): its accumulators, any picklable
    objects, as one binary column."""

    def __init__(self, combiner: Any):
        self.combiner, self.names = combiner, combiner.metrics_names()

    def set_aggregate_params(self, params: AggregateParams) -> None:
        self.combiner.set_aggregate_params(params)

    def request_budget(self, accountant: BudgetAccountant) -> None:
        self.combiner.request_budget(accountant)

    def state_schema(self) -> str:
        return "acc binary"

    def start(self, values: pa.Array, group: np.ndarray, n: int) -> States:
        ends = np.searchsorted(group, np.arange(n + 1)).tolist()
        rows = values.to_pylist()
        return {"acc": pa.array([pickle.dumps(self.combiner.create_accumulator(rows[a:b])) for a, b in zip(ends, ends[1:])], pa.binary())}

    def merge(self, states: States, group: np.ndarray, n: int) -> States:
        total: list[Any] = [None] * n
        known = [False] * n
        for g, raw in zip(group.tolist(), states["acc"].to_pylist()):
            own = pickle.loads(raw)
            total[g] = self.combiner.merge_accumulators(total[g], own) if known[g] else own
            known[g] = True
        return {"acc": pa.array([pickle.dumps(t) for t in total], pa.binary())}

    def output_schema(self) -> str:
        return self.combiner.output_schema()

    def compute_metrics(self, states: States) -> dict[str, Any]:
        found = [self.combiner.compute_metrics(pickle.loads(raw)) for raw in states["acc"].to_pylist()]
        return {name: [f[name] for f in found] for name in self.names}

    def explain_computation(self) -> str:
        return self.combiner.explain_computation()


def as_columnar(combiner: Any) -> ColumnarCombiner:
    return combiner if isinstance(combiner, ColumnarCombiner) else RowCombiner(combiner)


def grouped(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, first row of each group); equal rows, nulls included, share one."""
    n = len(columns[0]) if columns else 0
    code = np.zeros(n, np.int64)
    for column in columns:
        try:
            own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        except (pa.ArrowNotImplementedError, pa.ArrowInvalid):  # nested keys
            known: dict[bytes, int] = {}
            own = np.array([known.setdefault(pickle.dumps(v), len(known)) for v in column.to_pylist()], np.int64)
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    first = np.full(int(code.max(initial=-1)) + 1, n)
    np.minimum.at(first, code, np.arange(n))
    return code, first


class StateTable:
    """Key columns, number of units and the states of some combiners, column by column."""

    def __init__(self, combiners: Sequence[ColumnarCombiner], keys: Sequence[T.StructField]):
        self.combiners, self.n_keys = combiners, len(keys)
        states = [fields(c.state_schema()) for c in combiners]
        self.names = [[f.name for f in own] for own in states]
        own = [T.StructField(f"s{i}_{f.name}", f.dataType) for i, of in enumerate(states) for f in of]
        self.schema = T.StructType([*keys, T.StructField("_units", T.LongType()), *own])
        self.arrow = to_arrow_schema(self.schema)

    def states(self, batch: pa.RecordBatch | pa.Table, i: int) -> States:
        out = {}
        for name in self.names[i]:
            column = batch.column(f"s{i}_{name}")
            out[name] = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return out

    def batch(self, keys: Sequence[pa.Array], units: np.ndarray, states: Sequence[States]) -> pa.RecordBatch:
        named = {f"s{i}_{k}": v for i, own in enumerate(states) for k, v in own.items()}
        columns = [*keys, pa.array(units, pa.int64())]
        for f in list(self.arrow)[self.n_keys + 1 :]:
            v = named[f.name]
            columns.append(v if isinstance(v, pa.Array) and v.type == f.type else v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type))
        return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, self.arrow)], schema=self.arrow)

    def started(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """One state for each key of a batch of units (keys, list of values)."""
        values = batch.column(self.n_keys)
        n = batch.num_rows
        sizes = np.nan_to_num(values.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        unit, flat = np.repeat(np.arange(n), sizes), values.flatten()
        group, first = grouped(batch.columns[: self.n_keys])
        states = [c.merge(c.start(flat, unit, n), group, len(first)) for c in self.combiners]
        taken = pa.array(first)
        return self.batch([c.take(taken) for c in batch.columns[: self.n_keys]], np.bincount(group, minlength=len(first)), states)

    def merged(self, batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[: self.n_keys]]
        group, first = grouped(keys)
        if len(first) == table.num_rows and len(batches) == 1:
            return batches[0]
        units = np.zeros(len(first), np.int64)
        np.add.at(units, group, table.column("_units").to_numpy())
        taken = pa.array(first)
        return self.batch([k.take(taken) for k in keys], units, [c.merge(self.states(table, i), group, len(first)) for i, c in enumerate(self.combiners)])

    def empty(self, n: int) -> list[States]:
        """``n`` empty states of each combiner."""
        return [c.start(pa.array([], pa.null()), np.zeros(0, np.int64), n) for c in self.combiners]


def merged_states(unit: DataFrame, keys: Sequence[str], combiners: Sequence[ColumnarCombiner], values: str) -> tuple[DataFrame, StateTable]:
    """(keys, _units, states) of all units (keys, list of values) of each key."""
    source = unit.select(*keys, values)
    table = StateTable(combiners, [source.schema[k] for k in keys])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held = [table.merged([*held, table.started(batch)])]
                if held[0].num_rows >= HELD or held[0].nbytes >= HELD_BYTES:
                    yield held.pop()
        yield from held

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still: list[pa.RecordBatch] = []  # the last key so far, which may go on
        for batch in batches:
            if batch.num_rows:
                whole = table.merged([*still, batch])
                pairs = zip(batch.columns[: table.n_keys], whole.columns[: table.n_keys])
                code, _ = grouped([pa.concat_arrays([rows.slice(batch.num_rows - 1, 1), own]) for rows, own in pairs])
                open_ = pa.array(code[1:] == code[0])
                still = [whole.filter(open_)]
                done = whole.filter(pc.invert(open_))
                if done.num_rows:
                    yield done
        yield from still

    sent = source.mapInArrow(start, table.schema)
    sorted_ = sent.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(finish, table.schema), table


class VectorSum(ColumnarCombiner):
    """Sums of vectors of ``size`` coordinates; a unit's own sum is first brought to the
    norm bound by ``bounded`` (a table of unit vectors to the same table)."""

    def __init__(self, size: int, bounded: Callable[[np.ndarray], np.ndarray]):
        self.size, self.bounded = size, bounded

    def state_schema(self) -> str:
        return "vector array<double>"

    def _listed(self, sums: np.ndarray) -> States:
        return {"vector": pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * self.size, pa.int32()), pa.array(sums.ravel()))}

    def _table(self, vectors: pa.Array) -> np.ndarray:
        """Vectors as rows; missing coordinates count as 0, those beyond ``size`` do not count."""
        lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) if len(vectors) else np.zeros(0, np.int64)
        flat = np.nan_to_num(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf) if len(vectors) else np.zeros(0)
        if (lengths == self.size).all():
            return flat.reshape(-1, self.size)
        out = np.zeros((len(lengths), self.size))
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = at < self.size
        out[row[inside], at[inside]] = flat[inside]
        return out

    def _added(self, table: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.size))
        if len(group):
            order = np.argsort(group, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
            out[group[order][head]] = np.add.reduceat(table[order], head, axis=0)
        return out

    def start(self, values: pa.Array, group: np.ndarray, n: int) -> States:
        return self._listed(self.bounded(self._added(self._table(values), group, n)))

    def merge(self, states: States, group: np.ndarray, n: int) -> States:
        return self._listed(self._added(self._table(states["vector"]), group, n))
