"""A private DataFrame: rows with a hidden privacy id, from which only protected results come."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .budget import BudgetAccountant
from .engine import CustomCombiner, DPEngine, DPResult
from .extractors import DataExtractors, Extractor
from .params import AggregateParams, CountParams, MeanParams, PrivacyIdCountParams, SelectPartitionsParams, SumParams, VarianceParams
from .plans.columnar import ColumnarCombiner, fields
from .report import ExplainComputationReport

PID = "__privacy_id"


class PrivateCombineFn:
    """An aggregate in four steps: accumulators are created, given one clipped value after
    another, merged, and turned into a protected number by ``extract_private_output``."""

    def create_accumulator(self) -> Any:
        raise NotImplementedError

    def add_private_input(self, accumulator: Any, value: Any) -> Any:
        """The accumulator with a value, which is to be clipped here."""
        raise NotImplementedError

    def merge_accumulators(self, accumulators: Iterable[Any]) -> Any:
        raise NotImplementedError

    def request_budget(self, accountant: BudgetAccountant) -> Any:
        """What is asked of the accountant; ``extract_private_output`` gets it back."""
        raise NotImplementedError

    def extract_private_output(self, accumulator: Any, budget: Any) -> Any:
        """The number ``combined``, or a dict of the columns of ``output_schema``."""
        raise NotImplementedError

    def output_schema(self) -> str:
        return "combined double"


class CombineFnAdapter(CustomCombiner):
    """A ``PrivateCombineFn`` as a combiner of the engine."""

    def __init__(self, function: PrivateCombineFn):
        self.function, self.budget = function, None

    def request_budget(self, accountant: BudgetAccountant) -> None:
        self.budget = self.function.request_budget(accountant)

    def create_accumulator(self, values: list[Any]) -> Any:
        return functools.reduce(self.function.add_private_input, values, self.function.create_accumulator())

    def merge_accumulators(self, a: Any, b: Any) -> Any:
        return self.function.merge_accumulators([a, b])

    def compute_metrics(self, accumulator: Any) -> dict[str, Any]:
        found = self.function.extract_private_output(accumulator, self.budget)
        return found if isinstance(found, dict) else {"combined": float(found)}

    def metrics_names(self) -> list[str]:
        return [f.name for f in fields(self.output_schema())]

    def output_schema(self) -> str:
        return self.function.output_schema()


class PrivateDataFrame:
    """Transformations keep each row's privacy id; DP methods give a ``DPResult``."""

    def __init__(self, df: DataFrame, accountant: BudgetAccountant):
        self._df, self._accountant = df, accountant

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c != PID]

    def _with(self, df: DataFrame) -> "PrivateDataFrame":
        return PrivateDataFrame(df, self._accountant)

    def select(self, *columns: str | Column) -> "PrivateDataFrame":
        """A projection; generators (explode) keep the id of the row that they came from."""
        return self._with(self._df.select(F.col(PID), *columns))

    def map(self, *how: Any, schema: Any = None) -> "PrivateDataFrame":
        """Columns, or a function of a row (a dict of its visible columns) that gives a dict of
        the ``schema``; it runs over Arrow batches in Python."""
        if len(how) == 1 and callable(how[0]) and not isinstance(how[0], Column):
            return self._mapped(lambda row: [how[0](row)], schema)
        return self.select(*how)

    def flat_map(self, *how: Any, schema: Any = None) -> "PrivateDataFrame":
        """Columns with a generator, or a function of a row that gives any number of dicts."""
        if len(how) == 1 and callable(how[0]) and not isinstance(how[0], Column):
            return self._mapped(how[0], schema)
        return self.select(*how)

    def _mapped(self, function: Callable[[dict], Iterable[dict]], schema: Any) -> "PrivateDataFrame":
        """Every row that a function makes keeps the privacy id of the row it came from."""
        if schema is None:
            raise ValueError("a function of rows needs the schema of what it gives")
        made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if PID in made.names:
            raise ValueError("The privacy id can't be rewritten.")
        whole = T.StructType([self._df.schema[PID], *made.fields])
        arrow = to_arrow_schema(whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(PID)
                names = [n for i, n in enumerate(batch.schema.names) if i != at]
                columns = [c.to_pylist() for i, c in enumerate(batch.columns) if i != at]
                own, out = [], []
                for i, values in enumerate(zip(*columns) if columns else [()] * batch.num_rows):
                    for found in function(dict(zip(names, values))):
                        own.append(i)
                        out.append(found)
                pids = batch.column(at).take(pa.array(own, pa.int64()))  # ids stay Arrow's
                yield pa.RecordBatch.from_arrays([pids.cast(arrow.field(0).type), *[pa.array([found.get(f.name) for found in out], f.type) for f in list(arrow)[1:]]], schema=arrow)

        return self._with(self._df.mapInArrow(run, whole))

    def table_function(self, function: Any, *arguments: str | Column) -> "PrivateDataFrame":
        """The rows that a user-defined table function (``udtf(..., useArrow=True)`` goes by
        Arrow batches) makes of each row's ``arguments``; each keeps the privacy id of the row
        it came from.  Functions with a ``terminate`` step are refused: what it gives at the
        end comes from the rows of many units."""
        if hasattr(getattr(function, "func", function), "terminate"):
            raise ValueError("a table function that ends with terminate() mixes the rows of privacy units")
        given = [F.col(a) if isinstance(a, str) else a for a in arguments]
        joined = self._df.lateralJoin(function(*[a.outer() for a in given]))
        own, names = len(self._df.columns), joined.columns
        if PID in names[own:]:
            raise ValueError("The privacy id can't be rewritten.")
        flat = joined.toDF(*[f"_c{i}" for i in range(len(names))])
        return self._with(flat.select(F.col(f"_c{self._df.columns.index(PID)}").alias(PID), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if i >= own]))

    def with_column(self, name: str, column: Column) -> "PrivateDataFrame":
        if name == PID:
            raise ValueError("The privacy id can't be rewritten.")
        return self._with(self._df.withColumn(name, column))

    def filter(self, condition: str | Column | Callable[[dict], bool]) -> "PrivateDataFrame":
        if callable(condition) and not isinstance(condition, Column):
            own = T.StructType([f for f in self._df.schema.fields if f.name != PID])
            return self._mapped(lambda row: [row] if condition(row) else [], own)
        return self._with(self._df.where(condition))

    def _metric(self, params: Any, public: Any, report: Any, value: Extractor | None) -> DPResult:
        extractors = DataExtractors(PID, params.partition_extractor, value)
        return DPEngine(self._accountant).aggregate(self._df, params.to_aggregate_params(), extractors, public, report)

    def variance(self, params: VarianceParams, public_partitions: DataFrame | Iterable[Any] | None = None, out_explain_computation_report: ExplainComputationReport | None = None) -> DPResult:
        return self._metric(params, public_partitions, out_explain_computation_report, params.value_extractor)

    def mean(self, params: MeanParams, public_partitions: DataFrame | Iterable[Any] | None = None, out_explain_computation_report: ExplainComputationReport | None = None) -> DPResult:
        return self._metric(params, public_partitions, out_explain_computation_report, params.value_extractor)

    def sum(self, params: SumParams, public_partitions: DataFrame | Iterable[Any] | None = None, out_explain_computation_report: ExplainComputationReport | None = None) -> DPResult:
        return self._metric(params, public_partitions, out_explain_computation_report, params.value_extractor)

    def count(self, params: CountParams, public_partitions: DataFrame | Iterable[Any] | None = None, out_explain_computation_report: ExplainComputationReport | None = None) -> DPResult:
        return self._metric(params, public_partitions, out_explain_computation_report, None)

    def privacy_id_count(self, params: PrivacyIdCountParams, public_partitions: DataFrame | Iterable[Any] | None = None, out_explain_computation_report: ExplainComputationReport | None = None) -> DPResult:
        return self._metric(params, public_partitions, out_explain_computation_report, None)

    def select_partitions(self, params: SelectPartitionsParams, partition_extractor: Extractor) -> DPResult:
        return DPEngine(self._accountant).select_partitions(self._df, params, DataExtractors(PID, partition_extractor))

    def combine(self, combiner: "CustomCombiner | ColumnarCombiner | PrivateCombineFn", params: AggregateParams, partition_extractor: Extractor, value_extractor: Extractor, public_partitions: Any = None) -> DPResult:
        """A user-defined aggregate; ``params`` has its bounds."""
        if isinstance(combiner, PrivateCombineFn):
            combiner = CombineFnAdapter(combiner)
        given = {k: getattr(params, k) for k in params.__dataclass_fields__} | {"metrics": None, "custom_combiners": [combiner]}
        return DPEngine(self._accountant).aggregate(self._df, AggregateParams(**given), DataExtractors(PID, partition_extractor, value_extractor), public_partitions)


def make_private(df: DataFrame, budget_accountant: BudgetAccountant, privacy_id_extractor: str | Column) -> PrivateDataFrame:
    """Rows without a privacy id belong to nobody and go."""
    pid = F.col(privacy_id_extractor) if isinstance(privacy_id_extractor, str) else privacy_id_extractor
    return PrivateDataFrame(df.withColumn(PID, pid).where(F.col(PID).isNotNull()), budget_accountant)
