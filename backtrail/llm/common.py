"""What the operators of this subpackage share: table access, scratch tables and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from backtrail.sources.scratch import keep, scratch_root  # noqa: F401 - for the operators

#: Rows handled at once inside a Python worker; bounds the Python objects alive beside one Arrow batch.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder; only the given columns, so extra ones can't clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A table just read, dealt out to all cores if it has so few splits that most of them would idle; df must be a scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return keep(df, f"llm-{name}")


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple[list, ...]]]) -> DataFrame:
    """Apply a function to slices of rows through Arrow.

    ``make()`` runs once in each task and returns ``f(*lists)``, which gets one list for each input column and
    returns one list for each output column; it may return more or fewer rows than it got.
    """
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = f(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def column(returns: str, make: Callable[[], Callable[[list], list]], text: Column) -> Column:
    """A column computed from one other column by ``make()(values)``, a slice of rows at a time; runs through Arrow."""

    kind = _arrow_type(StructType.fromDDL(f"x {returns}")["x"].dataType)

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            parts = [pa.array(f(batch.slice(at, SLICE_ROWS).to_pylist()), type=kind) for at in range(0, len(batch), SLICE_ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run(text)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
