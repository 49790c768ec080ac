"""What the operators of this subpackage share: the shared folder, written tables, batch mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_root


def shared_dir(spark: SparkSession) -> str:
    """A new folder (not yet made) below spark.checkpoint.dir."""
    return f"{shared_root(spark)}/ebbmark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Later jobs read that table, so lost executors cost them no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1 << 20) -> DataFrame:
    """function on each Arrow batch, at most rows at once; a batch that gives None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                if (out := function(batch.slice(a, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def arrays(names_types: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in names_types.items()], names=list(names_types))
