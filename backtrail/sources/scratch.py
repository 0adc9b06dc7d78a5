"""Tables that cut the lineage of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the session is local, one is made."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    root = tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet and read it back; a lost executor then costs no recomputation of earlier steps."""
    path = posixpath.join(scratch_root(df.sparkSession), f"step-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """keep(), and the number of rows, which the same job counts."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]
