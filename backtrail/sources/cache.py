"""Artifacts that are built once and read as long as their inputs stay the same, sinks, and the readiness gate."""

from __future__ import annotations

import contextlib
import hashlib
import json
import logging
import os
import posixpath
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.sources.scratch import scratch_root

LOG = logging.getLogger("backtrail")
VERSION = 1
#: Names the folder of artifacts.
CACHE_VARIABLE = "BACKTRAIL_CACHE_DIR"


def cache_root(spark: SparkSession) -> str:
    """The folder that the environment names; else one beside the tables that steps write, which all executors share."""
    return os.environ.get(CACHE_VARIABLE) or posixpath.join(scratch_root(spark), "artifacts")


def entry_digest(*parts: Column | str) -> Column:
    """A number of 60 bits for one file's facts, to be added up."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(files: DataFrame, version: int = VERSION) -> str:
    """A digest of names, sizes and times of files (path, length, modificationTime), whatever their order. Each
    file's digest is added up, so nothing is gathered in one place."""
    one = entry_digest(F.lit(str(version)), "path", "length", F.unix_micros("modificationTime").cast("string"))
    row = files.agg(F.count("*").alias("n"), F.sum(one).alias("s")).first()
    return hashlib.sha256(f"{version}|{row['n']}|{row['s']}".encode()).hexdigest()


def artifact_path(root: str, name: str, salt: str) -> str:
    """S12."""
    return posixpath.join(root, f"{name}-{hashlib.sha256(name.encode()).hexdigest()[:16]}", hashlib.sha256(f"{VERSION}|{salt}".encode()).hexdigest()[:32])


def read_artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """The table if it was written to its end."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "_SUCCESS"))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def cached(spark: SparkSession, name: str, salt: str, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """The artifact of this name and salt; it is built if it is missing, and built live if the folder fails."""
    path = artifact_path(root or cache_root(spark), name, salt)
    try:
        if (known := read_artifact(spark, path)) is not None:
            return known
        build().write.mode("overwrite").parquet(path)
        return read_artifact(spark, path)
    except OSError as e:
        LOG.warning("artifact %s isn't kept: %s", name, e)
        return build()


def arguments_key(arguments: dict) -> str:
    """A digest of what a result depends on."""
    return hashlib.sha256(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()


def warm(spark: SparkSession, salt: str, builders: dict[str, Callable[[], DataFrame]], root: str | None = None) -> dict[str, int]:
    """Build all artifacts; how many rows each has."""
    return {name: cached(spark, name, salt, b, root).count() for name, b in builders.items()}


def require(spark: SparkSession, root: str, names: list[str]) -> None:
    """Fail with the list of tables that are missing."""
    missing = [n for n in names if read_artifact(spark, posixpath.join(root, n)) is None]
    if missing:
        raise RuntimeError("missing tables: " + ", ".join(missing))


def write_chains(chains: DataFrame, path: str, split: bool = True) -> None:
    """A folder of JSON for each language and chain, or one for all."""
    (chains.write.partitionBy("language", "chain_index") if split else chains.write).mode("overwrite").json(path)


def write_missing(ranked: DataFrame, path: str) -> None:
    """S21."""
    ranked.write.mode("overwrite").json(path)


def register_blocks(blocks: DataFrame) -> DataFrame:
    """Code blocks (file, start_line, end_line, text) once each, with an id that depends on the place only."""
    return blocks.dropDuplicates(["file", "start_line", "end_line"]).withColumn("block_id", F.sha2(F.concat_ws("|", "file", "start_line", "end_line"), 256))


@contextlib.contextmanager
def phase(spark: SparkSession, name: str):
    """Names the jobs of a phase and logs its time."""
    began = time.time()
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
        LOG.info("%s took %.1f s", name, time.time() - began)
