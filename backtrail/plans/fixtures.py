"""Fixture views: program-like tables computed from the star schema by the same arithmetic in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Calls between files with numbers of more than six digits.
FAR_CALLS = [(0, 1234561, 11), (0, 1234562, 12), (1234561, 1234562, 13), (1234562, 12345678901, 14)]


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._n: int | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def n(self) -> int:
        """Number of suppliers; a count that Parquet's footers hold."""
        if self._n is None:
            self._n = self.table("supplier").count()
        return self._n

    def call(self) -> DataFrame:
        """(src, dst, line): calls between files."""
        dst = F.col("l_partkey") % self.n
        rows = self.table("lineitem").select(F.col("l_suppkey").alias("src"), dst.alias("dst"), F.col("l_orderkey"), (10 * F.col("l_linenumber") + F.col("l_orderkey") % 10).alias("line"))
        rows = rows.where((F.col("dst") - F.col("src")).between(1, 5) | ((F.col("dst") < F.col("src")) & (F.col("l_orderkey") % 97 == 0)))
        far = self.spark.createDataFrame(FAR_CALLS, "src bigint, dst bigint, line bigint")
        return rows.groupBy("src", "dst").agg(F.min("line").alias("line")).unionAll(far)

    def call_with_gaps(self) -> DataFrame:
        """call(), and rows that lack an end."""
        gaps = self.spark.createDataFrame([(None, 1, 1), (0, None, 1)], "src bigint, dst bigint, line bigint")
        return self.call().unionAll(gaps)

    def setter(self) -> DataFrame:
        """(stem, line, variable, value): assignments."""
        return self.table("orders").select((F.col("o_custkey") % self.n).alias("stem"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("variable"), F.col("o_orderstatus").alias("value"))

    def flow(self) -> DataFrame:
        """(block, line, kind): instructions: trigger, conditional, unconditional, other."""
        kind = F.when(F.col("event_type").isin("click", "view"), "T").when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "error", "U").otherwise("O")
        return self.table("events").select(F.col("user_id").alias("block"), F.col("event_id").alias("line"), kind.alias("kind"))

    def fn(self) -> DataFrame:
        """(stem, fn, start_line): functions."""
        return self.table("part").select((F.col("p_partkey") % self.n).alias("stem"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("fn"), (7 * F.col("p_partkey")).alias("start_line"))


SQL = """fx_n AS (SELECT count(*) AS n FROM supplier),
fx_call AS (
  SELECT l_suppkey AS src, l_partkey % n AS dst, min(10 * l_linenumber + l_orderkey % 10) AS line FROM lineitem, fx_n
  WHERE (l_partkey % n - l_suppkey) BETWEEN 1 AND 5 OR (l_partkey % n < l_suppkey AND l_orderkey % 97 = 0) GROUP BY 1, 2
  UNION ALL VALUES (0, 1234561, 11), (0, 1234562, 12), (1234561, 1234562, 13), (1234562, 12345678901, 14)),
fx_gaps AS (SELECT * FROM fx_call UNION ALL VALUES (NULL, 1, 1), (0, NULL, 1)),
fx_setter AS (SELECT o_custkey % n AS stem, o_orderkey AS line, o_orderpriority AS variable, o_orderstatus AS value FROM orders, fx_n),
fx_flow AS (SELECT user_id AS block, event_id AS line, CASE WHEN event_type IN ('click', 'view') THEN 'T' WHEN event_type = 'purchase' THEN 'C'
  WHEN event_type = 'error' THEN 'U' ELSE 'O' END AS kind FROM events),
fx_fn AS (SELECT p_partkey % n AS stem, p_name || '_' || p_partkey AS fn, 7 * p_partkey AS start_line FROM part, fx_n)"""
