"""Readers of program files and artifacts; unreadable ones give no rows, and a reject table says why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.functions import scalars as X

BLUEPRINTS, SOURCES = ("*.cpp.json", "*.hpp.json"), ("*.hpp", "*.cpp", "*.mac", "*.asm")


def list_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = BLUEPRINTS + SOURCES) -> DataFrame:
    """(path, length, modificationTime) of a folder's own files that fit a pattern, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")


def stem_of(path) -> F.Column:
    """The file's name before its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def extension_of(path) -> F.Column:
    """Its extension, .gz left out."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:\.gz)?$", 1))


def read_texts(spark: SparkSession, folder: str, patterns: tuple[str, ...] = SOURCES) -> DataFrame:
    """(path, stem, ext, text) of whole files; gzip is unpacked, malformed bytes are replaced."""
    glob = "{" + ",".join((*patterns, *(f"{p}.gz" for p in patterns))) + "}"
    rows = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", stem_of(F.col("path")).alias("stem"), extension_of(F.col("path")).alias("ext"), "text")


ENUM_SCHEMA = "enum_values map<string, struct<enum_type: string, value: string>>, _corrupt string"


def enum_blueprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, key, value) of the enumerators in blueprints, bare and with their enum; null values are left out.
    Only that part of the documents is parsed."""
    raw = spark.read.schema(ENUM_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "{" + ",".join(BLUEPRINTS) + "}").json(folder)
    items = raw.select(F.col("_metadata.file_path").alias("path"), F.explode("enum_values").alias("name", "v")).where("v.value is not null")
    keys = F.filter(F.array("name", F.when(F.coalesce("v.enum_type", F.lit("")) != "", F.concat_ws("::", "v.enum_type", "name"))), lambda k: k.isNotNull())
    return items.select("path", F.explode(keys).alias("key"), F.col("v.value").alias("value"))


BLOCK = "id: string, start_line: int, end_line: int"
LISTED = f"blocks array<struct<{BLOCK}, flow: array<struct<line: int, inst: string, args: array<string>>>>>"
COLUMNAR = f"blocks array<struct<{BLOCK}, flow: struct<line: array<int>, inst: array<string>, args: array<array<string>>>>>"


def blueprint_flow(documents: DataFrame) -> DataFrame:
    """Documents (stem, json) to (stem, block, start_line, end_line, pos, line, inst, args), whether a block's flow
    is a list of instructions or one list for each of their parts."""
    block = lambda c: [F.col(f"{c}.id").alias("block"), F.col(f"{c}.start_line").alias("start_line"), F.col(f"{c}.end_line").alias("end_line")]
    columnar = F.get_json_object("json", "$.blocks[0].flow.line").isNotNull()
    listed = documents.where(~columnar).select("stem", F.explode(F.from_json("json", LISTED)["blocks"]).alias("b"))
    listed = listed.select("stem", *block("b"), F.posexplode("b.flow").alias("pos", "f"))
    parts = documents.where(columnar).select("stem", F.explode(F.from_json("json", COLUMNAR)["blocks"]).alias("b"))
    parts = parts.select("stem", *block("b"), F.posexplode(F.arrays_zip(F.col("b.flow.line").alias("line"), F.col("b.flow.inst").alias("inst"), F.col("b.flow.args").alias("args"))).alias("pos", "f"))
    own = lambda df: df.select("stem", "block", "start_line", "end_line", "pos", F.col("f.line").alias("line"), F.upper("f.inst").alias("inst"), F.col("f.args").alias("args"))
    return own(listed).unionByName(own(parts))


def rejects(documents: DataFrame) -> DataFrame:
    """(stem, reason) of documents (stem, json, error) that can't be used."""
    bad = F.col("error").isNotNull() | F.get_json_object("json", "$.blocks").isNull()
    return documents.where(bad).select("stem", X.error_text(F.coalesce("error", F.lit("")), F.lit("no blocks")).alias("reason"))


def normalise_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst) of graphs (json), whose nodes are strings or objects with id or name, and whose
    edges are objects or pairs."""
    v = documents.select(F.parse_json("json").alias("v"))
    node = v.select(F.explode(F.variant_get("v", "$.nodes", "array<variant>")).alias("x"))
    names = [F.try_variant_get("x", "$.id", "string"), F.try_variant_get("x", "$.name", "string"), F.try_variant_get("x", "$", "string")]
    edge = v.select(F.explode(F.variant_get("v", "$.edges", "array<variant>")).alias("x"))
    src = F.coalesce(F.try_variant_get("x", "$.source", "string"), F.try_variant_get("x", "$[0]", "string"))
    dst = F.coalesce(F.try_variant_get("x", "$.target", "string"), F.try_variant_get("x", "$[1]", "string"))
    return node.select(F.coalesce(*names).alias("id")).where("id is not null"), edge.select(src.alias("src"), dst.alias("dst")).where("src is not null and dst is not null")
