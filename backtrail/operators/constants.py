"""The constant dictionary: enumerators and assembler definitions, merged so that the first writer wins, and lookups."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.functions import scalars as X
from backtrail.operators import sequence

#: Words, and the signs that open and close bodies.
_SIGNS = re.compile(r"\w+|[{};]|[^\w\s{};]+")
_LAST_NAME = re.compile(r"[A-Za-z_]\w*\Z")
SCOPES = ("enum", "struct", "class", "namespace")


def enumerators(text: str) -> Iterator[tuple[str | None, str | None, int, int, str, str | None]]:
    """(enum, parent scopes, number of the enum, place, name, literal) of each enumerator in a text without comments.

    One pass over words and braces, with a stack of open bodies. A keyword of SCOPES opens a scope at the next brace, unless
    a semicolon comes first; its name is the word right behind it (class or struct left out). Syntax isn't respected
    otherwise: what follows "template <class T>" counts as a scope. A body that is never closed reaches the text's end."""
    open_bodies: list[str | None] = []  # the scope that each open body adds to its parents
    pending: list | None = None  # [keyword, name, whether a name may still come]
    signs, number = _SIGNS.finditer(text), 0
    for m in signs:
        sign = m[0]
        if sign == "{":
            kind, name, _ = pending or ("", None, False)
            pending = None
            if kind != "enum":
                open_bodies.append(name)
                continue
            level, close = 1, len(text)
            for inner in signs:
                level += (inner[0] == "{") - (inner[0] == "}")
                if level == 0:
                    close = inner.start()
                    break
            scope = "::".join(x for x in open_bodies if x) or None
            for i, (own, literal) in enumerate(listed(text[m.end() : close])):
                yield name, scope, number, i, own, literal
            number += 1
        elif sign == "}":
            pending = None
            if open_bodies:
                open_bodies.pop()
        elif sign == ";":
            pending = None
        elif pending is None:
            pending = [sign, None, True] if sign in SCOPES else None
        elif pending[2] and sign not in ("class", "struct"):
            pending[1:] = [sign if sign.isidentifier() and sign[0].isascii() else None, False]


def listed(body: str) -> Iterator[tuple[str, str | None]]:
    """(name, literal) of the enumerators between the braces: what stands between commas, and the last name before any =."""
    for part in body.split(","):
        left, equals, right = part.partition("=")
        name = _LAST_NAME.search(left.rstrip())
        if name and not equals:
            yield name[0], None
        elif name and right.strip() and "}" not in right:
            yield name[0], right.strip()


def enum_items(files: DataFrame) -> DataFrame:
    """(path, enum, parent, number, pos, name, literal) of the enumerators of each file (path, text), comments stripped."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, *e) for p, t in zip(batch["path"], batch["text"], strict=True) for e in enumerators(t or "")]
            yield pd.DataFrame(rows, columns=["path", "enum", "parent", "number", "pos", "name", "literal"]).astype({"number": "int64", "pos": "int64"})

    schema = "path string, enum string, parent string, number bigint, pos bigint, name string, literal string"
    return files.select("path", X.strip_comments(F.col("text")).alias("text")).mapInPandas(run, schema)


def enumerator_keys(enum: Column, parent: Column, name: Column) -> Column:
    """The spellings of an enumerator: bare, in its enum, in its parent, in both."""
    join = lambda *c: F.when(F.greatest(*(x.isNull().cast("int") for x in c)) == 0, F.concat_ws("::", *c))
    return F.filter(F.array(name, join(enum, name), join(parent, name), join(parent, enum, name)), lambda x: x.isNotNull())


def enum_pairs(files: DataFrame) -> DataFrame:
    """(path, seq, key, value) of all enumerators whose value is known."""
    items = enum_items(files).withColumnRenamed("enum", "own").withColumns({"enum": F.concat_ws("#", "path", "number"), "nth": F.col("number")})
    runs = sequence.enumerate_runs(items.withColumn("number", X.integer_literal(F.col("literal"))))
    named = runs.where("value is not null").select("path", "nth", "pos", "value", F.posexplode(enumerator_keys(F.col("own"), F.col("parent"), F.col("name"))).alias("spelling", "key"))
    return named.select("path", F.struct("nth", "pos", "spelling").alias("seq"), "key", "value")


def merge_first(pairs: DataFrame) -> DataFrame:
    """Pairs (rank, path, seq, key, value): of each key the value with the least rank, then path, then place."""
    order = F.struct("rank", "path", "seq")
    return pairs.groupBy("key").agg(F.min_by("value", order).alias("value"), F.min_by("path", order).alias("source_path"))


def look_up(names: DataFrame, cpp: DataFrame, asm: DataFrame) -> DataFrame:
    """Names (id, name) with their value: the C++ constant of that name, else of its last part, else the assembler
    constant of the name in capitals; null if none."""
    full = cpp.select(F.col("key").alias("name"), F.col("value").alias("v1"))
    tail = cpp.where(~F.col("key").contains("::")).select(F.col("key").alias("tail"), F.col("value").alias("v2"))
    upper = asm.select(F.upper("key").alias("upper"), F.col("value").alias("v3"))
    rows = names.withColumns({"tail": X.constant_tail(F.col("name")), "upper": F.upper("name")})
    rows = rows.join(full, "name", "left").join(tail, "tail", "left").join(upper, "upper", "left")
    return rows.withColumn("value", F.coalesce("v1", "v2", "v3")).drop("tail", "upper", "v1", "v2", "v3")


def resolve_tokens(texts: DataFrame, cpp: DataFrame, asm: DataFrame) -> DataFrame:
    """(id, pos, name, value) of the tokens of each text (id, text) that are constants, each at its first place."""
    found = texts.select("id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "name"))
    first = found.groupBy("id", "name").agg(F.min("pos").alias("pos"))
    return look_up(first, cpp, asm).where("value is not null")


def cpp_pairs(blueprints: DataFrame, sources: DataFrame) -> DataFrame:
    """(rank, path, seq, key, value): what C++ constants are called; blueprints (path, key, value) count before the
    enumerators of sources (path, text)."""
    first = F.struct(F.lit(0).cast("bigint").alias("nth"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("spelling"))
    known = blueprints.select(F.lit(0).alias("rank"), "path", first.alias("seq"), "key", "value")
    found = enum_pairs(sources).select(F.lit(1).alias("rank"), "path", "seq", "key", "value")
    return known.unionAll(found.select("rank", "path", F.struct(F.col("seq.nth").cast("bigint"), F.col("seq.pos").cast("bigint"), F.col("seq.spelling")).alias("seq"), "key", "value"))


def asm_pairs(sources: DataFrame) -> DataFrame:
    """(rank, path, seq, key, value): the definitions of assembler sources (path, text), names in capitals."""
    found = sources.select("path", F.posexplode(X.definitions(F.col("text"))).alias("seq", "d"))
    return found.select(F.lit(0).alias("rank"), "path", "seq", F.upper("d.name").alias("key"), F.col("d.value").alias("value"))


@dataclass(frozen=True)
class Dictionary:
    """Both tables of constants (key, value, source_path)."""

    cpp: DataFrame
    asm: DataFrame

    def bare_names(self) -> DataFrame:
        """(name) C++ constants without a scope."""
        return self.cpp.where(~F.col("key").contains("::")).select(F.col("key").alias("name"))

    def resolve(self, names: DataFrame) -> DataFrame:
        """Names (id, name) with their value."""
        return look_up(names, self.cpp, self.asm)


def dictionary(blueprints: DataFrame, sources: DataFrame) -> Dictionary:
    """The constants of blueprints (path, key, value) and source texts (path, ext, text); the first writer of a name
    wins: blueprints before sources, then by path, then in the text's order."""
    cpp = sources.where(F.col("ext").isin("hpp", "cpp"))
    return Dictionary(merge_first(cpp_pairs(blueprints, cpp)), merge_first(asm_pairs(sources.where(F.col("ext").isin("mac", "asm")))))


def get_dictionary(spark: SparkSession, blueprint_dir: str, source_dir: str, root: str | None = None) -> Dictionary:
    """The dictionary of two folders, built once for each state of their files and kept as tables."""
    from backtrail.sources import cache, files

    listing = files.list_files(spark, blueprint_dir, files.BLUEPRINTS).unionAll(files.list_files(spark, source_dir, files.SOURCES))
    salt = cache.fingerprint(listing)
    built: list[Dictionary] = []

    def part(which: str) -> DataFrame:
        if not built:
            built.append(dictionary(files.enum_blueprints(spark, blueprint_dir), files.read_texts(spark, source_dir)))
        return getattr(built[0], which)

    name = f"constants-{posixpath.basename(source_dir.rstrip('/'))}"
    keep_ = lambda which: cache.cached(spark, f"{name}-{which}", f"{blueprint_dir}|{source_dir}|{salt}", lambda: part(which), root)
    return Dictionary(keep_("cpp"), keep_("asm"))
