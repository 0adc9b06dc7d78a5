"""Row shapes of results: locations, guards, summaries, labelled routes, evidence stems, and preferred row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.functions import scalars as X
from backtrail.operators import sequence


def location(file: Column, start: Column, end: Column | None = None) -> Column:
    """The end defaults to the start."""
    return F.struct(file.alias("file"), start.alias("startLine"), (F.coalesce(end, start) if end is not None else start).alias("endLine"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def pair_conditions(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs (keys..., file, block, trigger_line, line, test, test_args, branch, branch_args, taken) as guards. taken is null
    for a pair of the target's own block: there the branch wasn't taken."""
    taken = F.coalesce("taken", F.lit(False))
    raw = lambda inst, args: F.concat_ws(" ", inst, F.when(F.size(args) > 0, F.array_join(args, ", ")))
    return pairs.select(
        *keys, "file", "block", X.predicate(F.col("test"), F.col("test_args"), F.col("branch"), taken).alias("condition"), taken.alias("polarity"), raw("test", "test_args").alias("raw_test"), raw("branch", "branch_args").alias("raw_branch"),
        F.lit("asm_guard").alias("kind"), location(F.col("file"), F.col("trigger_line"), F.col("line")).alias("location"),
    )


def condition_summary(conditions: DataFrame) -> DataFrame:
    """The file's own name, no block; absent details stay null."""
    keep = [c for c in ("id", "order", "condition", "polarity", "raw_test", "raw_branch", "kind", "via") if c in conditions.columns]
    return conditions.select(*keep, base_name(F.col("location.file")).alias("file"), F.col("location.startLine").alias("line"))


def setter_summary(setters: DataFrame, *keys: str) -> DataFrame:
    """Setters (keys..., id, location, value, conditions array<struct<condition,...>>, is_not_set) with inlined guard texts."""
    texts = F.transform("conditions", lambda c: c["condition"])
    return setters.select(*keys, "id", base_name(F.col("location.file")).alias("file"), F.col("location.startLine").alias("line"), "value", texts.alias("guards"), "is_not_set")


def with_certainty(rows: DataFrame) -> DataFrame:
    """P5: unconditional only without guards and if nothing was cut short."""
    return rows.withColumn("unconditional", (F.size("conditions") == 0) & ~F.col("incomplete"))


def hop_guards(guards: DataFrame) -> DataFrame:
    """X11: guards of hops (hop, seq, text, test, branch, args, note, block): plain texts with white space collapsed; a test and
    a branch as a predicate, taken iff the branch names the hop's block; notes are left out."""
    taken = F.coalesce(X.branch_target(F.col("args")) == F.upper("block"), F.lit(False))
    operands = F.when(F.rlike(F.trim("test"), F.lit(r"\s")), X.operands(F.regexp_extract(F.trim("test"), r"^\S+\s+(.*)$", 1))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("text").isNotNull(), X.guard_text(F.col("text"))).otherwise(X.predicate(F.upper(F.element_at(F.split(F.trim("test"), r"\s+"), 1)), operands, F.upper("branch"), taken))
    known = F.col("text").isNotNull() | (F.col("test").isNotNull() & F.col("branch").isNotNull())
    return guards.where(F.coalesce("note", F.lit("")) == "").where(known).select("hop", "seq", text.alias("text"))


def reader_stems(dependencies: DataFrame, setters: DataFrame | None = None) -> DataFrame:
    """(variable, stem) of the files where a variable is found (variable, file); of its setters too, if given."""
    rows = dependencies.select("variable", "file") if setters is None else dependencies.select("variable", "file").unionAll(setters.select("variable", "file"))
    return rows.select("variable", F.lower(F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)).alias("stem")).distinct()


def label_routes(routes: DataFrame, inner: DataFrame) -> DataFrame:
    """Routes (route, pos, stem) as text, where a file with known inner paths (stem, seq, size, path) shows its
    longest one, the first of equally long ones. Where both have the functions at which a file is entered and left (entry,
    leaving), only the paths between these count."""
    key = [c for c in ("stem", "entry", "leaving") if c in routes.columns and c in inner.columns]
    best = inner.groupBy(*key).agg(F.max_by("path", F.struct(F.col("size"), -F.col("seq"))).alias("inner"))
    hops = routes.join(best, key, "left").withColumn("label", F.coalesce("inner", "stem"))
    return hops.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda h: h["label"]), " > ").alias("route_text"))


def hinted(setters: DataFrame, hints: DataFrame) -> DataFrame:
    """Setters (fn, block, ...) whose function or block is what some hint (hint) names, qualified by more scopes or not."""
    wanted = hints.where("hint <> ''").select("hint").distinct()
    rows = setters.withColumn("_row", F.struct(*setters.columns))
    names = F.array_union(X.suffixes(F.coalesce("fn", F.lit(""))), X.suffixes(F.coalesce("block", F.lit(""))))
    hit = rows.select("_row", F.explode(names).alias("hint")).join(wanted, "hint", "left_semi").groupBy("_row").agg(F.lit(True).alias("hit"))
    kept = rows.join(hit, "_row", "left_semi")
    return kept.select(setters.columns)


def spans(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions (stem, fn) with first_line and last_line of their statements (stem, fn, line); 0 without any."""
    ends = lines.where("line > 0").groupBy("stem", "fn").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    return functions.select("stem", "fn").distinct().join(ends, ["stem", "fn"], "left").na.fill(0, ["first_line", "last_line"])


def first_rows(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key, and whether there are more (truncated). The cut is made before the shuffle
    where Spark can, and the count is pre-aggregated."""
    first = sequence.renumber(rows, key, order, "_n").where(F.col("_n") <= n).drop("_n")
    return first.join(rows.groupBy(*key).agg((F.count("*") > n).alias("truncated")), key)


def prefer(first: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """All rows of first, and those of other whose key first doesn't have."""
    return first.unionByName(other.join(first.select(*key).distinct(), key, "left_anti"))


def triage(setters: DataFrame, reachable: DataFrame, unverified: DataFrame) -> DataFrame:
    """setters (stem, ...) in reachable files (stem), or in unverified ones, which are flagged."""
    both = reachable.select("stem", F.lit(False).alias("via_unverified")).unionAll(unverified.select("stem", F.lit(True).alias("via_unverified")))
    return setters.join(both.groupBy("stem").agg(F.min("via_unverified").alias("via_unverified")), "stem")
