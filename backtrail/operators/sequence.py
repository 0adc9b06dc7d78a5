"""Operators over ordered rows: pairing, as-of and range lookups, runs, merges and first-position deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines of one stretch. Ordered operators work on stretches, so no task must hold a whole file however long it is.
STRETCH = 8192


def trigger_pairs(flow: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Flow (block, line, kind) to (block, trigger_line, line): a conditional branch C right behind a trigger T, once
    all but triggers, conditional and unconditional (U) branches are left out.

    The row before a stretch's first one is the last of the stretch before: only these last rows are ordered for a block.
    """
    rows = flow.where(F.col("kind").isin("T", "C", "U")).withColumn("stretch", F.floor(F.col("line") / stretch))
    ends = rows.groupBy("block", "stretch").agg(F.max(F.struct("line", "kind")).alias("end"))
    before = ends.select("block", "stretch", F.lag("end").over(Window.partitionBy("block").orderBy("stretch")).alias("before"))
    w = Window.partitionBy("block", "stretch").orderBy("line")
    paired = rows.withColumn("last", F.lag(F.struct("line", "kind")).over(w)).join(before, ["block", "stretch"], "left")
    last = F.coalesce("last", "before")
    return paired.where("kind = 'C'").where(last["kind"] == "T").select("block", last["line"].alias("trigger_line"), "line")


def owning_function(lines: DataFrame, starts: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Lines (stem, line, ...) with fn, the function (stem, fn, start_line) that starts nearest before or at the line.

    Starts and lines are sorted together once, by stretches, so no range join multiplies rows; what the stretches before
    end in is carried over.
    """
    at = F.floor(F.col("line") / stretch).alias("stretch")
    s = starts.select("stem", F.col("start_line").alias("line"), "fn", F.lit(0).alias("side"), *(F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in lines.columns if c not in ("stem", "line")))
    rows = s.unionByName(lines.withColumns({"fn": F.lit(None).cast("string"), "side": F.lit(1)})).withColumn("stretch", at)
    ends = rows.groupBy("stem", "stretch").agg(F.max(F.when(F.col("side") == 0, F.struct("line", "fn")))["fn"].alias("end"))
    before = Window.partitionBy("stem").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("stem", "stretch", F.last("end", True).over(before).alias("carried"))
    w = Window.partitionBy("stem", "stretch").orderBy("line", "side", "fn").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("fn", F.last("fn", True).over(w)).where("side = 1").join(carried, ["stem", "stretch"], "left")
    return found.withColumn("fn", F.coalesce("fn", "carried")).drop("side", "stretch", "carried")


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], name: str, stretch: int = STRETCH) -> DataFrame:
    """points (keys..., line, ...) with the line of the last of the marks (keys..., line) at or before it, as name; null
    where there is none. One pass over the union, by stretches, as in owning_function(): a key may have any number of rows."""
    rest = [c for c in points.columns if c not in keys and c != "line"]
    m = marks.select(*keys, "line", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest), F.lit(0).alias("side"))
    rows = m.unionAll(points.select(*keys, "line", *rest, F.lit(1).alias("side"))).withColumn("stretch", F.floor(F.col("line") / stretch))
    mark = F.when(F.col("side") == 0, F.col("line"))
    ends = rows.groupBy(*keys, "stretch").agg(F.max(mark).alias("end"))
    carried = ends.select(*keys, "stretch", F.max("end").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    w = Window.partitionBy(*keys, "stretch").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(name, F.max(mark).over(w)).where("side = 1").join(carried, [*keys, "stretch"], "left")
    return found.withColumn(name, F.coalesce(name, "carried")).select(*points.columns, name)


def compare_line(branches: DataFrame, triggers: DataFrame) -> DataFrame:
    """Branches (id, block, inst, operand, line) with the last trigger (block, inst, operand, line) of the same
    instruction and first operand at or before the line; a branch without an operand takes any; else the line itself.
    Instructions and operands are compared in capitals."""
    plain = lambda df: df.withColumns({"_i": F.upper("inst"), "_o": F.nullif(F.upper("operand"), F.lit(""))})
    b, t = plain(branches), plain(triggers)
    named = last_before(b.where("_o is not null"), t.where("_o is not null"), ["block", "_i", "_o"], "compare_line")
    any_ = last_before(b.where("_o is null"), t, ["block", "_i"], "compare_line")
    found = named.select(*branches.columns, "compare_line").unionByName(any_.select(*branches.columns, "compare_line"))
    return found.withColumn("compare_line", F.coalesce("compare_line", "line"))


def smallest_block(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Points (id, file, line) with the smallest of the blocks (file, block, pos, start_line, end_line) around the line;
    of equally small ones the first. Blocks without both lines (null or 0) are none.

    A block is cut into aligned ranges whose lengths are powers of two, at most two of each length. Of each such range only
    the smallest block is kept, so a point looks up one row for each length that occurs, however many blocks lie around it.
    """
    b = blocks.where("start_line <> 0 and end_line <> 0 and start_line <= end_line").withColumns({"s": F.col("start_line").cast("bigint"), "e": F.col("end_line").cast("bigint") + 1})
    # whole ranges of length 2^l inside: from ceil(s / 2^l) to floor(e / 2^l) - 1; those whose pair isn't inside are taken
    ends = F.expr("transform(sequence(0, 31), l -> named_struct('l', l, 'a', -shiftright(-s, l), 'b', shiftright(e, l)))")
    ranges = F.expr("flatten(transform(ends, r -> filter(array_distinct(array(if(pmod(r.a, 2) = 1, named_struct('l', r.l, 'at', r.a), null), if(pmod(r.b, 2) = 1, named_struct('l', r.l, 'at', r.b - 1), null))), x -> x is not null and r.a < r.b)))")
    spans = b.withColumn("ends", ends).select("file", "block", F.struct((F.col("e") - F.col("s")).alias("span"), F.col("pos")).alias("by"), F.explode(ranges).alias("r"))
    best = spans.groupBy("file", F.col("r.l").alias("l"), F.col("r.at").alias("at")).agg(F.min_by(F.struct("by", "block"), F.col("by")).alias("own"))
    lengths = spans.agg(F.array_sort(F.collect_set("r.l")).alias("lengths"))  # at most 32 numbers
    at = points.join(F.broadcast(lengths)).select("id", "file", F.explode(F.expr("transform(lengths, l -> named_struct('l', l, 'at', shiftright(cast(line as bigint), l)))")).alias("r"))
    near = at.select("id", "file", "r.l", "r.at").join(best, ["file", "l", "at"]).groupBy("id").agg(F.min_by("own.block", F.col("own.by")).alias("block"))
    return points.join(near, "id", "left")


def enumerate_runs(items: DataFrame) -> DataFrame:
    """Items (enum, pos, name, literal, number) with their value: the literal; else the last number plus the distance
    from it, counted from 0 at the start; null behind a literal that is no number."""
    w = Window.partitionBy("enum").orderBy("pos")
    run = items.withColumn("run", F.count("literal").over(w))  # each literal begins a run
    v = Window.partitionBy("enum", "run").orderBy("pos")
    offset = F.row_number().over(v) - 1
    base = F.when(F.col("run") == 0, F.lit(0)).otherwise(F.first("number").over(v))
    return run.withColumn("value", F.coalesce("literal", (base + offset).cast("string"))).drop("run")


def merge_chain(hops: DataFrame) -> DataFrame:
    """Hops (chain, pos, stem, label) without repeated labels; a bare stem goes if a qualified label of it exists,
    and the earliest of these takes the earlier of both places. Adds rank, the place in the result."""
    first = hops.groupBy("chain", "stem", "label").agg(F.min("pos").alias("pos")).withColumn("bare", F.col("label") == F.col("stem"))
    w = Window.partitionBy("chain", "stem")
    order = w.orderBy("bare", "pos")
    rows = first.withColumns({
        "qualified": F.max((~F.col("bare")).cast("int")).over(w), "bare_pos": F.min(F.when(F.col("bare"), F.col("pos"))).over(w), "nth": F.row_number().over(order),
    }).where("not bare or qualified = 0")
    place = F.when(~F.col("bare") & (F.col("nth") == 1), F.least("pos", "bare_pos")).otherwise(F.col("pos"))
    rows = rows.withColumn("pos", place)
    return rows.select("chain", "stem", "label", F.row_number().over(Window.partitionBy("chain").orderBy("pos")).alias("rank"))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def renumber(rows: DataFrame, key: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """1 to n in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def adjacent(hops: DataFrame) -> DataFrame:
    """Hops (chain, pos, label) as pairs with the next label."""
    w = Window.partitionBy("chain").orderBy("pos")
    return hops.withColumn("next", F.lead("label").over(w)).where("next is not null")
