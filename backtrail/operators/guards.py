"""Guards of call sites and setters: disjunctions, finalising, deduplication, infeasible routes and not-set conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backtrail.functions import scalars as X
from backtrail.operators import graph, projections, sequence


def or_of_sites(sites: DataFrame) -> DataFrame:
    """A2, A3: sites (hop, site, line, guard, pos), guard null at an unguarded one, to (hop, bound, guard): each site's
    guards joined by &&, in parentheses if several; sites joined by ||; no guard if any site has none. A single site's
    guards stay as they are. bound is the last line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("guard").isNotNull(), F.struct("pos", "guard")))), lambda s: s["guard"]), " && ")
    each = sites.groupBy("hop", "site", "line").agg(F.count("guard").alias("n"), text.alias("text"))
    shown = F.when(F.col("n") > 1, F.concat(F.lit("("), F.col("text"), F.lit(")"))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("line", "site", shown.alias("shown"))))
    hops = each.groupBy("hop").agg(
        F.max("line").alias("bound"), F.max(F.col("n") == 0).alias("open"), F.count("*").alias("sites"), F.max("text").alias("only"), F.array_join(F.transform(parts, lambda s: s["shown"]), " || ").alias("all")
    )
    guard = F.when(F.col("open"), F.lit(None)).when(F.col("sites") == 1, F.col("only")).otherwise(F.col("all"))
    return hops.select("hop", "bound", guard.alias("guard"))


def finalise(guards: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Guards (key..., pos, text) without empty and repeated texts, and without those that are a whole conjunct of some
    compound of the same key; renumbered as seq."""
    kept = sequence.first_of(guards.where("text is not null and trim(text) <> ''"), [*key, "text"], ["pos"])
    compound = kept.where(F.col("text").contains("&&")).select(*key, F.explode(X.conjuncts(F.col("text"))).alias("normal")).distinct()
    simple = kept.where(~F.col("text").contains("&&")).withColumn("normal", X.normal_conjunct(F.col("text"))).join(compound, [*key, "normal"], "left_anti").drop("normal")
    rest = simple.unionByName(kept.where(F.col("text").contains("&&")).select(simple.columns))
    return sequence.renumber(rest, list(key), ["pos"])


def constants_of(guards: DataFrame, key: tuple[str, ...], cpp: DataFrame, asm: DataFrame) -> DataFrame:
    """(key..., seq, constants) the constants that each guard (key..., seq, text) names, as a map; guards without
    any have no row."""
    from backtrail.operators import constants

    texts = guards.select(F.struct(*key, "seq").alias("id"), "text")
    found = constants.resolve_tokens(texts, cpp, asm).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("constants"))
    return found.select("id.*", "constants")


def richest(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A1: rows (key..., seq, chain, hops, qualified, columns...): the first row of each key, with the richest chain."""
    rank = F.struct("hops", "qualified", -F.col("seq"))
    return rows.groupBy(*key).agg(F.min("seq").alias("seq"), F.max_by("chain", rank).alias("chain"), *(F.min_by(c, "seq").alias(c) for c in columns))


def infeasible_routes(required: DataFrame, assigned: DataFrame) -> DataFrame:
    """Routes on which some required equality can't hold. required (route, pos, scrutinee, value): the first of each
    scrutinee counts. assigned (route, route_pos, site_pos, target, value, conditional, declaration): the last one counts
    that is unconditional, no declaration, and whose value is a scoped constant (F9). Values are equal if they, or their
    last parts, are."""
    need = required.groupBy("route", "scrutinee").agg(F.min_by("value", "pos").alias("need"))
    scoped = F.col("value").contains("::") & ~F.endswith("value", F.lit(")")) & ~F.col("value").contains(" ")
    last = assigned.where(~F.col("conditional") & ~F.col("declaration") & scoped).groupBy("route", F.col("target").alias("scrutinee")).agg(
        F.max_by("value", F.struct("route_pos", "site_pos")).alias("last")
    )
    bad = need.join(last, ["route", "scrutinee"]).where(F.col("need") != F.col("last")).where(X.constant_tail(F.col("need")) != X.constant_tail(F.col("last")))
    return bad.select("route").distinct()


def not_set(guards: DataFrame) -> DataFrame:
    """Guards (id, setter, line, pos, negated), one conjunct for each setter: its distinct negated guards joined by
    || in order; repeated conjuncts are left out. Setters without a line don't count."""
    literal = sequence.first_of(guards.where("line > 0"), ["id", "setter", "negated"], ["pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "negated")))
    conjunct = literal.groupBy("id", "setter").agg(F.min("line").alias("line"), F.array_join(F.transform(parts, lambda s: s["negated"]), " || ").alias("text"))
    return sequence.renumber(sequence.first_of(conjunct, ["id", "text"], ["setter"]), ["id"], ["setter"])


def not_set_status(setters: DataFrame) -> DataFrame:
    """Setters (id, setter, line, guards, truncated, raw, polarity) to (id, status). Without a setter that has a
    line: no_function. Else the first setter that is truncated or has no guard decides: incomplete or unconditional. Else
    tautology if one test stands under both polarities among setters with a single guard, else ok."""
    placed = setters.where("line > 0")
    stops = F.when(F.col("truncated"), "incomplete").when(F.col("guards") == 0, "unconditional")
    single = placed.where("guards = 1").groupBy("id", "raw").agg(F.countDistinct("polarity").alias("n")).groupBy("id").agg(F.max(F.col("n") > 1).alias("both"))
    first = placed.withColumn("stop", stops).groupBy("id").agg(F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("setter"))).alias("stop"))
    ids = setters.select("id").distinct().join(first.withColumn("placed", F.lit(True)), "id", "left").join(single, "id", "left")
    status = F.when(F.col("placed").isNull(), "no_function").when(F.col("stop").isNotNull(), F.col("stop")).when(F.coalesce("both", F.lit(False)), "tautology").otherwise("ok")
    return ids.select("id", status.alias("status"))


def entering_sites(pairs: DataFrame, calls: DataFrame, functions: DataFrame, owners: DataFrame) -> DataFrame:
    """(hop, line): the lines at which the caller of a pair (hop, stem, function, next_stem, next_type, next_function)
    enters the next file. calls (stem, fn, callee, line) are the caller's; where the caller has a function, only calls from
    exactly that one count.

    What a call enters: the next hop's function, if it has one (qualified by more or by fewer scopes); else some function
    (stem, fn) of a C++ file, qualified on either side; else, of an assembler file, a name that it owns (name, stem), or the
    file's own name, both in capitals. Where nothing is known of the next file, nothing is entered.
    """
    called = calls.where("callee <> ''").withColumnRenamed("fn", "caller")
    sites = pairs.join(called, "stem").where("coalesce(function, '') = '' or caller = function").select("hop", "line", "callee", "next_stem", "next_type", F.coalesce("next_function", F.lit("")).alias("next_function"))
    named = sites.where("next_function <> ''").withColumn("part", F.explode(X.suffixes(F.col("callee")))).where("part = next_function")
    file = sites.where("next_function = ''")
    own = functions.where("fn <> ''").select(F.col("stem").alias("next_stem"), "fn").distinct()
    cpp = file.where("next_type = 'cpp'")
    longer = cpp.withColumn("fn", F.explode(X.suffixes(F.col("callee")))).join(own, ["next_stem", "fn"], "left_semi")
    shorter = cpp.join(own.withColumn("callee", F.explode(X.suffixes(F.col("fn")))).select("next_stem", "callee").distinct(), ["next_stem", "callee"], "left_semi")
    asm = file.where("next_type = 'asm'").withColumn("upper", F.upper("callee"))
    owned = asm.join(owners.select(F.upper("name").alias("upper"), F.col("stem").alias("next_stem")).distinct(), ["upper", "next_stem"], "left_semi")
    itself = asm.where(F.col("upper") == F.upper(F.col("next_stem").cast("string")))
    parts = [df.select("hop", "line") for df in (named, longer, shorter, owned, itself)]
    return reduce(DataFrame.unionAll, parts).distinct()


def prefix_guards(hops: DataFrame, calls: DataFrame, functions: DataFrame, owners: DataFrame, site_guards: DataFrame, asm_sites: DataFrame | None = None,
                  asm_guards: DataFrame | None = None, triggers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(guards (chain, seq, pos, text, via, line, end_line), bounds (chain, stem, bound)) of descending the hops
    (chain, pos, stem, file_type, function) of a chain.

    A C++ caller: entering_sites() of calls; without any there is neither guard nor bound. A site without guards
    (site_guards: stem, line, seq, text) leaves the descent unguarded; one site gives its guards one by one, several one OR
    of them, at the first site; the bound is the last. An assembler caller: the first of its direct sites (asm_sites: stem,
    next_stem, pos, line), without any unguarded; each guard there (asm_guards: stem, line, seq, text, test, branch, args,
    note, block, branch_line) is written as a predicate and anchored at its compare (triggers: stem, inst, operand, line).
    """
    order = Window.partitionBy("chain").orderBy("pos")
    following = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    pairs = hops.select("chain", F.col("pos").alias("seq"), "stem", "file_type", "function", following("stem"), F.lead("file_type").over(order).alias("next_type"), following("function"))
    pairs = pairs.where("next_stem is not null").withColumns({"hop": F.struct("chain", "seq", "stem", "next_stem"), "via": F.concat(F.col("stem").cast("string"), F.lit("→"), F.col("next_stem").cast("string"))})
    cpp, asm = pairs.where("file_type = 'cpp'"), pairs.where("file_type <> 'cpp'")
    sites = entering_sites(cpp, calls, functions, owners).select("hop", "line", F.col("hop.stem").alias("stem"))
    guarded = sites.join(site_guards.where("trim(text) <> ''").select("stem", "line", F.col("seq").alias("pos"), F.col("text").alias("guard")), ["stem", "line"], "left")
    merged = or_of_sites(guarded.select("hop", F.col("line").alias("site"), "line", "guard", "pos"))
    count = guarded.groupBy("hop").agg(F.min("line").alias("first"), F.countDistinct("line").alias("sites"))
    merged = merged.join(count, "hop")
    several = merged.where("sites > 1 and guard is not null").select("hop", F.lit(1).cast("bigint").alias("pos"), F.col("guard").alias("text"), F.col("first").alias("line"))
    single = guarded.join(merged.where("sites = 1").select("hop"), "hop", "left_semi").where("guard is not null").select("hop", F.col("pos").cast("bigint").alias("pos"), F.col("guard").alias("text"), "line")
    via = pairs.select("hop", "via").distinct()
    out = several.unionAll(single).join(via, "hop").select("hop.chain", "hop.seq", "pos", "text", "via", "line", F.col("line").alias("end_line"))
    bounds = merged.select("hop.chain", "hop.stem", "bound")
    if asm_sites is not None:
        place = asm.join(asm_sites.withColumnRenamed("pos", "site_pos"), ["stem", "next_stem"]).groupBy("hop", "via", "stem").agg(F.min_by("line", "site_pos").alias("line"))
        bounds = bounds.unionAll(place.select("hop.chain", "hop.stem", F.col("line").alias("bound")))
        if asm_guards is not None:
            rows = place.join(asm_guards, ["stem", "line"]).withColumn("decision", F.coalesce("branch_line", "line")).withColumn("key", F.struct("hop", "seq"))
            texts = projections.hop_guards(rows.select(F.col("key").alias("hop"), "seq", "text", "test", "branch", "args", "note", "block")).select(F.col("hop").alias("key"), F.col("text").alias("shown"))
            anchored = rows.select("key", "via", "line", "decision", F.when(F.col("text").isNull(), F.element_at(F.split("test", r"\s+"), 1)).alias("inst"), F.try_element_at(X.operands(F.regexp_extract("test", r"^\S+\s+(.*)$", 1)), F.lit(1)).alias("operand"), "stem")
            if triggers is not None:
                points = anchored.select(F.col("key").alias("id"), F.col("stem").alias("block"), "inst", "operand", F.col("decision").alias("line"))
                found = sequence.compare_line(points, triggers.withColumnRenamed("stem", "block")).select(F.col("id").alias("key"), "compare_line")
                anchored = anchored.join(found, "key", "left").withColumn("compare_line", F.when(F.col("inst").isNotNull(), F.col("compare_line")))
            else:
                anchored = anchored.withColumn("compare_line", F.lit(None).cast("bigint"))
            asm_rows = texts.where("shown <> ''").join(anchored, "key").select(
                "key.hop.chain", "key.hop.seq", F.col("key.seq").cast("bigint").alias("pos"), F.col("shown").alias("text"), F.concat("via", F.lit("@"), F.col("line").cast("string")).alias("via"),
                F.coalesce("compare_line", "decision").alias("line"), F.col("decision").alias("end_line"),
            )
            out = out.unionAll(asm_rows)
    return out, bounds.groupBy("chain", "stem").agg(F.max("bound").alias("bound"))


def edge_guards(edges: DataFrame, guards: DataFrame, prefix: DataFrame, local: DataFrame) -> DataFrame:
    """J22, U-2: guards of each path (path, section, seq, text): the prefix's (0), those at its edges in order (1), the
    setter's own (2). A caller without guards adds none."""
    middle = edges.join(guards, ["stem", "fn", "line"]).select("path", F.lit(1).alias("section"), F.col("seq"), "text")
    own = lambda df, n: df.select("path", F.lit(n).alias("section"), "seq", "text")
    rows = own(prefix, 0).unionAll(middle).unionAll(own(local, 2))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("section", "seq", "text")))


def block_conditions(flow: DataFrame, edges: DataFrame, points: DataFrame, max_levels: int, file_edges: int = graph.FILE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(conditions (id, seq, file, block, depth, condition, polarity, test, branch, line, end_line), truncated (id,
    truncated)) of reaching points (id, file, block, line), by the blocks' instructions (file, block, line, inst, args, kind)
    and control flow (file, src, dst).

    First the pairs of test and branch in the point's own block before its line, which weren't taken; then those of blocks
    that dominate it, nearest first, then by block, if exactly one of their arms leads to the point. Pairs of one block keep
    their order. truncated: a dominating block lies deeper than max_levels.
    """
    flow = flow.withColumn("key", F.struct("file", "block"))
    found = sequence.trigger_pairs(flow.select(F.col("key").alias("block"), "line", "kind"))
    at = flow.select(F.col("key").alias("block"), "line", "inst", "args")
    pairs = found.join(at.select("block", F.col("line").alias("trigger_line"), F.col("inst").alias("test"), F.col("args").alias("test_args")), ["block", "trigger_line"])
    pairs = pairs.join(at.select("block", "line", F.col("inst").alias("branch"), F.col("args").alias("branch_args")), ["block", "line"]).select("block.file", "block.block", "trigger_line", "line", "test", "test_args", "branch", "branch_args")
    pairs = pairs.withColumn("target", X.branch_target(F.col("branch_args")))
    over = graph.keep(graph.ancestry(edges, points.select("file", F.col("block").alias("target")), file_edges), "ancestry")
    named = pairs.select("file", F.col("block").alias("node"), F.col("target").alias("branch")).distinct()
    gate = graph.gates(over, edges, named, max_levels).withColumnRenamed("branch", "arm")
    here = points.select("id", "file", "block", F.col("line").alias("before"))
    own = here.join(pairs, ["file", "block"]).where("before = 0 or line < before").select("id", F.lit(0).alias("depth"), "file", "block", "trigger_line", "line", "test", "test_args", "branch", "branch_args", F.lit(False).alias("taken"))
    other = here.withColumnRenamed("block", "at").join(gate, (here["file"] == gate["file"]) & (F.col("at") == gate["target"])).select("id", here["file"], gate["node"].alias("block"), "arm", "depth", "taken")
    other = other.join(pairs.withColumnRenamed("target", "arm"), ["file", "block", "arm"]).select("id", "depth", "file", "block", "trigger_line", "line", "test", "test_args", "branch", "branch_args", "taken")
    shaped = projections.pair_conditions(own.unionAll(other), "id", "depth")
    rows = shaped.select("id", "depth", "file", "block", "condition", "polarity", F.col("raw_test").alias("test"), F.col("raw_branch").alias("branch"), F.col("location.startLine").alias("line"), F.col("location.endLine").alias("end_line"))
    cut = over.where("dominates").where(F.col("depth") > max_levels).select("file", F.col("target").alias("block")).distinct().withColumn("truncated", F.lit(True))
    flags = points.select("id", "file", "block").join(cut, ["file", "block"], "left").select("id", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return sequence.renumber(rows, ["id"], ["depth", "block", "end_line"]), flags


def not_set_conditions(setters: DataFrame, conditions: DataFrame, truncated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions (group, seq, setter, line, text), status (group, status)) of a variable not being set in a
    module, from its setters (group, id, line) and what block_conditions() returns for these ids. Only where the status is
    ok there are conditions."""
    args = lambda c: X.operands(F.regexp_extract(c, r"^\S+\s+(.*)$", 1))
    inst = lambda c: F.upper(F.element_at(F.split(c, r"\s+"), 1))
    no_args = F.array().cast("array<string>")
    operands = F.when(F.rlike("test", F.lit(r"\s")), args("test")).otherwise(no_args)
    flipped = F.when(F.col("test").isNotNull() & F.col("polarity").isNotNull(), X.predicate(inst("test"), operands, inst("branch"), ~F.col("polarity")))
    each = setters.join(conditions.select("id", "seq", "condition", "polarity", "test", "branch"), "id").withColumn("negated", X.negate(F.trim("condition"), flipped))
    counted = setters.join(conditions.groupBy("id").agg(F.count("*").alias("guards"), F.min("test").alias("raw"), F.min("polarity").alias("polarity")), "id", "left").join(truncated, "id", "left")
    status = not_set_status(counted.select(F.col("group").alias("id"), F.col("id").alias("setter"), "line", F.coalesce("guards", F.lit(0)).alias("guards"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "raw", "polarity"))
    ok = status.where("status = 'ok'").select("id")
    texts = not_set(each.select(F.col("group").alias("id"), F.col("id").alias("setter"), "line", F.col("seq").alias("pos"), "negated").join(ok, "id", "left_semi"))
    return texts.withColumnRenamed("id", "group"), status.withColumnRenamed("id", "group")
