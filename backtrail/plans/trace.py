"""Tracing variables back to where their values come from: one plan for all chains at once.

Inputs are tables. Setters are searched by name, kept where the chain's tail can reach them, given every call path to them
within the bounds and the guards on these; paths that their own guards rule out are dropped, equal results are merged, and
what the rest depends on is traced in turn, up to a depth. Whatever a bound cut short carries a flag, and is never called
unconditional.

A node of the call graph is a file, or a function of a file ("stem::function"); its file is what stands before the first
"::". Chains are told apart by a column, so all of them advance in one frontier and one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.functions import scalars as X
from backtrail.operators import constants, graph, guards, lineage, projections, sequence
from backtrail.sources import cache
from backtrail.sources.scratch import keep


@dataclass
class Inputs:
    calls: DataFrame  # (src, dst, line): calls between nodes
    setters: DataFrame  # (id, stem, line, variable, language, value, is_declaration): stem is the node that they stand in
    guards: DataFrame  # (stem, line, seq, text): what encloses a line of a file
    dependencies: DataFrame  # (setter, variable): variables that a setter's value or guards need
    aliases: DataFrame | None = None  # (name, alias)
    constants: DataFrame | None = None  # (key, value)
    file_calls: DataFrame | None = None  # (src, dst, line, verified): a coarser graph, asked where calls knows no path
    cut_guards: DataFrame | None = None  # (stem, line): lines whose guards a bound cut short
    not_set: DataFrame | None = None  # (id, stem, line, variable, language, seq, text): when a variable isn't set
    hops: DataFrame | None = None  # (chain, pos, stem, file_type, function): the chains above their tails
    prefix: DataFrame | None = None  # (chain, seq, pos, text, via): guards of descending them; see guards.prefix_guards()
    upstream: DataFrame | None = None  # (chain, stem, bound): files of the chain, and the line at which each is left


@dataclass
class Bounds:
    paths: int = 64
    path_edges: int = 16
    depth: int = 10
    each_site: bool = False  # a path for each line of a call; else a call is guarded if all its lines are, by one or the other


@dataclass
class Trace:
    """Tables of all chains; path is null where none is known, chain_text shows the chain's hops too."""

    setters: DataFrame  # (chain, variable, depth, id, stem, line, value, value_resolved, path, chain_text, guards, texts, truncated, unconditional, via_unverified, is_not_set)
    edges: DataFrame  # (chain, parent, child, file, line): parent depends on child
    terminals: DataFrame  # (chain, variable): traced, and depend on nothing
    truncated: DataFrame  # (chain, variable): beyond the greatest depth, not traced

    @property
    def reached_depth(self) -> bool:
        return not self.truncated.isEmpty()


ENTRY = ["chain", "variable", "id", "rank"]  # a setter of a variable on one path of a chain


def languages(index: DataFrame, name: str, requested: str | None = None) -> list[str]:
    """Languages in which the index (language, name) knows a name: assembler in capitals, C++ exactly or without
    regard to case."""
    if requested:
        if requested not in ("asm", "cpp"):
            raise ValueError(f"language must be asm or cpp, not {requested}")
        return [requested]
    known = index.where(((F.col("language") == "asm") & (F.upper("name") == name.upper())) | ((F.col("language") == "cpp") & (F.lower("name") == name.lower())))
    found = sorted(r["language"] for r in known.select("language").distinct().limit(2).collect())
    if not found:
        raise ValueError(f"no setter of {name} is known")
    return found


def file_of(node: Column) -> Column:
    """The file of a node; null for a null one."""
    return X.label_stem(node.cast("string"))


def targets(inputs: Inputs, names: DataFrame) -> DataFrame:
    """The names and their aliases, each with the name it stands for: (variable, name)."""
    own = names.select("variable", F.col("variable").alias("name"))
    if inputs.aliases is None:
        return own
    return own.unionAll(names.join(inputs.aliases.withColumnRenamed("name", "variable"), "variable").select("variable", F.col("alias").alias("name"))).distinct()


def all_setters(inputs: Inputs) -> DataFrame:
    """Setters, and those that stand for a variable not being set; the guards of the latter come with them."""
    rows = inputs.setters.select("id", "stem", "line", "variable", "language", "value", "is_declaration", F.lit(False).alias("is_not_set"))
    if inputs.not_set is None:
        return rows
    own = inputs.not_set.select("id", "stem", "line", "variable", "language").distinct()
    return rows.unionAll(own.select("id", "stem", "line", "variable", "language", F.lit("[not set]").alias("value"), F.lit(False).alias("is_declaration"), F.lit(True).alias("is_not_set")))


def places(inputs: Inputs, tails: DataFrame) -> DataFrame:
    """(chain, stem, level): nodes that a tail (chain, node) reaches: over the calls (0), else over
    verified calls between files (1), else only over unverified ones (2)."""
    edges = [inputs.calls.select("src", "dst")]
    if inputs.file_calls is not None:
        edges += [inputs.file_calls.where("verified").select("src", "dst"), inputs.file_calls.select("src", "dst")]
    found = [graph.reach(tails, e, ["chain"]).select("chain", F.col("node").alias("stem"), F.lit(i).alias("level")) for i, e in enumerate(edges)]
    return keep(reduce(lambda a, b: projections.prefer(a, b, ["chain", "stem"]), found), "places")


def names_traced(inputs: Inputs, setters: DataFrame, known: DataFrame, variables: DataFrame, depth: int) -> DataFrame:
    """(variable): the variables (variable) and all that their setters in known places (stem) may depend on."""
    here = setters.where("not is_not_set").join(known.select("stem").distinct(), "stem", "left_semi").select("id", F.col("variable").alias("name"))
    if inputs.aliases is not None:  # a setter of an alias is one of the name
        here = here.unionAll(here.join(inputs.aliases.select(F.col("name").alias("own"), F.col("alias").alias("name")), "name").select("id", F.col("own").alias("name")))
    edges = here.join(inputs.dependencies.select(F.col("setter").alias("id"), F.col("variable").alias("dst")), "id").select(F.col("name").alias("src"), "dst")
    return graph.reach(variables.select(F.col("variable").alias("node")), edges, max_depth=depth).select(F.col("node").alias("variable"))


def call_paths(edges: DataFrame, tails: DataFrame, ends: DataFrame, bounds: Bounds) -> DataFrame:
    """(chain, stem, rank, nodes, sites, truncated): the paths from a chain's tail to its ends (chain, stem).

    Only nodes from which an end can be reached are walked through. Of several lines of one call each gives a path if
    bounds.each_site. truncated also says that paths longer than the bound may lead there; an end whose paths were all cut
    off has no row.
    """
    step = edges.select("src", "dst", "line").dropna(subset=["src", "dst"])
    step = step.select("src", "dst", F.col("line").cast("bigint").alias("site")).distinct() if bounds.each_site else step.select("src", "dst", F.lit(None).cast("bigint").alias("site")).distinct()
    step = keep(step, "steps")
    useful = keep(graph.backward(ends.select("chain", F.col("stem").alias("node")), step, ["chain"]).select("chain", "node"), "useful")
    tagged = step.join(useful.withColumnRenamed("node", "dst"), "dst").join(useful.withColumnRenamed("node", "src"), ["chain", "src"]).select(F.col("chain").alias("tag"), "src", "dst", "site")
    tagged = keep(tagged, "tagged")
    found = graph.paths_from(tagged, tails.select(F.col("chain").alias("tag"), "node"), bounds.path_edges, bounds.paths, 4 * bounds.paths)
    itself = tails.select(F.col("chain").alias("tag"), F.col("node").alias("dst"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("sites"), F.lit(False).alias("truncated"))
    paths = keep(itself.unionByName(found), "paths")
    # whatever lies behind a path of the greatest length, or behind a cut end, may be reached by more paths
    far = paths.where((F.size("sites") >= bounds.path_edges) | F.col("truncated")).select("tag", F.col("dst").alias("src")).distinct()
    seeds = tagged.join(far, ["tag", "src"], "left_semi").select("tag", F.col("dst").alias("node"))
    beyond = graph.reach(seeds, tagged, ["tag"]).select("tag", F.col("node").alias("dst"), F.lit(True).alias("beyond"))
    out = paths.join(beyond, ["tag", "dst"], "left").select(F.col("tag").alias("chain"), F.col("dst").alias("stem"), "nodes", "sites", (F.col("truncated") | F.coalesce("beyond", F.lit(False))).alias("truncated"))
    out = out.join(ends, ["chain", "stem"], "left_semi")
    return keep(sequence.renumber(out, ["chain", "stem"], ["nodes", "sites"], "rank"), "call_paths")


def path_guards(inputs: Inputs, edges: DataFrame, paths: DataFrame, bounds: Bounds) -> DataFrame:
    """(chain, stem, rank, seq, pos, text, via): the guards at the calls of each path, in order."""
    steps = paths.where(F.size("sites") > 0).select("chain", "stem", "rank", "nodes", F.posexplode("sites").alias("seq", "site"))
    steps = steps.select("chain", "stem", "rank", "seq", F.col("nodes")[F.col("seq")].alias("src"), F.col("nodes")[F.col("seq") + 1].alias("dst"), "site")
    known = inputs.guards.where("trim(text) <> ''").select(file_of(F.col("stem")).alias("file"), "line", F.col("seq").alias("pos"), F.col("text").alias("guard"))
    if bounds.each_site:
        hit = steps.withColumns({"file": file_of(F.col("src")), "line": F.col("site")}).join(known, ["file", "line"])
        texts = hit.select("chain", "stem", "rank", "seq", "src", "dst", "site", "pos", F.col("guard").alias("text"))
    else:
        lines = steps.select("src", "dst").distinct().join(edges.select("src", "dst", "line").distinct(), ["src", "dst"]).withColumn("file", file_of(F.col("src")))
        sites = lines.join(known, ["file", "line"], "left").select(F.struct("src", "dst").alias("hop"), F.col("line").alias("site"), "line", "guard", "pos")
        hops = guards.or_of_sites(sites).where("guard is not null").select("hop.src", "hop.dst", "guard", F.col("bound").alias("last"))
        shown = F.when(F.col("guard").contains("||"), F.concat(F.lit("("), "guard", F.lit(")"))).otherwise(F.col("guard"))
        texts = steps.join(hops, ["src", "dst"]).select("chain", "stem", "rank", "seq", "src", "dst", F.col("last").alias("site"), F.lit(0).alias("pos"), shown.alias("text"))
    across = file_of(F.col("src")) != file_of(F.col("dst"))
    function = lambda c: F.regexp_replace(F.col(c).cast("string"), "^.*?::", "")
    return texts.withColumn("via", X.via_text(file_of(F.col("src")), function("src"), file_of(F.col("dst")), function("dst"), F.col("site"), across)).drop("src", "dst", "site")


def infeasible(inputs: Inputs, tuples: DataFrame, final: DataFrame, paths: DataFrame) -> DataFrame:
    """The entries (ENTRY) on whose path a required value can't hold, as a function entered on it sets another one."""
    route = F.struct(*ENTRY).alias("route")
    need = final.withColumn("q", X.required_equality(F.col("text"))).where("q is not null").select(*ENTRY, F.col("seq").alias("pos"), "q.scrutinee", "q.value")
    need = keep(need, "required")
    asked = need.select(*ENTRY, "scrutinee").distinct().join(tuples.select(*ENTRY, "stem"), ENTRY).join(paths.select("chain", "stem", "rank", "nodes"), ["chain", "stem", "rank"])
    entered = asked.select(*ENTRY, "scrutinee", F.posexplode("nodes").alias("route_pos", "node")).where("route_pos > 0")
    by_name = entered.withColumn("name", F.explode(F.array_distinct(F.array("scrutinee", X.scrutinee_tail(F.col("scrutinee"))))))
    guarded = inputs.guards.where("trim(text) <> ''").select(file_of(F.col("stem")).alias("file"), "line").distinct().withColumn("conditional", F.lit(True))
    sets = inputs.setters.where("language = 'cpp'").select(F.col("stem").alias("node"), file_of(F.col("stem")).alias("file"), "line", F.col("variable").alias("name"), F.trim("value").alias("value"), F.col("is_declaration").alias("declaration"))
    sets = sets.join(guarded, ["file", "line"], "left").withColumn("conditional", F.coalesce("conditional", F.lit(False)))
    given = by_name.join(sets, ["node", "name"]).select(route, "route_pos", F.col("line").alias("site_pos"), F.col("scrutinee").alias("target"), "value", "conditional", "declaration")
    return guards.infeasible_routes(need.select(route, "pos", "scrutinee", "value"), given).select("route.*")


def chains_shown(inputs: Inputs, tuples: DataFrame, paths: DataFrame) -> DataFrame:
    """(chain, stem, rank, chain_text, stems, hops, qualified) of each path: the hops of the chain, then the path's."""
    label = F.col("node").cast("string")
    keys = tuples.select("chain", "stem", "rank").distinct()
    known = keys.join(paths.select("chain", "stem", "rank", "nodes"), ["chain", "stem", "rank"], "left")
    own = known.select("chain", "stem", "rank", F.posexplode(F.coalesce("nodes", F.array("stem"))).alias("pos", "node")).select("chain", "stem", "rank", F.lit(1).alias("part"), "pos", file_of(label).alias("file"), label.alias("label"))
    if inputs.hops is not None:
        above = inputs.hops.select("chain", F.lit(0).alias("part"), "pos", F.col("stem").cast("string").alias("file"), X.label(F.col("stem").cast("string"), F.col("file_type"), F.col("function")).alias("label"))
        own = keys.join(above, "chain").select(own.columns).unionAll(own)
    rows = own.select(F.struct("chain", "stem", "rank").alias("chain"), F.struct("part", "pos").alias("pos"), F.col("file").alias("stem"), "label")
    merged = sequence.merge_chain(rows).groupBy("chain").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("nth"), "stem", "label"))).alias("h"))
    texts = F.transform("h", lambda x: x["label"])
    return merged.select(
        "chain.*", F.array_join(texts, " > ").alias("chain_text"), F.array_distinct(F.transform("h", lambda x: x["stem"])).alias("stems"), F.size("h").alias("hops"), F.size(F.filter(texts, lambda x: x.contains("::"))).alias("qualified")
    )


def entries(inputs: Inputs, setters: DataFrame, names: DataFrame, tails: DataFrame, known: DataFrame, bounds: Bounds) -> DataFrame:
    """The rows of Trace.setters, without depth, of all setters of names (variable) in known places (chain, stem, level)."""
    found = setters.withColumnRenamed("variable", "name").join(targets(inputs, names), "name")
    placed = found.join(known, "stem").withColumn("upstream", F.lit(False))
    if inputs.upstream is not None:  # W6: in the chain's own files, what stands before the descent
        before = inputs.upstream.select("chain", F.col("stem").alias("file"), "bound")
        above = found.withColumn("file", file_of(F.col("stem"))).join(before.withColumn("file", F.col("file").cast("string")), "file").where("line <= bound")
        above = above.join(known.select("chain", "stem"), ["chain", "stem"], "left_anti").withColumns({"level": F.lit(3), "upstream": F.lit(True)})
        placed = placed.unionByName(above.select(placed.columns))
    placed = keep(placed, "placed")

    edges, all_paths, all_guards = [inputs.calls.select("src", "dst", "line")], [], []
    if inputs.file_calls is not None:
        edges.append(inputs.file_calls.where("verified").select("src", "dst", "line"))
    for level, e in enumerate(edges):
        ends = placed.where(F.col("level") == level).select("chain", "stem").distinct()
        all_paths.append(call_paths(e, tails, ends, bounds))
        all_guards.append(path_guards(inputs, e, all_paths[-1], bounds))
    paths, along = reduce(DataFrame.unionByName, all_paths), reduce(DataFrame.unionByName, all_guards)

    tuples = placed.join(paths.select("chain", "stem", "rank", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"), "truncated"), ["chain", "stem"], "left")
    # a reachable place has no path only where a bound cut them off; unverified and upstream ones have none to be cut
    tuples = tuples.withColumns({"rank": F.coalesce("rank", F.lit(0)), "truncated": F.coalesce("truncated", F.col("level") < 2)})
    if inputs.cut_guards is not None:
        cut = inputs.cut_guards.select(file_of(F.col("stem")).alias("file"), "line").distinct().withColumn("cut", F.lit(True))
        tuples = tuples.withColumn("file", file_of(F.col("stem"))).join(cut, ["file", "line"], "left").withColumn("truncated", F.col("truncated") | F.coalesce("cut", F.lit(False))).drop("file", "cut")
    tuples = keep(tuples, "tuples")

    local = inputs.guards.where("trim(text) <> ''").select(file_of(F.col("stem")).alias("file"), "line", "seq", "text")
    own = tuples.where("not is_not_set").withColumn("file", file_of(F.col("stem"))).join(local, ["file", "line"]).select(*ENTRY, F.col("seq").cast("bigint").alias("seq"), "text")
    if inputs.not_set is not None:
        own = own.unionAll(tuples.where("is_not_set").join(inputs.not_set.select("id", "seq", "text"), "id").select(*ENTRY, F.col("seq").cast("bigint").alias("seq"), "text"))
    none = F.lit(None).cast("string").alias("via")
    at = lambda section, *by: F.struct(F.lit(section).alias("section"), *(F.col(b).cast("bigint").alias(n) for b, n in zip(by, ("seq", "pos"), strict=True))).alias("pos")
    raw = own.withColumn("zero", F.lit(0)).select(*ENTRY, at(2, "seq", "zero"), "text", none)
    raw = raw.unionAll(tuples.select(*ENTRY, "stem").join(along, ["chain", "stem", "rank"]).select(*ENTRY, at(1, "seq", "pos"), "text", "via"))
    if inputs.prefix is not None:
        raw = raw.unionAll(tuples.where("not upstream").select(*ENTRY).join(inputs.prefix, "chain").select(*ENTRY, at(0, "seq", "pos"), "text", "via"))
    raw = keep(raw, "raw_guards")
    final = keep(guards.finalise(raw.drop("via"), tuple(ENTRY)), "guards")

    left = tuples.join(infeasible(inputs, tuples, final, paths), ENTRY, "left_anti")
    by_place = F.array_sort(F.collect_list(F.struct("seq", "text")))
    texts = final.groupBy(*ENTRY).agg(F.transform(by_place, lambda g: g["text"]).alias("texts"))
    vias = raw.where("via is not null").groupBy(*ENTRY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "via"))), lambda g: g["via"]).alias("vias"))
    empty = F.array().cast("array<string>")
    left = left.join(texts, ENTRY, "left").join(vias, ENTRY, "left").withColumns({"texts": F.coalesce("texts", empty), "vias": F.coalesce("vias", empty)})
    left = left.join(chains_shown(inputs, tuples, paths), ["chain", "stem", "rank"])

    # A1: one row for each setter's place, files of the chain, guards and calls; the first one's, with the richest chain
    left = left.withColumns({"sorted": F.array_sort("texts"), "seq": F.struct("id", "rank"), "via_unverified": F.col("level") == 2})
    key = ["chain", "variable", "stem", "line", "stems", "sorted", "vias", "is_not_set"]
    rank = F.struct("hops", "qualified")
    best = left.groupBy(*key).agg(F.max(rank).alias("most"), F.min_by(F.struct("id", "rank", "value", "language", "path", "texts", "truncated", "via_unverified", "upstream"), "seq").alias("first"))
    rich = left.join(best.select(*key, "most"), key).where(rank == F.col("most")).groupBy(*key).agg(F.min_by("chain_text", "seq").alias("chain_text"))
    rows = best.join(rich, key).select("chain", "variable", "stem", "line", "is_not_set", "chain_text", "first.*")
    rows = _resolved(inputs, rows)
    rows = projections.with_certainty(rows.withColumnsRenamed({"texts": "conditions", "truncated": "incomplete"})).withColumnsRenamed({"conditions": "texts", "incomplete": "truncated"})
    return keep(rows.withColumn("guards", F.when(F.size("texts") > 0, F.array_join("texts", " && "))), "entries")


def _resolved(inputs: Inputs, rows: DataFrame) -> DataFrame:
    """value_resolved: the constant that a value names."""
    if inputs.constants is None:
        return rows.withColumn("value_resolved", F.lit(None).cast("string"))
    values = rows.where("not is_not_set and value is not null").select(F.col("value").alias("name")).distinct()
    known = constants.look_up(values, inputs.constants, inputs.constants).where("value is not null").select(F.col("name").alias("value"), F.col("value").alias("value_resolved"))
    return rows.join(known, "value", "left").withColumn("value_resolved", F.when(~F.col("is_not_set"), F.col("value_resolved")))


def trace_chains(inputs: Inputs, variable: str, tails: DataFrame, bounds: Bounds | None = None) -> Trace:
    """The variable's setters, those of what they depend on, and so on, for each chain by its tail (chain, node)."""
    bounds = bounds or Bounds()
    spark = inputs.calls.sparkSession
    tails = keep(tails.select("chain", "node").dropna().distinct(), "tails")
    setters = all_setters(inputs)
    known = places(inputs, tails)
    root = spark.range(1).select(F.lit(variable).alias("variable"))
    reached = known.select("stem")
    if inputs.upstream is not None:
        above = setters.select("stem").distinct().withColumn("file", file_of(F.col("stem"))).join(inputs.upstream.select(F.col("stem").cast("string").alias("file")).distinct(), "file", "left_semi")
        reached = reached.unionAll(above.select("stem"))
    names = keep(names_traced(inputs, setters, reached, root, bounds.depth), "names")
    rows = entries(inputs, setters, names, tails, known, bounds)

    # which of these the chain's variable depends on, now that rows are known that no path leads to; the chain's own files
    # count for what it depends on, not for itself
    needs = rows.where("not is_not_set").select("chain", F.col("variable").alias("src"), "upstream", "stem", "line", F.col("id").alias("setter")).join(inputs.dependencies.withColumnRenamed("variable", "dst"), "setter")
    needs = keep(needs.where(~F.col("upstream") | (F.col("src") != variable)), "needs")
    depth = graph.reach(tails.select("chain", F.lit(variable).alias("node")).distinct(), needs, ["chain"], bounds.depth + 1)
    depth = keep(depth.withColumnRenamed("node", "variable"), "depths")
    traced = depth.where(F.col("depth") <= bounds.depth)
    rows = rows.join(traced, ["chain", "variable"]).where(~F.col("upstream") | (F.col("depth") > 0))
    edges = needs.withColumnRenamed("src", "parent").join(traced.select("chain", F.col("variable").alias("parent")), ["chain", "parent"], "left_semi")
    edges = edges.select("chain", "parent", F.col("dst").alias("child"), F.col("stem").alias("file"), "line").distinct()
    ends = traced.select("chain", "variable").join(edges.select("chain", F.col("parent").alias("variable")).distinct(), ["chain", "variable"], "left_anti")
    columns = ["chain", "variable", "depth", "id", "stem", "line", "value", "value_resolved", "path", "chain_text", "guards", "texts", "truncated", "unconditional", "via_unverified", "is_not_set"]
    return Trace(rows.select(columns), edges, ends, depth.where(F.col("depth") > bounds.depth).select("chain", "variable"))


def cached_trace(spark, salt: str, build: Callable[[], Inputs], variable: str, tails: list, bounds: Bounds | None = None, root: str | None = None) -> Trace:
    """trace_chains() from the tails, kept as tables under all that its result depends on: the state of the inputs (salt,
    such as cache.fingerprint()), the variable, the tails and the bounds. build is called only if nothing is kept."""
    bounds = bounds or Bounds()
    key = cache.arguments_key({"salt": salt, "variable": variable, "tails": tails, "bounds": asdict(bounds)})
    made: list[Trace] = []

    def part(name: str) -> DataFrame:
        if not made:
            inputs = build()
            kind = inputs.calls.schema["src"].dataType.simpleString()
            made.append(trace_chains(inputs, variable, spark.createDataFrame(list(enumerate(tails)), f"chain int, node {kind}"), bounds))
        return getattr(made[0], name)

    return Trace(*(cache.cached(spark, f"trace-{f.name}", key, lambda name=f.name: part(name), root) for f in fields(Trace)))


def trace(inputs: Inputs, variable: str, tail: int | str, bounds: Bounds | None = None) -> Trace:
    """trace_chains() of one chain, whose tail is given; its number is 0."""
    kind = inputs.calls.schema["src"].dataType
    return trace_chains(inputs, variable, inputs.calls.sparkSession.range(1).select(F.lit(0).alias("chain"), F.lit(tail).cast(kind).alias("node")), bounds)


def lineage_graph(found: Trace, variable: str, attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (chain, name, role, terminal, truncated, setters, first_depth), edges). The root comes first and
    is never terminal; nodes beyond the greatest depth are truncated. attributes (name, ...) are added to nodes."""
    counts = found.setters.groupBy("chain", "variable").agg(F.count("*").alias("setters"), F.min("depth").alias("first_depth"))
    every = found.terminals.select("chain", "variable", F.lit(True).alias("terminal"), F.lit(False).alias("truncated"))
    every = every.unionAll(found.edges.select("chain", F.col("parent").alias("variable"), F.lit(False), F.lit(False)).distinct())
    every = every.unionAll(found.truncated.select("chain", "variable", F.lit(False), F.lit(True)))
    merged = every.groupBy("chain", "variable").agg(F.min("terminal").alias("terminal"), F.max("truncated").alias("truncated")).join(counts, ["chain", "variable"], "left")
    is_root = F.col("variable") == variable
    nodes = merged.select(
        "chain", F.col("variable").alias("name"), F.when(is_root, "root").otherwise("dependent").alias("role"), (F.col("terminal") & ~is_root).alias("terminal"), "truncated", F.coalesce("setters", F.lit(0)).alias("setters"), "first_depth"
    )
    if attributes is not None:
        nodes = nodes.join(attributes, "name", "left")
    return nodes, found.edges
