"""The lineage graph: audit of the inputs, aliases, folding of results, classes of terminals, pruning and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.functions import scalars as X

# Markers and prefixes that tell where data come from; each is a parameter.
DB_READ_MARKERS = ("FINWC", "FIWHC", "FINDC", "FINHC", "FILEC", "FILNC", "FILUC", "GETFC")
USER_INPUT_MARKERS = ("AM0SG", "MI0MI", "IMSG")
INPUT_MSG_PREFIXES = ("MI0", "AM0")
WORKING_STORAGE_PREFIXES = ("EBW", "EBX", "EBC", "CE1", "WK_")
#: What keeps an ancestor without setters in the graph.
KEEP_FLAGS = ("keep",)
STEM = "^[a-z0-9_]+$"


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(stem) ends of edges (src, dst), in lower case and of a stem's shape (F3), that are no nodes (id)."""
    ends = edges.select(F.lower("src").alias("stem")).unionAll(edges.select(F.lower("dst").alias("stem"))).where(F.rlike("stem", F.lit(STEM)))
    return ends.distinct().join(nodes.select(F.lower("id").alias("stem")), "stem", "left_anti")


def without_blueprint(nodes: DataFrame, blueprints: DataFrame) -> DataFrame:
    """(stem) nodes of a stem's shape that have no blueprint (stem)."""
    shaped = nodes.select(F.lower("id").alias("stem")).where(F.rlike("stem", F.lit(STEM))).distinct()
    return shaped.join(blueprints.select("stem"), "stem", "left_anti")


def orphan_names(owners: DataFrame, blueprints: DataFrame) -> DataFrame:
    """(name) names (name, stem) with owners of which none has a blueprint."""
    owned = owners.where("stem is not null")
    with_one = owned.join(blueprints.select("stem"), "stem", "left_semi").select("name")
    return owned.select("name").distinct().join(with_one, "name", "left_anti")


def attribution(edges: DataFrame, blueprints: DataFrame, missing: DataFrame) -> DataFrame:
    """(stem, callee) edges from a stem with a blueprint to a missing one."""
    b, m = blueprints.select(F.col("stem").alias("src")), missing.select(F.col("stem").alias("dst"))
    return edges.join(b, "src", "left_semi").join(m, "dst", "left_semi").select(F.col("src").alias("stem"), F.col("dst").alias("callee")).distinct()


def rewrite_aliases(missing: DataFrame, aliases: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Missing names by the module that they are linked to: aliases (fn, entry, source, kind, pos), the last
    write in this order wins; a name whose module has a blueprint goes; without an alias it stays. (stem, called_as)."""
    last = aliases.groupBy("fn").agg(F.max_by("entry", F.struct("source", "kind", "pos")).alias("entry"))
    named = missing.join(last.withColumnRenamed("fn", "stem"), "stem", "left")
    out = named.select(F.coalesce("entry", "stem").alias("target"), F.when(F.col("entry").isNotNull(), F.col("stem")).alias("called_as"))
    gone = blueprints.select(F.col("stem").alias("target"))
    aliased, plain = out.where("called_as is not null").join(gone, "target", "left_anti"), out.where("called_as is null")
    return aliased.unionByName(plain).select(F.col("target").alias("stem"), "called_as").distinct()


def classify(nodes: DataFrame, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Nodes (name, external, asm_constant, cpp_constant, member, member_name, db_read, db_tokens, input_read) with
    their class; the first rule that fits counts. The three last say what is known of the stems that read the node."""
    markers = {"input": INPUT_MSG_PREFIXES, "storage": WORKING_STORAGE_PREFIXES} | (markers or {})
    begins = lambda c, prefixes: F.coalesce(F.rlike(F.upper(c), F.lit("^(" + "|".join(prefixes) + ")")), F.lit(False)) if prefixes else F.lit(False)
    kind = (
        F.when(F.col("external"), "external")
        .when(F.col("asm_constant") | F.col("cpp_constant"), "constant")
        .when(begins(F.col("name"), markers["input"]) | begins(F.col("member_name"), markers["input"]), "user_input")
        .when(begins(F.col("name"), markers["storage"]), "working_storage")
        .when(F.col("member") & (F.col("db_read") | F.col("db_tokens")), "database")
        .when(~F.col("member") & F.col("input_read"), "user_input")
        .when(F.col("member"), "record_field")
        .otherwise("unresolved")
    )
    return nodes.withColumn("class", kind)


def evidence(sources: DataFrame, db: tuple[str, ...] = DB_READ_MARKERS, user: tuple[str, ...] = USER_INPUT_MARKERS) -> DataFrame:
    """(stem, db_read, user_input, tokens) of sources (stem, ext, text); only assembler and macro sources count, and
    tokens are kept for stems that read a database."""
    text = F.col("text")
    rows = sources.where(F.col("ext").isin("asm", "mac")).select("stem", X.marker_hits(text, list(db)).alias("db_read"), X.marker_hits(text, list(user)).alias("user_input"), text)
    tokens = F.when(F.size("db_read") > 0, F.array_sort(F.array_distinct(X.upper_tokens(text)))).otherwise(F.array().cast("array<string>"))
    return rows.select("stem", "db_read", "user_input", tokens.alias("tokens"))


def stem_evidence(readers: DataFrame, homes: DataFrame, found: DataFrame) -> DataFrame:
    """(name, db_read, input_read, db_stems, input_stems) of the names that some stem tells something of: the stems that
    read them (name, stem) or are their home (name, stem), where evidence() found a marker."""
    stems = readers.select("name", "stem").unionAll(homes.select("name", "stem")).where("stem is not null").distinct()
    hit = stems.join(found.select("stem", (F.size("db_read") > 0).alias("db"), (F.size("user_input") > 0).alias("input")), "stem")
    return hit.groupBy("name").agg(
        F.max("db").alias("db_read"), F.max("input").alias("input_read"), F.array_sort(F.collect_set(F.when(F.col("db"), F.col("stem")))).alias("db_stems"), F.array_sort(F.collect_set(F.when(F.col("input"), F.col("stem")))).alias("input_stems")
    )


def token_evidence(sections: DataFrame, found: DataFrame) -> DataFrame:
    """(name, token_stem): the first stem that reads a database and names one of the sections (name, section) that a
    field belongs to, in capitals."""
    tokens = found.where(F.size("db_read") > 0).select("stem", F.explode("tokens").alias("section"))
    wanted = sections.where("section <> ''").select("name", F.upper("section").alias("section")).distinct()
    return wanted.join(tokens, "section").groupBy("name").agg(F.min("stem").alias("token_stem"))


def classify_nodes(nodes: DataFrame, readers: DataFrame, sections: DataFrame, found: DataFrame, cpp: DataFrame, asm: DataFrame, callees: DataFrame, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Nodes (name, external, member, member_name, home) with class, evidence and missing, the modules that
    are absent and that the files which read a name call: for external and unresolved names only, all of them, in order.

    readers (name, stem), sections (name, section), found: what evidence() returns, cpp and asm: constants (key), callees
    (stem, callee): calls into missing modules."""
    homes = nodes.select("name", F.lower("home").alias("stem"))
    rows = nodes.join(stem_evidence(readers, homes, found), "name", "left").join(token_evidence(sections, found), "name", "left")
    rows = rows.withColumn("upper", F.upper("name"))
    rows = rows.join(asm.select(F.upper("key").alias("upper"), F.lit(True).alias("asm_constant")).distinct(), "upper", "left").join(cpp.select(F.col("key").alias("name"), F.lit(True).alias("cpp_constant")).distinct(), "name", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.select("name", no("external"), no("asm_constant"), no("cpp_constant"), no("member"), "member_name", no("db_read"), F.col("token_stem").isNotNull().alias("db_tokens"), no("input_read"), "db_stems", "input_stems", "token_stem")
    judged = classify(rows, markers)
    absent = readers.select("name", "stem").join(callees.select("stem", "callee"), "stem").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("missing"))
    stems = F.when((F.col("class") == "database") & F.col("db_read"), F.array_join("db_stems", ",")).when(F.col("class") == "database", F.col("token_stem")).when((F.col("class") == "user_input") & F.col("input_read"), F.array_join("input_stems", ","))
    return judged.join(absent, "name", "left").select("name", "class", stems.alias("evidence"), F.when(F.col("class").isin("external", "unresolved"), F.col("missing")).alias("missing"))


def missing_references(classified: DataFrame) -> DataFrame:
    """A5: (name) a row for each terminal that may be defined in a missing module; classified holds names joined by commas."""
    return classified.where("missing is not null").select(F.explode(F.split("missing", ",")).alias("name"))


def unknown_functions(edges: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Edges (stem, fn, callee_stem, callee_fn) of the function graph whose target is neither a caller, nor in a file
    with callers, nor in one with a blueprint (stem); a row for each edge, repeated ones too."""
    callers = edges.select(F.col("stem").alias("callee_stem"), F.col("fn").alias("callee_fn")).distinct()
    stems = edges.select(F.lower("stem").alias("low")).unionAll(blueprints.select(F.lower("stem").alias("low"))).distinct()
    left = edges.join(callers, ["callee_stem", "callee_fn"], "left_anti")
    return left.withColumn("low", F.lower("callee_stem")).join(stems, "low", "left_anti").select("stem", "fn", "callee_stem", "callee_fn")


def fold_nodes(entries: DataFrame) -> DataFrame:
    """Entries (name, seq, qualified, terminal): a node for each name, with the first entry's attributes; it is
    terminal if all are."""
    return entries.groupBy("name").agg(F.min_by("qualified", "seq").alias("qualified"), F.min("terminal").alias("terminal"), F.count("*").alias("entries"))


def fold_edges(entries: DataFrame) -> DataFrame:
    """U-5: one edge for each (parent, child, file, line); parent depends on child."""
    return entries.select("parent", "child", "file", "line").distinct()


def terminal_counts(terminals: DataFrame) -> DataFrame:
    """A4: terminals (chain, class) counted for each class, and for each chain and class; chain is null in the former."""
    return terminals.groupingSets([["chain", "class"], ["class"]], "chain", "class").agg(F.count("*").alias("n"))


def missing_rank(references: DataFrame, k: int | None) -> DataFrame:
    """A5, O3: the k names (name, linkage) that most terminals point at, all if k is None, and what they may be."""
    counted = references.groupBy("name").agg(F.count("*").alias("n"), F.max("linkage").alias("linkage"))
    if k is not None:
        counted = counted.orderBy(F.desc("n"), "name").limit(k)
    return counted.select("name", "n", X.missing_kind(F.col("name"), F.col("linkage")).alias("kind"))


def removable_ancestors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path) of nodes (path, origin, terminal, setters, aliases, keep) that are linked synthetic ancestors without any
    content of their own; links (path, parent)."""
    linked = links.select("path").unionAll(links.select(F.col("parent").alias("path"))).distinct()
    bare = (F.col("origin") == "ancestor") & F.coalesce("terminal", F.lit(False)) & (F.col("setters") == 0) & (F.col("aliases") == 0) & ~F.col("keep")
    return nodes.where(F.col("path").isNotNull()).where(bare).join(linked, "path", "left_semi").select("path")


def prune_ancestors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that stay (path, parents): parents sorted, without removed ones, null if none is left."""
    gone = removable_ancestors(nodes, links)
    kept = links.join(gone, "path", "left_anti").join(gone.select(F.col("path").alias("parent")), "parent", "left_anti")
    parents = kept.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(F.col("parent").cast("string"))), ",").alias("parents"))
    return nodes.join(gone, "path", "left_anti").join(parents, "path", "left").select("path", "parents")
