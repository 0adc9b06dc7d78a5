"""The whole lineage job: chains, their traces in one plan, classes of terminals, what is missing, and the sinks."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.operators import lineage, projections
from backtrail.operators.constants import Dictionary
from backtrail.plans.trace import Bounds, Inputs, Trace, lineage_graph, trace_chains
from backtrail.sources import cache
from backtrail.sources.scratch import keep


@dataclass
class Options:
    chains: int = 50  # traced for each language
    seconds: float | None = None  # no batch of chains is begun after that
    batch: int = 50  # chains of one plan
    missing: int = 20
    split_chains: bool = True
    bounds: Bounds = field(default_factory=Bounds)
    db_read_markers: tuple[str, ...] = lineage.DB_READ_MARKERS
    user_input_markers: tuple[str, ...] = lineage.USER_INPUT_MARKERS
    input_msg_prefixes: tuple[str, ...] = lineage.INPUT_MSG_PREFIXES
    working_storage_prefixes: tuple[str, ...] = lineage.WORKING_STORAGE_PREFIXES
    scratch_prefixes: tuple[str, ...] = ()  # names that aren't traced


MARKERS = ("db_read_markers", "user_input_markers", "input_msg_prefixes", "working_storage_prefixes")


def options(given: dict) -> Options:
    """Known names are taken over, others are passed by; bounds may be given among them. Markers are read in capitals, and
    an empty list of them means the usual ones; an empty list of scratch prefixes means none (Q15)."""
    names, bound_names = {f.name for f in fields(Options)} - {"bounds"}, {f.name for f in fields(Bounds)}
    taken = {k: v for k, v in given.items() if k in names and v is not None and (k not in MARKERS or v)}
    taken |= {k: tuple(str(m).upper() for m in taken[k]) for k in (*MARKERS, "scratch_prefixes") if k in taken}
    return replace(Options(**taken), bounds=Bounds(**{k: v for k, v in given.items() if k in bound_names and v is not None}))


@dataclass
class Job:
    """Tables of all traced chains, with the columns language and chain_index."""

    variable: str
    traces: dict[tuple[str, int], object]  # (language, chain): its tail
    errors: dict[tuple[str, int], str]
    warnings: list[str]
    parts: list[tuple[DataFrame, Trace]] = field(default_factory=list)  # (chain, language, chain_index) of a batch, and its trace

    def setters(self) -> DataFrame:
        return self._union(lambda t: t.setters)

    def edges(self) -> DataFrame:
        return self._union(lambda t: t.edges)

    def terminals(self) -> DataFrame:
        return self._union(lambda t: t.terminals)

    def summaries(self) -> DataFrame:
        """Each setter on one line: its file, its line, the value and the guards."""
        s = self.setters()
        shaped = s.select("language", "chain_index", "variable", "id", projections.location(F.col("stem").cast("string"), F.col("line")).alias("location"), "value", F.transform("texts", lambda t: F.struct(t.alias("condition"))).alias("conditions"), "is_not_set")
        return projections.setter_summary(shaped, "language", "chain_index", "variable")

    def nodes(self) -> DataFrame:
        """Root, dependent, terminal and truncated variables of each chain."""
        return self._union(lambda t: lineage_graph(t, self.variable)[0])

    def _union(self, part: Callable[[Trace], DataFrame]) -> DataFrame:
        rows = [part(t).join(chains, "chain").drop("chain") for chains, t in self.parts]
        return reduce(DataFrame.unionByName, rows)


def run(inputs: Inputs, variable: str, chains: dict[str, list], opts: Options | None = None) -> Job:
    """Trace a variable from the tail of each chain of each language. Chains of a batch are one plan, and those that end where
    another does share its trace; a batch that fails is recorded for each of its chains and passed by. The limits are
    reported as warnings (O4, O5)."""
    opts = opts or Options()
    began, spark = time.time(), inputs.calls.sparkSession
    job = Job(variable, {}, {}, [])
    if opts.scratch_prefixes:
        scratch = reduce(lambda a, b: a | b, (F.startswith(F.upper("variable"), F.lit(p)) for p in opts.scratch_prefixes))
        inputs = replace(inputs, dependencies=inputs.dependencies.where(~scratch))
    todo = []
    for language, tails in chains.items():
        if len(tails) > opts.chains:
            job.warnings.append(f"{language}: {opts.chains} of {len(tails)} chains are traced")
        todo += [(language, i, tail) for i, tail in enumerate(tails[: opts.chains])]
    kind = inputs.calls.schema["src"].dataType.simpleString()
    for at in range(0, len(todo), opts.batch):
        if opts.seconds is not None and time.time() - began > opts.seconds:
            job.warnings.append(f"time is up before chain {todo[at][1]} of {todo[at][0]}")
            break
        batch = todo[at : at + opts.batch]
        number = {tail: n for n, tail in enumerate(dict.fromkeys(t for *_, t in batch))}
        try:
            with cache.phase(spark, f"trace {variable} from {len(number)} tails"):
                own = spark.createDataFrame([(number[t], language, i) for language, i, t in batch], "chain int, language string, chain_index int")
                tails = spark.createDataFrame([(n, t) for t, n in number.items()], f"chain int, node {kind}")
                job.parts.append((keep(own, "chains"), trace_chains(inputs, variable, tails, opts.bounds)))
            job.traces |= {(language, i): t for language, i, t in batch}
        except Exception as e:  # noqa: BLE001 - a failure is part of the result
            job.errors |= {(language, i): f"{type(e).__name__}: {e}"[:500] for language, i, _ in batch}
    return job


@dataclass
class Facts:
    """What is known of names and files beside the traces."""

    attributes: DataFrame  # (name, external, member, member_name, home)
    sections: DataFrame  # (name, section): the sections and counterparts that a field belongs to
    sources: DataFrame  # (stem, ext, text)
    constants: Dictionary
    callees: DataFrame  # (stem, callee): calls into missing modules
    linkage: DataFrame  # (stem): missing names that are linkage entries


def classified(job: Job, facts: Facts, opts: Options | None = None) -> DataFrame:
    """The terminals (language, chain_index, name, class, evidence, missing) of all chains. What is
    read where comes from the dependencies alone (Q3)."""
    opts = opts or Options()
    terminal = keep(job.nodes().where("terminal").select("language", "chain_index", "name"), "terminals")
    names = terminal.select("name").distinct()
    found_at = job.edges().select(F.col("child").alias("variable"), F.substring_index(F.col("file").cast("string"), "::", 1).alias("file"))
    readers = projections.reader_stems(found_at).select(F.col("variable").alias("name"), "stem")
    found = keep(lineage.evidence(facts.sources, opts.db_read_markers, opts.user_input_markers), "evidence")
    nodes = names.join(facts.attributes, "name", "left")
    markers = {"input": opts.input_msg_prefixes, "storage": opts.working_storage_prefixes}
    judged = lineage.classify_nodes(nodes, readers, facts.sections, found, facts.constants.cpp, facts.constants.asm, facts.callees, markers)
    return terminal.join(keep(judged, "classes"), "name")


def missing_report(terminals: DataFrame, linkage: DataFrame, k: int | None = None) -> DataFrame:
    """Missing modules by how many terminals point at them; all of them if k is None."""
    named = lineage.missing_references(terminals).join(linkage.select(F.col("stem").alias("name"), F.lit(True).alias("linkage")).distinct(), "name", "left")
    rows = named.select("name", F.coalesce("linkage", F.lit(False)).alias("linkage"))
    return lineage.missing_rank(rows, k)


def audit(nodes: DataFrame, edges: DataFrame, blueprints: DataFrame, owners: DataFrame, sample: int = 25, functions: DataFrame | None = None, errors: dict[str, str] | None = None) -> DataFrame:
    """(check, n, sample) of the inputs' gaps: dangling ends, nodes without blueprint, names without one, calls
    of unknown functions (stem, fn, callee_stem, callee_fn). A check that fails is left out and named in errors."""
    checks: dict[str, Callable[[], DataFrame]] = {
        "dangling": lambda: lineage.dangling(nodes, edges), "no_blueprint": lambda: lineage.without_blueprint(nodes, blueprints),
        "no_owner": lambda: lineage.orphan_names(owners, blueprints).select(F.col("name").alias("stem")),
    }
    if functions is not None:
        shown = F.concat("stem", F.lit("::"), "fn", F.lit(" -> "), "callee_stem", F.lit("::"), "callee_fn").alias("stem")
        checks["unknown_function"] = lambda: lineage.unknown_functions(functions, blueprints).select(shown)
    out = []
    for name, rows in checks.items():
        try:
            found = keep(rows().select("stem"), f"audit-{name}")
        except Exception as e:  # noqa: BLE001 - the other checks go on
            if errors is None:
                raise
            errors[name] = f"{type(e).__name__}: {e}"[:500]
            continue
        few = found.orderBy("stem").limit(sample).agg(F.array_sort(F.collect_list("stem")).alias("sample"))
        out.append(found.agg(F.count("*").alias("n")).join(F.broadcast(few)).select(F.lit(name).alias("check"), "n", "sample"))
    return reduce(DataFrame.unionAll, out)


def write(job: Job, folder: str, opts: Options | None = None) -> None:
    """The traces' tables as JSON."""
    opts = opts or Options()
    for name, rows in (("setters", job.setters()), ("edges", job.edges()), ("terminals", job.terminals()), ("nodes", job.nodes()), ("summaries", job.summaries())):
        cache.write_chains(rows, f"{folder}/{name}", opts.split_chains)


def run_lineage(spark: SparkSession, inputs: Inputs, variable: str, chains: dict[str, list], facts: Facts, folder: str, given: dict | None = None) -> dict:
    """The whole job: traces, classes, missing modules, sinks; returns the index. Any failure becomes its status."""
    began = time.time()
    try:
        opts = options(given or {})
        job = run(inputs, variable, chains, opts)
        out = {"variable": variable, "languages": sorted(chains), "chains_traced": len(job.traces), "chain_errors": len(job.errors), "warnings": job.warnings}
        if job.parts:
            write(job, folder, opts)
            terminals = keep(classified(job, facts, opts), "classified")
            cache.write_chains(terminals, f"{folder}/classified", opts.split_chains)
            counts = lineage.terminal_counts(terminals.select(F.concat_ws(":", "language", "chain_index").alias("chain"), "class")).where("chain is null")
            top = keep(missing_report(terminals, facts.linkage), "missing")
            cache.write_missing(top, f"{folder}/missing_files")
            out["terminals_by_class"] = {r["class"]: r["n"] for r in counts.collect()}
            out["missing_top"] = [r.asDict() for r in top.orderBy(F.desc("n"), "name").limit(opts.missing).collect()]
        return {**out, "status": "success", "elapsed": round(time.time() - began, 3)}
    except Exception as e:  # noqa: BLE001 - the caller reads the status
        return {"variable": variable, "status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
