"""The engine's queries over the fixture views, and for each the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backtrail.functions import scalars as X
from backtrail.operators import constants, graph, guards, lineage, projections, sequence
from backtrail.plans import job
from backtrail.plans.fixtures import SQL as VIEWS
from backtrail.plans.fixtures import Fixtures
from backtrail.plans.trace import Bounds, Inputs, Trace, lineage_graph, trace_chains
from backtrail.sources import cache
from backtrail.sources.scratch import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a function of Fixtures under its name; sql goes on behind the fixture views."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{sql}"
        return f

    return register


def nodes(fx: Fixtures, *ids: int) -> DataFrame:
    return fx.spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("bigint") for i in ids))).alias("node"))


def text_case(column: F.Column, values: list[str]) -> F.Column:
    """values[column]."""
    return F.array(*(F.lit(v) for v in values))[column.cast("int")]


def sql_case(expression: str, values: list[str]) -> str:
    return "list_value(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f")[CAST({expression} AS INT) + 1]"


# --- graph ---


@query(", r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM fx_gaps JOIN r ON src = node WHERE dst IS NOT NULL) SELECT node AS stem FROM r", True)
def reachable_files(fx):
    """G2, U-1: files that file 0 can reach."""
    return graph.reach(nodes(fx, 0), fx.call_with_gaps()).select(F.col("node").alias("stem"))


@query(
    """, r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM fx_call JOIN r ON src = node)
SELECT variable, stem, count(*) AS setters, min(line) AS first_line FROM fx_setter WHERE stem IN (SELECT node FROM r) OR stem IN (1, 2) GROUP BY ALL""",
    True,
)
def reachable_setters(fx):
    """Setters in files that the chain's tail reaches or that are in the chain, counted by variable and file."""
    keep_ = graph.reach(nodes(fx, 0), fx.call()).select("node").unionAll(nodes(fx, 1, 2)).distinct()
    rows = fx.setter().join(keep_.withColumnRenamed("node", "stem"), "stem", "left_semi")
    return rows.groupBy("variable", "stem").agg(F.count("*").alias("setters"), F.min("line").alias("first_line"))


@query(
    """, r(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT src, depth + 1 FROM fx_gaps JOIN r ON dst = node WHERE depth < 30 AND src IS NOT NULL)
SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    True,
)
def backward_depth(fx):
    """Files that can reach file 3, and their least distance, up to 30."""
    return graph.backward(nodes(fx, 3), fx.call_with_gaps(), max_depth=30)


@query(
    """, p(dst, nodes) AS (SELECT dst, [src, dst] FROM fx_gaps WHERE src = 0 AND dst <> 0
  UNION ALL SELECT c.dst, list_append(nodes, c.dst) FROM fx_gaps c JOIN p ON c.src = p.dst WHERE len(nodes) < 5 AND c.dst IS NOT NULL AND NOT list_contains(nodes, c.dst)),
t AS (SELECT dst, nodes, array_to_string(nodes, '>') AS path, len(nodes) - 1 AS hops FROM p)
SELECT dst, path, CAST(hops AS INT) AS hops, n > 4 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY nodes) AS k, count(*) OVER (PARTITION BY dst) AS n FROM t) WHERE k <= 4""",
    True,
)
def simple_paths(fx):
    """Paths of up to 4 edges from file 0, at most 4 for each end, and whether more were cut off."""
    return graph.simple_paths(keep(fx.call_with_gaps(), "call"), 0, 4, 4)


FILES = """, e AS (SELECT src // 8 AS file, src, dst FROM fx_call WHERE src // 8 = dst // 8 AND src <> dst),
target AS (SELECT file, max(dst) AS target FROM e WHERE dst % 8 <= 4 GROUP BY file),
b(file, target, node, depth) AS (SELECT file, target, target, 0 FROM target UNION SELECT b.file, target, src, depth + 1 FROM e JOIN b ON e.file = b.file AND e.dst = b.node WHERE depth < 8),
before AS (SELECT file, target, node, min(depth) AS depth FROM b GROUP BY ALL),
roots AS (SELECT DISTINCT file, src AS node FROM e EXCEPT SELECT file, dst FROM e),
f(file, target, removed, node) AS (
  SELECT c.file, c.target, c.node, r.node FROM before c JOIN roots r ON r.file = c.file AND r.node <> c.node WHERE c.node <> c.target
    AND EXISTS (SELECT 1 FROM before x WHERE x.file = r.file AND x.node = r.node)
  UNION SELECT f.file, target, removed, e.dst FROM f JOIN e ON e.file = f.file AND e.src = f.node WHERE e.dst <> removed),
dom AS (SELECT c.file, c.target, c.node, c.depth FROM before c WHERE c.node <> c.target
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.file = c.file AND f.target = c.target AND f.removed = c.node AND f.node = c.target))"""


def small_graphs(fx):
    """(edges (file, src, dst), targets (file, target)): the calls inside groups of 8 files."""
    group = lambda c: F.floor(F.col(c) / 8)
    edges = fx.call().where((group("src") == group("dst")) & (F.col("src") != F.col("dst"))).select(group("src").alias("file"), "src", "dst")
    edges = keep(edges, "edges")
    return edges, edges.where("dst % 8 <= 4").groupBy("file").agg(F.max("dst").alias("target"))


@query(FILES + " SELECT file, target, node, depth FROM dom", True)
def dominators(fx):
    """Blocks that every path from the entry to a middle block passes."""
    return graph.dominators(*small_graphs(fx))


@query(
    FILES
    + """, pair AS (SELECT file, src AS node, max(dst) AS branch FROM e GROUP BY ALL HAVING count(*) > 1),
arm AS (SELECT d.file, d.target, d.node, p.branch, d.depth, e.dst = p.branch AS named, EXISTS (SELECT 1 FROM before x WHERE x.file = d.file AND x.node = e.dst) AS can
  FROM dom d JOIN pair p ON p.file = d.file AND p.node = d.node JOIN e ON e.file = d.file AND e.src = d.node WHERE d.depth <= 3)
SELECT file, target, node, branch, depth, bool_or(named AND can) AS taken FROM arm GROUP BY ALL HAVING bool_or(named AND can) <> bool_or(NOT named AND can)""",
    True,
)
def necessary_guards(fx):
    """Guards at dominators up to 3 levels away of which exactly one arm reaches the target."""
    edges, targets = small_graphs(fx)
    pairs = edges.groupBy("file", F.col("src").alias("node")).agg(F.max("dst").alias("branch"), F.count("*").alias("n")).where("n > 1").drop("n")
    return graph.necessary_guards(edges, pairs, targets, 3)


# --- ordered rows ---


@query(
    """ SELECT block, trigger_line, line FROM (SELECT *, lag(kind) OVER w AS last, lag(line) OVER w AS trigger_line FROM fx_flow WHERE kind IN ('T', 'C', 'U')
  WINDOW w AS (PARTITION BY block ORDER BY line)) WHERE kind = 'C' AND last = 'T'"""
)
def trigger_pairs(fx):
    """Tests and the conditional branches that follow them."""
    return sequence.trigger_pairs(fx.flow())


@query(" SELECT s.stem, s.line, s.variable, f.fn FROM fx_setter s ASOF LEFT JOIN fx_fn f ON s.stem = f.stem AND s.line >= f.start_line")
def owning_function(fx):
    """The function that each setter stands in."""
    return sequence.owning_function(fx.setter().select("stem", "line", "variable"), fx.fn()).select("stem", "line", "variable", "fn")


INST = ["CLI", "CLC", "TM", "LTR"]


@query(
    f""", t AS (SELECT user_id AS block, event_id AS line, {sql_case('event_id % 4', INST)} AS inst, 'F' || (event_id % 3) AS operand FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT event_id AS id, user_id AS block, event_id AS line, {sql_case('event_id % 4', INST)} AS inst, CASE WHEN event_id % 5 <> 0 THEN 'F' || (event_id % 3) END AS operand FROM events WHERE event_type = 'purchase')
SELECT id, line, coalesce((SELECT max(t.line) FROM t WHERE t.block = b.block AND t.inst = b.inst AND t.line <= b.line AND (b.operand IS NULL OR b.operand = t.operand)), line) AS compare_line FROM b"""
)
def compare_line(fx):
    """The compare that each branch belongs to."""
    e = fx.table("events")
    inst, operand = text_case(F.col("event_id") % 4, INST), F.concat(F.lit("F"), (F.col("event_id") % 3).cast("string"))
    base = [F.col("user_id").alias("block"), F.col("event_id").alias("line"), inst.alias("inst")]
    t = e.where(F.col("event_type").isin("click", "view")).select(*base, operand.alias("operand"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), *base, F.when(F.col("event_id") % 5 != 0, operand).alias("operand"))
    return sequence.compare_line(b, t).select("id", "line", "compare_line")


@query(
    """, b AS (SELECT p_partkey % n AS file, p_partkey AS block, p_size AS pos, p_partkey % 50 AS start_line, p_partkey % 50 + p_size AS end_line FROM part, fx_n),
p AS (SELECT line AS id, stem AS file, line % 100 AS line FROM fx_setter)
SELECT p.id, p.file, p.line, arg_min(block, struct_pack(a := end_line - start_line, b := pos, c := block)) AS block FROM p LEFT JOIN b ON b.file = p.file AND start_line > 0 AND p.line BETWEEN start_line AND end_line GROUP BY ALL"""
)
def smallest_block(fx):
    """The smallest block around each setter's line."""
    key = F.col("p_partkey")
    blocks = fx.table("part").select((key % fx.n).alias("file"), key.alias("block"), F.struct(F.col("p_size"), key).alias("pos"), (key % 50).alias("start_line"), (key % 50 + F.col("p_size")).alias("end_line"))
    points = fx.setter().select(F.col("line").alias("id"), F.col("stem").alias("file"), (F.col("line") % 100).alias("line"))
    return sequence.smallest_block(points, blocks).select("id", "file", "line", "block")


@query(
    """, i AS (SELECT o_custkey AS enum, o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 50 AS VARCHAR) WHEN o_orderkey % 11 = 0 THEN '''x''' WHEN o_orderkey % 13 = 0 THEN '1_000' WHEN o_orderkey % 17 = 0 THEN '0xFFFFFFFFFFFFFFFFFFFF' END AS literal FROM orders),
r AS (SELECT *, CASE literal WHEN '''x''' THEN NULL WHEN '1_000' THEN 1000 WHEN '0xFFFFFFFFFFFFFFFFFFFF' THEN CAST(1208925819614629174706175 AS DECIMAL(38, 0)) ELSE CAST(literal AS DECIMAL(38, 0)) END AS number, count(literal) OVER (PARTITION BY enum ORDER BY pos) AS run FROM i),
o AS (SELECT *, row_number() OVER w - 1 AS k, first_value(number) OVER w AS base FROM r WINDOW w AS (PARTITION BY enum, run ORDER BY pos))
SELECT enum, pos, coalesce(literal, CAST(CASE WHEN run = 0 THEN k ELSE base + k END AS VARCHAR)) AS value FROM o"""
)
def enum_values(fx):
    """Values of enumerators, explicit or counted on."""
    key = F.col("o_orderkey")
    literal = F.when(key % 7 == 0, (key % 50).cast("string")).when(key % 11 == 0, F.lit("'x'")).when(key % 13 == 0, F.lit("1_000")).when(key % 17 == 0, F.lit("0xFFFFFFFFFFFFFFFFFFFF"))
    items = fx.table("orders").select(F.col("o_custkey").alias("enum"), key.alias("pos"), F.lit("").alias("name"), literal.alias("literal"))
    return sequence.enumerate_runs(items.withColumn("number", X.integer_literal(F.col("literal")))).select("enum", "pos", "value")


@query(
    """, h AS (SELECT o_custkey AS chain, o_orderkey AS pos, 's' || (o_orderkey % 5) AS stem, 's' || (o_orderkey % 5) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '::f' || (o_orderkey % 4) END AS label FROM orders),
d AS (SELECT chain, stem, label, min(pos) AS pos FROM h GROUP BY ALL),
q AS (SELECT *, label = stem AS bare, min(CASE WHEN label = stem THEN pos END) OVER (PARTITION BY chain, stem) AS bare_pos, bool_or(label <> stem) OVER (PARTITION BY chain, stem) AS has,
  row_number() OVER (PARTITION BY chain, stem ORDER BY label = stem, pos) AS k FROM d),
m AS (SELECT chain, stem, label, CASE WHEN NOT bare AND k = 1 THEN least(pos, coalesce(bare_pos, pos)) ELSE pos END AS pos FROM q WHERE NOT bare OR NOT has)
SELECT chain, stem, label, CAST(row_number() OVER (PARTITION BY chain ORDER BY pos) AS INT) AS rank FROM m"""
)
def merge_chain(fx):
    """Call chains without repeated hops."""
    key = F.col("o_orderkey")
    stem, function = F.concat(F.lit("s"), (key % 5).cast("string")), F.concat(F.lit("f"), (key % 4).cast("string"))
    hops = fx.table("orders").select(F.col("o_custkey").alias("chain"), key.alias("pos"), stem.alias("stem"), X.label(stem, F.when(key % 3 == 0, "asm").otherwise("cpp"), function).alias("label"))
    return sequence.merge_chain(hops)


@query(
    """, h AS (SELECT o_custkey AS chain, o_orderkey AS pos, o_orderkey % n AS label FROM orders, fx_n), p AS (SELECT *, lead(label) OVER (PARTITION BY chain ORDER BY pos) AS next FROM h)
SELECT chain, pos, label, p.next, c.line, c.line IS NULL AS unverified FROM p LEFT JOIN fx_call c ON c.src = p.label AND c.dst = p.next WHERE p.next IS NOT NULL"""
)
def prefix_hops(fx):
    """Neighbouring hops of chains, their direct call, and which have none."""
    hops = sequence.adjacent(fx.table("orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % fx.n).alias("label")))
    calls = fx.call().select(F.col("src").alias("label"), F.col("dst").alias("next"), F.col("line"))
    return hops.join(calls, ["label", "next"], "left").select("chain", "pos", "label", "next", "line", F.col("line").isNull().alias("unverified"))


@query(
    """, r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM fx_call JOIN r ON src = node WHERE line % 3 = 0), u(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM fx_call JOIN u ON src = node)
SELECT variable, stem, line, stem NOT IN (SELECT node FROM r) AS via_unverified FROM fx_setter WHERE stem IN (SELECT node FROM u)""",
    True,
)
def triage_setters(fx):
    """Setters in files that verified calls reach, and those that only unverified calls reach, which are flagged."""
    verified = graph.reach(nodes(fx, 0), fx.call().where("line % 3 = 0")).select(F.col("node").alias("stem"))
    some = graph.reach(nodes(fx, 0), fx.call()).select(F.col("node").alias("stem"))
    return projections.triage(fx.setter().drop("value"), verified, some)


# --- predicates and guards ---

TESTS = ["CLI", "CLC", "C", "TM", "LTR", "ICM", "OC", "XC", "TMY"]
BRANCHES = ["BE", "JNE", "BL", "JH", "BNH", "JNO", "BZ", "BM", "BXH", "BO"]
ARGS = ["F,M", "R5,R5", "A,15,FLD", "R1", "x,X", ",", "A,15,a"]


def tests(fx):
    key = F.col("event_id")
    pick = lambda by, values: text_case(F.floor(key / by) % len(values), values)
    return fx.table("events").select(key.alias("id"), pick(1, TESTS).alias("test"), pick(9, BRANCHES).alias("branch"), X.operands(pick(90, ARGS)).alias("args"), (key % 2 == 0).alias("taken"))


def _op(branch: str, taken: str) -> str:
    cases = " ".join(f"WHEN {branch} = '{w}' THEN CASE WHEN {taken} THEN '{op}' ELSE '{X.OPPOSITE[op]}' END" for w, op in X.COMPARE.items() if w in BRANCHES)
    return f"CASE {cases} END"


def _masks(taken: str) -> str:
    fill = lambda t: "'" + t.replace("{0}", "' || a0 || '").replace("{1}", "' || coalesce(args[2], '?') || '") + "'"
    return " ".join(f"WHEN test IN ('TM', 'TMY') AND branch = '{w}' THEN CASE WHEN {taken} THEN {fill(X.SENSE[k][0])} ELSE {fill(X.SENSE[k][1])} END" for w, k in X.MASK.items() if w in BRANCHES)


def predicate_sql(taken: str) -> str:
    zero = "(test = 'LTR' OR (args[1] <> '' AND (test = 'ICM' AND len(args) >= 3 AND upper(args[1]) = upper(args[-1]) OR test = 'OC' AND len(args) >= 2 AND upper(args[1]) = upper(args[2]))))"
    return f"""CASE {_masks(taken)} WHEN {_op('branch', taken)} IS NULL THEN test || ' ' || array_to_string(args, ', ') || CASE WHEN {taken} THEN ' taken:' ELSE ' fallthrough:' END || branch
  ELSE CASE WHEN test = 'ICM' AND len(args) >= 3 AND NOT {zero} THEN args[-1] ELSE a0 END || ' ' || {_op('branch', taken)} || ' ' || CASE WHEN {zero} OR (test = 'ICM' AND len(args) >= 3) THEN '0' ELSE a1 END END"""


TEST_VIEW = f""", e AS (SELECT event_id AS id, {sql_case(f'event_id % {len(TESTS)}', TESTS)} AS test, {sql_case(f'(event_id // 9) % {len(BRANCHES)}', BRANCHES)} AS branch,
  string_split({sql_case(f'(event_id // 90) % {len(ARGS)}', ARGS)}, ',') AS args, event_id % 2 = 0 AS taken FROM events),
t AS (SELECT *, args[1] AS a0, coalesce(args[2], '0') AS a1 FROM e)"""


@query(TEST_VIEW + f" SELECT id, {predicate_sql('taken')} AS predicate, CASE WHEN upper(args[-1]) NOT SIMILAR TO 'R?[0-9]+' THEN upper(args[-1]) WHEN args[1] NOT SIMILAR TO 'R?[0-9]+' THEN upper(args[1]) ELSE '' END AS target FROM t")
def predicate_text(fx):
    """What holds after a test and a branch, and the branch's target among the operands."""
    return tests(fx).select("id", X.predicate(F.col("test"), F.col("args"), F.col("branch"), F.col("taken")).alias("predicate"), X.branch_target(F.col("args")).alias("target"))


@query(TEST_VIEW + f" SELECT id, CASE WHEN id % 3 = 0 THEN {predicate_sql('NOT taken')} WHEN id % 3 = 1 THEN '!(' || {predicate_sql('taken')} || ')' ELSE {predicate_sql('taken')} END AS negated FROM t")
def negated_predicate(fx):
    """Negations, rendered anew where the test is known, else put on or taken off as text."""
    args = [F.col("test"), F.col("args"), F.col("branch")]
    text, flipped = X.predicate(*args, F.col("taken")), X.predicate(*args, ~F.col("taken"))
    rows = tests(fx).withColumns({"text": F.when(F.col("id") % 3 == 2, F.concat(F.lit("!("), text, F.lit(")"))).otherwise(text), "flipped": F.when(F.col("id") % 3 == 0, flipped)})
    return rows.select("id", X.negate(F.col("text"), F.col("flipped")).alias("negated"))


def call_sites(fx):
    """(hop, site, line, pos, guard): guards of call sites; a site without has one row with a null guard."""
    key = F.col("o_orderkey")
    guard = F.when(key % 4 != 0, F.concat(F.lit("g"), (key % 10).cast("string")))
    site = F.floor(key / 2)
    rows = fx.table("orders").select((F.floor(key / 6)).alias("hop"), site.alias("site"), (site * 3).alias("line"), key.alias("pos"), guard.alias("guard"))
    return rows


@query(
    """, s AS (SELECT o_orderkey // 6 AS hop, o_orderkey // 2 AS site, 3 * (o_orderkey // 2) AS line, o_orderkey AS pos, CASE WHEN o_orderkey % 4 <> 0 THEN 'g' || (o_orderkey % 10) END AS guard FROM orders),
e AS (SELECT hop, site, line, count(guard) AS n, string_agg(guard, ' && ' ORDER BY pos) AS text FROM s GROUP BY ALL)
SELECT hop, max(line) AS bound, CASE WHEN bool_or(n = 0) THEN NULL WHEN count(*) = 1 THEN max(text) ELSE string_agg(CASE WHEN n > 1 THEN '(' || text || ')' ELSE text END, ' || ' ORDER BY line, site) END AS guard FROM e GROUP BY hop"""
)
def or_guards(fx):
    """The guard of a hop that several call sites make."""
    return guards.or_of_sites(call_sites(fx))


GUARDS = ["x != 0 && y == 1", "y == 1", "z", "(y == 1)", "x != 0", "", "a->c != 0 && q", "c != 0", "((((((((y == 1))))))))", "(((x != 0)"]


def normal_sql(text: str) -> str:
    """normal_conjunct() of an expression."""
    bare = f"regexp_replace({text}, '\\s', '', 'g')"
    pairs = f"least(length({bare}) - length(ltrim({bare}, '(')), length({bare}) - length(rtrim({bare}, ')')))"
    return f"substr({bare}, {pairs} + 1, length({bare}) - 2 * {pairs})"


@query(
    f""", g AS (SELECT o_custkey AS id, o_orderkey AS pos, {sql_case('o_orderkey % 10', GUARDS)} AS text FROM orders),
k AS (SELECT id, text, min(pos) AS pos FROM g WHERE trim(text) <> '' GROUP BY ALL),
u AS (SELECT id, unnest(string_split(text, '&&')) AS part FROM k WHERE contains(text, '&&')),
c AS (SELECT DISTINCT id, {normal_sql('part')} AS normal FROM u)
SELECT id, pos, text, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INT) AS seq FROM k
WHERE contains(text, '&&') OR NOT EXISTS (SELECT 1 FROM c WHERE c.id = k.id AND c.normal = {normal_sql('text')})"""
)
def conjunct_subsume(fx):
    """Guards without repeated ones and without those that a compound says already."""
    rows = fx.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), text_case(F.col("o_orderkey") % 10, GUARDS).alias("text"))
    return guards.finalise(rows).select("id", "pos", "text", "seq")


@query(
    """, r AS (SELECT o_custkey AS stem, o_orderkey % 3 AS line, o_orderkey AS seq, 'c' || o_orderkey AS chain, o_orderkey % 5 AS hops, o_orderkey % 2 AS qualified, o_orderstatus AS value FROM orders)
SELECT stem, line, min(seq) AS seq, arg_max(chain, struct_pack(a := hops, b := qualified, c := -seq)) AS chain, arg_min(value, seq) AS value FROM r GROUP BY stem, line"""
)
def dedup_richest(fx):
    """A1: one row for each key: the first, with the richest chain."""
    key = F.col("o_orderkey")
    rows = fx.table("orders").select(F.col("o_custkey").alias("stem"), (key % 3).alias("line"), key.alias("seq"), F.concat(F.lit("c"), key.cast("string")).alias("chain"), (key % 5).alias("hops"), (key % 2).alias("qualified"), F.col("o_orderstatus").alias("value"))
    return guards.richest(rows, ["stem", "line"], ["value"])


VALUES = ["E::A", "E::B", "Other::A", "A", "f(E::B)", "E::B x"]


@query(
    f""", q AS (SELECT o_custkey AS route, o_orderkey AS pos, 'v' || (o_orderkey % 3) AS scrutinee, CASE WHEN o_orderkey % 2 = 0 THEN 'E::A' ELSE 'E::B' END AS value FROM orders WHERE o_orderkey % 4 < 2),
a AS (SELECT o_custkey AS route, o_orderkey AS pos, 'v' || (o_orderkey % 3) AS scrutinee, {sql_case('(o_orderkey // 3) % 6', VALUES)} AS value FROM orders WHERE o_orderkey % 5 > 1 AND o_orderkey % 7 > 0),
n AS (SELECT route, scrutinee, arg_min(value, pos) AS need FROM q GROUP BY ALL),
l AS (SELECT route, scrutinee, arg_max(value, pos) AS last FROM a WHERE contains(value, '::') AND NOT contains(value, ' ') AND right(value, 1) <> ')' GROUP BY ALL)
SELECT DISTINCT route FROM n JOIN l USING (route, scrutinee) WHERE need <> last AND string_split(need, '::')[-1] <> string_split(last, '::')[-1]"""
)
def route_prune(fx):
    """Routes that a required value rules out."""
    key = F.col("o_orderkey")
    base = [F.col("o_custkey").alias("route"), F.concat(F.lit("v"), (key % 3).cast("string"))]
    need = fx.table("orders").where(key % 4 < 2).select(base[0], key.alias("pos"), base[1].alias("scrutinee"), F.when(key % 2 == 0, "E::A").otherwise("E::B").alias("value"))
    given = fx.table("orders").select(
        base[0], key.alias("route_pos"), F.lit(0).alias("site_pos"), base[1].alias("target"), text_case(F.floor(key / 3) % 6, VALUES).alias("value"), (key % 5 <= 1).alias("conditional"), (key % 7 == 0).alias("declaration")
    )
    return guards.infeasible_routes(need, given)


@query(
    """, g AS (SELECT o_custkey AS id, o_orderkey // 3 AS setter, o_orderkey % 4 AS line, o_orderkey AS pos, 'n' || (o_orderkey % 5) AS negated FROM orders),
l AS (SELECT id, setter, negated, min(pos) AS pos, min(line) AS line FROM g WHERE line > 0 GROUP BY ALL), f AS (SELECT l.id, l.setter, l.negated, l.pos, g.line FROM l JOIN g ON g.pos = l.pos),
c AS (SELECT id, setter, min(line) AS line, string_agg(negated, ' || ' ORDER BY pos) AS text FROM f GROUP BY ALL),
d AS (SELECT id, text, min(setter) AS setter FROM c GROUP BY ALL)
SELECT d.id, d.setter, c.line, d.text, CAST(row_number() OVER (PARTITION BY d.id ORDER BY d.setter) AS INT) AS seq FROM d JOIN c ON c.id = d.id AND c.setter = d.setter"""
)
def not_set_guards(fx):
    """What must hold for a variable not to be set."""
    key = F.col("o_orderkey")
    rows = fx.table("orders").select(F.col("o_custkey").alias("id"), F.floor(key / 3).alias("setter"), (key % 4).alias("line"), key.alias("pos"), F.concat(F.lit("n"), (key % 5).cast("string")).alias("negated"))
    return guards.not_set(rows).select("id", "setter", "line", "text", "seq")


@query(
    """, s AS (SELECT o_custkey AS id, o_orderkey AS setter, o_orderkey % 3 AS line, o_orderkey % 5 + CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS guards, o_orderkey % 19 = 0 AS truncated, 't' || (o_orderkey % 2) AS raw, o_orderkey % 4 < 2 AS polarity FROM orders),
p AS (SELECT *, CASE WHEN truncated THEN 'incomplete' WHEN guards = 0 THEN 'unconditional' END AS stop FROM s WHERE line > 0),
f AS (SELECT id, arg_min(stop, setter) FILTER (WHERE stop IS NOT NULL) AS stop FROM p GROUP BY id),
t AS (SELECT id, bool_or(n > 1) AS twice FROM (SELECT id, raw, count(DISTINCT polarity) AS n FROM p WHERE guards = 1 GROUP BY ALL) GROUP BY id)
SELECT i.id, CASE WHEN f.id IS NULL THEN 'no_function' WHEN f.stop IS NOT NULL THEN f.stop WHEN coalesce(twice, false) THEN 'tautology' ELSE 'ok' END AS status
FROM (SELECT DISTINCT id FROM s) i LEFT JOIN f ON f.id = i.id LEFT JOIN t ON t.id = i.id"""
)
def not_set_status(fx):
    """Whether not-set conditions can be given."""
    key = F.col("o_orderkey")
    rows = fx.table("orders").select(
        F.col("o_custkey").alias("id"), key.alias("setter"), (key % 3).alias("line"), (key % 5 + F.when(key % 17 == 0, 0).otherwise(1)).alias("guards"), (key % 19 == 0).alias("truncated"),
        F.concat(F.lit("t"), (key % 2).cast("string")).alias("raw"), (key % 4 < 2).alias("polarity"),
    )
    return guards.not_set_status(rows)


@query(
    """, pe AS (SELECT o_custkey AS path, o_orderkey AS seq, o_orderkey % n AS stem, 'f' || (o_orderkey // n % 3) AS fn, o_orderkey // n % 5 AS line FROM orders, fx_n),
g AS (SELECT DISTINCT p_partkey % n AS stem, 'f' || (p_partkey // n % 3) AS fn, p_partkey // n % 5 AS line, p_brand || '=' || (p_partkey % 4) AS text FROM part, fx_n),
u AS (SELECT c_custkey AS path, 0 AS section, CAST(1 AS BIGINT) AS seq, c_mktsegment AS text FROM customer UNION ALL SELECT path, 1, seq, text FROM pe JOIN g USING (stem, fn, line)
  UNION ALL SELECT c_custkey, 2, CAST(1 AS BIGINT), 'local' FROM customer WHERE c_custkey % 2 = 0)
SELECT path, section, seq, text, CAST(row_number() OVER (PARTITION BY path ORDER BY section, seq, text) AS INT) AS rank FROM u"""
)
def edge_guards(fx):
    """J22, U-2, W2: all guards of a path: prefix, edges in order, the setter's own."""
    key, part = F.col("o_orderkey"), F.col("p_partkey")
    place = lambda c: [(c % fx.n).alias("stem"), F.concat(F.lit("f"), (F.floor(c / fx.n) % 3).cast("string")).alias("fn"), (F.floor(c / fx.n) % 5).alias("line")]
    edges = fx.table("orders").select(F.col("o_custkey").alias("path"), key.alias("seq"), *place(key))
    own = fx.table("part").select(*place(part), F.concat_ws("=", "p_brand", (part % 4).cast("string")).alias("text")).distinct()
    one = F.lit(1).cast("bigint").alias("seq")
    prefix = fx.table("customer").select(F.col("c_custkey").alias("path"), one, F.col("c_mktsegment").alias("text"))
    local = fx.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"), one, F.lit("local").alias("text"))
    return guards.edge_guards(edges, own, prefix, local)


# --- lineage ---


@query(
    """, node AS (SELECT DISTINCT 'S' || src AS id FROM fx_call WHERE src % 3 <> 0), e AS (SELECT 'S' || src AS src, CASE WHEN line % 11 = 0 THEN 'a.b' ELSE 'S' || dst END AS dst FROM fx_call)
SELECT DISTINCT stem FROM (SELECT lower(src) AS stem FROM e UNION ALL SELECT lower(dst) FROM e) WHERE regexp_full_match(stem, '[a-z0-9_]+') AND stem NOT IN (SELECT lower(id) FROM node)"""
)
def audit_dangling(fx):
    """J18, F3, U-4: ends of calls that are no nodes."""
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    known = fx.call().where("src % 3 <> 0").select(name("src").alias("id")).distinct()
    edges = fx.call().select(name("src").alias("src"), F.when(F.col("line") % 11 == 0, "a.b").otherwise(name("dst")).alias("dst"))
    return lineage.dangling(known, edges)


@query(
    """, o AS (SELECT upper(p_name) || '_' || (p_partkey % n) // 4 AS name, p_partkey % n AS stem FROM part, fx_n), bp AS (SELECT DISTINCT stem FROM fx_setter WHERE line % 2 = 0 AND stem % 5 <> 0)
SELECT DISTINCT name FROM o WHERE name NOT IN (SELECT name FROM o WHERE stem IN (SELECT stem FROM bp))"""
)
def audit_orphans(fx):
    """Names with owners, none of which has a blueprint."""
    # a name for each run of four files; owners of a mere p_name are so many that one always has a blueprint
    stem = F.col("p_partkey") % fx.n
    owners = fx.table("part").select(F.concat_ws("_", F.upper("p_name"), F.floor(stem / 4).cast("string")).alias("name"), stem.alias("stem"))
    return lineage.orphan_names(owners, fx.setter().where("line % 2 = 0 and stem % 5 <> 0").select("stem").distinct())


@query(
    """ SELECT DISTINCT src AS stem, dst AS callee FROM fx_call WHERE src IN (SELECT stem FROM fx_setter WHERE line % 3 = 0) AND dst NOT IN (SELECT stem FROM fx_setter WHERE line % 3 = 0 AND stem % 4 <> 1)"""
)
def audit_attribution(fx):
    """Which files with a blueprint call a missing one."""
    blueprints = fx.setter().where("line % 3 = 0").select("stem").distinct()
    present = blueprints.where("stem % 4 <> 1")
    missing = fx.call().select(F.col("dst").alias("stem")).distinct().join(present, "stem", "left_anti")
    return lineage.attribution(fx.call(), blueprints, missing)


@query(
    """, m AS (SELECT DISTINCT 'f' || (p_partkey % 40) AS stem FROM part), a AS (SELECT 'f' || (p_partkey % 30) AS fn, 'm' || (p_partkey % 11) AS entry, p_brand AS source, p_partkey % 2 AS kind, p_partkey AS pos FROM part WHERE p_partkey % 3 = 0),
bp AS (SELECT 'm' || x AS stem FROM range(5) t(x)), l AS (SELECT fn, arg_max(entry, struct_pack(a := source, b := kind, c := pos)) AS entry FROM a GROUP BY fn)
SELECT DISTINCT coalesce(entry, stem) AS stem, CASE WHEN entry IS NOT NULL THEN m.stem END AS called_as FROM m LEFT JOIN l ON l.fn = m.stem WHERE entry IS NULL OR entry NOT IN (SELECT stem FROM bp)"""
)
def alias_rewrite(fx):
    """Missing names under the modules that they are linked to."""
    key = F.col("p_partkey")
    name = lambda c, k: F.concat(F.lit(c), (key % k).cast("string"))
    missing = fx.table("part").select(name("f", 40).alias("stem")).distinct()
    aliases = fx.table("part").where(key % 3 == 0).select(name("f", 30).alias("fn"), name("m", 11).alias("entry"), F.col("p_brand").alias("source"), (key % 2).alias("kind"), key.alias("pos"))
    blueprints = fx.spark.range(5).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("stem"))
    return lineage.rewrite_aliases(missing, aliases, blueprints)


NAMES = ["EBW000", "MI0ACC", "FIELD", "am0x", "WK_A", "K1"]


def terminals(fx):
    key = F.col("o_orderkey")
    flag = lambda k, r=0: key % k == r
    return fx.table("orders").select(
        key.alias("id"), F.col("o_custkey").alias("chain"), F.concat(text_case(key % 6, NAMES), F.lit("")).alias("name"), flag(23).alias("external"), flag(13).alias("asm_constant"), flag(17).alias("cpp_constant"),
        flag(2).alias("member"), F.when(flag(2), text_case(F.floor(key / 2) % 6, NAMES)).alias("member_name"), flag(5).alias("db_read"), flag(7).alias("db_tokens"), flag(3).alias("input_read"),
    )


CLASSES = f""", t AS (SELECT o_orderkey AS id, o_custkey AS chain, {sql_case('o_orderkey % 6', NAMES)} AS name, CASE WHEN o_orderkey % 2 = 0 THEN {sql_case('(o_orderkey // 2) % 6', NAMES)} END AS member_name FROM orders),
c AS (SELECT *, CASE WHEN id % 23 = 0 THEN 'external' WHEN id % 13 = 0 OR id % 17 = 0 THEN 'constant'
  WHEN upper(name) LIKE 'MI0%' OR upper(name) LIKE 'AM0%' OR upper(member_name) LIKE 'MI0%' OR upper(member_name) LIKE 'AM0%' THEN 'user_input'
  WHEN upper(name) LIKE 'EBW%' OR upper(name) LIKE 'EBX%' OR upper(name) LIKE 'EBC%' OR upper(name) LIKE 'CE1%' OR starts_with(upper(name), 'WK_') THEN 'working_storage'
  WHEN id % 2 = 0 AND (id % 5 = 0 OR id % 7 = 0) THEN 'database' WHEN id % 2 <> 0 AND id % 3 = 0 THEN 'user_input' WHEN id % 2 = 0 THEN 'record_field' ELSE 'unresolved' END AS class FROM t)"""


@query(CLASSES + " SELECT id, name, class FROM c")
def classify_terminals(fx):
    """Where the values of terminals come from."""
    return lineage.classify(terminals(fx)).select("id", "name", "class")


@query(CLASSES + " SELECT chain, class, count(*) AS n FROM c GROUP BY GROUPING SETS ((chain, class), (class))")
def terminal_counts(fx):
    """A4: terminals by class, for each chain and in all."""
    return lineage.terminal_counts(lineage.classify(terminals(fx)).select("chain", "class"))


MISSING = ["qz41", "fold", "lookup", "char", "gather", "kw7r3", "mn0p", "x_y"]


@query(
    f""", r AS (SELECT {sql_case('(o_orderkey * 7 + o_custkey) % 8', MISSING)} || CASE WHEN o_custkey % 6 = 0 THEN CAST(o_custkey % 40 AS VARCHAR) ELSE '' END AS name, o_custkey % 6 = 0 AND o_custkey % 4 = 0 AS linkage FROM orders),
c AS (SELECT name, count(*) AS n, bool_or(linkage) AS linkage FROM r GROUP BY name ORDER BY n DESC, name LIMIT 20)
SELECT name, n, CASE WHEN name IN ('char', 'abs') THEN 'builtin' WHEN linkage THEN CASE WHEN regexp_matches(name, '[0-9]') THEN 'module' ELSE 'library' END
  WHEN regexp_full_match(name, '[a-z][a-z][0-9a-z][0-9a-z]') THEN CASE WHEN regexp_matches(name, '[0-9]') THEN 'module' ELSE 'library' END ELSE 'symbol' END AS kind FROM c"""
)
def missing_rank(fx):
    """The 20 missing names that most terminals point at (the limit is the feature)."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(text_case((key * 7 + cust) % 8, MISSING), F.when(cust % 6 == 0, (cust % 40).cast("string")).otherwise(""))
    return lineage.missing_rank(fx.table("orders").select(name.alias("name"), ((cust % 6 == 0) & (cust % 4 == 0)).alias("linkage")), 20)


@query(" SELECT DISTINCT 'v' || (l_partkey % 50) AS parent, 'v' || (l_suppkey % 50) AS child, l_returnflag AS file, l_linenumber AS line FROM lineitem")
def lineage_edges(fx):
    """U-5, G14: one edge for each dependency and place."""
    name = lambda c: F.concat(F.lit("v"), (F.col(c) % 50).cast("string"))
    return lineage.fold_edges(fx.table("lineitem").select(name("l_partkey").alias("parent"), name("l_suppkey").alias("child"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line")))


@query(
    """, e AS (SELECT p_name AS name, p_partkey AS seq, p_brand AS qualified, p_size > 3 AS terminal FROM part)
SELECT name, arg_min(qualified, seq) AS qualified, bool_and(terminal) AS terminal, count(*) AS entries FROM e GROUP BY name"""
)
def lineage_nodes(fx):
    """Nodes by name: the first entry's attributes, terminal if all entries are."""
    return lineage.fold_nodes(fx.table("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("qualified"), (F.col("p_size") > 3).alias("terminal")))


@query(
    """, nd AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'ancestor' ELSE 'dep' END AS origin, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 3 <> 0 END AS terminal, c_custkey % 5 % 2 AS setters, c_custkey % 7 % 2 AS aliases, c_custkey % 11 = 0 AS keep FROM customer),
ln AS (SELECT DISTINCT o_custkey AS path, o_orderkey % 97 AS parent FROM orders WHERE o_custkey % 4 <> 3),
g AS (SELECT path FROM nd WHERE origin = 'ancestor' AND coalesce(terminal, false) AND setters = 0 AND aliases = 0 AND NOT keep AND path IN (SELECT path FROM ln UNION SELECT parent FROM ln))
SELECT path, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT CAST(parent AS VARCHAR) AS p FROM ln WHERE ln.path = nd.path AND parent NOT IN (SELECT path FROM g))) AS parents FROM nd WHERE path NOT IN (SELECT path FROM g)"""
)
def ancestor_prune(fx):
    """Nodes without empty ancestors, and their links without these."""
    key = F.col("c_custkey")
    nodes_ = fx.table("customer").select(
        key.alias("path"), F.when(key % 2 == 0, "ancestor").otherwise("dep").alias("origin"), F.when(key % 9 != 0, key % 3 != 0).alias("terminal"),
        (key % 5 % 2).alias("setters"), (key % 7 % 2).alias("aliases"), (key % 11 == 0).alias("keep"),
    )
    links = fx.table("orders").where("o_custkey % 4 <> 3").select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 97).alias("parent")).distinct()
    return lineage.prune_ancestors(nodes_, links)


MARKERS = ["the", "of", "and", "les", "und"]


@query(
    """, d AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\\b(the|of|and|les|und)\\b', 1), lambda x: upper(x)))), ',') AS markers,
  len(regexp_extract_all(t, '\\b[A-Z][A-Z0-9_]{3,}\\b')) AS tokens FROM d"""
)
def marker_scan(fx):
    """Marker words of whole texts, and how many words in capitals there are."""
    rows = fx.table("documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "~").alias("t"))
    return rows.select("doc_id", F.array_join(X.marker_hits(F.col("t"), MARKERS), ",").alias("markers"), F.size(X.upper_tokens(F.col("t"))).cast("bigint").alias("tokens"))


@query(
    """ SELECT o_custkey AS path, count(*) AS files, CAST(sum(CAST('0x' || substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM orders GROUP BY o_custkey"""
)
def fingerprint(fx):
    """A digest of the (name, state) pairs of each folder's files, whatever their order; sums need no sorted list."""
    one = cache.entry_digest(F.col("o_orderkey").cast("string"), "o_orderstatus")
    return fx.table("orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("files"), F.sum(one).cast("string").alias("fingerprint"))


# --- names and sets ---


@query(
    """, h AS (SELECT o_orderkey AS hop, o_custkey % 20 AS stem, o_orderkey % 6 AS line, o_orderkey % 9 AS next FROM orders), c AS (SELECT DISTINCT p_partkey % 20 AS stem, p_size % 6 AS line, p_brand || '_' || p_partkey % 3 AS callee, p_size AS pos FROM part),
w AS (SELECT DISTINCT p_partkey % 9 AS stem, p_brand || '_' || p_partkey % 3 AS fn FROM part)
SELECT h.hop, h.stem, h.line, h.next, arg_min(c.callee, struct_pack(a := c.pos, b := c.callee)) AS callee FROM h LEFT JOIN (SELECT c.*, w.stem AS next FROM c JOIN w ON w.fn = c.callee) c ON c.stem = h.stem AND c.line = h.line AND c.next = h.next GROUP BY ALL"""
)
def hop_callee(fx):
    """What a hop's call site enters in the next file."""
    key, part = F.col("o_orderkey"), F.col("p_partkey")
    name = F.concat_ws("_", "p_brand", (part % 3).cast("string"))  # each is owned in three of nine files; every file owns a mere p_brand
    hops = fx.table("orders").select(key.alias("hop"), (F.col("o_custkey") % 20).alias("stem"), (key % 6).alias("line"), (key % 9).alias("next"))
    calls = fx.table("part").select((part % 20).alias("stem"), (F.col("p_size") % 6).cast("bigint").alias("line"), name.alias("callee"), F.col("p_size").alias("pos")).distinct()
    owners = fx.table("part").select((part % 9).alias("stem"), name.alias("fn")).distinct()
    return graph.hop_callee(hops, calls, owners).select("hop", "stem", "line", "next", "callee")


@query(
    """, a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'A::' WHEN 1 THEN 'B::A::' WHEN 2 THEN '' ELSE 'x' END || 'f' || (p_partkey % 30) AS name FROM part),
b AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'A::' ELSE '' END || 'f' || (o_orderkey % 25) AS wanted FROM orders)
SELECT id, name, wanted FROM a JOIN b ON name = wanted OR ends_with(name, '::' || wanted)"""
)
def name_match(fx):
    """Names that mean a wanted one, qualified or not; an equality on exploded suffixes."""
    part, key = F.col("p_partkey"), F.col("o_orderkey")
    names = fx.table("part").select(part.alias("id"), F.concat(text_case(part % 4, ["A::", "B::A::", "", "x"]), F.lit("f"), (part % 30).cast("string")).alias("name"))
    wanted = fx.table("orders").select(F.concat(F.when(key % 3 == 0, "A::").otherwise(""), F.lit("f"), (key % 25).cast("string")).alias("wanted")).distinct()
    return names.withColumn("wanted", F.explode(X.suffixes(F.col("name")))).join(wanted, "wanted").select("id", "name", "wanted")


@query(
    """, s AS (SELECT o_custkey AS route, o_orderkey % 3 AS segment, o_orderkey AS seq, 'p' || o_orderkey AS path FROM orders),
j AS (SELECT q.route, a.seq AS s0, b.seq AS s1, c.seq AS s2, concat_ws('/', a.path, b.path, c.path) AS path FROM (SELECT DISTINCT route FROM s) q
  LEFT JOIN s a ON a.route = q.route AND a.segment = 0 LEFT JOIN s b ON b.route = q.route AND b.segment = 1 LEFT JOIN s c ON c.route = q.route AND c.segment = 2),
k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY s0, s1, s2) AS rank, count(*) OVER (PARTITION BY route) AS n FROM j)
SELECT route, CAST(rank AS INT) AS rank, path, n > 16 AS truncated, n > 16 OR s0 IS NULL OR s1 IS NULL OR s2 IS NULL AS incomplete FROM k WHERE rank <= 16"""
)
def path_product(fx):
    """Paths stitched of one path for each segment, at most 16 for a route, with a flag where that cuts."""
    key = F.col("o_orderkey")
    rows = fx.table("orders").select(F.col("o_custkey").alias("route"), (key % 3).alias("segment"), key.alias("seq"), F.concat(F.lit("p"), key.cast("string")).alias("path"))
    return graph.stitch(rows, 3, 16)


@query(
    """, t AS (SELECT p_partkey AS id, 'a.b->C::d' || (p_partkey % 7) || '[' || p_size || ']' AS s, 'st::' || p_brand || '::' || (p_partkey % 5) AS label, p_size AS line, p_partkey % 2 = 0 AS cr FROM part)
SELECT id, split_part(label, '::', 1) AS stem, string_split(label, '::')[-1] AS tail, 'd' || (id % 7) AS scrutinee,
  CASE WHEN cr THEN 'A.f→B.g' ELSE 'f→g' END || '@' || line AS via FROM t"""
)
def label_parts(fx):
    """Parts of labels and names."""
    key = F.col("p_partkey")
    value = F.concat(F.lit("a.b->C::d"), (key % 7).cast("string"), F.lit("["), F.col("p_size").cast("string"), F.lit("]"))
    label = F.concat_ws("::", F.lit("st"), "p_brand", (key % 5).cast("string"))
    via = X.via_text(F.lit("A"), F.lit("f"), F.lit("B"), F.lit("g"), F.col("p_size"), key % 2 == 0)
    return fx.table("part").select(key.alias("id"), X.label_stem(label).alias("stem"), X.constant_tail(label).alias("tail"), X.scrutinee_tail(value).alias("scrutinee"), via.alias("via"))


@query(
    """, a AS (SELECT src AS x FROM fx_call), b AS (SELECT stem AS x FROM fx_setter WHERE line % 5 = 0)
SELECT 'both' AS part, x FROM (SELECT x FROM a INTERSECT SELECT x FROM b) UNION ALL SELECT 'left', x FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT 'right', x FROM (SELECT x FROM b EXCEPT SELECT x FROM a)"""
)
def set_ops(fx):
    """U-3, U-4: files that call, that set, and that do both; Spark's own set operators are the implementation."""
    a, b = fx.call().select(F.col("src").alias("x")), fx.setter().where("line % 5 = 0").select(F.col("stem").alias("x"))
    tag = lambda name, df: df.select(F.lit(name).alias("part"), "x")
    return tag("both", a.intersect(b)).unionAll(tag("left", a.subtract(b))).unionAll(tag("right", b.subtract(a)))


@query(
    """, s AS (SELECT stem, line, CASE line % 3 WHEN 0 THEN 'A::' WHEN 1 THEN 'B::A::' ELSE '' END || p_name AS fn, CASE WHEN line % 10 = 0 THEN p_brand END AS block FROM fx_setter JOIN part ON p_partkey = line % 200),
h AS (SELECT DISTINCT p_name AS hint FROM part WHERE p_partkey % 37 = 0 UNION SELECT 'A::' || p_name FROM part WHERE p_partkey % 41 = 0 UNION SELECT min(p_brand) FROM part UNION SELECT '')
SELECT stem, line, fn, block FROM s WHERE EXISTS (SELECT 1 FROM h WHERE hint <> '' AND (fn = hint OR ends_with(fn, '::' || hint) OR block = hint OR ends_with(block, '::' || hint)))"""
)
def hint_filter(fx):
    """Setters in a function or block that some hint names, qualified or not."""
    part = fx.table("part")
    scope = F.when(F.col("line") % 3 == 0, "A::").when(F.col("line") % 3 == 1, "B::A::").otherwise("")
    named = fx.setter().withColumn("k", F.col("line") % 200).join(part.select(F.col("p_partkey").alias("k"), "p_name", "p_brand"), "k")
    setters = named.select("stem", "line", F.concat(scope, "p_name").alias("fn"), F.when(F.col("line") % 10 == 0, F.col("p_brand")).alias("block"))
    hints = part.where("p_partkey % 37 = 0").select(F.col("p_name").alias("hint")).unionAll(part.where("p_partkey % 41 = 0").select(F.concat(F.lit("A::"), "p_name")))
    hints = hints.unionAll(part.agg(F.min("p_brand"))).unionAll(fx.spark.range(1).select(F.lit("")))
    return projections.hinted(setters, hints)


OPERANDS = ["TABLE+8 FIRST ROW OF IT", "C'P Q' Y", "NAME9 '  Z", "   LEFT  ", " B'0110' ", "R5", "A", "\t W\tis here", "x'  open"]


@query(
    f""", t AS (SELECT p_partkey AS id, {sql_case('p_partkey % 9', OPERANDS)} || ',' || {sql_case('(p_partkey // 9) % 9', OPERANDS)} AS s FROM part),
h AS (SELECT id, list_transform(string_split(s, ','), lambda x: regexp_extract(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '(?s)^((?:[^\\s'']|''[^'']*'')*(?:''.*)?)', 1)) AS args FROM t)
SELECT id, array_to_string(args, '|') AS args, CASE WHEN upper(args[2]) NOT SIMILAR TO 'R?([0-9]|1[0-5])' THEN upper(args[2]) WHEN upper(args[1]) NOT SIMILAR TO 'R?([0-9]|1[0-5])' THEN upper(args[1]) ELSE '' END AS target FROM h"""
)
def operand_parse(fx):
    """Operands without the remarks behind them, and the branch target."""
    key = F.col("p_partkey")
    text = F.concat_ws(",", text_case(key % 9, OPERANDS), text_case(F.floor(key / 9) % 9, OPERANDS))
    rows = fx.table("part").select(key.alias("id"), X.operands(text).alias("a"))
    return rows.select("id", F.array_join("a", "|").alias("args"), X.branch_target(F.col("a")).alias("target"))


@query(
    r""", t AS (SELECT p_partkey AS id, 'K' || p_partkey || '&X EQU C''D' || p_size || ''' remark' || chr(10) || ' DS CL4' || chr(10) || 'FLD DS CL4' || chr(10) || 'V' || (p_partkey % 9) || ' DC F''' || p_size || '''' AS s FROM part)
SELECT id, 'K' || id AS name, regexp_extract(s, 'EQU (\S+)', 1) AS value FROM t UNION ALL SELECT id, 'V' || (id % 9), regexp_extract(s, 'DC (\S+)', 1) FROM t"""
)
def definitions(fx):
    """EQU and DC lines of assembler texts; DS lines define nothing."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    s = lambda c: F.lit(c)
    text = F.concat(s("K"), key.cast("string"), s("&X EQU C'D"), size, s("' remark\n DS CL4\nFLD DS CL4\nV"), (key % 9).cast("string"), s(" DC F'"), size, s("'"))
    return fx.table("part").select(key.alias("id"), F.explode(X.definitions(text)).alias("d")).select("id", "d.name", "d.value")


@query(
    """, g AS (SELECT p_partkey % n AS stem, p_name AS fn, coalesce(min(p_partkey) FILTER (WHERE p_size % 4 <> 0 AND p_partkey > 0), 0) AS first_line, coalesce(max(p_partkey) FILTER (WHERE p_size % 4 <> 0 AND p_partkey > 0), 0) AS last_line FROM part, fx_n GROUP BY ALL)
SELECT stem, fn, first_line, last_line, CAST(row_number() OVER (PARTITION BY stem ORDER BY first_line, fn) AS INT) AS seq FROM g"""
)
def fn_span(fx):
    """First and last line of each function, 0 for those without any, numbered in a file's order."""
    rows = fx.table("part").select((F.col("p_partkey") % fx.n).alias("stem"), F.col("p_name").alias("fn"), F.col("p_partkey").alias("line"), "p_size")
    return sequence.renumber(projections.spans(rows, rows.where("p_size % 4 <> 0")), ["stem"], ["first_line", "fn"])


@query(
    """ SELECT variable, stem, line, n > 10 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY line) AS k, count(*) OVER (PARTITION BY variable) AS n FROM fx_setter) WHERE k <= 10"""
)
def chain_limit(fx):
    """The first 10 setters of each variable, and whether there are more (the limit is the feature)."""
    return projections.first_rows(fx.setter(), ["variable"], ["line"], 10).select("variable", "stem", "line", "truncated")


# --- constants ---

DICTIONARY = """, p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'E::' ELSE '' END || 'K' || (p_partkey % 60) AS key, CAST(p_partkey AS VARCHAR) AS value, p_size % 3 AS rank, p_brand AS path, p_partkey AS seq FROM part),
d AS (SELECT key, arg_min(value, struct_pack(a := rank, b := path, c := seq)) AS value, arg_min(path, struct_pack(a := rank, b := path, c := seq)) AS source_path FROM p GROUP BY key)"""


def dictionary(fx):
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 3 == 0, "E::").otherwise(""), F.lit("K"), (key % 60).cast("string"))
    pairs = fx.table("part").select(name.alias("key"), key.cast("string").alias("value"), (F.col("p_size") % 3).alias("rank"), F.col("p_brand").alias("path"), key.alias("seq"))
    return constants.merge_first(pairs)


@query(DICTIONARY + " SELECT key, value, source_path FROM d")
def const_merge(fx):
    """The dictionary in which the first writer wins."""
    return dictionary(fx)


@query(
    DICTIONARY
    + """, t AS (SELECT o_orderkey AS id, 'x' || (o_orderkey % 4) || ' == E::K' || (o_orderkey % 60) || ' && k' || (o_orderkey % 7) || ' != Q::K' || (o_orderkey % 13) || ' R5' AS s FROM orders),
n AS (SELECT id, list_distinct(list_filter(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_#$@]*(?:::[A-Za-z_][A-Za-z0-9_]*)?'), lambda x: x <> 'R5')) AS names FROM t),
u AS (SELECT id, unnest(names) AS name FROM n)
SELECT id, name, coalesce(f.value, b.value, a.value) AS value FROM u LEFT JOIN d f ON f.key = u.name LEFT JOIN d b ON b.key = string_split(u.name, '::')[-1] AND NOT contains(b.key, '::')
  LEFT JOIN d a ON a.key = upper(u.name) WHERE coalesce(f.value, b.value, a.value) IS NOT NULL"""
)
def const_lookup(fx):
    """Constants named in guard texts: by full name, by last part, in capitals."""
    key = F.col("o_orderkey")
    at = lambda k: (key % k).cast("string")
    text = F.concat(F.lit("x"), at(4), F.lit(" == E::K"), at(60), F.lit(" && k"), at(7), F.lit(" != Q::K"), at(13), F.lit(" R5"))
    texts = fx.table("orders").select(key.alias("id"), text.alias("text"))
    known = keep(dictionary(fx), "dictionary")
    return constants.resolve_tokens(texts, known, known).select("id", "name", "value")


HOPS = """, pr AS (SELECT o_orderkey AS hop, o_custkey AS chain, 's' || (o_orderkey % n) AS stem, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'f' || (o_orderkey % 3) END AS function, CASE WHEN o_orderkey % 5 = 0 THEN 'asm' ELSE 'cpp' END AS file_type FROM orders, fx_n),
cl AS (SELECT DISTINCT 's' || (p_partkey % n) AS stem, 'f' || (p_partkey // n % 3) AS fn, CASE p_partkey // n % 4 WHEN 0 THEN 'A::' WHEN 1 THEN 'B::A::' WHEN 2 THEN '' ELSE 'q' END || 'g' || (p_partkey % 6) AS callee, p_size AS line FROM part, fx_n),
fu AS (SELECT DISTINCT 's' || (p_partkey % n) AS stem, CASE p_partkey // n % 2 WHEN 0 THEN 'A::' ELSE '' END || 'g' || (p_partkey // n % 6) AS fn FROM part, fx_n),
ow AS (SELECT DISTINCT 'G' || (p_partkey % 6) AS name, 's' || (p_partkey % n) AS stem FROM part, fx_n WHERE p_partkey // n % 2 = 0),
nx AS (SELECT *, lead(stem) OVER w AS next_stem, lead(file_type) OVER w AS next_type, coalesce(lead(function) OVER w, '') AS next_function FROM pr WINDOW w AS (PARTITION BY chain ORDER BY hop)),
si AS (SELECT DISTINCT x.hop, x.chain, x.stem, x.next_stem, c.line FROM nx x JOIN cl c ON c.stem = x.stem WHERE x.next_stem IS NOT NULL AND x.file_type = 'cpp' AND (coalesce(x.function, '') = '' OR c.fn = x.function) AND CASE
  WHEN next_function <> '' THEN callee = next_function OR ends_with(callee, '::' || next_function)
  WHEN next_type = 'cpp' THEN EXISTS (SELECT 1 FROM fu WHERE fu.stem = x.next_stem AND (callee = fu.fn OR ends_with(callee, '::' || fu.fn) OR ends_with(fu.fn, '::' || callee)))
  ELSE EXISTS (SELECT 1 FROM ow WHERE ow.stem = x.next_stem AND ow.name = upper(callee)) END)"""


def chain_hops(fx):
    """(hops, calls, functions, owners) of chains: files s0 to s(n-1) with functions f0 to f2 that call g0 to g5."""
    n, key, part = fx.n, F.col("o_orderkey"), F.col("p_partkey")
    parts, nth = fx.table("part"), F.floor(part / n)
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    function = F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "").otherwise(named("f", key % 3))
    hops = fx.table("orders").select(F.col("o_custkey").alias("chain"), key.alias("pos"), named("s", key % n).alias("stem"), F.when(key % 5 == 0, "asm").otherwise("cpp").alias("file_type"), function.alias("function"))
    stem = named("s", part % n).alias("stem")
    calls = parts.select(stem, named("f", nth % 3).alias("fn"), F.concat(text_case(nth % 4, ["A::", "B::A::", "", "q"]), named("g", part % 6)).alias("callee"), F.col("p_size").alias("line")).distinct()
    functions = parts.select(stem, F.concat(text_case(nth % 2, ["A::", ""]), named("g", nth % 6)).alias("fn")).distinct()
    return hops, calls, functions, parts.where(nth % 2 == 0).select(named("G", part % 6).alias("name"), stem).distinct()


@query(HOPS + " SELECT hop, line FROM si")
def entering_sites(fx):
    """Lines at which a chain's C++ files enter the next one: by its function, its functions, or its entry names."""
    hops, calls, functions, owners = chain_hops(fx)
    w = Window.partitionBy("chain").orderBy("pos")
    following = [F.lead(a).over(w).alias(b) for a, b in (("stem", "next_stem"), ("file_type", "next_type"), ("function", "next_function"))]
    pairs = hops.select(F.col("pos").alias("hop"), "stem", "function", "file_type", *following).where("next_stem is not null and file_type = 'cpp'")
    return guards.entering_sites(pairs, calls, functions, owners)


@query(
    HOPS
    + """, sg AS (SELECT 's' || (p_partkey % n) AS stem, p_size AS line, p_partkey AS seq, 'w' || (p_partkey % 8) AS text FROM part, fx_n WHERE p_partkey // n % 3 <> 0),
e AS (SELECT hop, chain, si.stem, next_stem, si.line, count(text) AS n, string_agg(text, ' && ' ORDER BY seq) AS text FROM si LEFT JOIN sg ON sg.stem = si.stem AND sg.line = si.line GROUP BY ALL),
h AS (SELECT hop, chain, stem, next_stem, min(line) AS first, max(line) AS last, count(*) AS sites, bool_or(n = 0) AS open, string_agg(CASE WHEN n > 1 THEN '(' || text || ')' ELSE text END, ' || ' ORDER BY line) AS text FROM e GROUP BY ALL),
g AS (SELECT chain, hop AS seq, 1 AS pos, text, stem || '→' || next_stem AS via, first AS line FROM h WHERE sites > 1 AND NOT open
  UNION ALL SELECT h.chain, h.hop, sg.seq, sg.text, h.stem || '→' || h.next_stem, h.first FROM h JOIN sg ON sg.stem = h.stem AND sg.line = h.first WHERE sites = 1),
az AS (SELECT x.hop, x.chain, x.stem, arg_min(p_size, p_partkey) AS line FROM nx x, fx_n JOIN part ON 's' || (p_partkey % n) = x.stem AND 's' || ((p_partkey // n * 7 + 1) % n) = x.next_stem WHERE x.file_type = 'asm' GROUP BY ALL),
b AS (SELECT chain, stem, max(line) AS bound FROM (SELECT chain, stem, last AS line FROM h UNION ALL SELECT chain, stem, line FROM az) GROUP BY ALL)
SELECT 'guard' AS kind, chain, seq, pos, text, via, line FROM g UNION ALL SELECT 'bound', chain, NULL, NULL, stem, NULL, bound FROM b"""
)
def prefix_guards(fx):
    """What must hold to descend chains, and the line at which each file is left."""
    part, n = F.col("p_partkey"), fx.n
    stem = F.concat(F.lit("s"), (part % n).cast("string")).alias("stem")
    sites = fx.table("part").where(F.floor(part / n) % 3 != 0).select(stem, F.col("p_size").alias("line"), part.alias("seq"), F.concat(F.lit("w"), (part % 8).cast("string")).alias("text"))
    direct = fx.table("part").select(stem, F.concat(F.lit("s"), ((F.floor(part / n) * 7 + 1) % n).cast("string")).alias("next_stem"), part.alias("pos"), F.col("p_size").alias("line"))
    found, bounds = guards.prefix_guards(*chain_hops(fx), sites, direct)
    none = lambda kind: F.lit(None).cast(kind)
    rows = found.select(F.lit("guard").alias("kind"), "chain", "seq", "pos", "text", "via", "line")
    return rows.unionAll(bounds.select(F.lit("bound"), "chain", none("bigint"), none("bigint"), "stem", none("string"), "bound"))


BLOCK_TESTS = ["CLI", "TM", "LTR", "OC"]


@query(
    FILES
    + f""", ev AS (SELECT user_id % n AS node, event_id AS line, CASE WHEN event_type IN ('click', 'view') THEN 'T' WHEN event_type = 'purchase' THEN 'C' WHEN event_type = 'error' THEN 'U' ELSE 'O' END AS kind,
  {sql_case(f'event_id % {len(BLOCK_TESTS)}', BLOCK_TESTS)} AS test, {sql_case(f'event_id % {len(BRANCHES)}', BRANCHES)} AS branch, user_id % n // 8 * 8 + event_id % 8 AS goal, ['F' || (event_id % 3), 'M'] AS args FROM events, fx_n),
lg AS (SELECT *, lag(kind) OVER w AS before_kind, lag(line) OVER w AS trigger_line, lag(test) OVER w AS t_test, lag(args) OVER w AS t_args FROM ev WHERE kind IN ('T', 'C', 'U') WINDOW w AS (PARTITION BY node ORDER BY line)),
pr AS (SELECT node, trigger_line, line, t_test AS test, branch, goal, t_args AS args, t_args[1] AS a0, t_args[2] AS a1 FROM lg WHERE kind = 'C' AND before_kind = 'T'),
arm AS (SELECT d.file, d.target, d.node, d.depth, pr.line, bool_or(e.dst = pr.goal AND x.node IS NOT NULL) AS named, bool_or(e.dst <> pr.goal AND x.node IS NOT NULL) AS other
  FROM dom d JOIN pr ON pr.node = d.node JOIN e ON e.file = d.file AND e.src = d.node LEFT JOIN before x ON x.file = d.file AND x.target = d.target AND x.node = e.dst WHERE d.depth <= 2 GROUP BY ALL),
al AS (SELECT t.target AS id, 0 AS depth, pr.*, false AS taken FROM target t JOIN pr ON pr.node = t.target AND pr.line < 1000
  UNION ALL SELECT arm.target, arm.depth, pr.*, arm.named FROM arm JOIN pr ON pr.node = arm.node AND pr.line = arm.line WHERE named <> other)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY depth, 'N' || node, line) AS INT) AS seq, 'N' || node AS block, {predicate_sql('taken')} AS condition, taken AS polarity, trigger_line AS line, line AS end_line,
  EXISTS (SELECT 1 FROM dom WHERE dom.target = id AND dom.depth > 2) AS truncated FROM al""",
    True,
)
def block_conditions(fx):
    """The conditions of reaching a line of each group's middle block, nearest first."""
    edges, targets = small_graphs(fx)
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    node, key = F.col("user_id") % fx.n, F.col("event_id")
    kind = F.when(F.col("event_type").isin("click", "view"), "T").when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "error", "U").otherwise("O")
    goal = F.concat(F.lit("N"), (F.floor(node / 8) * 8 + key % 8).cast("string"))
    inst = F.when(kind == "C", text_case(key % len(BRANCHES), BRANCHES)).otherwise(text_case(key % len(BLOCK_TESTS), BLOCK_TESTS))
    args = F.when(kind == "C", F.array(goal)).otherwise(F.array(F.concat(F.lit("F"), (key % 3).cast("string")), F.lit("M")))
    flow = fx.table("events").select(F.floor(node / 8).alias("file"), F.concat(F.lit("N"), node.cast("string")).alias("block"), key.alias("line"), inst.alias("inst"), args.alias("args"), kind.alias("kind"))
    points = targets.select(F.col("target").alias("id"), "file", name("target").alias("block"), F.lit(1000).cast("bigint").alias("line"))
    found, flags = guards.block_conditions(flow, edges.select("file", name("src").alias("src"), name("dst").alias("dst")), points, 2)
    return found.join(flags, "id").select("id", "seq", "block", "condition", "polarity", "line", "end_line", "truncated")


@query(
    DICTIONARY
    + """, t AS (SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq, 'v == E::K' || (o_orderkey % 60) || ' && k' || (o_orderkey % 7) || ' != Q::K' || (o_orderkey % 13) AS s FROM orders),
n AS (SELECT id, seq, unnest(list_distinct(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_#$@]*(?:::[A-Za-z_][A-Za-z0-9_]*)?'))) AS name FROM t),
v AS (SELECT id, seq, name, coalesce(f.value, b.value, a.value) AS value FROM n LEFT JOIN d f ON f.key = n.name LEFT JOIN d b ON b.key = string_split(n.name, '::')[-1] AND NOT contains(b.key, '::') LEFT JOIN d a ON a.key = upper(n.name))
SELECT id, seq, string_agg(name || '=' || value, ',' ORDER BY name) AS constants FROM v WHERE value IS NOT NULL GROUP BY id, seq"""
)
def guard_constants(fx):
    """The constants that each of an order's guards names, as a map."""
    key = F.col("o_orderkey")
    at = lambda k: (key % k).cast("string")
    text = F.concat(F.lit("v == E::K"), at(60), F.lit(" && k"), at(7), F.lit(" != Q::K"), at(13))
    rows = sequence.renumber(fx.table("orders").select(F.col("o_custkey").alias("id"), key, text.alias("text")), ["id"], ["o_orderkey"])
    known = keep(dictionary(fx), "dictionary")
    found = guards.constants_of(rows, ("id",), known, known)
    return found.select("id", "seq", F.array_join(F.transform(F.map_entries("constants"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("constants"))


@query(
    """, s AS (SELECT o_custkey AS route, o_orderkey AS pos, 's' || (o_orderkey % 40) AS stem, 'f' || (o_orderkey % 3) AS entry, 'f' || (o_orderkey % 2) AS leaving FROM orders),
i AS (SELECT 's' || (p_partkey % 50) AS stem, 'f' || (p_partkey // 50 % 3) AS entry, 'f' || (p_partkey // 50 % 2) AS leaving, p_partkey AS seq, p_size % 5 AS size, 'i' || p_partkey AS path FROM part),
b AS (SELECT stem, entry, leaving, arg_max(path, struct_pack(a := size, b := -seq)) AS inner_path FROM i GROUP BY ALL)
SELECT route, string_agg(coalesce(inner_path, s.stem), ' > ' ORDER BY pos) AS route_text FROM s LEFT JOIN b ON b.stem = s.stem AND b.entry = s.entry AND b.leaving = s.leaving GROUP BY route"""
)
def route_labels(fx):
    """Routes as text, where a file shows the longest inner path between the functions at which it is entered and left."""
    key, part, nth = F.col("o_orderkey"), F.col("p_partkey"), F.floor(F.col("p_partkey") / 50)
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    routes = fx.table("orders").select(F.col("o_custkey").alias("route"), key.alias("pos"), named("s", key % 40).alias("stem"), named("f", key % 3).alias("entry"), named("f", key % 2).alias("leaving"))
    inner = fx.table("part").select(named("s", part % 50).alias("stem"), named("f", nth % 3).alias("entry"), named("f", nth % 2).alias("leaving"), part.alias("seq"), (F.col("p_size") % 5).alias("size"), named("i", part).alias("path"))
    return projections.label_routes(routes, inner)


# --- traces ---

SET_VALUES = ["E::A", "E::B", "A", "f(E::B)", "x y", "Q::A"]
CALL_GUARDS = ["v0 == E::A", "v1 == E::B && w", "w", "u != 0", "v2 == E::B", "(w)"]

TRACE = f""", tail AS (SELECT chain, CAST(node AS BIGINT) AS node FROM (VALUES (0, 0), (1, 1)) t(chain, node)),
st AS (SELECT o_orderkey AS id, o_custkey % n AS stem, 'v' || (o_orderkey % 5) AS variable, {sql_case('o_orderkey // 5 % 6', SET_VALUES)} AS value, o_orderkey % 7 = 0 AS decl FROM orders, fx_n),
gd AS (SELECT p_partkey % n AS stem, 10 + p_partkey // n AS line, p_partkey AS seq, {sql_case('p_partkey % 6', CALL_GUARDS)} AS text FROM part, fx_n
  UNION ALL SELECT o_custkey % n, o_orderkey, 1, CASE WHEN o_orderkey % 2 = 0 THEN 'w' ELSE 'own' END FROM orders, fx_n WHERE o_orderkey % 3 = 0),
dp AS (SELECT o_orderkey AS setter, 'v' || (o_orderkey // 7 % 5) AS child FROM orders WHERE o_orderkey % 11 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey // 7 % 5 < 3)),
rc(chain, node) AS (SELECT * FROM tail UNION SELECT chain, dst FROM fx_call JOIN rc ON src = node),
p(chain, dst, nodes) AS (SELECT chain, node, [node] FROM tail UNION ALL SELECT chain, c.dst, list_append(nodes, c.dst) FROM p JOIN fx_call c ON c.src = p.dst AND c.src <> c.dst WHERE len(nodes) <= 3 AND NOT list_contains(nodes, c.dst)),
cut AS (SELECT chain FROM p WHERE len(nodes) = 3 GROUP BY chain, dst HAVING count(*) > 16),
pk AS (SELECT chain, dst, nodes, k, len(nodes) > 1 AND (n > 4 OR chain IN (SELECT chain FROM cut)) AS tr
  FROM (SELECT *, row_number() OVER (PARTITION BY chain, dst ORDER BY nodes) AS k, count(*) OVER (PARTITION BY chain, dst) AS n FROM p) WHERE k <= 4),
far AS (SELECT DISTINCT chain, dst FROM pk WHERE len(nodes) > 3 OR tr),
by_(chain, node) AS (SELECT chain, c.dst FROM far JOIN fx_call c ON c.src = far.dst AND c.src <> c.dst UNION SELECT chain, c.dst FROM by_ JOIN fx_call c ON c.src = node),
tu AS (SELECT rc.chain, st.id, st.stem, st.variable, st.value, coalesce(k, 0) AS k, nodes, coalesce(tr OR by_.node IS NOT NULL, true) AS truncated
  FROM st JOIN rc ON rc.node = st.stem LEFT JOIN pk ON pk.chain = rc.chain AND pk.dst = st.stem LEFT JOIN by_ ON by_.chain = rc.chain AND by_.node = st.stem),
hp AS (SELECT chain, dst, k, nodes, unnest(range(1, len(nodes))) AS i FROM pk),
along AS (SELECT hp.chain, hp.dst AS stem, hp.k, hp.i, gd.seq, gd.text FROM hp JOIN fx_call c ON c.src = nodes[i] AND c.dst = nodes[i + 1] JOIN gd ON gd.stem = c.src AND gd.line = c.line),
raw AS (SELECT tu.chain, tu.id, tu.k, 1 AS section, a.i, a.seq, a.text FROM tu JOIN along a ON a.chain = tu.chain AND a.stem = tu.stem AND a.k = tu.k
  UNION ALL SELECT tu.chain, tu.id, tu.k, 2, gd.seq, 0, gd.text FROM tu JOIN gd ON gd.stem = tu.stem AND gd.line = tu.id),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain, id, k, text ORDER BY section, i, seq) AS nth FROM raw) WHERE nth = 1),
cj AS (SELECT DISTINCT chain, id, k, {normal_sql('part')} AS normal FROM (SELECT chain, id, k, unnest(string_split(text, '&&')) AS part FROM one WHERE contains(text, '&&'))),
fin AS (SELECT o.* FROM one o LEFT JOIN cj ON NOT contains(o.text, '&&') AND cj.chain = o.chain AND cj.id = o.id AND cj.k = o.k AND cj.normal = {normal_sql('o.text')} WHERE cj.id IS NULL),
rq AS (SELECT chain, id, k, string_split(text, ' ')[1] AS scrutinee, arg_min(string_split(text, ' ')[3], struct_pack(a := section, b := i, c := seq)) AS need FROM fin WHERE regexp_full_match(text, 'v[0-9] == E::[AB]') GROUP BY ALL),
free AS (SELECT st.* FROM st WHERE NOT decl AND contains(value, '::') AND NOT contains(value, ' ') AND right(value, 1) <> ')' AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.stem = st.stem AND gd.line = st.id)),
lastset AS (SELECT stem, variable, arg_max(value, id) AS value FROM free GROUP BY ALL),
asg AS (SELECT rq.chain, rq.id, rq.k, rq.scrutinee, any_value(rq.need) AS need, arg_max(f.value, hp.i) AS last FROM rq JOIN tu USING (chain, id, k) JOIN hp ON hp.chain = rq.chain AND hp.dst = tu.stem AND hp.k = rq.k
  JOIN lastset f ON f.stem = hp.nodes[hp.i + 1] AND f.variable = rq.scrutinee GROUP BY ALL),
gone AS (SELECT DISTINCT chain, id, k FROM asg WHERE string_split(need, '::')[-1] <> string_split(last, '::')[-1]),
gt AS (SELECT chain, id, k, string_agg(text, ' && ' ORDER BY section, i, seq) AS guards FROM fin GROUP BY ALL),
en AS (SELECT tu.*, guards FROM tu LEFT JOIN gt USING (chain, id, k) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.chain = tu.chain AND g.id = tu.id AND g.k = tu.k)),
nd AS (SELECT DISTINCT chain, variable, child, stem, id FROM en JOIN dp ON setter = id),
dq(chain, variable, depth) AS (SELECT chain, 'v0', 0 FROM tail UNION SELECT dq.chain, child, depth + 1 FROM dq JOIN nd ON nd.chain = dq.chain AND nd.variable = dq.variable WHERE depth < 2),
dm AS (SELECT chain, variable, min(depth) AS depth FROM dq GROUP BY ALL)"""


def traced(fx) -> Trace:
    """v0 and what it depends on, one step, from the files 0 and 1; at most 4 paths of 3 calls for each file."""
    n, key, part = fx.n, F.col("o_orderkey"), F.col("p_partkey")
    orders, parts = fx.table("orders"), fx.table("part")
    name = lambda c: F.concat(F.lit("v"), (c % 5).cast("string"))
    stem, by_seven = F.col("o_custkey") % n, F.floor(key / 7)
    setters = orders.select(key.alias("id"), stem.alias("stem"), key.alias("line"), name(key).alias("variable"), F.lit("cpp").alias("language"), text_case(F.floor(key / 5) % 6, SET_VALUES).alias("value"), (key % 7 == 0).alias("is_declaration"))
    guards_ = parts.select((part % n).alias("stem"), (10 + F.floor(part / n)).alias("line"), part.alias("seq"), text_case(part % 6, CALL_GUARDS).alias("text"))
    guards_ = guards_.unionAll(orders.where(key % 3 == 0).select(stem, key, F.lit(1).cast("bigint"), F.when(key % 2 == 0, "w").otherwise("own")))
    needs = orders.where((key % 11 == 0) & ((key % 5 == 0) | (by_seven % 5 < 3))).select(key.alias("setter"), name(by_seven).alias("variable"))
    tails = fx.spark.createDataFrame([(0, 0), (1, 1)], "chain int, node bigint")
    inputs = Inputs(keep(fx.call(), "call"), keep(setters, "setters"), keep(guards_, "guards"), keep(needs, "needs"))
    return trace_chains(inputs, "v0", tails, Bounds(paths=4, path_edges=3, depth=1, each_site=True))


@query(
    TRACE
    + """ SELECT en.chain, en.variable, dm.depth, en.id, array_to_string(nodes, '>') AS path, guards, truncated, guards IS NULL AND NOT truncated AS unconditional FROM en JOIN dm ON dm.chain = en.chain AND dm.variable = en.variable WHERE dm.depth <= 1""",
    True,
)
def trace_setters(fx):
    """G12 with J2, F1, G1, G3, J22, U-2, A18, F8, G16, W5, A1, O6: setters on each path of two chains, and what must hold."""
    return traced(fx).setters.select("chain", "variable", "depth", "id", "path", "guards", "truncated", "unconditional")


@query(
    TRACE
    + """, ed AS (SELECT DISTINCT nd.chain, nd.variable FROM nd JOIN dm ON dm.chain = nd.chain AND dm.variable = nd.variable AND dm.depth <= 1),
ct AS (SELECT chain, variable, count(*) AS setters FROM en GROUP BY ALL)
SELECT dm.chain, dm.variable AS name, CASE WHEN dm.variable = 'v0' THEN 'root' ELSE 'dependent' END AS role, depth <= 1 AND ed.variable IS NULL AND dm.variable <> 'v0' AS terminal, depth > 1 AS truncated,
  CASE WHEN depth <= 1 THEN coalesce(setters, 0) ELSE 0 END AS setters, CASE WHEN depth <= 1 AND setters > 0 THEN depth END AS first_depth
FROM dm LEFT JOIN ed ON ed.chain = dm.chain AND ed.variable = dm.variable LEFT JOIN ct ON ct.chain = dm.chain AND ct.variable = dm.variable""",
    True,
)
def trace_nodes(fx):
    """The variables of two traces: root, dependent, terminal, and those beyond the greatest depth."""
    return lineage_graph(traced(fx), "v0")[0]


# --- classes of terminals, the dictionary of texts ---

MARKED = ["FINWC", "IMSG", "nothing", "GETFC AM0SG"]
KNOWN = f""", nd AS (SELECT {sql_case('p_partkey % 6', NAMES)} || p_partkey AS name, p_partkey % 23 = 0 AS external, p_partkey % 2 = 0 AS member, CASE WHEN p_partkey % 2 = 0 THEN {sql_case('p_partkey // 2 % 6', NAMES)} END AS member_name, p_partkey AS p, n FROM part, fx_n),
rd AS (SELECT DISTINCT name, stem FROM (SELECT name, 's' || (p * 3 % n) AS stem FROM nd UNION ALL SELECT name, 's' || ((p * 5 + 1) % n) FROM nd WHERE p % 3 = 0)),
hm AS (SELECT name, stem FROM rd UNION SELECT name, 's' || (p % n) FROM nd WHERE p % 4 = 0),
ev AS (SELECT 's' || s_suppkey AS stem, s_suppkey % 4 IN (0, 3) AS db, s_suppkey % 4 IN (1, 3) AS inp, 'DR' || (s_suppkey % 50) || 'XX' AS token FROM supplier WHERE s_suppkey % 3 <> 1),
el AS (SELECT name, bool_or(db) AS db, bool_or(inp) AS inp, string_agg(stem, ',' ORDER BY stem) FILTER (WHERE db) AS dbs, string_agg(stem, ',' ORDER BY stem) FILTER (WHERE inp) AS ins FROM hm JOIN ev USING (stem) GROUP BY name),
tk AS (SELECT name, min(stem) AS stem FROM nd JOIN ev ON db AND token = 'DR' || (p % 50) || 'XX' WHERE member GROUP BY name),
ca AS (SELECT DISTINCT 's' || src AS stem, 'mo' || (dst % 30 + 10) AS callee FROM fx_call WHERE dst % 3 = 0),
ms AS (SELECT name, string_agg(DISTINCT callee, ',' ORDER BY callee) AS missing FROM rd JOIN ca USING (stem) GROUP BY name),
cs AS (SELECT nd.name, el.dbs, el.ins, coalesce(el.db, false) AS db, coalesce(el.inp, false) AS inp, tk.stem AS tks, ms.missing, CASE WHEN external THEN 'external' WHEN p % 13 = 0 OR p % 17 = 0 THEN 'constant'
  WHEN regexp_matches(upper(nd.name), '^(MI0|AM0)') OR regexp_matches(upper(coalesce(member_name, '')), '^(MI0|AM0)') THEN 'user_input' WHEN regexp_matches(upper(nd.name), '^(EBW|EBX|EBC|CE1|WK_)') THEN 'working_storage'
  WHEN member AND (coalesce(el.db, false) OR tk.stem IS NOT NULL) THEN 'database' WHEN NOT member AND coalesce(el.inp, false) THEN 'user_input' WHEN member THEN 'record_field' ELSE 'unresolved' END AS class
  FROM nd LEFT JOIN el USING (name) LEFT JOIN tk USING (name) LEFT JOIN ms USING (name)),
ct AS (SELECT name, class, CASE WHEN class = 'database' AND db THEN dbs WHEN class = 'database' THEN tks WHEN class = 'user_input' AND inp THEN ins END AS evidence, CASE WHEN class IN ('external', 'unresolved') THEN missing END AS missing FROM cs)"""


def judged_terminals(fx):
    n, key = fx.n, F.col("p_partkey")
    file = lambda c: F.concat(F.lit("s"), c.cast("string"))
    name = F.concat(text_case(key % 6, NAMES), key.cast("string")).alias("name")
    part, supplier, number = fx.table("part"), fx.table("supplier"), F.col("s_suppkey")
    nodes_ = part.select(name, (key % 23 == 0).alias("external"), (key % 2 == 0).alias("member"), F.when(key % 2 == 0, text_case(F.floor(key / 2) % 6, NAMES)).alias("member_name"), F.when(key % 4 == 0, F.upper(file(key % n))).alias("home"))
    readers = part.select(name, file(key * 3 % n).alias("stem")).unionAll(part.where(key % 3 == 0).select(name, file((key * 5 + 1) % n))).distinct()
    sections = part.where(key % 2 == 0).select(name, F.concat(F.lit("dr"), (key % 50).cast("string"), F.lit("xx")).alias("section"))
    text = F.concat(F.lit("CALL "), text_case(number % 4, MARKED), F.lit("\n DR"), (number % 50).cast("string"), F.lit("XX end"))
    sources = supplier.select(file(number).alias("stem"), text_case(number % 3, ["asm", "cpp", "mac"]).alias("ext"), text.alias("text"))
    callees = fx.call().where("dst % 3 = 0").select(file(F.col("src")).alias("stem"), F.concat(F.lit("mo"), (F.col("dst") % 30 + 10).cast("string")).alias("callee")).distinct()
    cpp, asm = part.where(key % 17 == 0).select(name.alias("key")), part.where(key % 13 == 0).select(F.upper(name).alias("key"))
    return lineage.classify_nodes(nodes_, readers, sections, lineage.evidence(sources), cpp, asm, callees)


@query(KNOWN + " SELECT * FROM ct")
def job_terminals(fx):
    """Where the values of terminals come from, by what is known of the files that read
    them, and which missing modules these call."""
    return judged_terminals(fx)


@query(
    KNOWN
    + """, r AS (SELECT unnest(string_split(missing, ',')) AS name FROM ct WHERE missing IS NOT NULL)
SELECT name, count(*) AS n, CASE WHEN name = 'mo12' THEN 'module' WHEN regexp_matches(name, '[0-9]') THEN 'module' ELSE 'library' END AS kind FROM r GROUP BY name"""
)
def missing_callees(fx):
    """Missing modules by how many terminals they may define."""
    return job.missing_report(judged_terminals(fx), fx.spark.createDataFrame([("mo12",)], "stem string"))


@query(
    """, t AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS path, p_partkey % 4 AS ext, p_partkey AS p, p_size FROM part),
pr AS (SELECT 'cpp' AS language, 0 AS rank, 'b' || s_suppkey AS path, 0 AS pos, 0 AS spelling, 'A' || (s_suppkey % 20) AS key, CAST(s_suppkey AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT 'cpp', 1, path, pos, sp, CASE WHEN sp = 0 THEN '' WHEN sp = 1 THEN 'E' || (p % 9) || '::' WHEN sp = 2 THEN 'S::' ELSE 'S::E' || (p % 9) || '::' END || CASE pos WHEN 0 THEN 'A' || (p % 31) WHEN 1 THEN 'B' || (p % 7) ELSE 'C' END,
    CASE pos WHEN 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + pos AS VARCHAR) END FROM t, range(3) x(pos), range(4) y(sp) WHERE ext < 2 AND (sp < 2 OR ext = 1)
  UNION ALL SELECT 'asm', 0, path, 0, 0, 'K' || (p % 13), CAST(p_size AS VARCHAR) FROM t WHERE ext = 2 UNION ALL SELECT 'asm', 0, path, 1, 0, 'V' || (p % 5), 'F''' || p_size || '''' FROM t WHERE ext >= 2)
SELECT language, key, arg_min(value, struct_pack(a := rank, b := path, c := pos, d := spelling)) AS value, arg_min(path, struct_pack(a := rank, b := path, c := pos, d := spelling)) AS source_path FROM pr GROUP BY language, key"""
)
def const_dictionary(fx):
    """The dictionary of blueprints and of C++ and assembler texts."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    digit = lambda c: c.cast("string")
    enum = F.concat(F.lit("enum class E"), digit(key % 9), F.lit(" { A"), digit(key % 31), F.lit(" = "), size, F.lit(", // first\n B"), digit(key % 7), F.lit(", /* , X = 3 */ C };"))
    asm = lambda word: F.concat(F.lit(word), F.lit("V"), digit(key % 5), F.lit("&T DC F'"), size, F.lit("' text"))
    equ = F.concat(F.lit("k"), digit(key % 13), F.lit(" EQU "), size, F.lit(" note\nW DS CL4\n"))
    text = F.when(key % 4 == 0, enum).when(key % 4 == 1, F.concat(F.lit("struct S : T { int f(); "), enum, F.lit(" };"))).when(key % 4 == 2, F.concat(equ, asm(""))).otherwise(asm("* note\n"))
    sources = fx.table("part").select(F.concat(F.lit("p"), F.lpad(digit(key), 8, "0")).alias("path"), text_case(key % 4, ["cpp", "hpp", "asm", "mac"]).alias("ext"), text.alias("text"))
    number = F.col("s_suppkey")
    blueprints = fx.table("supplier").where(number % 3 == 0).select(F.concat(F.lit("b"), digit(number)).alias("path"), F.concat(F.lit("A"), digit(number % 20)).alias("key"), digit(number).alias("value"))
    found = constants.dictionary(blueprints, sources)
    tag = lambda language, df: df.select(F.lit(language).alias("language"), "key", "value", "source_path")
    return tag("cpp", found.cpp).unionAll(tag("asm", found.asm))
