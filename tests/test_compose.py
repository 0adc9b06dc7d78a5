"""Composed operators by hand-made cases: prefix guards, block conditions, not-set conditions, traces, the job."""

import dataclasses

import pytest

from backtrail.operators import constants, graph, guards, lineage
from backtrail.plans import job, trace
from backtrail.sources import cache

CALLS = "src string, dst string, line long"
SETTERS = "id long, stem string, line long, variable string, language string, value string, is_declaration boolean"
GUARDS = "stem string, line long, seq long, text string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_prefix_guards_of_assembler_callers(spark):
    hops = frame(spark, [(1, 0, "aa", "asm", None), (1, 1, "bb", "asm", None), (1, 2, "cc", "cpp", "f"), (1, 3, "dd", "asm", None)], "chain long, pos long, stem string, file_type string, function string")
    calls = frame(spark, [("cc", "f", "dd", 7), ("cc", "f", "DD", 9), ("cc", "g", "dd", 1), ("cc", "f", "other", 2)], "stem string, fn string, callee string, line long")
    none = frame(spark, [], "stem string, fn string")
    owners = frame(spark, [], "name string, stem string")
    sites = frame(spark, [("cc", 7, 1, "p"), ("cc", 7, 2, "q"), ("cc", 9, 1, "r")], GUARDS)
    asm_sites = frame(spark, [("aa", "bb", 5, 40), ("aa", "bb", 2, 30), ("bb", "cc", 1, 50)], "stem string, next_stem string, pos long, line long")
    schema = "stem string, line long, seq long, text string, test string, branch string, args array<string>, note string, block string, branch_line long"
    asm_guards = frame(spark, [("aa", 30, 1, None, "TM FLD,X'40' remark", "JNO", ["R1", "there"], None, "THERE", 28), ("aa", 30, 2, None, "CLI A,B", "BE", ["x"], "skip", None, 29), ("aa", 30, 3, " a  == b ", None, None, None, None, None, None), ("aa", 40, 1, "no", None, None, None, None, None, None)], schema)
    triggers = frame(spark, [("aa", "tm", "fld", 20), ("aa", "TM", "FLD", 26), ("aa", "TM", "OTHER", 27), ("aa", "TM", "FLD", 29)], "stem string, inst string, operand string, line long")
    found, bounds = guards.prefix_guards(hops, calls, none, owners, sites, asm_sites, asm_guards, triggers)
    got = [(r["seq"], r["pos"], r["text"], r["via"], r["line"], r["end_line"]) for r in found.orderBy("seq", "pos").collect()]
    assert got == [(0, 1, "(FLD & X'40') != X'40'", "aa→bb@30", 26, 28), (0, 3, "a == b", "aa→bb@30", 30, 30), (2, 1, "(p && q) || r", "cc→dd", 7, 7)]
    assert {(r["stem"], r["bound"]) for r in bounds.collect()} == {("aa", 30), ("bb", 50), ("cc", 9)}


def test_block_conditions_and_not_set(spark):
    flow = [("f", "A", 1, "CLI", ["F", "1"], "T"), ("f", "A", 2, "BE", ["X"], "C"), ("f", "X", 3, "TM", ["G", "M"], "T"), ("f", "X", 4, "JO", ["away"], "C"), ("f", "X", 6, "CLI", ["H", "2"], "T"), ("f", "X", 9, "BE", ["Z"], "C")]
    flow = frame(spark, flow, "file string, block string, line long, inst string, args array<string>, kind string")
    edges = frame(spark, [("f", "A", "x"), ("f", "A", "B"), ("f", "x", "Y")], "file string, src string, dst string").replace("x", "X")
    points = frame(spark, [(1, "f", "X", 8), (2, "f", "Y", 20), (3, "f", "A", 1)], "id long, file string, block string, line long")
    for file_edges in (0, 10**6):
        found, flags = guards.block_conditions(flow, edges, points, 16, file_edges)
        got = [(r["id"], r["seq"], r["condition"], r["polarity"], r["line"], r["end_line"]) for r in found.orderBy("id", "seq").collect()]
        assert got == [(1, 1, "(G & M) != M", False, 3, 4), (1, 2, "F == 1", True, 1, 2), (2, 1, "(G & M) != M", False, 3, 4), (2, 2, "H != 2", False, 6, 9), (2, 3, "F == 1", True, 1, 2)]
        assert {r["id"]: r["truncated"] for r in flags.collect()} == {1: False, 2: False, 3: False}
    near, cut = guards.block_conditions(flow, edges, points, 1)
    assert {r["id"] for r in cut.where("truncated").collect()} == {2}
    assert near.where("id = 2").count() == 2

    setters = frame(spark, [("one", 1, 8), ("all", 1, 8), ("all", 3, 1), ("none", 1, 0)], "group string, id long, line long")
    texts, status = guards.not_set_conditions(setters, found, flags)
    assert {r["group"]: r["status"] for r in status.collect()} == {"one": "ok", "all": "unconditional", "none": "no_function"}
    assert [(r["group"], r["text"], r["line"]) for r in texts.collect()] == [("one", "(G & M) == M || F != 1", 8)]


def inputs(spark, calls, setters, guard_rows, needs, **more):
    rows = [(i, stem, line, v, "cpp", value, decl) for i, stem, line, v, value, decl in setters]
    return trace.Inputs(frame(spark, calls, CALLS), frame(spark, rows, SETTERS), frame(spark, guard_rows, GUARDS), frame(spark, needs, "setter long, variable string"), **more)


@pytest.fixture(scope="module")
def traced(spark):
    """Four unconnected programs, whose files begin with A to D, traced as four chains of one plan."""
    calls = [("Aa::m", "Ab::f", 1), ("Aa::m", "Ab::f", 2), ("Ba::m", "Ba::p", 1), ("Ba::p", "Bb::f", 2), ("Ba::m", "Ba::q", 3), ("Ba::q", "Bb::f", 4), ("Cb", "Cc", 1), ("Da::m", "Da::p", 1), ("Da::p", "Db::f", 2), ("Da::m", "Db::f", 3)]
    setters = [
        (10, "Ab::f", 10, "V", "1", False),
        (21, "Bb::f", 10, "V", "1", False), (22, "Ba::p", 20, "mode", "E::X", False), (23, "Ba::q", 30, "mode", "E::X", False), (24, "Ba::q", 31, "mode", "E::Y", True),
        (1, "Cc", 5, "V", "1", False), (2, "Cd", 6, "V", "2", False), (3, "Ce", 7, "V", "3", False), (4, "Ctop", 3, "W", "4", False), (5, "Ctop", 30, "W", "5", False), (6, "Ctop", 2, "V", "6", False),
        (40, "Db::f", 10, "V", "1", False),
    ]
    guard_rows = [("Aa", 1, 1, "g"), ("Aa", 2, 1, "h && k"), ("Aa", 2, 2, "k"), ("Bb", 10, 1, "p.mode == E::Y"), ("Ba", 30, 1, "maybe"), ("Cb", 1, 1, "g"), ("Cb", 2, 1, "h")]
    given = inputs(
        spark, calls, setters, guard_rows, [(21, "mode"), (23, "deep"), (1, "W")], file_calls=frame(spark, [("Cb", "Cd", 2, True), ("Cb", "Ce", 3, False)], CALLS + ", verified boolean"),
        hops=frame(spark, [(2, 0, "Ctop", "cpp", "f"), (2, 1, "Cb", "asm", None)], "chain int, pos long, stem string, file_type string, function string"),
        prefix=frame(spark, [(2, 0, 1, "up", "Ctop→Cb")], "chain int, seq long, pos long, text string, via string"), upstream=frame(spark, [(2, "Ctop", 10)], "chain int, stem string, bound long"),
        cut_guards=frame(spark, [("Cd", 6)], "stem string, line long"), not_set=frame(spark, [(90, "Cc", 5, "V", "cpp", 1, "!(g)")], "id long, stem string, line long, variable string, language string, seq long, text string"),
    )
    tails = frame(spark, [(0, "Aa::m"), (1, "Ba::m"), (2, "Cb"), (3, "Da::m")], "chain int, node string")
    found = trace.trace_chains(given, "V", tails, trace.Bounds(each_site=True))
    return found, found.setters.collect()


def of(traced, chain):
    return [r for r in traced[1] if r["chain"] == chain]


def test_each_site_gives_a_path(traced):
    assert sorted((r["guards"], r["chain_text"], r["unconditional"]) for r in of(traced, 0)) == [("g", "Aa::m > Ab::f", False), ("h && k", "Aa::m > Ab::f", False)]


def test_routes_that_cant_be_are_dropped(traced):
    assert [r["chain_text"] for r in of(traced, 1) if r["variable"] == "V"] == ["Ba::m > Ba::q > Bb::f"]
    assert {(r["parent"], r["child"]) for r in traced[0].edges.where("chain = 1").collect()} == {("V", "mode"), ("mode", "deep")}
    nodes, _ = trace.lineage_graph(traced[0], "V")
    assert {(r["name"], r["role"], r["terminal"], r["truncated"]) for r in nodes.where("chain = 1").collect()} == {("V", "root", False, False), ("mode", "dependent", False, False), ("deep", "dependent", True, False)}


def test_fallback_unverified_upstream_and_prefix(traced):
    got = of(traced, 2)
    rows = {r["id"]: (r["variable"], r["path"], r["chain_text"], r["guards"], r["truncated"], r["via_unverified"], r["is_not_set"], r["depth"]) for r in got}
    assert rows == {
        1: ("V", "Cb>Cc", "Ctop::f > Cb > Cc", "up && g", False, False, False, 0), 2: ("V", "Cb>Cd", "Ctop::f > Cb > Cd", "up && h", True, False, False, 0), 3: ("V", None, "Ctop::f > Cb > Ce", "up", False, True, False, 0),
        90: ("V", "Cb>Cc", "Ctop::f > Cb > Cc", "up && g && !(g)", False, False, True, 0), 4: ("W", None, "Ctop::f > Cb", None, False, False, False, 1),
    }
    assert {r["id"]: r["value"] for r in got}[90] == "[not set]"
    assert not any(r["unconditional"] for r in got if r["id"] in (1, 2, 3, 90))


def test_equal_results_are_one(traced):
    # the same files, guards and calls: the richest chain stays
    assert [(r["chain_text"], r["unconditional"]) for r in of(traced, 3)] == [("Da::m > Da::p > Db::f", True)]
    assert not traced[0].reached_depth


def test_depth_is_flagged(spark):
    given = inputs(spark, [("a", "b", 1)], [(1, "b", 1, "V", "W", False), (2, "b", 2, "W", "X", False)], [], [(1, "W"), (2, "X")])
    got = trace.trace(given, "V", "a", trace.Bounds(depth=0))
    assert got.reached_depth
    assert [r["variable"] for r in got.truncated.collect()] == ["W"]
    assert {r["variable"] for r in got.setters.collect()} == {"V"}


def facts(spark):
    known = constants.Dictionary(frame(spark, [("K", "1", "p")], "key string, value string, source_path string"), frame(spark, [], "key string, value string, source_path string"))
    return job.Facts(
        frame(spark, [("X", True, False, None, None)], "name string, external boolean, member boolean, member_name string, home string"), frame(spark, [], "name string, section string"),
        frame(spark, [("b", "asm", "x")], "stem string, ext string, text string"), known, frame(spark, [("b", "zz99")], "stem string, callee string"), frame(spark, [], "stem string"),
    )


def test_whole_job(spark, tmp_path):
    given = inputs(spark, [("a", "b", 1)], [(1, "b", 1, "V", "X + K", False)], [], [(1, "X"), (1, "K"), (1, "SCRATCH1")])
    done = job.run_lineage(spark, given, "V", {"cpp": ["a", "b"], "asm": ["a"]}, facts(spark), str(tmp_path), {"scratch_prefixes": ["scratch"], "input_msg_prefixes": []})
    assert (done["status"], done["chains_traced"], done["chain_errors"]) == ("success", 3, 0)
    assert done["terminals_by_class"] == {"external": 3, "constant": 3}
    assert [(r["name"], r["n"], r["kind"]) for r in done["missing_top"]] == [("zz99", 3, "module")]
    rows = spark.read.json(f"{tmp_path}/classified")
    assert {(r["language"], r["name"], r["class"]) for r in rows.collect()} == {("cpp", "X", "external"), ("cpp", "K", "constant"), ("asm", "X", "external"), ("asm", "K", "constant")}
    assert job.options({"input_msg_prefixes": [], "db_read_markers": ["q"]}).db_read_markers == ("Q",)
    assert job.options({"input_msg_prefixes": []}).input_msg_prefixes == lineage.INPUT_MSG_PREFIXES


def test_job_failures(spark, tmp_path):
    broken = dataclasses.replace(inputs(spark, [("a", "b", 1)], [], [], []), setters=frame(spark, [], "id long"))
    job_ = job.run(broken, "V", {"cpp": ["a"]})
    assert list(job_.errors) == [("cpp", 0)]
    assert job.run_lineage(spark, broken, "V", {"cpp": ["a"]}, facts(spark), str(tmp_path))["chain_errors"] == 1
    assert job.run_lineage(spark, None, "V", {}, None, str(tmp_path))["status"] == "failed"
    late = job.run(inputs(spark, [("a", "b", 1)], [], [], []), "V", {"cpp": ["a"]}, job.Options(seconds=-1.0))
    assert late.warnings == ["time is up before chain 0 of cpp"]
    with pytest.raises(ValueError):
        trace.languages(frame(spark, [("cpp", "v")], "language string, name string"), "v", "ada")


def test_audit_of_functions(spark):
    edges = frame(spark, [("A", "f", "a", "g"), ("A", "f", "b", "x"), ("A", "f", "c", "y"), ("A", "f", "c", "y"), ("A", "f", "A", "f")], "stem string, fn string, callee_stem string, callee_fn string")
    got = lineage.unknown_functions(edges, frame(spark, [("b",)], "stem string")).collect()
    assert [tuple(r) for r in got] == [("A", "f", "c", "y")] * 2
    errors: dict = {}
    empty = frame(spark, [], "id string")
    report = job.audit(empty, frame(spark, [], "src string, dst string"), frame(spark, [], "stem string"), empty, functions=edges, errors=errors)
    assert {r["check"]: r["n"] for r in report.collect()} == {"dangling": 0, "no_blueprint": 0, "unknown_function": 3}
    assert list(errors) == ["no_owner"]


def test_dictionary_is_kept(spark, tmp_path):
    bp, src = tmp_path / "bp", tmp_path / "src"
    bp.mkdir()
    src.mkdir()
    (bp / "x.hpp.json").write_text('{"enum_values": {"A": {"enum_type": "E", "value": "9"}}}')
    (src / "y.cpp").write_text("enum E { A = 1, B };")
    (src / "z.asm").write_text("k1 EQU 5\n")
    first = constants.get_dictionary(spark, str(bp), str(src), str(tmp_path / "cache"))
    assert {r["key"]: r["value"] for r in first.cpp.collect()} == {"A": "9", "E::A": "9", "B": "2", "E::B": "2"}
    assert [(r["id"], r["value"]) for r in first.resolve(frame(spark, [(1, "Q::B"), (2, "K1"), (3, "none")], "id long, name string")).orderBy("id").collect()] == [(1, "2"), (2, "5"), (3, None)]
    assert {r["name"] for r in first.bare_names().collect()} == {"A", "B"}
    again = constants.get_dictionary(spark, str(bp), str(src), str(tmp_path / "cache"))
    assert again.cpp.inputFiles() == first.cpp.inputFiles()
    (src / "y.cpp").write_text("enum E { A = 1, B = 70 };")
    assert {r["key"]: r["value"] for r in constants.get_dictionary(spark, str(bp), str(src), str(tmp_path / "cache")).cpp.collect()}["B"] == "70"


def test_scopes(spark):
    found = lambda text: [(e, s, n, v) for e, s, _, _, n, v in constants.enumerators(text)]
    assert found("namespace N { class C : public D { enum class E : int { A, B = 'x' , C=f(1) }; }; } enum { Z }") == [("E", "N::C", "A", None), ("E", "N::C", "B", "'x'"), ("E", "N::C", "C", "f(1)"), (None, None, "Z", None)]
    assert found("struct S; void f() { enum Q { R }; } struct T { enum U { V") == [("Q", None, "R", None), ("U", "T", "V", None)]
    assert found("enum E { A = 1 } x; }} enum F { B };") == [("E", None, "A", "1"), ("F", None, "B", None)]
    assert found("") == []


def test_immediate_dominators():
    assert graph.immediate_dominators({1: [2, 3], 2: [4], 3: [4], 4: [5], 5: [4]}, {2: [1], 3: [1], 4: [2, 3, 5], 5: [4]}) == {1: None, 2: 1, 3: 1, 4: 1, 5: 4}
    assert graph.immediate_dominators({1: [3], 2: [3]}, {3: [1, 2]}) == {1: None, 2: None, 3: None}


def test_trace_is_kept(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return inputs(spark, [("a", "b", 1)], [(1, "b", 1, "V", "1", False)], [], [])

    first = trace.cached_trace(spark, "s", build, "V", ["a"], root=str(tmp_path))
    again = trace.cached_trace(spark, "s", build, "V", ["a"], root=str(tmp_path))
    assert [tuple(r) for r in first.setters.collect()] == [tuple(r) for r in again.setters.collect()]
    assert len(built) == 1
    assert cache.arguments_key({"salt": "s", "tails": ["a"]}) != cache.arguments_key({"salt": "t", "tails": ["a"]})
