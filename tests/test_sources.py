import gzip
import json

import pytest

from backtrail.plans import trace
from backtrail.sources import cache, files


def test_texts_and_listing(spark, tmp_path):
    (tmp_path / "a.asm").write_bytes(b"X EQU 1\n\xff")
    (tmp_path / "b.mac.gz").write_bytes(gzip.compress(b"Y EQU 2\n"))
    (tmp_path / "c.txt").write_text("no")
    rows = {(r["stem"], r["ext"]): r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a", "asm"), ("b", "mac")}
    assert rows["b", "mac"] == "Y EQU 2\n"
    assert [r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.asm"]


def test_enum_blueprints(spark, tmp_path):
    (tmp_path / "a.cpp.json").write_text(json.dumps({"enum_values": {"A": {"enum_type": "E", "value": "1"}, "B": {"enum_type": "E", "value": None}}, "other": [1]}))
    (tmp_path / "b.cpp.json").write_text("{broken")
    assert sorted((r["key"], r["value"]) for r in files.enum_blueprints(spark, str(tmp_path)).collect()) == [("A", "1"), ("E::A", "1")]


def test_flow_of_both_layouts(spark):
    block = {"id": "b", "start_line": 1, "end_line": 9}
    listed = {"blocks": [block | {"flow": [{"line": 1, "inst": "cli", "args": ["A", "B"]}, {"line": 2, "inst": "be", "args": ["X"]}]}]}
    columnar = {"blocks": [block | {"flow": {"line": [1, 2], "inst": ["cli", "be"], "args": [["A", "B"], ["X"]]}}]}
    rows = spark.createDataFrame([("l", json.dumps(listed)), ("c", json.dumps(columnar))], "stem string, json string")
    got: dict = {}
    for r in files.blueprint_flow(rows).orderBy("pos").collect():
        got.setdefault(r["stem"], []).append((r["line"], r["inst"], r["args"]))
    assert got["l"] == got["c"] == [(1, "CLI", ["A", "B"]), (2, "BE", ["X"])]


def test_graph_shapes(spark):
    one = {"nodes": ["a", {"id": "b"}, {"name": "c"}], "edges": [{"source": "a", "target": "b"}, ["b", "c", 3]]}
    nodes, edges = files.normalise_graph(spark.createDataFrame([(json.dumps(one),)], "json string"))
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "c"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a", "b"), ("b", "c")}


def test_cache(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for salt in ("s", "s", "t"):
        assert cache.cached(spark, "x", salt, build, str(tmp_path)).count() == 3
    assert len(built) == 2
    with pytest.raises(RuntimeError, match="nothing"):
        cache.require(spark, str(tmp_path), ["nothing"])


def test_fingerprint_ignores_order_but_not_sizes(spark):
    rows = [("a", 1), ("b", 2)]
    table = lambda r: spark.createDataFrame(r, "path string, length long").selectExpr("path", "length", "timestamp'2020-01-01' as modificationTime")
    first = cache.fingerprint(table(rows))
    assert first == cache.fingerprint(table(rows[::-1]))
    assert first != cache.fingerprint(table([("a", 1), ("b", 3)]))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("asm", 0, "x"), ("cpp", 1, "y")], "language string, chain_index int, name string")
    cache.write_chains(rows, str(tmp_path / "split"))
    cache.write_chains(rows, str(tmp_path / "one"), split=False)
    assert spark.read.json(str(tmp_path / "split")).count() == spark.read.json(str(tmp_path / "one")).count() == 2
    blocks = spark.createDataFrame([("f", 1, 2, "t"), ("f", 1, 2, "t")], "file string, start_line int, end_line int, text string")
    assert cache.register_blocks(blocks).count() == 1


def test_trace(spark):
    make = spark.createDataFrame
    inputs = trace.Inputs(
        make([(0, 1, 5), (1, 2, 6), (3, 2, 1)], "src long, dst long, line long"),
        make([(1, 2, 10, "V", "cpp", "E::A", False), (2, 3, 11, "V", "cpp", "1", False), (3, 1, 12, "W", "cpp", "2", False), (4, 1, 13, "V", "cpp", "3", True)], "id long, stem long, line long, variable string, language string, value string, is_declaration boolean"),
        make([(2, 10, 1, "x == 1 && y"), (2, 10, 2, "y")], "stem long, line long, seq long, text string"),
        make([(1, "W"), (3, "V")], "setter long, variable string"),
        constants=make([("E::A", "7")], "key string, value string"),
    )
    got = trace.trace(inputs, "V", 0)
    rows = {r["id"]: r for r in got.setters.collect()}
    assert set(rows) == {1, 3, 4}
    assert (rows[1]["guards"], rows[1]["value_resolved"], rows[1]["unconditional"], rows[1]["path"]) == ("x == 1 && y", "7", False, "0>1>2")
    assert rows[3]["unconditional"]
    assert {(r["parent"], r["child"]) for r in got.edges.collect()} == {("V", "W"), ("W", "V")}
    assert not got.reached_depth


def small_inputs(spark):
    make = spark.createDataFrame
    return trace.Inputs(
        make([(0, 1, 5)], "src long, dst long, line long"),
        make([(1, 1, 10, "V", "cpp", "1", False)], "id long, stem long, line long, variable string, language string, value string, is_declaration boolean"),
        make([], "stem long, line long, seq long, text string"),
        make([(1, "W")], "setter long, variable string"),
    )


def test_job(spark, tmp_path):
    from backtrail.plans import job

    opts = job.options({"chains": 2, "depth": 3, "unknown": 1, "paths": None})
    assert (opts.chains, opts.bounds.depth, opts.bounds.paths) == (2, 3, 64)
    done = job.run(small_inputs(spark), "V", {"cpp": [0, 0, 0], "asm": [1]}, opts)
    assert list(done.traces) == [("cpp", 0), ("cpp", 1), ("asm", 0)]
    assert done.warnings == ["cpp: 2 of 3 chains are traced"]
    assert done.setters().count() == 3
    assert {r["variable"] for r in done.terminals().collect()} == {"W"}
    job.write(done, str(tmp_path), opts)
    assert spark.read.json(str(tmp_path / "edges")).count() == 3


def test_audit(spark):
    from backtrail.plans import job

    make = spark.createDataFrame
    got = job.audit(make([("A",), ("b",)], "id string"), make([("a", "c"), ("a", "x.y")], "src string, dst string"), make([("a",)], "stem string"), make([("N", "a"), ("M", "b"), ("O", None)], "name string, stem string"))
    assert {r["check"]: (r["n"], r["sample"]) for r in got.collect()} == {"dangling": (1, ["c"]), "no_blueprint": (1, ["b"]), "no_owner": (1, ["M"])}
