"""What bounds and call guards mean for a setter that has no guard of its own."""

from backtrail.plans import trace


def found(spark, calls, guards, setters, bounds):
    frame = spark.createDataFrame
    rows = [(i, stem, 1, "V", "cpp", str(i), False) for i, stem in enumerate(setters)]
    inputs = trace.Inputs(
        frame(calls, "src long, dst long, line long"), frame(rows, "id long, stem long, line long, variable string, language string, value string, is_declaration boolean"),
        frame(guards, "stem long, line long, seq long, text string"), frame([], "setter long, variable string"),
    )
    return sorted(tuple(r) for r in trace.trace(inputs, "V", 0, bounds).setters.select("stem", "path", "guards", "truncated", "unconditional").collect())


def test_far_setters_are_truncated(spark):
    # 0 to 4 in a row and back to 1; only 0 can't lie behind a path that was cut
    got = found(spark, [(0, 1, 5), (1, 2, 5), (2, 3, 5), (3, 4, 5), (4, 1, 5)], [], [0, 1, 2, 4], trace.Bounds(path_edges=2))
    assert {r[0]: r[3:] for r in got} == {0: (False, True), 1: (True, False), 2: (True, False), 4: (True, False)}
    assert [r[1] for r in got if r[0] == 4] == [None]


def test_call_guards_count(spark):
    calls = [(0, 1, 5), (1, 2, 6), (0, 3, 7), (0, 3, 8), (0, 4, 9), (0, 4, 10)]
    guards = [(0, 5, 1, "a"), (2, 1, 1, "own"), (0, 7, 1, "b"), (0, 8, 1, "c"), (0, 8, 2, "d"), (0, 9, 1, "e")]
    got = found(spark, calls, guards, [1, 2, 3, 4], trace.Bounds())
    assert [r[0] for r in got] == [1, 2, 3, 4]
    assert [r[2] for r in got] == ["a", "a && own", "(b || (c && d))", None]
    assert [r[4] for r in got] == [False, False, False, True]
