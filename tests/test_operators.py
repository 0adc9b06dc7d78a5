import random


from backtrail.operators import constants, graph, guards, lineage, projections, sequence


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_trigger_pairs(spark):
    def pairs(kinds):
        flow = frame(spark, [(1, i, k) for i, k in enumerate(kinds)], "block long, line long, kind string")
        return [(r["trigger_line"], r["line"]) for r in sequence.trigger_pairs(flow).orderBy("line").collect()]

    assert pairs("TOC") == [(0, 2)]
    assert pairs("TTC") == [(1, 2)]
    assert pairs("TUC") == []
    assert pairs("C") == []
    assert pairs("TCC") == [(0, 1)]


def test_smallest_block(spark):
    blocks = frame(spark, [("f", "A", 0, 1, 100), ("f", "B", 1, 10, 20), ("f", "C", 2, 10, 20)], "file string, block string, pos int, start_line int, end_line int")
    points = frame(spark, [(1, "f", 15), (2, "f", 50), (3, "f", 101)], "id long, file string, line int")
    assert {r["id"]: r["block"] for r in sequence.smallest_block(points, blocks).collect()} == {1: "B", 2: "A", 3: None}


def fold(labels):
    out = []
    for label in labels:
        stem = label.split("::")[0]
        if label in out or label == stem and any(x.split("::")[0] == stem for x in out):
            continue
        if label != stem and stem in out:
            out[out.index(stem)] = label
        else:
            out.append(label)
    return out


def test_merge_chain_equals_fold(spark):
    random.seed(5)
    chains = [[random.choice(["a", "b", "c"]) + random.choice(["", "::x", "::y"]) for _ in range(random.randrange(9))] for _ in range(400)]
    chains += [["a", "b::f", "a::x", "a::y", "a"], ["a::x", "a"], ["a", "a"]]
    rows = [(c, i, x.split("::")[0], x) for c, xs in enumerate(chains) for i, x in enumerate(xs)]
    got: dict = {}
    for r in sequence.merge_chain(frame(spark, rows, "chain long, pos long, stem string, label string")).orderBy("chain", "rank").collect():
        got.setdefault(r["chain"], []).append(r["label"])
    assert [got.get(i, []) for i in range(len(chains))] == [fold(c) for c in chains]


def test_or_of_sites(spark):
    rows = [(1, 1, 5, 1, "g1"), (1, 2, 9, 2, "g2"), (1, 2, 9, 3, "g3"), (2, 1, 5, 1, "g1"), (2, 2, 7, 2, None)]
    got = {r["hop"]: (r["bound"], r["guard"]) for r in guards.or_of_sites(frame(spark, rows, "hop long, site long, line long, pos long, guard string")).collect()}
    assert got == {1: (9, "g1 || (g2 && g3)"), 2: (7, None)}


def test_subsumption(spark):
    def final(*texts):
        rows = [(1, i, t) for i, t in enumerate(texts)]
        return [r["text"] for r in guards.finalise(frame(spark, rows, "id long, pos long, text string")).orderBy("seq").collect()]

    assert final("x != 0 && y == 1", "y == 1", "z", "z") == ["x != 0 && y == 1", "z"]
    assert final("a->ccr != 0 && q", "ccr != 0") == ["a->ccr != 0 && q", "ccr != 0"]
    assert final("", None) == []


def test_infeasible_routes(spark):
    need = frame(spark, [(r, 0, "V", "E::A") for r in range(6)], "route long, pos long, scrutinee string, value string")
    given = [(0, 1, "E::B", False), (1, 1, "E::B", True), (2, 1, "E::B", False), (2, 2, "E::A", False), (3, 1, "Other::A", False), (5, 1, "B", False)]
    rows = [(r, p, 0, "V", v, c, False) for r, p, v, c in given]
    schema = "route long, route_pos long, site_pos long, target string, value string, conditional boolean, declaration boolean"
    assert [r["route"] for r in guards.infeasible_routes(need, frame(spark, rows, schema)).collect()] == [0]


def reachable(edges, start, removed=None):
    seen, todo = set(), [s for s in start if s != removed]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [d for s, d in edges if s == x and d != removed]
    return seen


def test_dominators_against_brute_force(spark):
    random.seed(9)
    rows, targets, want = [], [], set()
    for file in range(25):
        n = random.randrange(3, 8)
        edges = {(a, b) for a in range(n) for b in range(n) if a != b and random.random() < 0.25}
        if not edges:
            continue
        target = random.choice(sorted({b for _, b in edges}))
        rows += [(file, a, b) for a, b in edges]
        targets.append((file, target))
        roots = {a for a, _ in edges} - {b for _, b in edges}
        back = reachable({(b, a) for a, b in edges}, [target])
        for node in back - {target}:
            if target not in reachable(edges, roots, node):
                want.add((file, target, node))
    got = graph.dominators(frame(spark, rows, "file long, src long, dst long"), frame(spark, targets, "file long, target long"))
    assert {(r["file"], r["target"], r["node"]) for r in got.collect()} == want


def test_necessary_guards(spark):
    edges = frame(spark, [(1, 0, 1), (1, 0, 2), (2, 0, 1), (2, 0, 2), (2, 1, 3), (2, 2, 3)], "file long, src long, dst long")
    pairs = frame(spark, [(1, 0, 1), (2, 0, 1)], "file long, node long, branch long")
    got = graph.necessary_guards(edges, pairs, frame(spark, [(1, 2), (2, 3)], "file long, target long"), 16)
    assert [(r["file"], r["node"], r["taken"]) for r in got.collect()] == [(1, 0, False)]


def test_paths_are_flagged_when_cut(spark):
    edges = frame(spark, [(0, i) for i in range(1, 6)] + [(i, 9) for i in range(1, 6)], "src long, dst long")
    got = graph.simple_paths(edges, 0, 3, 2).where("dst = 9").collect()
    assert len(got) == 2
    assert all(r["truncated"] for r in got)


def test_enumerators(spark):
    text = "/* enum Z { Q }; */ struct S { enum E { A, B = 0x10, C, D = 'x', F, G = 5, H }; }; enum { U1 = 2, U2 };"
    pairs = constants.enum_pairs(frame(spark, [("p", text), ("q", None)], "path string, text string"))
    got = {r["key"]: r["value"] for r in pairs.collect()}
    assert {k: got[k] for k in ("A", "B", "C", "D", "G", "H", "U1", "U2")} == {"A": "0", "B": "0x10", "C": "17", "D": "'x'", "G": "5", "H": "6", "U1": "2", "U2": "3"}
    assert "F" not in got
    assert got["E::C"] == got["S::C"] == got["S::E::C"] == "17"
    assert "Q" not in got


def test_classes(spark):
    schema = "name string, external boolean, asm_constant boolean, cpp_constant boolean, member boolean, member_name string, db_read boolean, db_tokens boolean, input_read boolean"
    no = [False] * 3
    rows = [
        ("x", True, True, False, False, None, *no), ("K", False, True, False, False, None, *no), ("MI0ACC", *no, False, None, *no), ("EBW000", *no, False, None, *no), ("f", *no, True, "g", True, False, False),
        ("f", *no, True, "g", *no), ("v", *no, False, None, False, False, True), ("f", *no, True, "g", False, False, True), ("v", *no, False, None, *no),
    ]
    got = [r["class"] for r in lineage.classify(frame(spark, rows, schema)).collect()]
    assert got == ["external", "constant", "user_input", "working_storage", "database", "record_field", "user_input", "record_field", "unresolved"]


def test_alias_rewrite(spark):
    aliases = frame(spark, [("ckxc", "te90", "a", 0, 1)], "fn string, entry string, source string, kind int, pos int")
    missing = frame(spark, [("ckxc",), ("other",)], "stem string")
    bare = lineage.rewrite_aliases(missing, aliases, frame(spark, [], "stem string")).collect()
    assert {(r["stem"], r["called_as"]) for r in bare} == {("te90", "ckxc"), ("other", None)}
    known = lineage.rewrite_aliases(missing, aliases, frame(spark, [("te90",)], "stem string")).collect()
    assert {r["stem"] for r in known} == {"other"}


def test_evidence(spark):
    rows = [("a", "asm", "X FINWC\n DR0FLD IMSG"), ("b", "cpp", "FINWC"), ("c", "mac", "nothing")]
    got = {r["stem"]: (r["db_read"], r["user_input"], r["tokens"]) for r in lineage.evidence(frame(spark, rows, "stem string, ext string, text string")).collect()}
    assert got == {"a": (["FINWC"], ["IMSG"], ["DR0FLD", "FINWC", "IMSG"]), "c": ([], [], [])}


def test_empty_tables(spark):
    empty = frame(spark, [], "src long, dst long")
    assert graph.reach(frame(spark, [(0,)], "node long"), empty).count() == 1
    assert graph.simple_paths(empty, 0, 3, 2).count() == 0
    assert lineage.missing_rank(frame(spark, [], "name string, linkage boolean"), 5).count() == 0
    assert guards.not_set(frame(spark, [], "id long, setter long, line long, pos long, negated string")).count() == 0



def test_stretches_change_nothing(spark):
    random.seed(6)
    flow = frame(spark, [(b, i, random.choice("TCUO")) for b in range(3) for i in range(200)], "block long, line long, kind string")
    pairs = [{(r["block"], r["trigger_line"], r["line"]) for r in sequence.trigger_pairs(flow, n).collect()} for n in (7, 10_000)]
    assert pairs[0] == pairs[1]
    starts = frame(spark, [(s, f"f{i}", i) for s in range(3) for i in range(0, 500, 41)], "stem long, fn string, start_line long")
    lines = frame(spark, [(s, i, i) for s in range(4) for i in range(-3, 520, 9)], "stem long, line long, id long")
    owners = [{(r["stem"], r["id"], r["fn"]) for r in sequence.owning_function(lines, starts, n).collect()} for n in (10, 10_000)]
    assert owners[0] == owners[1]
    assert len(owners[0]) == lines.count()


def test_projections(spark):
    pairs = frame(spark, [("d/f.asm", "B1", 3, 4, "CLI", ["F", "1"], "BE", ["X"], None)], "file string, block string, trigger_line int, line int, test string, test_args array<string>, branch string, branch_args array<string>, taken boolean")
    row = projections.condition_summary(projections.pair_conditions(pairs)).first()
    assert (row["condition"], row["polarity"], row["raw_test"], row["file"], row["line"]) == ("F != 1", False, "CLI F, 1", "f.asm", 3)
    schema = "hop long, seq long, text string, test string, branch string, args array<string>, note string, block string"
    rows = [(1, 1, " a  == b ", None, None, None, None, None), (1, 2, None, "CLI F,1", "BE", ["X"], None, "x"), (1, 3, None, None, None, None, "skip", None)]
    assert [r["text"] for r in projections.hop_guards(frame(spark, rows, schema)).orderBy("seq").collect()] == ["a == b", "F == 1"]
    routes = frame(spark, [(1, 0, "a"), (1, 1, "b")], "route long, pos long, stem string")
    inner = frame(spark, [("b", 0, 2, "b::f > b::g"), ("b", 1, 1, "b::h")], "stem string, seq long, size long, path string")
    assert projections.label_routes(routes, inner).first()["route_text"] == "a > b::f > b::g"
    entered = frame(spark, [(1, 0, "a", "a::m", "a::m"), (1, 1, "b", "b::f", "b::k")], "route long, pos long, stem string, entry string, leaving string")
    between = frame(spark, [("b", "b::f", "b::k", 0, 2, "b::f > b::k"), ("b", "b::f", "b::z", 1, 9, "b::f > b::y > b::z")], "stem string, entry string, leaving string, seq long, size long, path string")
    assert projections.label_routes(entered, between).first()["route_text"] == "a > b::f > b::k"
    one, two = frame(spark, [(1, "x")], "k long, v string"), frame(spark, [(1, "y"), (2, "z")], "k long, v string")
    assert {(r["k"], r["v"]) for r in projections.prefer(one, two, ["k"]).collect()} == {(1, "x"), (2, "z")}
    found = projections.triage(frame(spark, [("a",), ("b",), ("c",)], "stem string"), frame(spark, [("a",)], "stem string"), frame(spark, [("a",), ("b",)], "stem string"))
    assert {(r["stem"], r["via_unverified"]) for r in found.collect()} == {("a", False), ("b", True)}
    stems = projections.reader_stems(frame(spark, [("v", "d/X.cpp")], "variable string, file string"))
    assert [tuple(r) for r in stems.collect()] == [("v", "x")]


def test_walks_and_frontiers_agree(spark):
    random.seed(14)
    edges = frame(spark, [(g, random.randrange(30), random.randrange(30)) for g in range(3) for _ in range(60)], "g long, src long, dst long")
    seeds = frame(spark, [(g, r, s) for g in range(4) for r in (3, 5) for s in (1, 3)], "g long, gone long, node long")
    for depth in (None, 2):
        a, b = ({tuple(r) for r in graph.reach(seeds, edges, ["g", "gone"], depth, "gone", small).collect()} for small in (10**6, 0))
        assert a == b
        assert len(a) > 8
    plain = edges.drop("g")
    a, b = ({tuple(r) for r in graph.backward(frame(spark, [(4,)], "node long"), plain, small=small).collect()} for small in (10**6, 0))
    assert a == b


def test_narrow_paths_are_flagged(spark):
    edges = frame(spark, [(a, b) for a in range(5) for b in range(5) if a != b], "src long, dst long")
    whole = graph.simple_paths(edges, 0, 4, 100)
    wide, narrow = graph.simple_paths(edges, 0, 4, 100, 100), graph.simple_paths(edges, 0, 4, 100, 2)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in wide.collect()}
    assert whole.count() == 64
    assert 0 < narrow.count() < 64
    assert all(r["truncated"] for r in narrow.collect())


def test_nulls_are_no_nodes(spark):
    edges = frame(spark, [(0, 1, 2), (None, 1, 3), (0, None, 4), (0, 2, None), (0, 2, 5)], "g long, src long, dst long")
    seeds = frame(spark, [(0, 1), (None, 1), (0, None)], "g long, node long")
    for small in (0, 10**6):
        assert sorted(tuple(r) for r in graph.reach(seeds, edges, ["g"], small=small).collect()) == [(0, 1, 0), (0, 2, 1), (0, 5, 2)]
        assert sorted(tuple(r) for r in graph.reach(frame(spark, [(None,), (1,)], "node long"), edges.drop("g"), small=small).collect()) == [(1, 0), (2, 1), (3, 1), (5, 2)]


def test_long_numbers_are_whole(spark):
    edges = frame(spark, [(0, 1234561), (0, 1234562), (1234562, 98765432101)], "src long, dst long")
    got = {(r["dst"], r["path"]) for r in graph.simple_paths(edges, 0, 3, 9).collect()}
    assert got == {(1234561, "0>1234561"), (1234562, "0>1234562"), (98765432101, "0>1234562>98765432101")}


def test_routes_without_a_segment_stay(spark):
    segments = frame(spark, [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, "z"), (2, 1, 0, "m"), (3, 0, 0, "a"), (3, 1, 0, "b"), (3, 2, 0, "c")], "route long, segment long, seq long, path string")
    got = {(r["route"], r["rank"]): (r["path"], r["truncated"], r["incomplete"]) for r in graph.stitch(segments, 3, 4).collect()}
    assert got == {(1, 1): ("a/z", False, True), (1, 2): ("b/z", False, True), (2, 1): ("m", False, True), (3, 1): ("a/b/c", False, False)}


def test_files_of_any_size_have_the_same_dominators(spark):
    random.seed(19)
    rows = [(f, random.randrange(12), random.randrange(12)) for f in range(12) for _ in range(18)]
    targets = frame(spark, [(f, t) for f in range(13) for t in (1, 5, 9, 40)], "file long, target long")
    edges = frame(spark, [r for r in rows if r[1] != r[2]], "file long, src long, dst long")
    a, b = ({tuple(r) for r in graph.ancestry(edges, targets, n).where("dominates or depth > 0").collect()} for n in (10**6, 0))
    assert a == b
    assert len([r for r in a if r[4]]) > 10


def test_compare_line_against_brute_force(spark):
    random.seed(21)
    pick = lambda i: (i, random.randrange(2), random.choice(["CLI", "cli", "TM"]), random.choice(["A", "a", "B", None, ""]), random.randrange(30_000))
    marks, points = [pick(i) for i in range(120)], [pick(i) for i in range(150)]
    schema = "id long, block long, inst string, operand string, line long"
    want = {}
    for i, block, inst, operand, line in points:
        fits = [m[4] for m in marks if m[1] == block and m[2].upper() == inst.upper() and m[4] <= line and (not operand or (m[3] or "").upper() == operand.upper())]
        want[i] = max(fits, default=line)
    got = sequence.compare_line(frame(spark, points, schema), frame(spark, marks, schema).drop("id"))
    assert {r["id"]: r["compare_line"] for r in got.collect()} == want


def test_smallest_block_against_brute_force(spark):
    random.seed(22)
    blocks = [("fg"[i % 2], i, i, a, a + random.choice([0, 1, 7, 300, 5000])) for i, a in enumerate(random.randrange(6000) for _ in range(200))] + [("f", 900, 900, None, 5), ("f", 901, 901, 0, 10**6), ("f", 902, 902, 9, 3)]
    points = [(i, random.choice("fgh"), random.randrange(12_000)) for i in range(300)]
    want = {}
    for i, file, line in points:
        fits = [(b[4] - b[3], b[2], b[1]) for b in blocks if b[0] == file and b[3] and b[4] and b[3] <= line <= b[4]]
        want[i] = min(fits)[2] if fits else None
    got = sequence.smallest_block(frame(spark, points, "id long, file string, line long"), frame(spark, blocks, "file string, block long, pos long, start_line long, end_line long"))
    assert {r["id"]: r["block"] for r in got.collect()} == want
    assert len(got.columns) == 4
