"""Hand-derived vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from backtrail.functions import scalars as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("C'D' == LG1", ["LG1"]),
        ('x == A::B::C && 0x80 != "CA+B"', ["x", "A::B", "C", "x80"]),
        ("'A'B R5 R15 r3 R16", ["R16"]),
        ("L'FLD EBW#1 'NO'", ["EBW#1"]),
        ("a->b.c!='N' && K", ["a", "b", "c", "K"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.lit(text))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("EBWKIDX+4 BASE THE ADDRESSES", "EBWKIDX+4"), ("C'A B' X", "C'A B'"), ("PAMSG1 '  X", "PAMSG1"), ("'   PRE-AUTH ?", "'   PRE-AUTH ?"), (" B'1111' ", "B'1111'"), (" \tA", "A"), ("\n A\u00a0B", "A"), ("\t", "")],
)
def test_operand_head(spark, text, want):
    assert one(spark, X.operand_head(F.lit(text))) == want


@pytest.mark.parametrize(
    ("test", "args", "branch", "yes", "no"),
    [
        ("CLI", ["F", "C'A'"], "BE", "F == C'A'", "F != C'A'"),
        ("CLC", ["A", "B"], "BL", "A < B", "A >= B"),
        ("C", ["R1"], "BH", "R1 > 0", "R1 <= 0"),
        ("TM", ["F", "M"], "JNO", "(F & M) != M", "(F & M) == M"),
        ("TM", ["F", "M"], "BZ", "(F & M) == 0", "(F & M) != 0"),
        ("TM", ["F", "M"], "BM", "mixed(F & M)", "not-mixed(F & M)"),
        ("TM", ["F", "M"], "BE", "F == M", "F != M"),
        ("LTR", ["R5", "R5"], "BZ", "R5 == 0", "R5 != 0"),
        ("ICM", ["R1", "15", "R1"], "BZ", "R1 == 0", "R1 != 0"),
        ("ICM", ["R15", "15", "FLD"], "BNZ", "FLD != 0", "FLD == 0"),
        ("OC", ["X", "X"], "JZ", "X == 0", "X != 0"),
        ("XC", ["X", "X"], "JZ", "X == X", "X != X"),
        ("TM", ["F"], "BO", "(F & ?) == ?", "(F & ?) != ?"),
        ("TM", [], "BZ", "(? & ?) == 0", "(? & ?) != 0"),
        ("TM", ["{1}", "M"], "BO", "({1} & M) == M", "({1} & M) != M"),
        ("OC", ["ebw", "EBW"], "JZ", "ebw == 0", "ebw != 0"),
        ("NC", [" A", "a\t"], "JZ", " A == 0", " A != 0"),
        ("OC", ["", ""], "JZ", " == ", " != "),
        ("CLC", ["A", "B"], "BXH", "CLC A, B taken:BXH", "CLC A, B fallthrough:BXH"),
    ],
)
def test_predicate(spark, test, args, branch, yes, no):
    columns = F.lit(test), F.array(*map(F.lit, args)), F.lit(branch)
    assert one(spark, X.predicate(*columns, F.lit(True))) == yes
    assert one(spark, X.predicate(*columns, F.lit(False))) == no


def test_negation(spark):
    none = F.lit(None).cast("string")
    assert one(spark, X.negate(F.lit("!(a)"), none)) == "a"
    assert one(spark, X.negate(F.lit("a"), none)) == "!(a)"
    assert one(spark, X.negate(F.lit("(F & M) != M"), F.lit("(F & M) == M"))) == "(F & M) == M"


@pytest.mark.parametrize(("text", "want"), [("0x80U", 128), ("-1", -1), ("010", None), ("'A'", None), ("00", 0), ("7ul", 7), ("0b11", 3), ("", None), ("1_000", 1000), ("1__0", None), ("_1", None), ("0x_fF", 255), ("0o17", 15), (" -0x10\t", -16), ("+5", 5),
     ("0xFFFFFFFFFFFFFFFFFFFF", 16**20 - 1), ("0x" + "0" * 40 + "1", 1), ("0x" + "f" * 31, None), ("9" * 38, 10**38 - 1), ("9" * 39, None), ("0b" + "1" * 64, 2**64 - 1), ("-18446744073709551615", 1 - 2**64), ("0x", None), ("-", None)])
def test_integers(spark, text, want):
    assert one(spark, X.integer_literal(F.lit(text))) == want


def test_conjunct_normal_form(spark):
    assert one(spark, X.normal_conjunct(F.lit("(a->b != 0)"))) == "a->b!=0"
    assert one(spark, X.normal_conjunct(F.lit("(a)||(b)"))) == "a)||(b"
    assert one(spark, X.normal_conjunct(F.lit("(" * 8 + " a\t" + ")" * 8))) == "a"
    assert one(spark, X.normal_conjunct(F.lit("((a)"))) == "(a"
    assert one(spark, X.normal_conjunct(F.lit("()"))) == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("p.q->r[0] == E::A", ("p.q->r[0]", "E::A")), (" v==A::B::C ", ("v", "A::B::C")), ("!(v == E::A)", None), ("v == A", None), ("v == E::A && w", None),
        ("v != E::A", None), ("", None), ("é == É::ß", None), ("a é == E::A", None),
    ],
)
def test_required_equality(spark, text, want):
    got = one(spark, X.required_equality(F.lit(text)))
    assert (got and tuple(got)) == want


def test_definitions(spark):
    got = one(spark, X.definitions(F.lit("LG#C400&A EQU C'D'\nFLD DS CL4\nX1 EQU C'A B'\n")))
    assert [tuple(x) for x in got] == [("LG#C400", "C'D'"), ("X1", "C'A")]


def test_link_aliases(spark):
    got = one(spark, X.link_aliases(F.lit('#pragma map(ckXc, "TE90")\nint f(int) asm("F1");\nint g() asm("g");\nint h(a, b) __asm__ ( "H9" );\n# pragma map(k,"K2")')))
    assert [tuple(x) for x in got] == [("ckxc", "te90"), ("k", "k2"), ("f", "f1"), ("h", "h9")]


@pytest.mark.parametrize(
    ("name", "linkage", "want"),
    [("char", False, "builtin"), ("te90", False, "module"), ("pack", False, "library"), ("castod", False, "symbol"), ("unpack", True, "library"), ("av5e2", True, "module"), ("av5e2", False, "symbol")],
)
def test_missing_kind(spark, name, linkage, want):
    assert one(spark, X.missing_kind(F.lit(name), F.lit(linkage))) == want


def test_names(spark):
    assert one(spark, X.same_name(F.lit("A::f"), F.lit("f"))) is True
    assert one(spark, X.same_name(F.lit("xf"), F.lit("f"))) is False
    assert one(spark, X.same_name(F.lit(""), F.lit(""))) is False
    assert one(spark, X.suffixes(F.lit("A::B::f"))) == ["A::B::f", "B::f", "f"]
    assert one(spark, X.scrutinee_tail(F.lit("a.b->C::d[3]"))) == "d"
    assert one(spark, X.guard_text(F.lit("  a \n ==  b "))) == "a == b"
    assert one(spark, X.error_text(F.lit("x\n y.cpp: fatal error: z\n"), F.lit("E"))) == "y.cpp: fatal error: z"
    assert one(spark, X.strip_comments(F.lit("a/* b\n */c// d\ne"))) == "ac\ne"
    assert one(spark, X.marker_hits(F.lit("call finwc, GETFC xFINWC"), ["FINWC", "GETFC"])) == ["FINWC", "GETFC"]
    assert one(spark, X.upper_tokens(F.lit("éABCDé AB_C1 ABC"))) == ["AB_C1"]
