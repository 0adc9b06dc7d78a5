"""Scalar functions over names, operands, predicates and source text, as Column expressions.

Patterns use (?U) where words are meant in the Unicode sense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operator that a branch says when it is taken behind a compare, and the operators' opposites.
COMPARE = {
    "BE": "==", "BER": "==", "JE": "==", "BZ": "==", "BZR": "==", "JZ": "==",
    "BNE": "!=", "BNER": "!=", "JNE": "!=", "BNZ": "!=", "JNZ": "!=",
    "BH": ">", "BHR": ">", "JH": ">", "BP": ">", "JP": ">",
    "BL": "<", "BLR": "<", "JL": "<", "BM": "<", "JM": "<",
    "BNH": "<=", "JNH": "<=", "BNP": "<=", "JNP": "<=",
    "BNL": ">=", "JNL": ">=", "BNM": ">=", "JNM": ">=",
}
OPPOSITE = {"==": "!=", "!=": "==", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
# What a branch says of the tested bits when it is taken behind a test under mask.
MASK = {
    "BO": "all ones", "JO": "all ones", "BNO": "not all ones", "JNO": "not all ones",
    "BZ": "all zeros", "JZ": "all zeros", "BNZ": "not all zeros", "JNZ": "not all zeros",
    "BM": "mixed", "JM": "mixed", "BNM": "not mixed", "JNM": "not mixed",
}
# How that is written, and its opposite; {0} is the field, {1} the mask.
SENSE = {
    "all ones": ("({0} & {1}) == {1}", "({0} & {1}) != {1}"), "not all ones": ("({0} & {1}) != {1}", "({0} & {1}) == {1}"),
    "all zeros": ("({0} & {1}) == 0", "({0} & {1}) != 0"), "not all zeros": ("({0} & {1}) != 0", "({0} & {1}) == 0"),
    "mixed": ("mixed({0} & {1})", "not-mixed({0} & {1})"), "not mixed": ("not-mixed({0} & {1})", "mixed({0} & {1})"),
}
# Branches that are always taken.
UNCONDITIONAL = ("B", "J", "BR", "BCR")
CONDITIONAL = sorted({*COMPARE, *MASK})

#: White space in the sense of Unicode, and the four separators that also count as such.
SPACE = r"[\s\x1c-\x1f]"


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))[key]


def tokens(text: Column) -> Column:
    """Identifiers, at most one :: inside, that touch no quote on either side; no registers R0 to R15."""
    # fixed value: what counts as an identifier
    t = r"(?:[A-Za-z_][A-Za-z0-9_#$@]*+(?:::[A-Za-z_][A-Za-z0-9_]*+)?+)"
    found = F.regexp_extract_all(text, F.lit(rf"(?<=['\"]){t}|{t}(?=['\"])|({t})"), F.lit(1))
    return F.filter(found, lambda x: (x != "") & ~F.rlike(x, F.lit(r"(?i)^R([0-9]|1[0-5])$")))


def label(stem: Column, file_type: Column, function: Column) -> Column:
    """Stem::function of a C++ hop that has one, else the stem."""
    return F.when((file_type == "cpp") & (F.coalesce(function, F.lit("")) != ""), F.concat(stem, F.lit("::"), function)).otherwise(stem)


def label_stem(text: Column) -> Column:
    """Before the first ::."""
    return F.substring_index(text, "::", 1)


def same_name(name: Column, wanted: Column) -> Column:
    """Equal, or qualified by more scopes; empty names never match."""
    return F.coalesce((name != "") & (wanted != "") & ((name == wanted) | F.endswith(name, F.concat(F.lit("::"), wanted))), F.lit(False))


def suffixes(name: Column) -> Column:
    """The name and what is left of it behind each ::, so that a qualified match is an equality."""
    parts = F.split(name, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "::"))


def constant_tail(text: Column) -> Column:
    """Behind the last ::."""
    return F.substring_index(text, "::", -1)


def scrutinee_tail(text: Column) -> Column:
    """Behind the last ., -> or ::, and before any [."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^.*(?:\.|->|::)", ""), r"(?s)\[.*$", "")


def operand_head(text: Column) -> Column:
    """Up to the first white space outside quotes; an unended quote keeps the rest. White space around it goes first."""
    bare = F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")
    return F.regexp_extract(bare, r"(?sU)^((?:[^\s\x1c-\x1f']|'[^']*')*+(?:'.*)?)", 1)


def operands(text: Column) -> Column:
    """Comma-separated operands, each cut to its head."""
    return F.transform(F.split(text, ","), operand_head)


def is_register(text: Column) -> Column:
    return F.rlike(F.upper(text), F.lit(r"^R?([0-9]|1[0-5])$"))


def branch_target(args: Column) -> Column:
    """The rightmost operand that is no register, in capitals; else empty."""
    left = F.filter(args, lambda a: ~is_register(a) & (a != ""))
    return F.coalesce(F.upper(F.try_element_at(left, F.lit(-1))), F.lit(""))


def is_conditional_branch(inst: Column) -> Column:
    """F6."""
    return inst.isin(CONDITIONAL) & ~inst.isin(*UNCONDITIONAL)


def is_load_and_test(test: Column, args: Column) -> Column:
    """the instruction compares its operand with zero: equal operands are compared in capitals, and empty ones aren't
    equal. XC isn't such an instruction."""
    own = lambda i: F.upper(F.regexp_replace(F.try_element_at(args, F.lit(i)), rf"(?U)^{SPACE}+|{SPACE}+$", ""))
    same = lambda i: (own(1) != "") & (own(1) == own(i))
    return F.coalesce(
        test.isin("LTR", "LTGR", "LT", "LTG") | ((test == "ICM") & (F.size(args) >= 3) & same(-1)) | (test.isin("OC", "NC") & (F.size(args) >= 2) & same(2)), F.lit(False)
    )


def predicate(test: Column, args: Column, branch: Column, taken: Column) -> Column:
    """What holds after a test and a branch."""
    a0, a1 = F.coalesce(F.try_element_at(args, F.lit(1)), F.lit("?")), F.try_element_at(args, F.lit(2))
    sense = lookup(branch, MASK)
    written = F.when(taken, lookup(sense, {k: yes for k, (yes, _) in SENSE.items()})).otherwise(lookup(sense, {k: no for k, (_, no) in SENSE.items()}))
    # the operands may hold braces themselves: both places are marked first
    marked = F.replace(F.replace(written, F.lit("{0}"), F.lit("\u0001")), F.lit("{1}"), F.lit("\u0002"))
    under_mask = F.replace(F.replace(marked, F.lit("\u0001"), a0), F.lit("\u0002"), F.coalesce(a1, F.lit("?")))
    op = lookup(branch, COMPARE)
    op = F.when(taken, op).otherwise(lookup(op, OPPOSITE))
    raw = F.concat(test, F.when(F.size(args) > 0, F.concat(F.lit(" "), F.array_join(args, ", "))).otherwise(""), F.when(taken, " taken:").otherwise(" fallthrough:"), branch)
    memory, zero = (test == "ICM") & (F.size(args) >= 3), is_load_and_test(test, args)
    left = F.when(memory & ~zero, F.try_element_at(args, F.lit(-1))).otherwise(a0)
    right = F.when(memory | zero, F.lit("0")).otherwise(F.coalesce(a1, F.lit("0")))
    return F.when(test.isin("TM", "TMY") & sense.isNotNull(), under_mask).when(op.isNull(), raw).otherwise(F.concat_ws(" ", left, op, right))


def negate(text: Column, flipped: Column) -> Column:
    """The predicate at the other polarity where there is one; else !( ) is put on, or taken off."""
    bare = F.regexp_extract(text, r"(?s)^!\((.*)\)$", 1)
    return F.coalesce(flipped, F.when(F.rlike(text, F.lit(r"(?s)^!\(.*\)$")), bare).otherwise(F.concat(F.lit("!("), text, F.lit(")"))))


def guard_text(text: Column) -> Column:
    """X11: white space collapsed."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def normal_conjunct(text: Column) -> Column:
    """Without white space; all outer parentheses are peeled off, whether or not they belong together: as many pairs as
    there are opening ones at the start and closing ones at the end."""
    bare = F.regexp_replace(text, rf"(?U){SPACE}+", "")
    pairs = F.least(F.length(bare) - F.length(F.ltrim(bare, F.lit("("))), F.length(bare) - F.length(F.rtrim(bare, F.lit(")"))))
    return F.substring(bare, pairs + 1, F.length(bare) - 2 * pairs)


# Fixed value: a member path that must equal a scoped constant, and nothing else in the text.
REQUIRED = r"(?U)^\s*([A-Za-z_][\w.\->:\[\]]*?)\s*==\s*([A-Za-z_]\w*(?:::[A-Za-z_]\w*)+)\s*$"


def required_equality(text: Column) -> Column:
    """F8: struct(scrutinee, value) of a guard text that says nothing but scrutinee == Scope::Name; else null."""
    return F.when(F.rlike(text, F.lit(REQUIRED)), F.struct(F.regexp_extract(text, REQUIRED, 1).alias("scrutinee"), F.regexp_extract(text, REQUIRED, 2).alias("value")))


def conjuncts(text: Column) -> Column:
    return F.transform(F.split(text, "&&"), lambda x: normal_conjunct(x))


def via_text(caller_stem: Column, caller: Column, callee_stem: Column, callee: Column, line: Column, cross: Column) -> Column:
    """X15."""
    across = F.concat(caller_stem, F.lit("."), caller, F.lit("→"), callee_stem, F.lit("."), callee)
    return F.concat(F.when(cross, across).otherwise(F.concat(caller, F.lit("→"), callee)), F.lit("@"), line.cast("string"))


def integer_literal(text: Column) -> Column:
    """A decimal, hexadecimal, octal (0o) or binary literal without suffix, as decimal(38,0); null for anything else,
    010 included. Single underscores may stand between digits and behind a prefix. Numbers of more than 38 decimal digits,
    which no type of the traced languages holds, are null."""
    t = F.regexp_replace(F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", ""), r"[uUlL]+$", "")
    sign = F.when(F.startswith(t, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(38,0)")
    signed = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    body = F.replace(signed, F.lit("_"), F.lit(""))

    def based(digits: str, prefix: str, base: int, width: int) -> Column:
        # two halves of at most 60 bits each, as a conversion takes 64
        all_digits = F.regexp_replace(F.substring(body, 3, 1 << 20), r"^0+(?=.)", "")
        half = lambda at: F.conv(F.substring(F.lpad(all_digits, 2 * width, "0"), at, width), base, 10).cast("decimal(38,0)")
        value = half(1) * F.lit(base**width).cast("decimal(19,0)") + half(width + 1)
        return F.when(F.rlike(signed, F.lit(rf"^{prefix}(_?{digits})+$")) & (F.length(all_digits) <= 2 * width), value.cast("decimal(38,0)"))

    plain = F.when(F.rlike(signed, F.lit(r"^([1-9](_?[0-9])*|0(_?0)*)$")), body.try_cast("decimal(38,0)"))
    value = F.coalesce(based("[0-9a-f]", "0x", 16, 15), based("[0-7]", "0o", 8, 20), based("[01]", "0b", 2, 60), plain)
    return (sign * value).cast("decimal(38,0)")


def strip_comments(text: Column) -> Column:
    """/* */ first, then // to the line's end; strings aren't respected."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


# Fixed value: a label with an optional suffix, EQU, DC or DS, and the operand's first run.
DEFINITION = r"(?m)^([A-Za-z@#$_][A-Za-z0-9@#$_]*)(?:&\w+)?\s+(EQU|DC|DS)\s+(\S+)"


def definitions(text: Column) -> Column:
    """Array of struct(name, value) of EQU and DC lines; the value is the first run without blanks. DS gives none."""
    part = lambda i: F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(i))
    found = F.arrays_zip(part(1).alias("name"), part(2).alias("kind"), part(3).alias("value"))
    kept = F.filter(found, lambda x: x["kind"] != "DS")
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


# Two ways to say that a function is linked as an entry: the words before the name, and what stands between both names.
_QUOTED = r"""\s*"([\w]+)"\s*"""
PRAGMA = r"(?iU)#\s*pragma\s+map\b\s*\(\s*(\w+)\s*," + _QUOTED + r"\)"
LABELLED = r"(?iU)\b(\w+)\s*\([^(){};]*\)\s*_{0,2}asm_{0,2}\s*\(" + _QUOTED + r"\)"


def link_aliases(text: Column) -> Column:
    """Array of struct(fn, entry) of pragma maps, then of asm labels, in lower case; fn <> entry."""
    named = lambda rx: F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("fn"), F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("entry"))
    lower = F.transform(F.concat(named(PRAGMA), named(LABELLED)), lambda x: F.struct(F.lower(x["fn"]).alias("fn"), F.lower(x["entry"]).alias("entry")))
    return F.filter(lower, lambda x: x["fn"] != x["entry"])


def marker_pattern(markers: list[str]) -> str:
    """One word-bounded alternation, case ignored, all characters literal."""
    import re

    return r"(?iU)\b(" + "|".join(re.escape(m) for m in markers) + r")\b"


def marker_hits(text: Column, markers: list[str]) -> Column:
    """The sorted distinct hits, in capitals."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(marker_pattern(markers)), F.lit(1)), F.upper)))


def upper_tokens(text: Column) -> Column:
    """Words of four or more capitals, digits and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][A-Z0-9_]{3,})\b"), F.lit(1))


# Names that a compiler or its library brings along, and the shape of a program's name.
BUILTINS = (
    "char", "long", "int", "bool", "void", "short", "auto", "enum", "float", "double", "signed", "unsigned", "size_t", "boolean",
    "abs", "memcpy", "memset", "strlen", "strcpy", "strcmp", "strncpy", "strncmp", "sprintf",
)
MODULE_NAME = "^[a-z]{2}[0-9a-z]{2}$"


def missing_kind(name: Column, linkage: Column) -> Column:
    """Builtin, module, library or symbol; linkage says whether the name is a linkage entry."""
    digit = F.rlike(name, F.lit("[0-9]"))
    return (
        F.when(name.isin(*BUILTINS), "builtin")
        .when(linkage, F.when(digit, "module").otherwise("library"))
        .when(F.rlike(name, F.lit(MODULE_NAME)), F.when(digit, "module").otherwise("library"))
        .otherwise("symbol")
    )


def error_text(text: Column, kind: Column, size: int = 500) -> Column:
    """The first line that names a fatal error or a missing source, else the first line with text, else the kind."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    fatal = F.filter(lines, lambda x: x.contains("fatal error:") | x.contains("source file not found:"))
    return F.substring(F.trim(F.coalesce(F.get(fatal, F.lit(0)), F.get(lines, F.lit(0)), kind)), 1, size)
