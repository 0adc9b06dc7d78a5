"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage of a document by up to k = floor(error_rate * n) edits. Cut into
k + 1 pieces, at least one piece of it must then stand unchanged in the passage. One automaton finds all pieces of all
items in one pass over a document; around each hit the item is compared with the text by Myers' bit-parallel algorithm,
one machine step for each character of the text, with the item's characters as the bits of one integer.

Both sides are lower-cased and their white space is collapsed first, so that layout doesn't hide a leak. Items are
broadcast in blocks of a fixed size; a larger benchmark takes more passes over the documents, never a larger broadcast, and
the answer is the same for every block size.

Defined results: null and empty texts match nothing; an empty item matches nothing; items shorter than 1 / error_rate
must occur unchanged; repeated documents each get their rows. Of several texts with one item_id, and of several places, the
one with the least distance counts, then the one that starts first, then the one that ends first; items without an id count
as one item, whose id is null. Rows with a null doc_id stay. Other columns aren't looked at, whatever their names; empty
tables give no rows, and with an empty benchmark remove_leaks() keeps all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import column, map_rows, materialise

#: Characters of test items that one pass may broadcast.
BLOCK_CHARS = 4_000_000
ERROR_RATE = 0.05
MATCHES = "item_id bigint, distance int, start int, end int"


def plain(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of nearly equal length that cover n characters; fewer if n is too short."""
    parts = min(k + 1, n)
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


class EditPattern:
    """Myers' bit-vectors of one string."""

    def __init__(self, text: str):
        self.size = len(text)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(smallest edit distance to any substring of text, the first place where a substring that has it ends)."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        best, end = score, 0
        for i, c in enumerate(text):
            same = self.bits.get(c, 0)
            vertical = same | down
            diagonal = (((same & up) + up) ^ up) | same
            plus = down | ~(diagonal | up)
            minus = up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            plus, minus = plus << 1, minus << 1
            up = (minus | ~(vertical | plus)) & full
            down = plus & vertical & full
        return best, end


class Matcher:
    """All items of one block, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if text := plain(text or ""):
                k = int(error_rate * len(text))
                for a, b in pieces(len(text), k):
                    places.setdefault(text[a:b], []).append((len(self.items), a))
                self.items.append((item_id, text, k))
        self.find = ahocorasick.Automaton()
        for piece, where in places.items():
            self.find.add_word(piece, (len(piece), where))
        self.find.make_automaton()
        self.patterns: dict[int, tuple[EditPattern, EditPattern]] = {}

    def pattern(self, i: int) -> tuple[EditPattern, EditPattern]:
        if i not in self.patterns:
            text = self.items[i][1]
            self.patterns[i] = EditPattern(text), EditPattern(text[::-1])
        return self.patterns[i]

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item hit, the stretches of text that may hold it; overlapping ones are one."""
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.find.iter(text):
            for i, offset in where:
                starts.setdefault(i, set()).add(last + 1 - size - offset)
        out: dict[int, list[tuple[int, int]]] = {}
        for i, at in starts.items():
            _, item, k = self.items[i]
            merged = out[i] = []
            for s in sorted(at):
                a, b = max(0, s - k), min(len(text), s + len(item) + k)
                if merged and a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item that the text holds; places in plain(text)."""
        text = plain(text or "")
        best: dict[int, tuple[int, int, int, int]] = {}
        if not self.items or not text:
            return []
        for i, spans in self.windows(text).items():
            item_id, item, k = self.items[i]
            forward, backward = self.pattern(i)
            for a, b in spans:
                distance, end = forward.search(text[a:b])
                if distance > k or (item_id in best and best[item_id][1] < distance):
                    continue
                end += a
                _, back = backward.search(text[max(0, end - len(item) - k) : end][::-1])
                found = (item_id, distance, end - back, end)
                if item_id not in best or found[1:] < best[item_id][1:]:
                    best[item_id] = found
        return sorted(best.values(), key=lambda m: (m[0] is not None, m[0]))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, in blocks of about block_chars characters; only one block is brought to the driver at a time."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n = number_of_blocks(items, block_chars)
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def number_of_blocks(benchmark: DataFrame, block_chars: int) -> int:
    total = benchmark.select("item_id", "text").where("text is not null").distinct().agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // block_chars))


#: The matcher that this process used last, and the items and rate that it is for.
_last: list = [None, None]


def _matcher(items: list[tuple[int, str]], error_rate: float) -> Callable[[], Matcher]:
    def make() -> Matcher:
        key = (error_rate, items)
        if _last[0] != key:  # tasks of one process share it
            _last[:] = key, Matcher(items, error_rate)
        return _last[1]

    return make


def _match_block(docs: DataFrame, items: list[tuple[int, str]], error_rate: float, row: str) -> DataFrame:
    """(row..., doc_id, item_id, distance, start, end) by the items of one block."""
    make_matcher = _matcher(items, error_rate)
    keys = [row, "doc_id"] if row else ["doc_id"]

    def make():
        found = make_matcher()

        def f(*columns):
            *ids, texts = columns
            rows = [(*own, *m) for *own, t in zip(*ids, texts, strict=True) for m in found.matches(t)]
            return tuple([r[i] for r in rows] for i in range(len(keys) + 4))

        return f

    return map_rows(docs, [*keys, "text"], ", ".join(f"{k} bigint" for k in keys) + f", {MATCHES}", make)


def match(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): a row for each item that a document holds, at its best place."""
    if number_of_blocks(benchmark, block_chars) == 1:
        return _match_block(docs, next(item_blocks(benchmark, block_chars)), error_rate, "")
    # texts of one item may lie in several blocks: rows are numbered, and the best of each row and item is taken
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "documents")
    parts = [materialise(_match_block(rows, items, error_rate, "_row"), "matches") for items in item_blocks(benchmark, block_chars)]
    found = reduce(DataFrame.unionAll, parts).groupBy("_row", "doc_id", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("m"))
    return found.select("doc_id", "item_id", "m.distance", "m.start", "m.end")


def leaked_items(text: Column, items: list[tuple[int, str]], error_rate: float = ERROR_RATE) -> Column:
    """How many items of one block a text holds."""
    make_matcher = _matcher(items, error_rate)

    def make():
        found = make_matcher()
        return lambda texts: [len(found.matches(t)) for t in texts]

    return column("int", make, text)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    n = number_of_blocks(benchmark, block_chars)
    for i, items in enumerate(item_blocks(benchmark, block_chars)):
        docs = docs.where(leaked_items(F.col("text"), items, error_rate) == 0)
        if i + 1 < n:  # so that one block at a time is held
            docs = materialise(docs, "clean")
    return docs
