"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match pieces of a word are usually found by trying ever shorter prefixes, which takes quadratic time. Here
the vocabulary is a trie. Each trie node has a failure link and a number: when the next character has no edge, the
pieces that greedy matching would cut off before it could go on are exactly those on the way to the failure node, and
how many they are is known beforehand ("popped" pieces). A word is so read once, each character forward; only numbers
are added, and no piece is ever built.

The vocabulary has a form for the inside of a word and one with an end mark for its end. The end mark is read as one
more character behind each word. A place where no vocabulary entry fits makes the word unknown, which counts as one.

Words are the runs that the vocabulary's own split pattern yields from the lower-cased text; each is read in the
vocabulary's byte alphabet. Defined results: null and empty texts, and those of white space only, have 0 words and pieces; repeated rows
stay repeated, and rows with a null key stay; other columns aren't looked at, whatever their names; an empty table gives no
rows. Greedy matching knows no ties: the longest piece is one.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from backtrail.llm.bpe import split_space
from backtrail.llm.common import map_rows

#: The state after a place where nothing fits.
DEAD = -1
WORDS_KEPT = 300_000


class LongestMatch:
    """States are trie nodes; 0 is the root."""

    def __init__(self, vocabulary: list[str], end: str = "</w>"):
        self.end = ""  # the end mark as one character
        self.next: list[dict[str, int]] = [{}]
        self.is_piece = [False]
        for piece in vocabulary:
            body = piece.removesuffix(end) + self.end if end and piece.endswith(end) and piece != end else piece
            self._add(body)
        self._link()

    def _add(self, body: str) -> None:
        node = 0
        for c in body:
            node = self.next[node].setdefault(c, len(self.next))
            if node == len(self.next):
                self.next.append({})
                self.is_piece.append(False)
        self.is_piece[node] = True

    def _link(self) -> None:
        """Failure links and popped counts, by breadth: a node that is itself a piece pops that piece and goes on at the
        root; another one does as its parent would when the parent fails, until the node's own character fits."""
        n = len(self.next)
        self.fail, self.popped = [DEAD] * n, [0] * n
        level = [0]
        while level:
            following = []
            for node in level:
                for c, child in self.next[node].items():
                    following.append(child)
                    if self.is_piece[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    back, count = self.fail[node], self.popped[node]
                    while back != DEAD and c not in self.next[back]:
                        back, count = self.fail[back], count + self.popped[back]
                    if back != DEAD:
                        self.fail[child], self.popped[child] = self.next[back][c], count
            level = following

    def count(self, word: str) -> int:
        """How many pieces greedy longest matching cuts a word into; 1 if it can't be cut, 0 for the empty word."""
        if not word:
            return 0
        node, pieces = 0, 0
        following, fail, popped = self.next, self.fail, self.popped
        for c in word + self.end:
            while (step := following[node].get(c)) is None:
                pieces += popped[node]
                node = fail[node]
                if node == DEAD:
                    return 1
            node = step
        while node != 0:  # what is still held is popped, too
            pieces += popped[node]
            node = fail[node]
            if node == DEAD:
                return 1
        return pieces


_loaded: dict[str, tuple] = {}


def load(path: str):
    """(automaton, a function from text without white space to words in byte characters, remembered counts)."""
    if path not in _loaded:
        from backtrail.llm.bpe import ForcedBoundaryBpe, byte_characters

        bpe = ForcedBoundaryBpe(path)
        special = set(bpe.special)
        chars = byte_characters()
        automaton = LongestMatch([t for t in bpe.names if t and t not in special], bpe.end)
        _loaded[path] = automaton, lambda piece: ["".join(map(chars.__getitem__, w)) for w in bpe.words(piece)], {}
    return _loaded[path]


def count_tokens(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens) of every text. Words that occur often are read once by each worker and remembered."""

    def make():
        automaton, words_of, known = load(vocabulary)

        def numbers(piece: str) -> tuple[int, int]:
            words = words_of(piece)
            return len(words), sum(map(automaton.count, words))

        def f(keys, texts):
            n_words, n_tokens = [], []
            for t in texts:
                words = tokens = 0
                for piece, times in Counter(split_space(t or "")).items():
                    got = known.get(piece)
                    if got is None:
                        got = numbers(piece)
                        if len(known) >= WORDS_KEPT:
                            known.clear()
                        if len(piece) <= 64:
                            known[piece] = got
                    words += times * got[0]
                    tokens += times * got[1]
                n_words.append(words)
                n_tokens.append(tokens)
            return keys, n_words, n_tokens

        return f

    return map_rows(df, [key, text], f"{key} bigint, n_words bigint, n_tokens bigint", make)
