"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever produce a token of the vocabulary. So where two neighbouring bytes of a word occur next to each
other inside no token, no merge can bridge them: that place is a certain cut. Each word is cut at all such places, the
fragments are encoded independently of each other (and remembered), and their ids are concatenated.

Words are independent of each other too, and white space is dropped by this kind of tokenizer, so a text is taken apart
at white space first and everything after that is a function of one short piece, whatever the length of the text.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; equal texts give
equal results; rows are never merged or dropped, so repeated rows, and rows with a null key, stay. Of pairs that could be
merged the one of least rank is, from the left. Other columns aren't looked at, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from backtrail.llm.common import map_rows

#: Pieces remembered in one Python worker; beyond that the memory is emptied and filled anew (about 80 MB at most).
PIECES_KEPT = 300_000
LONG_PIECE = 64
_NONE = np.iinfo(np.int64).max
#: Code points that str.split() takes for white space and the tokenizer's patterns don't.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile("[" + "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "]+")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


def split_space(text: str) -> list[str]:
    """The runs between white space as the vocabulary's pattern has it: four separators that str.split() takes for white
    space belong to the runs."""
    return _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()


class ForcedBoundaryBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([ids[c] for c in chars], dtype=np.int64)
        self.last = np.array([ids[c + self.end] for c in chars], dtype=np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([ids[x] << 32 | ids[y] for x, y in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[x + y] for x, y in pairs], dtype=np.int64)
        self.joined = self._pairs_inside_tokens(ids)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        # the library's own normaliser and word splitter serve pieces beyond ASCII: they fix the version of Unicode
        whole = Tokenizer.from_file(path)
        self.normalise, self.words_of = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.ascii_words = regex.compile(split["pattern"]["Regex"]).findall
        self.special_rx = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.pieces: dict[str, bytes] = {}

    def _pairs_inside_tokens(self, ids: dict[str, int]) -> np.ndarray:
        """[a, b]: bytes a and b stand next to each other inside some token."""
        joined = np.zeros((256, 256), dtype=bool)
        for t in ids:
            body = [self.byte_of[c] for c in (t.removesuffix(self.end) if self.end else t)]
            joined[body[:-1], body[1:]] = True
        return joined

    def words(self, piece: str) -> list[bytes]:
        """The words of a piece without white space, as bytes."""
        if piece.isascii() and not _ODD_SPACE.search(piece):
            lower = piece.lower()
            return [lower.encode()] if lower.isalpha() else [w.encode() for w in self.ascii_words(lower)]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.words_of(self.normalise(piece))]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. Fragments never exchange anything."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        head = np.ones(len(data), dtype=bool)  # where a fragment begins: at each word, and at each certain cut
        head[1:] = ~self.joined[data[:-1], data[1:]]
        head[ends[:-1]] = True
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        done_symbols, done_place = [], []
        place = np.arange(len(data))
        while len(symbols):
            starts = np.flatnonzero(head)
            rank = np.full(len(symbols), _NONE)  # of the pair that a symbol forms with the next one
            inside = np.flatnonzero(~head[1:])
            keys = symbols[inside] << 32 | symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank[inside] = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(starts, append=len(symbols))
            over = np.repeat(best == _NONE, size)
            if over.any():
                done_symbols.append(symbols[over])
                done_place.append(place[over])
            merge = (rank == np.repeat(best, size)) & ~over
            # of pairs that overlap (a a a), the first, third, ... are merged
            follows = merge.copy()
            follows[0] = False
            follows[1:] &= merge[:-1]
            if follows.any():
                at = np.arange(len(merge))
                run = np.maximum.accumulate(np.where(merge & ~follows, at, 0))
                merge &= (at - run) % 2 == 0
            symbols = np.where(merge, self.made[np.where(merge, rank, 0)], symbols)
            keep = ~over
            keep[1:] &= ~merge[:-1]
            symbols, place, head = symbols[keep], place[keep], head[keep]
        if not done_symbols:
            return symbols, np.zeros(len(words), dtype=np.int64)
        place = np.concatenate(done_place)
        order = np.argsort(place, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(word[place], minlength=len(words))

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't remembered yet, all at once."""
        words = [self.words(p) for p in pieces]
        flat = [w for ws in words for w in ws]
        ids, count = self.encode_words(flat) if flat else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        data = ids.astype("<u4").tobytes()
        at, word_ends = 0, np.concatenate([[0], np.cumsum(count)]) * 4
        for p, ws in zip(pieces, words, strict=True):
            self.pieces[p] = data[word_ends[at] : word_ends[at + len(ws)]]
            at += len(ws)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        runs = [self.special_rx.split(t) if self.special and "<|" in t else [t] for t in texts]
        split = [[split_space(x) if not i % 2 else x for i, x in enumerate(r)] for r in runs]
        new = set().union(*(x for r in split for x in r[::2])).difference(self.pieces)
        if len(self.pieces) + len(new) > PIECES_KEPT:
            self.pieces.clear()
            new = set().union(*(x for r in split for x in r[::2]))
        self.learn(list(new))
        known = self.pieces.__getitem__
        out = [b"".join(b"".join(map(known, x)) if not i % 2 else self.special[x].to_bytes(4, "little") for i, x in enumerate(r)) for r in split]
        for p in new:
            if len(p) > LONG_PIECE:  # long pieces hardly ever return, and would fill the memory
                del self.pieces[p]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """As the tokenizer file has no decoder: the tokens' strings, special ones too, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


_loaded: dict[str, ForcedBoundaryBpe] = {}


def load(path: str) -> ForcedBoundaryBpe:
    """The vocabulary of a file, kept in this process; what it has remembered stays for the next task."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text."""

    def make():
        bpe = load(vocabulary)
        return lambda keys, texts: (keys, [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode_all([t or "" for t in texts])])

    return map_rows(df, [key, text], f"{key} bigint, ids array<int>", make)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every id list; a null list counts as empty."""

    def make():
        bpe = load(vocabulary)
        return lambda keys, lists: (keys, [bpe.decode(x or ()) for x in lists])

    return map_rows(df, [key, ids], f"{key} bigint, text string", make)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: (key, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for."""

    def make():
        bpe = load(vocabulary)

        def f(keys, texts):
            encoded = bpe.encode_all([t or "" for t in texts])
            ids = [np.frombuffer(x, dtype="<u4") for x in encoded]
            n = [len(x) for x in ids]
            a = [hashlib.sha256(x).hexdigest() for x in encoded]
            b = [hashlib.sha256(bpe.decode(x.tolist()).encode()).hexdigest() for x in ids]
            return (keys, n, a, b, [x.astype(np.int32) for x in ids]) if with_ids else (keys, n, a, b)

        return f

    schema = f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(df, [key, text], schema, make)
