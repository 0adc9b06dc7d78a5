"""Language identification by rank-order profiles.

A profile ranks the most frequent character n-grams (1 to 3 letters, word ends count as a letter) of a language. A
document's own ranking is compared with each profile by the out-of-place distance: for each of its n-grams, how many
ranks apart the two places are, or PROFILE where the profile doesn't have it. The nearest language wins; ties go to the
first in alphabetical order. The score is 1 minus the distance over the largest possible one.

Profiles are learned from about MAX_DOCS documents of each language at most, chosen by hashed id; the bound is a
parameter. Prediction reads whole texts and nothing else.

Defined results: null texts, texts without letters, and all texts if nothing could be learned are "und" with score 0.
Repeated documents each get a row. Documents with a null doc_id or language are never learned from. Other columns aren't
looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import column, map_rows, materialise

PROFILE = 300
MAX_DOCS = 2000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_BITS = 21  # of a code point
_GAP = 32


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as packed code points, counts); a word's ends count as a blank."""
    words = _WORD.findall((text or "").lower())
    if not any(any(map(str.isalpha, w)) for w in words):  # signs for numbers aren't letters
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = c != _GAP
    two = c[:-1] << _BITS | c[1:]
    three = (two[:-1] << _BITS | c[2:])[letter[1:-1]]
    return np.unique(np.concatenate([c[letter], two, three]), return_counts=True)


def ranking(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts in the n-grams' own order."""
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass
class Profiles:
    """ranks[i, l]: place of n-gram grams[i] in language l, or -1."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int = PROFILE

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int = PROFILE) -> Profiles:
        languages = sorted(ranked)
        grams = np.array(sorted({g for r in ranked.values() for g in r}), dtype=np.int64)
        ranks = np.full((len(grams), len(languages)), -1, dtype=np.int64)
        for j, name in enumerate(languages):
            own = np.array(ranked[name][:size], dtype=np.int64)
            ranks[np.searchsorted(grams, own), j] = np.arange(len(own))
        return cls(languages, grams, ranks, size)

    def identify(self, text: str | None) -> tuple[str, float]:
        own = ranking(*ngrams(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(own)))


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, size: int = PROFILE) -> Profiles:
    """Learn from documents outside the held-out fold (remainder 2 of 4) that have a language."""
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null").where(fold(4) != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles.of({}, size)
    scale = 1_000_000
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, scale if n <= max_docs else scale * max_docs // n)))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("lang")])

    def make():
        def f(langs, texts):
            total: dict[str, Counter] = {}
            for lang, t in zip(langs, texts, strict=True):
                grams, n = ngrams(t)
                total.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
            rows = [(lang, g, n) for lang, c in total.items() for g, n in c.items()]
            return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

        return f

    grams = map_rows(sample, ["lang", "text"], "lang string, gram bigint, n bigint", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "grams")
    ranked = {}
    for lang in counts:  # a top-k for each language: each task sends its best only
        top = grams.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(size)
        ranked[lang] = [r["gram"] for r in top.select("gram", "n").collect()]
    return Profiles.of({k: v for k, v in ranked.items() if v}, size)


def identify(text: Column, profiles: Profiles) -> Column:
    """struct<lang, score> of each text."""

    def make():
        return lambda texts: [dict(zip(("lang", "score"), profiles.identify(t), strict=True)) for t in texts]

    return column("struct<lang:string,score:double>", make, text)
