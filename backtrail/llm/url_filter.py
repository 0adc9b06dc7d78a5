"""URL filters: host and path rules, and a Bloom filter cascade for host lists.

A single Bloom filter of listed hosts would block some hosts that aren't listed. In a cascade, filter 1 holds the listed
keys, filter 2 those unlisted keys of the corpus that filter 1 lets through, filter 3 the listed keys that filter 2 lets
through, and so on until none is left. As the filters are built over all keys that occur in the corpus, each of these keys
gets its exact answer: a key that first fails at an even level is listed, at an odd one it isn't.

Each level hashes a key's 128-bit fingerprint anew, so keys that agree at one level part at the next. Only listed and
unlisted keys with equal fingerprints would never part: after MAX_LEVELS levels the listed keys that are still open stand
in the cascade in full, and are compared as text.

The keys are host names; a host is listed if it or a parent domain is. The corpus's keys are distinct hosts and their
parent domains, aggregated before they are shuffled. Only keys that pass filter 1 are looked up in the list. The filters
take a few bits for each listed key. Up to MAX_BYTES one cascade is sent to all tasks, and no join is needed to use it; a
longer list is dealt by hash into parts, each with a cascade of its own that only the tasks of its part read: any number of
listed keys has its exact answer by the same method.

Defined results: a null URL, or one without "://", has an empty host and path and is allowed, whatever is listed; null and
empty listed keys list nothing; with an empty list, all hosts are unlisted. Repeated rows, and rows with a null page_id,
stay. Of several rules that fit, the longest counts (host and path together); no two rules of one length can fit unless
they are equal. Other columns of the table aren't looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import materialise

BITS_FOR_KEY = 12
PROBES = 6
#: Bytes of filters that may be sent to all tasks; a longer list is dealt into parts.
MAX_BYTES = 64 << 20
#: Bytes of filters of one part.
PART_BYTES = 8 << 20
#: Behind so many levels, what is still open is compared as text.
MAX_LEVELS = 24
_CHUNK = 32768  # bits in a bitmap of bitmap_construct_agg

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def in_domain(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; null if none does. Of equally long ones the first in order counts."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = in_domain(host, r.host) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def parents(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


_MIX = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int | np.ndarray) -> np.ndarray:
    """The probes of each key at a level, a row for each key; h1 and h2 are 64-bit hashes."""
    salt = np.uint64((2 * level + 1) * _MIX % (1 << 64))
    a, b = _mixed(h1.view(np.uint64) + salt), _mixed(h2.view(np.uint64) ^ salt) | np.uint64(1)
    out = _mixed(a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None])
    return (out % np.asarray(bits, dtype=np.uint64).reshape(-1, 1)).astype(np.int64)


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


@dataclass
class Level:
    number: int
    bits: int
    data: np.ndarray  # of bytes

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = positions(h1, h2, self.number, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level]
    #: Listed keys that passed all levels, as did some unlisted key.
    remainder: frozenset[str] = field(default_factory=frozenset)

    def decide(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is listed, which keys passed all levels), the former for keys of the universe."""
        out, open_ = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
        for i, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out, open_

    def has(self, h1: np.ndarray, h2: np.ndarray, keys: pa.Array | None = None) -> np.ndarray:
        """Whether each key is listed; exact for keys of the universe that the cascade was built over."""
        out, open_ = self.decide(h1, h2)
        if self.remainder and len(open_):
            out[open_] = [k in self.remainder for k in keys.take(pa.array(open_)).to_pylist()]
        return out

    @property
    def size(self) -> int:
        return sum(len(x.data) for x in self.levels)


def bits_for(n: Column | int):
    """Bits of a filter of n keys, whole bitmaps."""
    if isinstance(n, int):
        return -(-max(64, n * BITS_FOR_KEY) // _CHUNK) * _CHUNK
    return F.ceil(F.greatest(F.lit(64), n * BITS_FOR_KEY) / _CHUNK) * _CHUNK


def bitmaps(keys: DataFrame, level: int) -> DataFrame:
    """(part, bits, chunk, map) of a Bloom filter for each part of the keys (part, h1, h2): bitmaps are made and merged where
    the keys are."""
    sizes = keys.groupBy("part").agg(F.count("*").alias("n")).select("part", bits_for(F.col("n")).cast("bigint").alias("bits"))

    @F.arrow_udf("array<bigint>")
    def probes(h1: pa.Array, h2: pa.Array, bits: pa.Array) -> pa.Array:
        at = positions(h1.to_numpy(), h2.to_numpy(), level, bits.to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * PROBES, pa.int32()), pa.array(at.reshape(-1)))

    at = keys.join(F.broadcast(sizes), "part").select("part", "bits", F.explode(probes("h1", "h2", "bits")).alias("at"))
    return at.groupBy("part", "bits", F.floor(F.col("at") / _CHUNK).alias("chunk")).agg(F.bitmap_construct_agg((F.col("at") % _CHUNK).cast("int")).alias("map"))


def _filled(rows: Iterator[tuple[int, int, bytes]], number: int) -> Level:
    """A level of (bits, chunk, map)."""
    data = None
    for bits, chunk, part in rows:
        if data is None:
            data = np.zeros(bits // 8, dtype=np.uint8)
        data[chunk * _CHUNK // 8 :][: _CHUNK // 8] = np.frombuffer(part, dtype=np.uint8)
    return Level(number, 8 * len(data), data)


def corpus_keys(hosts: DataFrame) -> DataFrame:
    """Distinct hosts and parent domains of a column host."""
    return hosts.where("host <> ''").distinct().select(F.explode(parents(F.col("host"))).alias("key")).distinct()


def level_has(level: Level) -> Column:
    @F.arrow_udf("boolean")
    def has(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(level.has(h1.to_numpy(), h2.to_numpy()))

    return has(F.col("h1"), F.col("h2"))


def hashed(keys: DataFrame, parts: int = 1) -> DataFrame:
    """Distinct keys (key) with their hashes and part."""
    h1, h2 = hashes(F.col("key"))
    part = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    return keys.where("key <> ''").distinct().select("key", h1.alias("h1"), h2.alias("h2"), part.alias("part"))


def build(universe: DataFrame, listed: DataFrame, max_levels: int = MAX_LEVELS) -> Cascade:
    """The cascade of the listed keys over the universe (both: key)."""
    levels: list[Level] = []

    def add(keys: DataFrame) -> bool:
        rows = bitmaps(keys, len(levels)).select("bits", "chunk", "map")
        found = [tuple(r) for r in rows.toLocalIterator()]
        if found:
            levels.append(_filled(iter(found), len(levels)))
        return bool(found)

    known = materialise(hashed(listed), "listed")
    if not add(known):
        return Cascade([])
    # only what passes the first filter is looked up in the list
    passed = materialise(hashed(universe).where(level_has(levels[0])), "passed")
    both = materialise(passed.join(known.select("key", F.lit(True).alias("in")), "key", "left").withColumn("in", F.coalesce("in", F.lit(False))), "tagged")
    rest, side = {True: both.where(F.col("in")).drop("in"), False: both.where(~F.col("in")).drop("in")}, False
    while len(levels) < max_levels:
        if not add(rest[side]):
            break
        rest[not side] = materialise(rest[not side].where(level_has(levels[-1])), "level")
        side = not side
    if len(levels) < max_levels or rest[False].isEmpty() or rest[True].isEmpty():
        return Cascade(levels)
    # keys of both kinds are still open: those whose fingerprints are equal
    return Cascade(levels, frozenset(r["key"] for r in rest[True].select("key").toLocalIterator()))


def listed_udf(cascade: Cascade):
    """A function of (keys, h1, h2), arrays of a row's keys and their hashes: whether any is listed."""

    @F.arrow_udf("boolean")
    def any_listed(keys: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = h1.flatten().to_numpy(), h2.flatten().to_numpy()
        sizes = h1.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(h1)), sizes)
        hit = np.zeros(len(h1), dtype=bool)
        hit[row[cascade.has(a, b, keys.flatten())]] = True
        return pa.array(hit)

    return any_listed


def _by_part(keys: DataFrame, filters: DataFrame, what: str) -> DataFrame:
    """keys (key, h1, h2, part, side) whose filters (part, level, bits, chunk, map) say so: passed (the one level given) or
    listed (all levels). A task reads its part's filters first, then its keys as a stream."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = filters.select("part", none("string").alias("key"), none("bigint").alias("h1"), none("bigint").alias("h2"), none("boolean").alias("side"), "level", "bits", "chunk", "map")
    rows = rows.unionAll(keys.select("part", "key", "h1", "h2", "side", none("int"), none("bigint"), none("bigint"), none("binary")))
    rows = rows.repartition("part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "level", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, maps = None, {}
        levels: dict[int, Level] = {}
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts[a] != part:
                    part, maps, levels = parts[a], {}, {}
                own = batch.slice(a, b - a)
                n = own.column(1).null_count
                for level, bits, chunk, data in zip(*(own.column(i).slice(0, n).to_pylist() for i in (5, 6, 7, 8)), strict=True):
                    maps.setdefault(level, []).append((bits, chunk, data))
                own = own.slice(n)
                if not own.num_rows:
                    continue
                levels |= {i: _filled(iter(m), i) for i, m in maps.items()}
                maps = {}
                h1, h2 = own.column(2).to_numpy(), own.column(3).to_numpy()
                if what == "passed":
                    hit = levels[max(levels)].has(h1, h2) if levels else np.zeros(len(h1), dtype=bool)
                else:
                    hit = Cascade([levels[i] for i in sorted(levels)]).has(h1, h2)
                yield pa.RecordBatch.from_arrays([own.column(i) for i in (1, 2, 3, 0, 4)], names=["key", "h1", "h2", "part", "side"]).filter(pa.array(hit))

    return rows.mapInArrow(run, "key string, h1 bigint, h2 bigint, part int, side boolean")


def listed_by_parts(universe: DataFrame, listed: DataFrame, parts: int, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(key): the keys of the universe that are listed, by a cascade for each of the parts that keys are dealt into by hash.
    Filters stay in the shared folder and are read by their part's tasks only."""
    none = F.lit(None).cast("boolean").alias("side")
    known = materialise(hashed(listed, parts), "listed")
    keys = hashed(universe, parts).select("*", none)
    filters = materialise(bitmaps(known, 0).select("part", F.lit(0).alias("level"), "bits", "chunk", "map"), "filters")
    passed = materialise(_by_part(keys, filters, "passed"), "passed")
    tagged = passed.drop("side").join(known.select("key", F.lit(True).alias("in")), "key", "left").withColumn("side", F.coalesce("in", F.lit(False))).drop("in")
    tagged = materialise(tagged, "tagged")
    rest, side, level, every = {True: tagged.where("side"), False: tagged.where("not side")}, False, 1, filters
    while level < max_levels and not rest[side].isEmpty():
        own = materialise(bitmaps(rest[side], level).select("part", F.lit(level).alias("level"), "bits", "chunk", "map"), "filters")
        # a part without keys of this side needs no further level: its open keys are of the other side
        rest[not side] = materialise(_by_part(rest[not side], own, "passed"), "level")
        every, side, level = every.unionAll(own), not side, level + 1
    found = _by_part(keys, every, "listed").select("key")
    if level < max_levels or rest[False].isEmpty() or rest[True].isEmpty():
        return found
    # what is still open on both sides is decided by its text
    undecided = rest[False].unionAll(rest[True]).select("key")
    return found.join(undecided, "key", "left_anti").unionAll(rest[True].select("key"))


def is_listed(rows: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """rows (with a column host) and a boolean column listed: the host or a parent domain of it is in listed (key)."""
    universe = corpus_keys(rows.select("host"))
    n = listed.where("key <> ''").distinct().count()
    keys = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(parents(F.col("host")))
    if n * BITS_FOR_KEY // 8 <= max_bytes:
        cascade = build(universe, listed)
        if not cascade.levels:
            return rows.withColumn("listed", F.lit(False))
        return rows.withColumn("listed", listed_udf(cascade)(keys, F.transform(keys, lambda k: hashes(k)[0]), F.transform(keys, lambda k: hashes(k)[1])))
    parts = max(2, -(-n * BITS_FOR_KEY // 8 // max(1, part_bytes)))
    found = materialise(listed_by_parts(universe, listed, parts), "listed_keys")
    hosts = rows.select("host").where("host <> ''").distinct()
    hit = hosts.select("host", F.explode(parents(F.col("host"))).alias("key")).join(found, "key", "left_semi").select("host").distinct()
    hit = materialise(hit.withColumn("listed", F.lit(True)), "listed_hosts")
    return rows.join(hit, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page (page_id, url)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = is_listed(rows, listed)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    default = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, default).alias("verdict"))
