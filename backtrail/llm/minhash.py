"""Near-duplicate detection with circulant MinHash.

A document's set is its distinct k-word shingles. Only two permutations make the whole signature: the first, sigma,
scatters the set's elements; the second, pi, is shifted in a circle by 0, 1, 2, ... places for the coordinates 0, 1, 2, ...
Both are bijections of 32-bit integers. A coordinate is the smallest shifted value over the set. Coordinates are joined to
bands of ROWS; documents that agree in a band are candidates, and each candidate link is confirmed on the full sets.

How the work stays linear where a third of all documents are copies:
  * documents with equal sets are one class from the start; only its smallest doc_id takes part further;
  * in a bucket (an equal band) each class is compared with the bucket's smallest class only;
  * then linked classes are contracted, and only buckets that still hold several components are looked at again: there,
    and only between different components, blocks of documents are compared with each other, so no link is lost.
Sets enter as 64-bit hashes of shingles; sets are called equal if the SHA-256 of their sorted hashes is. A link at
similarity 0.8 shares no band with a probability of (1 - 0.8^ROWS)^BANDS, 6e-7.

Defined results: null and empty texts, and texts of white space only, have the empty set, are linked with nothing and
form their own component; with fewer than k words the whole word sequence is the one shingle. Repeated rows with one
doc_id are each returned. Null doc_ids are linked with nothing, have a null component and are kept. A similarity of exactly
the limit is a link. Other columns aren't looked at, whatever their names, and deduplicate() returns them as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import map_rows, materialise
from backtrail.llm.components import components

ROWS, BANDS = 5, 36
PERCENT = 80
TASK_DOCS = 128  # documents in a block of comparisons, about
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def scatter32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers: multiplications by odd numbers and xor-shifts."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def sigma(x: np.ndarray) -> np.ndarray:
    return scatter32(x ^ np.uint32(0x5BD1E995))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: exactly what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists])
    flat = np.empty(sizes.sum(), dtype=object)
    flat[:] = [w for x in lists for w in x]
    h = mix64(pd.util.hash_array(flat, categorize=False)) if len(flat) else np.zeros(0, dtype=np.uint64)
    out, at = [], 0
    for n in sizes:
        own, at = h[at : at + n], at + n
        span = min(k, n)
        if not n:
            out.append(own)
            continue
        s = own[: n - span + 1].copy()
        for i in range(1, span):
            s = mix64(s * _ODD + own[i : n - span + 1 + i])
        s.sort()
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out


def signatures(sets: list[np.ndarray], coordinates: int = ROWS * BANDS) -> np.ndarray:
    """One row of coordinates for each non-empty set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    scattered = sigma((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    for shift in range(coordinates):
        out[:, shift] = np.minimum.reduceat(scatter32(scattered - np.uint32(shift)), starts)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; it differs between bands."""
    bands = signature.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, (len(signature), bands)).copy()
    for r in range(rows):
        key = mix64(key * _ODD + signature[:, r::rows][:, :bands].astype(np.uint64))
    return key


def document_sets(docs: DataFrame, k: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n set size, digest of the set, bands) of every document; digests and bands of empty sets are null."""

    def f(ids, texts):
        sets = shingle_sets(texts, k)
        n = [len(s) for s in sets]
        digest, keys = [None] * len(ids), [None] * len(ids)
        full = [i for i, size in enumerate(n) if size]
        if full:
            all_keys = band_keys(signatures([sets[i] for i in full], rows * bands), rows).view(np.int64)
            for row, i in zip(all_keys, full, strict=True):
                digest[i] = hashlib.sha256(sets[i].tobytes()).digest()
                keys[i] = row
        return ids, n, digest, keys

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, n bigint, digest binary, bands array<bigint>", lambda: f)


def compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, task) whose full sets are similar enough.

    texts is a written table (doc_id, text). All pairs of one task are compared in one place, to which each document's
    text is sent once, however many pairs it is in; so tasks must be small, and should share documents.
    """
    ends = pairs.select("task", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sent = ends.join(texts, "doc_id").select("task", F.col("doc_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    rows = sent.unionAll(pairs.select("task", "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("task").sortWithinPartitions("task", F.col("b").asc_nulls_first(), "a")

    def make():
        task, sets = None, {}

        def f(tasks, a, b, text):
            nonlocal task, sets
            out: tuple[list, list] = ([], [])
            i = 0
            while i < len(tasks):
                if tasks[i] != task:
                    task, sets = tasks[i], {}
                if b[i] is None:
                    j = i
                    while j < len(tasks) and tasks[j] == task and b[j] is None:
                        j += 1
                    sets.update(zip(a[i:j], shingle_sets(text[i:j], k), strict=True))
                    i = j
                    continue
                x, y = sets[a[i]], sets[b[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out[0].append(a[i])
                    out[1].append(b[i])
                i += 1
            return out

        return f

    return map_rows(rows, ["task", "a", "b", "text"], "a bigint, b bigint", make)


def near(n: str, m: str, percent: int):
    """Sizes of two sets that may be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept is true for the smallest doc_id of a component."""
    docs = docs.select("doc_id", "text")
    sets = materialise(document_sets(docs, k, rows, bands), "sets")
    whole = sets.where("n > 0 and doc_id is not null")
    # equal sets: any row of a class has the class's size and bands
    classes = materialise(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    hubs = materialise(buckets.groupBy("key").agg(F.min_by("n", "rep").alias("hub_n"), F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"), "hubs")
    shared = materialise(buckets.join(hubs, "key"), "shared")  # (key, rep, n, hub_n, hub): buckets of several classes

    wanted = materialise(shared.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    texts = materialise(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")  # a table may repeat rows
    star = shared.where("rep <> hub").where(near("n", "hub_n", percent)).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    star = materialise(star, "star")
    sizes = materialise(star.groupBy("a").agg(F.count("*").alias("size")), "sizes")
    star = star.join(sizes, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / TASK_DOCS))).alias("task"))
    links = materialise(compare(star, texts, k, percent), "links")
    linked = materialise(components(links), "components")

    found = materialise(other_links(shared, linked, texts, k, percent), "more")
    if not found.isEmpty():
        linked = materialise(components(links.unionAll(found)), "components")

    # back from classes to documents
    final = classes.select("digest", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    final = materialise(final, "final")
    out = whole.join(final, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # empty sets and rows without an id have nothing to join on; they'd all meet in one task
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, one of each group of near-copies: the one with the smallest doc_id. Of rows
    that repeat a doc_id one stays; documents with a null doc_id all stay."""
    dropped = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionAll(docs.where("doc_id is null"))


def other_links(shared: DataFrame, linked: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of one bucket that lie in different components and weren't compared with each other.

    Documents go to blocks of a bounded size: large components have blocks of their own, all others of a hub share some.
    Two blocks that meet in a bucket are one task; a block of one component needs no comparison in itself. A task counts
    all its intersections at once, so pairs are never written out, and a document is sent once to each task.
    """
    placed = shared.where("rep <> hub").join(linked, F.col("rep") == F.col("node"), "left")
    placed = materialise(placed.select("key", "rep", "n", "hub", F.coalesce("component", "rep").alias("component")), "placed")
    mixed = materialise(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "mixed")
    placed = materialise(placed.join(mixed, "key"), "mixed_rows")

    home = materialise(placed.groupBy("rep", "component").agg(F.min("hub").alias("home")), "home")
    sizes = home.groupBy("home", "component").agg(F.count("*").alias("size"))
    sizes = materialise(sizes.withColumn("large", F.col("size") >= TASK_DOCS), "sizes")
    rest = materialise(sizes.groupBy("home").agg(F.sum(F.when(~F.col("large"), F.col("size"))).alias("rest")), "rest")
    sizes = materialise(sizes.join(rest, "home"), "all_sizes")
    own = F.pmod(F.xxhash64("rep"), F.ceil(F.when(F.col("large"), F.col("size")).otherwise(F.col("rest")) / TASK_DOCS))
    pure = F.when(F.col("large"), F.col("component"))
    blocks = home.join(sizes, ["home", "component"]).select("rep", "component", pure.alias("pure"), F.xxhash64("home", F.coalesce(pure, F.lit(-1)), own).alias("block"))
    blocks = materialise(blocks, "blocks")

    met = placed.select("key", "rep", "n").join(blocks, "rep").groupBy("key", "block", "pure").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = materialise(met, "met")
    x, y = (met.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("block", "pure", "low", "high"))) for side in "xy")
    may = (
        (F.col("x_block") <= F.col("y_block")) & F.coalesce(F.col("x_pure") != F.col("y_pure"), F.lit(True))
        & (100 * F.col("x_high") >= percent * F.col("y_low")) & (100 * F.col("y_high") >= percent * F.col("x_low"))
    )
    tasks = materialise(x.join(y, "key").where(may).select("x_block", "y_block").distinct(), "tasks")
    ends = tasks.select(F.xxhash64("x_block", "y_block").alias("task"), F.explode(F.array_distinct(F.array("x_block", "y_block"))).alias("block"))
    sent = ends.join(blocks.select("block", "rep", "component"), "block")
    sent = sent.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("task", "block", "rep", "component", "text")

    def run(rows: pa.Table) -> pa.Table:
        ids, component, block = (rows[c].to_numpy() for c in ("rep", "component", "block"))
        sets = shingle_sets(rows["text"].to_pylist(), k)
        a, b = linked_pairs(sets, component, block, percent)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return sent.groupBy("task").applyInArrow(run, "a bigint, b bigint")


def linked_pairs(sets: list[np.ndarray], component: np.ndarray, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of similar sets of different components; if there are two blocks, only pairs across them."""
    n = np.array([len(s) for s in sets])
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times[column] > 1  # the rest can't be in two sets
    kept, place = np.unique(column[shared], return_inverse=True)
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, len(kept), 4096):  # bounds the matrix
        inside = (place >= at) & (place < at + 4096)
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[row[shared][inside], place[inside] - at] = 1
        both += has @ has.T
    alike = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    alike &= component[:, None] != component[None, :]
    if (block != block[0]).any():
        alike &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(alike, 1))
    return a, b
