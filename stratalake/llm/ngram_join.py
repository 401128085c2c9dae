"""Exact Jaccard self-join of word-shingle sets by a universe partition.

Shingles are hashed into the segments of a size band. Two sets that reach the similarity
differ in at most h shingles, h = size * (1 - s)(1 + 1/s) / (1 + s) for either of them, so
among any h + 1 segments that a set fills one is the same in both. A set therefore walks
the segments of its band in order and sends the sum of each segment's hashes until it has
h + 1 units. Costs decide the allocation:

* plain segments come first: one key, one unit;
* the last segments of a band also send their one-deletion neighbourhood: with two or more
  shingles they stand for two units, as they still meet after one difference;
* segments made of very frequent shingles only are left out by everybody, being the
  costly ones; a set that is too short of units then sends all its segments, and a
  prefix of its shingles, least frequent first, which meets every other such set.

The shorter walk of two similar sets thus always has a key that the other one sends too.
Sets near the lower edge of a band also walk the band below. Equal sets are one class.
In a bucket the members of a key are linked to the least one only, and verified exactly;
where a key's members then lie in several components, their pairs are verified as well.
Before texts are fetched, a pair must pass its sizes and a parity sketch: a bit vector
that every shingle flips one bit of, so two sets differ in at least as many shingles as
their vectors in bits. Sets of more shingles than that vector has bits fill it whatever they
hold; what passes is held against a wider vector of theirs, with a bit or more per shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.components import components
from stratalake.llm.exchange import (
    ENTRY_SCHEMA, LAST_ID, Entries, buckets, deal, gather, identified, joined, portions, runs, stored)
from stratalake.llm.words import SHINGLE, Rolling, Words, chunks, mix, shingle_set

SIMILARITY = (75, 100)
FREQUENT_SHARE, FREQUENT_LEAST = 10_000, 32
SKETCH_BITS = 1024
DENSITY, DELETIONS = 0.45, 0.25

SET_SCHEMA = "doc_id bigint, _d bigint, _t bigint, n bigint, g1 bigint, g2 bigint, sketch array<bigint>, wide binary, often binary, times binary"
SET_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "_d", "_t", "n", "g1", "g2")), ("sketch", pa.list_(pa.int64())), ("wide", pa.binary()), ("often", pa.binary()), ("times", pa.binary())])
MATCH_SCHEMA = "list bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint"
MATCH_ARROW = pa.schema([(c, pa.int64()) for c in ("list", "a1", "a2", "b1", "b2")])


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    return tuple(int(mix(shingles ^ np.uint64(c)).sum().astype(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def parity(shingles: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The parity sketch of a set as bytes; ``bits`` is a power of two, 8 at least."""
    bit = (mix(shingles ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8))


def wide_parity(shingles: np.ndarray) -> bytes | None:
    """A sketch with at least as many bits as shingles, for sets that overfill the plain one."""
    n = len(shingles)
    return parity(shingles, 1 << (n - 1).bit_length()).tobytes() if n > SKETCH_BITS else None


def flipped(p: bytes, q: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded to the other's width."""
    x, y = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(texts: list, lower: bool, size: int) -> Iterator[tuple[int, np.ndarray]]:
    rolling = Rolling()
    for first, held in chunks(texts):
        words = Words(rolling, held, lower)
        grams = words.grams(size)
        for i in range(len(held)):
            yield first + i, shingle_set(words, grams, i, size)


def _describe(size: int):
    """Size and digest of each set, and the shingles that stand in many sets of a batch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, tags, texts = (batch.column(c).to_pylist() for c in ("doc_id", "_d", "_t", "text"))
            rows, held, seen = [], [], set()
            for i, shingles in _sets(texts, True, size):
                g = digest(shingles)
                rows.append((ids[i], own[i], tags[i], len(shingles), *g, parity(shingles).view(np.int64), wide_parity(shingles), None, None))
                if g not in seen:
                    seen.add(g)
                    held.append(shingles)
            if held:
                values, times = np.unique(np.concatenate(held), return_counts=True)
                many = times >= max(4, len(held) // FREQUENT_SHARE)
                rows.append((None, None, None, None, None, None, None, None, values[many].tobytes(), times[many].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SET_ARROW, strict=True)], schema=SET_ARROW) if rows \
                else pa.RecordBatch.from_pylist([], SET_ARROW)
    return task


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = joined(batch.column("often").to_pylist(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(joined(batch.column("times").to_pylist(), np.int64))], names=["value", "times"])


class Allocation:
    """Segments of a band of set sizes and the keys a set sends for them."""

    def __init__(self, similarity: tuple[int, int], frequent: np.ndarray, times: np.ndarray):
        self.s, self.frequent, self.times = Fraction(*similarity), frequent, times  # frequent: sorted
        self.per = (1 - self.s) * (1 + 1 / self.s) / (1 + self.s)

    def bands(self, n: int) -> list[int]:
        band = (n.bit_length() - 1) // 2
        near = band and math.ceil(self.s * n) < 4 ** band
        return [band, band - 1] if near else [band]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """How many sets hold each shingle, as far as it is frequent, else 0."""
        if not len(self.frequent):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
        return np.where(self.frequent[at] == shingles, self.times[at], 0)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        n, weights = len(shingles), self.weights(shingles)
        rare, spread, short, out = weights == 0, mix(shingles), False, []
        for band in self.bands(n):
            m = math.ceil(DENSITY * 4 ** (band + 1))
            plain = m - math.ceil(DELETIONS * m)
            need = math.floor(self.per * n) + 1
            segment = ((spread >> np.uint64(7)) % np.uint64(m)).astype(np.int64)
            filled = np.bincount(segment[rare], minlength=m)
            units = np.minimum(filled, 1)
            units[plain:] += filled[plain:] > 1
            walk = int(np.searchsorted(np.cumsum(units), need)) + 1
            short |= walk > m
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, segment, spread)
            label = mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 40))
            sent = np.flatnonzero(filled[: min(walk, m)])
            out.append(mix(sums[sent] ^ label[sent]))
            if walk > plain:
                own = (segment >= plain) & (segment < walk) & (filled[segment] > 1)
                out.append(mix((sums[segment[own]] - spread[own]) ^ label[segment[own]]))
        if short:
            prefix = n - math.ceil(self.s * n) + 1
            first = np.lexsort((spread, weights))[:prefix]
            out.append(mix(spread[first] ^ np.uint64(0x2545F4914F6CDD1D)))
        return np.unique(np.concatenate(out))


def _keys(n: int, size: int, allocation: Allocation):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("_d", "_t")), strict=True))
            least: dict[tuple[int, int], tuple[tuple[int, int], np.ndarray]] = {}
            for i, shingles in _sets(batch.column("text").to_pylist(), True, size):
                g = digest(shingles)
                if len(shingles) and (g not in least or ids[i] < least[g][0]):
                    least[g] = ids[i], shingles
            entries = Entries(np.uint32)
            for own, shingles in sorted(least.values(), key=lambda x: x[0]):
                keys = allocation.keys(shingles)
                entries.add(*own, keys, np.full(len(keys), len(shingles)))
            yield entries.batch(n)
    return task


def _meet(similarity: tuple[int, int]):
    """Links between the least member of each key and the others, and the longer member lists."""
    num, den = similarity

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g1, g2, doc, keys, sizes = gather(batches, np.uint32)
        if not len(keys):
            return
        known, node = np.unique(np.stack([g1, g2]), axis=1, return_inverse=True)
        node = node.ravel()[doc].astype(np.int64)
        order = np.lexsort((node, keys))
        k, v, n = keys[order], node[order], sizes[order].astype(np.int64)
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        k, v, n = k[once], v[once], n[once]
        first = runs(k)
        length = np.diff(np.append(first, len(k)))
        lead = np.repeat(first, length)
        other = np.flatnonzero((np.arange(len(k)) != lead))
        a, b = lead[other], other
        fits = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
        pairs = np.unique(v[a][fits] * known.shape[1] + v[b][fits])
        a, b = pairs // known.shape[1], pairs % known.shape[1]
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, *(pa.array(known[r][x]) for x in (a, b) for r in (0, 1))], schema=MATCH_ARROW)
        long = np.repeat(length > 2, length)
        v, length = v[long], length[length > 2]
        if len(length):
            first = np.cumsum(length) - length
            name = np.add.reduceat(mix(known[0][v].astype(np.uint64) ^ mix(known[1][v].astype(np.uint64))), first)
            _, kept = np.unique(name, return_index=True)
            chosen = np.zeros(len(length), bool)
            chosen[kept] = True
            rows = np.repeat(chosen, length)
            v, name = v[rows], np.repeat(name, length)[rows]
            none = pa.nulls(len(v), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(known[0][v]), pa.array(known[1][v]), none, none], schema=MATCH_ARROW)
    return task


def _possible(similarity: tuple[int, int]):
    """Pairs whose wide sketches, where both have one, do not rule the similarity out."""
    num, den = similarity

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "wa", "wb")), strict=True)
            keep = [p is None or q is None or (den + num) * flipped(p, q) <= (den - num) * (n + m) for n, m, p, q in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return task


def _verify(size: int, similarity: tuple[int, int]):
    num, den = similarity

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, np.ndarray] = {}
            sides = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            distinct = list(dict.fromkeys(sides[0] + sides[1]))
            for i, shingles in _sets(distinct, True, size):
                texts[distinct[i]] = shingles
            keep = []
            for x, y in zip(*sides, strict=True):
                p, q = texts[x], texts[y]
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * same >= num * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return task


NODE = "struct<d:bigint,t:bigint>"


def jaccard_links(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Membership and components of the exact self-join of ``docs`` on their shingle sets.

    Returns ``members`` (a row per given row: doc_id, n, node) and ``roots`` (node, root) for
    the nodes that are not the least of their component. A node is the least row (id, text
    hash) of a class of equal sets; empty sets have no node. ASCII letters are compared
    without case. A null text is empty, a missing id counts as larger than every id; rows
    that share an id but not the text are documents of their own.
    """
    spark = docs.sparkSession
    n = buckets(spark)
    rows = identified(docs)
    table = stored(rows.mapInArrow(_describe(size), SET_SCHEMA), "sets")
    sets = table.filter("n IS NOT NULL")
    often = table.filter("often IS NOT NULL").select("often", "times").mapInArrow(_unpack, "value bigint, times bigint") \
        .groupBy("value").agg(F.sum("times").alias("times"))
    # At most FREQUENT_SHARE times the mean set size of these can exist.
    least = max(FREQUENT_LEAST, sets.count() // FREQUENT_SHARE)
    common = often.filter(F.col("times") >= least).toPandas()
    frequent, times = (common[c].to_numpy(np.int64) for c in ("value", "times"))
    order = np.argsort(frequent.view(np.uint64))
    classes = stored(sets.filter("n > 0").groupBy("g1", "g2").agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_t").alias("t"))).alias("node")), "classes")
    members = sets.join(classes, ["g1", "g2"], "left").select("doc_id", "n", "node")
    ids = stored(sets.filter("n > 0").select("_d", "_t", "g1", "g2").distinct().join(classes, ["g1", "g2"]).select("_d", "_t", "node"), "ids")
    sketches = sets.filter("n > 0").select(F.struct(F.col("_d").alias("d"), F.col("_t").alias("t")).alias("node"), "n", "sketch") \
        .join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"])

    allocation = Allocation(similarity, frequent.view(np.uint64)[order], times[order])
    met = stored(deal(rows.select("_d", "_t", "text").mapInArrow(_keys(n, size, allocation), ENTRY_SCHEMA))
                 .mapInArrow(_meet(similarity), MATCH_SCHEMA), "met")
    named = [ids.select(F.col("_d").alias(f"{x}1"), F.col("_t").alias(f"{x}2"), F.col("node").alias(x)) for x in "ab"]
    pairs = met.filter("list IS NULL").select("a1", "a2", "b1", "b2").distinct() \
        .join(named[0], ["a1", "a2"]).join(named[1], ["b1", "b2"]).filter("a != b") \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    num, den = similarity
    flips = reduce(add, (F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_BITS // 64)))
    possible = (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & ((den + num) * flips <= (den - num) * (F.col("na") + F.col("nb")))
    side = {x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"}
    met_pairs = pairs.join(side["a"], "a").join(side["b"], "b").filter(possible).select("a", "b")

    texts = rows.select("_d", "_t", "text")
    wide = sets.filter("wide IS NOT NULL").select(F.struct(F.col("_d").alias("d"), F.col("_t").alias("t")).alias("node"), "n", "wide") \
        .dropDuplicates(["node"])
    wider = [wide.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(wider[0], "a", "left").join(wider[1], "b", "left").select("a", "b", "na", "nb", "wa", "wb") \
            .mapInArrow(_possible(similarity), f"a {NODE}, b {NODE}")
        left = texts.select(F.col("_d").alias("ad"), F.col("_t").alias("at"), F.col("text").alias("text_a"))
        right = texts.select(F.col("_d").alias("bd"), F.col("_t").alias("bt"), F.col("text").alias("text_b"))
        return pairs.selectExpr("a", "b", "a.d AS ad", "a.t AS at", "b.d AS bd", "b.t AS bt") \
            .join(left, ["ad", "at"]).join(right, ["bd", "bt"]).select("a", "b", "text_a", "text_b") \
            .mapInArrow(_verify(size, similarity), f"a {NODE}, b {NODE}")

    links = stored(verified(met_pairs), "links")
    roots = components(links)
    placed = named[0].join(roots.withColumnRenamed("node", "a"), "a", "left").select("a1", "a2", "a", F.coalesce("root", "a").alias("root"))
    lists = met.filter("list IS NOT NULL").select("list", "a1", "a2").distinct().join(placed, ["a1", "a2"]).select("list", "a", "root")
    split = lists.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("list")
    apart = stored(lists.join(split, "list").distinct(), "apart")
    if not apart.isEmpty():
        # Only sizes of one class or of neighbouring ones can reach the similarity; what
        # sketches rule out is never made a row.
        width = -math.log(num / den)
        held = apart.join(side["a"], "a").withColumn("class", F.floor(F.log("na") / width + 1e-9))
        other = held.select("list", F.explode(F.array("class", F.col("class") + 1)).alias("class"),
                            F.col("a").alias("b"), F.col("root").alias("other"), F.col("na").alias("nb"), F.col("sa").alias("sb"))
        larger = F.expr("root != other AND (na > nb OR na = nb AND a > b)")
        left, right = held.alias("x"), other.alias("y")
        rest = left.join(right, (F.col("x.list") == F.col("y.list")) & (F.col("x.class") == F.col("y.class")) & larger & possible) \
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = stored(verified(rest.join(pairs, ["a", "b"], "left_anti")), "links")
        roots = components(links.unionByName(more))
    return members, roots


def jaccard_components(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id (least id linked with the row) of each given row.

    Empty sets are linked with nothing and are their own component; a component of rows
    without ids has none. See ``jaccard_links``.
    """
    members, roots = jaccard_links(docs, size, similarity)
    root = F.coalesce(F.coalesce("root", "node")["d"], "doc_id")
    return members.join(roots, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(root < LAST_ID, root).alias("component_id"))
