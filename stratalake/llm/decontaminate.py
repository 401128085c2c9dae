"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. An item of n shingles of which a
document must hold ``containment`` is sketched by its m = n - ceil(containment * n) + 1
least hashes: a document that holds enough of the item holds one of any m of its
shingles, so the sketch finds every such document whatever its length, where fixed-length
signatures of long documents would miss short items. A document only looks up hashes
below the greatest one of a partition's sketches; pairs found are verified on the words.
Up to ``BLOCK_BYTES`` of items, checked, go to all tasks and documents are only scanned. A
larger set never leaves Spark: tasks sketch the items and send what documents have below the
greatest sketch hashes, the two are joined by hash, and the pairs with their texts.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import stored
from stratalake.llm.words import SHINGLE, Rolling, Words, chunks

CONTAINMENT = (75, 100)
BLOCK_BYTES, ROW_BYTES = 8 << 20, 64
#: A hash that many documents hold is joined in this many parts.
PARTS = 16
#: Sketches that a verifying task keeps.
HELD = 64

HIT_SCHEMA = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint"
HIT_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_item", "n_shared")])


class Sketches:
    """One block of items: shingles as words, and sketch hashes by (words a shingle, size band)."""

    def __init__(self, items: list[tuple[int, str]], size: int, containment: tuple[int, int]):
        share, rolling = Fraction(*containment), Rolling()
        self.ids, self.grams, self.hashes, self.width = [], [], [], []
        bands: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = Words(rolling, [(text or "").encode("utf-8", "surrogatepass")], True)
            count = len(words.hash)
            if not count:
                continue
            width = min(size, count)
            hashes, at = np.unique(words.grams(width), return_index=True)
            j, n = len(self.ids), len(hashes)
            self.ids.append(item_id)
            self.width.append(width)
            self.hashes.append(hashes)
            self.grams.append({words.text(int(i), int(i) + width) for i in at})
            for h in hashes[: n - math.ceil(share * n) + 1]:
                bands.setdefault((width, n.bit_length()), []).append((int(h), j))
        self.need = [math.ceil(share * len(g)) for g in self.grams]
        self.bands = {}
        for band, held in bands.items():
            held.sort()
            self.bands[band] = (np.array([h for h, _ in held], np.uint64), np.array([j for _, j in held]))

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(text, item) pairs that share a sketch hash."""
        out: set[tuple[int, int]] = set()
        for width in {w for w, _ in self.bands}:
            grams = words.grams(width)
            for (w, _), (hashes, items) in self.bands.items():
                if w != width or not len(grams):
                    continue
                near = np.flatnonzero(grams <= hashes[-1])
                low, high = (np.searchsorted(hashes, grams[near], side) for side in ("left", "right"))
                for at, a, b in zip(near[high > low], low[high > low], high[high > low], strict=True):
                    text = int(np.searchsorted(words.bounds, at, "right")) - 1
                    if at + width <= words.bounds[text + 1]:
                        out.update((text, int(j)) for j in items[a:b])
        return out

    def shared(self, words: Words, raw: bytes, text: int, item: int) -> int:
        """How many shingles of the item the text holds, compared as words."""
        width = self.width[item]
        first, last = words.spans(text, width)
        at = np.flatnonzero(np.isin(words.grams_of(first, last, width), self.hashes[item])) + first
        held = {b" ".join(raw[words.start[k] : words.end[k]] for k in range(i, i + width)) for i in at.tolist()}
        return len(held & self.grams[item])


def _search(sketches):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, own = Rolling(), sketches.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for first, held in chunks(batch.column("text").to_pylist()):
                words = Words(rolling, held, True)
                raw = words.buf.tobytes()
                for text, item in sorted(own.candidates(words)):
                    n = own.shared(words, raw, text, item)
                    if n >= own.need[item]:
                        rows.append((ids[first + text], own.ids[item], len(own.grams[item]), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=HIT_ARROW)
    return task


def _small(items: DataFrame, limit: int) -> list[tuple[int, str]] | None:
    """The items that have text, if those and what a row takes stay below ``limit`` bytes."""
    total = items.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if total <= limit else None


KEY = ["_k", "_k2"]
SKETCH_ARROW = pa.schema([("_i", pa.int64()), ("width", pa.int32()), ("hash", pa.int64())])
GRAM_ARROW = pa.schema([("_k", pa.int64()), ("_k2", pa.int64()), ("width", pa.int32()), ("hash", pa.int64())])
FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("_k", "_k2", "_i", "n_item", "n_shared")])


def _signed(hashes: np.ndarray) -> np.ndarray:
    """63 bits in the same order."""
    return (hashes >> np.uint64(1)).view(np.int64)


def _sketched(size: int, containment: tuple[int, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Sketches(list(zip(batch.column("_i").to_pylist(), batch.column("text").to_pylist(), strict=True)), size, containment)
            for (width, _), (hashes, at) in own.bands.items():
                ids = np.array(own.ids, np.int64)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), width, np.int32)), pa.array(_signed(hashes))], schema=SKETCH_ARROW)
    return task


def _grams(greatest: dict[int, int]):
    """Distinct hashes of each text up to the greatest sketch hash of their width."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in KEY]
            for first, held in chunks(batch.column("text").to_pylist()):
                words = Words(rolling, held, True)
                for width, most in greatest.items():
                    grams = _signed(words.grams(width))
                    at = np.flatnonzero(grams <= most)
                    text = np.searchsorted(words.bounds, at, "right") - 1
                    inside = at + width <= words.bounds[text + 1]
                    pairs = np.unique(np.stack([text[inside], grams[at[inside]]]), axis=1)
                    own = [k[first + pairs[0]] for k in keys]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(np.full(pairs.shape[1], width, np.int32)), pa.array(pairs[1])], schema=GRAM_ARROW)
    return task


def _verified(size: int, containment: tuple[int, int]):
    """Pairs of a text and an item that hold on their words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, last, words, raw = Rolling(), OrderedDict(), None, None, b""
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                own = held.pop(row["_i"], None) or Sketches([(row["_i"], row["item"])], size, containment)
                held[row["_i"]] = own
                if len(held) > HELD:
                    held.popitem(last=False)
                if last != row["text"]:
                    last = row["text"]
                    words = Words(rolling, [last.encode("utf-8", "surrogatepass")], True)
                    raw = words.buf.tobytes()
                n = own.shared(words, raw, 0, 0)
                if n >= own.need[0]:
                    rows.append((row["_k"], row["_k2"], row["_i"], len(own.grams[0]), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=FOUND_ARROW)
    return task


def _schema(arrow: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in arrow)


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """Rows with 128 bits that stand for their text; copies of a text share them."""
    return docs.select(*columns, F.xxhash64("text").alias("_k"), F.xxhash64(F.lit(1), "text").alias("_k2"))


def _joined(docs: DataFrame, numbered: DataFrame, size: int, containment: tuple[int, int]) -> DataFrame:
    """Text keys and item numbers of the pairs found, for item sets of any size.

    Each distinct text is looked at once. A hash is cut into ``PARTS`` by text, so that one
    that many documents hold is no single task.
    """
    sketches = stored(numbered.mapInArrow(_sketched(size, containment), _schema(SKETCH_ARROW)), "sketches")
    greatest = {r.width: r.most for r in sketches.groupBy("width").agg(F.max("hash").alias("most")).collect()}  # at most a row per width
    texts = _keyed(docs.filter(F.octet_length("text") > 0), "text").groupBy(*KEY).agg(F.first("text").alias("text"))
    texts = stored(texts, "distinct_texts")
    grams = texts.mapInArrow(_grams(greatest), _schema(GRAM_ARROW)).withColumn("_part", F.pmod("_k", F.lit(PARTS)))
    parts = sketches.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    pairs = grams.join(parts, ["width", "hash", "_part"]).select(*KEY, "_i").distinct()
    with_texts = pairs.join(numbered.select("_i", F.col("text").alias("item")), "_i").join(texts, KEY)
    return with_texts.mapInArrow(_verified(size, containment), _schema(FOUND_ARROW))


def _numbered(items: DataFrame) -> DataFrame:
    """The items as a written table, each row with a number of its own."""
    return stored(items.withColumn("_i", F.monotonically_increasing_id()), "items")


def contained_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE, containment: tuple[int, int] = CONTAINMENT, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of each item found in each document.

    An item is found when the document holds at least ``containment`` of its distinct
    ``size``-word shingles; ASCII letters are compared without case. An item with fewer
    words is one shingle of its own length; one without words, or null, is never found.
    Repeated rows on either side give repeated pairs; null ids are returned as null. Items of
    up to ``limit`` bytes are sent to all tasks; the result is the same either way.
    """
    wanted = items.select("item_id", "text").filter(F.octet_length("text") > 0)
    small = _small(wanted, limit)
    if small is not None:
        sketches = docs.sparkSession.sparkContext.broadcast(Sketches(small, size, containment))
        out = docs.select("doc_id", "text").mapInArrow(_search(sketches), HIT_SCHEMA)
    else:
        numbered = _numbered(wanted)
        found = _joined(docs, numbered, size, containment)
        out = _keyed(docs, "doc_id").join(found, KEY).join(numbered.select("_i", "item_id"), "_i").select(
            F.col("doc_id").cast("long"), F.col("item_id").cast("long"), "n_item", "n_shared")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _clean(sketches):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, own = Rolling(), sketches.value
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for first, held in chunks(batch.column("text").to_pylist()):
                words = Words(rolling, held, True)
                raw = words.buf.tobytes()
                for text, item in own.candidates(words):
                    if kept[first + text]:
                        kept[first + text] = own.shared(words, raw, text, item) < own.need[item]
            yield batch.filter(pa.array(kept))
    return task


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, containment: tuple[int, int] = CONTAINMENT, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no item (see ``contained_items``)."""
    wanted = items.select("item_id", "text").filter(F.octet_length("text") > 0)
    small = _small(wanted, limit)
    if small is not None:
        sketches = docs.sparkSession.sparkContext.broadcast(Sketches(small, size, containment))
        return docs.mapInArrow(_clean(sketches), docs.schema)
    dirty = _joined(docs, _numbered(wanted), size, containment).select(*KEY).distinct()
    return _keyed(docs, F.struct("*").alias("_row")).join(dirty, KEY, "left_anti").select("_row.*")
