"""Dealing many small (key, document, place) entries to tasks as arrays, not as rows.

A map task sorts the entries of a batch by bucket and sends one row of packed arrays to
each bucket; Spark moves and spills these rows like any others. As many buckets as
``spark.sql.shuffle.partitions`` are used, so the size of a bucket is set the usual way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.words import mix
from stratalake.session import new_path

LAST_ID = (1 << 63) - 1

ENTRY_SCHEMA = "bucket int, docs binary, tags binary, counts binary, keys binary, places binary"
ENTRY_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "tags", "counts", "keys", "places"))])


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame) -> DataFrame:
    """One task per bucket."""
    return df.repartitionById(buckets(df.sparkSession), F.col("bucket"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder; cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and the row's identity: ``_d`` (a missing id comes last) and ``_t`` (text hash).

    Rows equal in both are interchangeable; rows that only share the id stay apart.
    """
    return docs.select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_d"),
        F.xxhash64(F.col("text")).alias("_t"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


class Entries:
    """Entries of one batch, added document by document."""

    def __init__(self, key_type=np.uint64):
        self.key_type = key_type
        self.docs, self.tags, self.keys, self.places = [], [], [], []

    def add(self, doc: int, tag: int, keys: np.ndarray, places: np.ndarray) -> None:
        self.docs.append(doc)
        self.tags.append(tag)
        self.keys.append(keys)
        self.places.append(places.astype(np.uint32))

    def batch(self, n: int) -> pa.RecordBatch:
        """A row for each bucket that has entries; keys are told apart within their bucket."""
        sizes = [len(k) for k in self.keys]
        if not sum(sizes):
            return pa.RecordBatch.from_pylist([], ENTRY_ARROW)
        keys, places = np.concatenate(self.keys), np.concatenate(self.places)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        docs, tags = np.array(self.docs, np.int64), np.array(self.tags, np.int64)
        bucket = (keys % np.uint64(n)).astype(np.int32)
        keys = (keys // np.uint64(n)).astype(self.key_type)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        columns = [[] for _ in ENTRY_ARROW.names]
        for b in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[b] : cuts[b + 1]]
            held, counts = np.unique(doc[at], return_counts=True)
            row = (docs[held], tags[held], counts.astype(np.uint32), keys[at], places[at])
            for column, value in zip(columns, (int(b), *(x.tobytes() for x in row)), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, ENTRY_ARROW, strict=True)], schema=ENTRY_ARROW)


def portions(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Whole rows of a batch, about ``limit`` bytes of text at a time; bounds a task's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def joined(rows: Iterable[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def gather(batches: Iterator[pa.RecordBatch], key_type=np.uint64):
    """All entries of a bucket: (doc, tag) tables, then index, key and place of each entry."""
    held = {c: [] for c in ENTRY_ARROW.names[1:]}
    for batch in batches:
        for c in held:
            held[c] += batch.column(c).to_pylist()
    docs, tags = joined(held["docs"], np.int64), joined(held["tags"], np.int64)
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), joined(held["counts"], np.uint32))
    return docs, tags, doc, joined(held["keys"], key_type), joined(held["places"], np.uint32)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def by_document(doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``doc`` with the places where it stands."""
    order = np.argsort(doc, kind="stable")
    first = runs(doc[order])
    for a, b in zip(first, np.append(first, len(order))[1:], strict=True):
        yield int(doc[order[a]]), order[a:b]


def by_owner(rows: Iterable[tuple[int, int, bytes]], n: int) -> pa.RecordBatch:
    """(id, text hash, 32-bit numbers) of documents, packed by the document's own bucket."""
    rows = list(rows)
    if not rows:
        return pa.RecordBatch.from_pylist([], ENTRY_ARROW)
    docs, tags = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    counts = np.array([len(r[2]) // 4 for r in rows], np.uint32)
    bucket = (mix(docs.view(np.uint64) ^ mix(tags.view(np.uint64))) % np.uint64(n)).astype(np.int32)
    packed = [(b, docs[at].tobytes(), tags[at].tobytes(), counts[at].tobytes(), None, b"".join([rows[i][2] for i in at]))
              for b, at in by_document(bucket)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*packed, strict=True), ENTRY_ARROW, strict=True)], schema=ENTRY_ARROW)


OWNED_SCHEMA = "_d bigint, _t bigint, places binary"
OWNED_ARROW = pa.schema([("_d", pa.int64()), ("_t", pa.int64()), ("places", pa.binary())])


def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a bucket with all its numbers."""
    held = {c: [] for c in ("docs", "tags", "counts", "places")}
    for batch in batches:
        for c in held:
            held[c] += batch.column(c).to_pylist()
    ids = np.stack([joined(held[c], np.int64) for c in ("docs", "tags")])
    counts, places = joined(held["counts"], np.uint32).astype(np.int64), joined(held["places"], np.uint32)
    ends = np.cumsum(counts)
    order = np.lexsort(ids[::-1])
    first = runs(mix(ids[0][order].view(np.uint64)) ^ ids[1][order].view(np.uint64))
    rows = []
    for a, b in zip(first, np.append(first, len(order))[1:], strict=True):
        own = [places[ends[i] - counts[i] : ends[i]] for i in order[a:b]]
        rows.append((int(ids[0][order[a]]), int(ids[1][order[a]]), np.concatenate(own).tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OWNED_ARROW, strict=True)], schema=OWNED_ARROW)
