"""Ranked lexical search: an Aho-Corasick automaton of all item terms scans whole documents.

1. The items' terms become one automaton, each with a boundary on both sides, so a match is
   a whole term of the document. One scan of a text gives the occurrences of every term;
   documents need no index. What it finds is written, a row for each document with a term.
2. Corpus figures (documents, terms, documents of each term) are sums over that table.
3. Scores are worked out from it. A term's number leads to the items that hold it; a task
   keeps the best documents of each item, and these meet in two steps.

The automaton and its outputs are broadcast while the items' terms stay below ``ITEM_BYTES``.
Larger query sets are joined by term instead, with the same result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.exchange import joined, stored

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BEST = 50
#: Bound of what is broadcast: bytes of the items' terms plus 8 for each item of a term.
ITEM_BYTES = 4 << 20
#: Documents are scored together up to so many (document, item) cells or term occurrences in items.
CELLS = 2 << 20
GROUPS = 64

_TERM_BYTE = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if _TERM_BYTE[b] else 32 for b in range(256))

COUNT_SCHEMA = "doc_id bigint, part int, at bigint, n bigint, terms binary, tf binary"
COUNT_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])
BAG_SCHEMA = "doc_id bigint, part int, at bigint, n bigint, bag array<struct<term:string,tf:bigint>>"
DF_SCHEMA = "term int, df bigint"
FOUND_SCHEMA = "item int, part int, doc_id bigint, score bigint"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term); the rows of one item_id, also of null, are one item."""
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(f"({TERM})"), 1)).alias("term")).distinct()


def _folded(text: str | None) -> bytes:
    """Bytes of the text with a space on both sides: A-Z folded, everything between terms a space."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_FOLD) + b" "


def _length(data: bytes) -> int:
    gap = np.frombuffer(data, np.uint8) == 32
    return int(np.count_nonzero(gap[:-1] & ~gap[1:]))


def _scan(terms):
    """Rows of COUNT_SCHEMA for the documents of a task that have a term."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms.value):
            automaton.add_word(f" {term.decode('latin-1')} ", i)
        if terms.value:
            automaton.make_automaton()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _folded(text)
                n = _length(data)
                if n:
                    found = Counter(map(itemgetter(1), automaton.iter(data.decode("latin-1")))) if terms.value else {}
                    rows.append((doc_id, part, at, n, np.fromiter(found, np.uint32, len(found)).tobytes(),
                                 np.fromiter(found.values(), np.uint32, len(found)).tobytes()))
                    at += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNT_ARROW, strict=True)], schema=COUNT_ARROW)
    return task


def _frequencies(n_terms: int):
    """How many documents of a task hold each term."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(joined(batch.column("terms").to_pylist(), np.uint32), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])
    return task


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Best:
    """The best documents of each item that a task has seen."""

    def __init__(self, items: int, keep: int):
        self.items, self.keep = items, keep
        self.least = np.ones(items, np.int64)  # a document below this score is out
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.doc, self.lacks = np.zeros(0, np.int64), np.zeros(0, bool)  # lacks: has no id, so comes last

    def add(self, scores: np.ndarray, docs: np.ndarray, lacks: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        row, item = np.nonzero(scores >= self.least)
        self.item, self.score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        self.doc, self.lacks = np.concatenate([self.doc, docs[row]]), np.concatenate([self.lacks, lacks[row]])
        if len(self.item) > 4 * self.keep * self.items:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.doc, self.lacks, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        order = order[rank < self.keep]
        full = rank == self.keep - 1
        self.least[item[full]] = self.score[np.lexsort((self.doc, self.lacks, -self.score, self.item))[full]]
        self.item, self.score, self.doc, self.lacks = (x[order] for x in (self.item, self.score, self.doc, self.lacks))


def _ranked(query, keep: int):
    """The best documents of a task for every item."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, holders, n_items, docs_total, terms_total = query.value
        best = Best(n_items, keep)
        for batch in batches:
            ids = batch.column("doc_id")
            docs, lacks = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            length = batch.column("n").to_numpy()
            held, tf = batch.column("terms").to_pylist(), batch.column("tf").to_pylist()
            counts = np.array([len(x) // 4 for x in held], np.int64)
            term, tf = joined(held, np.uint32).astype(np.int64), joined(tf, np.uint32).astype(np.int64)
            m = 50 + np.array([50 * int(n) * docs_total // terms_total for n in length], np.int64)
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, counts)))
            spread = starts[term + 1] - starts[term]
            owner, ends = np.repeat(np.arange(len(docs)), counts), np.cumsum(counts)
            work = np.cumsum(np.bincount(owner, spread, len(docs)) + n_items)
            a = 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + CELLS, "right")))
                e, f = ends[a - 1] if a else 0, ends[b - 1]
                # Every occurrence of a term goes to the items that hold the term.
                times = spread[e:f]
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[term[e:f]], times)
                cell = np.repeat((owner[e:f] - a) * n_items, times) + holders[at]
                each, size = np.repeat(value[e:f], times), (b - a) * n_items
                # Sums of whole numbers in two halves, each exact as a double.
                high, low = (np.bincount(cell, x, size).astype(np.int64) for x in (each >> 20, each & ((1 << 20) - 1)))
                best.add(((high << 20) + low).reshape(b - a, n_items), docs[a:b], lacks[a:b])
                a = b
        best.cut()
        part = np.full(len(best.item), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(part), pa.array(best.doc, mask=best.lacks), pa.array(best.score)],
                                         names=["item", "part", "doc_id", "score"])
    return task


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def _top(found: DataFrame, item: str, keep: int) -> DataFrame:
    """The best ``keep`` rows of each item; tasks meet in groups first, so that no group grows with them."""
    place = F.row_number().over(Window.partitionBy(item, F.pmod("part", F.lit(GROUPS))).orderBy(*_order()))
    near = found.withColumn("_place", place).filter(F.col("_place") <= keep)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(*_order()))).filter(F.col("rank") <= keep)


def _by_automaton(docs: DataFrame, pairs: DataFrame, keep: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    held: dict[str, list] = {}
    for item_id, term in pairs.collect():  # below ITEM_BYTES
        held.setdefault(term, []).append(item_id)
    terms = sorted(held)
    ids = sorted({i for group in held.values() for i in group}, key=lambda i: (i is None, i))
    number = {item_id: i for i, item_id in enumerate(ids)}
    counted = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                     .mapInArrow(_scan(context.broadcast([t.encode() for t in terms])), COUNT_SCHEMA), "term_counts")
    total, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select("terms").mapInArrow(_frequencies(len(terms)), DF_SCHEMA).groupBy("term").agg(F.sum("df")).collect()) if terms else {}
    weights = np.array([weight(total, df.get(i, 0)) for i in range(len(terms))], np.int64)
    groups = [sorted(number[i] for i in held[t]) for t in terms]
    starts = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int64)
    holders = np.array([i for g in groups for i in g], np.int64)
    query = context.broadcast((weights, starts, holders, len(ids), total, length))
    found = counted.select("doc_id", "n", "terms", "tf").mapInArrow(_ranked(query, keep), FOUND_SCHEMA)
    kind = pairs.schema["item_id"].dataType
    names = spark.createDataFrame([(i, v) for v, i in number.items()], f"item int, item_id {kind.simpleString()}")
    return _top(found, "item", keep).join(F.broadcast(names), "item")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All terms of each document with their occurrences."""
    part, at = TaskContext.get().partitionId(), 0
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), []
        for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            bag = Counter(_folded(text).split())
            if bag:
                rows.append((doc_id, part, at, sum(bag.values()), [{"term": t.decode("utf-8", "replace"), "tf": n} for t, n in bag.items()]))
                at += 1
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                                              pa.array(columns[3], pa.int64()), pa.array(columns[4], kind)], names=["doc_id", "part", "at", "n", "bag"])


def _by_join(docs: DataFrame, pairs: DataFrame, keep: int) -> DataFrame:
    """The same for items of any size: the terms of documents and items meet in a join."""
    counted = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bags, BAG_SCHEMA), "term_bags")
    total, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = 50 + F.expr(f"(50 * n * {total}) div {max(length, 1)}")
    entries = counted.select("doc_id", "part", "at", m.alias("m"), F.explode("bag").alias("b")).select("doc_id", "part", "at", "m", "b.*")
    entries = entries.join(pairs.select("term").distinct(), "term", "left_semi")
    df = entries.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.floor(1000 * F.ln((2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    each = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")
    scores = entries.join(weights, "term").join(pairs, "term").groupBy("item_id", "part", "at", "doc_id").agg(F.sum(each).alias("score"))
    return _top(scores.filter("score > 0"), "item_id", keep)


def ranked_documents(docs: DataFrame, items: DataFrame, keep: int = BEST, limit: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``keep`` best documents of each item, with a score above 0.

    Terms are runs of digits, ASCII letters (without case) and characters beyond ASCII; a null
    or empty text has none. Equal scores rank by ascending doc_id, a missing one last; rows
    equal in both are interchangeable. Repeated documents count and rank each on their own;
    repeated items and items of one id are one. An item that no document matches, or without
    terms, has no rows. Other columns are ignored.
    """
    pairs = stored(item_terms(items), "item_terms")
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    best = _by_automaton(docs, pairs, keep) if size <= limit else _by_join(docs, pairs, keep)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long").alias("score"))
