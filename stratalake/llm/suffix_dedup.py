"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

Sorting every suffix would move many times the corpus. Only suffixes that can tie for
``window`` bytes matter, and a cover sample finds them: from every window of that many
bytes the place of the least of its ``seed``-byte hashes is sampled, so two equal windows
have a sampled place at the same distance from their start. (An arithmetic difference cover
has the same property for all pairs of places and needs about three times as many samples.)

1. Sampled places are dealt by hash; places whose seed stands in one text only are done.
2. The bytes around the other places are dealt in buckets by seed, one bucket at a time is
   held. The suffixes at its sampled places are sorted and ranked, with the length that each
   has in common with the next.
3. Any other suffix of the bucket is the bytes up to its sampled place and that place's rank:
   ranks between which nothing shorter than the bytes left is common are a tie. So suffixes
   are compared byte by byte from their sampled place back, and by ranks for what is behind
   it, however long; nothing but ranks and one byte for each suffix is held at a time.

Every window that equals one in a smaller document is found. Copies of whole texts are
settled beforehand from hashes of a text. Windows are compared as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import (
    ENTRY_ARROW, ENTRY_SCHEMA, OWNED_SCHEMA, Entries, buckets, by_document, by_owner, deal, gather, identified, joined, owned,
    portions, runs, stored)
from stratalake.llm.words import Rolling, chunks, least_places

WINDOW, SEED = 50, 20

PART_SCHEMA = "bucket int, docs binary, tags binary, lengths binary, starts binary, offsets binary, texts binary"
PART_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "tags", "lengths", "starts", "offsets", "texts"))])
#: Suffixes whose bytes are laid out at a time.
LAID_OUT = 1 << 15


class Cover:
    """Sampled places of some texts, with the windows each is the least seed of."""

    def __init__(self, rolling: Rolling, texts: list[bytes], window: int, seed: int):
        self.window, self.rolling = window, rolling
        buf = np.frombuffer(b" ".join(texts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.sums = rolling.sums(buf)
        inside = np.zeros(len(buf), bool)
        for a, t in zip(self.at, texts, strict=False):
            inside[a : max(a, a + len(t) - window + 1)] = True
        hashes = rolling.windows(self.sums, seed)
        self.places, self.low, self.high = least_places(hashes, np.flatnonzero(inside), window - seed + 1)
        self.keys = hashes[self.places]
        self.cuts = np.searchsorted(self.low, self.at)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the given ranges, and the range each comes from."""
    sizes = last - first + 1
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


def _later(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which keys also stand in a smaller document."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    if len(first):
        least = np.minimum.reduceat(docs[order], first)
        out[order] = docs[order] > np.repeat(least, np.diff(np.append(first, len(keys))))
    return out


def _suffix_ranks(buf: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each suffix among all in byte order, and how many bytes each in that order has
    in common with the one before. Suffixes end after ``length`` bytes, ``window`` at most."""
    laid, column = np.zeros((len(start), window), np.uint8), np.arange(window)
    for a in range(0, len(start), LAID_OUT):
        own = slice(a, a + LAID_OUT)
        at = np.minimum(start[own, None] + column, len(buf) - 1)
        laid[own] = np.where(column < length[own, None], buf[at], 0)
    order = np.argsort(laid.view(f"S{window}").ravel(), kind="stable")
    common = np.zeros(len(start), np.int64)
    for a in range(1, len(start), LAID_OUT):
        here = order[a : a + LAID_OUT]
        differ = laid[here] != laid[order[a - 1 : a - 1 + len(here)]]
        common[a : a + len(here)] = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    place = np.empty(len(start), np.int64)
    place[order] = np.arange(len(start))
    return place, common


def late_windows(buf: np.ndarray, at: np.ndarray, offset: np.ndarray, count: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Which windows also stand in a smaller document, by stretch and then by start.

    A stretch of bytes begins at ``at``, has its sampled place ``offset`` bytes on, and
    ``count`` windows that all hold the seed there.
    """
    first = np.cumsum(count) - count
    late = np.zeros(int(count.sum()), bool)
    if not len(late):
        return late
    rank, common = _suffix_ranks(buf, at + offset, count - 1 + window - offset, window)
    left, before = np.arange(len(at)), np.zeros(len(at), np.int64)  # stretches that reach back so far, and what they hold there
    for back in range(int(offset.max()) + 1):
        if back:
            long = offset[left] >= back
            left, before = left[long], before[long]
            _, before = np.unique(before * 256 + buf[at[left] + offset[left] - back], return_inverse=True)
        tie = np.cumsum(common < window - back)  # suffixes that are equal for the bytes left
        has = offset[left] - back < count[left]
        here = left[has]
        found = _later(before[has] * (len(tie) + 1) + tie[rank[here]], docs[here])
        late[(first[here] + offset[here] - back)[found]] = True
    return late


def _sample(n: int, window: int, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in (part for whole in batches for part in portions(whole)):
            ids, tags, texts = (batch.column(c).to_pylist() for c in ("_d", "_t", "text"))
            entries, least = Entries(), {}
            for d, t in zip(ids, tags, strict=True):
                least[t] = min(d, least.get(t, d))
            for first, held in chunks(texts):
                cover = Cover(rolling, held, window, seed)
                for k in range(len(held)):
                    if least.get(tags[first + k]) == ids[first + k]:
                        del least[tags[first + k]]  # one of several copies is enough
                        own = slice(cover.cuts[k], cover.cuts[k + 1])
                        entries.add(ids[first + k], tags[first + k], cover.keys[own], cover.places[own] - cover.at[k])
            yield from _combined(entries, n)
    return task


def _combined(entries: Entries, n: int) -> Iterator[pa.RecordBatch]:
    """What a batch sends: of a key in several of its texts, all found places and two witnesses."""
    if not sum(map(len, entries.keys)):
        return
    keys, doc = np.concatenate(entries.keys), np.repeat(np.arange(len(entries.keys)), [len(k) for k in entries.keys])
    places = np.concatenate(entries.places)
    order = np.argsort(keys, kind="stable")  # by key, then by text
    k, d = keys[order], doc[order]
    first = runs(k)
    length = np.diff(np.append(first, len(k)))
    many = np.repeat(d[first] != d[first + length - 1], length)
    ends = np.zeros(len(k), bool)
    ends[first] = ends[first + length - 1] = True
    found = order[many]
    yield by_owner(((entries.docs[i], entries.tags[i], places[found[at]].tobytes()) for i, at in by_document(doc[found])), n)
    sent = np.sort(order[~many | ends])
    cuts = np.searchsorted(doc[sent], np.arange(len(entries.keys) + 1))
    out = Entries(np.uint32)
    for i in np.flatnonzero(np.diff(cuts)):
        at = sent[cuts[i] : cuts[i + 1]]
        out.add(entries.docs[i], entries.tags[i], keys[at], places[at])
    yield out.batch(n)


def _shared(n: int):
    """Places whose seed stands in more than one text; those found in a batch are passed on."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = []
        for batch in batches:
            settled = batch.column("keys").is_null()
            yield batch.filter(settled)
            dealt.append(batch.filter(pc.invert(settled)))
        docs, tags, doc, keys, places = gather(dealt, np.uint32)
        order = np.argsort(keys, kind="stable")
        first = runs(keys[order])
        if len(first):
            tag = tags[doc[order]]
            many = np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)
            kept = order[np.repeat(many, np.diff(np.append(first, len(order))))]
            yield by_owner(((int(docs[d]), int(tags[d]), places[kept[at]].tobytes()) for d, at in by_document(doc[kept])), n)
    return task


def _ranges(starts: np.ndarray) -> bytes:
    """Sorted window starts as (first, last) pairs of consecutive ones."""
    breaks = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]
    return np.stack([first, last], axis=1).astype(np.uint32).tobytes()


def _suffixes(n: int, window: int, seed: int):
    """Bytes around the places of each text, by bucket; what the batch itself settles is passed on."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in (part for whole in batches for part in portions(whole)):
            ids, tags, texts, lists = (batch.column(c).to_pylist() for c in ("_d", "_t", "text", "places"))
            parts, bytes_of = [], []
            for first, held in chunks(texts):
                cover = Cover(rolling, held, window, seed)
                wanted = np.concatenate([np.unique(np.frombuffer(lists[first + k], np.uint32)).astype(np.int64) + cover.at[k] for k in range(len(held))])
                at = np.searchsorted(cover.places, wanted)
                text = np.searchsorted(cover.at, wanted, "right") - 1
                parts.append((cover.keys[at], cover.low[at] - cover.at[text], cover.high[at] - cover.at[text], wanted - cover.at[text], text + first))
                bytes_of += held
            if not parts:
                continue
            key, low, high, place, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(key):
                continue
            stretches = [bytes_of[i][x:y] for i, x, y in zip(text.tolist(), low.tolist(), (high + window).tolist(), strict=True)]
            lengths = high - low + window
            id_of, tag_of = np.array(ids, np.int64), np.array(tags, np.int64)
            late = late_windows(np.frombuffer(b"".join(stretches), np.uint8), np.cumsum(lengths) - lengths, place - low, high - low + 1, id_of[text], window)
            starts, seeds = _spread(low, high)
            gone = np.flatnonzero(late)
            settled = by_owner(((ids[i], tags[i], _ranges(starts[gone[at]])) for i, at in by_document(text[seeds[gone]])), n)
            nothing = pa.nulls(settled.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(settled.column(c) for c in ("bucket", "docs", "tags", "counts", "places")), nothing, nothing], schema=PART_ARROW)
            rows = []
            open_ = np.unique(seeds[~late])
            for b, at in by_document((key[open_] % np.uint64(n)).astype(np.int32)):
                s = open_[at]
                rows.append((b, id_of[text[s]].tobytes(), tag_of[text[s]].tobytes(), lengths[s].astype(np.uint32).tobytes(),
                             low[s].astype(np.uint32).tobytes(), (place - low)[s].astype(np.uint8).tobytes(), b"".join([stretches[i] for i in s])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PART_ARROW, strict=True)], schema=PART_ARROW)
    return task


def _resolve(n: int, window: int):
    """Sorts the suffixes of a bucket; gives the starts of windows that a smaller document has."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [] for c in PART_ARROW.names}
        for batch in batches:
            settled = batch.column("texts").is_null()
            passed = batch.filter(settled)
            yield pa.RecordBatch.from_arrays([*(passed.column(c) for c in ("bucket", "docs", "tags", "lengths")), pa.nulls(passed.num_rows, pa.binary()),
                                              passed.column("starts")], schema=ENTRY_ARROW)
            dealt = batch.filter(pc.invert(settled))
            for c in held:
                held[c] += dealt.column(c).to_pylist()
        docs, tags = joined(held["docs"], np.int64), joined(held["tags"], np.int64)
        lengths, low = joined(held["lengths"], np.uint32).astype(np.int64), joined(held["starts"], np.uint32).astype(np.int64)
        if len(docs):
            late = late_windows(joined(held["texts"], np.uint8), np.cumsum(lengths) - lengths, joined(held["offsets"], np.uint8).astype(np.int64),
                                lengths - window + 1, docs, window)
            starts, owner = _spread(low, low + lengths - window)
            starts, owner = starts[late], owner[late]
            # A document may have come in several rows: told apart by id and text hash.
            _, same = np.unique(np.stack([docs, tags]), axis=1, return_inverse=True)
            first = [(owner[i[0]], i) for _, i in by_document(same.ravel()[owner])]
            yield by_owner(((int(docs[o]), int(tags[o]), _ranges(np.unique(starts[i]))) for o, i in first), n)
    return task


RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, n_removed bigint, kept binary"
RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("n_removed", pa.int64()), ("kept", pa.binary())])


def _cut(window: int, carry: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.select(["doc_id", "text", "places", "whole"]).to_pylist():
                data = row["text"].encode("utf-8", "surrogatepass")
                if row["whole"]:
                    spans, kept = [(0, len(data))], b""
                elif row["places"]:
                    held = np.frombuffer(row["places"], np.uint32).astype(np.int64).reshape(-1, 2)
                    held = held[np.argsort(held[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(held[:, 1]) + window
                    breaks = np.flatnonzero(held[1:, 0] > reach[:-1])
                    firsts, ends = held[np.append(0, breaks + 1), 0], reach[np.append(breaks, len(held) - 1)]
                    spans = list(zip(firsts.tolist(), (ends - firsts).tolist(), strict=True))
                    edges = [0, *(x for s, n in spans for x in (s, s + n)), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                else:
                    spans, kept = [], data
                rows.append({"doc_id": row["doc_id"], "n_bytes": len(data), "n_removed": len(data) - len(kept), "kept": kept,
                             "spans": [{"start": s, "length": n} for s, n in spans]})
            out = pa.RecordBatch.from_pylist(rows, RESULT_ARROW)
            if carry:
                texts = [r["kept"].decode("utf-8", "ignore") for r in rows]
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(texts, pa.string()), batch.column("_row")],
                                                 names=[*RESULT_ARROW.names, "text", "_row"])
            yield out
    return task


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, carry: bool = False) -> DataFrame:
    """Each row of ``docs`` with the removed spans and the bytes that are left.

    A byte goes when a string of ``window`` bytes around it also starts in a document with
    a smaller id. A null text is empty. A missing id counts as larger than every id; rows
    of one id never remove each other's bytes, and equal rows get equal results. Columns
    other than doc_id and text are ignored. The result has a row per given row: doc_id,
    n_bytes, spans (in bytes), n_removed, kept. With ``carry`` also text (what is left, without
    characters that a span cuts) and _row (a struct of the given columns but the text).
    """
    n = buckets(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    rows = identified(docs, F.struct(*others).alias("_row")) if carry else identified(docs)
    narrow = rows.select("_d", "_t", F.xxhash64(F.lit(window), "text").alias("_u"), F.octet_length("text").alias("_n"))
    copy = ["_t", "_u", "_n"]
    firsts = stored(narrow.groupBy(*copy).agg(F.min("_d").alias("_first"), F.max("_d").alias("_last")).filter("_first < _last"), "copies")
    copies = narrow.filter(F.col("_n") >= window).join(firsts, copy).filter("_d > _first").select("_d", "_t").distinct()
    found = deal(deal(rows.select("_d", "_t", "text").mapInArrow(_sample(n, window, seed), ENTRY_SCHEMA)).mapInArrow(_shared(n), ENTRY_SCHEMA)) \
        .mapInArrow(owned, OWNED_SCHEMA).join(copies, ["_d", "_t"], "left_anti")
    suffixes = rows.join(found, ["_d", "_t"]).mapInArrow(_suffixes(n, window, seed), PART_SCHEMA)
    removed = deal(deal(suffixes).mapInArrow(_resolve(n, window), ENTRY_SCHEMA)).mapInArrow(owned, OWNED_SCHEMA)
    marks = removed.select("*", F.lit(False).alias("whole")).unionByName(
        copies.select("_d", "_t", F.lit(None).cast("binary").alias("places"), F.lit(True).alias("whole")))
    schema = RESULT_SCHEMA + (f", text string, _row {rows.schema['_row'].dataType.simpleString()}" if carry else "")
    return rows.join(marks, ["_d", "_t"], "left").mapInArrow(_cut(window, carry), schema)
