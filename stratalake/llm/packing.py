"""Packing token ids into sequences by concatenating and cutting.

Pass one tokenizes the texts and writes, per task, each document's ids with the number of
ids before it in the task. The tasks' totals give every task its global offset by a prefix
sum; pass two cuts each document at multiples of the window, without an exchange.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.exchange import stored

WINDOW, END_ID = 2048, 1

TOKEN_SCHEMA = "doc_id bigint, part int, before bigint, n bigint, ids binary"
TOKEN_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


#: The published split pattern of byte-level BPE, and its bytes that print as themselves.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Character classes differ between Unicode versions only beyond this range.
SETTLED = re.compile("[^\x00-\u052f]|\\s{256}")
LONGEST_WORD = 256


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings by id, if the file describes plain byte-level BPE whose ids follow its merges."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") \
        and model.get("type") == "BPE" and not any(model.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return None
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    byte = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if len(vocab) != 256 + len(merged) or merged != list(range(256, len(vocab))) or any(c not in vocab for c in byte):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids of whole texts, as the tokenizer's file defines them.

    Plain byte-level BPE goes through a faster encoder of the same merges. Texts with
    characters outside SETTLED, very long words or white space, or added tokens, and
    files of any other kind, go to the tokenizer itself; the ids are the same.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = merge_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def is_simple(self, text: str) -> bool:
        return not SETTLED.search(text) and max(map(len, text.split()), default=0) <= LONGEST_WORD and not any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self.fast.encode_to_numpy(t, disallowed_special=()).astype(self.kind).tobytes() if self.fast and self.is_simple(t) else b"" for t in texts]
        left = [i for i, ids in enumerate(out) if not ids]
        for i, e in zip(left, self.tokenizer.encode_batch([texts[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return out


def _tokenize(path: str, end_id: int, step: int = 256):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total, part = Encoder(path), 0, TaskContext.get().partitionId()
        end = encoder.kind(end_id).tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(ids), step):
                encoded = [e + end for e in encoder.encode([t or "" for t in texts[a : a + step]])]
                sizes = np.array([len(e) // len(end) for e in encoded], np.int64)
                before = total + np.cumsum(sizes) - sizes
                total += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a : a + step], pa.int64()), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before),
                    pa.array(sizes), pa.array(encoded, pa.binary())], schema=TOKEN_ARROW)
    return task


def _cut(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy()
            begin = batch.column("before").to_numpy() + batch.column("offset").to_numpy()
            packed = batch.column("ids").to_pylist()
            tokens = np.concatenate([np.frombuffer(p, np.uint16 if len(p) == 2 * n else np.uint32) for p, n in zip(packed, sizes, strict=True)]).astype("<u4") \
                if packed else np.zeros(0, "<u4")
            first, last = begin // window, (begin + sizes - 1) // window
            count = last - first + 1
            owner = np.repeat(np.arange(len(docs)), count)
            sequence = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
            low = np.maximum(sequence * window, begin[owner])
            high = np.minimum((sequence + 1) * window, (begin + sizes)[owner])
            ends = np.concatenate([[0], np.cumsum(4 * (high - low))]).astype(np.int64)
            ids = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([
                pa.array([docs[i] for i in owner], pa.int64()), pa.array(low - begin[owner]), pa.array(high - low), pa.array(sizes[owner]),
                pa.array(sequence), pa.array(low - sequence * window), ids.cast(pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return task


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids; only the last is not full.

    A row per piece: doc_id, start (ids of its document before it), length, doc_tokens (with
    the end id), sequence_id, offset (place in the sequence), ids (little-endian 32-bit).
    Documents follow each other
    in reading order, so boundaries inside a sequence are the pieces with start 0. A null
    text is empty and gives the end id alone; repeated rows are documents of their own; a
    null doc_id stays null. Other columns are ignored. ``tokenizer`` is a file's path.
    """
    table = stored(docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, end_id), TOKEN_SCHEMA), "tokens")
    # One row per task of pass one.
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    offset = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", offset.alias("offset"))
    return table.join(F.broadcast(offsets), "part").mapInArrow(_cut(window), PIECE_SCHEMA)
