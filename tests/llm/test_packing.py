"""Packing, decontamination and the classifier."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from stratalake.llm import decontaminate
from stratalake.llm.decontaminate import contained_items, decontaminated
from stratalake.llm.packing import Encoder, pack
from stratalake.llm.queries import op7_rule_ensemble, tokenizer_path
from stratalake.llm.rule_ensemble import FEATURES, accepted, fit, scored, with_statistics


@pytest.mark.parametrize("window", [2048, 64])
def test_packed_ids(awkward, window):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = sorted((str(r.doc_id), *tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1) for r in awkward.collect())
    rows = pack(awkward, tokenizer_path(), window).collect()
    held, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.sequence_id * window + r.offset - r.start), []).append((r.start, ids, r.doc_tokens))
    assert sorted((str(k[0]), *(i for _, ids, _ in sorted(v) for i in ids)) for k, v in docs.items()) == expected
    for v in docs.values():
        assert sum(len(ids) for _, ids, _ in v) == v[0][2]
    for s in range(len(held)):
        at = 0
        for offset, length in sorted(held[s]):
            assert offset == at
            at += length
        assert at == window or s == len(held) - 1


def test_no_rows(nothing):
    assert pack(nothing, tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    rng = random.Random(0)
    pieces = ["a", "don't", " ", "  ", "\n", " \n", "\n ", "\t", " ", " ", "<|endoftext|>", "日本", "é", "1234", "!!", "\\", "the", "\x1c", "😀", "x́"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)] + [" ".join(rng.choice(pieces) for _ in range(6)) for _ in range(1000)]
    encoder, tokenizer = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(got, encoder.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def grams(text, n):
    held = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    held = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in held]
    return held, {tuple(held[i : i + n]) for i in range(len(held) - n + 1)}


def contained(docs, items):
    out = []
    for item, text in items:
        held = grams(text, 5)[0]
        n = min(5, len(held))
        if n:
            wanted = grams(text, n)[1]
            for doc, body in docs:
                same = len(wanted & grams(body, n)[1])
                if 100 * same >= 75 * len(wanted):
                    out.append((str(doc), str(item), len(wanted), same))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 0])
def test_contained_items(spark, awkward, limit):
    """Items sent to all tasks, and items joined by hash."""
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    long = dict(docs)[100].split(" ")
    items = [(1, " ".join(long[4000:4030])), (2, " ".join(long[10:22] + ["new"] + long[23:50])), (3, " ".join(long[10:14] + ["new"] + long[15:20])),
             (4, None), (5, ""), (6, "One  TWO"), (7, "lonely lonely"), (8, "a b c d e"), (9, " ".join(long)), (None, "na na na"), (6, "One  TWO"), (10, "absent")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    expected = contained(docs, items)
    got = sorted((str(r.doc_id), str(r.item_id), r.n_item, r.n_shared) for r in contained_items(awkward, frame, limit=limit).collect())
    assert got == expected and len({r[1] for r in expected}) >= 6
    dirty = {(d, t) for d, t in docs if contained([(d, t)], items)}
    kept = sorted(str(tuple(r)) for r in decontaminated(awkward, frame, limit=limit).collect())
    assert kept == sorted(str(tuple(r)) for r in awkward.collect() if (r.doc_id, r.text) not in dirty)
    assert contained_items(awkward.limit(0), frame, limit=limit).count() == 0
    clashing = awkward.withColumnsRenamed({"lang": "_k", "source": "_row", "shard": "_i"}).withColumn("width", F.lit(1))
    again = sorted(str(tuple(r)[:-1]) for r in decontaminated(clashing, frame.withColumn("_i", F.lit(0)), limit=limit).collect())
    assert again == kept
    assert contained_items(awkward, frame.limit(0)).count() == 0 and decontaminated(awkward, frame.limit(0)).count() == len(docs)


def test_a_very_long_text_and_a_common_shingle(spark):
    """Half of all texts hold one item's words; the joined form finds what the scan finds."""
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(i, f"common words stand in all of these texts {i % 50}") for i in range(400)] + [(1000, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common words stand in all of these"), (2, "w150000 w150001 w150002 w150003 w150004 w150005 w150006"), (3, "w5 w7 w9")], "item_id long, text string")
    scanned, joined = (sorted(map(tuple, contained_items(docs, items, limit=limit).collect())) for limit in (decontaminate.BLOCK_BYTES, 0))
    assert scanned == joined and len(joined) == 401


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op7_rule_ensemble(spark, sf_dir).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert unseen and sum(p == y for p, y in unseen) >= 0.97 * len(unseen)


def test_compiled_score_equals_the_rules(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = with_statistics(documents)
    ensemble = fit(rows.join(labels, "doc_id").withColumnRenamed("quality", "label"))
    assert ensemble.rules
    for r in rows.withColumn("score", ensemble.score()).collect():
        total = ensemble.intercept
        for rule, weight in ensemble.rules:
            total += weight * all(r[f] <= bound if at_most else r[f] > bound for f, at_most, bound in rule)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
    assert set(FEATURES) <= set(rows.columns)


def test_few_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = scored(awkward, labels).collect()
    assert len(rows) == awkward.count() and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(5, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.9 for r in scored(awkward, ones).collect())
    assert scored(nothing, ones).count() == 0
    assert sorted(map(str, accepted(awkward, ones).collect())) == sorted(map(str, awkward.collect()))


def test_encoder_gives_the_tokenizers_ids():
    encoder, rng = Encoder(tokenizer_path()), random.Random(3)
    assert encoder.fast
    signs = "ab  \n\t\r'sd1²é.,!?<|_ñß \u0085​中文😀'llre\x1c\x0b"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [chr(c) + w for c in range(0x530) for w in ("a", "1", " ", "\n", ".")]
    texts += ["", "<|endoftext|> x", "a" * 5000, " " * 3000, "it's 'S we'll ", "a \n\n b   "]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e, encoder.kind).tolist() for e in encoder.encode(texts)] == expected
