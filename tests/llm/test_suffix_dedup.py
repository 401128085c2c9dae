"""Removed bytes against a dictionary of all windows."""

import random
import pytest

import numpy as np

from stratalake.llm.suffix_dedup import late_windows, remove_repeats


def brute_force(rows, window):
    big = 1 << 63
    first = {}
    for i, text in rows:
        data, key = (text or "").encode(), big if i is None else i
        for j in range(len(data) - window + 1):
            first[data[j : j + window]] = min(key, first.get(data[j : j + window], key))
    out = []
    for i, text in rows:
        data, key = (text or "").encode(), big if i is None else i
        gone = bytearray(len(data))
        for j in range(len(data) - window + 1):
            if first[data[j : j + window]] < key:
                gone[j : j + window] = b"\1" * window
        runs = sum(1 for j in range(len(data)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((-1 if i is None else i, len(data), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize(("window", "seed"), [(50, 20), (24, 9)])
def test_awkward_rows(awkward, window, seed):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert result(remove_repeats(awkward, window, seed)) == brute_force(rows, window)


def test_given_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(remove_repeats(documents)) == brute_force(rows, 50)


def test_carried_columns_and_whole_characters(spark):
    text = "é" * 40
    df = spark.createDataFrame([(1, "x" + text, "p", "q"), (2, text[:30] + "ß" + text, "r", "s")], "doc_id long, text string, kept string, _t string")
    rows = {r.doc_id: r for r in remove_repeats(df, 50, 20, carry=True).collect()}
    # The run of equal characters takes the first byte of the other one with it.
    assert (bytes(rows[2].kept), rows[2]["_row"].kept, rows[2]["_row"]["_t"], rows[2].text) == (b"\x9f", "r", "s", "")


def test_no_rows(nothing):
    assert remove_repeats(nothing).count() == 0


def test_windows_of_stretches_equal_a_plain_search():
    rng = random.Random(7)
    for window, seed in ((50, 20), (9, 4)):
        common = bytes(rng.choices(b"ab\x00", k=seed))
        stretches, offsets, counts, docs = [], [], [], []
        pool = [bytes(rng.choices(b"ab\x00", k=window)) for _ in range(3)]
        for i in range(120):
            offset = rng.randrange(window - seed + 1)
            # Every window holds the seed: the last starts at the sampled place at most.
            count = rng.randrange(1, offset + 2)
            behind = count - 1 + window - offset - seed
            back, ahead = rng.choice(pool)[window - offset :] if offset else b"", (rng.choice(pool) * 2)[:behind]
            if rng.random() < 0.3:
                ahead = bytes(rng.choices(b"ab\x00", k=behind))
            stretches.append(back + common + ahead)
            offsets.append(offset)
            counts.append(count)
            docs.append(rng.randrange(40))
        lengths = np.array([len(x) for x in stretches])
        got = late_windows(np.frombuffer(b"".join(stretches), np.uint8), np.cumsum(lengths) - lengths, np.array(offsets), np.array(counts), np.array(docs), window)
        held = {}
        for x, o, c, d in zip(stretches, offsets, counts, docs, strict=True):
            for k in range(c):
                held.setdefault((o - k, x[k : k + window]), []).append(d)
        want = [min(held[o - k, x[k : k + window]]) < d for x, o, c, d in zip(stretches, offsets, counts, docs, strict=True) for k in range(c)]
        assert got.tolist() == want and 0 < sum(want) < len(want)
