"""Components against all pairs."""

import random
import re

import pytest

from stratalake.llm import ngram_join
from stratalake.llm.ngram_join import Allocation, jaccard_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    held = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    if len(held) < size:
        return {tuple(held)} if held else set()
    return {tuple(held[i : i + size]) for i in range(len(held) - size + 1)}


def brute_force(rows, num=75, den=100):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if a and b and den * same >= num * (len(a) + len(b) - same):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted((str(doc), len(s), str(least[find(i)])) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(df, **more):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df, **more).collect())


@pytest.mark.parametrize("frequent", [32, 2])
def test_awkward_rows(awkward, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", frequent)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert result(awkward) == brute_force(rows)


@pytest.mark.parametrize("similarity", [(75, 100), (50, 100), (9, 10)])
def test_given_documents(documents, similarity):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(documents, similarity=similarity) == brute_force(rows, *similarity)


def test_no_rows(nothing):
    assert jaccard_components(nothing).count() == 0


def test_similar_sets_always_meet():
    """Any two sets at the similarity share a key, whatever is frequent."""
    import numpy as np

    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep, add = rng.random(len(a)) > rng.random() * 0.2, rng.integers(0, 1 << 62, int(rng.random() * 0.2 * n)).astype(np.uint64)
        b = np.unique(np.concatenate([a[keep], add]))
        same = len(np.intersect1d(a, b))
        frequent = np.sort(rng.choice(a, int(rng.random() * len(a)), replace=False)) if trial % 2 else np.zeros(0, np.uint64)
        allocation = Allocation((75, 100), frequent, rng.integers(32, 40, len(frequent)))
        if len(b) and 100 * same >= 75 * (len(a) + len(b) - same):
            assert len(np.intersect1d(allocation.keys(a), allocation.keys(b)))


def test_sketches_never_rule_out_more_than_differs():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1100, 9000))).astype(np.uint64))
        b = np.concatenate([a[rng.random(len(a)) > rng.random() * 0.5], np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64))])
        p, q = ngram_join.wide_parity(a), ngram_join.wide_parity(np.unique(b))
        if q is not None:
            assert ngram_join.flipped(p, q) == ngram_join.flipped(q, p) <= len(np.setxor1d(a, b))


def test_long_texts(spark):
    """Sets of over a thousand shingles on both sides of the limit, of unlike sketch widths."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2200)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:1800])), (3, " ".join(base[:1500])), (4, " ".join(base[1100:] + base[:100])), (5, " ".join(base[:1040])), (6, " ".join(base[:1010])), (6, " ".join(base[:1010]))]
    for i in range(8):
        changed = list(base)
        for at in rng.sample(range(2200), 20 * i):
            changed[at] = f"x{i}y{at}"
        rows.append((10 + i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(docs) == brute_force(rows)
