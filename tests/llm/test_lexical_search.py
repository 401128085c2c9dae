"""Ranked search against a plain count of terms, with both ways of meeting the items."""

import math
import random
import re
from collections import Counter

import pytest

from stratalake.llm.lexical_search import CELLS, ranked_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def plain(docs, items, keep):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for i, held in own.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in held if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if lacks else d, -s) for r, (s, lacks, d) in enumerate(sorted(scored)[:keep])]
    return sorted(map(repr, out))


def got(docs, items, **more):
    return sorted(repr(tuple(r)) for r in ranked_documents(docs, items, **more).collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    pool = ["the", "The", "THE", "a1", "été", "ÉTÉ", "naïve", "日本", "x" * 40, "b2b", *(f"w{i}" for i in range(60))]
    docs = [(rng.choice([None, i, i]), rng.choice([" ", "-", "_", "\n", "'"]).join(rng.choices(pool, weights=range(len(pool), 0, -1), k=rng.randrange(40)))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " .-_ "), (503, "the " * 30000), (504, "thee them ether"), (7, "the the"), (7, "the the"), (506, "\x00the\x7f퟿")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(25)]
    items += [(None, "été the"), (3, "w1 w2"), (3, "w1 w2"), (90, None), (91, ""), (92, "..."), (93, "nowhere"), (94, "the the the")]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"keep": 3}, {"limit": 0, "keep": 7}, {"keep": 1000}])
def test_scores_are_those_of_a_plain_count(spark, tables, more):
    docs, items = tables
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id bigint, text string, n bigint, term string, part int").repartition(5)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id bigint, text string, rank int")
    assert got(d, q, **more) == plain(docs, items, more.get("keep", 50))


def test_small_blocks_of_documents(spark, tables, monkeypatch):
    docs, items = tables
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string")
    whole = got(d, q)
    monkeypatch.setattr("stratalake.llm.lexical_search.CELLS", 40)
    assert got(d, q) == whole and CELLS > 40


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_empty_tables(spark, tables, limit):
    d, q = (spark.createDataFrame(t, s) for t, s in zip(tables, ("doc_id bigint, text string", "item_id bigint, text string"), strict=True))
    assert got(d.limit(0), q, limit=limit) == [] == got(d, q.limit(0), limit=limit) == got(d.limit(0), q.limit(0), limit=limit)
