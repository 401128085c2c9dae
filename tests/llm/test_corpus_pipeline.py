"""Every stage of the pipeline against brute force on what its predecessor kept, and the whole."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from stratalake.llm.queries import tokenizer_path
from stratalake.llm.rule_ensemble import scored

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF_DIR = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _d string, _t string, _row string, kept int"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def tuples(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)

    def words(n):
        return [f"{rng.choice('abcdef')}{rng.randrange(300)}" for _ in range(n)]

    base, passage, item = words(90), words(60), words(30)
    texts = [(i, " ".join(words(60))) for i in range(20)]
    texts += [(20 + i, " ".join([*base[:5 * i], *words(1), *base[5 * i + 1 :]])) for i in range(6)] + [(26, " ".join(base)), (27, " ".join(base))]
    texts += [(30 + i, " ".join(words(20) + passage + words(25))) for i in range(5)] + [(40, " ".join(words(10) + item + words(40))), (41, " ".join(item))]
    texts += [(50, None), (51, ""), (52, " \n"), (None, "lonely text"), (None, " ".join(base)), (5, texts[5][1]), (6, "other text of the same id"), (60, " ".join(words(9000)))]
    rows = [(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", 1) for i, t in texts]
    return spark.createDataFrame(rows, EXTRA).repartition(4), " ".join(item)


def test_classifier_keeps_what_scores_enough(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = P.quality(spark, documents, SF_DIR)
    good = scored(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet")).filter("score >= 0.3")
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in good.collect())


def test_one_document_of_each_group_stays(spark, docs):
    df, _ = docs
    rows = [tuple(r) for r in df.collect()]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members = defaultdict(list)
    for g, r, s in zip(group, rows, sets, strict=True):
        members[g if s else (g, id(r))].append(r)
    kept = [tuple(r) for r in P.near_duplicates(spark, df, SF_DIR).collect()]
    assert len(kept) == len(members)
    least = {min(1 << 63 if r[0] is None else r[0] for r in m) for m in members.values()}
    assert {1 << 63 if r[0] is None else r[0] for r in kept} == least and all(r in rows for r in kept)


def test_repeats_are_cut(spark, docs):
    df, _ = docs
    before = {(r.doc_id, r.text): r for r in df.filter("doc_id IN (30, 31, 32, 33, 34, 60, 51) OR doc_id < 5").collect()}
    rows = spark.createDataFrame(list(before.values()), EXTRA)
    out = P.repeats(spark, rows, SF_DIR)
    assert out.columns == df.columns
    data = sorted((r.doc_id, (r.text or "").encode()) for r in before.values())
    for r in out.collect():
        own = dict(data)[r.doc_id]
        seen = {d[i : i + 50] for i_, d in data if i_ < r.doc_id for i in range(len(d) - 49)}
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - 49):
            if own[i : i + 50] in seen:
                gone[i : i + 50] = True
        assert r.text.encode() == bytes(np.frombuffer(own, np.uint8)[~gone]) and r.n_chars == len(r.text)
        assert (r.lang, r["_d"], r["_t"], r["_row"], r.kept) == ("en", "a", "b", "c", 1)


def test_documents_with_a_benchmark_item_go(spark, docs, tmp_path):
    df, item = docs
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = P.benchmark_free(spark, df, str(tmp_path))
    wanted = shingles(item)
    assert tuples(kept) == sorted(repr(tuple(r)) for r in df.collect() if 100 * len(wanted & shingles(r.text)) < 75 * len(wanted))
    assert kept.count() == df.count() - 2


def test_packing_cuts_all_ids(spark, docs):
    df, _ = docs
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(r.doc_id), *tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1) for r in df.collect())
    held = defaultdict(list)
    for r in P.packed(spark, df, SF_DIR).collect():
        held[str(r.doc_id), r.sequence_id * 2048 + r.offset - r.start] += [(r.start, np.frombuffer(r.ids, "<u4").tolist())]
    assert sorted((k[0], *(i for _, ids in sorted(v) for i in ids)) for k, v in held.items()) == want


def test_empty_tables_pass_through(spark, docs, tmp_path):
    df, _ = docs
    for name, schema in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df.limit(0), str(tmp_path))
        assert out.columns == df.columns and out.count() == 0
    assert P.packed(spark, df.limit(0), str(tmp_path)).count() == 0


def test_the_whole_run(spark):
    """Each stage works on all its predecessor kept: running them one by one gives the same pieces."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = documents
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, rows, SF_DIR)
        assert kept.columns == documents.columns
        rows = spark.createDataFrame(kept.collect(), documents.schema)
    texts = {r.doc_id: r.text for r in rows.collect()}
    pieces = defaultdict(list)
    for r in P.run(spark, SF_DIR).select("doc_id", "start", "ids").collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert 0 < len(texts) < documents.count()
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in pieces.items()} == {
        d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
