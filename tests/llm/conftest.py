import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, key string"


def words(rng, n, pool=400):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(pool)}é" for _ in range(n)]


def awkward_documents():
    """Nulls, empty and long texts, repeated rows and ids, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage, base = words(rng, 70), words(rng, 300)
    texts: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One two"), (5, "a b c d e")]
    texts += [(10 + i, " ".join(words(rng, 60 + 7 * i))) for i in range(20)]
    texts += [(40 + i, " ".join(words(rng, 50) + passage + words(rng, 30 + i))) for i in range(12)]
    texts += [(60 + i, " ".join(base)) for i in range(8)]
    for i in range(14):  # near copies that drift apart from each other
        changed = list(base)
        for at in rng.sample(range(300), 1 + 2 * (i % 5)):
            changed[at] = f"x{i}y{at}"
        texts.append((80 + i, " ".join(changed)))
    texts += [(100, " ".join(words(rng, 6000))), (101, "z" * 9000), (102, "na " * 3000), (103, "a\n" * 80 + "b\n" * 3)]
    texts += [(10, texts[6][1]), (10, " ".join(words(rng, 80))), (None, " ".join(base)), (None, None), (None, "lonely " * 3)]
    return [(i, t, "en", "src0", None if t is None else len(t), "s", "k") for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
