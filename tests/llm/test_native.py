"""Sharding, reply trees, quality rules and WARC derivatives against plain Python."""

import hashlib
import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalake.llm import reply_trees
from stratalake.llm.exchange import stored
from stratalake.llm.histogram_sort import TOLERANCE, shard_by_bytes
from stratalake.llm.quality_rules import RULES, judged
from stratalake.llm.reply_trees import END, ROLE_END, START, conversation_messages, format_trees, learned_text, read_back
from stratalake.llm.warc import derivatives, plain_text, responses_from_pages

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- sharding -----------------------------------------------------------------------------

@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_ordered_and_gapless(spark, documents, shards):
    rows = shard_by_bytes(documents, shards).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in documents.collect())
    assert all(r.size == len((r.text or "").encode()) + 1 for r in rows)
    by_shard = {s: sorted((r.slot, r.doc_id) for r in rows if r.shard == s) for s in range(shards)}
    ids = [doc for s in range(shards) for _, doc in by_shard[s]]
    assert ids == sorted(ids)
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s, held in by_shard.items():
        assert [slot for slot, _ in held] == list(range(len(held)))
        assert abs(sum(r.size for r in rows if r.shard == s) - total / shards) <= 2 * (most + total * TOLERANCE / shards)


def test_awkward_rows_are_sharded(awkward, nothing):
    rows = shard_by_bytes(awkward, 4).collect()
    assert len(rows) == awkward.count() and "key" in rows[0].asDict()
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids) and {r.shard for r in rows} <= set(range(4))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_by_bytes(nothing, 4).count() == 0


def test_a_key_of_a_third_of_all_rows_is_split(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    sizes = [r[1] for r in shard_by_bytes(df, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 30


def test_equal_rows_are_split(spark):
    """Half of all rows are one row."""
    same = [(7, "same text", {"k": 1}, "x")] * 2000
    rows = same + [(i, f"text {i}", {"k": i}, "y") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, _key string").repartition(6)
    out = shard_by_bytes(df, 8).collect()
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 40
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert Counter((r.doc_id, r.text, r.tags["k"], r["_key"]) for r in out) == Counter((a, b, c["k"], d) for a, b, c, d in rows)


def test_sharding_keeps_columns_of_other_names(spark):
    df = spark.createDataFrame([(i, "t" * i, i, i, i, i) for i in range(20)], "doc_id long, text string, _key int, _range int, Size int, _row int")
    out = shard_by_bytes(df, 3)
    assert out.columns == ["doc_id", "text", "_key", "_range", "_row", "size", "shard", "slot"]
    assert all(r["_key"] == r["_range"] == r["_row"] == r.doc_id and r.size == len(r.text) + 1 for r in out.collect())


def test_rules_keep_columns_of_other_names(spark):
    df = spark.createDataFrame([(1, "some words here", "a", "b", "c", 5)], "doc_id long, text string, _text string, _words string, _lines string, N_Words int")
    out = judged(df)
    assert out.columns[:5] == ["doc_id", "text", "_text", "_words", "_lines"] and "N_Words" not in out.columns
    assert tuple(out.first())[:5] == (1, "some words here", "a", "b", "c") and out.first().n_words == 3


def test_tags_and_references(spark):
    cases = {"x < y and z > w": "x < y and z > w", "it&#x27;s &#X27;&#39;": "it's ''", "a&#55296;b&#x110000;c&#x10FFFF;": "a\ufffdb\ufffdc\U0010ffff",
             "&#x26;lt; &#38;gt; &amp;amp;": "&lt; &gt; &amp;", "1 <2 <3>": "1 <2 <3>", "<b>x</b><!DOCTYPE y><?z?>": "x", "&#0; &bogus;": "&#0; &bogus;"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.t for r in df.select("h", plain_text(F.col("h")).alias("t")).collect()} == cases


# --- reply trees --------------------------------------------------------------------------

def test_paths_of_random_trees(spark):
    rng, rows = random.Random(3), []
    for tree in (None, 1, 2):
        for node in range(40):
            parent = rng.choice([None, 99, *range(max(0, node - 6), node)]) if node % 9 else None
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), rng.choice([None, "", "t </s> \\ x", f"n{node}"]), float(rng.randrange(5))))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    expected = {}
    for tree in (None, 1, 2):
        held = {r[1]: r for r in rows if r[0] == tree}
        found = []
        for leaf in set(held) - {r[2] for r in held.values()}:
            path, at = [], leaf
            while at in held:
                path.append(held[at])
                at = held[at][2]
            found.append((-sum(r[5] for r in path) / len(path), leaf, [(r[3] or "", r[4] or "") for r in reversed(path)]))
        for rank, (_, leaf, turns) in enumerate(sorted(found)[:3], 1):
            expected[tree, rank] = (leaf, turns)
    got = format_trees(df, keep=3).withColumn("turns", read_back(F.col("formatted"))).collect()
    assert {(r.tree, r["rank"]): (r.leaf, [(t.role, t.text) for t in r.turns]) for r in got} == expected


def test_cycles_give_no_path(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (1, 4, None, "user", "d", 0.0)]
    got = format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), keep=5).collect()
    assert [r.leaf for r in got] == [4]


def test_control_strings_and_loss_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\\", "\\<s>\\\\", f"a{START}b{ROLE_END}c{END}", "é\n<\\s> 日本", "", None, "<|im_end|" + "x", "ends with <"]
    rows = [(1, i, "assistant" if i % 2 else "u<s>er\\", t) for i, t in enumerate(nasty)] + [(None, None, None, None), (2, 5, "user", "x"), (2, 5, "user", "x")]
    df = conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: r for r in format_trees(df).withColumns({
        "turns": read_back(F.col("formatted")), "learned": learned_text(F.col("formatted"), F.col("loss"))}).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "u<s>er\\", t or "") for i, t in enumerate(nasty)]
    assert got[1].learned == "".join(t or "" for t in nasty[1::2])
    assert len(got[2].turns) == 2 and [(t.role, t.text) for t in got[None].turns] == [("", "")]
    inner = got[1].formatted.replace(START, "").replace(ROLE_END, "").replace(END, "")
    assert not re.search(r"</?s>|\[/?INST\]|<\|im_(start|sep|end)\|>", inner)
    assert format_trees(df.limit(0)).count() == 0


# --- quality rules ------------------------------------------------------------------------

def plain_statistics(text):
    text = text or ""
    held = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(held[i : i + 3]) for i in range(len(held) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(held) < 50 or 100 * len(covered) > 50 * len(held)
    return len(held), sum(map(len, held)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics(awkward, documents):
    for df in (awkward.select("doc_id", "text"), documents.select("doc_id", "text")):
        rows = judged(df).collect()
        assert rows and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_statistics(r.text) for r in rows)
        assert all(r.kept == (not r.base_failed and not r.broken_rules) and set(r.broken_rules) <= set(RULES) for r in rows)


def test_rules_follow_the_labels(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("n_words >= 50").join(labels, "doc_id").collect()
    wrong = [r.doc_id for r in rows if r.kept != bool(r.quality)]
    assert len(wrong) <= 0.02 * len(rows)


def test_judged_clashing_names_and_no_rows(awkward, nothing):
    rows = judged(awkward.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(3)))
    assert dict(rows.dtypes)["n_words"] == "bigint" and rows.count() == awkward.count()
    assert judged(nothing).count() == 0


# --- WARC ---------------------------------------------------------------------------------

def test_derivatives_link_back(spark):
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>a &lt;b&gt;<br>c&#233;&#128512;<!-- no --><script>x='</p>'</script></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    given = {r.record_id: r for r in responses_from_pages(pages).collect()}
    rows = derivatives(responses_from_pages(pages)).collect()
    assert Counter(r.warc_type for r in rows) == {"metadata": 4, "conversion": 4}
    for r in rows:
        source = given[r.refers_to]
        head, body = source.block.split("\r\n\r\n", 1)
        lines, block = r.record.split("\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in lines.split("\r\n")[1:])
        assert block == r.block + "\r\n\r\n" and fields["WARC-Refers-To"] == source.record_id != fields["WARC-Record-ID"] == r.record_id
        assert int(fields["Content-Length"]) == len(r.block.encode()) == r.content_length
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        payload = "sha256:" + hashlib.sha256(body.encode()).hexdigest()
        if r.warc_type == "conversion":
            assert fields["WARC-Source-Payload-Digest"] == payload and fields["WARC-Target-URI"] == (source.target_uri)
        else:
            kept = dict(x.split(": ", 1) for x in r.block.strip().split("\r\n"))
            assert kept["source-payload-digest"] == payload and kept["source-status"] == "200"
            assert kept["source-block-digest"] == "sha256:" + hashlib.sha256(source.block.encode()).hexdigest()
            assert all(kept["source-header-" + k] == v for k, v in (x.split(": ", 1) for x in head.split("\r\n")[1:]))
    assert next(r.block for r in rows if r.page_id == 1 and r.warc_type == "conversion") == "T & U\na <b>\ncé😀"


def test_other_responses(spark):
    rows = [("r1", "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\ngone"), ("r2", "HTTP/1.1 200 OK\r\ncontent-type: text/plain\r\n\r\n<b> \r\n\r\n x"), ("r3", None), ("r4", "no head")]
    df = spark.createDataFrame([(i, "u", "d", b, "mine") for i, b in rows], "record_id string, target_uri string, date string, block string, warc_type string")
    got = derivatives(df).collect()
    assert Counter((r.refers_to, r.warc_type) for r in got) == Counter([(f"r{i}", "metadata") for i in range(1, 5)] + [("r2", "conversion")])
    assert next(r.block for r in got if r.warc_type == "conversion") == "<b> \r\n\r\n x"
    assert derivatives(df.limit(0)).count() == 0


def test_text_of_given_pages(spark):
    """Words of the visible text as a plain parser finds them."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", plain_text(F.col("html")).alias("text")).collect()
    for r in rows:
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style)[^>]*>.*?</\1[^>]*>", "", r.html)
        bare = re.sub(r"(?i)</?(?:article|body|br|div|head|h1|html|li|nav|p|title|ul|section|footer|header|table|td|tr|main|aside)\b[^>]*>", " ", bare)
        expected = html.unescape(re.sub(r"<[^>]*>", "", bare)).split()
        assert "".join(r.text.split()) == "".join(expected)


def test_rule_model_has_its_full_size():
    import inspect

    from stratalake.llm import rule_ensemble

    assert inspect.signature(rule_ensemble.fit).parameters["trees"].default == 24
    assert "maxIter=ITERATIONS" in inspect.getsource(rule_ensemble.fit) and rule_ensemble.ITERATIONS == 60


def test_reply_trees_write_only_what_a_round_adds(spark, monkeypatch):
    """A chain of 64 messages: every pair of leaf and ancestor is written once."""
    written = []

    def spying(df, name):
        out = stored(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(reply_trees, "stored", spying)
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(64)], "id int, parent int")
    found = reply_trees.paths(chain).collect()
    assert sorted((r.id, r.distance) for r in found) == [(i, 63 - i) for i in range(64)]
    assert sum(n for name, n in written if name == "paths") == 64


def test_reply_trees_take_long_texts_and_any_column_names(spark):
    long = "é</s>" * 50_000
    rows = spark.createDataFrame(
        [(1, 1, None, "user", long, 1.0, "x", 7), (1, 2, 1, "assistant", long, 1.0, "y", 8)],
        "tree int, node int, parent int, role string, text string, score double, id string, leaf int")
    row = reply_trees.format_trees(rows.withColumn("_p", F.lit(1)).withColumn("m", F.lit(2)).withColumn("rank", F.lit(3))).first()
    assert (row.tree, row.leaf, row.rank) == (1, 2, 1)
    back = spark.createDataFrame([(row.formatted, row.loss)], "f string, l array<struct<start:bigint,length:bigint>>")
    turns, learned = back.select(reply_trees.read_back(F.col("f")), reply_trees.learned_text(F.col("f"), F.col("l"))).first()
    assert [t.text for t in turns] == [long, long] and learned == long
