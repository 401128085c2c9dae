"""Conversation repair against an exhaustive search, plain strings and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stratalake.llm.queries import damaged
from stratalake.llm.structure_repair import Audits, cheapest, digests, read_symbol, repair, script, symbol

FORM = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, edits string, part int"


def plain(signs):
    """Cheapest audit with plain strings: every state keeps (cost, audit)."""
    best = {0: (0, "")}

    def better(into, state, cost, audit):
        if state not in into or (cost, audit) < into[state]:
            into[state] = (cost, audit)

    def inserted():
        for state in (0, 1, 3, 2):
            if state in best:
                better(best, 3 if state == 2 else 2, best[state][0] + 2, best[state][1] + "I")

    for sign in signs:
        fault, initial = read_symbol(sign)
        inserted()
        after = {}
        for q, (cost, audit) in best.items():
            better(after, q, cost + 3, audit + "D")
            if fault in (0, 3):
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(initial)
                if to:
                    better(after, to, cost + (fault == 3), audit + "K")
                better(after, 3 if q == 2 else 2, cost + 2 + (fault == 3), audit + "R")
        best = after
    inserted()
    return min(best[q] for q in (0, 3) if q in best)


def exhaustive(signs):
    """All edits of each row with up to two insertions before it and at the end."""
    options = []
    for sign in signs:
        fault, initial = read_symbol(sign)
        own = [("D", "", 3)]
        if fault in (0, 3):
            own += [("K", initial, fault == 3), *(("R", r, 2 + (fault == 3)) for r in "ua")]
        options.append(own)
    gaps = [("", ""), *(("I", r) for r in "ua"), *(("II", a + b) for a in "ua" for b in "ua")]
    found = []
    for rows in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(signs) + 1):
            roles = "".join(p[1] + r[1] for p, r in zip(put, rows, strict=False)) + put[-1][1]
            if FORM.fullmatch(roles):
                audit = "".join(p[0] + r[0] for p, r in zip(put, rows, strict=False)) + put[-1][0]
                found.append((sum(r[2] for r in rows) + 2 * audit.count("I"), audit))
    return min(found)


SIGNS = [symbol(f, i) for f in range(4) for i in "sua?"]


def test_all_short_conversations():
    for n in range(3):
        for signs in itertools.product(SIGNS, repeat=n):
            assert cheapest(signs) == exhaustive(signs) == plain(signs)


@pytest.mark.parametrize(("limit", "modulus"), [(1 << 18, (1 << 61) - 1), (16, (1 << 61) - 1), (16, 7), (1 << 18, 3)])
def test_long_conversations_with_few_nodes_and_colliding_hashes(limit, modulus):
    rng = random.Random(limit + modulus)
    for n in (1, 5, 40, 300):
        for _ in range(12):
            signs = rng.choices(SIGNS, k=n)
            assert cheapest("".join(signs), limit, modulus) == plain(signs)
    assert cheapest("".join(SIGNS[1] for _ in range(2000)), limit, modulus)[0] == 2000


def test_order_of_audits():
    audits, rng = Audits(modulus=5), random.Random(1)
    nodes = [0]
    for _ in range(400):
        nodes.append(audits.add(rng.choice(nodes), rng.choice("DIKR")))
    for a in rng.sample(nodes, 60):
        for b in rng.sample(nodes, 20):
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_script_follows_the_audit():
    for signs in ("", "A", "BCB", "EBBC"):
        _, audit = cheapest(signs)
        edits = script(signs, audit)
        assert len(edits) == len(signs) and "".join(edits).translate(str.maketrans("uaUA", "RRII")) == audit


def expected(rows):
    """Report and hash of damaged rows (conv_id, turn, role, text), in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, signs, counts = set(), [], [0] * 4
        for _, _, role, text in own:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            signs.append(symbol(fault, role[:1] if role[:1] in set("sua") else "?"))
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = plain(signs)
        said, state, row = [], "", 0
        for e in audit:
            nxt = "assistant" if state == "u" else "user"
            if e == "I":
                said, state = [*said, f"{nxt}:"], nxt[0]
                continue
            if e != "D":
                role = own[row][2] if e == "K" else nxt
                said, state = [*said, f"{role}:{own[row][3]}"], role[0]
            row += 1
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def read(rows):
    fixed = repair(rows)
    report = {r.conv_id: r for r in fixed.report.collect()}
    hashes = dict(digests(fixed.rows).collect())
    empty = hashlib.sha256(b"").hexdigest()
    return {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(k, empty)) for k, r in report.items()}


def test_awkward_rows(spark):
    rng, rows = random.Random(2), []
    for conv in (None, 1, 2, 3):
        for _ in range(25):
            rows.append((conv, rng.choice([None, 0, 2, 3, 7]), rng.choice(["user", "assistant", "system", "", "tool", "usher"]),
                         rng.choice(["", " \n", "yes.", "no", "why? ", "ja\x85", "é!\t", "x" * 60000 + "."])))
    rows += [(4, None, "user", "a."), (5, 9, "assistant", "Only."), *[(6, i, "user" if i % 2 else "system", "same.") for i in range(200)]]
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA).repartition(5)
    assert read(df) == expected(rows)


def test_nulls_are_one_space_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, 0, None, None, "", 0), (1, 1, None, "a.", "", 0)], SCHEMA)
    assert read(df) == expected([(1, 0, " ", " "), (1, 1, " ", "a.")])
    assert read(df.limit(0)) == {}


def test_a_conversation_over_all_parts(spark):
    rows = [(0 if i % 3 else i, i, "user" if i % 2 else "assistant", f"t{i % 50}" + "." * (i % 4)) for i in range(3000)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)
    assert read(df) == expected(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? x") for c in (None, *range(30)) for t in (None, 0, 1, 2)]
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "One Two x"}.get(code, text)
        want += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = damaged(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert got.select(F.count_distinct("text")).first()[0] == 3
