"""Conversation repair against a plain search over all edits, and against SQL."""

import functools
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomledger.llm import dialogue
from loomledger.llm.oracles import ORACLE
from loomledger.llm.queries import QUERIES

SPACE = " \t\n\v\f\r"
FIT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def brute(rows):
    """(faults, illegal, cost, audit, repaired) of (role, text) rows in order."""
    faults = []
    for k, (role, text) in enumerate(rows):
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in rows[:k] else "truncated" if bare[-1] not in ".!?" else "")
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @functools.cache
    def best(k, last, inserted=0):
        ways = [(0, "", ())] if k == len(rows) and last in ("", "a") else []

        def go(cost, edit, out, then):
            if then:
                ways.append((cost + then[0], edit + then[1], out + then[2]))

        fit = FIT[last]
        if inserted < 3:
            go(5, "I", ((fit, ""),), best(k, fit[0], inserted + 1))
        if k < len(rows):
            role, text = rows[k]
            go(2, "D", (), best(k + 1, last))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] else 0
                if (last, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    go(more, "K", ((role, text),), best(k + 1, role[0]))
                go(1 + more, "R", ((fit, text),), best(k + 1, fit[0]))
        return min(ways, key=lambda w: w[:2], default=None)

    cost, audit, out = best(0, "")
    return faults, illegal, cost, audit, out


def conversations(seed, n, longest=9):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(r.randint(1, longest)):
            text = r.choice(("Yes.", "No!", "What", "Is it?", " ", "", "\v", "Done. \n", f"{r.randint(0, 3)}.", "é."))
            rows.append((c, r.choice((k, k, k, k + 3)), r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "únique")), text))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            row = (c, t, "user" if h == 4 else role, "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text)
            out += [row] * (2 if h == 3 else 1)
    return out


def expected(rows, hurt=True):
    out = {}
    for c in {x[0] for x in rows}:
        own = [x for x in (damaged(rows) if hurt else rows) if x[0] == c]
        own = ordered(own)
        faults, illegal, cost, audit, told = brute(tuple((r, x) for _, _, r, x in own))
        turns = {t for _, t, _, _ in own if t is not None}
        whole = "\n".join(f"{r}:{x}" for r, x in told)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [(None, 1, "user", "Hi."), (None, None, None, None), (7000, None, "user", "A."), (7000, None, "assistant", "B."), (7000, 4, None, "C."), (7001, None, None, None), (7002, 5, "user", "x" * 50_000), (7002, 9, "assistant", "y" * 50_000 + ".")]


def test_search():
    r = random.Random(6)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8] * 40:
        rows = tuple((r.choice(("user", "assistant", "system", "tool")), r.choice(("", "A.", "B.", "C", "D", "E!", "F?"))) for _ in range(n))
        faults, _, cost, audit, _ = brute(rows)
        codes = "".join(chr(48 + 4 * ("", "truncated", "blank", "duplicate").index(f) + "suat".index(x[0][0])) for f, x in zip(faults, rows, strict=True))
        assert dialogue.cheapest(codes, 0, (0, 3)) == (cost, audit), rows


@pytest.mark.parametrize("piece", [256, 2])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(dialogue, "PIECE", piece)
    dialogue._whole.cache_clear()
    rows = conversations(piece, 60) + ODD
    rows += [*rows[:3], *[(8000, k, ("user", "assistant")[(k // 2) % 2], f"{k % 7}{'.' * (k % 3)}") for k in range(40)]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit(1)).withColumn("row", F.lit("x")).repartition(5)
    found, turns = dialogue.repair(df)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    sha = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.digests(turns).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: (*(r[c] for c in NAMES[:-1]), sha.get(r["conv_id"], nothing)) for r in found.collect()}
    assert got == expected(clean, hurt=False)
    out = turns.where("conv_id = 8000").orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(out))) and all((r["turn"] is None) == (r["edit"] == "I") for r in out)


def test_pieces_of_one_conversation(spark, monkeypatch):
    """A conversation over many tasks and pieces, with repeated rows, equal turns and turns without numbers."""
    monkeypatch.setattr(dialogue, "PIECE", 5)
    r = random.Random(12)
    rows = [(1, r.choice((None, k // 2, k)), r.choice(("user", "assistant", "system", "user")), r.choice(("A.", "B", "C?", "", f"{k}."))) for k in range(150)]
    assert {x["conv_id"]: tuple(x[c] for c in NAMES) for x in dialogue.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()} == expected(rows)


def test_query_and_twin(spark, tmp_path):
    rows = conversations(1, 80) + ODD + [(9000 + k, 0, "user", "Gone?") for k in range(60)]
    some = spark.createDataFrame(rows, SCHEMA)
    some.write.parquet(f"{tmp_path}/full/conversations.parquet")
    some.limit(0).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    for d, files, want in ((f"{tmp_path}/full", "/*.parquet", expected(rows)), (f"{tmp_path}/empty", "/*.parquet", {}), ("/root/testdata/sf0.001", "", None)):
        got = {x["conv_id"]: tuple(x[c] for c in NAMES) for x in QUERIES["op13_conversation_repair"](spark, d).collect()}
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet{files}'")
        twin = {r[0]: r[1:] for r in con.execute(ORACLE["op13_conversation_repair"]).fetchall()}
        if want is None:
            want = expected([tuple(x) for x in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
        assert got == want
        assert twin == want
