"""The prefix trie against plain Python, with planted shared beginnings."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import prefix_trie, queries, scans, sql

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(k))
        out.append((
            m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    """Shared first turns, whole copies, gaps, short and long ones, nulls, ties and repeated rows."""
    random.seed(8)
    said = lambda: " ".join(random.choice("alpha beta gamma delta".split()) for _ in range(random.randint(0, 3)))
    rows = []
    for c in [*range(0, 60), *range(61, 80), 105, 119, 2005]:
        for t in range(random.randint(1, 5)):
            rows.append((c, t * 2, random.choice(("user", "assistant", None)), said() if random.random() < 0.95 else None))
    for c in range(200, 290):
        rows += [(c, t, "user", ("one two", "three", "four five six", "seven")[t]) for t in range(4)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tied"), (7, 1, "user", "tie"), (8, None, "user", "first"), (None, 0, "user", "nobody's"), (300, 0, None, None)]
    rows += [(40, 10 + t, "user", f"turn {t % 9}") for t in range(300)] + [(43, 10 + t, "user", f"turn {t % 9}") for t in range(280)]
    random.shuffle(rows)
    return rows


def as_query(frame):
    return sorted((tuple(r) for r in frame.select(
        F.col("conv"), "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_against_python(spark):
    rows = conversations()
    assert as_query(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_query_and_sql(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_prefix_trie(spark, str(tmp_path))
    assert got.columns == list(NAMES)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duck.execute(f"SELECT {', '.join(NAMES)} FROM ({sql.OP12})").fetchall(), key=str) == brute(rows)


def test_collisions_are_found(spark, monkeypatch):
    """With tiny primes fingerprints collide; the proof fails until bases (here: primes) are good."""
    rows, tried = conversations(), []

    def bases(attempt):
        tried.append(attempt)
        monkeypatch.setattr(prefix_trie, "PRIMES", (11, 13) if attempt < 2 else (2147483647, 2147483629))
        return [5, 6] if attempt < 2 else [1_234_577, 7_654_321]

    monkeypatch.setattr(prefix_trie, "bases", bases)
    assert as_query(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert tried == [0, 1, 2]


def test_one_conversation_spans_partitions(spark, monkeypatch):
    """One conversation with nearly all rows is scanned in several stretches; ids that end at one node come in chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(20, t, "user", str(t % 7)) for t in range(3000)] + [(21, 0, "user", "x")] + [(c, 0, "user", "0") for c in range(400, 500)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.conv, r.depth): r for r in prefix_trie.prefix_trie(frame).collect()}
    assert len([k for k in got if k[0] == 20]) == 3001 and got[20, 0].n_convs == 102
    for (c, d), r in got.items():
        if c == 20 and d > 1:
            assert (r.parent, r.n_convs, r.n_children) == (20, 1, int(d < 3000))
    local = {(r.turn_conv, r.turn_pos) for r in got.values()}
    assert (20, 3000) in local and (None, None) in local
    short = [x for x in rows if x[0] != 20] + rows[:40]
    assert as_query(prefix_trie.prefix_trie(spark.createDataFrame(short, SCHEMA))) == brute(short)


def test_scan_stitches(spark):
    rows = spark.range(5000).select(F.floor(F.col("id") % 3 / 2).alias("k"), "id", F.lit(1).cast("bigint").alias("n"), F.col("id").alias("s"))
    got = scans.scan(rows, "k", [F.col("id")], ["n", "s"], lambda a, b: (a[0] + b[0], a[1] + b[1]), "sums").collect()
    sums = collections.Counter()
    counts = collections.Counter()
    for r in sorted(got, key=lambda r: r.id):
        counts[r.k] += 1
        sums[r.k] += r.id
        assert (r.n, r.s) == (counts[r.k], sums[r.k])
    assert len(got) == 5000


@pytest.mark.parametrize("extra", ["owner", "depth", "ends"])
def test_odd_tables(spark, extra):
    frame = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (2, None, None, None, None)], f"{SCHEMA}, {extra} int")
    assert as_query(prefix_trie.prefix_trie(frame)) == brute([tuple(r)[:4] for r in frame.collect()])
    assert prefix_trie.prefix_trie(frame.where("false")).collect() == []
    assert prefix_trie.prefix_trie(frame.where("false").unionByName(spark.createDataFrame([(None, 1, "a", "b", 1)], frame.schema))).collect() == []
