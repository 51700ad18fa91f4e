"""The prefix trie against plain code and its SQL, with long, equal, empty and very common conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from bidlake.llm import prefixtrie, queries
from tests.oracle import SMALL, connection, differences


def plain_turns(rows):
    """Role and text by conversation, in order."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own)] for c, own in held.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = own + sum(saved[p] for p in children[path])
    ends = defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def found(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def invented(seed):
    """Few different turns, so that conversations share beginnings of all lengths; one much longer than the rest, many equal."""
    draw = random.Random(seed)
    rows = []
    for c in range(0, 400, 2):
        n = draw.choice([1, 2, 3, 5, 9, 14]) if c != 30 else 300
        rows += [(c, t if draw.random() > 0.03 else None, "user" if t % 2 else "bot", f"ü{draw.randrange(2)}") for t in range(n)]
    rows += [(1001 + 2 * i, t, "user", "hello") for i in range(150) for t in range(4)]
    rows += [(5, 0, None, None), (7, 0, "", ""), (7, 1, "a", "b"), (9, 1, "a", "b"), (9, 1, "a", "b"), (None, 1, "a", "b")]
    draw.shuffle(rows)
    return rows


def spread(rows):
    """No two turns of a conversation alike in place, as those stand by their hashes."""
    seen, out = set(), []
    for c, t, role, text in rows:
        if (c, t) not in seen or (c, t) == (9, 1):
            seen.add((c, t))
            out.append((c, t, role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_invented_conversations(spark, seed):
    rows = spread(invented(seed))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).repartition(7)
    assert found(prefixtrie.prefix_trie(frame)) == plain_trie(plain_turns(rows))
    assert found(prefixtrie.family_trie(frame)) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_whole_table_by_plain_code_and_sql(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    assert found(queries.op13_prefixtrie(spark, SMALL)) == plain_trie(plain_rebuilt(plain_turns(rows)))
    assert not differences(queries.op13_prefixtrie(spark, SMALL), connection(), queries.PREFIX_TRIE_SQL)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.prefix_trie(empty).count() == 0 and prefixtrie.family_trie(empty).count() == 0
    rows = [(c, 0, "user", "x") for c in range(40)]  # those that lose their only turn are left without any
    convs = plain_rebuilt(plain_turns([r for r in rows if r[0] % 5]))
    assert any(not t for t in convs.values())
    assert found(prefixtrie.family_trie(spark.createDataFrame([r for r in rows if r[0] % 5], SCHEMA))) == plain_trie(convs)


def test_running_over_borders(spark):
    """A key in many partitions has the same sums, numbers and digests as in one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("k"), "id", (F.col("id") * 37 % 101).alias("v"), F.xxhash64("id").alias("x"))
        got = {(r["k"], r["id"]): (r["s"], r["nth"], r["x"]) for r in prefixtrie.running(rows, "k", [F.col("id")], sums={"v": "s"}, digests=["x"], nth="nth").collect()}
        expected = {}
        for k in range(11):
            total = folded = 0
            for n, r in enumerate(sorted(rows.filter(F.col("k") == k).collect(), key=lambda r: r["id"])):
                total, folded = total + r["v"], folded ^ r["x"]
                expected[(k, r["id"])] = (total, n, folded)
        assert got == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
