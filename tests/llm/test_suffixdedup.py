"""Repeated byte strings against plain code that looks at every string of every text."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest

from bidlake.llm import buckets, queries, suffixdedup
from tests.oracle import SMALL


def plain(texts, match=100):
    """(n_bytes, spans, kept) of each text, which are in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1):
            part = data[i : i + match]
            if part in seen:
                gone[i : i + match] = b"\x01" * match
            else:
                seen.add(part)
        spans, i = [], 0
        while i < len(data):
            j = i
            while j < len(data) and gone[j] == gone[i]:
                j += 1
            spans += [(i, j)] if gone[i] else []
            i = j
        out.append((len(data), spans, bytes(x for x, g in zip(data, gone) if not g)))
    return out


def found(frame):
    return [(r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in frame.orderBy("doc_id").collect()]


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    expected = {i: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for (i, _), (n, spans, kept) in zip(rows, plain([t for _, t in rows]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_suffixdedup(spark, SMALL).collect()}
    assert got == expected and any(x[1] for x in got.values())


def invented(seed):
    """Texts out of shared passages cut at odd places, periods of all lengths, and bytes of several letters."""
    draw = random.Random(seed)
    letters = "abcdefgh ü\n"
    passages = ["".join(draw.choice(letters) for _ in range(draw.choice([40, 90, 99, 100, 101, 130, 400]))) for _ in range(12)]
    texts: list[str | None] = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 200, "abc" * 150 + "d" + "abc" * 150]
    for _ in range(60):
        parts = []
        for _ in range(draw.randrange(1, 7)):
            p = draw.choice(passages)
            a = draw.randrange(0, 30)
            parts.append(p[a : len(p) - draw.randrange(0, 30)] if draw.random() < 0.5 else p)
            parts.append("".join(draw.choice(letters) for _ in range(draw.randrange(0, 60))))
        texts.append("".join(parts))
    texts += [texts[20]] * 40 + [passages[0] * 3]
    return texts


@pytest.mark.parametrize(("seed", "block", "named"), [(1, 4 << 20, 64), (2, 600, 64), (3, 600, 1), (4, 1, 2)])
def test_invented_texts(spark, monkeypatch, seed, block, named):
    monkeypatch.setattr(suffixdedup, "BLOCK", block)
    monkeypatch.setattr(suffixdedup, "NAMED", named)
    texts = invented(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "key").selectExpr("key AS doc_id", "text", "1 AS block", "'x' AS ids").repartition(5)
    assert found(suffixdedup.remove_repeats(frame)) == plain(texts)


def test_small_pieces(monkeypatch):
    """Stretches don't depend on where pieces are cut."""
    texts = [t.encode() for t in invented(5) if t]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = buckets.stretches(data, ends)
    monkeypatch.setattr(buckets, "PIECE", 333)
    again = buckets.stretches(data, ends)
    assert all((getattr(whole, f) == getattr(again, f)).all() for f in ("first", "last", "bucket", "whole"))
    places, own, _ = buckets.match_buckets(data, ends, again.first, again.last)
    assert len(places) == sum(max(0, len(t) - 99) for t in texts)
    by_bucket = {}
    for p, b in zip(places.tolist(), own.tolist()):
        assert by_bucket.setdefault(b, bytes(data[p : p + 100])) == bytes(data[p : p + 100])
    assert len(by_bucket) == len(set(by_bucket.values()))


def test_ids_null_repeated_and_none(spark):
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    frame = spark.createDataFrame([(None, long), (3, long), (3, long), (1, "a" + long)], "doc_id long, text string")
    got = suffixdedup.remove_repeats(frame, with_bytes=False).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, len(long)), (3, len(long)), (3, len(long))]
    assert all(r["kept"] is None for r in got)
    assert suffixdedup.remove_repeats(frame.filter("false")).count() == 0
