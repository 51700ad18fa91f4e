"""Queries over whole tables, held against SQL, plain code, other libraries or labels."""

from __future__ import annotations

import hashlib
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import regex

from bidlake.llm import linededup, queries
from tests.oracle import SMALL, connection, differences


def rows(table: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{table}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert not differences(queries.queries()[name](spark, SMALL), connection(), queries.oracle_sql()[name])


def test_media_digests(spark):
    texts = dict(rows("documents", "doc_id, text"))
    found = queries.op1_media(spark, SMALL).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_shards_are_balanced(spark):
    found = queries.op3_sharding(spark, SMALL).collect()
    texts = dict(rows("documents", "doc_id, text"))
    sums = [0] * 8
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sums[r["shard"]] += r["size"]
    assert len(found) == len(texts) and max(sums) - min(sums) <= 2 * max(r["size"] for r in found)


def test_forest_recall(spark):
    pairs = [(i, np.array(v, np.float64)) for i, v in rows("embeddings", "vec_id, embedding") if v is not None]
    ids, x = np.array([i for i, _ in pairs]), np.stack([v for _, v in pairs])
    found: dict[int, set] = {}
    for r in queries.op4_forest(spark, SMALL).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits, total = hits + len(best & found[ids[i]]), total + len(best)
    assert hits >= 0.9 * total


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    texts = {i: t or "" for i, t in rows("documents", "doc_id, text")}
    for r in queries.op8_bpe(spark, SMALL).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_toxicity_on_held_out_labels(spark):
    toxic = dict(rows("labels", "doc_id, toxic"))
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in queries.op5_toxicity(spark, SMALL).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert held and np.mean([p == t for p, t in held]) >= 0.9


def _normal(line: str) -> str:
    return regex.sub(r"\p{N}+", "0", regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower())).strip(" ")


def _similar(names: list[str]) -> list[tuple[str, str]]:
    """All pairs of names of enough edit similarity; no pair of fewer edits has more letters of one kind apart."""
    names = sorted(names, key=len)
    lengths = np.array([len(x) for x in names])
    letters = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 32, minlength=32) for x in names])
    pairs = []
    for i, x in enumerate(names):
        end = np.searchsorted(lengths, lengths[i] * 100 / linededup.PERCENT + 1, side="right")
        apart = letters[i + 1 : end] - letters[i]
        edits = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        pairs += [(x, names[j]) for j in (np.flatnonzero(edits <= lengths[i + 1 : end] * (100 - linededup.PERCENT) // 100) + i + 1).tolist()]
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT unnest($1) AS a, unnest($2) AS b", [[a for a, _ in pairs], [b for _, b in pairs]])
    return con.execute(f"SELECT a, b FROM p WHERE levenshtein(a, b) <= length(b) * {100 - linededup.PERCENT} // 100").fetchall()


def test_line_dedup_against_all_pairs(spark):
    """Groups by edit similarity alone: no line goes but for a linked one, and hardly one stays."""
    texts = dict(rows("documents", "doc_id, text"))
    places: dict[str, list] = {}
    for i in sorted(texts):
        for at, line in enumerate(texts[i].split("\n") if texts[i] is not None else []):
            if name := _normal(line):
                places.setdefault(name, []).append((i, at))
    root = {name: name for name in places}

    def top(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in _similar(list(places)):
        root[top(a)] = top(b)
    groups: dict[str, list] = {}
    for name, found in places.items():
        groups.setdefault(top(name), []).extend(found)
    expected = {p for g in groups.values() for p in sorted(g)[1:]}
    of = {p: k for k, g in groups.items() for p in g}
    members: dict[int, list] = {}
    gone = set()
    found = queries.op2_linededup(spark, SMALL).collect()
    for r in found:
        for at, group in enumerate(r["line_group"] or []):
            if group is not None:
                members.setdefault(group, []).append((r["doc_id"], at))
    for places_of in members.values():
        assert len({of[p] for p in places_of}) == 1 and len(places_of) > 1
        gone |= set(sorted(places_of)[1:])
    for r in found:
        text = texts[r["doc_id"]]
        assert r["text"] == (None if text is None else "\n".join(line for at, line in enumerate(text.split("\n")) if (r["doc_id"], at) not in gone))
    assert gone <= expected and len(gone) >= 0.98 * len(expected) > 0, (len(gone), len(expected))


def test_sources_get_their_targets(spark):
    found = queries.op6_mixing(spark, SMALL).collect()
    taken: dict = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in found)
    ordered = sorted({(r["source"] is None, r["source"], r["source_size"], r["target"]) for r in found}, key=lambda x: (x[0], x[1] or ""))
    left, open_, targets = sum(x[2] for x in ordered), dict(enumerate(ordered)), {}
    while open_:  # reshare what stops
        weight = sum(i % 3 + 1 for i in open_)
        full = [i for i, x in open_.items() if left * (i % 3 + 1) / weight > 3 * x[2]]
        if not full:
            targets |= {i: left * (i % 3 + 1) / weight for i in open_}
            break
        for i in full:
            targets[i] = 3 * open_.pop(i)[2]
        left = sum(x[2] for x in ordered) - sum(targets.values())
    assert all(abs(targets[i] - x[3]) < 1e-6 * max(1, x[3]) for i, x in enumerate(ordered))


def test_kept_documents_have_no_close_pair(spark):
    """What the pipeline's near-duplicate stage keeps, by plain sets."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [r["text"] for r in corpus_pipeline.without_near_duplicates(spark, docs, SMALL).collect()]
    sets = []
    for text in kept:
        words = regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    assert not [1 for a, b in combinations(filter(None, sets), 2) if 100 * len(a & b) >= 80 * len(a | b)]


def test_line_dedup_recall_of_edit_similarity(spark):
    """Pairs of the smallest scale and of invented short and long lines, by edit similarity alone."""
    texts = dict(rows("documents", "doc_id, text"))
    words = sorted({w for t in texts.values() for w in _normal(t or "").split(" ") if len(w) > 3})
    draw = np.random.default_rng(1)
    for n in (1, 2, 6, 10, 30, 60):
        for k in range(20):
            line = list(draw.choice(words, n))
            other = [line[0][:-1] + "q", *line[1:]] if n < 6 else [*line[:-2], str(draw.choice(words)), line[-1]]
            texts[10_000_000 + 1000 * n + k] = " ".join(line) + "\n" + " ".join(other)
    pairs = _similar(list({_normal(line) for t in texts.values() for line in (t or "").split("\n")} - {""}))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = {}
    for r in linededup.dedup_lines(docs).collect():
        group |= {_normal(line): g for line, g in zip((texts[r["doc_id"]] or "").split("\n"), r["line_group"] or [])}
    for short in (True, False):
        held = [group[a] is not None and group[a] == group[b] for a, b in pairs if (len(b) < 50) == short]
        assert len(held) >= 40
        assert np.mean(held) >= (0.9 if short else 0.95), (short, sum(held), len(held))


def test_forest_recall_over_several_shards(spark, monkeypatch):
    from bidlake.llm import forest

    monkeypatch.setattr(forest, "SHARD", 120)
    monkeypatch.setattr(forest, "BLOCK", 16)
    test_forest_recall(spark)


def test_media_features_by_plain_transform(spark):
    """Equal texts have equal forms, and the stored form is a PNG that another reader's steps take apart."""
    import struct
    from itertools import groupby

    from bidlake.llm import media

    stored = media.store_text(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    column = next(name for name, kind in stored.dtypes if kind == "binary")
    texts = dict(rows("documents", "doc_id, text"))
    found = {r["doc_id"]: r for r in queries.op1_media(spark, SMALL).collect()}
    for r in stored.select("doc_id", column).collect():
        png = bytes(r[column])
        assert (len(png), hashlib.sha256(png).hexdigest()) == (found[r["doc_id"]]["media_bytes"], found[r["doc_id"]]["media_sha256"])
        at, packed, size = 8, b"", None
        while at < len(png):
            n, kind = struct.unpack(">I4s", png[at : at + 8])
            data = png[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + data) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
            size = struct.unpack(">II", data[:8]) if kind == b"IHDR" else size
            packed += data if kind == b"IDAT" else b""
            at += 12 + n
        width, height = size
        raw, before, out = zlib.decompress(packed), bytearray(width), b""
        for y in range(height):
            kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
            for x in range(width):
                line[x] = (line[x] + (line[x - 1] if kind == 1 and x else before[x] if kind == 2 else 0)) & 255
            assert kind in (0, 1, 2)
            before, out = line, out + bytes(line)
        data = (texts[r["doc_id"]] or "").encode()
        assert out == data + bytes(-len(data) % 64 or (0 if data else 64))
    same = sorted((texts[i] or "", r["feature"]) for i, r in found.items())
    assert all(len({f for _, f in g}) == 1 for _, g in groupby(same, key=lambda x: x[0]))


def test_media_feature_by_plain_cosines(spark):
    """The hash of each text's samples: means of a 32 x 32 grid, 8 x 8 lowest cosine coefficients, above their median or not."""
    import math

    waves = [[math.cos(math.pi * (2 * x + 1) * u / 64) * math.sqrt((1 if u == 0 else 2) / 32) for x in range(32)] for u in range(8)]
    texts = dict(rows("documents", "doc_id, text"))
    for r in queries.op1_media(spark, SMALL).collect():
        data = (texts[r["doc_id"]] or "").encode()
        image = np.frombuffer(data + bytes(-len(data) % 64 or (0 if data else 64)), np.uint8).reshape(-1, 64).astype(float)
        n = len(image)
        spans = [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
        grid = np.array([[image[a:b, 2 * x : 2 * x + 2].mean() for x in range(32)] for a, b in spans])
        low = [[sum(waves[u][y] * float(np.dot(waves[v], grid[y])) for y in range(32)) for v in range(8)] for u in range(8)]
        flat = np.array([round(c, 6) for line in low for c in line])
        middle = (sorted(flat)[31] + sorted(flat)[32]) / 2
        bits = "".join("1" if c > middle else "0" for c in flat)
        wrong = bin(int(bits, 2) ^ int(r["feature"], 16)).count("1")
        assert wrong <= sum(abs(c - middle) < 1e-5 for c in flat), r["doc_id"]  # what lies at the median may fall either way


def test_shards_by_plain_prefix_sums(spark):
    """Shards are contiguous in one order with gapless slots, and no row's middle lies outside its shard's part by more than its group of equal texts, or the largest row."""
    found = queries.op3_sharding(spark, SMALL).collect()
    ordered = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [r["slot"] for r in ordered] == [i for s in range(8) for i in range(sum(r["shard"] == s for r in found))]
    total, most, before = sum(r["size"] for r in found), max(r["size"] for r in found), 0
    for r in ordered:
        middle = before + r["size"] / 2
        assert r["shard"] * total / 8 - most <= middle <= (r["shard"] + 1) * total / 8 + most
        before += r["size"]
    places = {}
    for i, r in enumerate(ordered):
        places.setdefault((r["size"], r["text_crc32"]), []).append(i)
    assert all(b - a == 1 for own in places.values() for a, b in zip(own, own[1:]))  # equal texts are neighbours
