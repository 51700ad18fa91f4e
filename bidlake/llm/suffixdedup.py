"""Removal of byte strings that stand earlier already: a sparse suffix sort over blocks of texts by bucket identifiers."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.llm.buckets import MATCH, match_buckets, stretches
from bidlake.session import cut, ensure_checkpoint_dir, let_go, remove, written

#: Bytes of text of a block, and of text for each partition of blocks and each pack of buckets.
BLOCK, SHARE = 4 << 20, 64 << 20
#: Different surroundings of an initial bucket that a block names one by one; of more it only says that there are many, and all are compared match by match.
NAMED = 64
_UNKNOWN = np.uint64(0)


def _packs(numbers: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """A binary value for each count, of so many numbers in order."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, int]:
    """(block, ids, ends, data) of whole texts in the order of their ids, in a table bucketed by block; its name, its folder and the number of packs.

    Blocks are numbered in that order. The bucketed table keeps texts where they are when what is known of a block comes to it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(at_least, math.ceil(n_bytes / SHARE))
    order = [F.col("id").asc_nulls_first(), F.col("_hash").asc(), F.col("_nth").asc()]
    named = rows.withColumns({"_hash": F.xxhash64("text"), "_nth": F.monotonically_increasing_id()})
    placed = named.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    schema = T.StructType().add("block", "long").add("ids", T.ArrayType(rows.schema["id"].dataType)).add("ends", "binary").add("data", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([ends.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                ids.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield flush()

    ensure_checkpoint_dir(spark)
    name = f"blocks_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    blocks = placed.mapInArrow(work, schema)
    blocks.write.bucketBy(min(parts, 100_000), "block").option("path", folder).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name, folder, max(4 * at_least, parts)


@dataclass
class Records:
    """What a block says of its stretches: records in the order of (pack, bucket, whole), of each stretch its record and whether it is the first of its kind."""

    bucket: np.ndarray
    whole: np.ndarray
    counts: np.ndarray
    record: np.ndarray
    first: np.ndarray


def _records(bucket: np.ndarray, whole: np.ndarray, packs: int) -> Records:
    pack = (bucket % np.uint64(packs)).astype(np.int64)
    whole = np.maximum(whole, np.uint64(1))
    order = np.lexsort((whole, bucket, pack))  # stable: equal ones in the order of their places
    b, w = bucket[order], whole[order]
    new_bucket = np.ones(len(b), bool)
    new_bucket[1:] = b[1:] != b[:-1]
    new = new_bucket.copy()
    new[1:] |= w[1:] != w[:-1]
    of_bucket = np.cumsum(new_bucket) - 1
    many = np.bincount(of_bucket, weights=new)[of_bucket] > NAMED if len(b) else np.zeros(0, bool)
    starts = np.where(many, new_bucket, new)
    number = np.cumsum(starts) - 1
    record, first = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
    record[order], first[order] = number, new
    return Records(b[starts], np.where(many, _UNKNOWN, w)[starts], np.bincount(pack[order][starts], minlength=packs), record, first)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _text(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block's texts and where they begin and end."""
    return np.frombuffer(row.column("data")[0].as_buffer(), np.uint8), np.frombuffer(row.column("ends")[0].as_buffer(), "<i8")


def _bucket_packs(blocks: DataFrame, packs: int) -> DataFrame:
    """(pack, block, buckets, wholes): the different stretches of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = stretches(*_text(row))
            found = _records(s.bucket, s.whole, packs)
            some = np.flatnonzero(found.counts)
            columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row.column("block")[0].as_py())), _packs(found.bucket, found.counts[some], 8), _packs(found.whole, found.counts[some], 8)]
            yield pa.RecordBatch.from_arrays(columns, names=["pack", "block", "buckets", "wholes"])

    return blocks.select("block", "ends", "data").mapInArrow(work, "pack int, block long, buckets binary, wholes binary")


def _gathered(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


#: What is known of a record: it is the first or only one, stands in an earlier block as it is, or must be compared match by match.
FIRST, EARLIER, OPEN = 0, 1, 2


def bucket_states(buckets: np.ndarray, wholes: np.ndarray) -> np.ndarray:
    """The state of each record of a pack, which are in the order of their blocks: buckets are sorted, and refined by what surrounds them."""
    order = np.lexsort((wholes, buckets))
    b, w = buckets[order], wholes[order]
    new_bucket = np.ones(len(b), bool)
    new_bucket[1:] = b[1:] != b[:-1]
    new = new_bucket.copy()
    new[1:] |= w[1:] != w[:-1]
    of_bucket = np.cumsum(new_bucket) - 1
    unlike = (np.bincount(of_bucket, weights=new) > 1) | (np.bincount(of_bucket, weights=w == _UNKNOWN) > 0)
    states = np.zeros(len(b), np.uint8)
    states[order] = np.where((w == _UNKNOWN) | new & unlike[of_bucket], OPEN, np.where(new, FIRST, EARLIER))
    return states


def _answers(packed: DataFrame, columns: dict[str, type], decide) -> DataFrame:
    """(block, answers): for each block the packs with any state but FIRST, as (pack, states) in the order in which the block gave them."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        first = next(iter(columns))
        counts = np.array([len(v) for v in table.column(first).to_pylist()]) // np.dtype(columns[first]).itemsize
        states = decide(*[_gathered(table, c, kind) for c, kind in columns.items()])
        ends = np.cumsum(counts)
        told = np.add.reduceat(states != FIRST, ends - counts) > 0 if len(counts) else np.zeros(0, bool)
        rows = [(b, p, states[e - c : e].tobytes()) for b, p, e, c, t in zip(table.column("block").to_pylist(), table.column("pack").to_pylist(), ends, counts, told) if t]
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((), (), ()), kinds)], names=["block", "pack", "states"])

    answered = packed.groupBy("pack").applyInArrow(work, "block long, pack int, states binary")
    return answered.groupBy("block").agg(F.collect_list(F.struct("pack", "states")).alias("answers"))  # at most all packs


def _states(row: pa.RecordBatch, counts: np.ndarray) -> np.ndarray:
    """The states of a block's records in their order; packs without an answer hold firsts only."""
    states, ends = np.zeros(int(counts.sum()), np.uint8), np.cumsum(counts)
    for answer in row.column("answers")[0].as_py() or ():
        states[ends[answer["pack"]] - counts[answer["pack"]] : ends[answer["pack"]]] = np.frombuffer(answer["states"], np.uint8)
    return states


def _match_packs(blocks: DataFrame, answers: DataFrame, packs: int) -> DataFrame:
    """Two kinds of rows: with pack -1 a block's places of matches known to stand earlier (first, last) and its open ones (places, counts); others (pack, block, buckets, checks) of open matches."""
    schema = "pack int, block long, buckets binary, checks binary, first binary, last binary, places binary, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, ends = _text(row)
            s = stretches(data, ends)
            found = _records(s.bucket, s.whole, packs)
            state = _states(row, found.counts)[found.record]
            known, is_open = (state == EARLIER) | ~found.first, (state == OPEN) & found.first
            places, buckets, checks = match_buckets(data, ends, s.first[is_open], s.last[is_open])
            pack = (buckets % np.uint64(packs)).astype(np.int64)
            order = np.lexsort((checks, buckets, pack))
            b, c = buckets[order], checks[order]
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            again = places[order][~new]
            counts = np.bincount(pack[order][new], minlength=packs)
            some = np.flatnonzero(counts)
            number, n = row.column("block")[0].as_py(), len(some)
            nothing = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(n, number)), _packs(b[new], counts[some], 8), _packs(c[new], counts[some], 4), nothing, nothing, nothing, nothing], names=names)
            own = [np.concatenate([s.first[known], again]), np.concatenate([s.last[known], again]), places[order][new], counts]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([number]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *[pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in own]], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return blocks.join(answers.hint("shuffle_hash"), "block", "left").select("block", "ends", "data", "answers").mapInArrow(work, schema)


def match_states(buckets: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """EARLIER for each match of a pack that an earlier block has, FIRST for others."""
    order = np.lexsort((checks, buckets))
    b, c = buckets[order], checks[order]
    states = np.zeros(len(b), np.uint8)
    states[order[1:]] = np.where((b[1:] == b[:-1]) & (c[1:] == c[:-1]), EARLIER, FIRST)
    return states


def _removed(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of ``n`` bytes those that a match covers whose place lies from first to last of a run."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(last + MATCH, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _cleaned(blocks: DataFrame, marks: DataFrame, answers: DataFrame, with_bytes: bool) -> DataFrame:
    """A row for each text: (id, n_bytes, n_removed, spans, kept_sha256, kept)."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType().add("id", kind).add("n_bytes", "long").add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))).add("kept_sha256", "string").add("kept", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for row in _rows(batches):
            data, ends = _text(row)
            first, last, places, counts = (np.frombuffer(row.column(c)[0].as_buffer(), "<i8") for c in ("first", "last", "places", "counts"))
            more = places[_states(row, counts) == EARLIER]
            gone = _removed(len(data), np.concatenate([first, more]), np.concatenate([last, more]))
            out = []
            for a, b in zip(ends.tolist(), ends[1:].tolist()):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))) if own.any() else np.zeros(0, np.int64)
                kept = data[a:b][~own] if len(edges) else data[a:b]
                removed = int((edges[1::2] - edges[::2]).sum())
                out.append((b - a, removed, [{"begin": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()], hashlib.sha256(np.ascontiguousarray(kept)).hexdigest(), kept.tobytes() if with_bytes else None))
            columns = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), span, pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), *columns], names=schema.names)

    known = marks.join(answers, "block", "left").hint("shuffle_hash")
    return blocks.join(known, "block").select("block", "ids", "ends", "data", "first", "last", "places", "counts", "answers").mapInArrow(work, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept) of every text, as UTF-8 bytes, without those that a string of MATCH bytes covers that also starts earlier.

    Earlier is in a text of a smaller id, or before in the same text; strings are those of whole texts as they come, don't cross texts, and overlaps count.
    A suffix is sampled in each string at its least initial bucket, so that equal strings are sampled at the same place. First, buckets of sampled suffixes are sorted
    and refined by the identifiers of the bytes around, over all places that share the suffix. What is alike there stands earlier as a whole or not at
    all; only where a bucket has unlike surroundings are its strings refined to MATCH bytes by the identifiers of later offsets and sorted again. Identifiers are hashes
    (128 bits of surroundings, 96 of strings), so of n strings compared about n^2 / 2^97 pairs are taken for equal.

    A block names a bucket's few surroundings, or says that it has many, so that a very common string is a few records a block, and a group of copies
    one a block. Spans are (begin, end) in bytes, in order and apart; ``kept`` is what is left, null unless ``with_bytes``. A null text is empty, and keeps its row; null ids come first; rows
    equal in id come in the order of a hash of their texts, so of repeated rows the first stays whole. Texts may be of any length that
    a cell holds; a block is a task's work, which takes about 40 bytes for each byte of a text whose strings all are to be compared, far less for others. No two
    texts of over BLOCK bytes are in memory together. Other columns don't matter; no rows, no rows.
    """
    spark = docs.sparkSession
    blocks, name, folder, packs = text_blocks(docs, id_col, text_col)
    matches_folder = None
    try:
        let_go(spark)
        answers = cut(_answers(_bucket_packs(blocks, packs), {"buckets": np.uint64, "wholes": np.uint64}, bucket_states))
        let_go(spark)
        found, matches_folder = written(_match_packs(blocks, answers, packs))
        del answers
        let_go(spark)
        answers = cut(_answers(found.filter("pack >= 0").select("pack", "block", "buckets", "checks"), {"buckets": np.uint64, "checks": np.uint32}, match_states))
        let_go(spark)
        marks = found.filter("pack < 0").select("block", "first", "last", "places", "counts")
        out = cut(_cleaned(blocks, marks, answers, with_bytes))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for used in filter(None, (folder, matches_folder)):
            remove(spark, used)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", "kept_sha256", "kept")
