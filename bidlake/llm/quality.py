"""Quality by an interpolated modified Kneser-Ney model of letters, trained on trusted texts, with counts and scores joined by n-gram."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.session import cut, ensure_checkpoint_dir, let_go, remove

#: Letters of an n-gram, and bits of each in its key.
ORDER, LETTER = 5, 12
#: Code points below stand for themselves; all others share as many classes.
PLAIN = 1 << LETTER - 1
#: Letters of a chunk of texts, whose different n-grams are looked up together, and of a piece of it, which are packed and worked on at once.
CHUNK, WINDOW = 32_000_000, 1_000_000
#: The share of trusted texts of a language that its threshold lets through, and the slack on their perplexity; short texts have more, by so many letters' share.
QUANTILE, SLACK, ALLOWED = 0.995, 1.2, 16
#: One of so many trusted texts isn't trained on, so that thresholds are of texts that the model hasn't seen.
UNSEEN = 4
#: Languages up to which their thresholds are broadcast.
LANGUAGES = 100_000
START, END = 1, 2


def letter_codes(text: str) -> np.ndarray:
    """Codes of a text between its ORDER - 1 starts and its end: lower case, white space as a blank, digits as 0."""
    code = np.frombuffer(f"{chr(START) * (ORDER - 1)}{text.lower()}{chr(END)}".encode("utf-32-le", "replace"), np.uint32)
    code = np.where(code < PLAIN, code, PLAIN + (code * np.uint32(2654435761) >> np.uint32(16)) % PLAIN).astype(np.uint16)
    code[(code >= 9) & (code <= 13)] = 32
    code[(code >= 48) & (code <= 57)] = 48
    return code


def ngram_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that end at each place from the ORDER-th on."""
    keys = np.zeros(max(0, len(codes) - ORDER + 1), np.int64)
    for i in range(ORDER):
        keys = (keys << LETTER) | codes[i : i + len(keys)]
    return keys


def pack(codes: np.ndarray) -> bytes:
    """Codes as compressed bytes, low ones first."""
    planes = np.concatenate([codes & 255, codes >> 8]).astype(np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    """The codes that ``pack`` has packed."""
    planes = np.frombuffer(pa.decompress(data, 2 * n, codec="zstd"), np.uint8)
    return planes[:n].astype(np.uint16) | planes[n:].astype(np.uint16) << 8


def text_chunks(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """(chunk, ids, langs, sizes, texts, codes) of (id, lang, text) in a table bucketed by chunk, its name, and its folder beside the checkpoints.

    A chunk has whole texts of one task, of at most about CHUNK letters or a single longer one, packed in pieces of ``texts`` texts each. The bucketed table keeps the
    texts where they are when n-grams come to them. A null text is an empty one.
    """
    spark = docs.sparkSession
    kind, language = docs.schema["id"].dataType, docs.schema["lang"].dataType
    schema = T.StructType().add("chunk", "long").add("ids", T.ArrayType(kind)).add("langs", T.ArrayType(language)).add("sizes", T.ArrayType(T.LongType())).add("texts", T.ArrayType(T.IntegerType())).add("codes", T.ArrayType(T.BinaryType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, langs, sizes, texts, pieces, held = [], [], [], [], [], []
        number, letters, waiting = TaskContext.get().partitionId() << 32, 0, 0

        def piece() -> None:
            texts.append(len(held))
            pieces.append(pack(np.concatenate(held)))
            held.clear()

        def flush() -> pa.RecordBatch:
            if held:
                piece()
            columns = [(ids, id_type), (langs, lang_type), (sizes, pa.int64()), (texts, pa.int32()), (pieces, pa.binary())]
            row = pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([x], pa.list_(t)) for x, t in columns]], names=schema.names)
            for x, _ in columns:
                x.clear()
            return row

        for batch in batches:
            id_type, lang_type = batch.column(0).type, batch.column(1).type
            for key, lang, text in zip(*(batch.column(i) for i in range(3))):
                code = letter_codes(text.as_py() or "")
                if held and waiting + len(code) > WINDOW:
                    piece()
                    waiting = 0
                held.append(code)
                ids.append(key.as_py())
                langs.append(lang.as_py())
                sizes.append(len(code))
                waiting, letters = waiting + len(code), letters + len(code)
                if letters >= CHUNK:
                    yield flush()
                    number, letters, waiting = number + 1, 0, 0
        if sizes:
            yield flush()

    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    docs.select("id", "lang", "text").mapInArrow(work, schema).write.bucketBy(buckets, "chunk").option("path", folder).saveAsTable(name)
    return spark.table(name), name, folder


def _pieces(chunk: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The pieces of a chunk: texts (from, to), their codes and their sizes."""
    sizes, at = np.array(chunk["sizes"][0].as_py(), np.int64), 0
    for n, packed in zip(chunk["texts"][0].as_py(), chunk["codes"][0].values):
        own = sizes[at : at + n]
        yield at, at + n, unpack(packed.as_py(), int(own.sum())), own
        at += n


def _text_keys(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of texts that lie one after another, without those over their borders, and where each text's begin."""
    keys = ngram_keys(codes)
    inside = np.ones(len(keys), bool)
    ends = np.cumsum(sizes)[:-1]
    for j in range(1, ORDER):
        inside[ends - j] = False
    return keys[inside], np.cumsum(sizes - ORDER + 1) - (sizes - ORDER + 1)


def count_ngrams(chunks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(chunk, gram, n): each chunk's different n-grams, with their number in its trusted texts, whose (chunk, at) is in ``trusted``."""

    def work(places: pa.Table, chunk: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table({"chunk": pa.array([], pa.int64()), "gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        good = np.zeros(len(chunk["ids"][0]), bool)
        good[places["at"].to_numpy()] = True
        every, own = [], []
        for a, b, codes, sizes in _pieces(chunk):
            keys, starts = _text_keys(codes, sizes)
            every.append(pc.unique(pa.array(keys)))
            own.append(pc.value_counts(pa.array(keys[np.repeat(good[a:b], np.diff(np.append(starts, len(keys))))])))
        grams = pa.chunked_array(every).unique().to_numpy()
        values, counts = (np.concatenate([x.field(i).to_numpy() for x in own]) for i in (0, 1))
        order = np.argsort(grams)
        n = np.bincount(np.searchsorted(grams, values, sorter=order), weights=counts, minlength=len(grams)).astype(np.int64)
        return pa.table({"chunk": pa.array(np.full(len(grams), chunk["chunk"][0].as_py())), "gram": pa.array(grams[order]), "n": pa.array(n)})

    return trusted.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(work, "chunk long, gram long, n long")


def _discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's discounts for counts of 1, 2 and more; 0.5, 1 and 1.5 where there are too few n-grams to tell."""
    row = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _discounted(n: Column, d: list[float]) -> Column:
    return n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(F.least(F.lit(d[2]), n))


def score_table(counts: DataFrame) -> DataFrame:
    """(gram, logp) for every n-gram of the corpus, from the trusted counts.

    The counts of each order stay dealt by n-gram and are joined with the corpus' n-grams: for each order its own count, and of its
    context the total and the weight left for the next lower order. Lower orders count different letters before; the last
    falls back on equal shares of all letters and one unknown.
    """
    by_order = {ORDER: counts.filter("n > 0").select("gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = cut(by_order[k + 1].groupBy((F.col("gram").bitwiseAND((1 << LETTER * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    letters = by_order[1].count() + 1
    table = counts.select("gram").withColumn("p", F.lit(1.0 / letters))
    for k in range(1, ORDER + 1):
        own = by_order[k]
        d = _discounts(own)
        cases = [F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)), F.count(F.when(F.col("n") > 2, 1))]
        left = sum(F.lit(x) * c for x, c in zip(d, cases))
        context = own.groupBy(F.shiftright("gram", LETTER).alias("context")).agg(F.sum("n").alias("total"), left.alias("left"))
        keyed = table.withColumn("_own", F.col("gram").bitwiseAND((1 << LETTER * k) - 1)).withColumn("context", F.shiftright("_own", LETTER))
        joined = keyed.join(own.select(F.col("gram").alias("_own"), "n"), "_own", "left").join(context, "context", "left")
        higher = F.coalesce(_discounted(F.col("n"), d), F.lit(0.0)) / F.col("total") + F.col("left") / F.col("total") * F.col("p")
        table = cut(joined.select("gram", F.when(F.col("total").isNotNull(), higher).otherwise(F.col("p")).alias("p")))
    return table.select("gram", F.log("p").alias("logp"))


def score_texts(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, lang, n_letters, perplexity) of every text of the chunks, given (chunk, gram, logp) of each chunk's n-grams."""
    kinds = {f.name: f.dataType.elementType for f in chunks.schema.fields if f.name in ("ids", "langs")}
    schema = T.StructType().add("id", kinds["ids"]).add("lang", kinds["langs"]).add("n_letters", "long").add("perplexity", "double")

    def work(known: pa.Table, chunk: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table({"id": [], "lang": [], "n_letters": [], "perplexity": []})
        grams, logp, sums = known["gram"].combine_chunks(), known["logp"].to_numpy(), []
        for _, _, codes, sizes in _pieces(chunk):
            keys, starts = _text_keys(codes, sizes)
            sums.append(np.add.reduceat(logp[pc.index_in(pa.array(keys), value_set=grams).to_numpy()], starts))
        letters = np.array(chunk["sizes"][0].as_py(), np.int64) - ORDER + 1
        return pa.table({"id": chunk["ids"][0].values, "lang": chunk["langs"][0].values, "n_letters": pa.array(letters), "perplexity": pa.array(np.exp(-np.concatenate(sums) / letters))})

    return scores.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(work, schema)


def perplexity(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(id, lang, n_letters, perplexity) of each whole text of (id, lang, text) under the model of the texts whose id is in ``trusted``.

    The texts are packed in chunks. Each chunk gives its different n-grams; their counts are joined by n-gram, order by order, and each
    n-gram's score goes back to the chunks that have it, so that nothing is collected and texts don't move. Null texts are empty ones, which hold
    only their end; texts may have any length. Without trusted texts all letters are equally likely.
    """
    chunks, name, folder = text_chunks(docs)
    spark = docs.sparkSession
    try:
        places = chunks.select("chunk", F.posexplode("ids").alias("at", "id")).join(trusted.select("id").distinct(), "id").select("chunk", "at")
        grams = count_ngrams(chunks, cut(places))
        counts = cut(grams.groupBy("gram").agg(F.sum("n").alias("n")))
        scores = cut(score_table(counts))
        let_go(spark)
        found = cut(score_texts(chunks, grams.select("chunk", "gram").join(scores, "gram")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)
    return found


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(id, lang, n_letters, perplexity, threshold, kept) of every row of ``docs``; other columns aren't read, whatever their names.

    Trusted are the texts of ids that ``labels`` gives quality 1 and not toxic 1 (an id with several labels must have only such); one in
    UNSEEN of them, by a hash of the id, isn't trained on. A text is kept if its perplexity is at most its language's threshold: ``slack`` times the
    quantile of that language's unseen trusted texts, where it has none, of all its trusted ones; languages without any, null among
    them, take that of all languages. A text's own threshold is higher by ALLOWED letters' share of its length; without trusted texts all are kept. Empty texts have
    one letter, their end, and are judged like others. Repeated rows are rows of their own.
    """
    good = labels.groupBy(id_col).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), F.lit(False))).alias("good")).filter("good")
    flags = cut(good.select(F.col(id_col).alias("id")).filter("id is not null").distinct())
    unseen = F.pmod(F.xxhash64("id"), F.lit(UNSEEN)) == 0
    found = perplexity(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), flags.filter(~unseen))
    scored = cut(found.join(flags.withColumn("trusted", F.lit(True)), "id", "left"))

    def levels(name: str) -> list[Column]:
        return [(F.percentile_approx(F.when(some, F.col("perplexity")), quantile, 10_000) * slack).alias(f"{name}{i}") for i, some in enumerate((unseen, F.lit(True)))]

    by_lang = cut(scored.filter("trusted and lang is not null").groupBy("lang").agg(*levels("own")))
    if by_lang.count() <= LANGUAGES:
        by_lang = F.broadcast(by_lang)
    overall = scored.filter("trusted").agg(*levels("all"))
    held = scored.join(by_lang, "lang", "left").join(F.broadcast(overall))  # one row
    threshold = F.coalesce("own0", "own1", "all0", "all1") * (1 + ALLOWED / F.col("n_letters"))
    kept = F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return held.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_letters", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
