"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import bpe, elkan, forest, htmltext, linededup, media, minhash, mixing, prefixtrie, quality, sharding, suffixdedup, toxicity


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizer files have this vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_text(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.media_features(stored).drop("media_error")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "line_group")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.byte_shards(_table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    encoded = bpe.bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    decoded = bpe.bpe_decode(encoded.select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op11_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.elkan_clusters(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.family_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_linededup": op2_linededup,
        "op3_sharding": op3_sharding,
        "op4_forest": op4_forest,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_quality": op7_quality,
        "op8_bpe": op8_bpe,
        "op9_minhash": op9_minhash,
        "op10_htmltext": op10_htmltext,
        "op11_suffixdedup": op11_suffixdedup,
        "op12_elkan": op12_elkan,
        "op13_prefixtrie": op13_prefixtrie,
        "pipeline": pipeline,
    }


#: All pairs of documents that share a two-word shingle, counted; components by walking the links.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts
), followed AS (
    SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM words
), shingles AS (
    SELECT DISTINCT doc_id, word || ' ' || after AS s FROM followed WHERE after IS NOT NULL
    UNION ALL SELECT doc_id, w[1] FROM texts WHERE len(w) = 1
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
    SELECT * FROM shingles JOIN sizes USING (doc_id)
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM sized x JOIN sized y ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY a, b HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), steps AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, steps.b FROM reached JOIN steps ON reached.b = steps.a
), named AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM named LEFT JOIN sizes USING (doc_id)
"""


def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every distance of every round, none left out by bounds."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [
        """vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), components AS MATERIALIZED (
    SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vectors
), start AS (
    SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM vectors
), centroids0 AS MATERIALIZED (
    SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM start WHERE c < %d
)""" % k
    ]
    for r in range(rounds + 1):
        steps.append(f"""distances{r} AS (
    SELECT i, c, sum((p.x - q.x) * (p.x - q.x)) AS distance FROM components p JOIN centroids{r} q USING (d) GROUP BY i, c
), assigned{r} AS MATERIALIZED (
    SELECT i, min(CAST(distance AS HUGEINT) * 1000 + c) AS best, CAST(best % 1000 AS INT) AS c, CAST(best // 1000 AS BIGINT) AS distance FROM distances{r} GROUP BY i
)""")
        if r < rounds:
            steps.append(f"""means{r} AS (
    SELECT c, d, {floor} AS x FROM (SELECT a.c, d, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM assigned{r} a JOIN components USING (i) GROUP BY a.c, d)
), centroids{r + 1} AS MATERIALIZED (
    SELECT c, d, coalesce(m.x, q.x) AS x FROM centroids{r} q LEFT JOIN means{r} m USING (c, d)
)""")
    return f"""WITH {', '.join(steps)}, digests AS (
    SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centroids{rounds} GROUP BY c
)
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM assigned{rounds} JOIN vectors USING (i) JOIN digests USING (c)"""


#: All prefixes of all rebuilt conversations as keys; each node added to all its ancestors. CRC-32 bit by bit.
PREFIX_TRIE_SQL = """
WITH ordered AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, c - c % 5 AS f, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, x: list_reduce(range(8), lambda b, y: xor(b >> 1, (b & 1) * 3988292384), xor(a, x)), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT c FROM ordered)
), taken AS (
    SELECT ids.c, f, h, count(o.c) AS n FROM ids LEFT JOIN ordered o ON o.c = f AND o.p <= h GROUP BY ALL
), turns AS (
    SELECT taken.c, p AS d, r, t FROM taken JOIN ordered o ON o.c = f AND p <= h
    UNION ALL SELECT taken.c, p - h + n, r, t FROM taken JOIN ordered o ON o.c = taken.c AND p > h
), prefixes AS MATERIALIZED (
    SELECT c, d, md5(string_agg(md5(r) || md5(t), '') OVER (PARTITION BY c ORDER BY d)) AS k, strlen(t) AS bytes FROM turns
    UNION ALL SELECT c, 0, '', 0 FROM ids
), nodes AS MATERIALIZED (
    SELECT d, k, min(c) AS owner, count(*) AS n, (count(*) - 1) * max(bytes) AS saved FROM prefixes GROUP BY d, k
), parents AS (
    SELECT n.*, p.k AS pk, m.owner AS parent FROM nodes n LEFT JOIN prefixes p ON p.c = n.owner AND p.d = n.d - 1 LEFT JOIN nodes m ON m.d = n.d - 1 AND m.k = p.k
), children AS (
    SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY ALL
), weighed AS MATERIALIZED (
    SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (d, k)
), sums AS (
    SELECT a.d, a.k, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved_tokens FROM weighed w JOIN prefixes a ON a.c = w.owner AND a.d <= w.d GROUP BY a.d, a.k
), lasts AS (
    SELECT c, max(d) AS d, arg_max(k, d) AS k FROM prefixes GROUP BY c
), ends AS (
    SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM lasts GROUP BY d, k
)
SELECT owner AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM weighed JOIN sums USING (d, k) LEFT JOIN ends USING (d, k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_minhash": NEAR_DUPLICATES_SQL, "op12_elkan": clusters_sql(), "op13_prefixtrie": PREFIX_TRIE_SQL}
