"""The whole pipeline on a small corpus, against plain code."""

from __future__ import annotations

import re

import corpus_pipeline
from bidlake.llm import toxicity
from bidlake.llm.queries import vocabulary_path

WORDS = "harbour lantern copper meadow thunder velvet orchard granite willow compass feather marble canyon ripple anchor saddle timber crystal pepper blanket".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def _prose(seed: int, n: int = 60) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i * 5) % len(WORDS)] + "abcdefghij"[(i + seed) % 10] for i in range(n))


def _write(spark, folder, rows) -> str:
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    insults = " ".join(sorted(w for w in toxicity.SEED if w.isascii())[:12])
    head = "this very line stands at the head of several pages of the corpus"
    texts = {
        1: _prose(1), 2: f"{head}\n{_prose(2)}", 3: f"{head}\n{_prose(3)}", 4: f"{insults} you {insults}", 5: _prose(1), 6: _prose(2) + " again",
        7: None, 8: "", 9: _prose(9, 400), 10: _prose(2).replace("\n", " ").split(" ", 1)[1],
    }
    folder = _write(spark, tmp_path / "in", [(i, t, "en", "ab"[i % 2] if i != 9 else None, len(t or "")) for i, t in texts.items()])
    # By plain code: insults go; of equal lines the first stays; then no text has words that aren't in one kept before.
    left = {i: t for i, t in texts.items() if i != 4}
    left[3] = _prose(3)
    left[5] = ""
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t and t.split() else set()
    kept: dict[int, str] = {}
    for i, t in sorted(left.items()):
        if t and not any(near(shingles(t), shingles(o)) for o in kept.values()):
            kept[i] = t
    found = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in found}
    assert ids <= set(kept) and {1, 2, 3, 9} <= ids
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    by_source: dict = {}
    for r in found:
        assert r["ids"] == tokenizer.encode(kept[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["decodes"]
        by_source[r["source"]] = by_source.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", kept[r["doc_id"]]))
    assert all(sum(x["doc_id"] == i for x in found) <= 3 for i in ids) and set(by_source) == {"a", "b", None}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _write(spark, tmp_path / "in", [])).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    folder = _write(spark, tmp_path / "in", [(1, _prose(1), "en", "a", 9), (2, None, None, None, None), (None, "x", "de", "a", 1)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
