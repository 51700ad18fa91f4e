"""Classifiers over every whole page and document, held against Python's patterns."""

from __future__ import annotations

import re

import duckdb
import pytest

from bidlake import catalog
from bidlake.functions import pages, rules
from tests.oracle import SMALL


def texts() -> dict[tuple, str]:
    return {(k, i): t or "" for k, i, t in duckdb.sql(f"SELECT 'page', page_id, html FROM '{SMALL}/pages.parquet' UNION ALL SELECT 'document', doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()}


def pattern(p: str) -> re.Pattern:
    return re.compile(p.removeprefix("(?s)"), re.I | (re.S if p.startswith("(?s)") else 0))


def test_injections_of_whole_texts(spark):
    expected = {k: sum(bool(pattern(p).search(t)) for p in rules.INJECTIONS) for k, t in texts().items()}
    assert {(r["kind"], r["id"]): r["hits"] for r in catalog.queries()["injection_scan_texts"](spark, SMALL).collect()} == expected


def test_redaction_of_whole_texts(spark):
    expected = texts()
    for p in rules.INJECTIONS:
        expected = {k: pattern(p).sub("[REDACTED:injection]", t) for k, t in expected.items()}
    assert {(r["kind"], r["id"]): r["text"] for r in catalog.queries()["redaction_texts"](spark, SMALL).collect()} == expected


def wall(html: str) -> tuple:
    sample = html[: pages.SAMPLE]
    has = lambda p: re.search(p, sample, re.I) is not None
    many, n_links = len(re.findall(pages.LOGIN_WORDS, sample, re.I)) >= 2, len(re.findall(pages.DOCUMENT_LINK, sample, re.I))
    if has(pages.EXPIRED):
        return True, "expired", 0.9
    signs = [(has(pages.PASSWORD), 55), (has(pages.LOGIN_FORM), 25), (many, 20), (has(pages.REGISTER_WORDS), 10), (has(pages.GATED), 45), (has(pages.CAPTCHA), 35)]
    score = sum(n for sign, n in signs if sign) - (50 + 10 * min(n_links, 5) if n_links else 0)
    kind = "captcha" if signs[5][0] else "login" if signs[0][0] or signs[1][0] or many else "registration" if signs[3][0] else "login" if signs[4][0] else None
    score = max(0, min(100, score))
    return score >= 60 and kind is not None, kind, score / 100


def test_walls_of_whole_pages(spark):
    expected = {i: wall(t) for (k, i), t in texts().items() if k == "page"}
    found = {r["page_id"]: (r["is_wall"], r["kind"], pytest.approx(float(r["confidence"]))) for r in catalog.queries()["login_wall_pages"](spark, SMALL).collect()}
    assert found == expected
