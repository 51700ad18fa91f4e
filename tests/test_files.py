"""URL lists, replies, summaries, code checks, dynamic columns and the audit log, by cases and written files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bidlake.functions import codecheck, replies, summaries
from bidlake.operators import wide
from bidlake.sources import lists
from bidlake.streaming import audit


def values(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_lists_of_four_separators(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {
        "comma.csv": '﻿id,"The Link",Link\n1,x,"https://a.example/?q=1,2"\n\n2,y,ftp://no\n3,z, http://b.example \n',
        "semicolon.csv": "name;URL;note\na,b;https://c.example;c,d\n",
        "tab.csv": "site\tx\nhttps://d.example\t1\nhttps://d.example\t2\n",
        "pipe.csv": 'no|tender_url\n1|"https://e.example/""q"""\n2\n',
        "headless.csv": "https://f.example\nhttps://g.example\n",
        "other.csv": "first,second\nhttps://h.example,https://i.example\n",
        "blank.csv": "\n  \n",
    }
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    lines = lists.lines_of_files(spark, str(tmp_path / "in"))
    found = {r["file"].rsplit("/", 1)[-1]: r["separator"] for r in lists.dialects(lines).collect()}
    assert found == {"comma.csv": ",", "semicolon.csv": ";", "tab.csv": "\t", "pipe.csv": "|", "headless.csv": ",", "other.csv": ","}
    urls = lists.listed_urls(lines)
    got = sorted((r["file"].rsplit("/", 1)[-1].split(".")[0], r["url"]) for r in urls.collect())
    assert got == [
        ("comma", "http://b.example"), ("comma", "https://a.example/?q=1,2"), ("headless", "https://f.example"), ("headless", "https://g.example"), ("other", "https://h.example"),
        ("pipe", 'https://e.example/"q"'), ("semicolon", "https://c.example"), ("tab", "https://d.example"), ("tab", "https://d.example"),
    ]
    assert [r["url"] for r in lists.first_of_each(urls, 3).orderBy("place").collect()] == ["https://a.example/?q=1,2", "http://b.example", "https://f.example"]
    assert [r["url"] for r in lists.listed_urls(lines.filter("file like '%other%'"), column="SECOND").collect()] == ["https://i.example"]
    direct = spark.createDataFrame([(" https://d.example ",), ("",), (None,)], "url string")
    assert {tuple(r) for r in lists.direct_then_listed(direct, urls.filter("file like '%tab%' or file like '%semi%'")).collect()} == {("https://d.example", "direct"), ("https://c.example", "list")}


def test_url_columns(spark):
    headers = spark.createDataFrame([(0, ["Website", "URL"]), (1, ["a", "Links"]), (2, ["x"])], "i int, h array<string>").orderBy("i")
    place = lambda names, by_name: [r[0] for r in headers.select(lists.url_column(F.col("h"), names, by_name)).collect()]
    assert place(lists.ANY_HEADER, False) == [2, 2, None] and place(lists.BEST_HEADER, True) == [2, None, None] and place(["website", "url"], True) == [1, None, None]


def test_replies(spark):
    known = {"titel": F.lit("old"), "cpv_codes": F.array(F.lit("x"), F.lit("y")), "lose": F.lit(None).cast("array<string>")}
    cases = {
        '```json\n{"titel": " new ", "cpv_codes": [1, "b", 2.50, true, false, 0, null, ""], "lose": ["l"]}\n```': ("new", ["1", "b", "2.50", "True"], ["l"]),
        '{"titel": "", "cpv_codes": ["only"], "lose": []}': ("old", ["x", "y"], []),
        '{"titel": 5, "cpv_codes": "no"}': ("old", ["x", "y"], []),
        'Here it is: {"titel": "salvaged"} as asked': ("old", ["x", "y"], []),
        "[1]": ("old", ["x", "y"], []), "no json": ("old", ["x", "y"], []), "": ("old", ["x", "y"], []), None: ("old", ["x", "y"], []),
    }
    found = values(spark, list(cases), lambda t: replies.merged_fields(t, known))
    shown = [(f["titel"], [x.replace("2.5", "2.50") if x == "2.5" else x for x in f["cpv_codes"]], f["lose"]) for f in found]
    assert shown == list(cases.values())
    assert values(spark, ['so: {"titel": "s"} .'], lambda t: replies.merged_fields(t, {"titel": F.lit("old")}, salvage=True)["titel"]) == ["s"]


def test_word_budget(spark):
    long = "one two three. four five six seven"
    cases = [("a b", 3), (long, 7), (long, 5), (long, 6), ("w " * 9, 3), ("", 3), (None, 3), ("a.b " * 4, 2)]
    found = [values(spark, [t], lambda c, n=n: summaries.within_words(c, n))[0] for t, n in cases]
    assert found == ["a b", long, "one two three.", "one two three. four five six…", "w w w…", "", None, "a.b a."]


def test_sentences_and_bullets(spark):
    assert values(spark, ["A b. C d! E f? G", " x ", "", None], summaries.sentences) == [["A b.", "C d!", "E f?", "G"], ["x"], [], None]
    text = "intro. more\n- one\n• two\n3) three\n* \n4. four"
    assert values(spark, [text, "One. Two. Three."], lambda t: summaries.bullet_sentences(t, 3)) == [["one", "two", "three"], ["One.", "Two.", "Three."]]
    assert values(spark, ["2025-03-15", "2025-13-01", " soon ", None], summaries.long_date) == ["15 March 2025", "2025-13-01", "soon", None]


def test_summaries_of_what_is_there(spark):
    names = ["tender_type", "issuing_authority", "tender_title", "tender_id", "publication_date", "submission_deadline", "tender_value", "scope_of_work", "eligibility", "contact_email", "contact_name", "contact_phone"]
    said = {"issuing_authority": "City", "tender_title": "t" * 130, "publication_date": "2025-01-02", "scope_of_work": "First. Second. Third.", "eligibility": "- one\n- two", "contact_name": "Kim", "contact_phone": "7"}
    one = spark.range(1)
    f = {n: F.lit(said.get(n)).cast("string") for n in names} | {"cpv_codes": F.array(*[F.lit(str(i)) for i in range(7)])}
    found = one.select(summaries.english_summary(f).alias("s")).first()["s"]
    assert found["paragraph"] == f"Tender issued by City for {'t' * 119}…. This tender was published on 2 January 2025. CPV code(s): 0, 1, 2, 3, 4. First. Second. Eligibility: one; two. Contact: Kim, Tel: 7."
    assert found["bullets"] == ["Issuing authority: City", f"Title: {'t' * 119}…", "Publication date: 2 January 2025", "CPV codes: 0, 1, 2, 3, 4"]
    none = {n: F.lit(None).cast("string") for n in replies.TEXTS} | {n: F.array().cast("array<string>") for n in replies.LISTS}
    row = one.select(summaries.german_paragraph(none).alias("p"), summaries.german_bullets(none).alias("b")).first()
    assert (row["p"], row["b"]) == ("Es handelt sich um ein öffentliches Vergabeverfahren.", [])
    some = none | {"vergabestelle": F.lit("Amt"), "auftragswert": F.lit("5"), "laufzeit": F.lit("1 Jahr"), "nuts_codes": F.array(*map(F.lit, "ABCD")), "ansprechpartner": F.lit("Kim")}
    row = one.select(summaries.german_paragraph(some).alias("p"), summaries.german_bullets(some).alias("b")).first()
    assert row["p"] == "Amt führt ein Vergabeverfahren durch. Auftragswert: 5 EUR. Vertragslaufzeit: 1 Jahr."
    assert row["b"] == ["Auftraggeber: Amt", "Geschätzter Auftragswert: 5 EUR", "Vertragslaufzeit: 1 Jahr", "NUTS-Region: A, B, C", "Ansprechpartner: Kim"]


@pytest.mark.parametrize(
    ("code", "said"),
    [
        ("def scrape(url, output_dir):\n    return []", []),
        ("import subprocess\ndef scrape(url, output_dir):\n    subprocess.run(['ls'])", ["forbidden import: subprocess", "forbidden call: subprocess.run"]),
        ("def scrape(url, output_dir):\n    eval('1+1')", ["forbidden call: eval"]),
        ("def other(): pass", ["missing required function `scrape(url, output_dir)`"]),
        ("from socket import socket as s\nimport os.path, ctypes.util\ndef scrape(u, o): pass", ["forbidden import-from: socket", "forbidden import: ctypes.util"]),
        ("from . import subprocess\ndef scrape(u, o): x.os.system('a'); (lambda: 1)(); f()()", []),
        ("def scrape(", ["SyntaxError"]), ("", ["missing required function `scrape(url, output_dir)`"]), ("x\x00y", ["SyntaxError"]), ("(" * 5000, ["SyntaxError"]),
    ],
)
def test_code_checks(code, said):
    assert [e.split(":")[0] if e.startswith("SyntaxError") else e for e in codecheck.offences(code)] == said


def test_checked_code_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "def scrape(u, o): pass", "x"), (2, None, "y")], "id int, code string, ok string")
    assert [(r["id"], r["ok"], len(r["errors"])) for r in codecheck.checked_code(rows).orderBy("id").collect()] == [(1, True, 0), (2, False, 1)]


def test_dynamic_columns_are_written_and_read(spark, tmp_path):
    pairs = [("a", 1, "title", "T, \"q\""), ("a", 2, "buyer", "B"), ("b", 1, "buyer", "C"), ("b", 3, "deadline", None), ("b", 4, "Buyer", "D"), ("b", 5, "buyer", "E"), ("c", 1, None, None), ("a", 6, "file", "F")]
    frame = spark.createDataFrame(pairs, "file string, nth int, name string, value string")
    made = wide.wide(frame, ["file"], "name", "value", ["file", "nth"])
    assert made.columns == ["file", "title", "buyer", "file_", "deadline", "Buyer_"]
    rows = {tuple(r) for r in made.collect()}
    assert rows == {("a", 'T, "q"', "B", "F", None, None), ("b", None, "E", None, None, "D"), ("c", None, None, None, None, None)}
    made.write.csv(str(tmp_path / "out"), header=True, escape='"')
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True, escape='"').collect()} == rows
    assert wide.wide(frame.filter("false"), ["file"], "name", "value", ["nth"]).columns == ["file"]


def test_a_repeated_batch_adds_no_rows(spark, tmp_path):
    schema = "event_type string, message string, job_id string, item_id string"
    first = spark.createDataFrame([("e", "m" * 5000, "j", "i"), ("f", None, None, None)], schema)
    second = spark.createDataFrame([("g", "n", "j", None)], schema)
    write = audit.append_batch(str(tmp_path / "log"))
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(rows, batch)
    found = sorted((r["batch_id"], r["event_type"], len(r["message"]), r["trace_id"]) for r in audit.audit_log(spark, str(tmp_path / "log")).collect())
    assert found == [(0, "e", 4000, "j:i"), (0, "f", 0, None), (1, "g", 1, "j")]
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = audit.audit_stream(spark, str(tmp_path / "in"), first.schema)
    query = stream.writeStream.foreachBatch(audit.append_batch(str(tmp_path / "streamed"))).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert audit.audit_log(spark, str(tmp_path / "streamed")).count() == 2
