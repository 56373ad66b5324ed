"""Texts that grow in one direction: no operator may end a JVM, or take more than time in proportion."""

import random
import time

import pytest

from tuneprep.llm import licenses, quotation, secret_scan
from tuneprep.llm.queries import QUERIES

rng = random.Random(8)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License").'
MIT = "Released under the MIT License."
TEXTS = {
    "base64": "".join(rng.choices(BASE64, k=200_000)),
    "marks": ">" * 20_000,
    "spaced marks": " > \t" * 20_000 + "a",
    "licences": "\n".join([APACHE, *[MIT] * 20_000]),
    "lines": "\n".join(f"> line {i}" if i % 3 else f"line {i}" for i in range(100_000)),
    "one quote": "> said\n" * 100_000,
    "path": "ab/" * 20_000 + "a1",
    "names": "abc-def_" * 20_000 + "9",
    "one word": "w" * 300_000,
    "separators": "=:=\"' " * 30_000,
    "keywords": "token=" * 30_000,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = list(enumerate(TEXTS.values()))
    tables = {
        "documents": (rows + [(i, f"plain text {i} of some words") for i in range(50, 90)], "doc_id long, text string"),
        "benchmark": ([(i, t[:5000]) for i, t in rows], "item_id long, text string"),
        "conversations": ([(1, i, "u", t) for i, t in rows], "conv_id long, turn long, role string, text string"),
        "labels": ([(i, i % 2, i % 2) for i in range(90)], "doc_id long, quality int, toxic int"),
        "pages": ([(i, "http://a.com/" + t, t) for i, t in rows], "page_id long, url string, html string"),
    }
    for name, (data, schema) in tables.items():
        df = spark.createDataFrame(data, schema)
        if name == "documents":
            df = df.selectExpr("*", "if(doc_id % 2 = 0, 'en', 'de') as lang")
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("op10_cover_tree", "op12_vector_codes")))
def test_every_operator_ends(spark, folder, name):
    table = {"op2_link_trust": "pages", "op4_quotation_links": "conversations"}.get(name, "documents")
    start = time.monotonic()
    rows = QUERIES[name](spark, folder).collect()
    assert time.monotonic() - start < 240
    if name != "op7_best_fit_packing":
        assert len(rows) == spark.read.parquet(f"{folder}/{table}.parquet").count()


def test_rules_over_many_identifiers(spark):
    texts = ["\n".join([APACHE, *[MIT] * n, "You may obtain a copy of the License at http://a.b"]) for n in (0, 1, 20_000)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert [(len(r["sentence_ids"]), r["licenses"]) for r in sorted(rows)] == [(2, ["Apache-2.0"]), (3, ["Apache-2.0", "MIT"]), (20_002, ["Apache-2.0", "MIT"])]


def test_rules_are_subsequences(spark):
    known = {c: c for c in "abc"}
    rules = [("ab", ["a", "b"]), ("abc", ["a", "b", "c"]), ("aa", ["a", "a"]), ("abc", ["c", "c"]), ("ba", ["b", "a"])]
    texts = [".\n".join(rng.choices("abcx", k=rng.randrange(8))) for _ in range(200)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), known=known, rules=rules).collect()

    def fits(sequence, ids):
        rest = iter(ids)
        return all(x in rest for x in sequence)

    for r in rows:
        ids = r["sentence_ids"]
        shown = {}
        for number, (name, sequence) in enumerate(rules, 1):
            if fits(sequence, ids):
                shown.setdefault(name, number)
        assert (r["licenses"], r["rules"]) == ([n for n in dict(rules) if n in shown], [shown[n] for n in dict(rules) if n in shown])
    none = licenses.scan(spark.createDataFrame([(1, APACHE)], "id long, text string"), rules=[]).first()
    assert (none["sentence_ids"], none["licenses"]) == (["apache-2-header"], [])


def test_quotes_and_secrets_in_long_texts(spark):
    lines = quotation._lines
    df = spark.createDataFrame([(1, TEXTS["marks"] + "x"), (2, TEXTS["spaced marks"]), (3, "a > b"), (4, " >\t> c")], "id long, text string")
    got = {r["id"]: [(x["level"], x["words"]) for x in r["l"]] for r in df.select("id", lines(df["text"]).alias("l")).collect()}
    assert got == {1: [(20_000, "x")], 2: [(20_000, "a")], 3: [(0, "a > b")], 4: [(2, "c")]}
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(TEXTS.values())), "id long, text string")).collect()
    spans = {name: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for name, r in zip(TEXTS, sorted(rows), strict=True)}
    whole = [s for s in spans["base64"] if s[0] == "entropy"]
    assert whole and sum(e - b for _, b, e in spans["base64"]) >= 200_000 - 100 and spans["path"] == spans["names"] == []
