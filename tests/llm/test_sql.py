"""Queries against their SQL: on a whole small table, on edge cases, and on empty tables."""

import random
from collections import Counter

import duckdb
import pytest

from tuneprep.llm.queries import ORACLES, QUERIES

NAMES = sorted(ORACLES)
rng = random.Random(5)


def compared(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations", "pages"):
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet{'' if 'testdata' in folder else '/*.parquet'}')")
    relation = con.sql(ORACLES[name])
    result = QUERIES[name](spark, folder)
    columns = sorted(result.columns)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    theirs = Counter(tuple(r[i] for i in order) for r in relation.fetchall())
    ours = Counter(tuple(r) for r in result.select(*columns).collect())
    assert (list((ours - theirs).items())[:4], list((theirs - ours).items())[:4]) == ([], [])
    return ours


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, folder, name):
    assert compared(spark, folder, name)


def words(n, kinds=40):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def documents():
    passage = words(30, 10**6)
    base = words(120, 10**6)
    near = [base[:i] + ["other"] + base[i + 1 :] for i in (3, 50, 119)]
    far = [base[:40] + words(80, 10**6), base[:90]]
    licence = "Released under the MIT License."
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\nThis line is unknown. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    )
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "ONE",
        "one two",
        "Two ONE",
        "a b c",
        "...!!!",
        " ".join(base),
        " ".join(base).upper(),
        *(" ".join(x) for x in near),
        *(" ".join(x) for x in far),
        " ".join(words(10) + passage[:9] + words(3) + passage[4:20] + words(4)),
        " ".join(passage[:10]) + "," + ";".join(passage[:10]),
        "x" + " ".join(passage),
        "-".join(passage).upper(),
        "short item " * 40,
        "é日本 x ".join(passage[:12]),
        " ".join(words(20000, 10**6)),
        "a" * 100000,
        f"text. {licence} More text\nLicensed under CC BY-NC 4.0.\n{licence}",
        mit,
        mit.replace("\n", " "),
        "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. licensed",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ]
    items = [
        (0, None),
        (1, ""),
        (2, " ".join(passage)),
        (3, " ".join(passage[2:14])),
        (4, "Short ITEM"),
        (5, "日本"),
        (6, " ".join(passage)),
        (7, "..."),
        (10, " ".join(passage[:10])),
    ]
    # A text without an id between two that only it links, the same twice, and one of null ids alone.
    chain = words(60, 10**6)
    changed = lambda places: " ".join("other" if i in places else w for i, w in enumerate(chain))
    nameless = [changed((0,)), changed((0,)), None, "", " ".join(words(50, 10**6))]
    rows = [(i * 3 + 1, t, 7, "x") for i, t in enumerate([*texts, changed(()), changed((0, 59))])]
    return rows + [(None, t, 8, "y") for t in [*nameless, nameless[-1]]], items


def vectors():
    out = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0]]
    for _ in range(6):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        for k in range(12):
            out.append([c + rng.gauss(0, 0.1 * (k % 4)) for c in centre])
            out.append([-c for c in out[-1]] if k == 5 else [3 * c for c in out[-1]])
    out += [out[20]] * 5 + [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    return [(i * 7 % 1000, v, i, [None, 3, 3, 4][i % 4]) for i, v in enumerate(out)]


def messages():
    rows = [
        (1, 0, "a", "First line\nsecond line\n\nOther  PARAGRAPH here"),
        (1, 1, "b", "> first LINE\n> second line\nReply one"),
        (1, 2, "a", "On Monday Ann wrote:\n>> First line\n>> second line\n> Reply one\n\nReply two"),
        (1, 5, "b", "> other paragraph here\n\n> Reply two\nThree"),
        (1, 7, "b", "> never said\nFour"),
        (1, 9, "c", "> > > first line second line\n>Four\n"),
        (1, 9, "d", None),
        (2, 3, "a", "> first line\n> second line"),
        (2, 4, "b", ""),
        (2, 8, "b", "plain\r\ntext\r\n> quoted later"),
        (2, 9, "b", "quoted later"),
        (None, 1, "a", "> Four\nx"),
        (3, None, "a", "Four"),
    ]
    return rows + [(9, i, "u", f"line {i}" if i % 3 else f"> line {i - 1}\nyes") for i in range(1200)]


def pages():
    return [(1, None, None), (2, "http://a.com/x", "")]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    docs, items = documents()
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, size int, hash string"),
        ("benchmark", items, "item_id long, text string"),
        ("embeddings", vectors(), "vec_id long, embedding array<float>, class int, label int"),
        ("conversations", messages(), "conv_id long, turn long, role string, text string"),
        ("pages", pages(), "page_id long, url string, html string"),
        ("labels", [(1, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        more = ", lang string" if name == "documents" else ""
        spark.createDataFrame([], schema + more).write.parquet(f"{folder}/empty/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, edges, name):
    assert compared(spark, edges, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edges, name):
    if name in ("op7_best_fit_packing", "op8_secret_scan"):
        pytest.skip("has a test of its own")
    assert QUERIES[name](spark, f"{edges}/empty").count() == 0
