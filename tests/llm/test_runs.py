"""Runs of words against all periods."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneprep.llm import runs as R
from tuneprep.llm.queries import QUERIES


def plain(words, least_length=6, least_exponent=4):
    """(begin, end, period) by comparing the words with themselves one period further, for each period."""
    w = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out = []
    for q in range(1, len(w) // least_exponent + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]])
        for b, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            begin, end = int(b), int(e) + q
            smaller = any(q % p == 0 and x <= begin and end <= y for x, y, p in out)
            if end - begin >= max(least_length, least_exponent * q) and not smaller:
                out.append((begin, end, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(3)
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 4, [1, 2] * 3 + [1], [2, 1, 1] * 50, list(range(300)), list(range(300, 0, -1)))
    for _ in range(400):
        kinds = rng.choice([1, 2, 2, 3, 5, 30])
        words = [rng.randrange(kinds) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            root = [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
            words += (root * rng.randrange(2, 9))[rng.randrange(3) :] + [rng.randrange(kinds) for _ in range(rng.randrange(9))]
        yield words
    a, b = [1], [1, 2]
    for _ in range(11):
        a, b = b, b + a
    yield b
    yield b * 5


@pytest.mark.parametrize("least", [(6, 4), (3, 3), (1, 5), (40, 4)])
def test_runs_equal_those_of_all_periods(least):
    texts = list(sequences())
    expected = [plain(x, *least) for x in texts]
    assert [R.find_runs(np.array(x, np.int64), np.zeros(len(x), int), *least) for x in texts] == expected
    flat, part = np.array([w for x in texts for w in x]), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    offsets = np.cumsum([0] + [len(x) for x in texts])
    together = [(b + o, e + o, p) for o, rs in zip(offsets, expected, strict=False) for b, e, p in rs]
    assert R.find_runs(flat, part, *least) == sorted(together, key=lambda r: (r[0], r[2]))


def test_chains_end_with_the_longest_lyndon_words():
    """With least 1 each position is in one chain as its longest Lyndon word."""
    for x in sequences():
        if not x:
            continue
        ranks = np.unique(x, return_inverse=True)[1] + 1
        got = {}
        for start, copies, size in R.chains(np.concatenate([[0], ranks, [0]]), int(ranks.max()), 1):
            got |= {start + k * size - 1: size for k in range(copies)}
        w = ranks.tolist()
        suffix = sorted(range(len(w) + 1), key=lambda i: w[i:])
        rank = {s: r for r, s in enumerate(suffix)}
        assert got == {i: next(j for j in range(i + 1, len(w) + 1) if rank[j] < rank[i]) - i for i in range(len(w))}


def test_long_texts_take_linear_time():
    """Words in ascending order, all alike, and a period of a third: none may take the square of its length."""
    n = 200_000
    for words in (np.arange(n), np.zeros(n, int), np.arange(n) % (n // 5), np.arange(n) % 2):
        found = R.find_runs(words.astype(np.int64), np.zeros(n, int))
        assert found == ([] if words[-1] == n - 1 else [(0, n, int(words.max()) + 1)])


def collapsed(words, runs):
    gone = {i for b, e, p in runs for i in range(b + p, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    rs = plain(words)
    lines = "".join(f"{b},{e - b},{p}\n" for b, e, p in rs)
    best = (None,) * 4
    for b, e, p in rs:
        if best[0] is None or (e - b) * best[2] > best[1] * p:
            best = (b, e - b, p, 1000 * (e - b) // p)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, rs))]
    return (doc_id, len(rs), *best, *sha)


def test_query_equals_plain_runs(spark, folder):
    documents = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    expected = [expected_row(*d) for d in documents]
    assert sum(r[1] for r in expected) > 10
    assert sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect()) == sorted(expected)


def test_edges(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 7, "a\x1fb " * 7, "A a " * 9, "x y\x0bz\x0c" * 8, "w" * 300_000, "1 2 " * 60_000, "日本 é " * 30]
    ids = [*range(13), *(i for i in range(10**6) if zlib.crc32(str(i).encode()) % 10 == 0 and i % 7 == 0)][:26] + [None]
    rows = [(i, t, [1], "c") for i, t in zip(ids, [*texts, *texts, "b c " * 9], strict=True)]
    rows.append(rows[8])
    spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected_row(*r[:2])) for r in rows)


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([("a b a b a b a b c", 3, "old", "k")], "text string, runs int, collapsed string, more string")
    row = R.runs(df.select("more", F.col("text"), "runs", "collapsed")).first()
    assert row.asDict(True) == {"more": "k", "text": "a b a b a b a b c", "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "a b c"}
