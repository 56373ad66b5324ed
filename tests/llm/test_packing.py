"""Packing: exact ids, whole rows, gapless sequences, and few of them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tuneprep.llm import packing as P
from tuneprep.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity=P.CAPACITY):
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            expected.append((key, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1])
        assert sum(n for _, n in places) <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_whole_table(spark, folder):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bins, bound = check(QUERIES["op7_best_fit_packing"](spark, folder).collect(), texts)
    assert bins <= bound + 2


def test_cases(spark, tmp_path):
    texts = [
        None, "", "a", "<|endoftext|> x", "tab\x1d \x85 ½ m²  \n\n 日本語 it's we'll_ok", "word " * 5000, "x" * 50_000, "e\u0301 ﬁ",
        *(["the same text"] * 40),
    ]
    rows = [(i % 30, t, "sequence_id", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, row string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    check(QUERIES["op7_best_fit_packing"](spark, str(tmp_path)).collect(), [(r[0], r[1]) for r in rows])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op7_best_fit_packing"](spark, f"{tmp_path}/none").count() == 0


def test_groups_meet_again_in_later_rounds(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    rows = P.pack(df, group=200).collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.05 * len(P.best_fit(lengths, 1024))


@pytest.mark.parametrize("seed", range(5))
def test_local_search_empties_bins(seed):
    """Bins filled at random: the search keeps all pieces, never overfills, and comes near the bound."""
    rng = random.Random(seed)
    lengths = [rng.randint(20, 400) for _ in range(120)]
    start = [[i, i + 1] for i in range(0, 120, 2)]
    before = sum(sum(lengths[r] for r in b) ** 2 for b in start)
    out = P.local_search([list(b) for b in start], lengths, 1024)
    assert sorted(r for b in out for r in b) == list(range(120))
    fills = [sum(lengths[r] for r in b) for b in out]
    assert max(fills) <= 1024 and sum(f * f for f in fills) > before
    assert len(out) <= -(-sum(lengths) // 1024) + 2


@pytest.mark.parametrize("seed", range(6))
def test_local_search_ends_when_no_exchange_is_left(seed):
    """Every move of one or two pieces for none or one, between any two underfull bins, is tried on the result."""
    rng = random.Random(seed)
    high = (300, 700, 1023)[seed % 3]
    lengths = [rng.randint(1, high) for _ in range(60)]
    out = P.local_search(P.best_fit(lengths, 1024) if seed % 2 else [[i] for i in range(60)], lengths, 1024)
    fill = [sum(lengths[r] for r in b) for b in out]
    under = [i for i in range(len(out)) if fill[i] < 1024]
    for a in under:
        for b in under:
            if a == b:
                continue
            taken = [(r,) for r in out[a]] + [(r, s) for i, r in enumerate(out[a]) for s in out[a][i + 1 :]]
            for take in taken:
                for back in [(), *((r,) for r in out[b])]:
                    d = sum(lengths[r] for r in take) - sum(lengths[r] for r in back)
                    assert not (0 < d <= 1024 - fill[b] and fill[b] + d > fill[a])
