"""The pipeline, stage by stage, on documents with planted cases."""

import random

import corpus_pipeline
import pytest

from tuneprep.llm.packing import CAPACITY

rng = random.Random(3)
WORDS = {
    "en": "the of and thing when other there which from have river stone water night house under".split(),
    "de": "der die und nicht über schön straße zwischen größe müssen können haus wasser nacht".split(),
}


def prose(lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "en", "is"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(lang, 80), lang, "s", 1, i) for i in range(60) for lang in [("en", "de")[i % 2]]]
    passage = " ".join(f"word{i}" for i in range(14))
    near = rows[1][1].split()
    near[40] = "changed"
    rows += [
        (100, rows[0][1].upper(), "en", "s", 1, 0),
        (101, " ".join(near), "de", "s", 1, 0),
        (102, prose("en", 30) + " " + passage + " " + prose("en", 5), "en", "s", 1, 0),
        (103, prose("en", 20) + " token = 0123456789abcdef01234567 " + prose("en", 9), "en", "s", 1, 0),
        (104, "12345 !!!", None, "s", 1, 0),
        (105, None, "en", "s", 1, 0),
        (106, "", None, None, None, None),
        (107, prose("en", 3000), "en", "s", 1, 0),
        (2, rows[2][1], "en", "s", 1, 0),
        (None, prose("en", 40), "en", "s", 1, 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect())
    everything = sorted((r[0] is None, r[0]) for r in rows)
    gone = [(False, 104), (False, 105), (False, 106)]
    assert kept["language_id"] == [x for x in everything if x not in gone]
    copies = [(False, 100), (False, 101)]
    left = [x for x in kept["language_id"] if x not in copies]
    left.remove((False, 2))
    assert kept["ngram_jaccard_join"] == left
    assert kept["benchmark_decontamination"] == [x for x in left if x != (False, 102)]
    assert kept["secret_scan"] == kept["benchmark_decontamination"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "0123456789" not in texts[103] and "[SECRET]" in texts[103] and texts[3] == rows[3][1]


def test_near_copies_with_several_edits(spark, tmp_path):
    base = [f"w{i}" for i in range(100)]

    def edited(*places):
        return " ".join("other" if i in places else w for i, w in enumerate(base))

    # Sets of 5 words: 96 in each; two separate edits leave 86 of 106 in common (0.811), three 81 of 111 (0.730).
    rows = [(1, " ".join(base)), (2, edited(30, 60)), (3, edited(20, 50, 80)), (4, " ".join(f"v{i}" for i in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3, 4]


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """A stage decides on each row: no clean document goes with a row of its id, and no copy stays with one."""
    passage = " ".join(f"word{i}" for i in range(14))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = [" ".join(f"{k}{i}" for i in range(100)) for k in "abcdef"]
    schema = "doc_id long, text string, _row int"

    def left(stage, rows):
        out = stage(spark, spark.createDataFrame([(*r, 5) for r in rows], schema), str(tmp_path))
        assert out.columns == ["doc_id", "text", "_row"]
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    clean = [(None, text[0]), (None, text[1]), (7, text[2]), (8, text[3])]
    dirty = [(None, text[4] + " " + passage), (7, text[5] + " " + passage)]
    assert left(corpus_pipeline.decontaminate, clean + dirty) == sorted(clean, key=str)
    near = text[0].replace("a50 ", "changed ")
    # Copies: two with null ids of one text; a near copy under an id that another text has; null ids beside an id.
    rows = [(None, text[1]), (None, text[1]), (3, text[0]), (5, near), (5, text[2]), (None, text[2]), (6, text[3]), (6, text[3]), (6, text[4])]
    kept = [(None, text[1]), (3, text[0]), (5, text[2]), (6, text[3]), (6, text[4])]
    assert left(corpus_pipeline.drop_near_duplicates, rows) == sorted(kept, key=str)


def test_run(spark, corpus):
    folder, rows = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == ({r[0] for r in rows} - {100, 101, 102, 104, 105, 106})
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= CAPACITY


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
