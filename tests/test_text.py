import random

from pyspark.sql import functions as F

from tuneprep.functions.text import LEAD_INS, WRAPPERS, first_line, normalise_label, strip


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", expression(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


KNOWN = {
    "Leaf Rust": "leaf_rust",
    "The disease is: Leaf-Rust.": "leaf_rust",
    "the disease isolated": "olated",
    "Answer: the disease is early blight": "early_blight",
    "\r\n  \r  'tar/spot' \nsecond": "tar_spot",
    "Answer:": "answer",
    "answer:answer: rust": "rust",
    "\xa0(Rust)\u3000": "rust",
    "a\\b--c__d": "a_b_c_d",
    "m² été": "m²_été",
    "e\u0301": "e",
    "?!": "",
    "": "",
    "___": "",
}


def test_known_answers(spark):
    assert column(spark, KNOWN, normalise_label) == list(KNOWN.values())


def test_null_is_empty(spark):
    assert column(spark, [None], normalise_label) == [""]


def test_an_answer_comes_back_from_what_is_put_around_it(spark):
    """Texts are built from a known answer, so the answer is known without the rule."""
    rng = random.Random(5)
    # A phrase that begins with another one is never reached, as the shorter one comes first.
    phrases = [p for p in LEAD_INS if not any(p != q and p.startswith(q) for q in LEAD_INS)]
    space = [" ", "  ", "\t", "\xa0", "\u3000"]
    joints = ["-", "/", "\\", " ", "  ", "_", "__", " - ", "\t"]
    noise = ["", "#", "%", "\u0301", "*"]
    texts, answers = [], []
    for _ in range(5000):
        words = rng.choices(["rust", "Leaf", "SPOT", "x", "été", "m²", "9"], k=rng.randint(1, 4))
        body = words[0]
        for word in words[1:]:
            body += rng.choice(joints) + rng.choice(noise) + word + rng.choice(noise)
        for phrase in rng.choices(phrases, k=rng.randint(0, 3)):
            body = rng.choice([phrase, phrase.title(), phrase.upper()]) + rng.choice(space) + body
        body = "".join(rng.choices(WRAPPERS, k=2)) + body + "".join(rng.choices(WRAPPERS, k=2))
        before = "".join(rng.choices(["\n", "\r", " \r\n", "\t\n"], k=rng.randint(0, 2)))
        texts.append(before + rng.choice(space) + body + rng.choice(["", "\nsecond line", "\r", "\r\nthird"]))
        answers.append("_".join(words).lower())
    got = column(spark, texts, normalise_label)
    assert [(t, g, a) for t, g, a in zip(texts, got, answers) if g != a] == []


def test_strip_is_pythons(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 \u3000\u200b.", k=8)) for _ in range(3000)]
    assert column(spark, texts, strip) == [t.strip() for t in texts]
    assert column(spark, texts, first_line) == [
        next((p.strip() for p in t.replace("\r", "\n").split("\n") if p.strip()), "") for t in texts
    ]


def test_normalising_twice_changes_nothing_for_labels(spark):
    labels = ["Leaf Rust", "tar-spot", "Early  Blight (late)", "a/b", "Été 2"]
    once = column(spark, labels, normalise_label)
    assert column(spark, once, normalise_label) == once
