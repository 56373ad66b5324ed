"""op11: periodic runs of words in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.binding import let
from tuneprep.llm.registry import query, table
from tuneprep.llm.runs import runs

WORD = r"([^\x20\x09-\x0D]+)"


def planted(text: Column, doc_id: Column) -> Column:
    """The text; for a tenth of the ids one whose words repeat from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))

        def places(ap: Column) -> Column:
            place = lambda i: F.when(i < ap["a"], i).otherwise(ap["a"] + F.pmod(i - ap["a"], ap["p"]))
            return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), places)).otherwise(text)

    return F.when(F.pmod(h, F.lit(10)) == 0, let(F.regexp_extract_all(text, F.lit(WORD)), repeat)).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    greater = lambda one, two: one["length"] * two["period"] > two["length"] * one["period"]
    # In order of start and period the first of equal exponents stays.
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(greater(r, best), r).otherwise(best))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    found = runs(documents).withColumn("most", most)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
