"""Models and tokenisers as plug-ins that run next to the data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# make() loads a model, once per Python worker; the result maps a batch to answers.
Predict = Callable[[pd.DataFrame], Sequence[str]]


def predict(
    df: DataFrame,
    make: Callable[[], Predict],
    inputs: Sequence[str],
    output: str = "raw_output",
    batch_size: int = 64,
) -> DataFrame:
    """Add the model's answer to every row.

    The inputs are what the model may see; leave the answer out of them. Rows
    reach the model in batches of at most ``batch_size``, cut from what Spark sends at a time: rows
    of at most ``spark.sql.execution.arrow.maxBytesPerBatch`` bytes (64 MiB unless set otherwise), so
    rows with large images come in fewer at a time. ``sources.images.with_bytes`` joins images
    by path just before. The answer is stripped; a bound of its length is the model's own matter. The model is loaded once per Python worker
    and kept for the tasks that the worker runs after the first.
    """
    plug_in = uuid.uuid4()

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = ModelCache.get(plug_in)
        if model is None:
            model = make()
            ModelCache.add(plug_in, model)
        for batch in batches:
            answers: list[str] = []
            for start in range(0, len(batch), batch_size):
                answers.extend(model(batch.iloc[start : start + batch_size]))
            yield pd.Series(answers, dtype="object").map(lambda a: "" if a is None else str(a).strip())

    return df.withColumn(output, answer(F.struct(*inputs)))


def tokenise(text: Column, make: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Token ids from a plugged-in tokeniser, loaded once per Python worker."""
    plug_in = uuid.uuid4()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokeniser = ModelCache.get(plug_in)
        if tokeniser is None:
            tokeniser = make()
            ModelCache.add(plug_in, tokeniser)
        for batch in batches:
            yield pd.Series(tokeniser(batch.tolist()), index=batch.index, dtype="object")

    return ids(text)
