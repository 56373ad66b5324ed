"""Run tables: epoch summaries, best epoch, early stop, resume, steps and schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.operators.ordering import ROWS_PER_BUCKET, running

START_F1 = -1.0


def epoch_summary(batches: DataFrame, accumulate: int, by: Sequence[str] = ("epoch",)) -> DataFrame:
    """Batches, optimizer steps, items, items per second and mean loss of an epoch.

    ``batches`` has one row per batch: ``chunk``, ``loss``, ``n_rows`` (measured, so
    a short batch counts what it holds) and ``seconds``. Steps are taken per chunk.
    """
    chunks = batches.groupBy(*by, "chunk").agg(
        F.count(F.lit(1)).alias("_batches"),
        F.sum("n_rows").alias("_rows"),
        F.sum("seconds").alias("_seconds"),
        F.sum("loss").alias("_loss"),
    )
    seconds = F.sum("_seconds")
    return chunks.groupBy(*by).agg(
        F.sum("_batches").alias("train_batches"),
        F.sum(F.ceil(F.col("_batches") / F.lit(accumulate))).alias("optimizer_steps"),
        F.sum("_rows").alias("items"),
        seconds.alias("time_sec"),
        (F.sum("_rows") / F.greatest(seconds, F.lit(0.001))).alias("items_per_sec"),
        (F.sum("_loss") / F.sum("_batches")).alias("train_loss"),
    )


def running_accuracy(
    predictions: DataFrame,
    by: Sequence[str],
    index: str = "index",
    true_col: str = "true_id",
    pred_col: str = "predicted_id",
    status_col: str = "status",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Accuracy and unknown answers up to each prediction of a run."""
    hit = F.when(F.col(true_col) == F.col(pred_col), F.lit(1)).otherwise(F.lit(0))
    unknown = F.when(F.col(status_col) == "unknown", F.lit(1)).otherwise(F.lit(0))
    out = running(
        predictions,
        by,
        index,
        {
            "n_seen": ("sum", F.lit(1)),
            "n_correct": ("sum", hit),
            "unknown_so_far": ("sum", unknown),
        },
        rows_per_bucket=rows_per_bucket,
    )
    return out.withColumn("running_accuracy", F.col("n_correct") / F.col("n_seen"))


def running_loss(
    batches: DataFrame,
    by: Sequence[str] = ("epoch",),
    index: str = "batch",
    loss: str = "loss",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mean loss up to each batch of an epoch."""
    out = running(
        batches,
        by,
        index,
        {"_sum": ("sum", F.col(loss)), "_n": ("sum", F.lit(1))},
        rows_per_bucket=rows_per_bucket,
    )
    return out.withColumn("running_loss", F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def _above(score: Column, bound: Column) -> Column:
    """Greater than the bound; a missing score or NaN is not."""
    return F.coalesce((score > bound) & ~F.isnan(score), F.lit(False))


def best_epoch(
    log: DataFrame, by: Sequence[str] = ("run_id",), score: str = "macro_f1", start: float = START_F1
) -> DataFrame:
    """The first epoch with the highest score above ``start``; -1 if there is none."""
    better = F.when(
        _above(F.col(score), F.lit(start)),
        F.struct(F.col(score).alias("score"), (-F.col("epoch")).alias("early")),
    )
    top = F.max(better)
    return log.groupBy(*by).agg(
        F.coalesce(-top["early"], F.lit(-1)).cast("int").alias("best_epoch"),
        F.coalesce(top["score"], F.lit(start)).alias("best_macro_f1"),
    )


def early_stop(
    log: DataFrame,
    patience: int,
    by: Sequence[str] = ("run_id",),
    score: str = "macro_f1",
    start: float = START_F1,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mark improvements, count epochs without one, and drop what follows the stop.

    ``epoch`` counts from 1 without gaps. The epoch at which ``no_improve`` reaches
    ``patience`` is the last one kept and has ``stopped`` set.
    """
    # The last improvement before or at an epoch is the first epoch with the highest
    # score so far, so one running maximum gives both.
    candidate = F.when(
        _above(F.col(score), F.lit(start)),
        F.struct(F.col(score).alias("score"), (-F.col("epoch")).alias("early")),
    )
    best = running(log, by, "epoch", {"_best": ("max", candidate)}, rows_per_bucket=rows_per_bucket)
    since = F.col("epoch") - F.coalesce(-F.col("_best.early"), F.lit(0))
    counted = best.withColumn("no_improve", since.cast("int")).drop("_best")
    over = F.when(F.col("no_improve") >= patience, F.lit(1)).otherwise(F.lit(0))
    marked = running(
        counted, by, "epoch", {"_over": ("max", over)}, inclusive=False,
        rows_per_bucket=rows_per_bucket,
    )
    return (
        marked.where(F.coalesce("_over", F.lit(0)) == 0)
        .withColumn("improved", F.col("no_improve") == 0)
        .withColumn("stopped", F.col("no_improve") >= patience)
        .drop("_over")
    )


def resume_position(
    manifest: DataFrame,
    total_chunks: int,
    by: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("written_at",),
) -> DataFrame:
    """Where a run goes on: the chunk after the last one recorded, or the next epoch.

    ``fault`` is ``chunk_total_changed`` if the run was made with another plan.
    ``needs_validation`` is set where all chunks of the epoch are done but its
    validation was not recorded.
    """
    last = F.max_by(
        F.struct("epoch", "chunk", "total_chunks", "validated"), F.struct(*order)
    ).alias("p")
    done = F.col("p.chunk") >= total_chunks
    return (
        manifest.groupBy(*by)
        .agg(last)
        .select(
            *by,
            F.when(done, F.col("p.epoch") + 1)
            .otherwise(F.greatest(F.col("p.epoch"), F.lit(1)))
            .cast("int")
            .alias("start_epoch"),
            F.when(done, F.lit(1)).otherwise(F.col("p.chunk") + 1).cast("int").alias("start_chunk"),
            (done & ~F.col("p.validated")).alias("needs_validation"),
            F.when(F.col("p.total_chunks") != total_chunks, F.lit("chunk_total_changed")).alias(
                "fault"
            ),
        )
    )


def chunk_steps(chunks: DataFrame, batch_size: int, accumulate: int) -> DataFrame:
    """Batches and optimizer steps of each chunk from its measured rows (``n_rows``)."""
    batches = F.ceil(F.col("n_rows") / F.lit(batch_size))
    return chunks.withColumn("n_batches", batches).withColumn(
        "n_steps", F.ceil(F.col("n_batches") / F.lit(accumulate))
    )


def accumulation_plan(chunks: DataFrame, batch_size: int, accumulate: int) -> DataFrame:
    """Per chunk: its batches and steps, and the batches and gradient scale of its last step.

    A step ends every ``accumulate`` batches and at the end of a chunk; a short last
    group is scaled up. All other steps have ``accumulate`` batches and scale 1.
    """
    sized = chunk_steps(chunks, batch_size, accumulate).where(F.col("n_batches") > 0)
    last = F.col("n_batches") - (F.col("n_steps") - 1) * accumulate
    return sized.select(
        "chunk",
        "n_batches",
        "n_steps",
        last.alias("last_batches"),
        (F.lit(float(accumulate)) / last).alias("last_scale"),
    )


def step_budget(
    chunks: DataFrame,
    batch_size: int,
    accumulate: int,
    epochs: int,
    warmup_ratio: float,
    estimate: int | None = None,
) -> DataFrame:
    """Optimizer steps of the whole run, at least 1, and how many of them warm up.

    Chunks that were not measured (null ``n_rows``) count ``estimate`` rows; without
    an estimate they are an error, as the sum would leave them out.
    """
    known = chunks if estimate is None else chunks.withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(estimate))
    )
    unmeasured = F.raise_error(F.lit("chunks without a row count need an estimate"))
    per_epoch = F.when(F.count_if(F.col("n_rows").isNull()) > 0, unmeasured.cast("bigint")).otherwise(
        F.coalesce(F.sum("n_steps"), F.lit(0))
    )
    return (
        chunk_steps(known, batch_size, accumulate)
        .agg(per_epoch.cast("bigint").alias("steps_per_epoch"))
        .withColumn("total_steps", F.greatest(F.lit(1), F.col("steps_per_epoch") * epochs).cast("bigint"))
        .withColumn(
            "warmup_steps", F.floor(F.col("total_steps") * F.lit(float(warmup_ratio))).cast("bigint")
        )
    )


def lr_schedule(
    chunks: DataFrame,
    batch_size: int,
    accumulate: int,
    epochs: int,
    warmup_ratio: float,
    rate: float,
) -> DataFrame:
    """First and last step of each chunk of each epoch, and the learning rate at both.

    The rate rises linearly to ``rate`` during the warm-up, then falls linearly to 0.
    """
    sized = chunk_steps(chunks, batch_size, accumulate)
    # One row per chunk file group: the window runs over the plan, not over data.
    before = F.coalesce(
        F.sum("n_steps").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    budget = step_budget(chunks, batch_size, accumulate, epochs, warmup_ratio)
    total = budget.select("total_steps").scalar()
    warmup = budget.select("warmup_steps").scalar()
    per_epoch = budget.select("steps_per_epoch").scalar()

    def at(step: Column) -> Column:
        rising = step / F.greatest(warmup, F.lit(1))
        falling = F.greatest(F.lit(0.0), (total - step) / F.greatest(total - warmup, F.lit(1)))
        return F.lit(float(rate)) * F.when(step < warmup, rising).otherwise(falling)

    return (
        sized.withColumn("_before", before)
        .where(F.col("n_steps") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("first_step", (F.col("epoch") - 1) * per_epoch + F.col("_before"))
        .withColumn("last_step", F.col("first_step") + F.col("n_steps") - 1)
        .select(
            "epoch",
            "chunk",
            "first_step",
            "last_step",
            at(F.col("first_step")).alias("first_lr"),
            at(F.col("last_step")).alias("last_lr"),
        )
    )


def epoch_rows(
    summary: DataFrame, metrics: DataFrame, by: Sequence[str] = ("run_id", "epoch")
) -> DataFrame:
    """The rows of the run log: the training summary of each epoch with its validation metrics.

    An epoch that was not validated keeps its row, with null metrics.
    """
    return summary.join(metrics, list(by), "left")


def run_summary(
    log: DataFrame,
    plan: DataFrame,
    by: Sequence[str] = ("run_id",),
    shards: DataFrame | None = None,
    mode: str | None = None,
    test_metrics: DataFrame | None = None,
) -> DataFrame:
    """Best epoch and score of each run, with the chunk and shard counts of the plan.

    ``shards`` (``split``, ``shard_id``) adds the shard lists of the splits ``train``,
    ``val`` and ``test``, ``mode`` a column of that name, and ``test_metrics`` (keyed by
    ``by``) the figures of the final test as ``test_`` columns. Shard lists are lists of files.
    """
    shape = plan.agg(
        F.count(F.lit(1)).alias("n_shards"), F.count_distinct("chunk").alias("chunks_per_epoch")
    )
    out = best_epoch(log, by).select(
        "*",
        shape.select("chunks_per_epoch").scalar().alias("chunks_per_epoch"),
        shape.select("n_shards").scalar().alias("training_shards"),
    )
    if shards is not None:
        for name in ("train", "val", "test"):
            listed = shards.where(F.col("split") == name).agg(
                F.array_sort(F.collect_list("shard_id")).alias("s")
            )
            out = out.withColumn(f"{name}_shards", listed.scalar())
    if mode is not None:
        out = out.withColumn("mode", F.lit(mode))
    if test_metrics is not None:
        figures = {c: f"test_{c}" for c in test_metrics.columns if c not in by}
        out = out.join(test_metrics.withColumnsRenamed(figures), list(by), "left")
    return out
