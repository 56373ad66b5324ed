"""Checks of run tables: summaries, running values, stops, resume and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import statement
from checks.registry import check
from checks.scans import rounded
from checks.splits import PLAN, train_plan
from tuneprep.operators import runlog
from tuneprep.session import new_path
from tuneprep.streaming import progress


@check(
    "g10_epoch_summary",
    statement(
        """select epoch, cast(sum(n) as bigint) as train_batches,
             cast(sum(ceil(n / 4)) as bigint) as optimizer_steps, cast(sum(items) as bigint) as items,
             round(sum(sec), 4) as time_sec, round(sum(items) / greatest(sum(sec), 0.001), 4)
               as items_per_sec,
             round(sum(loss) / sum(n), 4) as train_loss
           from (select epoch, chunk, count(*) as n, sum(n_rows) as items, sum(seconds) as sec,
             sum(loss) as loss from batch_log group by 1, 2) group by 1""",
        "batch_log",
    ),
)
def epoch_summary(spark, folder):
    out = runlog.epoch_summary(fx.batch_log(spark, folder), accumulate=4)
    return out.select(
        *[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
    )


def _answered(spark, folder):
    """Orders as answers of five runs: finished ones are right, pending ones unknown."""
    status = F.col("o_orderstatus")
    return fx.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("run"),
        F.col("o_orderkey").alias("index"),
        F.lit(1).alias("true_id"),
        F.when(status == "F", 1).when(status == "P", -1).otherwise(0).alias("predicted_id"),
        F.when(status == "P", "unknown").otherwise("valid_normalized").alias("status"),
    )


@check(
    "h1_running_accuracy",
    statement(
        """select run, index, n_seen, cast(n_correct as bigint) as n_correct,
             cast(unknown_so_far as bigint) as unknown_so_far,
             round(n_correct / n_seen, 6) as running_accuracy from
             (select o_orderpriority as run, o_orderkey as index, count(*) over w as n_seen,
                count(*) filter (o_orderstatus = 'F') over w as n_correct,
                count(*) filter (o_orderstatus = 'P') over w as unknown_so_far
              from orders window w as (partition by o_orderpriority order by o_orderkey))"""
    ),
)
def running_accuracy(spark, folder):
    out = runlog.running_accuracy(_answered(spark, folder), ["run"], rows_per_bucket=1000)
    return rounded(out.drop("true_id", "predicted_id", "status"))


def _in_chunks(spark, folder):
    """The same answers in five chunks of consecutive indexes."""
    rows = _answered(spark, folder).withColumnsRenamed({"predicted_id": "pred"})
    last = F.max("o_orderkey")
    end = fx.table(spark, folder, "orders").agg(last).first()[0] + 1
    rows = rows.withColumn("chunk", F.floor(F.col("index") * 5 / end).cast("int"))
    rows = rows.withColumnRenamed("pred", "predicted_id")
    return [rows.where(F.col("chunk") == n).drop("chunk") for n in range(5)]


@check(
    "h1_running_accuracy_across_chunks",
    statement(
        """select run, index, n_seen, cast(n_correct as bigint) as n_correct,
             cast(unknown_so_far as bigint) as unknown_so_far,
             round(n_correct / n_seen, 6) as running_accuracy from
             (select o_orderpriority as run, o_orderkey as index, count(*) over w as n_seen,
                count(*) filter (o_orderstatus = 'F') over w as n_correct,
                count(*) filter (o_orderstatus = 'P') over w as unknown_so_far
              from orders window w as (partition by o_orderpriority order by o_orderkey))"""
    ),
)
def running_accuracy_across_chunks(spark, folder):
    """Each chunk is looked at once and goes on from the counters of those before it."""
    path, out = new_path(spark, "progress"), None
    for chunk, rows in enumerate(_in_chunks(spark, folder)):
        found = progress.running_accuracy_of_chunk(rows, path, chunk, ["run"], rows_per_bucket=1000)
        found = rounded(found.drop("true_id", "predicted_id", "status"))
        out = found if out is None else out.unionByName(found)
    return out


@check(
    "g8_counters_across_chunks",
    statement(
        """select chunk, cast(count(*) as bigint) as n_seen, cast(count(*) filter (o_orderstatus = 'F') as bigint) as n_correct,
             cast(count(*) filter (o_orderstatus = 'P') as bigint) as unknown_so_far
           from range(5) c(chunk), (select *, floor(o_orderkey * 5 / (select max(o_orderkey) + 1 from orders)) as own from orders)
           where own <= chunk group by 1"""
    ),
)
def counters_across_chunks(spark, folder):
    """Counters as of each chunk, after all were counted; one of them twice."""
    path, out = new_path(spark, "progress"), None
    for chunk, rows in list(enumerate(_in_chunks(spark, folder))) + [(2, _in_chunks(spark, folder)[2])]:
        progress.add_chunk(rows, path, chunk)
    for chunk in range(5):
        row = progress.counters(spark, path, before=chunk + 1).withColumn("chunk", F.lit(chunk).cast("bigint"))
        out = row if out is None else out.unionByName(row)
    return out


@check(
    "h2_running_loss",
    statement(
        """select epoch, batch, round(avg(loss) over
             (partition by epoch order by batch rows unbounded preceding), 6) as running_loss
           from (select o_orderpriority as epoch, o_orderkey as batch, o_totalprice / 99991 as loss
             from orders)"""
    ),
)
def running_loss(spark, folder):
    batches = fx.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("epoch"),
        F.col("o_orderkey").alias("batch"),
        (F.col("o_totalprice") / 99991).alias("loss"),
    )
    return rounded(runlog.running_loss(batches, rows_per_bucket=1000).drop("loss"))


@check(
    "h3_best_epoch",
    statement(
        """select run_id, epoch as best_epoch, macro_f1 as best_macro_f1 from
             (select *, row_number() over (partition by run_id order by macro_f1 desc, epoch) as place
              from run_log) where place = 1""",
        "run_log",
    ),
)
def best_epoch(spark, folder):
    return runlog.best_epoch(fx.run_log(spark, folder))


STOPS = {
    "marked": """
      select *, macro_f1 > coalesce(max(macro_f1) over (partition by run_id order by epoch
        rows between unbounded preceding and 1 preceding), -1.0) as improved from run_log""",
    "counted": """
      select *, epoch - coalesce(max(case when improved then epoch end) over
        (partition by run_id order by epoch), 0) as no_improve from marked""",
    "stops": "select run_id, min(epoch) as stop from counted where no_improve >= 3 group by 1",
}


@check(
    "h4_early_stop",
    statement(
        """select c.run_id, epoch, macro_f1, improved, cast(no_improve as int) as no_improve,
             coalesce(epoch = stop, false) as stopped
           from counted c left join stops s on c.run_id = s.run_id
           where stop is null or epoch <= stop""",
        "run_log",
        **STOPS,
    ),
)
def early_stop(spark, folder):
    return runlog.early_stop(fx.run_log(spark, folder), patience=3, rows_per_bucket=10)


@check(
    "h5_resume_position",
    statement(
        """select run_id, cast(case when chunk >= 18 then epoch + 1 else greatest(epoch, 1) end as int)
             as start_epoch, cast(case when chunk >= 18 then 1 else chunk + 1 end as int) as start_chunk,
             chunk >= 18 and not validated as needs_validation,
             case when total_chunks <> 18 then 'chunk_total_changed' end as fault
           from (select user_id as run_id, cast(value as int) % 4 as epoch, event_id % 19 as chunk,
               case when event_id % 11 = 0 then 17 else 18 end as total_chunks,
               event_type = 'view' as validated,
               row_number() over (partition by user_id order by ts desc, event_id desc) as place
             from (select * replace (floor(value) as value) from events)) where place = 1"""
    ),
)
def resume_position(spark, folder):
    manifest = fx.table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        (F.floor("value") % 4).cast("int").alias("epoch"),
        (F.col("event_id") % 19).alias("chunk"),
        F.when(F.col("event_id") % 11 == 0, 17).otherwise(18).alias("total_chunks"),
        (F.col("event_type") == "view").alias("validated"),
        "ts",
        "event_id",
    )
    return runlog.resume_position(manifest, 18, order=["ts", "event_id"])


CHUNKS = {
    "plan": PLAN,
    "chunks": """
      select chunk, cast(sum(n_rows) as bigint) as n_rows, cast(ceil(sum(n_rows) / 16) as bigint) as n_batches,
        cast(ceil(ceil(sum(n_rows) / 16) / 3) as bigint) as n_steps from plan group by 1""",
}


def _chunks(spark, folder):
    return train_plan(spark, folder).groupBy("chunk").agg(F.sum("n_rows").alias("n_rows"))


@check("h6_chunk_steps", statement("select * from chunks", "shards", **CHUNKS))
def chunk_steps(spark, folder):
    return runlog.chunk_steps(_chunks(spark, folder), 16, 3)


@check(
    "h6_accumulation_plan",
    statement(
        """select chunk, n_batches, n_steps, case when n_batches % 3 = 0 then 3 else n_batches % 3 end::bigint
             as last_batches, case when n_batches % 3 = 0 then 1.0::double else 3.0::double / (n_batches % 3) end
             as last_scale from chunks where n_batches > 0""",
        "shards",
        **CHUNKS,
    ),
)
def accumulation_plan(spark, folder):
    return runlog.accumulation_plan(_chunks(spark, folder), 16, 3)


BUDGET = """
  select cast(sum(n_steps) as bigint) as steps_per_epoch,
    cast(greatest(1, sum(n_steps) * 3) as bigint) as total_steps,
    cast(floor(greatest(1, sum(n_steps) * 3) * 0.05::double) as bigint) as warmup_steps from chunks"""


@check("h7_step_budget", statement(BUDGET, "shards", **CHUNKS))
def step_budget(spark, folder):
    return runlog.step_budget(_chunks(spark, folder), 16, 3, epochs=3, warmup_ratio=0.05)


@check(
    "h8_lr_schedule",
    statement(
        """select epoch, chunk, min(step) as first_step, max(step) as last_step,
             arg_min(lr, step) as first_lr, arg_max(lr, step) as last_lr from
           (select cast(epoch as int) as epoch, chunk, step, round(0.0001 * case when step < warmup_steps
             then step / greatest(warmup_steps, 1) else greatest(0, (total_steps - step)
               / greatest(total_steps - warmup_steps, 1)) end, 12)::double as lr
           from (select *, (epoch - 1) * steps_per_epoch + cast(before as bigint) + local as step from
             (select *, unnest(range(n_steps)) as local from
               (select *, coalesce(sum(n_steps) over (order by chunk rows between unbounded preceding
                  and 1 preceding), 0) as before, unnest([1, 2, 3]) as epoch from
                  (select * from chunks)), budget))) group by 1, 2""",
        "shards",
        **CHUNKS,
        budget=BUDGET,
    ),
)
def lr_schedule(spark, folder):
    out = runlog.lr_schedule(_chunks(spark, folder), 16, 3, 3, 0.05, 1e-4)
    return out.withColumns({c: F.round(c, 12) for c in ("first_lr", "last_lr")})


@check(
    "a10_run_summary",
    statement(
        """select run_id, epoch as best_epoch, macro_f1 as best_macro_f1,
             (select count(distinct chunk) from plan) as chunks_per_epoch,
             (select count(*) from plan) as training_shards from
             (select *, row_number() over (partition by run_id order by macro_f1 desc, epoch) as place
              from run_log) where place = 1""",
        "run_log",
        "shards",
        plan=PLAN,
    ),
)
def run_summary(spark, folder):
    return runlog.run_summary(fx.run_log(spark, folder), train_plan(spark, folder))
