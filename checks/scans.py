"""Checks of shard scans, column mapping and files."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import MATCH_STEPS, METRIC_STEPS, METRICS, statement, strip
from checks.registry import check
from tuneprep.operators import metrics, splits
from tuneprep.operators.runlog import resume_position
from tuneprep.operators.vocab import distinct_labels
from tuneprep.plans.evaluate import score_answers, score_table
from tuneprep.session import new_path
from tuneprep.sources import shards, sinks, vocab_increments
from tuneprep.streaming import ingest
from tuneprep.streaming.buffer import ShuffleBuffer


@check(
    "a1_scan_shards",
    statement(
        """select *, 'part.parquet' as shard_file, p_partkey as shard_row, p_partkey as index
           from part"""
    ),
)
def scan_shards(spark, folder):
    path = f"{folder}/part.parquet"
    return shards.with_index(shards.scan_shards(spark, path), shards.file_rows(spark, path))


@check(
    "a1_index_manifest",
    statement(
        """select sample_id, shard_id, index from
             (select sample_id, shard_id, row_number() over (order by shard_id, sample_id) - 1 as index
              from (select p_partkey as sample_id, cast(p_partkey % 48 as int) as shard_id from part))
           where shard_id % 5 = 2 and sample_id % 3 <> 0"""
    ),
)
def index_manifest(spark, folder):
    """Files added in two parts; filtered rows keep the numbers that all rows give them."""
    path, run = new_path(spark, "numbered"), new_path(spark, "manifest")
    rows = fx.table(spark, folder, "part").select(
        F.col("p_partkey").alias("sample_id"), (F.col("p_partkey") % 48).cast("int").alias("shard")
    )
    # Numbers with leading zeros, so that names are in the order of the shards.
    rows = rows.withColumn("shard_id", F.format_string("%02d", "shard")).drop("shard")
    rows = rows.repartition(4, "shard_id").sortWithinPartitions("shard_id", "sample_id")
    for part in (F.col("shard_id") >= "20", F.col("shard_id") < "20"):
        rows.where(part).write.mode("append").partitionBy("shard_id").parquet(path)
        files = shards.index_manifest(spark, path, run)
    scan = shards.scan_shards(spark, path, "sample_id bigint, shard_id int")
    wanted = scan.where((F.col("shard_id") % 5 == 2) & (F.col("sample_id") % 3 != 0))
    return shards.with_index(wanted, files).select("sample_id", "shard_id", "index")


@check(
    "k2_shards_of_a_split",
    statement(
        """select sample_id, shard_id from (select p_partkey as sample_id, cast(p_partkey % 48 as int) as shard_id
             from part) where shard_id between 36 and 41"""
    ),
)
def shards_of_a_split(spark, folder):
    """The validation shards by number; files of other shards are not opened."""
    path = _shard_folder(spark, folder)
    plan = ingest.shard_plan(spark, path, pattern=PATTERN).withColumn(
        "split", splits.shard_split(F.col("shard_id"))
    )
    paths = [r["path"] for r in plan.where("split = 'val'").select("path").collect()]
    rows = shards.read_shards(spark, path, paths, "sample_id bigint, disease string")
    number = shards.shard_number(F.col("shard_file"), PATTERN)
    return rows.select("sample_id", number.alias("shard_id"))


@check(
    "a1_union_by_name",
    statement(
        """select p_partkey, case when p_partkey % 2 = 0 then p_name end as p_name,
             case when p_partkey % 2 = 1 then p_type end as p_type from part"""
    ),
)
def union_by_name(spark, folder):
    """Two kinds of shards in one folder, each without a column of the other."""
    path = new_path(spark, "mixed")
    part = fx.table(spark, folder, "part")
    even = F.col("p_partkey") % 2 == 0
    part.where(even).select("p_partkey", "p_name").write.parquet(path)
    part.where(~even).select("p_partkey", "p_type").write.mode("append").parquet(path)
    return shards.scan_shards(spark, path).select("p_partkey", "p_name", "p_type")


@check("a2_required_columns", statement("select p_partkey, p_name from part"))
def required_columns(spark, folder):
    part = fx.table(spark, folder, "part")
    try:
        shards.check_columns(part, ["p_name", "no_such_column"])
    except KeyError:
        return shards.check_columns(part, ["p_partkey", "p_name"]).select("p_partkey", "p_name")
    raise AssertionError("a missing column was not noticed")


@check(
    "a3_map_columns",
    statement(
        """select p_partkey as sample_id, p_brand as image, p_name as disease, p_type as crop,
             cast(null as varchar) as label_id from part"""
    ),
)
def map_columns(spark, folder):
    part = fx.table(spark, folder, "part").withColumnRenamed("p_partkey", "sample_id")
    return shards.map_columns(part, "p_brand", "p_name", "p_type", "", keep=["sample_id"])


@check(
    "a4_label_scan",
    statement(
        f"""select label, count(*) as n_rows from
              (select {strip('disease')} as label from samples) where label <> '' group by 1""",
        "samples",
    ),
)
def label_scan(spark, folder):
    from tuneprep.operators.vocab import label_column

    return (
        label_column(fx.samples(spark, folder), "disease")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@check(
    "a5_shard_audit",
    statement(
        """with files as (
             select cast(p_partkey % 5003 as int) as shard_id, p_partkey % 7 = 0 as tmp,
               cast(floor(p_retailprice) as bigint) as length from part where p_partkey % 11 <> 0),
           present as (
             select shard_id, max(case when not tmp then length end) as length, bool_or(tmp) as tmp
             from files group by 1)
           select coalesce(shard_id, cast(s as int)) as shard_id, length,
             case when s is null then 'stale' when length > 1000 then 'ok' when length is not null
               then 'too_small' when tmp then 'unfinished' else 'missing' end as state
           from range(150) r(s) full join present on shard_id = s"""
    ),
)
def shard_audit(spark, folder):
    """Parts stand for a listing: finished, unfinished and stale files, and gaps."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("train-"), F.lpad((key % 5003).cast("string"), 5, "0"), F.lit(".parquet"))
    listing = fx.table(spark, folder, "part").where(key % 11 != 0).select(
        F.when(key % 7 == 0, F.concat(name, F.lit(".tmp"))).otherwise(name).alias("file"),
        F.floor("p_retailprice").alias("length"),
    )
    return shards.audit_listing(listing, 150)


@check(
    "a6_bounded_read",
    statement("select * from orders order by md5('42:' || o_orderkey) limit 1000"),
)
def bounded_read(spark, folder):
    return splits.take_seeded(fx.table(spark, folder, "orders"), ["o_orderkey"], 1000)


def _buffer_steps(chunks, size):
    """SQL of a buffer of ``size`` rows over chunks 0 to chunks - 1, and of its emptying."""
    steps, pools = {}, []
    for k in range(chunks + 1):
        held = f"select sample_id from pool_{k - 1} where place > leaving" if k else "select sample_id from branded where false"
        new = f" union all select sample_id from branded where chunk = {k}" if k < chunks else ""
        steps[f"pool_{k}"] = f"""
          select sample_id, row_number() over (order by md5('42:{k}:' || sample_id)) as place,
            greatest(0, count(*) over () - {size if k < chunks else 0}) as leaving from ({held}{new})"""
        before = " + ".join([f"coalesce((select max(leaving) from pool_{i}), 0)" for i in range(k)] or ["0"])
        pools.append(f"select sample_id, place - 1 + {before} as position from pool_{k} where place <= leaving")
    return steps | {"left_all": " union all ".join(pools)}


@check(
    "a6_stream_buffer",
    statement("select sample_id, position from left_all where position < 1500", "branded", **_buffer_steps(6, 100)),
)
def stream_buffer(spark, folder):
    """A buffer of 100 rows over a stream of chunks, killed once: the first 1,500 rows that leave it."""
    work = _killed_at(2)
    buffer = ShuffleBuffer(spark, new_path(spark, "buffer"), ["sample_id"], 100, 42, 1500)

    def put(rows, vocab, position):
        buffer.push(rows.select("sample_id"), position)
        work(position)

    _until(_run(spark, _shard_folder(spark, folder), work=put), 2)
    buffer.flush()
    return buffer.left()


SCORED = """
  select m.*, v.label_id as true_id from matched m left join vocab v on m.true_label = v.label"""


@check(
    "a7_prediction_file",
    statement(
        """select l_orderkey as index, true_label, true_id, predicted_label, predicted_id, status,
             true_id = predicted_id as correct, raw_output as raw_model_output from scored""",
        "answers",
        "vocab",
        **MATCH_STEPS,
        scored=SCORED,
    ),
)
def prediction_file(spark, folder):
    path = new_path(spark, "predictions")
    scored = score_answers(fx.answers(spark, folder), fx.vocab(spark, folder), ["k"])
    sinks.write_predictions(sinks.prediction_rows(scored, F.col("l_orderkey")), path)
    return sinks.read_predictions(spark, path)


SCORE_STEPS = MATCH_STEPS | {
    "scored": """
      select v.label_id as true_id, m.predicted_id as pred_id
      from matched m left join vocab v on m.true_label = v.label""",
    "classes": "select label_id from vocab",
}


def rounded(df):
    """Figures to six digits, as the oracle gives them."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@check("a8_metrics_file", statement(METRICS, "answers", "vocab", **SCORE_STEPS, **METRIC_STEPS))
def metrics_file(spark, folder):
    path = new_path(spark, "metrics")
    scored = score_table(fx.answers(spark, folder), fx.vocab(spark, folder))
    sinks.write_metrics(scored, path)
    return rounded(spark.read.schema(scored.schema).json(path))


@check(
    "a9_run_log",
    statement("select event_type as run_id, event_id as epoch, value as train_loss from events"),
)
def run_log_file(spark, folder):
    """A run interrupted half-way: the second part is appended to the first."""
    path = new_path(spark, "run-log")
    rows = fx.table(spark, folder, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("train_loss"),
    )
    early = F.col("epoch") % 2 == 0
    sinks.append_run_log(rows.where(early), path)
    sinks.append_run_log(rows.where(~early), path)
    return sinks.read_run_log(spark, path, "run_id string, epoch bigint, train_loss double")


PATTERN = r"shard_id=(\d+)/"
SAMPLES = "sample_id bigint, disease string"
CHUNK_ORDER_IDS = """
  select label, cast(row_number() over (order by chunk, label) - 1 as int) as label_id from
    (select disease as label, min(chunk) as chunk from branded group by 1)"""


def _shard_folder(spark, folder):
    """48 shards, a folder each; the later a shard stands in the plan, the older are its files."""
    path = new_path(spark, "shards")
    shard = (F.col("sample_id") % 48).cast("int")
    rows = fx.branded(spark, folder).drop("chunk").withColumn("shard_id", shard).repartition(4, "shard_id")
    for first in (32, 16, 0):
        part = rows.where(F.col("shard_id").between(first, first + 15))
        part.write.mode("append").partitionBy("shard_id").parquet(path)
    return path


def _run(spark, source, chunk_size=8, **options):
    plan = ingest.shard_plan(spark, source, chunk_size, pattern=PATTERN)
    return ingest.Run(spark, plan, source, SAMPLES, new_path(spark, "run"), **options)


class Killed(RuntimeError):
    pass


def _killed_at(*places):
    """A function that fails the first time it is called for each of some numbers."""
    left = set(places)

    def work(number):
        if number in left:
            left.remove(number)
            raise Killed(f"at {number}")

    return work


def _until(run, attempts):
    """Start a run again as often as it is killed."""
    for _ in range(attempts):
        try:
            run.finish()
        except StreamingQueryException as error:
            if "Killed" not in str(error):
                raise
    return run


@check("j1_rolling_ingest", statement(CHUNK_ORDER_IDS, "branded"))
def rolling_ingest(spark, folder):
    """Ids follow the chunk plan although the files were written in the opposite order."""
    run = _run(spark, _shard_folder(spark, folder))
    run.finish()
    return run.vocab()


@check("j2_chunk_order_ids", statement(CHUNK_ORDER_IDS, "branded"))
def chunk_order_ids(spark, folder):
    """Chunk after chunk, each adding a segment of new labels: ids as in one pass over the chunk plan."""
    run = new_path(spark, "increments")
    rows = fx.branded(spark, folder)
    for chunk in range(6):
        ingest.grow_vocab(distinct_labels(rows.where(F.col("chunk") == chunk), "disease"), run, chunk)
    return vocab_increments.load(spark, run)


@check(
    "j2_versions",
    statement(
        """select chunk, cast(count(*) filter (first <= chunk) as bigint) as n_labels,
             cast(count(*) filter (first = chunk) as bigint) as n_added
           from range(6) c(chunk), (select disease, min(chunk) as first from branded group by 1) group by 1""",
        "branded",
    ),
)
def versions(spark, folder):
    """The vocabulary as of each chunk, from the segments, after all were written."""
    run = new_path(spark, "increments")
    rows = fx.branded(spark, folder)
    for chunk in range(6):
        ingest.grow_vocab(distinct_labels(rows.where(F.col("chunk") == chunk), "disease"), run, chunk)
    out, before = None, F.lit(0)
    for chunk in range(6):
        known = vocab_increments.load(spark, run, before=chunk + 1)
        size = known.agg(F.count(F.lit(1)).alias("n_labels"))
        row = size.select(F.lit(chunk).cast("bigint").alias("chunk"), "n_labels", (F.col("n_labels") - before).alias("n_added"))
        before = F.lit(sum(s.rows for s in vocab_increments.segments(spark, run, chunk + 1)))
        out = row if out is None else out.unionByName(row)
    return out


@check(
    "j3_resume_ingest",
    statement(
        """select epoch, cast(chunk + 1 as int) as chunk, 6 as total_chunks, true as validated, n_rows, n_labels, n_shards
           from (select 1 as epoch union all select 2), (select chunk, count(*) as n_rows,
             count(distinct disease) as n_labels, cast(count(distinct sample_id % 48) as int) as n_shards
             from branded group by 1)
           where chunk = 5
           union all select epoch, cast(chunk + 1 as int), 6, false, n_rows, n_labels, n_shards
           from (select 1 as epoch union all select 2), (select chunk, count(*) as n_rows,
             count(distinct disease) as n_labels, cast(count(distinct sample_id % 48) as int) as n_shards
             from branded group by 1)
           where chunk < 5""",
        "branded",
    ),
)
def resume_ingest(spark, folder):
    """Killed in two chunks and in a validation: each chunk is done once, each epoch is validated."""
    work, validate = _killed_at(1, 7), _killed_at(1)
    run = _run(
        spark,
        _shard_folder(spark, folder),
        epochs=2,
        work=lambda rows, vocab, position: work(position),
        validate=lambda epoch, vocab: validate(epoch),
    )
    log = _until(run, 4).log()
    counts = F.max(F.struct("n_rows", "n_labels", F.size("shards").alias("n_shards"))).alias("c")
    done = log.where("not validated").groupBy("epoch", "chunk", "total_chunks").agg(counts)
    marked = log.where("validated").select("epoch", "chunk", "validated")
    return done.join(marked, ["epoch", "chunk"], "left").select(
        "epoch", "chunk", "total_chunks", F.coalesce("validated", F.lit(False)).alias("validated"), "c.*"
    )


@check(
    "h5_resume_from_log",
    statement(
        """select unnest(['cut', 'unvalidated', 'done']) as run_id, unnest([1, 2, 2]) as start_epoch,
             unnest([n - 1, 1, 1])::int as start_chunk, unnest([false, true, false]) as needs_validation,
             cast(null as varchar) as fault from (select count(distinct chunk // 2) as n from branded)""",
        "branded",
    ),
)
def resume_from_log(spark, folder):
    """Positions of three runs from what ingestion wrote: killed in a chunk, in the validation, and finished."""
    source, out = _shard_folder(spark, folder), None
    for run_id, position, epoch in (("cut", 1, 0), ("unvalidated", -1, 1), ("done", -1, 0)):
        work, validate = _killed_at(position), _killed_at(epoch)
        run = _run(
            spark,
            source,
            16,
            run_id=run_id,
            work=lambda rows, vocab, at, work=work: work(at),
            validate=lambda at, vocab, validate=validate: validate(at),
        )
        log = _until(run, 1).log()
        out = log if out is None else out.unionByName(log)
    return resume_position(out, 3, order=["entry"])
