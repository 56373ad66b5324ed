"""Checks of metrics, losses and the evaluation as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import MATCH_STEPS, METRIC_STEPS, METRICS, normalise, statement, strip
from checks.registry import check
from checks.scans import SCORE_STEPS, SCORED, rounded
from tuneprep.operators.logit_blocks import block_cross_entropy
from tuneprep.operators import losses, metrics, validation
from tuneprep.plans.evaluate import evaluate, score_answers, score_table
from tuneprep.session import materialise

CLASS_STEPS = {
    "scored": "select true_id, pred_id from class_pairs",
    "classes": "select label_id from class_ids",
} | METRIC_STEPS


def _pairs(spark, folder):
    return metrics.confusion(fx.class_pairs(spark, folder))


def _scored(spark, folder):
    return metrics.per_class(_pairs(spark, folder), fx.class_ids(spark, folder))


@check(
    "g1_guard_counts",
    statement(
        """select count(*) as n_rows, count(*) filter (true_id is null or pred_id is null) as n_null,
             count(*) filter (true_id < 0) as n_negative from
             (select case when l_suppkey % 19 = 0 then -1 when l_suppkey % 23 <> 0 then l_linenumber end
                as true_id, case when l_partkey % 17 <> 0 then 1 end as pred_id from lineitem)"""
    ),
)
def guard_counts(spark, folder):
    supplier = F.col("l_suppkey")
    rows = fx.table(spark, folder, "lineitem").select(
        F.when(supplier % 19 == 0, -1).when(supplier % 23 != 0, F.col("l_linenumber")).alias("true_id"),
        F.when(F.col("l_partkey") % 17 != 0, 1).alias("pred_id"),
    )
    return metrics.guard_counts(metrics.confusion(rows))


@check(
    "g2_accuracy",
    statement(
        """select round(avg(case when true_id = pred_id then 1.0 else 0.0 end)::double, 6) as accuracy,
             count(*) as num_samples from class_pairs""",
        "class_pairs",
    ),
)
def accuracy(spark, folder):
    return rounded(metrics.accuracy(_pairs(spark, folder)))


@check(
    "g3_per_class",
    statement(
        """select label_id, support, predicted, correct, round(precision, 6) as precision,
             round(recall, 6) as recall, round(f1, 6) as f1 from rated""",
        "class_pairs",
        "class_ids",
        **CLASS_STEPS,
    ),
)
def per_class(spark, folder):
    return rounded(_scored(spark, folder))


@check(
    "g4_macro",
    statement(
        """select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall,
             round(avg(f1), 6) as macro_f1 from rated""",
        "class_pairs",
        "class_ids",
        **CLASS_STEPS,
    ),
)
def macro(spark, folder):
    return rounded(metrics.macro(_scored(spark, folder)))


@check(
    "g5_micro",
    statement(
        """select round(sum(correct) / sum(predicted), 6) as micro_precision,
             round(sum(correct) / sum(support), 6) as micro_recall,
             round(2 * sum(correct) / (sum(predicted) + sum(support)), 6) as micro_f1 from rated""",
        "class_pairs",
        "class_ids",
        **CLASS_STEPS,
    ),
)
def micro(spark, folder):
    return rounded(metrics.micro(_scored(spark, folder)))


@check(
    "g6_weighted",
    statement(
        """select round(sum(precision * support) / sum(support), 6) as weighted_precision,
             round(sum(recall * support) / sum(support), 6) as weighted_recall,
             round(sum(f1 * support) / sum(support), 6) as weighted_f1 from rated""",
        "class_pairs",
        "class_ids",
        **CLASS_STEPS,
    ),
)
def weighted(spark, folder):
    return rounded(metrics.weighted(_scored(spark, folder)))


@check(
    "g7_default_classes",
    statement("select distinct true_id as label_id from class_pairs where true_id >= 0", "class_pairs"),
)
def default_classes(spark, folder):
    return metrics.class_list(_pairs(spark, folder))


@check(
    "g7_metrics_default_classes",
    statement(
        METRICS,
        "class_pairs",
        scored="select true_id, pred_id from class_pairs",
        classes="select distinct true_id as label_id from class_pairs",
        **METRIC_STEPS,
    ),
)
def metrics_default_classes(spark, folder):
    return rounded(metrics.classification_metrics(materialise(_pairs(spark, folder), "pairs")))


@check(
    "g8_unknown_rate",
    statement(
        """select count(*) as num_samples, count(*) filter (status = 'unknown') as unknown_predictions,
             round(count(*) filter (status = 'unknown') / count(*), 6) as unknown_rate from matched""",
        "answers",
        "vocab",
        **MATCH_STEPS,
    ),
)
def unknown_rate(spark, folder):
    from tuneprep.operators.matching import match_predictions

    matched = match_predictions(fx.answers(spark, folder), fx.vocab(spark, folder), row_key=["k"])
    return rounded(metrics.unknown_rate(matched))


@check("score_answers", statement(METRICS, "answers", "vocab", **SCORE_STEPS, **METRIC_STEPS))
def score_all(spark, folder):
    """Score a table of raw model answers, from text to figures."""
    vocab = materialise(fx.vocab(spark, folder), "vocab")
    return rounded(score_table(fx.answers(spark, folder), vocab))


@check(
    "b11_debug_rows",
    statement(
        """select k, true_label, true_id, raw_output, predicted_label as matched_label, predicted_id,
             status from scored order by k limit 10""",
        "answers",
        "vocab",
        **MATCH_STEPS,
        scored=SCORED,
    ),
)
def debug_rows(spark, folder):
    scored = score_answers(fx.answers(spark, folder), fx.vocab(spark, folder), ["k"])
    return validation.debug_rows(scored, ["k"])


@check(
    "f6_causal_pairs",
    statement(
        """select batch_id, position, next as label from
             (select batch_id, position, lead(label) over (partition by batch_id order by position)
                as next from logits) where next is not null""",
        "logits",
    ),
)
def causal_pairs(spark, folder):
    return losses.causal_pairs(fx.logits(spark, folder), ["batch_id"]).drop("logits")


def _with_labels(spark, folder):
    """Logits whose rows carry the labels of their whole sequence, as a data preparation writes them."""
    tokens = fx.logits(spark, folder)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"])
    labels = tokens.groupBy("batch_id").agg(in_order.alias("labels"))
    return tokens.drop("label").join(labels, "batch_id")


@check(
    "f6_next_labels",
    statement(
        """select batch_id, position, next as label, round(z, 6) as first_logit from
             (select batch_id, position, logits[1]::double as z,
                lead(label) over (partition by batch_id order by position) as next from logits)
           where next is not null""",
        "logits",
    ),
)
def next_labels(spark, folder):
    """The causal shift as a projection; the logits are seen by their first value."""
    pairs = losses.next_labels(_with_labels(spark, folder))
    first = F.round(F.get("logits", F.lit(0)).cast("double"), 6).alias("first_logit")
    return pairs.select("batch_id", "position", "label", first)


LOSS_STEPS = {
    "paired": """
      select batch_id, position, list_transform(logits, lambda x: x::double) as z,
        lead(label) over (partition by batch_id order by position) as label from logits""",
    "priced": """
      select batch_id, position, label, case when label <> -100 then
        list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[label + 1]
        end as loss from paired where label is not null""",
    "per_batch": """
      select batch_id, avg(loss) as batch_loss, count(loss) as target_tokens from priced group by 1""",
}


def _losses(spark, folder):
    pairs = losses.causal_pairs(fx.logits(spark, folder), ["batch_id"])
    return pairs.withColumn("loss", losses.cross_entropy(F.col("logits"), F.col("label")))


@check(
    "f7_cross_entropy",
    statement(
        "select batch_id, position, label, round(loss, 6) as loss from priced", "logits", **LOSS_STEPS
    ),
)
def cross_entropy(spark, folder):
    return rounded(_losses(spark, folder).drop("logits"))


@check(
    "f7_blocks",
    statement(
        """select batch_id, position, label, round(loss, 6) as loss, cast(null as varchar) as fault from priced""",
        "logits",
        **LOSS_STEPS,
    ),
)
def block_losses(spark, folder):
    """The same losses from logits in blocks of 24 classes: no row has all of them."""
    pairs = losses.next_labels(_with_labels(spark, folder))
    starts = F.sequence(F.lit(0), F.size("logits") - 1, F.lit(24))
    blocks = pairs.withColumn("start", F.explode(starts))
    blocks = blocks.withColumn("logits", F.slice("logits", F.col("start") + 1, 24))
    return rounded(block_cross_entropy(blocks, ["batch_id", "position"]))


@check(
    "g9_batch_losses",
    statement(
        """select batch_id, round(batch_loss, 6) as batch_loss, target_tokens,
             cast(null as varchar) as fault from per_batch""",
        "logits",
        **LOSS_STEPS,
    ),
)
def batch_losses(spark, folder):
    return rounded(losses.batch_losses(_losses(spark, folder)))


@check(
    "g9_loss_summary",
    statement(
        """select round(avg(batch_loss), 6) as val_loss,
             round(sum(batch_loss * target_tokens) / sum(target_tokens), 6) as token_loss,
             cast(sum(target_tokens) as bigint) as valid_target_tokens, count(*) as n_batches,
             round(avg(batch_loss + batch_id), 6) as model_reported_val_loss from per_batch""",
        "logits",
        **LOSS_STEPS,
    ),
)
def loss_summary(spark, folder):
    per_batch = losses.batch_losses(_losses(spark, folder))
    reported = per_batch.withColumn("reported", F.col("batch_loss") + F.col("batch_id"))
    return rounded(losses.loss_summary(reported, "reported"))


def stub_model(prefix):
    """A model that repeats the payload, so that SQL can say what it answers."""

    def make():
        def answer(batch):
            return [None if p is None else prefix + p + " " for p in batch["payload"]]

        return answer

    return make


def _samples(spark, folder):
    """Answers as samples: the raw answer is the payload; some labels are bad."""
    key = F.col("l_orderkey")
    return fx.answers(spark, folder).select(
        F.col("k").alias("sample_id"),
        F.when(key % 97 == 0, F.lit(None))
        .when(key % 89 == 0, F.lit("no such disease"))
        .otherwise(F.concat(F.lit(" "), "true_label"))
        .alias("disease"),
        F.lit("leaf").alias("crop"),
        F.lit(None).cast("string").alias("label_id"),
        F.col("raw_output").alias("payload"),
    )


EVALUATED = {
    "asked": f"""
      select k, true_label, {strip("'Prediction: ' || raw_output || ' '")} as raw_output,
        {normalise("'Prediction: ' || raw_output || ' '")} as p
      from answers where l_orderkey % 97 <> 0 and l_orderkey % 89 <> 0""",
}


@check(
    "i1_predict",
    statement(
        f"""select k, {strip("'Prediction: ' || raw_output || ' '")} as raw_output from answers""",
        "answers",
    ),
)
def predict(spark, folder):
    from tuneprep.operators import inference

    rows = fx.answers(spark, folder).select("k", F.col("raw_output").alias("payload"))
    return inference.predict(rows, stub_model("Prediction: "), ["payload"]).drop("payload")


@check(
    "i3_evaluate_predictions",
    statement(
        """select k as sample_id, true_label, true_id, raw_output, predicted_label, predicted_id, status,
             true_id = predicted_id as correct from scored""",
        "answers",
        "vocab",
        **MATCH_STEPS | EVALUATED,
        scored=SCORED,
    ),
)
def evaluate_predictions(spark, folder):
    vocab = materialise(fx.vocab(spark, folder), "vocab")
    result = evaluate(
        _samples(spark, folder), vocab, stub_model("Prediction: "), ["payload"], strict=False
    )
    return result.predictions.drop("normalised")


@check(
    "i3_evaluate_first_n",
    statement(
        """select k as sample_id, true_label, true_id, raw_output, predicted_label, predicted_id, status,
             true_id = predicted_id as correct from scored""",
        "answers",
        "vocab",
        first="select k from answers order by k limit 500",
        asked=EVALUATED["asked"] + " and k in (select k from first)",
        **{name: step for name, step in MATCH_STEPS.items() if name != "asked"},
        scored=SCORED,
    ),
)
def evaluate_first(spark, folder):
    """The first samples are taken before bad ones among them are left out."""
    vocab = materialise(fx.vocab(spark, folder), "vocab")
    result = evaluate(
        _samples(spark, folder), vocab, stub_model("Prediction: "), ["payload"], max_samples=500, strict=False
    )
    return result.predictions.drop("normalised")


@check(
    "f7_target_faults",
    statement(
        """select batch_id, count(*) filter (bad) as n_bad, case when count(*) filter (bad) > 0 then 'bad_target' end as fault
           from (select batch_id, t is null or not (t = -100 or t between 0 and len(logits) - 1) as bad from
             (select *, case when vec_id % 61 = 0 then null when vec_id % 47 = 0 then 64 when vec_id % 43 = 0 then -1
                when vec_id % 5 = 0 then -100 else label end as t from
                (select vec_id, embedding as logits, label, cast(vec_id % 20 as int) as batch_id from embeddings))) group by 1"""
    ),
)
def target_faults(spark, folder):
    """Labels outside the logits, and missing ones, are faults of their batch, not ignored targets."""
    key = F.col("vec_id")
    label = (
        F.when(key % 61 == 0, F.lit(None))
        .when(key % 47 == 0, 64)
        .when(key % 43 == 0, -1)
        .when(key % 5 == 0, -100)
        .otherwise(F.col("label"))
    )
    rows = fx.table(spark, folder, "embeddings").select(
        (key % 20).cast("int").alias("batch_id"), F.col("embedding").alias("logits"), label.alias("label")
    )
    rows = rows.select(
        "batch_id",
        losses.target_fault(F.col("logits"), F.col("label")).alias("bad"),
        losses.cross_entropy(F.col("logits"), F.col("label")).alias("loss"),
    )
    found = losses.batch_losses(rows, fault="bad").select("batch_id", "fault")
    counts = rows.groupBy("batch_id").agg(F.count("bad").alias("n_bad"))
    return found.join(counts, "batch_id")


@check(
    "i3_evaluate_metrics",
    statement(METRICS, "answers", "vocab", **SCORE_STEPS | EVALUATED, **METRIC_STEPS),
)
def evaluate_metrics(spark, folder):
    vocab = materialise(fx.vocab(spark, folder), "vocab")
    result = evaluate(
        _samples(spark, folder), vocab, stub_model("Prediction: "), ["payload"], strict=False
    )
    return rounded(result.metrics)
