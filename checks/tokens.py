"""Checks of conversations, tokens, masks and padded batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import joined, statement, strip, word_ids
from checks.registry import check
from tuneprep.functions import chat, text, tokens
from tuneprep.operators import batches, splits
from tuneprep.plans import prepare

# The prompts, stated again for the oracle.
SYSTEM = (
    "You are an expert plant pathologist AI assistant specializing in agricultural visual diagnosis."
)
ASK = ", identify the crop disease. Respond with only the disease name from the official vocabulary."


def prompt(crop: str) -> str:
    return (
        f"case when {crop} <> '' then 'Given this ' || {crop} || ' crop image{ASK}' "
        f"else 'Given this crop image{ASK}' end"
    )


def asked(crop: str) -> str:
    return (
        f"'<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || "
        f"chr(10) || '<|vision_start|><|image_pad|><|vision_end|>' || {prompt(crop)} || "
        f"'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
    )


def conversation_json(crop: str, answer: str) -> str:
    return f"""'[{{"role":"system","content":[{{"type":"text","text":"{SYSTEM}"}}]}},'
      || '{{"role":"user","content":[{{"type":"image"}},{{"type":"text","text":"' || {prompt(crop)}
      || '"}}]}}' || case when {answer} is null then '' else
      ',{{"role":"assistant","content":[{{"type":"text","text":' || to_json({answer}) || '}}]}}' end
      || ']'"""


CLEAN = {"clean": f"select sample_id, {strip('disease')} as disease, coalesce(crop, '') as crop from samples"}


def _clean(spark, folder):
    return fx.samples(spark, folder).select(
        "sample_id",
        text.strip(F.col("disease")).alias("disease"),
        F.coalesce("crop", F.lit("")).alias("crop"),
        F.lit(0).alias("label_id"),
    )


@check(
    "e5_prompt_text",
    statement(f"select sample_id, {prompt('crop')} as prompt from clean", "samples", **CLEAN),
)
def prompt_text(spark, folder):
    return _clean(spark, folder).select(
        "sample_id", chat.prompt_text(F.col("crop")).alias("prompt")
    )


@check(
    "e6_conversation",
    statement(
        f"select sample_id, {conversation_json('crop', 'disease')} as messages from clean",
        "samples",
        **CLEAN,
    ),
)
def conversation(spark, folder):
    return _clean(spark, folder).select(
        "sample_id",
        F.to_json(chat.conversation(F.col("crop"), F.col("disease"))).alias("messages"),
    )


@check(
    "e6_conversation_turns",
    statement(
        f"""select conv_id, turn, md5({conversation_json('crop', 'disease')}) as messages
            from turns""",
        "turns",
    ),
)
def conversation_turns(spark, folder):
    return fx.turns(spark, folder).select(
        "conv_id",
        "turn",
        F.md5(F.to_json(chat.conversation(F.col("crop"), F.col("disease")))).alias("messages"),
    )


@check(
    "e7_chat_text",
    statement(
        f"""select conv_id, turn, {asked('crop')} as prompt_text,
              md5({asked('crop')} || disease || '<|im_end|>' || chr(10)) as full_text from turns""",
        "turns",
    ),
)
def chat_text(spark, folder):
    crop, answer = F.col("crop"), F.col("disease")
    return fx.turns(spark, folder).select(
        "conv_id",
        "turn",
        chat.render(chat.conversation(crop), open_turn=True).alias("prompt_text"),
        F.md5(chat.render(chat.conversation(crop, answer))).alias("full_text"),
    )


@check(
    "b12_generation_rows",
    statement(
        f"""select conv_id, turn, disease, crop, label_id, {asked('crop')} as prompt_text
            from turns""",
        "turns",
    ),
)
def generation_rows(spark, folder):
    return prepare.generation_rows(fx.turns(spark, folder), keep=["conv_id", "turn"])


EXAMPLES = {
    "texts": f"""
      select *, {asked('crop')} as prompt_text,
        {asked('crop')} || disease || '<|im_end|>' || chr(10) as full_text,
        cast(turn % 5 as int) as visual from turns""",
    "tokenised": f"""
      select *, len({word_ids('prompt_text')}) as prompt_length, {word_ids('full_text')} as text_ids
      from texts""",
    "placed": """
      select *, list_concat(list_resize([]::int[], visual, 7), text_ids) as ids from tokenised""",
    "masked": """
      select *, least(greatest(0, len(ids) - len(text_ids)) + prompt_length, len(ids)) as edge
      from placed""",
    "examples": """
      select *, list_transform(ids, lambda x, i: case when i <= edge then -100 else x end) as labels
      from masked""",
}


def _examples(spark, folder):
    return prepare.training_rows(
        fx.turns(spark, folder), keep=["conv_id", "turn"], image_tokens=F.col("turn") % 5, image_id=7
    )


@check(
    "f1_boundary",
    statement(
        """select conv_id, turn, cast(len(ids) as int) as n_ids, cast(prompt_length as int)
             as prompt_length, cast(edge as int) as boundary from examples""",
        "turns",
        **EXAMPLES,
    ),
)
def boundary(spark, folder):
    return _examples(spark, folder).select(
        "conv_id", "turn", F.size("input_ids").alias("n_ids"), "prompt_length", "boundary"
    )


@check(
    "f2_prompt_mask",
    statement(
        f"select conv_id, turn, md5({joined('labels')}) as labels from examples", "turns", **EXAMPLES
    ),
)
def prompt_mask(spark, folder):
    return _examples(spark, folder).select(
        "conv_id", "turn", F.md5(F.array_join(F.col("labels").cast("array<string>"), " ")).alias("labels")
    )


@check(
    "f3_target_check",
    statement(
        f"""select doc_id, cast(len(ids) - edge as int) as n_targets,
              case when len(ids) <= edge then 'no_target' end as reason from
              (select doc_id, {word_ids('text')} as ids,
                 least(doc_id % 60, len({word_ids('text')})) as edge from documents)"""
    ),
)
def target_check(spark, folder):
    ids = fx.table(spark, folder, "documents").select(
        "doc_id", tokens.word_ids(F.col("text")).alias("ids")
    )
    labels = ids.withColumn(
        "labels", tokens.mask_prompt(F.col("ids"), (F.col("doc_id") % 60).cast("int"))
    )
    return labels.select(
        "doc_id",
        tokens.target_count(F.col("labels")).alias("n_targets"),
        tokens.target_fault(F.col("labels")).alias("reason"),
    )


@check(
    "b12_training_rows",
    statement(
        f"""select conv_id, turn, disease, crop, label_id, md5({joined('ids')}) as input_ids,
              md5({joined('labels')}) as labels, cast(len(ids) as int) as n_attended,
              case when len(ids) <= edge then 'no_target' end as reason from examples""",
        "turns",
        **EXAMPLES,
    ),
)
def training_rows(spark, folder):
    def text_of(name):
        return F.md5(F.array_join(F.col(name).cast("array<string>"), " ")).alias(name)

    return _examples(spark, folder).select(
        "conv_id",
        "turn",
        "disease",
        "crop",
        "label_id",
        text_of("input_ids"),
        text_of("labels"),
        F.size("attention_mask").alias("n_attended"),
        "reason",
    )


COLLATED = {
    "rows": f"""
      select doc_id, {word_ids('text')} as ids, doc_id % 7 as n_prompt, doc_id % 31 = 0 as bad,
        (row_number() over (order by md5('42:0:' || doc_id)) - 1) // 16 as batch_id from documents""",
    "sized": """
      select *, max(len(ids)) over (partition by batch_id) as n,
        bool_and(doc_id % 97 <> 1) over (partition by batch_id) as complete from rows where not bad""",
    "padded": """
      select *, list_concat(list_resize([]::int[], n - len(ids), 3), ids) as input_ids,
        list_concat(list_resize([]::int[], n - len(ids), 0), list_resize([]::int[], len(ids), 1)) as mask,
        case when complete then list_concat(list_resize([]::int[], n - len(ids), -100),
          list_transform(ids, lambda x, i: case when i <= n_prompt then -100 else x end)) end as labels
      from sized""",
}


def _placed(spark, folder):
    documents = fx.table(spark, folder, "documents").select("doc_id", "text")
    return fx.token_rows(splits.assign_batches(splits.shuffled(documents, ["doc_id"]), 16))


@check(
    "f4_left_pad",
    statement(
        f"""select doc_id, batch_id, cast(n as int) as padded_length, cast(n - len(ids) as int) as padding,
              md5({joined('input_ids')}) as input_ids, md5({joined('mask')}) as attention_mask,
              md5({joined('labels')}) as labels from padded""",
        **COLLATED,
    ),
)
def left_pad(spark, folder):
    def text_of(name):
        return F.md5(F.array_join(F.col(name).cast("array<string>"), " ")).alias(name)

    return batches.collate(_placed(spark, folder), pad_id=3).select(
        "doc_id",
        "batch_id",
        "padded_length",
        "padding",
        text_of("input_ids"),
        text_of("attention_mask"),
        text_of("labels"),
    )


@check(
    "f4_padding_waste",
    statement(
        """select batch_id, count(*) as n_rows, cast(max(n) as int) as padded_length,
             cast(sum(n - len(ids)) as bigint) as padding,
             round(sum(n - len(ids)) / sum(n), 6) as waste from sized group by 1""",
        **COLLATED,
    ),
)
def padding_waste(spark, folder):
    waste = batches.padding_waste(batches.collate(_placed(spark, folder), pad_id=3))
    return waste.withColumn("waste", F.round("waste", 6))


@check(
    "f4_empty_batches",
    statement(
        """select batch_id, count(*) as n_rows from
             (select conv_id, turn, case when len(text) < 400 then 'short' end as reason,
                (row_number() over (order by md5('42:0:' || conv_id || chr(31) || turn)) - 1) // 2
                  as batch_id from conversations)
           group by 1 having count(*) filter (reason is null) = 0"""
    ),
)
def empty_batches(spark, folder):
    rows = fx.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.length("text") < 400, F.lit("short")).alias("reason")
    )
    placed = splits.assign_batches(splits.shuffled(rows, ["conv_id", "turn"]), 2)
    return batches.empty_batches(placed)


@check(
    "f5_completion",
    statement(
        f"""select doc_id, cast(len(tail) as int) as n_tokens, md5({joined('tail')}) as tokens from
              (select doc_id, ({word_ids('text')})[(doc_id % 40 + 1):] as tail from documents)"""
    ),
)
def completion(spark, folder):
    tail = fx.table(spark, folder, "documents").select(
        "doc_id",
        tokens.completion(
            tokens.word_ids(F.col("text")), (F.col("doc_id") % 40).cast("int")
        ).alias("tail"),
    )
    return tail.select(
        "doc_id",
        F.size("tail").alias("n_tokens"),
        F.md5(F.array_join(F.col("tail").cast("array<string>"), " ")).alias("tokens"),
    )


@check(
    "f6_shift_pairs",
    statement(
        f"""select doc_id, cast(greatest(len(ids) - 1, 0) as int) as n_pairs,
              md5({joined('ids[:len(ids) - 1]')}) as inputs, md5({joined('ids[2:]')}) as targets
            from (select doc_id, {word_ids('text')} as ids from documents)"""
    ),
)
def shift_pairs(spark, folder):
    ids = fx.table(spark, folder, "documents").select(
        "doc_id", tokens.word_ids(F.col("text")).alias("ids")
    )
    pairs = ids.select("doc_id", tokens.shift_pairs(F.col("ids"), F.col("ids")).alias("p"))
    return pairs.select(
        "doc_id",
        F.size("p").alias("n_pairs"),
        F.md5(F.array_join(F.col("p.value").cast("array<string>"), " ")).alias("inputs"),
        F.md5(F.array_join(F.col("p.label").cast("array<string>"), " ")).alias("targets"),
    )


@check(
    "i2_tokenise",
    statement(
        f"""select conv_id, turn, cast(len(ids) as int) as n_tokens, {joined('ids')} as ids from
              (select conv_id, turn, {word_ids('text')} as ids from conversations)"""
    ),
)
def tokenise(spark, folder):
    ids = fx.table(spark, folder, "conversations").select(
        "conv_id", "turn", tokens.word_ids(F.col("text")).alias("ids")
    )
    return ids.select(
        "conv_id",
        "turn",
        F.size("ids").alias("n_tokens"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
    )


@check(
    "i2_tokenise_plugin",
    statement(
        f"""select conv_id, turn, {joined('ids')} as ids from
              (select conv_id, turn, list_transform(
                 regexp_split_to_array({strip('text')}, '{r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}]"}+'),
                 lambda w: length(w)) as ids from conversations)"""
    ),
)
def tokenise_plugin(spark, folder):
    """A plugged-in tokeniser whose ids are the lengths of the words."""
    from tuneprep.operators import inference

    def make():
        return lambda batch: [[len(w) for w in t.split()] for t in batch]

    rows = fx.table(spark, folder, "conversations")
    return rows.select(
        "conv_id",
        "turn",
        F.array_join(inference.tokenise(F.col("text"), make).cast("array<string>"), " ").alias("ids"),
    )


@check(
    "prepare_training_batches",
    statement(
        f"""select conv_id, turn, batch_id, cast(n as int) as padded_length,
              md5({joined('list_concat(list_resize([]::int[], n - len(ids), 0), ids)')}) as input_ids,
              md5({joined('list_concat(list_resize([]::int[], n - len(ids), -100), labels)')}) as labels
            from (select *, max(len(ids)) over (partition by batch_id) as n from
              (select *, (row_number() over (order by md5('42:1:' || conv_id || chr(31) || turn)) - 1) // 16
                 as batch_id from examples) where len(ids) > edge)""",
        "turns",
        **EXAMPLES,
    ),
)
def training_batches(spark, folder):
    """From turns to padded batches of one epoch."""
    made = prepare.training_batches(
        fx.turns(spark, folder),
        ["conv_id", "turn"],
        batch_size=16,
        pad_id=0,
        epoch=1,
        image_tokens=F.col("turn") % 5,
        image_id=7,
        strict=False,
    )

    def text_of(name):
        return F.md5(F.array_join(F.col(name).cast("array<string>"), " ")).alias(name)

    return made.batches.select(
        "conv_id", "turn", "batch_id", "padded_length", text_of("input_ids"), text_of("labels")
    )


def cut_ids(x: str) -> str:
    return f"({word_ids(x)})[:length({x}) % 200 + 1]"


@check(
    "f4_quarantine",
    statement(
        "select conv_id, turn, 'no_target' as reason from examples where len(ids) <= edge",
        "turns",
        **EXAMPLES
        | {
            "tokenised": f"""
              select *, len({cut_ids('prompt_text')}) as prompt_length, {cut_ids('full_text')} as text_ids
              from texts"""
        },
    ),
)
def left_out(spark, folder):
    """The examples to which a tokeniser that cuts texts leaves no target; strict mode refuses them."""
    made = prepare.training_batches(
        fx.turns(spark, folder),
        ["conv_id", "turn"],
        batch_size=16,
        pad_id=0,
        epoch=1,
        tokenise=lambda text: F.slice(tokens.word_ids(text), 1, F.length(text) % 200 + 1),
        image_tokens=F.col("turn") % 5,
        image_id=7,
        strict=False,
    )
    return made.quarantine.select("conv_id", "turn", "reason")
