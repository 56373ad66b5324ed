"""Pieces of oracle SQL: statements of the text rules, and assembly of a query."""

from __future__ import annotations

from checks.fixtures import SQL

# Fixed values, as in the rules: whitespace, wrappers, lead-in phrases.
SPACES = "||".join(
    f"chr({n})"
    for n in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239,
              8287, 12288]
)
SPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PHRASES = (
    "the disease is|the disease appears to be|the disease appears as|the disease is:|disease:|"
    "answer:|prediction:|predicted disease:|the answer is"
)


def statement(body: str, *inputs: str, **steps: str) -> str:
    """``body`` after a WITH clause of the named inputs and the given steps."""
    parts = {name: SQL[name] for name in inputs} | steps
    if not parts:
        return body
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in parts.items()) + "\n" + body


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def normalise(x: str) -> str:
    text = strip(f"coalesce({x}, '')")
    lines = f"string_split(replace({text}, chr(13), chr(10)), chr(10))"
    kept = f"list_filter({lines}, lambda s: {strip('s')} <> '')"
    out = strip(f"coalesce(({kept})[1], '')")
    out = f"trim({out}, ' ' || chr(9) || '\"''`.,:;!?()[]{{}}<>')"
    out = strip(f"regexp_replace({out}, '^(?i:(?:{PHRASES}){SPACE_CLASS}*)+', '')")
    out = f"translate({out}, '-/\\', '___')"
    out = f"regexp_replace({out}, '{SPACE_CLASS}+', '_', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
    out = f"regexp_replace({out}, '_+', '_', 'g')"
    return f"lower(trim({out}, '_'))"


def word_ids(x: str) -> str:
    words = f"regexp_split_to_array({strip(x)}, '{SPACE_CLASS}+')"
    ids = f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 7))::int)"
    return f"case when {strip(x)} = '' then []::int[] else {ids} end"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def seeded(seed: str, key: str) -> str:
    return f"md5('{seed}:' || {key})"


# Answers matched to the vocabulary by the rule as stated: a join with OR.
MATCH_STEPS = {
    "forms": f"select label, label_id, {normalise('label')} as norm from vocab",
    "asked": f"select *, {normalise('raw_output')} as p from answers",
    "texts": "select distinct p from asked where p <> ''",
    "ranked": """
      select p, label, label_id, row_number() over (
        partition by p order by case when p = norm then 0 else 1 end, label_id) as place
      from texts join forms on p = norm or starts_with(p, norm || '_') or ends_with(p, '_' || norm)""",
    "matched": """
      select a.*, coalesce(r.label, 'Unknown') as predicted_label,
        coalesce(r.label_id, -1) as predicted_id,
        case when r.p is null then 'unknown' else 'valid_normalized' end as status
      from asked a left join ranked r on a.p = r.p and r.place = 1""",
}

# All metrics of a step ``scored(true_id, pred_id)`` over the step ``classes(label_id)``.
METRIC_STEPS = {
    "per_class": """
      select c.label_id,
        (select count(*) from scored where true_id = c.label_id) as support,
        (select count(*) from scored where pred_id = c.label_id) as predicted,
        (select count(*) from scored where true_id = c.label_id and pred_id = true_id) as correct
      from classes c where c.label_id >= 0""",
    "rated": """
      select *, coalesce(correct / nullif(predicted, 0), 0) as precision,
        coalesce(correct / nullif(support, 0), 0) as recall,
        coalesce(2 * correct / nullif(predicted + support, 0), 0) as f1 from per_class""",
}
METRICS = """
  select round(o.accuracy, 6) as accuracy, o.num_samples, o.unknown_predictions,
    round(o.unknown_rate, 6) as unknown_rate, m.* from
    (select avg(case when true_id = pred_id then 1.0 else 0.0 end)::double as accuracy,
       count(*) as num_samples, count(*) filter (pred_id = -1) as unknown_predictions,
       count(*) filter (pred_id = -1) / count(*) as unknown_rate from scored) o,
    (select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall,
       round(avg(f1), 6) as macro_f1,
       round(sum(correct) / sum(predicted), 6) as micro_precision,
       round(sum(correct) / sum(support), 6) as micro_recall,
       round(2 * sum(correct) / (sum(predicted) + sum(support)), 6) as micro_f1,
       round(sum(precision * support) / sum(support), 6) as weighted_precision,
       round(sum(recall * support) / sum(support), 6) as weighted_recall,
       round(sum(f1 * support) / sum(support), 6) as weighted_f1 from rated) m"""
