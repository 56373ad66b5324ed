"""URL filters: rules on host and path, and trust that flows along links for the rest.

A url that a rule fits has the verdict of the longest one. For the others the hosts'
link graph decides: personalised PageRank carries trust from hosts with allowed pages
along links, and distrust from hosts with blocked pages against them, so that a host
is distrusted for linking to blocked ones. A host whose distrust exceeds its trust by
the margin is blocked, else allowed.

Defined cases. A null url, or one without ``://``, has an empty host and path; no
rule fits and, as it is no node of the graph, it is allowed. Links of a host to
itself, and null pages, add nothing. Repeated pages count each time. Trust that
reaches a host without links to others ends there. Propagation ends when all that is
still to come is at most a tolerance of the trust and of the distrust. A ``//`` alone, as in a
comment of a script, is no link. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.operators.joins import fits_broadcast, lookup_join, salted_join
from tuneprep.session import materialise

ALLOW, BLOCK = "allow", "block"
# Host and path of each rule, and its verdict.
RULES = [
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
]
DAMPING = 0.85
# The part of all trust, and of all distrust, that may still be on its way at the end.
TOLERANCE = 1e-3
# How many steps of the propagation one table is written for.
STEPS_PER_TABLE = 6
MARGIN = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"://([^/?#]*)"
_PATH = r"://[^/?#]*([^?#]*)"
# Places that name another host: urls, links without a scheme in attributes, and host names in running text.
_NAME = "[A-Za-z0-9.-]*[A-Za-z0-9]"
_LINK = rf"(?:\b[Hh][Tt][Tt][Pp][Ss]?:|\b(?:[Hh][Rr][Ee][Ff]|[Ss][Rr][Cc])[ \t\r\n]*=[ \t\r\n]*[\"']?[ \t\r\n]*)//[A-Za-z0-9]{_NAME}|\b[Ww][Ww][Ww]\.{_NAME}"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty if it has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _HOST, 1), _UPPER, _LOWER), F.regexp_extract(url, _PATH, 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, judged in reversed(ordered):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, weight): how often the pages (host, html) of a host name another host."""
    names = F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda x: F.translate(F.regexp_replace(x, "(?s)^.*//", ""), _UPPER, _LOWER))
    links = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(names).alias("target"))
    return links.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of all hosts that trust or distrust reaches.

    links: source, target, weight; seeds: host, trust, distrust, each of which sums up to 1 or 0.
    Each step moves on what arrived in the step before. The links of a hub are spread over
    tasks: the moving table, one row per host, is broadcast if all hosts are measured to fit, else joined with salts.
    """
    out = links.groupBy("source").agg(F.sum("weight").alias("all_out"))
    into = links.groupBy("target").agg(F.sum("weight").alias("all_into"))
    flows = lookup_join(lookup_join(links, out, "source", "inner", ["target"]), into, "target", "inner", ["source"])
    flows = materialise(
        flows.select(F.col("source").alias("host"), F.col("target").alias("to"), F.lit(True).alias("good"), (F.col("weight") / F.col("all_out") * damping).alias("share")).unionByName(
            flows.select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(False).alias("good"), (F.col("weight") / F.col("all_into") * damping).alias("share"))
        ),
        "flows",
    )
    edges = materialise(flows.groupBy("host").agg(F.count(F.lit(1)).alias("_rows")), "edges")
    # More hosts than those with links never move anything on.
    few = fits_broadcast(edges)

    def moved(state: DataFrame) -> DataFrame:
        moving = state.where("new_trust > 0 or new_distrust > 0").select("host", "new_trust", "new_distrust")
        if few:
            # Only hosts with links take part, so the broadcast is within what was measured.
            moving = F.broadcast(moving.join(F.broadcast(edges.select("host")), "host", "left_semi"))
            arrived = flows.join(moving, "host")
        else:
            arrived = salted_join(flows, moving, "host", "inner", ["to", "good"], counts=edges)
        return arrived.select(
            F.col("to").alias("host"),
            *(F.lit(0.0).alias(c) for c in ("trust", "distrust")),
            F.when(F.col("good"), F.col("new_trust") * F.col("share")).otherwise(0.0).alias("new_trust"),
            F.when(F.col("good"), 0.0).otherwise(F.col("new_distrust") * F.col("share")).alias("new_distrust"),
        )

    columns = ("trust", "distrust", "new_trust", "new_distrust")
    first = [(F.col(c) * (1 - damping)).alias(n) for c, n in (("trust", "new_trust"), ("distrust", "new_distrust"))]
    state = materialise(seeds.select("host", *(F.lit(0.0).alias(c) for c in columns[:2]), *first), "trust")
    while True:
        for _ in range(STEPS_PER_TABLE):
            stays = state.select(
                "host",
                *((F.col(c) + F.col(f"new_{c}")).alias(c) for c in columns[:2]),
                *(F.lit(0.0).alias(c) for c in columns[2:]),
            )
            state = stays.unionByName(moved(state)).groupBy("host").agg(*(F.sum(c).alias(c) for c in columns))
        state = materialise(state, "trust")
        left = state.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in columns[2:])).first()
        # What is on its way now is damped at each further step.
        if max(left) / (1 - damping) <= tolerance:
            return state.select("host", *((F.col(c) + F.col(f"new_{c}")).alias(c) for c in columns[:2]))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row for each of pages (id, url, html): id, host, path, rule, verdict, trust, distrust."""
    host, path = parts(F.col("url"))
    cut = pages.select("id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = cut.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    counts = judged.where("host <> '' and ruled is not null").groupBy("host").agg(
        *(F.count(F.when(F.col("ruled") == x, 1)).alias(f"n_{x}") for x in (ALLOW, BLOCK))
    )
    counts = materialise(counts, "seed_hosts")
    totals = counts.agg(F.sum(f"n_{ALLOW}"), F.sum(f"n_{BLOCK}")).first()
    seeds = counts.select(
        "host", *((F.col(f"n_{x}") / F.lit(float(max(1, n or 0)))).alias(c) for x, n, c in zip((ALLOW, BLOCK), totals, ("trust", "distrust"), strict=True))
    )
    # Pages are searched for links once.
    scores = propagate(materialise(host_links(cut), "links"), seeds)
    found = judged.join(scores, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > trust * margin, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return found.select(
        "id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
