"""Licence scans by sentence rules, in built-in functions only.

A text can break at line ends and after full stops, question and exclamation marks
and semicolons before white space, and before a URL; not after a colon inside a line, as in the SQL of the query. It is normalised (A-Z in lower case, every run of
other characters than letters and digits one space, lines of comment marks are empty lines, the
number or letter of a point of a list ends at a break) and searched for known licence sentences that begin and end at a break.
Between words of a sentence the text may break (a wrapped notice), but not at the end of another
sentence or at an empty line. Of sentences that begin at one place the longest is taken, and the search goes on behind
it. The identifiers of a text, in order, are matched against
the rules: a rule is a licence and the sentences that show it, in this order, with
other known sentences allowed between them. All of it is one projection of each row.

Defined cases. Null and empty texts have no identifiers and no licence. A repeated
sentence counts each time. Of rules for one licence the first that matches is
given; licences are listed in the order of the rules. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of licences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2-short",
    "licensed under the apache license version 2 0 the license": "apache-2-header",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at": "apache-2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the rights to"
    " use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the"
    " software is furnished to do so subject to the following conditions": "mit-permission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3-short",
    "this work is licensed under the gnu general public license version 2": "gpl-2-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
    " as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
    " as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-header",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty"
    " of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
    " conditions are met": "bsd-permission",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission": "bsd-endorsement",
    "licensed under cc by nc 4 0": "cc-by-nc-4-short",
    "licensed under cc by 4 0": "cc-by-4-short",
    "licensed under cc by sa 4 0": "cc-by-sa-4-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-short",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-short",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-short",
    "spdx license identifier mit": "spdx-mit",
    "spdx license identifier apache 2 0": "spdx-apache-2",
    "spdx license identifier bsd 2 clause": "spdx-bsd-2",
    "spdx license identifier bsd 3 clause": "spdx-bsd-3",
    "spdx license identifier gpl 2 0 only": "spdx-gpl-2",
    "spdx license identifier gpl 3 0 only": "spdx-gpl-3",
}
# Licence and the sentences that show it, in order. Longer evidence comes before shorter.
RULES = [
    ("Apache-2.0", ["apache-2-header", "apache-2-compliance", "apache-2-copy"]),
    ("Apache-2.0", ["spdx-apache-2"]),
    ("Apache-2.0", ["apache-2-header"]),
    ("Apache-2.0", ["apache-2-short"]),
    ("MIT", ["mit-permission", "mit-notice", "mit-warranty"]),
    ("MIT", ["spdx-mit"]),
    ("MIT", ["mit-short"]),
    ("GPL-3.0", ["gpl-3-header", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0", ["gpl-3-header"]),
    ("GPL-3.0", ["spdx-gpl-3"]),
    ("GPL-3.0", ["gpl-3-short"]),
    ("GPL-2.0", ["gpl-2-header", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0", ["gpl-2-header"]),
    ("GPL-2.0", ["spdx-gpl-2"]),
    ("GPL-2.0", ["gpl-2-short"]),
    ("BSD-3-Clause", ["bsd-permission", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-3-Clause", ["spdx-bsd-3"]),
    ("BSD-2-Clause", ["bsd-permission", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["spdx-bsd-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-short"]),
    ("CC-BY-4.0", ["cc-by-4-short"]),
]
# A licence that a later one holds word for word is not given beside it.
IMPLIED = {"BSD-2-Clause": "BSD-3-Clause"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK, OTHER = r"([.!?])[ \t\r\f\n]+", r"[^a-z0-9\x{80}-\x{10FFFF}]+"


# Ends of sentences and paragraphs, and weaker breaks, in the normalised text.
HARD, SOFT = "\u0001", "\u0002"
WORD = OTHER.removeprefix("[^").removesuffix("]+")
# A line without a word: an empty one, or one of comment marks.
EMPTY = rf"\n[^A-Z{WORD}\n]*\n"
# The start of a line: other characters than words, a comment mark made of letters, the number or letter of a point of a list.
POINT = rf"(?m)^[^A-Z{WORD}\n]*(?:(?:[Rr][Ee][Mm]|dnl)(?=[ \t])[^A-Z{WORD}\n]*)?(?:(?:[0-9]{{1,2}}|[A-Za-z])[.)](?=[ \t]))?"
WEAK = r";(?=[ \t\f\n])|\n|[ \t](?=[Hh][Tt][Tt][Pp][Ss]?://)"


def broken(text: Column) -> Column:
    """The normalised text: words with a space, HARD or SOFT between, and HARD at both ends."""
    lines = F.regexp_replace(F.regexp_replace(text, f"[{HARD}{SOFT}]", " "), "\r\n?", "\n")
    marked = F.regexp_replace(F.regexp_replace(lines, POINT, SOFT), EMPTY, HARD)
    marked = F.regexp_replace(F.regexp_replace(marked, BREAK, f"$1{HARD}"), WEAK, SOFT)
    words = F.regexp_replace(F.translate(marked, UPPER, LOWER), f"[^{WORD}{HARD}{SOFT}]+", " ")
    # Of several breaks between two words the strongest holds; a run is looked at from its start only.
    words = F.regexp_replace(words, f"(?<![ {HARD}{SOFT}])[ {SOFT}]*+{HARD}[ {HARD}{SOFT}]*+", HARD)
    words = F.regexp_replace(words, f"(?<![ {SOFT}]) *+{SOFT}[ {SOFT}]*+", SOFT)
    return F.concat(F.lit(HARD), F.trim(words), F.lit(HARD))


def sentence_pattern(known: dict[str, str]) -> str:
    """A pattern over broken() text that the known sentences fit, the longest first."""
    one = [f"[ {SOFT}]".join(s.split(" ")) for s in sorted(known, key=len, reverse=True)]
    return f"(?<=[{HARD}{SOFT}])(?:{'|'.join(one)})(?=[{HARD}{SOFT}])"


def hint(known: dict[str, str]) -> str:
    """A pattern that every text with a known sentence fits; other texts are not searched. It has a word of each sentence, long words first."""
    left, words = list(known), []
    while left:
        counts: dict[str, int] = {}
        for sentence in left:
            for w in set(sentence.split(" ")):
                counts[w] = counts.get(w, 0) + 1
        words.append(max(counts, key=lambda w: (len(w) > 6, counts[w], len(w), w)))
        left = [sentence for sentence in left if words[-1] not in sentence]
    return "|".join("".join(f"[{c.upper()}{c}]" if c in LOWER else c for c in w) for w in words)


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    # A text has no sentence that is not normalised.
    known = {s: i for s, i in known.items() if re.fullmatch("[a-z0-9\x80-\U0010ffff]+(?: [a-z0-9\x80-\U0010ffff]+)*", s)}
    if not known:
        return F.array().cast("array<string>")
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    found = F.regexp_extract_all(broken(text), F.lit(sentence_pattern(known)), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.translate(s, SOFT, " ")))
    return F.when(text.rlike(hint(known)), ids).otherwise(F.array().cast("array<string>"))


def progress(ids: Column, sequences: list[list[str]]) -> Column:
    """How many identifiers of each sequence a list of identifiers has, in this order; others may lie between.

    One pass, with a place in each sequence that moves on when its next identifier comes.
    """
    table = F.array(*(F.array(*map(F.lit, sequence)) for sequence in sequences))
    moved = lambda places, x: F.transform(places, lambda p, k: F.when(F.get(F.get(table, k), p) == x, p + 1).otherwise(p))
    return F.aggregate(ids, F.array_repeat(F.lit(0), len(sequences)), moved)


def scan(documents: DataFrame, text: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """documents with sentence_ids, rules (numbers from 1 of the first that shows each licence) and licenses."""
    rules = RULES if rules is None else rules
    ids = identifiers(F.coalesce(F.col(text), F.lit("")), SENTENCES if known is None else known)
    if not rules:
        return documents.withColumns({"sentence_ids": ids, "rules": F.array().cast("array<int>"), "licenses": F.array().cast("array<string>")})
    shown: dict[str, Column] = {}
    for number, (name, sequence) in enumerate(rules, 1):
        fits = F.get("_progress", F.lit(number - 1)) == len(sequence)
        shown[name] = shown[name].when(fits, F.lit(number)) if name in shown else F.when(fits, F.lit(number))
    found = documents.withColumn("sentence_ids", ids)
    found = found.withColumn("_progress", F.when(F.size("sentence_ids") > 0, progress(F.col("sentence_ids"), [sequence for _, sequence in rules])))
    found = found.withColumn("_shown", F.array(*(F.struct(F.lit(n).alias("license"), c.alias("rule")) for n, c in shown.items())))
    implied = {n: by for n, by in IMPLIED.items() if n in shown and by in shown}
    held = lambda x, n, by: (x["license"] == n) & F.exists("_shown", lambda y: (y["license"] == by) & y["rule"].isNotNull())
    kept = lambda x: x["rule"].isNotNull() & ~(F.lit(False) if not implied else _any(held(x, n, by) for n, by in implied.items()))
    found = found.withColumn("_shown", F.when(F.size("sentence_ids") > 0, F.filter("_shown", kept)).otherwise(F.array().cast("array<struct<license:string,rule:int>>")))
    return found.withColumns({"rules": F.col("_shown.rule"), "licenses": F.col("_shown.license")}).drop("_shown", "_progress")


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out
