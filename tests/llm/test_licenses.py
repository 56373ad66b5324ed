"""Licence notices as they stand in files: wrapped, commented, in lists, or on one line."""

import textwrap

import pytest

from tuneprep.llm import licenses as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
(b) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
IDS = {
    "MIT": ["mit-permission", "mit-notice", "mit-warranty"],
    "GPL-2.0": ["gpl-2-header", "gpl-warranty", "gpl-details"],
    "BSD-3-Clause": ["bsd-permission", "bsd-source", "bsd-binary", "bsd-endorsement"],
    "Apache-2.0": ["apache-2-header", "apache-2-compliance", "apache-2-copy"],
}
NOTICES = dict(zip(IDS, (MIT, GPL, BSD, APACHE)))


def wrapped(text, mark="", width=72):
    lines = [x for line in text.split("\n") for x in textwrap.wrap(line, width, break_on_hyphens=False) or [""]]
    return "\n".join((mark + x).rstrip(" ") for x in lines)


FORMS = {
    "one line": lambda t: t,
    "wrapped": wrapped,
    "narrow": lambda t: wrapped(t, width=30).replace("\n", "\r\n"),
    "block": lambda t: "/*\n" + wrapped(t, " * ") + "\n */\nint x;",
    "hash": lambda t: "#!/bin/sh\n" + wrapped(t, "# ") + "\nexit",
    "slashes": lambda t: "Copyright (c) A. Author\n\n" + wrapped(t, "// ", 60) + "\n\nint main;",
    "rem": lambda t: wrapped(t, "REM "),
}


def scanned(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [(r["sentence_ids"], r["licenses"]) for r in sorted(L.scan(rows, **options).collect())]


def test_notices_in_files(spark):
    cases = [(name, form) for name in NOTICES for form in FORMS]
    found = scanned(spark, [FORMS[form](NOTICES[name]) for name, form in cases])
    assert dict(zip(cases, found)) == {(name, form): (IDS[name], [name]) for name, form in cases}


def test_breaks(spark):
    texts = [
        "Released under\n\nthe MIT License.",
        "Released under\n#\nthe MIT License.",
        "Released under the. MIT License",
        "unReleased under the MIT License",
        "Was released\nunder the MIT License\ntoo. Released under the MIT License",
        "; \n" * 50_000 + " " * 100_000 + "Licensed under\nthe MIT License",
        "x\u0001Released under the MIT\u0002License",
    ]
    expected = [[], [], [], [], ["mit-short"], ["mit-short"], []]
    assert [ids for ids, _ in scanned(spark, texts)] == expected


@pytest.mark.parametrize("known", [{"zażółć own terms": "own"}, {"use it freely": "own", "C++": "never"}, {}])
def test_known_sentences_of_ones_own(spark, known):
    texts = ["Zażółć\nown terms.", "Use it\nfreely!", "Released under the MIT License"]
    expected = [["own"] if "zażółć own terms" in known else [], ["own"] if "use it freely" in known else [], []]
    assert [ids for ids, _ in scanned(spark, texts, known=known)] == expected
