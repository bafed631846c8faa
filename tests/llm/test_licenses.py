"""Operator 7 against brute force."""

import random
import re
from re import _constants as C
from re import _parser as P

import pytest
from pyspark.sql import types as T

from quern.llm.license_rules import keyword_pattern, rules
from quern.llm.license_texts import TEXTS
from quern.llm.queries_licenses import PHRASES, op7_licenses

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("labels", T.StringType()))])
RULES = rules()


def brute(doc_id, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    line = f" {' '.join(words)} " if words else " "
    found = []
    for r in RULES:
        found += [(m.start(), m.end(), r) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line)]
    standing = []
    for i, (s, e, r) in enumerate(found):
        def hides(o):
            same = (o[0], o[1], o[2].priority) == (s, e, r.priority)
            return o[0] <= s and e <= o[1] and o[2].priority <= r.priority and (not same or o[2].order < r.order)
        if not any(hides(o) for j, o in enumerate(found) if j != i):
            standing.append((r.label, r.confidence))
    base = {x for _, x in places}
    starts = [i for i, _ in places]
    labels = sorted(base | {x for x, _ in standing})
    score = max([1.0] * bool(places) + [c for _, c in standing] + [0.0])
    return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score)


LINES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "CC-BY-NC-SA 3.0", "SPDX-License-Identifier: GPL-2.0-or-later",
    "under the mit license apache license version 2 cc by nc cc by nc", "GNU Lesser General Public License v2.1", "See the Mozilla Public License 2.0", "All rights reserved.",
    "opensource.org/licenses/BSD-3-Clause", "dedicated to the public domain", "mit freundlichen Grüßen", "the limit license", "Creative Commons Attribution-ShareAlike", "CC0",
    "under the GNU General Public License version 3", "Alle Rechte vorbehalten", "the MIT licence", "apache helicopter version 2", "plain words here", "é CC BY NC é", "wtfpl", "bsd license",
]


def rows():
    random.seed(2)
    out = [(i, line) for i, line in enumerate(LINES)]
    out += [(100 + i, random.choice([" ", "\n", "--"]).join(random.choices(LINES, k=random.randint(2, 9)))) for i in range(60)]
    return out + [(500, None), (501, ""), (502, "-- \n"), (503, "word " * 5000 + "CC BY NC"), (None, LINES[0]), (1, LINES[1])]


def test_hundreds_of_rules():
    assert len(TEXTS) > 130 and len({r.pattern for r in RULES}) == len(RULES) > 500 and [r.order for r in RULES] == list(range(len(RULES)))
    assert [r.priority for r in RULES] == sorted(r.priority for r in RULES)
    for r in RULES:
        re.compile(r.pattern)


def test_query(spark, tmp_path):
    spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    out = op7_licenses(spark, f"{tmp_path}/a")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([brute(*r) for r in rows()], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op7_licenses(spark, f"{tmp_path}/b").collect() == []


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op7_licenses(spark, sf).collect()), key=str) == sorted([brute(*r) for r in docs], key=str)


@pytest.mark.parametrize("text,label", [("SPDX-License-Identifier: MIT", "mit"), ("Licensed under the GPL v3", "gpl-3.0"), ("under the Apache License, Version 2.0", "apache-2")])
def test_labels(text, label):
    assert label in brute(0, text)[6].split(",")


#: (text, label it must have, text alike that must not have it)
SENTENCES = [
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")', "mit", "Permission is hereby granted to any person to enter the house"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd", "Redistribution of land and use of water are permitted"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause", "Neither the name of the king nor the names of his sons"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause", "All advertising materials must display the price"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc", "Permission to use the pool is hereby granted"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "apache-2", "Unless required by applicable law, he stays"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2", "http://www.apache.org/dist/httpd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", "This program is free on Sundays"),
    ("either version 2 of the License, or (at your option) any later version.", "gpl-2.0", "either version 2 of the song or any later version"),
    ("released under GPLv2+", "gpl-2.0", "released with a GPS v2"),
    ("GNU GPLv3", "gpl-3.0", "GNU Emacs v3"),
    ("LGPLv2.1", "lgpl-2.1", "LGPL-3.0"),
    ("GNU Library General Public License, version 2", "lgpl-2.0", "the library of the general public"),
    ("AGPLv3", "agpl-3.0", "AGP v3"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0", "This source code form is blue"),
    ("This is free and unencumbered software released into the public domain.", "unlicense", "This is free and unencumbered time"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "zlib", "Altered carbon must be plainly marked"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost", "Distributed under the boost phase"),
    ("The Software shall be used for Good, not Evil.", "json", "The sword shall be used for good, not evil."),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa", "https://creativecommons.org/about"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0", "https://creativecommons.org/publicdomain/mark"),
    ("Some rights reserved", "cc", "Some rights are wrong"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary", "Unauthorized parking is strictly prohibited"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2", "SPDX-License-Identifier: MIT"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "mit", "SPDX-License-Identifier: Apache-2.0"),
    ("Llama 3.1 Community License Agreement", "llama", "the llama community"),
    ("Licence Ouverte 2.0", "etalab", "une licence de chasse"),
    ("Все права защищены", "all-rights-reserved", "все права и обязанности"),
    ("Creative Commons Zero", "cc0", "creative zero commons"),
    ("under the Expat License", "mit", "under the expat community"),
]


def test_sentences(spark):
    from quern.llm.licenses import scan

    rows = [(2 * i + k, (text, other)[k]) for i, (text, _, other) in enumerate(SENTENCES) for k in (0, 1)]
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), keys=["doc_id"], text_col="text", phrases=PHRASES).collect()}
    assert got == {d: brute(d, t)[6] for d, t in rows}
    for i, (text, label, other) in enumerate(SENTENCES):
        assert label in got[2 * i].split(","), text
        assert label not in got[2 * i + 1].split(","), other


def example(tree, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.IN and arg[0][0] is not C.NEGATE:
            kind, value = rng.choice(arg)
            out += chr(value if kind is C.LITERAL else value[0])
        elif op in (C.IN, C.NOT_LITERAL):
            out += "x"
        elif op is C.BRANCH:
            out += example(rng.choice(arg[1]), rng)
        elif op is C.SUBPATTERN:
            out += example(arg[3], rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        else:
            assert op is C.ASSERT_NOT, op
    return out


def test_gates_let_through_what_rules_match():
    """Each rule's alternatives hold one of its keywords at a word."""
    rng, pattern = random.Random(1), keyword_pattern(RULES)
    for r in RULES:
        tree = P.parse(r.pattern)
        for _ in range(100):
            text = f" {example(tree, rng)} "
            assert re.search(f"(?<= )(?:{r.pattern})(?= )", text), (r.pattern, text)
            assert any(f" {k}" in text for k in r.keywords), (r.label, r.keywords, text)
            # and the one pass over a text finds it
            assert set(r.keywords) & set(re.findall(pattern, text)), (r.label, text)
