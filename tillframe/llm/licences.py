"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised to lower-case words; known licence sentences have identifiers, and a
licence is found where a text's identifiers contain the licence's sequence in order. Sentences are read twice: line
by line, and flowing over line breaks, as licence texts are often wrapped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tillframe.llm.arrays import others

# Sentences of published licences and notices, with identifiers.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "Licensed under the Apache License, Version 2.0",
    6: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    7: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    8: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    9: "This work is licensed under the GNU General Public License, version 3",
    10: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    11: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    12: "Licensed under CC BY-NC 4.0",
    13: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    14: "Licensed under CC BY 4.0",
    15: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    17: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    18: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    20: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    21: "This is free and unencumbered software released into the public domain",
    22: "SPDX-License-Identifier: MIT",
    23: "SPDX-License-Identifier: Apache-2.0",
    24: "SPDX-License-Identifier: GPL-3.0-or-later",
}
# Licence, kind of licence, and the sentences that tell it, in order.
RULES = (
    ("MIT", "permissive", (1,)),
    ("MIT", "permissive", (2,)),
    ("MIT", "permissive", (3, 4)),
    ("MIT", "permissive", (22,)),
    ("Apache-2.0", "permissive", (5,)),
    ("Apache-2.0", "permissive", (6, 8)),
    ("Apache-2.0", "permissive", (23,)),
    ("GPL-3.0", "copyleft", (9,)),
    ("GPL-3.0", "copyleft", (10, 11)),
    ("GPL-3.0", "copyleft", (24,)),
    ("CC-BY-NC-4.0", "restricted", (12,)),
    ("CC-BY-NC-4.0", "restricted", (13,)),
    ("CC-BY-4.0", "permissive", (14,)),
    ("CC-BY-4.0", "permissive", (15,)),
    ("BSD-3-Clause", "permissive", (16, 17, 18, 19)),
    ("BSD-2-Clause", "permissive", (16, 17, 18)),
    ("ISC", "permissive", (20,)),
    ("Unlicense", "permissive", (21,)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END, OTHER = "[.!?;:]+[ \\t\\r]*(\\n|$)|[.!?;:]+[ \\t\\r]+|\\n", "[^a-z0-9\\n]+"


def normalised(sentence: str) -> list[str]:
    """What a known sentence looks like after the cut; one that holds an end of sentence gives several parts."""
    cut = re.sub(OTHER, " ", re.sub(SENTENCE_END, "\n", sentence.lower()))
    return [p.strip(" ") for p in cut.split("\n") if p.strip(" ")]


def known() -> dict[str, str]:
    """Normalised sentence part -> identifier, ``6`` or ``6.1``, ``6.2`` for a sentence that the cut parts."""
    out: dict[str, str] = {}
    for key, sentence in SENTENCES.items():
        parts = normalised(sentence)
        for i, part in enumerate(parts):
            out.setdefault(part, str(key) if len(parts) == 1 else f"{key}.{i + 1}")
    return out


def rule_patterns() -> list[tuple[str, str, str]]:
    """Licence, kind and the pattern its rule is in a list of identifiers that begins and ends with a comma."""
    by_part = known()
    out = []
    for licence, kind, sentences in RULES:
        wanted = [by_part[p] for s in sentences for p in normalised(SENTENCES[s])]
        out.append((licence, kind, "," + "(.*,)?".join(w.replace(".", "[.]") + "," for w in wanted)))
    return out


def _identifiers(text: Column, table: Column) -> Column:
    """The identifiers of a text's known sentences in order, each between commas."""
    cut = F.regexp_replace(F.translate(text, UPPER, LOWER), SENTENCE_END, "\n")
    words = F.regexp_replace(cut, OTHER, " ")
    found = F.transform(F.split(words, "\n"), lambda s: F.try_element_at(table, F.trim(s)))
    return F.concat(F.lit(","), F.array_join(F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.concat(x, F.lit(","))), ""))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with licences and kinds (in order, comma-joined), n_sentences and sentence_ids.

    n_sentences counts the known sentences, sentence_ids lists them, as the lines have them; licences come from lines
    or flowing text. A null or empty text has none, and empty strings. A kept column named like an output gives way to
    it. An empty table gives an empty result.
    """
    keep = others(keep, "licences", "kinds", "n_sentences", "sentence_ids")
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keep,
        _identifiers(whole, table).alias("__lines"),
        _identifiers(F.regexp_replace(whole, "[ \\t\\r]*\\n[ \\t]*", " "), table).alias("__flow"),
    )
    both = F.col("__lines"), F.col("__flow")
    hits = [F.when(both[0].rlike(p) | both[1].rlike(p), F.struct(F.lit(n).alias("licence"), F.lit(k).alias("kind"))) for n, k, p in rule_patterns()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return rows.select(
        *keep,
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["licence"]))), ",").alias("licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["kind"]))), ",").alias("kinds"),
        (F.size(F.split(both[0], ",")) - 2).cast("long").alias("n_sentences"),
        F.trim(both[0], F.lit(",")).alias("sentence_ids"),
    )


def scan_sql() -> str:
    """The same for DuckDB over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    keys, values = (", ".join(quote(x) for x in side) for side in zip(*known().items()))

    def identifiers(text: str) -> str:
        cut = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{SENTENCE_END}', chr(10), 'g')"
        words = f"regexp_replace({cut}, '{OTHER}', ' ', 'g')"
        found = f"list_transform(string_split({words}, chr(10)), lambda s: map([{keys}], [{values}])[trim(s, ' ')])"
        return f"',' || coalesce(array_to_string(list_transform(list_filter({found}, lambda x: x is not null), lambda x: x || ','), ''), '')"

    flow = "regexp_replace(coalesce(text, ''), '[ \\t\\r]*\\n[ \\t]*', ' ', 'g')"
    names = {}
    for licence, kind, pattern in rule_patterns():
        names.setdefault((licence, kind), []).append(f"regexp_matches(l, '{pattern}') or regexp_matches(f, '{pattern}')")
    picks = ", ".join(f"case when {' or '.join(p)} then {quote(n)} end" for (n, _), p in names.items())
    kinds = ", ".join(f"case when {' or '.join(p)} then {quote(k)} end" for (_, k), p in names.items())
    joined = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x is not null))), ','), '')"
    return (
        f"select doc_id, {joined.format(picks)} licences, {joined.format(kinds)} kinds, "
        "cast(length(l) - length(replace(l, ',', '')) - 1 as bigint) n_sentences, trim(l, ',') sentence_ids from "
        f"(select doc_id, {identifiers(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} l, {identifiers(flow)} f from documents)"
    )
