"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into units twice: into sentences (over line ends) and into lines. A unit is normalised (A-Z lower-cased,
everything but letters and digits a single blank) and looked up among the known licence sentences, a fixed table. What a document holds
of them, in order, is matched against the licence rules: a rule is a sequence of sentence identifiers that must occur
in that order, with anything in between. A rule that contains another one's sequence supersedes it.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import ascii_lower, table

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
    "bsd-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-short": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl3-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-short": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-short": "Licensed under CC0 1.0.",
    "cc0-long": "This work is licensed under a Creative Commons Zero v1.0 Universal License.",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

# SPDX identifiers whose SPDX-License-Identifier line is known. "GPL-2.0+" reads like "GPL-2.0" once normalised.
SPDX = ("0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
        "CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only "
        "GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense WTFPL Zlib").split()
SPDX += ["MIT OR Apache-2.0", "Apache-2.0 OR MIT"]
SENTENCES |= {"spdx-" + x.lower().replace(" ", "-"): "SPDX-License-Identifier: " + x for x in SPDX}

# Which sentences, in which order, make which licence.
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    ("mit-released", "MIT", ["mit-short"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("apache-header", "Apache-2.0", ["apache-notice"]),
    ("apache-header-url", "Apache-2.0", ["apache-notice", "apache-copy"]),
    ("apache-short", "Apache-2.0", ["apache-short"]),
    ("gpl-3-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("gpl-3-free", "GPL-3.0-or-later", ["gpl-free"]),
    ("gpl-3-short", "GPL-3.0-only", ["gpl3-short"]),
    ("mpl-2-header", "MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("cc-by-nc-short", "CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("cc-by-short", "CC-BY-4.0", ["cc-by-short"]),
    ("cc-by-sa-short", "CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("cc-by-long", "CC-BY-4.0", ["cc-by-long"]),
    ("cc-by-sa-long", "CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("all-rights-reserved", "LicenseRef-All-Rights-Reserved", ["all-rights"]),
    ("bsd-3-author", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-author"]),
    ("gpl-2-free", "GPL-2.0-or-later", ["gpl2-free"]),
    ("gpl-2-only", "GPL-2.0-only", ["gpl2-only"]),
    ("gpl-2-short", "GPL-2.0-only", ["gpl2-short"]),
    ("lgpl-2.1-free", "LGPL-2.1-or-later", ["lgpl21-free"]),
    ("lgpl-3-free", "LGPL-3.0-or-later", ["lgpl3-free"]),
    ("lgpl-2.1-short", "LGPL-2.1-only", ["lgpl21-short"]),
    ("lgpl-3-short", "LGPL-3.0-only", ["lgpl3-short"]),
    ("agpl-3-free", "AGPL-3.0-or-later", ["agpl3-free"]),
    ("agpl-3-short", "AGPL-3.0-only", ["agpl3-short"]),
    ("mpl-2-short", "MPL-2.0", ["mpl-short"]),
    ("cc0-waiver", "CC0-1.0", ["cc0-waiver"]),
    ("cc0-short", "CC0-1.0", ["cc0-short"]),
    ("cc0-long", "CC0-1.0", ["cc0-long"]),
    ("cc-by-nd-short", "CC-BY-ND-4.0", ["cc-by-nd-short"]),
    ("cc-by-nc-sa-short", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-short"]),
    ("cc-by-nc-nd-short", "CC-BY-NC-ND-4.0", ["cc-by-nc-nd-short"]),
    ("cc-by-nd-long", "CC-BY-ND-4.0", ["cc-by-nd-long"]),
    ("cc-by-nc-long", "CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("cc-by-nc-sa-long", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-long"]),
    ("cc-by-nc-nd-long", "CC-BY-NC-ND-4.0", ["cc-by-nc-nd-long"]),
    *(("spdx-" + x.lower().replace(" ", "-"), x, ["spdx-" + x.lower().replace(" ", "-")]) for x in SPDX),
]

#: Rules whose sequence begins another rule's: (superseded, by).
SUPERSEDED = [("bsd-2-text", "bsd-3-text"), ("bsd-2-text", "bsd-3-author"), ("apache-header", "apache-header-url"), ("gpl-3-free", "gpl-3-header")]

_BLANK = r"[\x20\x09-\x0D]"
#: What opens BSD's endorsement sentence, whoever is named, ends a unit too, so that the sentence is known by its rest.
_NEITHER = "[^a-z0-9]+".join(["neither", "the", "name", "of", "[^;]+?", "nor", "the", "names", "of", "(?:its|any|other)", "contributors"])
#: Lines without a letter or digit, as the empty ones of comment blocks ('#', ' *', '//'), end a sentence like empty lines.
_SENTENCE_END = rf"[.!?:]+({_BLANK}+|\z)|\n(?:[^\p{{L}}\p{{N}}\n]*\n)+|{_NEITHER}"
_LINE_END = rf"\n|{_NEITHER}"
_OTHER = r"[^\p{L}\p{N}\x01]+"
_MARK = "\x01"


def normalise(sentence: str) -> str:
    """The one spelling by which a sentence is looked up."""
    return re.sub(r"[\W_]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def units(text: Column, end: str) -> Column:
    """The normalised units of a text, in order, not trimmed."""
    marked = F.regexp_replace(ascii_lower(text), end, _MARK)
    return F.split(F.regexp_replace(marked, _OTHER, " "), _MARK)


def _longest_unit(sentence: str, end: str) -> str:
    return max((normalise(u) for u in re.split(end.replace(r"\z", r"\Z").replace(r"\p{L}\p{N}", r"\w").replace("+([", "+(?:["), sentence.lower())), key=len)


_BY_UNIT = {(_longest_unit(s, end), k) for k, s in SENTENCES.items() for end in (_SENTENCE_END, _LINE_END)}
_SHARED = Counter(u for u, _ in _BY_UNIT)
#: (unit, sentence_id): by which unit a known sentence is recognised; one that is cut in several, by its longest. A unit of
#: several sentences (what stands before the colon of the SPDX lines) tells none.
KNOWN = sorted((u, k) for u, k in _BY_UNIT if _SHARED[u] == 1)


def _chain(seq: Column, steps: Column) -> Column:
    """The earliest run through ``steps`` in ``seq``: how many steps it takes, first and last position."""
    start = F.struct(F.lit(0).alias("step"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def on(at: Column, x: Column) -> Column:
        hit = (at["step"] < F.size(steps)) & (x["pos"] > at["last"]) & (F.get(steps, at["step"]) == x["sentence_id"])
        new = F.struct((at["step"] + 1).alias("step"), F.when(at["step"] == 0, x["pos"]).otherwise(at["first"]).alias("first"),
                       x["pos"].alias("last"))
        return F.when(hit, new).otherwise(at)

    return F.reduce(seq, start, on)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, cut ("sentence" or "line"), rule_id, licence, first_unit and last_unit (numbers of the units, from 0) and
    n_sentences of every rule that a document satisfies under either cut, by its earliest chain of sentences.

    Null and empty texts satisfy none; rows that share an id (or a null id) are read as one document laid over each other;
    an empty table gives an empty result; other columns are ignored. A document's state is its licence sentences only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cuts = F.array(F.struct(F.lit("sentence").alias("cut"), units(text, _SENTENCE_END).alias("units")),
                   F.struct(F.lit("line").alias("cut"), units(text, _LINE_END).alias("units")))
    each = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(cuts).alias("c"))
            .select("doc_id", "c.cut", F.posexplode("c.units").alias("pos", "unit"))
            .select("doc_id", "cut", "pos", F.trim("unit").alias("unit")).filter("unit <> ''"))
    known = docs.sparkSession.createDataFrame(KNOWN, "unit string, sentence_id string")  # a fixed table
    found = each.join(F.broadcast(known), "unit")
    seqs = found.groupBy("doc_id", "cut").agg(F.sort_array(F.collect_set(F.struct("pos", "sentence_id"))).alias("seq"))
    rules = F.array(*(F.struct(F.lit(rule).alias("rule_id"), F.lit(name).alias("licence"), F.array(*map(F.lit, steps)).alias("steps"))
                      for rule, name, steps in RULES))
    tried = F.transform(rules, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["licence"].alias("licence"), F.size(r["steps"]).alias("n_sentences"),
                                                  _chain(F.col("seq"), r["steps"]).alias("at")))
    held = seqs.select("doc_id", "cut", F.filter(tried, lambda r: r["at"]["step"] == r["n_sentences"]).alias("held"))
    rules = F.transform("held", lambda r: r["rule_id"])
    above = F.array(*(F.when(F.array_contains(rules, by), F.lit(low)) for low, by in SUPERSEDED))
    return (held.withColumn("above", above).select("doc_id", "cut", "above", F.explode("held").alias("r"))
            .filter(~F.coalesce(F.array_contains(F.array_compact("above"), F.col("r.rule_id")), F.lit(False)))
            .select("doc_id", "cut", "r.rule_id", "r.licence", F.col("r.at.first").alias("first_unit"),
                    F.col("r.at.last").alias("last_unit"), "r.n_sentences"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


OP10_SQL = rf"""
WITH RECURSIVE known(unit, sentence_id) AS (VALUES {_values(KNOWN)}),
steps(rule_id, licence, n_sentences, step, sentence_id) AS (
  VALUES {_values([(r, n, len(ss), k, s) for r, n, ss in RULES for k, s in enumerate(ss)])}),
superseded(low, high) AS (VALUES {_values(SUPERSEDED)}),
cuts AS (
  SELECT doc_id, cut, string_split(regexp_replace(regexp_replace(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           CASE cut WHEN 'line' THEN '{_LINE_END}' ELSE '{_SENTENCE_END}' END, chr(1), 'g'), '{_OTHER}', ' ', 'g'), chr(1)) AS us
  FROM documents, (VALUES ('sentence'), ('line')) c(cut)),
each AS (SELECT doc_id, cut, unnest(us) AS unit, generate_subscripts(us, 1) - 1 AS pos FROM cuts),
found AS (SELECT DISTINCT doc_id, cut, pos, sentence_id FROM each JOIN known ON trim(each.unit) = known.unit),
chain(doc_id, cut, rule_id, licence, n_sentences, step, first_unit, last_unit) AS (
  SELECT doc_id, cut, rule_id, licence, n_sentences, 0, min(pos), min(pos)
  FROM found JOIN steps USING (sentence_id) WHERE step = 0 GROUP BY ALL
  UNION ALL
  SELECT c.doc_id, c.cut, c.rule_id, c.licence, c.n_sentences, c.step + 1, c.first_unit,
         (SELECT min(f.pos) FROM found f WHERE f.doc_id = c.doc_id AND f.cut = c.cut AND f.pos > c.last_unit AND f.sentence_id = s.sentence_id)
  FROM chain c JOIN steps s ON s.rule_id = c.rule_id AND s.step = c.step + 1 WHERE c.last_unit IS NOT NULL),
held AS (SELECT * FROM chain WHERE step = n_sentences - 1 AND last_unit IS NOT NULL)
SELECT doc_id, cut, rule_id, licence, first_unit, last_unit, n_sentences FROM held h
WHERE NOT EXISTS (SELECT 1 FROM held b JOIN superseded s ON s.high = b.rule_id
                  WHERE b.doc_id = h.doc_id AND b.cut = h.cut AND s.low = h.rule_id)
"""
