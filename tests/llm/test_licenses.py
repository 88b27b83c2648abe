import duckdb

from cases import SF, documents, edge_docs, rows_of
from dealerlens.llm import licenses as op


def test_every_rule_is_recognised_as_prose_and_by_lines(spark):
    texts = {(k, j): sep.join(op.SENTENCES[s] for s in ss) for k, (_, _, ss) in enumerate(op.RULES) for j, sep in enumerate((" ", "\n"))}
    got = {(r.doc_id, r.rule_id) for r in op.scan_licenses(edge_docs(spark, [(10 * k + j, t) for (k, j), t in texts.items()])).collect()}
    assert got == {(10 * k + j, rule) for k, (rule, _, _) in enumerate(op.RULES) for j in (0, 1)}


def test_order_counts_and_wrapped_lines_are_read(spark):
    mit = [op.SENTENCES[s] for s in ("mit-grant", "mit-notice", "as-is-software")]
    wrapped = "MIT License\n\nCopyright (c) 2020\n\n" + mit[0].replace(" copy, modify", "\ncopy, modify") + "\n\n" + mit[1] + " Some words. " + mit[2].lower()
    got = rows_of(op.scan_licenses(edge_docs(spark, [(1, wrapped), (2, " ".join(mit[::-1]))])), "doc_id", "cut", "licence")
    assert got == [(1, "sentence", "MIT")]


def test_edge_cases(spark):
    got = rows_of(op.scan_licenses(edge_docs(spark)), "doc_id", "cut", "rule_id", "first_unit", "last_unit")
    assert got == sorted((i, c, "apache-short", 2 if c == "line" else 1, 2 if c == "line" else 1) for i in (7, 9) for c in ("line", "sentence"))
    twice = edge_docs(spark, [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")])
    assert rows_of(op.scan_licenses(twice).filter("cut = 'line'"), "doc_id", "licence") == [(1, "MIT"), (None, "CC-BY-4.0")]
    assert op.scan_licenses(edge_docs(spark, [])).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = op.op10_license_scan(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(op.OP10_SQL).fetchall())


def test_licence_lines_listed_by_hand(spark):
    # Written out here, not taken from the module's tables.
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
           "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
           "3. Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")
    lines = {"All rights reserved.": "LicenseRef-All-Rights-Reserved", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only",
             "/* SPDX-License-Identifier: MIT */": "MIT", "Licensed under CC0 1.0.": "CC0-1.0", bsd: "BSD-3-Clause",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later"}
    got = {(r.doc_id, r.licence) for r in op.scan_licenses(edge_docs(spark, [(k, "Some prose.\n" + t + "\nMore.") for k, t in enumerate(lines)])).collect()}
    assert got == set(enumerate(lines.values()))


def test_licence_lines_of_the_tables_are_all_found(spark):
    d = documents()
    held = {i for i, t in zip(d.doc_id, d.text, strict=True) if any(x in (t or "").split("\n") for x in (
        "All rights reserved.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."))}
    assert held and held <= {r.doc_id for r in op.op10_license_scan(spark, SF).collect()}


def test_headers_in_comment_blocks_are_read(spark):
    apache = ('{0} Copyright 2020 Foo\n{0}\n{0} Licensed under the Apache License, Version 2.0 (the "License");\n{0} you may not use this file except in compliance\n'
              '{0} with the License.\n{0}\n{0} Unless required')
    mit = op.SENTENCES["mit-grant"].replace(" copy, modify", "\n * copy, modify")
    mit = f"/*\n * Copyright (c) 2020 Foo\r\n *\r\n * {mit}\n *\n * {op.SENTENCES['mit-notice']}\n *\n * {op.SENTENCES['as-is-software']}\n */"
    got = rows_of(op.scan_licenses(edge_docs(spark, [(1, apache.format("#")), (2, apache.format(" *")), (3, apache.format("//")), (4, mit)])), "doc_id", "cut", "rule_id")
    assert [g for g in got if g[1] == "sentence"] == [(1, "sentence", "apache-header"), (2, "sentence", "apache-header"), (3, "sentence", "apache-header"), (4, "sentence", "mit-text")]
