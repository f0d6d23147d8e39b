"""op2 through Spark: weights of ordinary words, statements over lines."""

from tabulon.llm import licences


def test_common_words_cost_little_in_a_large_corpus(spark):
    rows = [(i, f"d{i}/a.txt", f"this project is number{i} by the team") for i in range(400)]
    rows.append((1000, "x/a.txt", "This project is released under the MIT License."))
    rows.append((1001, "y/a.txt", "This mit license zebra quagga okapi released tapir."))
    files = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r.id: r.own_licence for r in licences.scan(files).collect() if r.own_licence}
    assert got == {1000: "MIT"}


BSD = """Copyright (c) 1999 Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above notice.
"""
GPL = """/*
 * A tool of some kind
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""
APACHE = "# Some words before, and this file is\r\n# Licensed under the Apache\r\n# License, Version\r\n# 2.0 by all of us\r\n"


def test_statements_wrapped_over_lines(spark):
    rows = [(1, "a/LICENSE", BSD), (2, "a/b/c.c", "int x;"), (3, "g/main.c", GPL), (4, "h/x.py", APACHE),
            (5, "i/y.py", "permission to use\nthe software\nunder version 3"), (6, "j/z", "released under\nthe mit\nlicense")]
    rows += [(i, f"d{i}/a.txt", "this is the text of a file and of no other one") for i in range(10, 60)]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r.id: (r.own_licence, r.licence) for r in licences.scan(files).collect() if r.licence}
    assert got == {1: ("BSD-3-Clause", "BSD-3-Clause"), 2: (None, "BSD-3-Clause"), 3: ("GPL-3.0", "GPL-3.0"),
                   4: ("Apache-2.0", "Apache-2.0"), 6: ("MIT", "MIT")}
