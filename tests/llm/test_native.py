"""Licenses, chats and URLs: fixtures, awkward rows and plans without Python."""

import random

import duckdb
import pytest
from helpers import SF, awkward, roots
from pyspark.sql import functions as F

from quern.llm import chat, licenses, queries, urls


def test_license_rules_in_order(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that:\n* Redistributions of source code must retain the above copyright notice, this list.\n* Redistributions in binary form must reproduce the above copyright notice.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"."
    rows = [(1, "Text.\n// Licensed under the Apache License, Version 2.0.\nMore text."), (2, "# Released under the MIT License. And so on."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, bsd), (6, "All licence holders agree with the warranty."), (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (8, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.licenses for k, r in got.items()} == {1: ["Apache-2.0"], 2: ["MIT"], 3: ["GPL-3.0"], 4: ["CC-BY-NC-4.0"], 5: ["BSD-2-Clause"], 6: [], 7: ["MIT", "CC-BY-NC-4.0"], 8: []}
    assert got[5].sentence_ids == ["bsd_intro", "bsd_source", "bsd_binary", "bsd_asis"] and got[6].n_unknown == 1


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
@pytest.mark.parametrize("head", ["", "Copyright (c) 2020 A. Person\n\n", "The licence of this file\n"])
def test_wrapped_licenses(spark, mark, head):
    texts = {"MIT": MIT, "BSD-3-Clause": BSD, "GPL-2.0-or-later": GPL, "GPL-3.0-or-later": GPL.replace("version 2", "version 3"), "Apache-2.0": APACHE}
    rows = [(k, "\n".join(mark + x for x in (head + t).split("\n")) + "\n") for k, t in texts.items()]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: [k] for k in texts}
    assert got["Apache-2.0"].sentence_ids[-4:] == ["apache2", "apache2_grant", "apache2_copy", "apache2_asis"]


MORE = {
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.

This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely.""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright
and related or neighboring rights to this work.""",
}
SHORT = {
    "Licensed under the Apache-2.0 license.": "Apache-2.0", "Released under MIT.": "MIT", "This project is dual-licensed under the terms of the MIT license": "MIT",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "/* SPDX-License-Identifier: GPL-2.0+ */": "GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "Licensed under the LGPLv2.1 or later": "LGPL-2.1", "This library is distributed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "Available under the 3-clause BSD license": "BSD-3-Clause", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "BSL-1.0",
    "Licensed under GPLv3 or later": "GPL-3.0-or-later", "This work is licensed under CC BY-SA 4.0 International": "CC-BY-SA-4.0", "Released under the ISC License": "ISC",
    "The images are licensed under CC0 1.0 Universal": "CC0-1.0", "The licence of the bird shop was renewed.": "", "Published under the title of the book": "",
}


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_more_wrapped_licenses(spark, mark):
    rows = [(k, "\n".join(mark + x for x in ("Copyright (c) 2020 A. Person\n\n" + t).split("\n")) + "\n") for k, t in MORE.items()]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: [k] for k in MORE}


def test_short_licenses(spark):
    rows = [*SHORT, *(f"Some words.\n{k}\nMore words of the text" for k in SHORT)]
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate([*SHORT.values()] * 2))


def test_awkward_licenses(spark):
    docs = awkward(spark)
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count() and all(r.licenses == [] and r.n_unknown == 0 for r in got)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, n int"


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi", 0), (2, 0, "user", "hi", 0), (2, 1, "assistant", "hello", 0), (3, 5, "user", "hi", 0), (3, 6, "assistant", "hello", 0), (4, 0, "user", "hi", 0), (4, 1, "assistant", "other", 0), (5, 1, "assistant", "hello", 0), (6, 0, "user", None, 0), (7, 0, "user", "", 0), (7, 1, None, "x", 0), (None, 0, "user", "lost", 0), (8, 0, "a", "tie", 0), (8, 0, "a", "tie", 0), (9, 0, "a", "tie", 0)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {2, 4, 5, 6, 7, 8}
    assert got[2].n_same == 2 and got[2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert got[8].n_turns == 2
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_hosts_paths_and_rules(spark):
    rows = [("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de", "example.net", "/de", "net/", "block"), ("http://example.net", "example.net", "", None, "allow"), ("http://xexample.com/de/", "xexample.com", "/de/", None, "allow"), ("http://a.b.example.com/de/1", "a.b.example.com", "/de/1", "example.com/de/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://x.org/fr/://y", "x.org", "/fr/://y", "org/fr/", "allow"), ("http://É.ORG?x/fr/", "É.org", "", None, "allow"), ("http://h.net\n/x y\n?z", "h.net\n", "/x y\n", None, "allow"), ("", "", "", None, "allow")]
    df = spark.createDataFrame([(k, r[0], None, 1) for k, r in enumerate(rows)], "page_id long, url string, html string, node int")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(df, queries.URL_RULES).collect()}
    assert got == {k: r[1:] for k, r in enumerate(rows)}
    assert urls.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_decisions_reach_aliases(spark):
    link = '<head><LINK href="{}" rel=canonical></head>'
    rows = [
        (1, "http://a.test/1", link.format("http://bad.net/x")),
        (2, "http://a.test/2", '<meta http-equiv="refresh" content="0; url=/1">'),
        (3, "https://a.test/2#frag", None),
        (4, "http://bad.net/x", ""),
        (5, "http://c.test/", link.format("http://d.net/y")),
        (6, "http://e.example.net/en/", link.format("//d.net/y")),
        (7, "http://d.net/y", None),
        (8, "http://f.test/", "<!-- " + link.format("http://bad.net/x") + " --><script>" + link.format("http://bad.net/x") + "</script>"),
        (9, "http://g.test/", '<a href="http://bad.net/x" rel="canonicals">'),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}


@pytest.mark.parametrize(("to", "want"), [("page.html", "h.net/a/b/page.html"), ("../x", "h.net/a/x"), ("./", "h.net/a/b/"), ("..", "h.net/a/"), ("../../../../x/./y", "h.net/x/y"), ("?p=1", "h.net/a/b/c?p=1"), ("/r/../s?q=../t", "h.net/s?q=../t"), ("//O.net", "o.net"), ("HTTPS://o.net/X#f", "o.net/X"), ("a:b/c", None), ("mailto:x@y", None), ("#top", None), ("", None)])
def test_relative_targets(spark, to, want):
    got = spark.createDataFrame([("http://H.net/a/b/c?z#f", to)], "url string, t string").select(urls._node(urls.resolve(F.col("url"), F.col("t")))).first()[0]
    assert got == want


def test_relative_and_listed_aliases(spark):
    rows = [
        (1, "http://a.test/d/1", '<link rel="nofollow canonical" href="../2?x=1&amp;y=2">'),
        (2, "http://a.test/2?x=1&y=2", "<meta content='0; url=http://bad.net/' http-equiv='Refresh'>"),
        (3, "http://b.test", "<link href=next.html rel='canonical'>"),
        (4, "http://b.test/next.html", '<link rel="canonical" href="//bad.net">'),
        (5, "http://c.test/", '<link rel="noncanonical canonicals" href="//bad.net">'),
        (6, "http://bad.net", None),
        (7, "http://bad.net/", "long " * 200_000),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_aliases_match_union_find_and_sql(spark, seed):
    r = random.Random(seed)
    hosts = ["a.test", "b.test", "x.net", "example.net", "q.example.com", "w.org"]
    pages = [f"http://{r.choice(hosts)}{r.choice(['/', '/en/', '/de/', '/fr/'])}{k}" for k in range(120)]
    rows, links = [], []
    for k, url in enumerate(pages):
        to = r.choice(pages) if r.random() < 0.6 else None
        tag = r.choice(['<link rel=canonical href="{}">', "<LINK HREF='{}' rel=\"x canonical\"/>", '<meta http-equiv=refresh content="0;url={}">']) if to else "<p>"
        rows.append((k, url, "<html>" + tag.format(to)))
        if to:
            links.append((url, to))
    of = roots(pages, links)
    rules = sorted(queries.URL_RULES, key=lambda x: -len(x[1] + x[2]))

    def own(url):
        host, _, path = url[7:].partition("/")
        return next((v for v, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)), None)

    kinds = {}
    for p in pages:
        kinds.setdefault(of[p], set()).add(own(p))
    want = {k: own(p) or ("allow" if "allow" in kinds[of[p]] or "block" not in kinds[of[p]] else "block") for k, p in enumerate(pages)}
    assert len(set(want.values())) == 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.verdict for x in urls.judge_urls(df, queries.URL_RULES).collect()} == want
    duck = duckdb.connect()
    duck.register("pages", df.toPandas())
    assert {x[0]: x[4] for x in duck.execute(queries.ORACLE["op10_url_filter"]).fetchall()} == want


def plain_chats(rows):
    """Maximal conversations by comparing all with all."""
    low = lambda v: (v is not None, v if v is not None else "")
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    told = {c: [(r, x) for _, r, x in sorted(t, key=lambda y: ((y[0] is not None, y[0] or 0), low(y[1]), low(y[2])))] for c, t in convs.items()}
    out = {}
    for c, t in told.items():
        same = [d for d, u in told.items() if u == t]
        if c == min(same) and not any(len(u) > len(t) and u[: len(t)] == t for u in told.values()):
            out[c] = (len(t), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_random_chats_match_all_pairs(spark, ties):
    r = random.Random(ties)
    rows, long = [], "word " * 100_000
    for c in range(80):
        for k in range(r.randrange(1, 6)):
            rows.append((c, r.choice([1, 2, None]) if ties else k, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "ho", long if c == 3 else "hum"]), 0))
    rows += [(None, 1, "user", "hi", 0), *[(200 + c, k, "user", x, 0) for c in range(40) for k, x in enumerate("abc"[: 1 + c % 3])]]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(7) for c in ("pos", "n_same", "t1", "p1")})
    assert {x.conv_id: (x.n_turns, x.n_same, x.chat) for x in chat.format_chats(df).collect()} == plain_chats(rows)


@pytest.mark.parametrize("name", ["op1_license_scan", "op8_chat_format", "op10_url_filter"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
