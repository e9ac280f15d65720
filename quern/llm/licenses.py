"""License recognition by sentence rules, with DataFrame functions only.

A text is cut into sentences, each sentence is normalised and mapped to the identifier of a known licence sentence, and the
sequence of identifiers is matched against ordered licence rules: a rule is a sequence of identifiers, the first rule that
matches at a place wins it, and what no rule takes stays unknown.  Everything happens within a row; there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a licence's name in a sentence that grants it.
GRANT = r"(?:(?:this|the) .{1,60} (?:is|are) )?(?:dual[ -])?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
LICENCE, LATER = r"(?: licen[sc]e)?", r",? (?:or (?:\(at your option\) )?(?:any )?(?:later|newer)(?: version)?)"
GPL = r"(?:gnu general public licen[sc]e|gnu gpl|gpl)"
LGPL = r"(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl)"
AGPL = r"(?:gnu affero general public licen[sc]e|gnu agpl|agpl)"
FREE = r"this (?:program|library|software|file|package) is free software[:;,] you can redistribute it and/or modify it under the terms of (?:the )?"


def _version(number: str) -> str:
    """A version after a name: ``version 2``, ``v2.0``, ``-2.0`` or just the number."""
    return rf",?(?: ?-? ?(?:version |v\.? ?)|[ -])?{number}(?:\.0)?"


#: Identifiers of licences as they stand after SPDX-License-Identifier.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "MS-PL", "OFL-1.1", "PostgreSQL",
    "Unlicense", "WTFPL", "Zlib",
)

#: Identifiers and patterns of licence sentences, matched against a whole normalised sentence (lower case, single
#: spaces, straight quotes, no closing punctuation).  The first that matches counts, so special wordings stand before general ones.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache2", GRANT + r"apache(?: software)?" + LICENCE + _version("2") + LICENCE + r"(?: \(the \"licen[sc]e\"\))?"),
    ("apache2_grant", r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    ("apache2_copy", r"you may obtain a copy of the licen[sc]e at .{0,80}"),
    ("apache2_asis", r"unless required by applicable law or agreed to in writing, (?:software|the work) distributed under the licen[sc]e is distributed on an \"as is\" basis.*"),
    ("mit", GRANT + r"(?:mit|expat)" + LICENCE),
    ("mit_grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software .*"),
    ("mit_notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("mit_asis", r"the software is provided \"as is\", without warranty of any kind.*"),
    ("gpl2_later", GRANT + GPL + _version("2") + LICENCE + LATER),
    ("gpl3_later", GRANT + GPL + _version("3") + LICENCE + LATER),
    ("gpl2", GRANT + GPL + _version("2") + LICENCE),
    ("gpl3", GRANT + GPL + _version("3") + LICENCE),
    ("gpl3_free", FREE + GPL + r".* version 3 .*later version"),
    ("gpl2_only_free", FREE + GPL + r"(?:,? version 2|.*[;:,] version 2)(?!.*later version).*"),
    ("gpl3_only_free", FREE + GPL + r"(?:,? version 3|.*[;:,] version 3)(?!.*later version).*"),
    ("gpl_free", FREE + GPL + r".*"),
    ("gpl_warranty", r"this (?:program|library|software|file|package) is distributed in the hope that it will be useful, but without any warranty.*"),
    ("lgpl21", GRANT + LGPL + _version(r"2\.1") + LICENCE + rf"(?:{LATER})?"),
    ("lgpl3", GRANT + LGPL + _version("3") + LICENCE + rf"(?:{LATER})?"),
    ("lgpl3_free", FREE + LGPL + r".* version 3 .*later version"),
    ("lgpl21_free", FREE + LGPL + r".* version 2\.1 .*later version"),
    ("agpl3", GRANT + AGPL + _version("3") + LICENCE + rf"(?:{LATER})?"),
    ("agpl3_free", FREE + AGPL + r".* version 3 .*later version"),
    ("mpl2", r"(?:this source code form is subject to the terms of the |" + GRANT + r")(?:mozilla public licen[sc]e|mpl)" + _version("2") + LICENCE),
    ("mpl2_copy", r"if a copy of the mpl was not distributed with this file, you can obtain one at .{0,80}"),
    ("isc", GRANT + r"isc" + LICENCE),
    ("isc_grant", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc0_grant", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_asis", r"the software is provided \"as is\" and .{1,40} disclaims all warranties.*"),
    ("bsd_intro", r"redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("bsd_source", r"(?:\(?[\da-z][.)] |[*o] )?redistributions of source code must retain the (?:above )?copyright notice.*"),
    ("bsd_binary", r"(?:\(?[\da-z][.)] |[*o] )?redistributions in binary form must reproduce the (?:above )?copyright notice.*"),
    ("bsd_names", r"(?:\(?[\da-z][.)] |[*o] )?(?:neither the names? of .*|the names? of .* may not) (?:may )?be used to endorse or promote products.*"),
    ("bsd_asis", r"this software is provided by .{1,80} \"as is\".*"),
    ("bsd2", GRANT + r"(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd)" + LICENCE),
    ("bsd3", GRANT + r"(?:bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd)" + LICENCE),
    ("unlicense_domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense_free", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.*"),
    ("unlicense", GRANT + r"unlicen[sc]e"),
    ("boost", GRANT + r"(?:boost software licen[sc]e|bsl)" + _version("1") + r"(?: \(see .{0,120})?"),
    ("boost_grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation .*"),
    ("zlib_asis", r"this software is provided ['\"]as[ -]is['\"],? without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose,? including commercial applications.*"),
    ("cc0", r"(?:to the extent possible under law, .{1,120} (?:has|have) (?:waived|dedicated) all copyright and related or neighboring rights to .*|" + GRANT + r"(?:cc0|creative commons zero)(?:[ -]1\.0)?(?: universal)?" + LICENCE + ")"),
    ("ccbync", GRANT + r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)(?:[ -]\d(?:\.\d)?)?(?: international)?" + LICENCE),
    ("ccbysa", GRANT + r"(?:cc[ -]by-sa|creative commons attribution-sharealike)(?:[ -]\d(?:\.\d)?)?(?: international)?" + LICENCE),
    ("ccby", GRANT + r"(?:cc[ -]by|creative commons attribution)(?:[ -]\d(?:\.\d)?)?(?: international)?" + LICENCE),
    *((f"spdx_{x.lower()}", r"spdx-licen[sc]e-identifier: " + x.lower().replace(".", r"\.").replace("-or-later", r"(?:-or-later|\+)").replace("-only", r"(?:-only)?")) for x in SPDX),
    ("copyright", r"(?:copyright|\(c\)|©) .{1,80}"),
    ("rights", r"all rights reserved"),
)


@dataclass(frozen=True)
class Rule:
    """A licence and the identifiers of its sentences in order; the first rule of a list that matches wins."""

    license: str
    ids: tuple[str, ...]


#: Ordered licence rules, longer ones first.
RULES: tuple[Rule, ...] = (
    Rule("BSD-3-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis")),
    Rule("BSD-2-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_asis")),
    Rule("Apache-2.0", ("apache2", "apache2_grant", "apache2_copy", "apache2_asis")),
    Rule("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    Rule("MIT-0", ("mit_grant", "mit_asis")),
    Rule("GPL-3.0-or-later", ("gpl3_free", "gpl_warranty")),
    Rule("GPL-2.0-only", ("gpl2_only_free", "gpl_warranty")),
    Rule("GPL-3.0-only", ("gpl3_only_free", "gpl_warranty")),
    Rule("GPL-2.0-or-later", ("gpl_free", "gpl_warranty")),
    Rule("LGPL-3.0-or-later", ("lgpl3_free", "gpl_warranty")),
    Rule("LGPL-2.1-or-later", ("lgpl21_free", "gpl_warranty")),
    Rule("AGPL-3.0-or-later", ("agpl3_free", "gpl_warranty")),
    Rule("MPL-2.0", ("mpl2", "mpl2_copy")),
    Rule("ISC", ("isc_grant", "isc_asis")),
    Rule("0BSD", ("isc0_grant", "isc_asis")),
    Rule("Unlicense", ("unlicense_domain", "unlicense_free")),
    Rule("BSL-1.0", ("boost_grant", "mit_asis")),
    Rule("Zlib", ("zlib_asis", "zlib_grant")),
    Rule("Apache-2.0", ("apache2",)),
    Rule("MIT", ("mit",)),
    Rule("GPL-3.0", ("gpl3",)),
    Rule("GPL-2.0", ("gpl2",)),
    Rule("GPL-3.0-or-later", ("gpl3_later",)),
    Rule("GPL-2.0-or-later", ("gpl2_later",)),
    Rule("LGPL-2.1", ("lgpl21",)),
    Rule("LGPL-3.0", ("lgpl3",)),
    Rule("AGPL-3.0", ("agpl3",)),
    Rule("MPL-2.0", ("mpl2",)),
    Rule("ISC", ("isc",)),
    Rule("BSD-2-Clause", ("bsd2",)),
    Rule("BSD-3-Clause", ("bsd3",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("BSL-1.0", ("boost",)),
    Rule("CC0-1.0", ("cc0",)),
    Rule("CC-BY-NC-4.0", ("ccbync",)),
    Rule("CC-BY-SA-4.0", ("ccbysa",)),
    Rule("CC-BY-4.0", ("ccby",)),
    *(Rule(x, (f"spdx_{x.lower()}",)) for x in SPDX),
)

#: Sentences that are also known where they run over several lines or hold ``;``.
PIECES = tuple(x for x in SENTENCES if x[0] not in ("copyright", "rights"))

#: Comment and list marks at the start of a line.
MARKS = r"[\s#/*%>;:-]*"
#: Starts of sentences that begin a new piece on a new line even if the line before isn't closed.
OPENINGS = r"(?i:(?:licensed|released|available) under|spdx-licen[sc]e|you may not use this|you may obtain|unless required by|permission is (?:hereby )?granted|permission to use|the above copyright notice and|the software is provided|this (?:program|library|software|source code form) is|this is free and|anyone is free to|if a copy of the mpl|to the extent possible under|redistributions? (?:of|in|and)|neither the name|copyright (?:\(c\)|©|\d)|\(c\)|©|all rights reserved)"
#: Pieces end at blank lines, at sentence ends (not after ``v.``), at a colon that ends a line, and before openings.
HARD = rf"[ \t]*(?:\r?\n|\r)[ \t#/*%>;:-]*[\r\n]\s*|(?<=[.!?])(?<![ ,][vV]\.)\s+|(?<=:)[ \t]*[\r\n]+|[\r\n]+(?={MARKS}{OPENINGS})"

#: A sentence without one of these is no licence sentence, so most texts are passed over after one search.
HINT = r"(?i)licen[sc]e|copyright|\(c\)|©|warrant|redistribut|permission|free software|as is|reserved|endorse|released under|distributed under|available under|unencumbered|public domain"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that hold a hint word.

    Sentences end at line breaks and at ``.``, ``!``, ``?`` or ``;`` before white space; comment marks at the edges, closing
    punctuation and case go, runs of white space are one space.
    """
    cut = F.split(text, r"[\r\n]+|(?<=[.!?;])\s+")
    return F.filter(F.transform(F.filter(cut, lambda s: s.rlike(HINT)), _clean), lambda s: s != "")


def _clean(s: Column) -> Column:
    straight = F.translate(s, "“”„‘’", "\"\"\"''")
    return F.lower(F.regexp_replace(F.regexp_replace(straight, r"\s+", " "), r"^[\s#/*%>;:-]+|[\s.!?;:*/-]+$", ""))


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's hinted sentences, of sentences that run over lines too.

    A piece whose lines joined, without comment marks, are a known sentence is that; if not, each part up to a ``;`` is tried
    so, and what is left is read line by line.
    """

    def known(piece: Column, other) -> Column:
        name = F.array(identify(_clean(F.regexp_replace(piece, rf"\s*[\r\n]{MARKS}", " ")), PIECES))
        return F.flatten(F.transform(name, lambda x: F.when(x != "unknown", F.array(x)).otherwise(other(piece))))

    lines = lambda p: F.transform(sentences(p), lambda s: identify(s))
    parts = lambda p: F.flatten(F.transform(F.split(p, r"(?<=;)\s+"), lambda q: known(q, lines)))
    linked = F.regexp_replace(text, rf"(?i)(copy of the licen[sc]e at|can obtain one at){MARKS}(https?://)", "$1 $2")
    pieces = F.filter(F.split(linked, HARD), lambda p: p.rlike(HINT) | p.rlike(r"(?i)redistribution|applicable\s|of the mpl|anyone is free to"))
    return F.flatten(F.transform(pieces, lambda p: known(p, parts)))


def identify(sentence: Column, known: tuple[tuple[str, str], ...] = SENTENCES) -> Column:
    """The identifier of the first known sentence that is the whole of this one; ``unknown`` otherwise."""
    out = F.lit("unknown")
    for name, pattern in reversed(known):
        out = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def match_rules(ids: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The licences that ordered rules find in an array of identifiers, in rule order, each once.

    The identifiers are joined to one string and each rule cuts what it matches out of it, so an identifier serves one rule.
    """
    left = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("|"))), "|"))
    marks = left
    for k, rule in enumerate(rules):
        ids = r"\|\|".join(rule.ids).replace(".", r"\.")
        marks = F.regexp_replace(marks, rf"\|{ids}\|", f"|={k}|")
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(marks, F.lit(r"=(\d+)\|"), 1), lambda x: x.cast("int"))))
    names = F.array(*[F.lit(r.license) for r in rules])
    return F.array_distinct(F.transform(found, lambda k: F.element_at(names, k + 1)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_unknown), one row per input row.

    sentence_ids are the identifiers of the hinted sentences in order, licenses those that rules find, n_unknown the hinted
    sentences that no rule knows.  Null, empty and plain texts have empty arrays and 0.  Repeated rows are judged alike.
    """
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    ids = F.when(text.rlike(HINT), sentence_ids(text)).otherwise(none)
    out = docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids"))
    some = F.size("sentence_ids") > 0
    return out.select("doc_id", "sentence_ids", F.when(some, match_rules(F.col("sentence_ids"))).otherwise(none).alias("licenses"), F.size(F.filter("sentence_ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"))
