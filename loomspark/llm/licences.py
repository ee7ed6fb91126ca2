"""License scans: texts brought to a canonical form and looked up by digest among known licences and notices."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.spans import let

#: Fixed values: (licence, whether its material may be used to train, known text). Public notices and short licence texts.
KNOWN = (
    ("MIT", "allow", "Released under the MIT License."),
    ("MIT", "allow", "Licensed under the MIT License."),
    ("MIT", "allow", "This project is licensed under the terms of the MIT license."),
    ("MIT", "allow", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "allow", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "allow", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "allow", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "allow", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "allow", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "review", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "review", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "review", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "review", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-4.0", "allow", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "review", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "forbid", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "forbid", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "allow", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "forbid", "All rights reserved."),
    ("proprietary", "forbid", "Proprietary and confidential."),
    (
        "ISC",
        "allow",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "MIT",
        "allow",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)
#: What file headers say of a licence, wherever lines break: from the first word that tells it apart to the last.
HEADERS = (
    ("Apache-2.0", "allow", 'Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("Apache-2.0", "allow", 'Apache License, Version 2.0 (the "License"); you may not use this work except in compliance with the License'),
    ("MIT", "allow", "Licensed under the MIT License. See License.txt in the project root"),
    ("MIT", "allow", "source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("BSD-style", "allow", "source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSL-1.0", "allow", "Distributed under the Boost Software License, Version 1.0"),
    ("MPL-2.0", "review", "Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-1.0", "review", "terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "review", "terms of the Eclipse Public License 2.0 which is available at"),
    ("GPL-2.0", "review", "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "review", "terms of the GNU General Public License as published by the Free Software Foundation; version 2"),
    ("GPL-2.0", "review", "terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "review", "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "review", "terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("LGPL-2.0", "review", "terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "review", "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "review", "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "review", "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
)
#: What introduces an expression of licence identifiers, and the parts of one.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"
SPDX_PARTS = r"[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?|[()]"
#: Words by which a place where a long text may begin or end is told: each text of ``full`` has at least so many.
ANCHOR = 5
#: Spellings of a word that count as one.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "authorise": "authorize",
    "authorised": "authorized",
    "copyrightholder": "copyright holder",
    "favour": "favor",
    "https": "http",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "neighbouring": "neighboring",
    "organisation": "organization",
    "organisations": "organizations",
    "programme": "program",
    "programmes": "programs",
    "sublicence": "sublicense",
}
#: Lines that name a holder or a year, left out before the digest.
COPYRIGHT = r"(?i)^[^\p{L}\p{N}]*(?:copyright\b|\(c\)|©|portions copyright\b)"

#: Files of ``license_texts`` that hold full public texts, their names and whether they may be used to train. MIT and ISC are in KNOWN.
FULL = {
    "0BSD": ("0BSD", "allow"),
    "Apache-2.0": ("Apache-2.0", "allow"),
    "Artistic-1.0": ("Artistic-1.0", "review"),
    "BSD-2-Clause": ("BSD-2-Clause", "allow"),
    "BSD-3-Clause": ("BSD-3-Clause", "allow"),
    "BSL-1.0": ("BSL-1.0", "allow"),
    "CC0-1.0": ("CC0-1.0", "allow"),
    "GFDL-1.3": ("GFDL-1.3", "review"),
    "GPL-1": ("GPL-1.0", "review"),
    "GPL-2": ("GPL-2.0", "review"),
    "GPL-3": ("GPL-3.0", "review"),
    "LGPL-2": ("LGPL-2.0", "review"),
    "LGPL-2.1": ("LGPL-2.1", "review"),
    "LGPL-3": ("LGPL-3.0", "review"),
    "MPL-1.1": ("MPL-1.1", "review"),
    "MPL-2.0": ("MPL-2.0", "review"),
    "OFL-1.1": ("OFL-1.1", "review"),
    "Unlicense": ("Unlicense", "allow"),
    "WTFPL": ("WTFPL", "allow"),
    "Zlib": ("Zlib", "allow"),
}
#: Canonical lines that only name a licence, left out of whole texts.
TITLES = (
    "0bsd license",
    "bsd 2 clause license",
    "bsd 3 clause license",
    "bsd license",
    "bsd zero clause license",
    "isc license",
    "isc license isc",
    "mit license",
    "mit license mit",
    "new bsd license",
    "simplified bsd license",
    "the bsd 2 clause license",
    "the bsd 3 clause license",
    "the isc license",
    "the mit license",
    "the mit license mit",
    "the unlicense",
    "the zlib license",
    "zero clause bsd",
    "zlib license",
)
#: Lines that name a holder, also those that end in "All rights reserved.", but not lines of a licence that begin by the word.
HOLDER = r"(?i)^[^A-Za-z0-9]*(?:(?:portions )?copyright\b(?!.*\bnotice).*(?:\d{4}|\(c\)|©|<year>|\[y+\]|\[year\]|all rights reserved)|©|\(c\) *(?:copyright *)?(?:\d{4}|<year>)|all rights reserved\W*$)"
#: Policies, the strictest last.
POLICIES = ("none", "allow", "review", "forbid")


def _folded(line: Column) -> Column:
    """Lower case, words parted by single blanks, one spelling each."""
    pairs = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    words = F.split(F.lower(line), r"[^\p{L}\p{N}]+")
    return F.trim(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " "))


def lines_of(text: Column) -> Column:
    """Array of structs (raw, words) of the lines of a text."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), _folded(x).alias("words")))


def canonical_lines(lines: Column) -> Column:
    """The words of the lines that aren't empty; lines that name a holder are."""
    named = lambda x: x.rlike(COPYRIGHT) & ~x.rlike(r"(?i)all rights reserved\W*$|notice")
    return F.filter(F.transform(lines, lambda x: F.when(named(x["raw"]), "").otherwise(x["words"])), lambda x: x != "")


def body(lines: Column) -> Column:
    """The words of a text without its titles and holders."""
    kept = F.filter(lines, lambda x: (x["words"] != "") & ~x["words"].isin(*TITLES) & ~x["raw"].rlike(HOLDER))
    return F.concat_ws(" ", F.transform(kept, lambda x: x["words"]))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def full_texts() -> list[tuple[str, str, str]]:
    """Licence, policy and text of the headers and full texts, those with an appendix also without it."""
    out = [row for row in KNOWN if len(row[2]) > 500] + list(HEADERS)
    for file, (name, policy) in FULL.items():
        text = (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text("utf-8")
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        out += [(name, policy, x) for x in ([text, text[: end.end()], text[: end.start()]] if end else [text])]
    return out


def known(spark: SparkSession, texts=KNOWN, full=None) -> DataFrame:
    """digest, words, full, license, policy (its place in POLICIES): a row per canonical text of the lists. Of the full texts
    the words stand by, without titles and holders; of several with the same digest the strictest policy holds."""
    rows = [(*row, False) for row in texts] + [(*row, True) for row in (full_texts() if full is None else full)]
    rows = spark.createDataFrame(rows, "license string, policy string, text string, full boolean").select("*", lines_of(F.col("text")).alias("lines"))
    words = F.when(F.col("full"), body(F.col("lines"))).otherwise(F.concat_ws(" ", canonical_lines(F.col("lines"))))
    rank = F.array_position(F.array(*map(F.lit, POLICIES)), F.col("policy")) - 1
    rows = rows.select(words.alias("words"), "full", "license", rank.alias("policy"))
    rows = rows.groupBy(digest(F.col("words")).alias("digest"), "words").agg(
        F.max("full").alias("full"), F.min("license").alias("license"), F.max("policy").cast("int").alias("policy")
    )
    parts = F.split("words", " ")
    return rows.select("*", F.size(parts).alias("n"), _hashed(parts, F.lit(1)).alias("head"), _hashed(parts, F.greatest(F.size(parts) - ANCHOR + 1, F.lit(1))).alias("tail"))


def _hashed(words: Column, start: Column) -> Column:
    """Hash of the ANCHOR words from a place on, which counts from 1."""
    return F.xxhash64(F.array_join(F.slice(words, start, F.lit(ANCHOR)), " "))


def among(text: Column, anchors: list[tuple[str, int, int, int]]) -> Column:
    """Array of digests of the runs of words of a text that may be one of the known texts, given as (words, n, head, tail);
    null where there is none. The text's words are parted by single blanks.

    A known text is looked for where its first ANCHOR words stand, and only where its last ones stand at its length; so the
    work grows with the text, not with the list. Whether the run is the known text its digest tells. A run that is all of the
    text is left out.
    """
    if short := [w for w, n, _, _ in anchors if n < ANCHOR]:
        raise ValueError(f"texts to be found among others need {ANCHOR} words: {short[:3]}")
    if not anchors:
        return F.lit(None).cast("array<string>")
    firsts, seconds = (sorted({w.split(" ")[k] for w, *_ in anchors}) for k in (0, 1))
    heads: dict[int, set[tuple[int, int]]] = {}
    for _, n, head, tail in anchors:
        heads.setdefault(head, set()).add((n, tail))
    ends = lambda pairs: F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).cast("long").alias("tail")) for n, t in sorted(pairs)])
    ends_of = F.create_map(*[x for head, pairs in heads.items() for x in (F.lit(head).cast("long"), ends(pairs))])

    def runs(words: Column) -> Column:
        places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(firsts) & F.get(words, i + 1).isin(seconds), i + 1)))
        fits = lambda i, e: (e["n"] < F.size(words)) & (_hashed(words, i + e["n"] - ANCHOR) == e["tail"])
        at = lambda i: F.filter(F.try_element_at(ends_of, _hashed(words, i)), lambda e: fits(i, e))
        found = F.transform(places, lambda i: F.transform(at(i), lambda e: digest(F.array_join(F.slice(words, i, e["n"]), " "))))
        return F.flatten(F.array_compact(found))

    return let(F.split(text, " "), runs)


def spdx_key(identifier: Column) -> Column:
    """An identifier without what says that later versions hold or don't, in lower case."""
    return F.regexp_replace(F.lower(identifier), r"(?:\+|-only|-or-later)$", "")


def spdx(expression: Column, ranks: dict[str, int]) -> Column:
    """Struct of ids, the keys of the identifiers of an expression, and rank, the place in POLICIES that follows from it.

    ``OR`` takes the mildest of its sides, ``AND``, which binds closer, the strictest; what follows ``WITH`` is an exception and
    changes nothing. An identifier without a rank counts as ``review``. The expression ends where its grammar does; rank is null
    where no identifier comes first. A stack of open brackets is folded over the parts: (best of the sides of OR, strictest so far).
    """
    known_ranks = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    frame = "struct<best:int,now:int>"
    start = F.from_json(
        F.lit('{"outer":[],"best":null,"now":null,"want":true,"with":false,"done":false,"ids":[]}'),
        f"outer array<{frame}>, best int, now int, want boolean, with boolean, done boolean, ids array<string>",
    )

    def state(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, s[k]).alias(k) for k in ("outer", "best", "now", "want", "with", "done", "ids")])

    def step(s: Column, part: Column) -> Column:
        word, yes, no, none = F.lower(part), F.lit(True), F.lit(False), F.lit(None).cast("int")
        key = spdx_key(part)
        rank = F.coalesce(F.try_element_at(known_ranks, key), F.lit(POLICIES.index("review")))
        opened = F.concat(s["outer"], F.array(F.struct(s["best"].alias("best"), s["now"].alias("now"))))
        last = F.get(s["outer"], F.size(s["outer"]) - 1)
        closed = F.slice(s["outer"], F.lit(1), F.greatest(F.size(s["outer"]) - 1, F.lit(0)))
        operand = (
            F.when(word == "(", state(s, outer=opened, best=none, now=none))
            .when(word.isin(")", "and", "or", "with"), state(s, done=yes))
            .otherwise(state(s, now=F.greatest(s["now"], rank), want=no, ids=F.concat(s["ids"], F.array(key))))
        )
        operator = (
            F.when(word == "and", state(s, want=yes))
            .when(word == "or", state(s, best=F.least(s["best"], s["now"]), now=none, want=yes))
            .when(word == "with", state(s, **{"with": yes}))
            .when((word == ")") & (F.size(s["outer"]) > 0), state(s, outer=closed, best=last["best"], now=F.greatest(last["now"], F.least(s["best"], s["now"]))))
            .otherwise(state(s, done=yes))
        )
        return F.when(s["done"], s).when(s["with"], state(s, **{"with": no})).when(s["want"], operand).otherwise(operator)

    def ended(s: Column) -> Column:
        # Brackets that stay open close at the end.
        up = lambda value, o: F.least(o["best"], F.greatest(o["now"], value))
        rank = F.aggregate(F.reverse(s["outer"]), F.least(s["best"], s["now"]), up)
        return F.struct(s["ids"].alias("ids"), rank.alias("rank"))

    return F.aggregate(F.regexp_extract_all(expression, F.lit(SPDX_PARTS), F.lit(0)), start, step, ended)


def scanned(docs: DataFrame, texts=KNOWN, full=None) -> DataFrame:
    """A row for each row of docs: doc_id, license (of the whole text, or null), notices (of lines, of headers and full texts that
    stand among others, and of SPDX identifiers; sorted and comma-joined, maybe empty), policy (forbid, review, allow or none; the
    strictest that was found, where an SPDX expression counts as a whole).

    Each text gives a digest for the whole, one for the whole without titles and holders, and one for each distinct line;
    they meet the known digests in a hash join, and only what was found is shuffled. A known full text or header that stands among
    other words, whatever line breaks, titles and holders are about it, gives its digest as well (``among``), and each identifier
    of an SPDX expression that of its key; identifiers are known by the names of the licences listed. Null texts hold nothing.
    Equal rows give equal rows. Other columns of docs are not read. The list of known texts goes to all tasks:
    it may have 10,000 texts and 10 MB at most.
    """
    spark = docs.sparkSession
    table = known(spark, texts, full).collect()  # the list given, whose size is checked here
    if len(table) > 10_000 or sum(len(r["words"]) for r in table) > 10_000_000:
        raise ValueError("the list of known licences is too long to go to all tasks")
    names: dict[str, tuple[str, int]] = {}
    for r in sorted(table, key=lambda r: r["policy"]):
        names[r["license"].lower()] = (r["license"], r["policy"])
    listed = spark.createDataFrame([(r["digest"], r["license"], r["policy"]) for r in table], "digest string, license string, policy int")
    listed = listed.unionByName(
        spark.createDataFrame([(f"spdx {key}", *row) for key, row in names.items()], "words string, license string, policy int").select(
            digest(F.col("words")).alias("digest"), "license", "policy"
        )
    )
    anchors = sorted({(r["words"], r["n"], r["head"], r["tail"]) for r in table if r["full"]})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.when(text.rlike(SPDX), F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)))
    said = F.transform(said, lambda x: spdx(x, {key: policy for key, (_, policy) in names.items()}))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h"), lines_of(text).alias("lines"), said.alias("said"))
    keyed = keyed.select("doc_id", "h", "said", canonical_lines(F.col("lines")).alias("lines"), body(F.col("lines")).alias("body"))
    mark = lambda part, value, rank=F.lit(None): F.struct(F.lit(part).alias("part"), value.alias("digest"), rank.cast("int").alias("rank"))
    nothing = F.array().cast("array<struct<part:int,digest:string,rank:int>>")
    marks = F.concat(
        F.array(mark(0, digest(F.concat_ws(" ", "lines"))), mark(0, digest(F.col("body")))),
        F.transform(F.array_distinct("lines"), lambda x: mark(1, digest(x))),
        F.coalesce(F.transform(F.array_distinct(among(F.col("body"), anchors)), lambda x: mark(1, x)), nothing),
        F.coalesce(F.flatten(F.transform("said", lambda x: F.transform(x["ids"], lambda i: mark(1, digest(F.concat(F.lit("spdx "), i)), x["rank"])))), nothing),
    )
    each = keyed.select("doc_id", "h", F.explode(marks).alias("m")).select("doc_id", "h", "m.part", F.col("m.digest").alias("mark"), "m.rank")
    hits = each.join(F.broadcast(listed), F.col("mark") == F.col("digest"))
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).agg(
        F.min(F.when(F.col("part") == 0, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == 1, F.col("license")))), ",").alias("notices"),
        F.max(F.coalesce("rank", "policy")).alias("rank"),
    )
    ids = docs.select("doc_id", F.xxhash64(text).alias("h"))
    joined = ids.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    policy = F.get(F.array(*map(F.lit, POLICIES)), F.coalesce("rank", F.lit(0)))
    return joined.select("doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"), policy.alias("policy"))


def duckdb_sql(texts=KNOWN, full=None) -> str:
    """The same lookup for DuckDB, over canonical texts instead of their digests; long texts are looked for among others by
    ``contains``. SPDX expressions aren't worked out: a line that is one of ``texts`` is all that is found of them."""
    quoted = lambda row: "('" + "', '".join(x.replace("'", "''") for x in row) + "')"
    values = ", ".join([quoted((*row, "0")) for row in texts] + [quoted((*row, "1")) for row in (full_texts() if full is None else full)])
    spelled = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EQUIVALENT.items()) + " ELSE w END"
    split = r"string_split(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"
    words = f"trim(array_to_string(list_transform({split}, lambda w: {spelled}), ' '))"
    folded = f"list_transform(string_split(t, chr(10)), lambda x: {{'raw': x, 'words': {words}}})"
    dropped = r"(?i)^[^\p{L}\p{N}]*(?:copyright\b|\(c\)|©|portions copyright\b)"
    named = rf"regexp_matches(x.raw, '{dropped}') AND NOT regexp_matches(x.raw, '(?i)all rights reserved\W*$|notice')"
    # The holder's lines without a look-ahead: a copyright line that speaks of no notice, or one of the other forms.
    year = r"(?:\d{4}|\(c\)|©|<year>|\[y+\]|\[year\]|all rights reserved)"
    begins = r"(?i)^[^A-Za-z0-9]*(?:portions )?copyright\b"
    other = r"(?i)^[^A-Za-z0-9]*(?:©|\(c\) *(?:copyright *)?(?:\d{4}|<year>)|all rights reserved\W*$)"
    holder = rf"((regexp_matches(x.raw, '{begins}.*{year}') AND NOT regexp_matches(x.raw, '{begins}.*\bnotice')) OR regexp_matches(x.raw, '{other}'))"
    titles = ", ".join(f"'{x}'" for x in TITLES)
    lines = f"list_filter(list_transform(ls, lambda x: CASE WHEN {named} THEN '' ELSE x.words END), lambda y: y <> '')"
    body_of = f"array_to_string(list_transform(list_filter(ls, lambda x: x.words <> '' AND x.words NOT IN ({titles}) AND NOT {holder}), lambda x: x.words), ' ')"
    return f"""
    WITH source(license, policy, t, long) AS (VALUES {values}),
    parsed AS (SELECT license, policy, long, {folded} AS ls FROM source),
    known AS (SELECT canon, max(long) AS long, min(license) AS license, max(CASE policy WHEN 'forbid' THEN 3 WHEN 'review' THEN 2 ELSE 1 END) AS rank FROM (
        SELECT license, policy, long, CASE long WHEN '1' THEN {body_of} ELSE array_to_string({lines}, ' ') END AS canon FROM parsed) GROUP BY canon),
    docs AS (SELECT doc_id, text, {folded} AS ls FROM (SELECT DISTINCT doc_id, text, coalesce(text, '') AS t FROM documents)),
    canonical AS (SELECT doc_id, text, {lines} AS lines, {body_of} AS body FROM docs),
    marks AS (SELECT doc_id, text, 0 AS part, array_to_string(lines, ' ') AS canon FROM canonical
        UNION ALL SELECT doc_id, text, 0, body FROM canonical
        UNION ALL SELECT doc_id, text, 1, unnest(list_distinct(lines)) FROM canonical
        UNION ALL SELECT doc_id, text, 1, canon FROM canonical, known
            WHERE long = '1' AND length(body) > length(canon) AND contains(' ' || body || ' ', ' ' || canon || ' ')),
    hits AS (SELECT doc_id, text, min(license) FILTER (part = 0) AS license, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (part = 1) AS notices,
        max(rank) AS rank FROM marks JOIN known USING (canon) GROUP BY doc_id, text)
    SELECT d.doc_id, h.license, coalesce(h.notices, '') AS notices, ['none', 'allow', 'review', 'forbid'][coalesce(rank, 0) + 1] AS policy
    FROM documents d LEFT JOIN hits h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text IS NOT DISTINCT FROM h.text"""
