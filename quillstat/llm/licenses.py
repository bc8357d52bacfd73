"""License scans in DataFrame operations only: Dice coefficient over word bigrams, pruned by size bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm._tables import lower_az, store

#: Least Dice coefficient of a match, in per cent.
DICE = 90
#: Characters of templates that may be broadcast; beyond, the joins shuffle.
BROADCAST_CHARS = 16_000_000
#: Lines that name a holder; they differ from one copy of a license to the next.
HOLDER = "(^|\\n)[^a-z0-9\\n]*copyright[ \\t]+(\\(c\\)|©|[0-9])[^\\n]*"
BLANK_LINES = "\\n([ \\t\\r]*\\n)+"
EDGES = " \t\r\n"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain."

#: (license, text): fixed values, the published texts and notices of common licenses.
TEMPLATES = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD", _BSD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license_id string, text string")


def cleaned(text: Column) -> Column:
    """A-Z lower-cased, one spelling of license, holders' lines emptied, white space at both ends removed; null is empty."""
    text = F.replace(lower_az(F.coalesce(text.cast("string"), F.lit(""))), F.lit("licence"), F.lit("license"))
    return F.trim(F.regexp_replace(text, HOLDER, "\n"), F.lit(EDGES))


def words(text: Column) -> Column:
    """Words of a cleaned text: runs of a-z and 0-9."""
    return F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")


def pairs(w: str) -> Column:
    """Pairs of neighbouring words of the column ``w``, in order."""
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(w: str) -> Column:
    """Distinct pairs of neighbouring words of the column ``w``."""
    return F.array_distinct(pairs(w))


def _anchors(template: str, dice: int) -> Column:
    """The longer word of so many bigrams that a match must have one of them; those with the longest words, as these are rare."""
    n = F.size(template)
    need = F.floor((dice * n + (199 - dice)) / (200 - dice))
    longer = F.transform(template, lambda g: F.when(F.length(F.substring_index(g, " ", 1)) >= F.length(F.substring_index(g, " ", -1)), F.substring_index(g, " ", 1)).otherwise(F.substring_index(g, " ", -1)))
    ranked = F.array_sort(F.transform(longer, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, (n - need + 1).cast("int")), lambda r: r["w"])


def _units(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda x, i: F.struct(F.lit(kind).alias("unit_kind"), (i + 1).cast("long").alias("unit_no"), x.alias("x")))


def _paragraphs() -> Column:
    return F.split("x", BLANK_LINES, -1)


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: int = DICE) -> DataFrame:
    """One row for each unit of a text and each template part nearest to it, if their Dice coefficient is ``dice`` per cent or more.

    Units are the lines of a text, its paragraphs of more than one line (blank
    lines divide them), if it has more than one paragraph, the whole of it, and spans: runs of a
    part's number of words anywhere in the text, laid so that one of the part's rare
    bigrams stands where the part has it (unit_no is the span's first word, from 1). So a
    notice amid other words of a line or paragraph is found too; spans that overlap are all returned.
    Template parts are a template's whole text (0) and, if it has more than one,
    its paragraphs (from 1). Columns: id, unit_kind (line, paragraph, text or span),
    unit_no (from 1), license_id, template_no (from 1, by license and text),
    template_part, n_shared, n_unit, n_template (distinct bigrams), dice.

    The coefficient 2s / (a + b) can reach the threshold only if the smaller set
    has at least dice / (200 - dice) of the larger one's size. Parts are listed
    by each unit size that this allows, and a unit meets the list of its own size
    by equality. A match shares so many bigrams with its part that it has one of
    any few of them; only units with the longer word of one of these are turned
    into bigrams. Texts are not shuffled while the templates are small enough
    to broadcast, which is checked; beyond that, the joins shuffle.

    Null and empty texts, and units and parts of fewer than two words, match
    nothing. Null ids are kept; repeated rows each give their matches. Other
    columns are ignored. An empty table gives an empty table. Parts that tie for a unit are all returned.
    """
    source = templates.select(F.col("license_id"), cleaned(F.col("text")).alias("x")).distinct()
    # One row a template, so numbering them in one task stays cheap.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("license_id", "x"))), lambda t, i: F.struct((i + 1).alias("template_no"), t["license_id"].alias("license_id"), t["x"].alias("x")))
    source = source.groupBy().agg(listed.alias("t")).select(F.inline("t"))
    whole = F.array(F.struct(F.lit(0).alias("template_part"), F.col("x").alias("x")))
    parts = F.when(F.size(_paragraphs()) > 1, F.transform(_paragraphs(), lambda p, i: F.struct((i + 1).alias("template_part"), p.alias("x")))).otherwise(F.array().cast("array<struct<template_part:int,x:string>>"))
    source = source.select("template_no", "license_id", F.inline(F.concat(whole, parts)))
    source = source.select("template_no", "license_id", "template_part", words(F.col("x")).alias("w"))
    source = store(source.select("*", bigrams("w").alias("template")).withColumn("n_template", F.size("template")).where("n_template > 0"), "license-templates")
    least = F.floor((dice * F.col("n_template") + (199 - dice)) / (200 - dice)).cast("int")
    most = F.floor((200 - dice) * F.col("n_template") / dice).cast("int")
    part = F.struct("license_id", "template_no", "template_part", "template", "n_template")
    by_size = store(source.select(F.explode(F.sequence(least, most)).alias("_size"), part.alias("part")).groupBy("_size").agg(F.sort_array(F.collect_list("part")).alias("_parts")), "license-sizes")
    chars = F.aggregate("_parts", F.lit(0), lambda n, p: n + F.length(F.concat_ws(" ", p["template"])))
    held = by_size.agg(F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.coalesce(F.min("_size"), F.lit(1)).alias("least")).first()
    lines = F.split("x", "\n", -1)
    several = F.filter(_units("paragraph", F.col("p")), lambda u: F.instr(u["x"], "\n") > 0)
    text = F.filter(_units("text", F.array("x")), lambda u: F.size("p") > 1)
    texts = docs.select(F.col(id_col).alias("_id"), cleaned(F.col(text_col)).alias("x"))
    units = texts.select("_id", "x", _paragraphs().alias("p"))
    units = units.select("_id", F.inline(F.concat(_units("line", lines), several, text)))
    # n distinct bigrams take n + 1 words, so 2n + 1 characters at least.
    units = units.where(F.length("x") >= 2 * held.least + 1).select("_id", "unit_kind", "unit_no", words(F.col("x")).alias("_words"))
    anchors = None
    if held.chars <= BROADCAST_CHARS:
        anchors = source.select(F.explode(_anchors("template", dice)).alias("a")).agg(F.sort_array(F.collect_set("a"))).first()[0]
        units = units.where(F.arrays_overlap("_words", F.lit(anchors or [""])))
    units = units.select("_id", "unit_kind", "unit_no", bigrams("_words").alias("_unit")).withColumn("n_unit", F.size("_unit"))
    met = units.join(F.broadcast(by_size) if held.chars <= BROADCAST_CHARS else by_size, F.col("n_unit") == F.col("_size"))
    scored = F.transform("_parts", lambda p: F.struct(p["license_id"].alias("license_id"), p["template_no"].alias("template_no"), p["template_part"].alias("template_part"), F.size(F.array_intersect("_unit", p["template"])).alias("n_shared"), p["n_template"].alias("n_template")))
    close = F.filter(scored, lambda p: 200 * p["n_shared"] >= dice * (F.col("n_unit") + p["n_template"]))
    met = met.withColumn("_close", close).where(F.size("_close") > 0)
    value = lambda p: 2 * p["n_shared"] / (F.col("n_unit") + p["n_template"])
    met = met.withColumn("_top", F.array_max(F.transform("_close", value)))
    met = met.select(F.col("_id").alias(id_col), "unit_kind", "unit_no", "n_unit", "_top", F.inline(F.filter("_close", lambda p: value(p) == F.col("_top"))))
    met = met.select(id_col, "unit_kind", "unit_no", "license_id", "template_no", "template_part", "n_shared", "n_unit", "n_template", F.col("_top").alias("dice"))
    return met.unionByName(_spans(texts, source, dice, anchors).withColumnRenamed("_id", id_col))


def _span_anchors(source: DataFrame, dice: int) -> DataFrame:
    """(g, o, m, template row): so many bigrams of each part that a match must share one, those with the longest words first, with the first place of each in the part's m words."""
    first = source.select("template_no", "template_part", "n_template", F.posexplode(pairs("w")).alias("o", "g")).groupBy("template_no", "template_part", "n_template", "g").agg(F.min("o").alias("o"))
    a, b = F.substring_index("g", " ", 1), F.substring_index("g", " ", -1)
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    by_length = Window.partitionBy("template_no", "template_part").orderBy(F.desc(F.length(longer)), longer, "g")
    need = F.floor((dice * F.col("n_template") + (199 - dice)) / (200 - dice))
    first = first.withColumn("_nth", F.row_number().over(by_length)).where(F.col("_nth") <= F.col("n_template") - need + 1)
    return first.select("template_no", "template_part", "g", "o").join(source.select("template_no", "template_part", "license_id", "template", "n_template", F.size("w").alias("m")), ["template_no", "template_part"])


def _spans(texts: DataFrame, source: DataFrame, dice: int, words_list: list[str] | None) -> DataFrame:
    """The spans of texts (_id, x) that match; ``words_list``: words of which a match has one, null where they are too many to send."""
    anchors = store(_span_anchors(source, dice), "license-anchors")
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), "_id", words(F.col("x")).alias("_w"))
    places = F.transform(pairs("_w"), lambda g, i: F.struct(i.alias("_i"), g.alias("g")))
    if words_list is not None:
        grams = anchors.agg(F.sort_array(F.collect_set("g"))).first()[0]
        rows = rows.where(F.arrays_overlap("_w", F.lit(words_list or [""])))
        places, anchors = F.filter(places, lambda s: F.array_contains(F.lit(grams or [""]), s["g"])), F.broadcast(anchors)
    rows = rows.select("_row", "_id", "_w", F.inline(places)).join(anchors, "g")
    rows = rows.withColumn("_from", F.greatest(F.col("_i") - F.col("o"), F.lit(0))).withColumn("_to", F.least(F.col("_i") - F.col("o") + F.col("m"), F.size("_w")))
    rows = rows.withColumn("_span", F.slice("_w", F.col("_from") + 1, F.col("_to") - F.col("_from"))).withColumn("_unit", bigrams("_span"))
    rows = rows.withColumn("n_unit", F.size("_unit")).withColumn("n_shared", F.size(F.array_intersect("_unit", "template"))).where(200 * F.col("n_shared") >= dice * (F.col("n_unit") + F.col("n_template")))
    rows = rows.select("_row", "_id", F.lit("span").alias("unit_kind"), (F.col("_from") + 1).cast("long").alias("unit_no"), "license_id", "template_no", "template_part", "n_shared", "n_unit", "n_template", (2 * F.col("n_shared") / (F.col("n_unit") + F.col("n_template"))).alias("dice"))
    rows = rows.dropDuplicates(["_row", "unit_no", "template_no", "template_part"])
    return rows.withColumn("_top", F.max("dice").over(Window.partitionBy("_row", "unit_no"))).where("dice = _top").drop("_row", "_top")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CLEANED = r"trim(regexp_replace(replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licence', 'license'), '(^|\n)[^a-z0-9\n]*copyright[ \t]+(\(c\)|©|[0-9])[^\n]*', chr(10), 'g'), E' \t\r\n')"

LICENSE_SQL = rf"""
with l(license_id, text) as (values {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in TEMPLATES)}),
t as (select *, row_number() over (order by license_id, x) as template_no from (select distinct license_id, {_CLEANED} as x from l)),
tp as (select *, regexp_split_to_array(x, '\n([ \t\r]*\n)+') as p from t),
parts as (select license_id, template_no, 0 as template_part, x from t union all select license_id, template_no, unnest(range(1, len(p) + 1)), unnest(p) from tp where len(p) > 1),
d as (select row_number() over () as r, doc_id, x, string_split(x, chr(10)) as l, regexp_split_to_array(x, '\n([ \t\r]*\n)+') as p from (select doc_id, {_CLEANED} as x from documents)),
units as (select r, doc_id, 'line' as unit_kind, unnest(range(1, len(l) + 1)) as unit_no, unnest(l) as x from d
  union all select * from (select r, doc_id, 'paragraph', unnest(range(1, len(p) + 1)), unnest(p) as x from d) where contains(x, chr(10))
  union all select r, doc_id, 'text', 1, x from d where len(p) > 1),
uw as (select r, doc_id, unit_kind, unit_no, string_split(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), ' ') as w from units),
ub as (select r, doc_id, unit_kind, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from uw),
tw as (select license_id, template_no, template_part, string_split(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), ' ') as w from parts),
tb as (select license_id, template_no, template_part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from tw),
m as (select ub.* exclude b, tb.* exclude b, len(list_intersect(ub.b, tb.b)) as n_shared, len(ub.b) as n_unit, len(tb.b) as n_template from ub join tb
  on 200 * least(len(ub.b), len(tb.b)) >= {DICE} * (len(ub.b) + len(tb.b)) and len(ub.b) > 0),
tg as (select license_id, template_no, template_part, w, i, w[i] || ' ' || w[i + 1] as g from (select *, unnest(range(1, len(w))) as i from tw)),
tf as (select license_id, template_no, template_part, g, min(i) as o, max(len(w)) as m, max(case when length(split_part(g, ' ', 1)) >= length(split_part(g, ' ', 2)) then split_part(g, ' ', 1) else split_part(g, ' ', 2) end) as longer from tg group by all),
ta as (select *, count(*) over (partition by template_no, template_part) as n, row_number() over (partition by template_no, template_part order by length(longer) desc, longer, g) as nth from tf),
an as (select * from ta where nth <= n - floor(({DICE} * n + {199 - DICE}) / {200 - DICE}) + 1),
dw as (select r, doc_id, string_split(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), ' ') as w from d),
dg as (select r, doc_id, w, i, w[i] || ' ' || w[i + 1] as g from (select *, unnest(range(1, len(w))) as i from dw)),
sp as (select distinct dg.r, dg.doc_id, greatest(dg.i - an.o + 1, 1) as f, least(dg.i - an.o + an.m, len(dg.w)) as e, license_id, template_no, template_part from dg join an on dg.g = an.g),
sb as (select sp.r, sp.doc_id, 'span' as unit_kind, f as unit_no, license_id, template_no, template_part, list_distinct(list_transform(range(f, e), lambda i: w[i] || ' ' || w[i + 1])) as u from sp join dw on sp.r = dw.r),
sm as (select sb.* exclude u, len(list_intersect(u, tb.b)) as n_shared, len(u) as n_unit, len(tb.b) as n_template from sb join tb on sb.template_no = tb.template_no and sb.template_part = tb.template_part),
every as (select r, doc_id, unit_kind, unit_no, license_id, template_no, template_part, n_shared, n_unit, n_template from m union all select r, doc_id, unit_kind, unit_no, license_id, template_no, template_part, n_shared, n_unit, n_template from sm)
select doc_id, unit_kind, unit_no::bigint as unit_no, license_id, template_no::int as template_no, template_part::int as template_part, n_shared::int as n_shared, n_unit::int as n_unit, n_template::int as n_template, 2.0::double * n_shared / (n_unit + n_template) as dice from every where 200 * n_shared >= {DICE} * (n_unit + n_template)
qualify dice = max(dice) over (partition by r, unit_kind, unit_no)
"""
