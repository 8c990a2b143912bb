"""Licence scan by canonical digests, in DataFrame functions only.

A text is made canonical (below), and SHA-256 of that is looked up among the digests of known licences: by whole text,
and, so that a notice inside a longer document is found too, by each of its lines. Known texts go through the same
expressions, so they may be given in any spelling.

Canonical form, in this order:
1. lower case (A-Z and what the engine's lower() maps);
2. lines that state a copyright go: they begin with the copyright sign, or with "copyright" or "(c)" before a year, a
   place for one in brackets, "by" or the sign; so does "all rights reserved";
3. equivalent spellings become one: EQUIVALENTS, as whole words;
4. everything but a-z and 0-9 becomes one blank between words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import license_texts
from lintlake.llm.common import pick

# Spellings that licence guidelines hold to be the same, each pair as (variant, kept).
EQUIVALENTS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("modelled", "modeled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("whilst", "while"),
    ("https", "http"),
    ("version", "v"),
)

# Notices and opening sentences of licences, by SPDX id, and the body of MIT.
_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
)
# Of CC-BY-NC-4.0 only the notices are known.
KNOWN = (*_NOTICES, *license_texts.texts(_NOTICES[-1][1]))

_COPYRIGHT = r"(?m)^[ \t]*(?:©|(?:copyright[ \t:]*)?\(c\)[ \t]*(?:copyright[ \t]*)?[0-9<\[{]|copyright[ \t:]*(?:\(c\)|©|[0-9<\[{]|by\b))[^\n]*$|all rights reserved\.?"


def canonical(text: Column) -> Column:
    """The canonical form of a text (null: null)."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9]+", "  "), F.lit(" "))  # each word with two blanks of its own
    for variant, kept in EQUIVALENTS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {kept} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form; null where nothing is left of it."""
    return F.when(form != "", F.sha2(form, 256))


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """form, digest, license: one row for each known canonical form; of two licences with one form the first by name."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("body")) for k, t in texts])).alias("x"))
    forms = rows.select(canonical(F.col("x.body")).alias("form"), "x.license").filter("form <> ''")
    return forms.groupBy("form").agg(F.min("license").alias("license")).select("form", digest(F.col("form")).alias("digest"), "license")


def _marks(forms: list[str]) -> str:
    """A pattern that every line with one of these forms matches in lower case: each form's longest word, in all its spellings."""
    words = {max(f.split(), key=lambda w: (len(w), w)) for f in forms}
    return "|".join(sorted(words | {v for v, kept in EQUIVALENTS if kept in words}))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row per row of docs: id, text_digest, license (of the whole text), line_licenses, n_license_lines.

    license is null where the whole text is no known one; line_licenses is the comma-joined sorted set of licences that
    single lines are, empty where none is. A text that is null, empty, or nothing but punctuation and copyright lines
    has no digest and no licence. Repeated rows give repeated results; an empty table none; other columns are ignored.

    The known texts are a literal of the code, so the broadcast side of the join is bounded by the code. Lines look
    their digests up in the same few entries as a literal map, within their row: nothing is exploded or grouped again.
    """
    entries = known(docs.sparkSession, texts).collect()
    table = known(docs.sparkSession, texts).select(F.col("digest").alias("_k"), F.col("license").alias("_license"))
    lookup = F.create_map(*[F.lit(x) for r in entries for x in (r["digest"], r["license"])])
    marks = _marks([r["form"] for r in entries])
    plain = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    whole = plain.withColumn("_form", canonical(F.col("_text"))).withColumn("_digest", digest(F.col("_form")))
    out = whole.join(F.broadcast(table), F.col("_digest") == F.col("_k"), "left")
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n", -1), lambda x: F.lower(x).rlike(marks))
    found = F.filter(F.transform(lines, lambda x: F.element_at(lookup, digest(canonical(x)))), lambda x: x.isNotNull())
    out = out.withColumn("_found", found)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_digest").alias("text_digest"),
        F.col("_license").alias("license"),
        F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("line_licenses"),
        F.size("_found").cast("long").alias("n_license_lines"),
    )


def oracle(texts: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The scan of `documents` in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        words = f"regexp_extract_all(regexp_replace(lower({x}), {quote(_COPYRIGHT)}, ' ', 'g'), '[a-z0-9]+')"
        same = " ".join(f"WHEN '{variant}' THEN '{kept}'" for variant, kept in EQUIVALENTS)
        return f"array_to_string(list_transform({words}, lambda w: CASE w {same} ELSE w END), ' ')"

    rows = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in texts)
    return f"""
        WITH known AS (SELECT form, min(license) AS license FROM (SELECT {form("body")} AS form, license FROM (VALUES {rows}) AS v(license, body)) GROUP BY form),
        lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        hits AS (SELECT doc_id, license FROM (SELECT doc_id, {form("line")} AS form FROM lines) JOIN known USING (form)),
        per AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM hits GROUP BY doc_id),
        whole AS (SELECT doc_id, {form("text")} AS form FROM documents)
        SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest, license, coalesce(line_licenses, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines
        FROM whole LEFT JOIN known USING (form) LEFT JOIN per USING (doc_id)"""
