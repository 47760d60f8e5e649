"""Licence scan by canonical digests.

A text is brought to a canonical form: ASCII lower case, lines that state a copyright dropped, equivalent spellings made
one, everything but letters and digits turned into single spaces. The digest of the whole canonical text is looked up
among those of known licences by a hash join; lines that speak of a license are looked up alone as well, because
licences are mostly named in one line. Where words grant a license ("licensed under", "SPDX-License-Identifier:"), the
names behind them are looked up too, in single lines and over the lines of a paragraph, to the end of the sentence; names
joined by "or", "and", a comma or a slash each count, and of names that begin alike the longest.

The catalogue is a table (license_id, kind, text) of the caller, kinds ``text``, ``notice`` and ``name``; ``shipped`` holds
``KNOWN``, the texts in ``licence_texts`` and the names in ``licence_names.tsv``. Its digests are broadcast only up to
``BROADCAST_ROWS`` rows; a larger catalogue is joined by a shuffle.

Defined cases: a null text, or one whose canonical form is empty, has no digest and matches nothing. Texts that differ
only in what the canonical form drops match alike. If two entries have one canonical form, the smaller id is reported.
Every input row gives one output row; only the id and text columns are read.
"""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

BROADCAST_ROWS = 10_000

# Pairs of equivalent spellings, the second is the canonical one.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("copyright holders", "copyright holder"),
    ("copyright owners", "copyright holder"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
)

# Public licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""

KNOWN = (
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("MIT", "text", MIT),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("ISC", "text", ISC),
    ("0BSD", "text", ZERO_BSD),
    ("WTFPL", "text", WTFPL),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
)

# A line that states a copyright: the word, the sign or both, and right behind it a year, or behind the sign a holder. The
# word alone also begins lines of ordinary text, and ``(c)`` alone is a list mark. Holder first, the year ends the line.
YEAR = r"[\[<{(]?((19|20)[0-9]{2}|yyyy|years?\b)"
MARK = r"(copyright[\s:]*(\(c\)|©|&copy;)|(\(c\)|©|&copy;)\s*copyright|©|&copy;)"
STATED = rf"(({MARK}|copyright|\(c\))[ \t:]*(by[ \t]+)?{YEAR}[^\n]*|{MARK}[ \t]*[a-z\[<{{\x80-\uffff][^\n]*|(copyright|\(c\))[ \t][^\n]*[^0-9\n](19|20)[0-9]{{2}}[ \t.]*(?=\n|$))"
# Where a statement and the licence share a line, it ends before the words that open the licence.
OPENING = r"(permission is hereby granted|permission to use, copy|redistribution and use in source)"
COPYRIGHT_LINE = rf"(^|\n)[^a-z0-9(©&\n]*(?!{OPENING}){STATED}"
COPYRIGHT_BEFORE = rf"({MARK}|(copyright|\(c\))[ \t:]*{YEAR})[^\n]*?(?={OPENING})"
# Statements of the publishers and the blank forms in known texts, which a wrapping may join to other lines.
PUBLISHED = (
    r"copyright\s+(\(c\)|©)\s+[0-9][-0-9,\s]*(free\s+software\s+foundation|unicode),?\s+inc[.,]*|"
    r"copyright\s+(\(c\)\s+)?[\[<{]?(19yy|yyyy|year)[\]>}]?\s+[\[<{]?(name\s+of\s+(author|copyright\s+owner)|your\s+name)[\]>}]?\.?"
)
RESERVED = r"\ball\s+rights\s+reserved\b"
NOTICE_LINE = "licen[cs]"
# What each user of a text fills in: the address of its publisher, and the holder in texts of the BSD family.
ADDRESS = r"( write to the)?( (51 franklin|59 temple|675 mass)[a-z]*( [a-z0-9]+){0,12}? (usa|0211[01] 130[17]|02139))| http (www )?(fsf|gnu) org( licenses)?( \w+ html)?"
HOLDERS = (
    (r"neither the names? of .*? may be used", "neither the name of holder may be used"),
    (r"includes software developed by .*? (?=4 neither|neither)", "includes software developed by holder "),
    (r"this software is provided by .*? as is", "this software is provided by holder as is"),
    (r"in no event shall .*? be liable", "in no event shall holder be liable"),
)
# Words that grant a license under the name behind them.
GRANT = (
    r"(?:\bspdx-license-identifier\s*:|\blicen[cs]e\s*[:=]|\bunder\s+(?:the\s+)?(?:terms|conditions)\b|"
    r"\b(?:licen[cs]ed|released|(?:re)?distributed|available|published|provided|covered|issued|offered|shared|open[- ]sourced)\s+(?:under|by|with|via|as)\b)"
)
FILLERS = r"\b(the|an?|of|terms|conditions|either|both|version|gnu)\b|\bv(er)?[. ]*(?=[0-9])"
# Titles that stand above a text or are left out.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "New BSD License", "BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
FAMILIES = {"GPL": ("General Public License",), "LGPL": ("Lesser General Public License", "Library General Public License"), "AGPL": ("Affero General Public License",), "GFDL": ("Free Documentation License",)}


def names_of(license_id: str, entry: str) -> list[tuple[str, str]]:
    """(id, name) of an entry of the table of names: ``@`` a GNU license, ``#`` a Creative Commons one, ``=`` a name that must end there."""
    if entry[0] == "@":
        short, number = entry[1:].split(" ")
        full = [f"{x}{y}" for x in FAMILIES[short] for y in ("", f" ({short})", ",", " as published by the Free Software Foundation", " as published by the Free Software Foundation,", " as published by the Free Software Foundation;")]
        return [(license_id, x) for x in (f"{short} {number}", f"{short}{number}", f"{short}v{number}", f"{short}, version {number}", f"{short} License {number}", *(f"{x} {number}" for x in full))]
    if entry[0] == "#":
        forms = (license_id, f"Creative Commons {license_id[3:]}", f"Creative Commons {entry[1:]}", f"Creative Commons {entry[1:]} License", f"Creative Commons {license_id}")
        return [(f"{license_id}-{v}", f"{x} {v}") for x in forms for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    return [(license_id, entry)]


@cache
def shipped() -> tuple[tuple[str, str, str], ...]:
    """KNOWN, the texts in ``licence_texts`` with and without title and appendix, and the names in ``licence_names.tsv``."""
    here = Path(__file__).parent
    texts = [(i, t) for i, kind, t in KNOWN if kind == "text"]
    for path in sorted((here / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        forms = [text]
        if "END OF TERMS AND CONDITIONS" in text:
            before, end, _ = text.partition("END OF TERMS AND CONDITIONS")
            forms += [before, before + end]
        if path.stem.startswith("BSD"):
            # items marked by stars or dashes leave nothing in the canonical form
            forms += ["\n".join(line[3:] if line[:1].isdigit() and line[1:3] == ". " else line for line in text.split("\n"))]
        texts += [(path.stem, x) for x in forms]
    texts += [(i, f"{title}\n\n{t}") for i, t in texts for title in TITLES.get(i, ())]
    named = [x for line in (here / "licence_names.tsv").read_text(encoding="utf-8").splitlines() for i, _, rest in [line.partition("\t")] for e in rest.split("|") for x in names_of(i, e)]
    notices = [x for x in KNOWN if x[1] == "notice"] + [(i, "notice", x) for i, x in named if "license" in x.lower()]
    return (*((i, "text", t) for i, t in texts), *notices, *((i, "name", x) for i, x in named))


def canonical(text: Column) -> Column:
    """Canonical form; null for a null text."""
    lower = lower_ascii(text)
    # most texts hold none of these words, and looking for them costs less than the expressions
    stated = reduce(lambda x, y: x | y, (F.contains(lower, F.lit(w)) for w in ("copyright", "(c)", "©", "&copy;", "reserved")))
    out = F.regexp_replace(F.regexp_replace(lower, PUBLISHED, " "), COPYRIGHT_BEFORE, " ")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), RESERVED, " ")
    out = F.when(stated, out).otherwise(lower)
    out = F.regexp_replace(spelled(out), ADDRESS, "")
    return reduce(lambda x, r: F.regexp_replace(x, *r), HOLDERS, out)


def spelled(lower: Column) -> Column:
    """Letters and digits in words with single spaces, in the usual spelling."""
    out = F.trim(F.regexp_replace(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if that is empty."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def name_form(lower: Column) -> Column:
    """Words of a name in lower case without fillers; ``zq`` stands where a name may end, ``2.0`` is 2 and ``2.1`` is 2p1."""
    out = F.regexp_replace(F.regexp_replace(lower, GRANT, " zq "), r"(?<=[a-z0-9])/(?=[a-z0-9])|[,;()|\[\]]|\b(or|and)\b", " zq ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?<=[0-9])\.0+\b", ""), r"([0-9])\.(?=[0-9])", "$1p")
    out = spelled(F.regexp_replace(spelled(out), FILLERS, " "))
    return F.regexp_replace(out, r"\bzq( zq)+\b", "zq")


def name_digest(form: Column) -> Column:
    return F.sha2(F.concat(F.lit("name:"), form), 256)


def grams(text: Column, longest: int) -> Column:
    """Names that may be granted in a text: (unit, start, size, d), with all sizes up to that of the longest known name."""
    lower = F.regexp_replace(lower_ascii(text), "\r", "")
    lines = F.split(lower, "\n", -1)
    paragraphs = F.transform(F.split(lower, r"\n[^a-z0-9\n]*(?=\n)", -1), lambda x: F.regexp_replace(x, r"\n[\s#*/;!%<>-]*", " "))
    units = F.filter(F.concat(lines, paragraphs), lambda x: x.rlike(NOTICE_LINE))
    tails = F.flatten(F.transform(units, lambda x: F.regexp_extract_all(x, F.lit(GRANT + r"([^\n]*?)(?=[.!?](?:[\s\"')*]|$)|$)"), F.lit(1))))
    forms = F.transform(tails, lambda x: F.split(F.regexp_replace(F.concat(name_form(x), F.lit(" zq")), "^(zq )+", ""), " "))

    def of(words: Column, unit: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 2) == "zq"))
        return F.flatten(F.transform(starts, lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)),
            lambda n: F.struct(unit.alias("unit"), i.alias("start"), n.alias("size"), name_digest(F.array_join(F.slice(words, i, n), " ")).alias("d")),
        )))

    return F.flatten(F.transform(forms, of))


def catalogue(spark: SparkSession, known: tuple | None = None) -> DataFrame:
    return spark.createDataFrame(list(shipped() if known is None else known), "license_id string, kind string, text string")


def licence_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical digest, ``license_id`` of the whole text, and ``notices``: ids named by single lines or grants, sorted."""
    bare = F.col("text").startswith("=")
    name = F.concat(name_form(lower_ascii(F.col("text"))), F.when(bare, " zq").otherwise(""))
    entries = known.select("license_id", F.when(F.col("kind") == "name", name).alias("name"), F.when(F.col("kind") != "name", digest(F.col("text"))).alias("d"))
    longest = entries.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 0
    digests = entries.select("license_id", F.coalesce("d", name_digest(F.col("name"))).alias("d")).dropna().groupBy("d").agg(F.min("license_id").alias("license_id"))
    small = digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(digests) if small else digests
    text = F.col(text_col).cast("string")
    lower = lower_ascii(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: lower_ascii(x).rlike(NOTICE_LINE))
    found = F.transform(F.transform(lines, digest), lambda d, i: F.struct((-1 - i).alias("unit"), F.lit(1).alias("start"), F.lit(1).alias("size"), d.alias("d")))
    if longest:
        found = F.concat(found, grams(text, longest))
    found = F.when(lower.rlike(NOTICE_LINE), found).otherwise(F.array().cast("array<struct<unit:int,start:int,size:int,d:string>>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), found.alias("found"))
    whole = rows.join(side.withColumnRenamed("d", "digest"), "digest", "left")
    # the few rows that hold such lines go through a join of their own, beside the others
    numbered = whole.withColumn("row", F.monotonically_increasing_id())
    named = F.filter("found", lambda x: x["d"].isNotNull())
    opened = numbered.select("*", F.explode_outer(F.when(F.size(named) > 0, named)).alias("x")).select("row", "doc_id", "digest", "license_id", "x.*")
    hits = opened.join(side.withColumnRenamed("license_id", "named"), "d", "left")
    hit = F.when(F.col("named").isNotNull(), F.struct("unit", "start", "size", "named"))
    out = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("license_id").alias("license_id"), F.collect_set(hit).alias("hits"))
    kept = F.filter("hits", lambda x: ~F.exists("hits", lambda y: (y["unit"] == x["unit"]) & (y["start"] == x["start"]) & (y["size"] > x["size"])))
    return out.select("doc_id", "digest", "license_id", F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["named"]))).alias("notices"))
