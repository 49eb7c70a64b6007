"""Licence scan by canonical digest: whole texts that are a known licence, however set.

Two digests are looked up.  That of the canonical form (the SQL counterpart has the same) finds
bare texts; that of the file form also finds files as they are shipped, with titles, copyright
notices, list markers and names of holders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as (written, canonical) words.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"),
    ("sub license", "sublicense"), ("per cent", "percent"),
)

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
          "documentation and/or other materials provided with the distribution.")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
          "this software without specific prior written permission.")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# Texts of public licences and the licence lines in use, by name.
KNOWN = {
    "MIT": f"{_MIT_GRANT}, subject to the following conditions: {_MIT_NOTICE} {_MIT_WARRANTY}",
    "BSD-2-Clause": f"{_BSD_START} {_BSD_1} {_BSD_2} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_START} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_WARRANTY}",
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            f"the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
             f"{_ISC_WARRANTY}"),
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
}


#: (pattern, replacement) steps of the canonical form; both Spark and RE2 read them alike.
STEPS = (
    (r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*", " "),
    (r"https?://", " "),
    (r"[^\p{L}\p{N}]+", " "),
)


def canonical(text: Column) -> Column:
    """Lower case, copyright lines off, punctuation and white space to one space, spellings made equal."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for written, plain in SPELLINGS:
        out = F.replace(out, F.lit(f" {written} "), F.lit(f" {plain} "))
    return F.trim(out)


# What only files have.  These patterns run in Spark alone.
FILE_LINES = {"MIT line": "Released under the MIT License."}
#: SHA-256 of the file forms of long texts; a test recomputes them where the texts are installed.
FILE_DIGESTS = {
    "812558c2127bace4a4f1222bd2338b04fe96a41e8b690b8e183a934468ee6576": "Apache-2.0",
    "1e0d975c70016816d0c8b3d41e01651ee213e21b05f6dd2fe2e7206698c8ce40": "Apache-2.0",  # without the appendix
    "51ce791fd6dbf56df73a504d05d445ea67e3219edf2ba3ec49c5e3ba4f9c58d0": "CC0-1.0",
    "11067a290bac260f4c6c7d79e23915cf50bb1152c3babe698027482376a5e956": "GPL-2.0",
    "304429d7d573830e29253f05d5db2e9588d5d58aa865f4d1b8b89b07e1a39930": "GPL-3.0",
    "957b478ee735fdcc17e0dd9721f1bc0d7b7bf8139a17ffdb19cf9ab1b4b3344f": "LGPL-2.1",
    "8b382dd66ce8da3b3b61af92a44dcc9e4dc64c240fefd721ed7bc1022686dbc9": "LGPL-3.0",
    "c55de2a91588606b15e94971545b532c062e1ade18807139b0b7d17025224c03": "MPL-2.0",
}
_TITLE = ("the|a|mit|expat|x11|isc|bsd|freebsd|netbsd|0bsd|zero|two|three|0|2|3|clause|new|or|revised|modified|simplified|licen[cs]es?|software|agreement|"
          "and|style|open|source|internet|systems|consortium|full|text")
_NOT_A_HOLDER = r"[ \t]*(?:notices?|holders?|owners?|licen[cs]es?|laws?|and|or|statements?|interest|permission)(?![\p{L}\p{N}])"
_GAP = r"[^\p{L}\p{N}\n©]*+"
FILE_STEPS = (
    (r"\r\n?", "\n"),
    # notices with a year or sign, and the lines on which a list of holders goes on
    (r"(?m)^[^\p{L}\p{N}\n(©]*+(?:portions )?(?:copyright[ \t:]*(?:\(c\)|©|&copy;|[\[<{(]?(?:\d{4}|yyyy|year)\b)|(?:\(c\)|©)[ \t]*(?:copyright|\d{4}))"
     r"[^\n]*+(?:(?<=,|,[ \t]|, {2})\n[^\n]*+){0,99}", ""),
    # titles, notices without a year and empty lines before the body; each match starts where the last one ended
    (rf"\G{_GAP}(?:(?:(?:{_TITLE})(?![\p{{L}}\p{{N}}]){_GAP}){{1,14}}|(?:all )?rights reserved[^\n]*+|(?:copyright|\(?c\)|©)(?!{_NOT_A_HOLDER})[^\n]*+)?+\n", ""),
    # numbers and letters of clauses; other bullets go with the punctuation
    (r"([:;.,](?:\s+(?:and|or)\b)?[^\p{L}\p{N}]*+)(?:(?:\d{1,2}|[a-h]|i{1,3}|iv)[.)\]]|o)\s+", "$1"),
    (r"https?://", " "),
    (r"[^\p{L}\p{N}]+", " "),
)
#: Names of holders inside BSD texts.
HOLDERS = (
    (r" neither the names? of .{1,120}? nor the names of (?:its|their|the) contributors ", " neither the name of the copyright holder nor the names of its contributors "),
    (r" software is provided by .{1,120}? and contributors as is ", " software is provided by the copyright holders and contributors as is "),
    (r" in no event shall .{1,120}? or contributors be liable ", " in no event shall the copyright holder or contributors be liable "),
)
#: Words of which every built-in file form has one, as written; other texts need no file form.
_SIGNS = ("permission", "redistribution", "licen")


def file_form(text: Column) -> Column:
    """The canonical form of a licence file without titles, copyright notices, clause marks and
    names of holders.  A line of the body that starts with "copyright" stays."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, by in FILE_STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for written, plain in SPELLINGS:
        out = F.replace(out, F.lit(f" {written} "), F.lit(f" {plain} "))
    for pattern, by in HOLDERS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def file_digests(spark: SparkSession) -> DataFrame:
    """(license_id, file_sha256) of the built-in texts, in file form."""
    rows = spark.createDataFrame(sorted((KNOWN | FILE_LINES).items()), "license_id string, body string").select("license_id", F.sha2(file_form(F.col("body")), 256).alias("file_sha256"))
    rows = rows.unionByName(spark.createDataFrame(list(FILE_DIGESTS.items()), "file_sha256 string, license_id string"))
    return rows.groupBy("file_sha256").agg(F.min("license_id").alias("file_license"))


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, license_sha256) of the known texts, in canonical form."""
    rows = spark.createDataFrame(sorted((known or KNOWN).items()), "license_id string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("license_sha256"), "license_id").groupBy("license_sha256").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License of every document whose whole text is a known licence text or licence file.

    ``known``: (license_id, license_sha256) of canonical forms, with which file forms are
    compared too; the built-in lists when not given.  A given table may be large: it meets the digests in a hash join, which Spark
    broadcasts only when its size is below the session's bound.  The digest is computed where
    the row lies, so the text is never shuffled.  Returns doc_id, n_chars_canonical,
    canonical_sha256 and license_id (of the canonical form, else of the file form; null when
    nothing matches).  A null, empty or
    punctuation-only text has the empty canonical form and no licence.  Repeated rows stay,
    other columns are ignored, an empty table gives an empty result.
    """
    text = F.col(text_col)
    if known is None:
        known, files = known_digests(docs.sparkSession), file_digests(docs.sparkSession)
        signed = F.lower(text.cast("string"))
        signed = F.coalesce(F.greatest(*(signed.contains(x) for x in _SIGNS)), F.lit(False))
    else:
        known, signed = known.groupBy("license_sha256").agg(F.min("license_id").alias("license_id")), F.lit(True)
        files = known.withColumnsRenamed({"license_sha256": "file_sha256", "license_id": "file_license"})
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(text).alias("form"), F.when(signed, F.sha2(file_form(text), 256)).alias("as_file"))
    rows = rows.select("doc_id", F.length("form").cast("long").alias("n_chars_canonical"), F.sha2("form", 256).alias("canonical_sha256"), "as_file")
    rows = rows.withColumn("as_file", F.coalesce("as_file", "canonical_sha256"))  # no null keys, which would meet in one task
    empty = F.sha2(F.lit(""), 256)
    match = rows.join(known, (F.col("canonical_sha256") == F.col("license_sha256")) & (F.col("license_sha256") != empty), "left")
    match = match.join(files, (F.col("as_file") == F.col("file_sha256")) & (F.col("file_sha256") != empty), "left")
    return match.select("doc_id", "n_chars_canonical", "canonical_sha256", F.coalesce("license_id", "file_license").alias("license_id"))


def license_sql(known: dict[str, str] | None = None) -> str:
    """The scan in SQL over ``documents``; it knows canonical forms, not files."""
    def form(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        for pattern, by in STEPS:
            x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
        x = f"(' ' || trim({x}, ' ') || ' ')"
        for spelt, plain in SPELLINGS:
            x = f"replace({x}, ' {spelt} ', ' {plain} ')"
        return f"trim({x}, ' ')"

    listed = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((known or KNOWN).items()))
    return f"""
WITH known AS (SELECT sha256(f) AS h, min(license_id) AS license_id FROM (SELECT license_id, {form('body')} AS f FROM (VALUES {listed}) AS k(license_id, body)) WHERE f <> '' GROUP BY ALL),
forms AS (SELECT doc_id, {form('text')} AS f FROM documents)
SELECT doc_id, CAST(length(f) AS BIGINT) AS n_chars_canonical, sha256(f) AS canonical_sha256, license_id
FROM forms LEFT JOIN known ON sha256(f) = known.h"""
