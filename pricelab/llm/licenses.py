"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case; copyright statements removed (lines
that start with copyright and a sign, a year or a placeholder, or say that all rights are reserved; running text
that happens to break before the word stays, so the form does not depend on line breaks);
punctuation to spaces; equivalent spellings to one; white space to one space.
The sha256 of the whole form is joined with the digests of the known full
licence texts (``license_digests``, with and without their titles) and notices,
and so is every line's, because notices are mostly one line of a document; a
notice listed under two licences counts as the one that sorts first. A line's own copyright statement is a line
removed, so it names no licence.

Null texts count as empty; an empty form matches nothing. Rows repeated with
the same doc_id and form are one row of the result, their lines counted together. The table of known digests is fixed and small, so it is broadcast; a
table given by the caller is joined as Spark decides.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS

# FIXED VALUES: known notices. Titles and short notices by which the licences are granted.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)
# FIXED VALUES: equivalent spellings, as (strings without which the pattern cannot match, pattern, common form).
SPELLINGS = (
    (("authoris", "emphasis", "initialis", "maximis", "optimis", "organis", "realis", "recognis", "utilis"),
     r"\b(author|emphas|initial|maxim|optim|organ|real|recogn|util)is(e|ed|es|ing|ation|ations)\b", "$1iz$2"),
    (("behaviour", "colour", "favour", "honour", "labour"), r"\b(behavi|col|fav|hon|lab)our", "$1or"),
    (("defence", "licence", "offence"), r"\b(defen|licen|offen)ce", "$1se"),
    (("calibre", "centre"), r"\b(calib|cent)re\b", "$1er"),
    (("cancell", "labell", "modell", "signall"), r"\b(cancel|label|model|signal)l(ed|ing)\b", "$1$2"),
    (("analogue", "catalogue"), r"\b(anal|catal)ogue", "$1og"),
    (("acknowledgement", "judgement"), r"\b(acknowledg|judg)ement", "$1ment"),
    (("practis",), r"\bpractis(e|ed|es|ing)\b", "practic$1"),
)
COPYRIGHT_WORDS = ("copyright", "(c)", "©", "all rights reserved")
COPYRIGHT_LINE = (r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|:?[ \t]*[12][0-9]{3}|[<\[])[^\n]*|\(c\)[ \t]*(copyright|[12][0-9]{3})[^\n]*|©[^\n]*|"
                  r"all rights reserved[ \t.]*)$")
OTHER = r"[^\p{L}\p{N}\n]+"


def holds(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(p)) for p in parts])


def with_form(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the canonical form of ``text``, line breaks kept; empty for null.

    One projection for each step, so that a step's input is made once; a pattern is only run on texts that hold a
    string which it needs.
    """
    c = F.col(out)
    df = df.withColumn(out, F.lower(F.coalesce(text, F.lit(""))))
    df = df.withColumn(out, F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c))
    df = df.withColumn(out, F.when(holds(c, COPYRIGHT_WORDS), F.regexp_replace(c, COPYRIGHT_LINE, " ")).otherwise(c))
    df = df.withColumn(out, F.regexp_replace(c, OTHER, " "))
    spelled = reduce(lambda x, s: F.regexp_replace(x, s[1], s[2]), SPELLINGS, c)
    return df.withColumn(out, F.when(holds(c, tuple(p for s in SPELLINGS for p in s[0])), spelled).otherwise(c))


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest) of the known notices and full texts: a fixed table."""
    df = with_form(spark.createDataFrame(list(KNOWN), "license string, notice string"), F.col("notice"), "form")
    texts = spark.createDataFrame([(name, d) for name, found in DIGESTS.items() for d in found], "license string, digest string")
    return df.select("license", digest(one_line(F.col("form"))).alias("digest")).unionByName(texts).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest of the whole canonical text, license if the whole text is a known notice, line_licenses (sorted) of its lines."""
    fixed = known is None
    known = known_digests(docs.sparkSession) if fixed else known.select("license", "digest").distinct()
    hint = F.broadcast if fixed else (lambda x: x)
    rows = with_form(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), F.col("text"), "form").select("doc_id", "form")
    lines = F.transform(F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != ""), digest)
    rows = rows.select("doc_id", digest(one_line(F.col("form"))).alias("digest"), lines.alias("lines"))
    # A row for the text and for each of its lines; only the text's and those that name a licence go on.
    each = rows.select("doc_id", "digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), "lines")).alias("line"))
    each = each.withColumn("sought", F.coalesce("line", "digest"))
    found = known.groupBy("digest").agg(F.min("license").alias("found")).withColumnRenamed("digest", "known")
    each = each.join(hint(found), F.col("sought") == F.col("known"), "left").where("found is not null or line is null")
    return each.groupBy("doc_id", "digest").agg(
        F.max(F.when(F.col("line").isNull(), F.col("found"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("line").isNotNull(), F.col("found")))), ",").alias("line_licenses"),
        F.count("line").alias("n_lines"))


def sql_forms(name: str, source: str) -> str:
    """A common table expression for checking: the rows of ``source`` (text in ``t``) with their canonical ``form``."""
    c = f"regexp_replace(lower(coalesce(t, '')), '\\r\\n?', chr(10), 'g')"
    for pattern, by in ((COPYRIGHT_LINE, " "), (OTHER, " "), *((p, by.replace("$", "\\")) for _, p, by in SPELLINGS)):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"{name} AS (SELECT *, {c} AS form FROM ({source}))"
