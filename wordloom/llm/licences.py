"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought into canonical form: lower case, copyright lines dropped
(lines that start with ``copyright``, ``(c)`` or the sign, and ``all rights
reserved`` lines), everything but letters and digits taken as a space, spaces
collapsed, equivalent spellings replaced.  The SHA-256 of the canonical text is
joined with the digests of the known licences: an entire text is a known licence
or it is not.  Every line of a text is looked up the same way (in a map of the
known digests), which finds notices such as ``Released under the MIT License.``

The known licences are a parameter (at most ``MAX_KNOWN`` texts; ``read_known`` reads
them from a folder), so their side
of the join is broadcast; documents are scanned once and never shuffled, which
no group of copies can skew.

Null and empty texts, and texts without letters or digits, have an empty
canonical form and match nothing.  Null or repeated keys keep their rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .licence_texts import EQUIVALENT, KNOWN

MAX_KNOWN = 5_000
MAX_KNOWN_BYTES = 64 << 20
# fixed patterns, shared with the SQL form
COPYRIGHT_LINE = (r"(?m)^[ \t#*/;-]*(?:copyright|\(c\)|©|all rights reserved)"
                  r"(?:[ \t:.,-]*(?:\(c\)|©|copyright|[0-9<\[{]|by[ \t]|$))[^\n]*$")
RIGHTS_LINE = r"(?m)^[ \t#*/;-]*all rights reserved[ \t.]*$"
BREAKS = r"[^\p{L}\p{N}\n]+"
LINE_ENDS = r"[ ]*\n[ \n]*"


def canonical_lines(text: Column) -> Column:
    """Canonical text with one newline between non-empty lines."""
    t = F.lower(text)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.regexp_replace(t, RIGHTS_LINE, "")
    # blanks around every line, so that words are bounded by them
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, BREAKS, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(" " + a), F.lit(" " + b))
    return F.regexp_replace(F.regexp_replace(t, LINE_ENDS, "\n"), r"^[ \n]+|[ \n]+$", "")


def canonical_lines_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    t = f"lower({text})"
    for pattern, to in ((COPYRIGHT_LINE, "''"), (RIGHTS_LINE, "''"), (BREAKS, "' '")):
        t = f"regexp_replace({t}, {quoted(pattern)}, {to}, 'g')"
    t = f"(' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' ')"
    for a, b in EQUIVALENT:
        t = f"replace({t}, {quoted(' ' + a)}, {quoted(' ' + b)})"
    return (f"regexp_replace(regexp_replace({t}, {quoted(LINE_ENDS)}, chr(10), 'g'), "
            f"{quoted('^[ ' + chr(92) + 'n]+|[ ' + chr(92) + 'n]+$')}, '', 'g')")


def whole(lines: Column) -> Column:
    """Canonical form of an entire text from its canonical lines."""
    return F.translate(lines, "\n", " ")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def read_known(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(licence id, text) of the ``<licence id>.txt`` files of a folder, in order of
    their names; ``<licence id>.<anything>.txt`` is another text of the same licence."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(
        F.col("_metadata.file_name").alias("name"), "value")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    if n > MAX_KNOWN or size > MAX_KNOWN_BYTES:
        raise ValueError(f"{n} licences of {size} bytes; at most {MAX_KNOWN} of {MAX_KNOWN_BYTES} bytes")
    rows = sorted((r["name"], r["value"]) for r in files.collect())
    return [(re.sub(r"(\.[^.0-9][^.]*)?\.txt$", "", name), text) for name, text in rows]


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licence_id) of the known texts; the first id of a digest counts."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known licences")
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("licence_id"), F.lit(t).alias("text"))
                       for i, (n, t) in enumerate(known)])
    rows = spark.range(1).select(F.inline(listed))
    return (rows.select("place", "licence_id", digest(whole(canonical_lines(F.col("text")))).alias("digest"))
            .groupBy("digest").agg(F.min_by("licence_id", "place").alias("licence_id")))


def scan(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
         known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """(key, digest, licence_id, notices): the licence that the entire text is
    (null if none), and the distinct licences its lines name, sorted."""
    table = known_digests(docs.sparkSession, known)
    by_digest = F.create_map(*[F.lit(x) for r in table.collect() for x in (r["digest"], r["licence_id"])])
    rows = (docs.select(F.col(key_col), canonical_lines(text_or_empty(text_col)).alias("_lines"))
            .withColumn("digest", digest(whole(F.col("_lines")))))
    named = F.transform(F.split("_lines", "\n"), lambda x: by_digest[digest(x)])
    rows = rows.select(key_col, "digest", F.array_sort(F.array_distinct(F.filter(
        named, lambda x: x.isNotNull()))).alias("notices"))
    return (rows.join(F.broadcast(table), "digest", "left")
            .select(key_col, "digest", "licence_id", "notices"))
