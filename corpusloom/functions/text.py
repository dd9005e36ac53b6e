"""Column helpers that give Spark strings the text rules the corpus jobs rely on.

Spark's ``trim`` and Java's ``\\s`` know only ASCII blanks and ``\\b`` differs between
engines, so the character sets are spelled out once here and every other module builds
its expressions from them. All helpers are JVM-side column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white-space characters, and the characters that end a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_SET = r"\t-\r\x1c-\x1f\x{85}\p{Z}"  # the same characters, as a regex set
WS = f"[{WS_SET}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LETTER = r"\p{L}"
WORD_CHAR = r"[\p{L}\p{N}_]"


def as_column(value) -> Column:
    """A column as it is; anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def strip_chars(text: Column, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def has_letter(text: Column) -> Column:
    return text.rlike(LETTER)


def split_lines(text: Column) -> Column:
    """Lines of ``text``; a final line end opens no further line, "" has no lines."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    no_lines = F.array().cast("array<string>")
    return F.when(text == "", no_lines).otherwise(F.split(body, LINE_END, -1))


def with_lines(docs: DataFrame, text: str = "markdown", lines: str = "lines") -> DataFrame:
    """``text`` replaced by the array of its lines; a null text has none."""
    none = F.array().cast("array<string>")
    return docs.withColumn(lines, F.coalesce(split_lines(F.col(text)), none)).drop(text)


def explode_lines(docs: DataFrame, doc: str = "doc_id", lines: str = "lines") -> DataFrame:
    """(doc, pos, line), one row per line. A document without lines keeps one row whose line is null."""
    return docs.select(doc, F.posexplode_outer(lines).alias("pos", "line"))


def heading_level(line: Column) -> Column:
    """1-6 for a heading line, 0 for any other (null stays 0)."""
    stripped = strip(line)
    marks = F.length(F.regexp_extract(stripped, r"^(#{1,6})", 1))
    return F.when(F.startswith(stripped, F.lit("#")), marks).otherwise(F.lit(0))


def heading_title(line: Column) -> Column:
    """Title of a heading line without its closing marks; "" for any other line.

    The level takes at most six marks, so a seventh mark belongs to the title.
    """
    stripped = strip(line)
    rest = lstrip(F.regexp_replace(stripped, r"^#{1,6}", ""))
    title = rstrip(F.rtrim(rest, F.lit("#")))
    return F.when(F.startswith(stripped, F.lit("#")), title).otherwise(F.lit(""))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal needle."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")
