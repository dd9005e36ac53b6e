"""Cleaning markdown: inline rewrites on whole documents, then rules per line.

Inline rewrites may join lines (their patterns run across line ends), so they come
first. The line rules need neighbours and headings above; the lines of a document are an
array in its row, and what runs along them is a scan of that array. So nothing is
shuffled or sorted, and rows that share an id are documents of their own. A dropped line becomes null, so
that places are kept until the lines are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import after_first, scan
from corpusloom.functions.text import (
    LETTER,
    WORD_CHAR,
    WS,
    WS_SET,
    count_of,
    has_letter,
    heading_level,
    heading_title,
    rstrip,
    strip,
    strip_chars,
    with_lines,
)

# Sections dropped by title, line openings that mark page chrome, and the
# words at which the subject of a sentence ends.
DROPPED_SECTIONS = ("references", "disclaimer")
BOILERPLATE = (
    "ask ods",
    "have a question",
    "join the",
    "ods email list",
    "email list",
    "skip to",
    "print this",
    "share this",
    "back to top",
    "consumer",
    "health professional",
    "other resources",
    "subscribe",
)
TITLE_STOPS = (
    "is are was were has have can may might refers consists occurs includes comes "
    "and or also which that"
).split()
TITLE_STOP_MARKS = r"[,:;(\[–—]"
MAX_LINK_DEPTH = 6
MAX_BOILERPLATE_CHARS = 60
MAX_TITLE_WORDS = 5
MAX_TITLE_CHARS = 40

# What counts as a link, a bare address, a tag, a citation, loose punctuation.
# Quantifiers are possessive: every part is unambiguous, so giving back characters cannot
# find another match; without them long inputs would backtrack or overflow the stack.
LINK = r"\[([^\[\]]*+)\]\((?:[^()]*+(?:\([^()]*+\)[^()]*+)*+)\)"
BARE_URL = rf"https?://[^{WS_SET}]++"
HTML_TAG = r"</?[a-zA-Z][^>]*+>"
CITATION = rf"\[{WS}*+\p{{Nd}}++(?:{WS}*+[,–-]{WS}*+\p{{Nd}}++)*+{WS}*+\]"
SPACED_PUNCTUATION = rf"{WS}(?<!{WS}{WS}){WS}*+([.,;:)])"
PUNCTUATION_AFTER_SPACE = rf"[.,;:)](?<={WS}.)"  # the same spot, cheaper to look for
EMPTY_PARENS = rf"\({WS}*+\)"


@dataclass(frozen=True)
class CleanOptions:
    strip_links: bool = True
    strip_citations: bool = True
    drop_boilerplate: bool = True
    name_empty_headings: bool = True
    drop_sections: tuple[str, ...] = DROPPED_SECTIONS


# --- whole-document rewrites -------------------------------------------------------


def unescape_brackets(text: Column) -> Column:
    for mark in ("\\[", "\\]"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def unwrap_link(text: Column) -> Column:
    """``[label](url)`` to ``label`` for the innermost links."""
    return F.regexp_replace(text, LINK, "$1")


def unwrap_links(text: Column) -> Column:
    """Links inside out; passes beyond the nesting change nothing."""
    for _ in range(MAX_LINK_DEPTH):
        text = unwrap_link(text)
    return text


def strip_bare_urls(text: Column) -> Column:
    return F.regexp_replace(text, BARE_URL, "")


def strip_html_tags(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def collapse_asterisks(text: Column) -> Column:
    return F.regexp_replace(text, r"\*{3,}", " ")


def attach_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, SPACED_PUNCTUATION, "$1")


def drop_empty_parens(text: Column) -> Column:
    return F.regexp_replace(text, EMPTY_PARENS, "")


def tidy_punctuation(text: Column) -> Column:
    return drop_empty_parens(attach_punctuation(text))


def clean_inline(
    docs: DataFrame, options: CleanOptions = CleanOptions(), text: str = "markdown"
) -> DataFrame:
    """All inline rewrites in order. Each pattern is only run on texts that hold a part
    every match of it must hold, so most documents skip most of the passes.
    """
    body = F.col(text)

    def holds(part: str) -> Column:
        return F.contains(body, F.lit(part))

    steps = [(holds("\\"), unescape_brackets)]
    if options.strip_links:
        steps += [(holds("]("), unwrap_link)] * MAX_LINK_DEPTH
        steps.append((holds("://"), strip_bare_urls))
    steps.append((holds("<"), strip_html_tags))
    if options.strip_citations:
        steps.append((holds("["), strip_citations))
    steps += [
        (holds("***"), collapse_asterisks),
        (body.rlike(PUNCTUATION_AFTER_SPACE), attach_punctuation),
        (holds("("), drop_empty_parens),
    ]
    for applies, rewrite in steps:
        docs = docs.withColumn(text, F.when(applies, rewrite(body)).otherwise(body))
    return docs


# --- line rules ---------------------------------------------------------------------


def drop_sections(docs: DataFrame, titles: tuple[str, ...] = DROPPED_SECTIONS) -> DataFrame:
    """Null out every line that has a heading with one of ``titles`` above it.

    A heading is above a line while no heading of its own or a lower level follows it;
    here headings without a title end a section too. Along the lines it is enough to know the level of
    the outermost heading that drops what is below it.
    """

    def code(line: Column) -> Column:
        """Twice the level, and one more for a heading that drops its section."""
        level = heading_level(line)
        title = strip_chars(F.lower(heading_title(line)), ": ")
        return F.when(level > 0, level * 2 + title.isin(*titles).cast("int")).otherwise(F.lit(0))

    def step(dropping: Column, code: Column) -> Column:
        level = F.shiftright(code, 1)
        below = (code == 0) | ((dropping > 0) & (level > dropping))
        return F.when(below, dropping).when(code % 2 == 1, level).otherwise(F.lit(0))

    some = F.exists("_codes", lambda c: c % 2 == 1)
    return (
        docs.withColumn("_codes", F.transform("lines", code))
        .withColumn("_dropping", F.when(some, scan(F.col("_codes"), F.lit(0), step)))
        .withColumn(
            "lines",
            F.when(
                F.col("_dropping").isNotNull(),
                F.transform(
                    F.arrays_zip(F.col("lines").alias("line"), F.col("_dropping").alias("in")),
                    lambda x: F.when(x["in"] == 0, x["line"]),
                ),
            ).otherwise(F.col("lines")),
        )
        .drop("_codes", "_dropping")
    )


def infer_title(line: Column) -> Column:
    """Subject of a sentence, or "" where the line opens with none.

    >>> "HMB is a metabolite"  ->  "HMB"
    """
    stops = "|".join(TITLE_STOPS)
    cut = rf"(?<!{WORD_CHAR})(?:{stops})(?!{WORD_CHAR})|{TITLE_STOP_MARKS}"
    subject = strip_chars(F.split(strip(line), cut, 2)[0], " .*_|")
    words = F.filter(F.split(subject, f"{WS}+"), lambda word: word != "")
    named = (F.size(words) <= MAX_TITLE_WORDS) & F.try_element_at(words, F.lit(1)).rlike(f"^{LETTER}")
    title = F.substring(F.array_join(words, " "), 1, MAX_TITLE_CHARS)
    return F.when((F.size(words) > 0) & (heading_level(line) == 0) & named, title).otherwise("")


def name_empty_headings(docs: DataFrame) -> DataFrame:
    """Name headings without a letter after the line below; drop those it cannot name."""

    def nameless(line: Column) -> Column:
        return (heading_level(line) > 0) & ~has_letter(heading_title(line))

    def named(x: Column) -> Column:
        line, title = x["line"], F.coalesce(x["title"], F.lit(""))
        marks = F.substring(F.lit("######"), F.lit(1), heading_level(line))
        name = F.when(title != "", F.concat(marks, F.lit(" "), title))
        return F.when(nameless(line), name).otherwise(line)

    # From the last line to the first: the nearest line that says anything, as it was before any
    # heading got its name.
    text = F.transform(F.reverse("lines"), lambda x: F.when(strip(x) != "", x))
    nearest = scan(F.col("_texts"), F.lit(None).cast("string"), lambda s, x: F.coalesce(x, s))
    some = F.coalesce(F.exists("lines", nameless), F.lit(False))
    below = F.transform(after_first(F.col("_nearest")), infer_title)
    pairs = F.arrays_zip(F.col("lines").alias("line"), below.alias("title"))
    return (
        docs.withColumn("_texts", F.when(some, text))
        .withColumn("_nearest", F.when(F.col("_texts").isNotNull(), F.reverse(nearest)))
        .withColumn(
            "lines",
            F.when(F.col("_nearest").isNotNull(), F.transform(pairs, named)).otherwise(F.col("lines")),
        )
        .drop("_texts", "_nearest")
    )


def is_boilerplate(stripped: Column) -> Column:
    """Short line, no heading, that opens with a phrase of page chrome."""
    opening = F.lower(F.rtrim(F.ltrim(stripped, F.lit("-*| ")), F.lit("| ")))
    return (
        (F.length(stripped) <= MAX_BOILERPLATE_CHARS)
        & ~F.startswith(stripped, F.lit("#"))
        & opening.rlike(f"^(?:{'|'.join(BOILERPLATE)})")
    )


def tidy_lines(docs: DataFrame, drop_boilerplate: bool = True) -> DataFrame:
    """Tidy the blanks of each line: "" for a paragraph break, null for a line that goes.

    Marks without text go, but not the rule of a table; so do headings without a letter.
    """

    def tidy(x: Column) -> Column:
        tidied, stripped = x["tidied"], x["stripped"]
        only_marks = strip_chars(stripped, "#-*| ") == ""
        nameless = (heading_level(stripped) > 0) & ~has_letter(heading_title(stripped))
        rule = (
            F.when(stripped == "", F.lit(""))
            .when(only_marks, F.when(F.startswith(stripped, F.lit("|-")), tidied))
            .when(nameless, F.lit(None))
        )
        if drop_boilerplate:
            rule = rule.when(is_boilerplate(stripped), F.lit(None))
        return rule.otherwise(tidied)

    blanks = lambda x: rstrip(F.regexp_replace(x, r"[ \t]{2,}", " "))
    stripped = F.transform("_tidied", strip)
    both = F.arrays_zip(F.col("_tidied").alias("tidied"), stripped.alias("stripped"))
    return (
        docs.withColumn("_tidied", F.transform("lines", blanks))
        .withColumn("lines", F.transform(both, tidy))
        .drop("_tidied")
    )


def join_lines(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Lines back to one text per document, at most one blank line in a row.

    A filter on the text would be moved below all steps before it and repeat them, each within the
    next; behind an outer explode it stays where it is.
    """
    joined = F.regexp_replace(F.array_join("lines", "\n"), r"\n{3,}", "\n\n")
    whole = F.array(F.concat(strip(joined), F.lit("\n")))
    rest = [c for c in docs.columns if c != "lines"]
    return docs.select(*rest, F.explode_outer(whole).alias(text))


def clean_markdown(
    docs: DataFrame,
    options: CleanOptions = CleanOptions(),
    doc: str = "doc_id",
    text: str = "markdown",
) -> DataFrame:
    """(doc, markdown) to (doc, markdown), cleaned within its row."""
    docs = with_lines(clean_inline(docs.select(doc, text), options, text), text)
    if options.drop_sections:
        docs = drop_sections(docs, tuple(t.lower() for t in options.drop_sections))
    if options.name_empty_headings:
        docs = name_empty_headings(docs)
    return join_lines(tidy_lines(docs, options.drop_boilerplate), text)


def cleaning_report(docs: DataFrame, stage: str, text: str = "markdown") -> DataFrame:
    """One row of corpus counts: what a cleaning stage leaves behind."""
    body = F.col(text)
    heading = r"(?m)^[ \t]*#"
    return docs.agg(
        F.count("*").alias("documents"),
        F.sum(F.length(body)).alias("chars"),
        F.sum(count_of(body, "\n")).alias("line_ends"),
        F.sum(F.regexp_count(body, F.lit(LINK))).alias("links"),
        F.sum(F.regexp_count(body, F.lit(HTML_TAG))).alias("tags"),
        F.sum(F.regexp_count(body, F.lit(CITATION))).alias("citations"),
        F.sum(F.regexp_count(body, F.lit(heading))).alias("headings"),
    ).select(F.lit(stage).alias("stage"), "*")
