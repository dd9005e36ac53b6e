"""HTML pages to markdown with column expressions only: no shuffle, no Python.

Every rule is one rewrite of the whole page, ordered so that a later rule cannot be
misled by text an earlier one should have removed (scripts may contain ``</p>``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, WS_SET, heading_level, split_lines, strip

# Elements dropped with all they hold, elements that start a new line, and
# the named entities that are decoded ("&amp;" last, so that nothing is decoded twice).
CODE = ("script", "style")
DROPPED = ("head", "footer")
NAVIGATION = ("nav",)
BLOCKS = (
    "p div section article main header aside ul ol table thead tbody blockquote pre dl dt dd "
    "figure figcaption hr br"
).split()
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&ndash;": "–",
    "&mdash;": "—",
    "&hellip;": "…",
}
AD_BLOCK = r"(?is)<div[^>]*\bclass=\"ad\"[^>]*>.*?</div>"

# What precedes a link's target, and the parts of a table.
HREF = r'(?i)(<a\b[^>]*?\shref\s?=\s?")([^"]*)'
TABLE = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
ROW = r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|\z)"
CELL = r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|\z)"
#: The line below the first row of a table.
RULE = r"^\|(?: --- \|)+$"


def _drop_elements(html: Column, names: tuple[str, ...]) -> Column:
    return F.regexp_replace(html, rf"(?is)<({'|'.join(names)})\b[^>]*>.*?</\1\s*>", "")


def decode_named(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def decode_numeric(text: Column) -> Column:
    """Decimal and hexadecimal character references; each that occurs is replaced throughout.

    Numbers that stand for no character (beyond the last one, or half of a surrogate pair) stay
    as they are written.
    """
    written = F.array_distinct(
        F.regexp_extract_all(text, F.lit(r"(?i)&#(\d{1,7}|x[0-9a-f]{1,6});"), F.lit(1))
    )

    def decoded(acc: Column, code: Column) -> Column:
        digits = F.when(F.lower(F.left(code, F.lit(1))) == "x", F.conv(F.substr(code, F.lit(2)), 16, 10))
        number = F.coalesce(digits, code).cast("int")
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.when(
            valid, F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")), character)
        ).otherwise(acc)

    return F.aggregate(written, text, decoded)


def without_chrome(html: Column, keep_nav: bool = False) -> Column:
    """The page without comments, scripts, styles, advertising and navigation."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = _drop_elements(html, CODE)
    html = _drop_elements(html, DROPPED if keep_nav else DROPPED + NAVIGATION)
    return F.regexp_replace(html, AD_BLOCK, "")


def article_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article\s*>", 1)


def quoted_links(html: Column) -> Column:
    """The targets of links in double quotes, however they were written."""
    link = r"(?i)(<a\b[^>]*?\shref\s?=\s?)"
    html = F.regexp_replace(html, rf"{link}'([^'\"]*)'", '$1"$2"')
    return F.regexp_replace(html, rf"{link}(?![\"' ])([^\s\"'>]+)", '$1"$2"')


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` followed, however many there are."""
    steps = F.split(path, "/", -1)
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.array_append(done, step)),
    )
    ended = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    followed = F.concat(F.array_join(walked, "/"), ended)
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), followed).otherwise(path)


def resolve(link: Column, origin: Column, page: Column, url: Column) -> Column:
    """A link on the page at ``url``: absolute, its path without dots; an empty one stays empty."""
    folder = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(
        F.regexp_extract(page, r"^.*/", 0)
    )
    absolute = (
        F.when(link == "", link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.substring_index(origin, "//", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.substring_index(url, "#", 1), link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link)
        .otherwise(F.concat(folder, link))
    )
    path = F.regexp_extract(absolute, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    host = F.regexp_extract(absolute, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", 0)
    rest = F.substr(absolute, F.length(host) + F.length(path) + 1)
    return F.when(path == "", absolute).otherwise(F.concat(host, without_dots(path), rest))


def with_absolute_links(pages: DataFrame, body: str, url: str) -> DataFrame:
    """Links of ``body`` that are relative to the page's ``url``, resolved; without one they stay.

    The page is cut at its links once, each is resolved by itself, and the parts are joined again.
    """
    at = F.col(url)
    linked = F.col(body).rlike(r"(?i)\shref\s?=")
    cut = pages.withColumn("_linked", F.when(linked, F.col(body)))
    text = F.col("_linked")  # null where there is nothing to look for
    cut = cut.withColumns(
        {
            "_origin": F.regexp_extract(at, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", 0),
            "_page": F.regexp_extract(at, r"^[^?#]*", 0),
            "_openings": F.regexp_extract_all(text, F.lit(HREF), F.lit(1)),
            "_links": F.regexp_extract_all(text, F.lit(HREF), F.lit(2)),
            "_between": F.split(text, HREF, -1),
        }
    )
    links = F.transform("_links", lambda a: resolve(a, F.col("_origin"), F.col("_page"), at))
    parts = F.transform(
        F.arrays_zip(F.slice("_between", F.lit(2), F.size("_links")).alias("text"), F.col("_openings").alias("opening"), links.alias("link")),
        lambda x: F.concat(x["opening"], x["link"], x["text"]),
    )
    known = F.coalesce(F.col("_origin"), F.lit("")) != ""
    resolved = F.concat(F.element_at("_between", 1), F.array_join(parts, ""))
    there = known & (F.size("_links") > 0)
    return cut.withColumn(body, F.when(there, resolved).otherwise(F.col(body))).drop(
        "_linked", "_origin", "_page", "_openings", "_links", "_between"
    )


def table_lines(table: Column) -> Column:
    """The inside of a table as lines: text outside its rows, the first row, a rule, the other rows."""
    block = rf"(?i)</?(?:{'|'.join(BLOCKS)}|li|h[1-6])\b[^>]*>"

    def cell(inside: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(inside, block, " "), r"</?[a-zA-Z][^>]*>", "")
        return F.replace(strip(F.regexp_replace(flat, rf"{WS}+", " ")), F.lit("|"), F.lit("\\|"))

    def cells(row: Column) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(CELL), F.lit(1)), cell)

    rows = F.filter(
        F.transform(F.regexp_extract_all(table, F.lit(ROW), F.lit(1)), cells), lambda c: F.size(c) > 0
    )
    written = F.transform(rows, lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(rows, 1))))
    ruled = F.concat(F.slice(written, 1, 1), F.array(rule), F.slice(written, F.lit(2), F.size(written)))
    outside = F.regexp_replace(table, ROW, "")
    return F.concat(outside, F.lit("\n\n"), F.when(F.size(rows) > 0, F.array_join(ruled, "\n")).otherwise(""))


def with_tables(pages: DataFrame, body: str) -> DataFrame:
    """Tables of ``body`` as lines of markdown. Of nested ones, the inner ends the outer one."""
    text = F.col(body)
    cut = pages.withColumns(
        {
            "_tables": F.regexp_extract_all(text, F.lit(TABLE), F.lit(1)),
            "_between": F.split(text, TABLE, -1),
        }
    )
    parts = F.transform(
        F.arrays_zip(F.col("_tables").alias("table"), F.slice("_between", F.lit(2), F.size("_tables")).alias("text")),
        lambda x: F.concat(F.lit("\n\n"), table_lines(x["table"]), F.lit("\n\n"), x["text"]),
    )
    written = F.concat(F.element_at("_between", 1), F.array_join(parts, ""))
    there = F.size("_tables") > 0
    return cut.withColumn(body, F.when(there, written).otherwise(text)).drop("_tables", "_between")


def headings_and_anchors(html: Column) -> Column:
    """Headings and links as marks."""
    html = F.regexp_replace(html, r"(?i)<h([1-6])\b[^>]*>|</h[1-6]\s*>", "\n\n<h$1>")
    for level in range(1, 7):
        html = F.replace(html, F.lit(f"<h{level}>"), F.lit("#" * level + " "))
    return F.regexp_replace(
        F.replace(html, F.lit("<h>"), F.lit("")),
        r"(?i)<a\b[^>]*\bhref\s?=\s?\"([^\"]*)\"[^>]*>(.*?)</a\s*>",
        "[$2]($1)",
    )


def rows_to_marks(html: Column) -> Column:
    """Rows and cells outside tables."""
    for pattern, mark in (
        (r"(?i)</t[dh]\s*>", " |"),
        (r"(?i)<tr\b[^>]*>", "\n|"),
        (r"(?i)<t[dh]\b[^>]*>", " "),
    ):
        html = F.regexp_replace(html, pattern, mark)
    return html


def tags_to_marks(html: Column) -> Column:
    """List items as marks, the ends of blocks as line ends; all other tags are dropped."""
    for pattern, mark in (
        (r"(?i)<li\b[^>]*>", "\n- "),
        (rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n\n"),
        (r"</?[a-zA-Z][^>]*>", ""),
    ):
        html = F.regexp_replace(html, pattern, mark)
    return html


def with_page_lines(pages: DataFrame, keep_nav: bool = False, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``lines``: the stripped, non-empty markdown lines of the page.

    Steps that look at their input more than once are columns of their own, so that the
    passes before them run once.
    """
    body = F.col("_body")
    pages = pages.withColumn("_body", without_chrome(F.col(html), keep_nav)).drop(html)
    if not keep_nav:
        pages = pages.withColumn("_article", article_of(body)).withColumn(
            "_body", F.when(F.col("_article") != "", F.col("_article")).otherwise(body)
        )
    blanks = rf"{WS}{{2,}}|[{WS_SET}&&[^ ]]"  # a single blank is one already
    pages = pages.withColumn("_body", F.regexp_replace(body, blanks, " "))
    unquoted = body.rlike(r"(?i)\shref\s?=\s?[^\"\s]")
    pages = pages.withColumn("_body", F.when(unquoted, quoted_links(body)).otherwise(body))
    if "url" in pages.columns:
        pages = with_absolute_links(pages, "_body", "url")
    pages = with_tables(pages.withColumn("_body", headings_and_anchors(body)), "_body")
    pages = pages.withColumn("_body", F.when(body.rlike("(?i)</?t[rdh]"), rows_to_marks(body)).otherwise(body))
    pages = pages.withColumn("_body", decode_named(tags_to_marks(body)))
    numeric = F.when(F.contains(body, F.lit("&#")), decode_numeric(body)).otherwise(body)
    pages = pages.withColumn("_body", F.replace(numeric, F.lit("&amp;"), F.lit("&")))
    stripped = F.transform(split_lines(body), strip)
    # Behind an outer explode, filters on the result stay where they are and repeat no pass.
    lines = F.array(F.filter(stripped, lambda line: line != ""))
    rest = [c for c in pages.columns if c not in ("_body", "_article")]
    return pages.select(*rest, F.explode_outer(lines).alias("lines"))


def join_blocks(lines: Column) -> Column:
    """Blocks parted by blank lines; the rows of one table follow one another."""

    def parted(line: Column, i: Column) -> Column:
        row = F.startswith(line, F.lit("|")) & F.startswith(F.get(lines, i - 1), F.lit("|"))
        first = F.coalesce(F.get(lines, i + 1).rlike(RULE), F.lit(False))
        gap = F.when(i == 0, "").when(row & ~first, "\n").otherwise("\n\n")
        return F.concat(gap, line)

    return F.array_join(F.transform(lines, parted), "")


def page_markdown(pages: DataFrame, keep_nav: bool = False, html: str = "html") -> DataFrame:
    """(…, html) to (…, markdown): one paragraph, heading, item or table per block."""
    lines = with_page_lines(pages, keep_nav, html)
    return lines.withColumn("markdown", join_blocks(F.col("lines"))).drop("lines")


def block_kind(line: Column) -> Column:
    return (
        F.when(heading_level(line) > 0, "heading")
        .when(F.startswith(line, F.lit("- ")), "item")
        .when(line.rlike(RULE), "rule")
        .when(F.startswith(line, F.lit("|")), "row")
        .otherwise("text")
    )


def page_blocks(
    pages: DataFrame, keep_nav: bool = False, page: str = "page_id", html: str = "html"
) -> DataFrame:
    """(page, pos, kind, lvl, text), one row per block in page order."""
    known = [c for c in (page, "url", html) if c in pages.columns]
    lines = with_page_lines(pages.select(*known), keep_nav, html)
    # An inner explode would be given a filter on its input, and the filter would repeat
    # all passes over the page; the outer one is filtered behind it.
    blocks = lines.select(page, F.posexplode_outer("lines").alias("pos", "text"))
    text = F.col("text")
    return blocks.filter(text.isNotNull()).select(
        page, "pos", block_kind(text).alias("kind"), heading_level(text).alias("lvl"), "text"
    )
