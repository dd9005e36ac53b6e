"""Building blocks of the SQL that the registered queries are compared with.

They state each rule in another way than the Spark code where there is one: headings in
force by intervals instead of running windows, splitting by recursion over boundary
lists, similarities by joins of sparse weights.
"""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINK = r"\[([^\[\]]*)\]\((?:[^()]*(?:\([^()]*\)[^()]*)*)\)"
TAG = r"</?[a-zA-Z][^>]*>"
CITATION = rf"\[{WS}*\p{{Nd}}+(?:{WS}*[,–-]{WS}*\p{{Nd}}+)*{WS}*\]"


def with_(
    *ctes: tuple[str, str], last: str, recursive: bool = True, once: tuple[str, ...] = ()
) -> str:
    """One statement; the parts named in ``once`` are computed once, however often they are read."""
    kind = lambda name: "MATERIALIZED " if name in once else ""
    body = ",\n".join(f"{name} AS {kind(name)}({text})" for name, text in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{last}"


def sub(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def strip(text: str) -> str:
    return sub(text, f"^{WS}+|{WS}+$")


def rstrip(text: str) -> str:
    return f"regexp_replace({text}, '{WS}+$', '')"


def level(line: str) -> str:
    return f"CAST(length(regexp_extract({strip(line)}, '^(#{{1,6}})', 1)) AS INTEGER)"


def title(line: str) -> str:
    return f"regexp_extract({strip(line)}, '(?s)^#{{1,6}}{WS}*(.*?){WS}*#*$', 1)"


# The composed corpus: one markdown document per conversation turn, with links, nested
# citations, empty headings, chrome, tables and closing sections put around its text.
# The expression is plain SQL that both engines read alike.
MARKDOWN = """
'# Conversation ' || CAST(conv_id AS STRING) || '

Skip to main content

Start ' || chr(92) || '[here' || chr(92) || '] with the [guide (' || role || ')](http://e.example/g_(' || CAST(turn AS STRING) || ')) .
-
## Turn ' || CAST(turn AS STRING) || ' ##

' || CASE WHEN turn % 3 = 0 THEN '### ' ELSE '### <sub>' || CAST(turn AS STRING) || '</sub>)' END || '

' || text || ' [[' || CAST(turn AS STRING) || '](http://e.example#en' || CAST(turn AS STRING) || ')] ****

' || repeat('#', CAST(3 + conv_id % 3 AS INT)) || ' Said by the ' || role || '

' || text || ' (see [w](http://e.example/' || CAST(turn AS STRING) || ')) and [1, 2–3] at http://e.example/x  now ;  ( ) end .

| key | value | more |
|---|---|---|
| ' || CAST(turn AS STRING) || ' | ' || role || ' | <b>x</b> |
|  |  |

' || CASE WHEN turn % 2 = 0 THEN '### 

The ' || role || ', also known as speaker, is heard.

##### Detail of a very long heading that goes on about conversation ' || CAST(conv_id AS STRING) || ' for quite a while

' || text || '



' ELSE 'Share this page

' END || CASE WHEN turn % 4 = 1 THEN '## Disclaimer:

nothing to keep here

### Kept out

more of it
### 
' ELSE '' END || '## References

1. Some [ref](http://e.example/r)
### Nested

a nested reference
' || CASE WHEN conv_id % 2 = 1 THEN '# Afterword

' || text || '
' ELSE '' END
"""

MD_CORPUS = (
    "md_corpus",
    f"SELECT conv_id * 1000000 + turn AS doc_id, {MARKDOWN} AS markdown FROM conversations",
)


def lines(source: str, text: str = "markdown") -> str:
    cut = f"regexp_replace({text}, '(?:{LINE_END})$', '')"
    return f"""
    SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS line
    FROM (SELECT doc_id, CASE WHEN {text} = '' THEN [] ELSE
            regexp_split_to_array({cut}, '{LINE_END}') END AS a FROM {source})"""


def unwrapped(text: str) -> str:
    for _ in range(6):
        text = sub(text, LINK, r"\1")
    return text


def unescaped(text: str) -> str:
    return rf"replace(replace({text}, '\[', ''), '\]', '')"


def tidied(text: str) -> str:
    return sub(sub(text, rf"{WS}+([.,;:)])", r"\1"), rf"\({WS}*\)")


def inline(text: str) -> str:
    text = sub(unwrapped(unescaped(text)), rf"https?://{NOT_WS}+")
    text = sub(sub(text, TAG), CITATION)
    return tidied(sub(text, r"\*{3,}", " "))


# A heading is in force from its line to the next heading of its own or a lower level.
def headings_in_force(source: str, untitled: bool) -> str:
    titled = "" if untitled else f"AND {title('line')} <> ''"
    return f"""
    WITH h AS (SELECT doc_id, pos, {level('line')} AS lvl, {title('line')} AS title
               FROM {source} WHERE {level('line')} > 0 {titled})
    SELECT a.doc_id, a.pos, a.lvl, a.title,
           coalesce(min(b.pos), 2147483647) AS until_pos
    FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.lvl <= a.lvl
    GROUP BY a.doc_id, a.pos, a.lvl, a.title"""


def drop_sections(source: str) -> list[tuple[str, str]]:
    return [
        ("h_all", headings_in_force(source, untitled=True)),
        (
            "kept",
            f"""
    SELECT * FROM {source} l WHERE NOT EXISTS (
      SELECT 1 FROM h_all h WHERE h.doc_id = l.doc_id
        AND trim(lower(h.title), ': ') IN ('references', 'disclaimer')
        AND l.pos >= h.pos AND l.pos < h.until_pos)""",
        ),
    ]


STOPS = "is|are|was|were|has|have|can|may|might|refers|consists|occurs|includes|comes|and|or|also|which|that"


def inferred(line: str) -> str:
    """Title taken from the line after an empty heading."""
    text = strip(line)
    # Text before a stop word, before a stop mark, or all of it: the shortest counts.
    word = rf"regexp_extract({text}, '^((?:.*?[^\p{{L}}\p{{N}}_])??)(?:{STOPS})(?:[^\p{{L}}\p{{N}}_]|$)', 1)"
    has_word = rf"regexp_matches({text}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{STOPS})(?:[^\p{{L}}\p{{N}}_]|$)')"
    mark = rf"regexp_extract({text}, '^([^,:;(\[–—]*)', 1)"
    subject = f"""CASE WHEN {has_word} AND length({word}) < length({mark}) THEN {word} ELSE {mark} END"""
    return f"trim({subject}, ' .*_|')"


def named_headings(source: str) -> list[tuple[str, str]]:
    words = f"list_filter(regexp_split_to_array(subject, '{WS}+'), lambda w: w <> '')"
    return [
        (
            "looked_ahead",
            f"""
    SELECT l.*, {level('l.line')} AS lvl, {title('l.line')} AS title,
      (SELECT arg_min(n.line, n.pos) FROM {source} n WHERE n.doc_id = l.doc_id AND n.pos > l.pos
         AND {strip('n.line')} <> '') AS following FROM {source} l""",
        ),
        (
            "subjects",
            f"SELECT *, CASE WHEN following IS NULL OR {level('following')} > 0 THEN '' ELSE "
            f"{inferred('following')} END AS subject FROM looked_ahead",
        ),
        ("worded", f"SELECT *, {words} AS words FROM subjects"),
        (
            "named",
            r"""
    SELECT doc_id, pos, CASE WHEN lvl > 0 AND NOT regexp_matches(title, '\p{L}')
        THEN repeat('#', lvl) || ' ' || substring(array_to_string(words, ' '), 1, 40)
        ELSE line END AS line
    FROM worded WHERE NOT (lvl > 0 AND NOT regexp_matches(title, '\p{L}')
      AND (len(words) = 0 OR len(words) > 5 OR NOT regexp_matches(words[1], '^\p{L}')))""",
        ),
    ]


BOILERPLATE = (
    "ask ods|have a question|join the|ods email list|email list|skip to|print this|share this|"
    "back to top|consumer|health professional|other resources|subscribe"
)


def tidy_lines(source: str, name: str = "tidy") -> list[tuple[str, str]]:
    return [
        (
            f"{name}_0",
            f"SELECT doc_id, pos, {rstrip(sub('line', '[ ' + chr(92) + 't]{2,}', ' '))} AS line FROM {source}",
        ),
        (
            name,
            rf"""
    SELECT doc_id, pos, CASE WHEN s = '' THEN '' ELSE line END AS line
    FROM (SELECT *, {strip('line')} AS s FROM {name}_0)
    WHERE s = '' OR (
      CASE WHEN regexp_matches(s, '^[#*| -]+$') THEN s[:2] = '|-'
           WHEN {level('s')} > 0 AND NOT regexp_matches({title('s')}, '\p{{L}}') THEN false
           WHEN length(s) <= 60 AND s[1] <> '#'
             AND regexp_matches(lower(s), '^[-*| ]*(?:{BOILERPLATE})') THEN false
           ELSE true END)""",
        ),
    ]


def joined(source: str) -> str:
    text = "string_agg(line, chr(10) ORDER BY pos)"
    body = rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT doc_id, {strip(body)} || chr(10) AS markdown FROM {source} GROUP BY doc_id"


def clean(source: str) -> list[tuple[str, str]]:
    return [
        ("inlined", f"SELECT doc_id, {inline('markdown')} AS markdown FROM {source}"),
        ("raw_lines", lines("inlined")),
        *drop_sections("raw_lines"),
        *named_headings("kept"),
        *tidy_lines("named"),
        ("cleaned", joined("tidy")),
    ]


def sections(source: str, max_chars: int = 80) -> list[tuple[str, str]]:
    fits = f"list_filter(range(1, len(p) + 1), lambda i: length(array_to_string(p[i:], ' > ')) <= {max_chars} OR i = len(p))[1]"
    return [
        ("s_lines", lines(source)),
        ("h_titled", headings_in_force("s_lines", untitled=False)),
        (
            "s_paths",
            f"""
    SELECT doc_id, pos, array_to_string(p[{fits}:], ' > ') AS section FROM (
      SELECT doc_id, pos, CASE WHEN len(deep) > 0 THEN deep ELSE every END AS p FROM (
        SELECT h.doc_id, h.pos, list(a.title ORDER BY a.pos) AS every,
               coalesce(list(a.title ORDER BY a.pos) FILTER (a.lvl > 1), []) AS deep
        FROM h_titled h JOIN h_titled a
          ON a.doc_id = h.doc_id AND a.pos <= h.pos AND h.pos < a.until_pos
        GROUP BY h.doc_id, h.pos))""",
        ),
        (
            "s_numbered",
            """
    SELECT l.*, h.pos IS NOT NULL AS is_heading,
      CAST(count(h.pos) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS INTEGER) AS section_seq
    FROM s_lines l LEFT JOIN h_titled h ON h.doc_id = l.doc_id AND h.pos = l.pos""",
        ),
        (
            "sectioned",
            f"""
    SELECT n.doc_id, n.section_seq, coalesce(max(p.section), '') AS section,
      {strip("coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY n.pos), '')")} AS body
    FROM s_numbered n LEFT JOIN s_paths p ON p.doc_id = n.doc_id AND p.pos = n.pos
    GROUP BY n.doc_id, n.section_seq
    HAVING {strip("coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY n.pos), '')")} <> ''""",
        ),
    ]


def prefixed(source: str, size: int, overlap: int, prepend: bool = True) -> list[tuple[str, str]]:
    budget = max(size // 3, 20)
    prefix = f"""CASE WHEN section = '' OR NOT {prepend} THEN ''
      WHEN length(section) > {budget}
      THEN {rstrip(f'substring(section, 1, {budget - 1})')} || '…' || chr(10) || chr(10)
      ELSE section || chr(10) || chr(10) END"""
    return [
        ("p_0", f"SELECT *, {prefix} AS prefix FROM {source}"),
        ("p_1", f"SELECT *, greatest({size} - length(prefix), {size // 2}) AS size FROM p_0"),
        ("prefixed", f"SELECT *, least({overlap}, size // 2) AS overlap FROM p_1"),
    ]


def split_bodies(source: str) -> list[tuple[str, str]]:
    """(doc_id, section_seq, body, size, overlap) to ordered stripped pieces."""
    ctes = [
        (
            "seg_1",
            f"SELECT doc_id, section_seq, size, overlap, 0 AS start, body AS txt FROM {source}",
        )
    ]
    for depth, sep in ((1, "chr(10) || chr(10)"), (2, "chr(10)"), (3, "' '")):
        ctes += [
            (
                f"cut_{depth}",
                f"""
    SELECT doc_id, section_seq, size, overlap, start AS seg, i, part,
      start + CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id, section_seq, start ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT * EXCLUDE (part), CASE WHEN i > 1 THEN {sep} || part ELSE part END AS part FROM (
      SELECT doc_id, section_seq, size, overlap, start, unnest(string_split(txt, {sep})) AS part,
        generate_subscripts(string_split(txt, {sep}), 1) AS i
      FROM seg_{depth} WHERE contains(txt, {sep}))) WHERE part <> ''""",
            ),
            (
                f"seg_{depth + 1}",
                f"""
    SELECT doc_id, section_seq, size, overlap, start, part AS txt FROM cut_{depth} WHERE length(part) >= size
    UNION ALL SELECT * FROM seg_{depth} WHERE NOT contains(txt, {sep})""",
            ),
            (
                f"run_{depth}",
                f"""
    SELECT doc_id, section_seq, size, overlap,
      list_append(list(start ORDER BY start), max(start + length(part))) AS bounds
    FROM (SELECT *, sum(CASE WHEN length(part) >= size THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id, section_seq, seg ORDER BY start) AS island FROM cut_{depth})
    WHERE length(part) < size GROUP BY doc_id, section_seq, size, overlap, seg, island""",
            ),
        ]
    ctes += [
        ("runs", "SELECT * FROM run_1 UNION ALL SELECT * FROM run_2 UNION ALL SELECT * FROM run_3"),
        (
            "packed",
            """
    SELECT *, bounds[1] AS s, list_max(list_filter(bounds, lambda b: b <= bounds[1] + size)) AS e FROM runs
    UNION ALL
    SELECT doc_id, section_seq, size, overlap, bounds, s2 AS s,
      list_max(list_filter(bounds, lambda b: b <= s2 + size)) AS e
    FROM (SELECT *, list_min(list_filter(bounds, lambda b: b >= s AND b >= e - overlap
             AND (b = e OR b >= nxt - size))) AS s2
          FROM (SELECT *, list_min(list_filter(bounds, lambda b: b > e)) AS nxt
                FROM packed WHERE e < list_max(bounds)))""",
        ),
        (
            "spans",
            """
    SELECT doc_id, section_seq, s, e FROM packed
    UNION ALL
    SELECT doc_id, section_seq, start + k * (size - overlap),
      start + least(k * (size - overlap) + size, length(txt))
    FROM (SELECT *, unnest(range(length(txt))) AS k FROM seg_4)
    WHERE k = 0 OR k * (size - overlap) + overlap < length(txt)""",
        ),
        (
            "pieces",
            f"""
    SELECT * FROM (SELECT doc_id, section_seq, s, {strip('substring(body, s + 1, e - s)')} AS piece
      FROM spans JOIN {source} USING (doc_id, section_seq)) WHERE piece <> ''""",
        ),
    ]
    return ctes


def fold_pieces(source: str, min_chars: int) -> list[tuple[str, str]]:
    """Pieces of each section folded to chunks bodies: (doc_id, section_seq, nth, piece)."""
    return [
        (
            "worth",
            rf"""
    SELECT doc_id, section_seq, size, list(piece ORDER BY s) AS ps
    FROM pieces JOIN (SELECT doc_id, section_seq, size FROM {source}) USING (doc_id, section_seq)
    WHERE regexp_matches(piece, '[\p{{L}}\p{{N}}]') GROUP BY doc_id, section_seq, size""",
        ),
        (
            "folding",
            f"""
    SELECT doc_id, section_seq, size, ps, 1 AS i, [ps[1]] AS m FROM worth
    UNION ALL
    SELECT doc_id, section_seq, size, ps, i + 1,
      CASE WHEN length(ps[i + 1]) < {min_chars} AND length(m[-1]) + length(ps[i + 1]) + 1 <= size
        THEN list_append(m[1:len(m) - 1], m[-1] || chr(10) || ps[i + 1])
        ELSE list_append(m, ps[i + 1]) END
    FROM folding WHERE i < len(ps)""",
        ),
        (
            "folded",
            f"""
    SELECT doc_id, section_seq, unnest(range(len(m))) AS nth, unnest(m) AS piece FROM (
      SELECT doc_id, section_seq, CASE WHEN len(m) > 1 AND length(m[1]) < {min_chars}
          AND length(m[1]) + length(m[2]) + 1 <= size
        THEN list_prepend(m[1] || chr(10) || m[2], m[3:]) ELSE m END AS m
      FROM folding WHERE i = len(ps))""",
        ),
    ]


def chunk_rows() -> list[tuple[str, str]]:
    return [
        (
            "chunk_texts",
            """
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_seq, nth) - 1
        AS INTEGER) AS chunk_index, section, prefix || piece AS text
    FROM folded JOIN prefixed USING (doc_id, section_seq)""",
        ),
        (
            "chunks",
            """
    SELECT doc_id, chunk_index, printf('c%04d-', chunk_index) || substr(sha1(text), 1, 8) AS chunk_id,
      section, text, CAST(length(text) AS INTEGER) AS size FROM chunk_texts""",
        ),
    ]


def chunk_ctes(
    source: str, size: int = 600, overlap: int = 100, min_chars: int = 80, prepend: bool = True
) -> list[tuple[str, str]]:
    """Everything from (doc_id, markdown), already clean, to ``chunks``."""
    return [
        *sections(source),
        *prefixed("sectioned", size, overlap, prepend),
        *split_bodies("prefixed"),
        *fold_pieces("prefixed", min_chars),
        *chunk_rows(),
    ]


MD_CHUNKS = [MD_CORPUS, *clean("md_corpus"), *chunk_ctes("cleaned", 300, 50, 60)]


# --- pages -----------------------------------------------------------------------------


def page_lines(html: str, keep_nav: bool = False) -> str:
    text = sub(html, r"(?s)<!--.*?-->")
    for name in ("script", "style", "head", "footer") + (() if keep_nav else ("nav",)):
        text = sub(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>")
    text = sub(text, r'(?is)<div[^>]*\bclass="ad"[^>]*>.*?</div>')
    if not keep_nav:
        article = rf"regexp_extract({text}, '(?is)<article\b[^>]*>(.*)</article\s*>', 1)"
        text = f"coalesce(nullif({article}, ''), {text})"
    return text


def page_markup(text: str, url: str = "url") -> str:
    text = sub(text, f"{WS}+", " ")
    # All links of the pages begin at the root of their host.
    host = f"split_part({url}, '/', 1) || '//' || split_part(split_part(split_part({url}, '/', 3), '?', 1), '#', 1)"
    text = rf"""replace({text}, 'href="/', 'href="' || {host} || '/')"""
    for n in range(1, 7):
        text = f"regexp_replace({text}, '(?i)<h{n}\\b[^>]*>', chr(10) || chr(10) || '{'#' * n} ', 'g')"
    for pattern, mark in (
        (r"(?i)</h[1-6]\s*>", "chr(10) || chr(10)"),
        (r'(?i)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a\s*>', r"'[\2](\1)'"),
        (r"(?i)<li\b[^>]*>", "chr(10) || '- '"),
        (r"(?i)</t[dh]\s*>", "' |'"),
        (r"(?i)<tr\b[^>]*>", "chr(10) || '|'"),
        (r"(?i)<t[dh]\b[^>]*>", "' '"),
        (
            r"(?i)</?(?:p|div|section|article|main|header|aside|ul|ol|table|thead|tbody|blockquote"
            r"|pre|dl|dt|dd|figure|figcaption|hr|br)\b[^>]*>",
            "chr(10) || chr(10)",
        ),
        (TAG, "''"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {mark}, 'g')"
    for entity, character in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
        ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"),
        ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def page_blocks(keep_nav: bool = False) -> list[tuple[str, str]]:
    """``blocks``: (page_id, url, pos, line) of the stripped lines that are not empty."""
    return [
        ("content", f"SELECT page_id, url, {page_lines('html', keep_nav)} AS body FROM pages"),
        ("marked", f"SELECT page_id, url, {page_markup('body')} AS body FROM content"),
        (
            "page_pieces",
            f"""SELECT page_id, url, list_filter(list_transform(
              regexp_split_to_array(body, '{LINE_END}'), lambda l: {strip('l')}), lambda l: l <> '') AS ls
            FROM marked""",
        ),
        (
            "blocks",
            """SELECT page_id, url, CAST(unnest(range(len(ls))) AS INTEGER) AS pos,
              unnest(ls) AS line FROM page_pieces""",
        ),
        (
            "page_texts",
            """SELECT page_id, url, array_to_string(ls, chr(10) || chr(10)) AS markdown
            FROM page_pieces""",
        ),
    ]


def slug(url: str) -> str:
    name = f"regexp_extract(rtrim({url}, '/'), '([^/]*)$', 1)"
    stem = rf"regexp_replace({name}, '^(.+)\.[^.]+$', '\1')"
    words = f"trim(regexp_replace(lower({stem}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif(left({words}, 60), ''), 'source')"


# --- vectors and search ---------------------------------------------------------------


def weights(source: str, keys: str, text: str, name: str) -> list[tuple[str, str]]:
    """Sparse unit vectors: (keys, bucket, weight)."""
    return [
        (
            f"{name}_words",
            rf"""SELECT {keys}, regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') AS token FROM (
              SELECT {keys}, unnest(regexp_split_to_array(lower({text}), '{WS}+')) AS w FROM {source})""",
        ),
        (
            f"{name}_counts",
            f"""SELECT {keys}, CAST('0x' || substr(md5(token), 1, 2) AS INTEGER) % 256 AS bucket,
              count(*) AS n FROM {name}_words WHERE token <> '' GROUP BY ALL""",
        ),
        (
            name,
            f"""SELECT {keys}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS weight
              FROM {name}_counts""",
        ),
    ]


QUERIES = (
    "asked",
    f"""SELECT conv_id * 1000000 + turn AS query_id, text AS query FROM conversations
      WHERE role = 'user' AND {strip('text')} <> ''""",
)

# Questions as the registered model writes them: none for texts of odd length.
MD_QUESTIONS = [
    ("said", "SELECT doc_id, chunk_id, chunk_index, section, text FROM chunks WHERE length(text) % 2 = 0"),
    (
        "questions",
        f"""SELECT doc_id, chunk_id, chunk_index, section, 0 AS nth,
          'What does ' || split_part(text, chr(10), 1) || ' say?' AS question FROM said
        UNION ALL
        SELECT doc_id, chunk_id, chunk_index, section, 1,
          {strip("replace(left(text, 50), chr(10), ' ')")} FROM said""",
    ),
]
INDEX_ROWS = (
    "index_rows",
    """SELECT doc_id, chunk_id AS row_id, text AS document, 'chunk' AS type, chunk_id AS parent_id,
      chunk_index, section FROM chunks
    UNION ALL
    SELECT doc_id, chunk_id || '-q' || nth, question, 'question', chunk_id, chunk_index, section
    FROM questions""",
)
CHUNK_ROWS_ONLY = (
    "index_rows",
    """SELECT doc_id, chunk_id AS row_id, text AS document, 'chunk' AS type, chunk_id AS parent_id,
      chunk_index, section FROM chunks""",
)
MD_INDEX = [*MD_CHUNKS, *MD_QUESTIONS, INDEX_ROWS]


def similarities(queries: str = "asked") -> list[tuple[str, str]]:
    """``sims``: every query against every index row, also those that share no word."""
    return [
        *weights("index_rows", "doc_id, row_id", "document", "row_weights"),
        *weights(queries, "query_id", "query", "query_weights"),
        (
            "shared",
            """SELECT query_id, doc_id, row_id, sum(q.weight * r.weight) AS s
            FROM query_weights q JOIN row_weights r USING (bucket) GROUP BY ALL""",
        ),
        (
            "sims",
            f"""SELECT q.query_id, i.doc_id, i.row_id, i.parent_id, round(coalesce(s, 0), 6) AS similarity
            FROM {queries} q CROSS JOIN index_rows i
            LEFT JOIN shared s ON s.query_id = q.query_id AND s.doc_id = i.doc_id AND s.row_id = i.row_id""",
        ),
    ]


def numbered(source: str, name: str = "rank") -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id
      ORDER BY similarity DESC, doc_id, row_id) AS INTEGER) AS {name} FROM {source}"""


COLLAPSE = """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id, doc_id, parent_id ORDER BY similarity DESC, row_id) AS r FROM {0}) WHERE r = 1"""


def ranked(k: int, fetch: int | None = None, collapse: bool = True) -> list[tuple[str, str]]:
    """``ranked``: the final hits as ids and scores."""
    source, ctes = "sims", []
    if fetch is not None:
        ctes.append(("fetched", f"SELECT * EXCLUDE (place) FROM ({numbered('sims', 'place')}) WHERE place <= {fetch}"))
        source = "fetched"
    if collapse:
        ctes.append(("collapsed", COLLAPSE.format(source)))
        source = "collapsed"
    return [*ctes, ("ranked", f"SELECT * FROM ({numbered(source)}) WHERE rank <= {k}")]


HITS = (
    "hits",
    """SELECT r.query_id, r.rank, r.doc_id, r.parent_id AS chunk_id,
      CASE WHEN o.type = 'question' THEN coalesce(p.document, o.document) ELSE o.document END AS text,
      r.similarity, round(1 - r.similarity, 6) AS distance, o.type AS match_type,
      o.section, o.chunk_index, CASE WHEN o.type = 'question' THEN o.document ELSE '' END AS matched_text
    FROM ranked r JOIN index_rows o ON o.doc_id = r.doc_id AND o.row_id = r.row_id
    LEFT JOIN index_rows p ON p.doc_id = r.doc_id AND p.row_id = r.parent_id""",
)
MD_SEARCH = [*MD_INDEX, QUERIES, *similarities(), *ranked(5, 15), HITS]
