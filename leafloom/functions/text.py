"""Text normalisation, tokens, excerpts, page lists and hashes as column expressions.

``(?U)`` makes the regex classes Unicode-aware, so that a no-break space counts as white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom import constants as K

CURLY = "\u2018\u2019\u201c\u201d\u00a0"
STRAIGHT = "''\"\" "


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, even inside lambdas over long arrays."""
    return F.transform(F.array(value), body)[0]


def unicode_regex(pattern: str) -> str:
    """The pattern with Unicode classes and with only the newline as a line end."""
    return "(?Ud)" + pattern


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(K.WHITESPACE))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(K.WHITESPACE))


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_line(text: Column) -> Column:
    return normalize_ws(F.lower(text))


def normalize_for_match(text: Column) -> Column:
    """Straight quotes, lower case, single spaces: the form in which a quote is looked up."""
    return normalize_line(F.translate(text, CURLY, STRAIGHT))


def repair_soft_breaks(text: Column) -> Column:
    """Joins lines broken in mid-sentence, and collapses blanks."""
    joined = F.regexp_replace(strip(text), r"(?<=[a-z,;\-])\n(?=[a-z])", " ")
    return F.regexp_replace(joined, r"[ \t]+", " ")


def cut(text: Column, limit: int, mark: str) -> Column:
    """The first ``limit`` characters and ``mark`` when the text is longer."""
    return F.when(F.length(text) > limit, F.concat(strip_end(F.substring(text, 1, limit)), F.lit(mark))).otherwise(text)


def snippet(text: Column) -> Column:
    return cut(text, K.SNIPPET_CHARS, " […]")


def tokens(text: Column, pattern: str = K.RETRIEVAL_WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def query_key(text: Column) -> Column:
    """Order-free key of a query: its distinct words of three letters or more."""
    words = F.filter(tokens(text), lambda w: F.length(w) > 2)
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def content_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def format_pages(pages: Column) -> Column:
    """``page 4``, ``pages 4-9`` or ``pages unknown``."""
    good = F.array_distinct(F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p > 0))
    first, last = F.array_min(good), F.array_max(good)
    return (
        F.when(F.size(good) == 0, F.lit("pages unknown"))
        .when(F.size(good) == 1, F.concat(F.lit("page "), first.cast("string")))
        .otherwise(F.concat(F.lit("pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    )


def source_section(number: Column, pages: Column, body: Column) -> Column:
    """One source's part of a leaf body."""
    return F.concat(
        F.lit("## Source "), number.cast("string"), F.lit(" ("), format_pages(pages), F.lit(")\n\n"), strip(body), F.lit("\n")
    )


def wrap_leaf_body(body: Column, pages: Column) -> Column:
    """Body under its source heading; a body that has one is kept."""
    bare = strip(body)
    return F.when(bare.startswith("## Source "), F.concat(bare, F.lit("\n"))).otherwise(
        source_section(F.lit(1), pages, body)
    )


def strip_source_headings(body: Column) -> Column:
    return strip(F.regexp_replace(body, r"(?m)^## Source \d+ \([^\n)]*\)\n+", ""))


def summary_block(text: Column) -> Column:
    """Text inside the summary tags, or null."""
    return F.when(text.rlike(K.SUMMARY_PATTERN), strip(F.regexp_extract(text, K.SUMMARY_PATTERN, 1)))


def split_list(text: Column) -> Column:
    """Comma-separated text to trimmed non-empty items."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def subject_scope(text: Column) -> Column:
    return F.when(text.isin(K.SUBJECT_SCOPES), text).otherwise(F.lit(K.DEFAULT_SUBJECT_SCOPE))


def capital(letter: Column) -> Column:
    """One character in upper case as one character: where that is several letters, the capital sharp s, the title case, or the character itself."""
    upper, title = F.upper(letter), F.initcap(letter)
    single = lambda c: F.length(c) == F.length(letter)
    return F.when(single(upper), upper).when(letter == "\u00df", "\u1e9e").when(single(title), title).otherwise(letter)


def title_case(text: Column) -> Column:
    return F.initcap(F.translate(text, "_-", "  "))


def node_trail(node_id: Column) -> Column:
    """Path without the subject."""
    return F.when(F.instr(node_id, "/") > 0, F.regexp_replace(node_id, "^[^/]*/", "")).otherwise(node_id)


def short_node_id(node_id: Column) -> Column:
    """Last two segments of a path."""
    return F.substring_index(node_id, "/", -2)


def last_segment(node_id: Column) -> Column:
    return F.substring_index(node_id, "/", -1)


def pretty_node_title(node_id: Column, name: Column | None = None) -> Column:
    """Name if known, else the last path segment without its number, in title case."""
    pretty = F.initcap(F.translate(F.regexp_replace(last_segment(node_id), r"^\d+-", ""), "-", " "))
    return pretty if name is None else F.coalesce(name, pretty)


def scope_label(scope: Column, subject: Column, node_id: Column, subject_name: Column) -> Column:
    """Label of a search scope. It is made of subject and topic names, never of a publisher."""
    return (
        F.when(scope == "all", F.lit("All subjects"))
        .when(
            scope == "subject",
            F.when(F.coalesce(subject, F.lit("")) == "", F.lit("Unknown subject")).otherwise(
                F.coalesce(F.nullif(subject_name, F.lit("")), title_case(subject))
            ),
        )
        .when(
            scope == "node",
            F.when(F.coalesce(node_id, F.lit("")) == "", F.lit("Unknown node")).otherwise(title_case(last_segment(node_id))),
        )
        .otherwise(scope)
    )


def rewrite_node_id(node_id: Column, old_subject: Column, book: Column, new_subject: Column) -> Column:
    """Moves a ``subject/book/...`` path under the new subject; other paths are kept. Only whole segments match."""
    prefix = F.concat(old_subject, F.lit("/"), book)
    return F.when(
        (node_id == prefix) | node_id.startswith(F.concat(prefix, F.lit("/"))), F.concat(new_subject, F.substr(node_id, F.length(prefix) + 1))
    ).otherwise(node_id)


def ancestor_paths(node_id: Column) -> Column:
    """The node's own path and every path above it."""
    parts = F.split(node_id, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def authority_rank(publisher: Column) -> Column:
    """Rank of a publisher; a fixed table of a few entries, so a map literal."""
    table = F.create_map(*[F.lit(x) for pair in K.AUTHORITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, strip(F.lower(F.coalesce(publisher, F.lit(""))))), F.lit(K.DEFAULT_RANK))
