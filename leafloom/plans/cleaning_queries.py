"""Cleaning and paragraph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import cleaning
from leafloom.plans import fixtures as fx
from leafloom.plans.fixtures import sql_text
from leafloom.plans.registry import block, query
from leafloom.session import stored

BUNDLE = "springboard_rajasthan"
ALL_PATTERNS = cleaning.patterns_for(BUNDLE)


def _steps(patterns, name: str, source: str, key: str = "book, page") -> list[str]:
    """One SQL block per pattern, each working on what the block before left."""
    previous, names = source, []
    for i, (_, pattern) in enumerate(patterns):
        this = f"{name}_{i}"
        carry = "".join(f", m{j}" for j in range(i))
        block(
            this,
            f"SELECT {key}, regexp_replace(text, {sql_text(pattern)}, '', 'g') AS text{carry}, "
            f"regexp_extract_all(text, {sql_text(pattern)}) AS m{i} FROM {previous}",
            previous,
        )
        previous = this
        names.append(this)
    return names


GENERIC_STEPS = _steps(K.GENERIC_PATTERNS, "generic", "fx_dirty_page")
ALL_STEPS = _steps(ALL_PATTERNS, "every", "fx_dirty_page")
_LABEL_SQL = " UNION ALL ".join(
    f"SELECT book, page, {i} AS step, '{label}' AS label, m{i} AS m FROM {ALL_STEPS[-1]}"
    for i, (label, _) in enumerate(ALL_PATTERNS)
)
block(
    "page_samples",
    rf"""
SELECT book, page, label, sum(len(m)) AS n,
       list_transform(flatten(list(m ORDER BY step))[1:5], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS samples
FROM ({_LABEL_SQL}) GROUP BY book, page, label HAVING sum(len(m)) > 0""",
    ALL_STEPS[-1],
)

# PF1..PF9: each pattern on the text the earlier ones leave.
_NAMES = [
    "strip_url",
    "strip_bare_domain",
    "strip_brand_line",
    "strip_email",
    "strip_social_handle",
    "strip_downloaded_from",
    "strip_pagination",
    "strip_copyright",
    "strip_social_join",
]


def _single(name: str, i: int) -> None:
    pattern = K.GENERIC_PATTERNS[i][1]

    def run(t):
        text = F.col("text")
        for _, earlier in K.GENERIC_PATTERNS[:i]:
            text = cleaning.remove(text, earlier)
        found = F.regexp_extract_all("before", F.lit(T.unicode_regex(pattern)), F.lit(0))
        return (
            fx.dirty_pages(t)
            .select("book", "page", text.alias("before"))
            .select("book", "page", F.size(found).alias("removed"), cleaning.remove(F.col("before"), pattern).alias("after"))
            .select("book", "page", "removed", F.md5("after").alias("after_md5"))
        )

    query(
        name,
        f"SELECT book, page, CAST(len(m{i}) AS INTEGER) AS removed, md5(text) AS after_md5 FROM {GENERIC_STEPS[i]}",
        (GENERIC_STEPS[i],),
    )(run)


for _i, _n in enumerate(_NAMES):
    _single(_n, _i)


@query(
    "strip_source_bundle",
    "SELECT book, page, md5(text) AS after_md5, "
    + ", ".join(f"CAST(len(m{9 + i}) AS INTEGER) AS n{i}" for i in range(8))
    + f" FROM {ALL_STEPS[-1]}",
    (ALL_STEPS[-1],),
)
def _(t):
    df = fx.dirty_pages(t)
    for _, pattern in K.GENERIC_PATTERNS:
        df = df.withColumn("text", cleaning.remove(F.col("text"), pattern))
    counts = []
    for i, (_, pattern) in enumerate(K.SOURCE_BUNDLES[BUNDLE]):
        df = df.withColumn(f"n{i}", F.size(F.regexp_extract_all("text", F.lit(T.unicode_regex(pattern)), F.lit(0))))
        df = df.withColumn("text", cleaning.remove(F.col("text"), pattern))
        counts.append(f"n{i}")
    return df.select("book", "page", *counts, F.md5("text").alias("after_md5"))


@query(
    "collapse_blank_lines",
    r"SELECT book, page, md5(regexp_replace(text, '(?:[ \t]*\n){3,}', chr(10) || chr(10), 'g')) AS after_md5 FROM fx_dirty_page",
    ("fx_dirty_page",),
)
def _(t):
    return fx.dirty_pages(t).select("book", "page", F.md5(cleaning.collapse_blank_lines(F.col("text"))).alias("after_md5"))


@query(
    "clean_text",
    rf"""
SELECT p.book, p.page, md5(regexp_replace(p.text, '(?:[ \t]*\n){{3,}}', chr(10) || chr(10), 'g')) AS cleaned_md5,
       coalesce(s.removals, '') AS removals, coalesce(s.samples, '') AS samples
FROM {ALL_STEPS[-1]} p LEFT JOIN (
  SELECT book, page, string_agg(label || '=' || n, ';' ORDER BY label) AS removals,
         string_agg(label || '=' || array_to_string(samples, '|'), ';' ORDER BY label) AS samples
  FROM page_samples GROUP BY book, page) s USING (book, page)""",
    ("page_samples",),
)
def _(t):
    df = cleaning.clean_with_report(fx.dirty_pages(t), "text", ALL_PATTERNS)
    pairs = lambda m, show: F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), show(e["value"]))), ";"
    )
    return df.select(
        "book",
        "page",
        F.md5("cleaned_text").alias("cleaned_md5"),
        pairs("removals", lambda v: v.cast("string")).alias("removals"),
        pairs("samples", lambda v: F.array_join(v, "|")).alias("samples"),
    )


@query(
    "pattern_bundle",
    f"SELECT label, sum(n)::BIGINT AS removed FROM page_samples GROUP BY label",
    ("page_samples",),
)
def _(t):
    df = cleaning.clean_with_report(fx.dirty_pages(t), "text", cleaning.patterns_for(BUNDLE))
    return cleaning.removal_counts(df)


def _report(t):
    reported = cleaning.clean_with_report(fx.dirty_pages(t), "text", ALL_PATTERNS).select("book", "page", "removals", "samples")
    return cleaning.cleanup_report(stored(reported, "removals"), "book", "page")


@query(
    "cleanup_report",
    """
SELECT book, label, sum(n)::BIGINT AS removed,
       array_to_string(flatten(list(samples ORDER BY page))[1:5], '|') AS samples
FROM page_samples GROUP BY book, label""",
    ("page_samples",),
)
def _(t):
    return _report(t).withColumn("samples", F.array_join("samples", "|"))


@query(
    "cleanup_totals",
    "SELECT book, sum(n)::BIGINT AS fragments, count(DISTINCT label) AS categories FROM page_samples GROUP BY book",
    ("page_samples",),
)
def _(t):
    reported = cleaning.clean_with_report(fx.dirty_pages(t), "text", ALL_PATTERNS)
    return cleaning.cleanup_totals(cleaning.removal_counts(reported, "book"), "book")


_SPLIT_SQL = r"""
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS paragraph_id, unnest(ps) AS text
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n+'),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 20) AS ps FROM documents)"""


@query("split_paragraphs", _SPLIT_SQL)
def _(t):
    doubled = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return cleaning.split_paragraphs(doubled, "text")


@query("number_paragraphs", "SELECT doc_id, paragraph_id, page, text FROM fx_paragraph", ("fx_paragraph",))
def _(t):
    return cleaning.number_paragraphs(fx.page_text(t).select("doc_id", "page", F.col("native_text").alias("text")))


@query(
    "load_page_table",
    "SELECT doc_id, page, length(native_text) AS native_chars FROM fx_page_text WHERE trim(native_text || ocr_text) <> ''",
    ("fx_page_text",),
)
def _(t):
    from leafloom.sources.tables import nonblank_pages

    return nonblank_pages(fx.page_text(t)).select("doc_id", "page", F.length("native_text").cast("bigint").alias("native_chars"))


@query(
    "normalize_ws",
    r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS value FROM documents",
)
def _(t):
    return t("documents").select("doc_id", F.md5(T.normalize_ws(F.col("text"))).alias("value"))


@query(
    "normalize_line",
    r"SELECT doc_id, paragraph_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS value FROM fx_paragraph",
    ("fx_paragraph",),
)
def _(t):
    return fx.paragraphs(t).select("doc_id", "paragraph_id", T.normalize_line(F.col("text")).alias("value"))


@query(
    "normalize_for_match",
    r"""
SELECT doc_id, md5(trim(regexp_replace(lower(translate(replace(text, '. ', chr(8221) || '.' || chr(160)), chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160),
       chr(39) || chr(39) || '"" ')), '\s+', ' ', 'g'))) AS value FROM documents""",
)
def _(t):
    curly = F.replace("text", F.lit(". "), F.lit("”. "))
    return t("documents").select("doc_id", F.md5(T.normalize_for_match(curly)).alias("value"))


@query(
    "repair_soft_breaks",
    r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([a-z,;-])\n([a-z])', '\1 \2', 'g'),
       '([a-z,;-])\n([a-z])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS value
FROM (SELECT doc_id, regexp_replace(replace(text, ' the ', chr(10) || 'the  '), '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
def _(t):
    wrapped = F.replace("text", F.lit(" the "), F.lit("\nthe  "))
    body = F.regexp_replace(T.repair_soft_breaks(wrapped), r"\n{3,}", "\n\n")
    return t("documents").select("doc_id", F.md5(body).alias("value"))


block(
    "ocr_line",
    r"""
SELECT doc_id, page, native_text, raw, pos, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS norm,
       trim(regexp_replace(lower(native_text), '\s+', ' ', 'g')) AS native_norm
FROM (SELECT doc_id, page, native_text, unnest(lines) AS raw, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos
      FROM (SELECT *, string_split(ocr_text, chr(10)) AS lines FROM fx_page_text))""",
    "fx_page_text",
)
block(
    "merged_page",
    r"""
SELECT p.doc_id, p.page, p.native_text,
       CASE WHEN r.extra IS NULL THEN p.native_text
            ELSE regexp_replace(p.native_text, '\s+$', '') || chr(10) || chr(10) || r.extra || chr(10) END AS merged
FROM fx_page_text p LEFT JOIN (
  SELECT doc_id, page, string_agg(trim(raw), chr(10) ORDER BY pos) AS extra
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, norm ORDER BY pos) AS rn FROM ocr_line
        WHERE length(norm) >= 4 AND NOT contains(native_norm, norm)) WHERE rn = 1
  GROUP BY doc_id, page) r USING (doc_id, page)""",
    "ocr_line",
)


@query("merge_ocr_with_native", "SELECT doc_id, page, md5(merged) AS merged_md5 FROM merged_page", ("merged_page",))
def _(t):
    merged = cleaning.merge_ocr(F.col("native_text"), F.col("ocr_text"))
    return fx.page_text(t).select("doc_id", "page", F.md5(merged).alias("merged_md5"))


@query(
    "ocr_first_occurrence",
    """
SELECT doc_id, page, norm, pos, trim(raw) AS raw
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, norm ORDER BY pos) AS rn FROM ocr_line WHERE length(norm) >= 4) WHERE rn = 1""",
    ("ocr_line",),
)
def _(t):
    return cleaning.first_ocr_lines(fx.page_text(t), ["doc_id", "page"], "ocr_text")


@query(
    "ocr_chars_recovered",
    "SELECT doc_id, sum(greatest(0, length(merged) - length(native_text)))::BIGINT AS chars FROM merged_page GROUP BY doc_id",
    ("merged_page",),
)
def _(t):
    merged = cleaning.merge_ocr(F.col("native_text"), F.col("ocr_text"))
    return cleaning.ocr_chars_recovered(fx.page_text(t), "doc_id", "native_text", merged)
