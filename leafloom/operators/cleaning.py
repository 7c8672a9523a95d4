"""Boilerplate removal, paragraph split, and merging of OCR lines into native page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import ordered

Patterns = list[tuple[str, str]]


def patterns_for(bundle: str | None = None, generic: bool = True, extra: Patterns = ()) -> Patterns:
    """The ordered pattern list: generic tier, then a named bundle, then the caller's own."""
    if bundle is not None and bundle not in K.SOURCE_BUNDLES:
        raise ValueError(f"unknown bundle {bundle!r}, known: {sorted(K.SOURCE_BUNDLES)}")
    return [*(K.GENERIC_PATTERNS if generic else []), *(K.SOURCE_BUNDLES[bundle] if bundle else []), *extra]


def remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, T.unicode_regex(pattern), "")


def may_match(text: Column, label: str) -> Column:
    """False when the text lacks the literal the pattern needs."""
    literal = K.PATTERN_LITERALS.get(label)
    return F.lit(True) if literal is None else F.contains(text, F.lit(literal))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, K.EXCESS_BLANKS, "\n\n")


def clean_text(text: Column, patterns: Patterns) -> Column:
    """Cleaned text only, as one expression."""
    for _, pattern in patterns:
        text = remove(text, pattern)
    return collapse_blank_lines(text)


def _step(state: Column, label: str, pattern: str) -> Column:
    """Removes one pattern from ``state.text`` and appends its matches to ``state.matches``.

    A one-element array and ``transform`` bind the state, so each step appears once in the expression
    however often it is used; a chain of plain columns would double with every step a filter passes.
    """

    def bound(s: Column) -> Column:
        found = F.when(
            may_match(s["text"], label), F.regexp_extract_all(s["text"], F.lit(T.unicode_regex(pattern)), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        return T.let(
            found,
            lambda m: F.struct(
                F.when(F.size(m) > 0, remove(s["text"], pattern)).otherwise(s["text"]).alias("text"),
                F.concat(s["matches"], F.array(m)).alias("matches"),
            ),
        )

    return F.transform(state, bound)


def clean_with_report(df: DataFrame, text: str, patterns: Patterns, sample_cap: int = K.SAMPLE_CAP) -> DataFrame:
    """Adds ``cleaned_text``, ``removals`` (label to count) and ``samples`` (label to first matches).

    Each pattern is counted on the text the pattern before it left.
    """
    state = F.array(F.struct(F.col(text).alias("text"), F.array().cast("array<array<string>>").alias("matches")))
    for label, pattern in patterns:
        state = _step(state, label, pattern)
    entries = []
    for label in dict.fromkeys(label for label, _ in patterns):
        parts = [F.col("_state.matches")[i] for i, (name, _) in enumerate(patterns) if name == label]
        matches = F.concat(*parts) if len(parts) > 1 else parts[0]
        entries.append(
            F.struct(
                F.lit(label).alias("label"),
                F.size(matches).alias("n"),
                F.transform(F.slice(matches, 1, sample_cap), T.strip).alias("samples"),
            )
        )
    hits = F.filter(F.array(*entries), lambda e: e["n"] > 0)
    return (
        df.withColumn("_state", state[0])
        .withColumn("_hits", hits)
        .withColumns(
            {
                "cleaned_text": collapse_blank_lines(F.col("_state.text")),
                "removals": F.map_from_entries(F.transform("_hits", lambda e: F.struct(e["label"], e["n"]))),
                "samples": F.map_from_entries(F.transform("_hits", lambda e: F.struct(e["label"], e["samples"]))),
            }
        )
        .drop("_state", "_hits")
    )


def removal_counts(reported: DataFrame, *keys: str) -> DataFrame:
    """Removals per key and label. The outer explode keeps Spark from inferring a filter that would
    run the whole pattern chain a second time."""
    rows = reported.select(*keys, F.explode_outer("removals").alias("label", "n")).filter(F.col("label").isNotNull())
    return rows.groupBy(*keys, "label").agg(F.sum("n").alias("removed"))


def paragraph_array(text: Column, boundary: str = K.BLANK_LINE) -> Column:
    """Paragraphs of one page text in order, white space collapsed, short ones dropped."""
    chunks = F.transform(F.split(text, boundary), T.normalize_ws)
    return F.filter(chunks, lambda c: F.length(c) >= K.MIN_PARAGRAPH_CHARS)


def split_paragraphs(df: DataFrame, text: str, boundary: str = K.BLANK_LINE) -> DataFrame:
    """One row per paragraph of a one-row text, numbered from 0 by its place in the row: no shuffle."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(paragraph_array(F.col(text), boundary)).alias("paragraph_id", "text"))


def number_paragraphs(
    pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text", boundary: str = K.BLANK_LINE
) -> DataFrame:
    """Paragraphs of paged documents, numbered from 0 through all pages of the document.

    Only (document, page, count) is summed over the pages; the paragraph rows themselves are never
    gathered per document.
    """
    arrays = pages.select(key, page, paragraph_array(F.col(text), boundary).alias("_ps"))
    starts = ordered.prefix_sum(
        arrays.select(key, page, F.size("_ps").alias("_n")), [key], page, F.col("_n"), "_start"
    ).select(key, page, "_start")
    return (
        arrays.join(starts, [key, page])
        .select(key, page, "_start", F.posexplode("_ps").alias("_pos", "text"))
        .select(key, (F.col("_start") + F.col("_pos")).cast("int").alias("paragraph_id"), page, "text")
    )


def cleanup_report(reported: DataFrame, key: str, page: str, sample_cap: int = K.SAMPLE_CAP) -> DataFrame:
    """Per document and label: removals over all pages and the first samples in page order.

    A page carries at most ``sample_cap`` samples; ranking them with a limit keeps hot documents cheap.
    """
    counts = removal_counts(reported, key)
    rows = reported.select(key, page, F.explode_outer("samples").alias("label", "_s")).select(
        key, page, "label", F.posexplode("_s").alias("_pos", "sample")
    )
    first = ordered.best_per_key(rows, [key, "label"], [F.col(page), F.col("_pos")], keep=sample_cap)
    samples = first.groupBy(key, "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "sample"))), lambda s: s["sample"]).alias("samples")
    )
    return counts.join(samples, [key, "label"])


def cleanup_totals(report: DataFrame, key: str) -> DataFrame:
    return report.groupBy(key).agg(F.sum("removed").alias("fragments"), F.count("label").alias("categories"))


def merge_ocr(native: Column, ocr: Column) -> Column:
    """Native page text plus the OCR lines it lacks, as one expression over one page.

    A line counts once per page in its normalised form, so the first form of each is kept.
    """
    lines = F.transform(
        F.split(ocr, r"\r\n|\r|\n"), lambda raw: F.struct(T.normalize_line(raw).alias("norm"), T.strip(raw).alias("raw"))
    )
    fresh = T.let(
        T.normalize_line(native),
        lambda known: F.filter(lines, lambda x: (F.length(x["norm"]) >= 4) & ~F.contains(known, x["norm"])),
    )
    first = T.let(
        fresh,
        lambda rows: T.let(
            F.transform(rows, lambda x: x["norm"]),
            lambda norms: F.filter(rows, lambda x, i: F.array_position(norms, x["norm"]) == i + 1),
        ),
    )

    def joined(rows: Column) -> Column:
        block = F.array_join(F.transform(rows, lambda x: x["raw"]), "\n")
        return F.when(F.size(rows) == 0, native).otherwise(
            F.concat(T.strip_end(native), F.lit("\n\n"), block, F.lit("\n"))
        )

    return T.let(first, joined)


def first_ocr_lines(pages: DataFrame, keys: list[str], ocr: str) -> DataFrame:
    """First form of each normalised OCR line of a page, with its place."""
    lines = pages.select(*keys, F.posexplode(F.split(ocr, r"\r\n|\r|\n")).alias("pos", "raw")).withColumn(
        "norm", T.normalize_line(F.col("raw"))
    )
    kept = lines.filter(F.length("norm") >= 4)
    return kept.groupBy(*keys, "norm").agg(F.min_by(F.struct("pos", "raw"), "pos").alias("_f")).select(
        *keys, "norm", F.col("_f.pos").alias("pos"), T.strip(F.col("_f.raw")).alias("raw")
    )


def ocr_chars_recovered(pages: DataFrame, key: str, native: str, merged: Column) -> DataFrame:
    gained = F.greatest(F.lit(0), F.length(merged) - F.length(native))
    return pages.groupBy(key).agg(F.sum(gained).cast("bigint").alias("chars"))
