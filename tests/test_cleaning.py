import pytest
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import cleaning


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, label, left",
    [
        ("go to https://a.example/b now", "url", "go to  now"),
        ("see www.books.example/x today", "bare_domain", "see  today"),
        ("keep\nUnacademy sheet 4\nend", "coaching_name", "keep\n\nend"),
        ("mail a.b@c.example ok", "email", "mail  ok"),
        ("hi @some_name bye", "social_handle", "hi  bye"),
        ("x downloaded  from here", "downloaded_from", "x "),
        ("a Page 2 of 9 b", "pagination", "a  b"),
        ("© 1999 Someone\nrest", "copyright", "\nrest"),
        ("please subscribe to our channel!\nrest", "social_join", "please \nrest"),
    ],
)
def test_generic_patterns(spark, text, label, left):
    df = spark.createDataFrame([(text,)], "t string")
    row = cleaning.clean_with_report(df, "t", cleaning.patterns_for()).first()
    assert row.cleaned_text == left
    assert row.removals == {label: 1}
    assert len(row.samples[label]) == 1


def test_no_break_space_counts_as_space(spark):
    assert one(spark, cleaning.clean_text(F.lit("page 3 of 4"), cleaning.patterns_for())) == ""
    assert one(spark, T.normalize_ws(F.lit(" a  b\n"))) == "a b"


def test_bundle_runs_after_generic_and_shares_a_label(spark):
    text = (
        "A-1 KeshavVihar road\nJaipur 302018 office\nbody text\nA-1 Keshav Vihar\nplain line\nJaipur- 302018 b\n"
        "Rajasthan Geography Notes\nsee https://x.example"
    )
    df = spark.createDataFrame([(text,)], "t string")
    row = cleaning.clean_with_report(df, "t", cleaning.patterns_for("springboard_rajasthan")).first()
    assert row.removals == {"url": 1, "address_block": 1, "address_line": 2, "book_header": 1}
    assert row.samples["address_line"] == ["A-1 Keshav Vihar", "Jaipur- 302018 b"]
    assert "body text" in row.cleaned_text and "plain line" in row.cleaned_text
    with pytest.raises(ValueError):
        cleaning.patterns_for("unknown")


def test_clean_text_equals_report(spark):
    df = spark.createDataFrame([("a\n\n\n\nb @handle99 https://x.example\n \n\t\n\nc",)], "t string")
    full = cleaning.clean_with_report(df, "t", cleaning.patterns_for()).first().cleaned_text
    assert full == one(df.sparkSession, cleaning.clean_text(F.lit("a\n\n\n\nb @handle99 https://x.example\n \n\t\n\nc"), cleaning.patterns_for()))
    assert full.startswith("a\n\nb")


def test_samples_are_capped_in_page_order(spark):
    rows = [("d", p, " ".join(f"@user{p}{i}x" for i in range(4))) for p in (2, 1)]
    df = spark.createDataFrame(rows, "doc string, page int, t string")
    report = cleaning.cleanup_report(cleaning.clean_with_report(df, "t", cleaning.patterns_for()), "doc", "page").first()
    assert report.removed == 8
    assert report.samples == ["@user10x", "@user11x", "@user12x", "@user13x", "@user20x"]


def test_paragraph_split_and_numbering(spark):
    page = "A first paragraph that is long\nenough to stay.\n\n short \n \nAnother paragraph with enough text."
    df = spark.createDataFrame([(1, 2, page), (1, 1, page), (2, 5, page)], "doc_id int, page int, text string")
    rows = cleaning.number_paragraphs(df).orderBy("doc_id", "paragraph_id").collect()
    assert [(r.doc_id, r.paragraph_id, r.page) for r in rows] == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 0, 5), (2, 1, 5)]
    assert rows[0].text == "A first paragraph that is long enough to stay."


@pytest.mark.parametrize(
    "native, ocr, merged",
    [
        ("Native text", "", "Native text"),
        ("Hills and Rivers", "hills  AND rivers\n", "Hills and Rivers"),
        ("Hills ", "Map of lakes\nabc\nMAP OF LAKES\nSalt pans", "Hills\n\nMap of lakes\nSalt pans\n"),
        ("", "Only on the map", "\n\nOnly on the map\n"),
    ],
)
def test_ocr_merge(spark, native, ocr, merged):
    assert one(spark, cleaning.merge_ocr(F.lit(native), F.lit(ocr))) == merged


def test_soft_breaks_and_cuts(spark):
    assert one(spark, T.repair_soft_breaks(F.lit(" the long\nriver; a\nb-\nc End.\nNext  line "))) == "the long river; a b- c End.\nNext line"
    assert one(spark, T.snippet(F.lit("x" * 599 + "  tail"))) == "x" * 599 + " […]"
    assert one(spark, T.snippet(F.lit("y" * K.SNIPPET_CHARS))) == "y" * 600


def test_pages_and_sections(spark):
    pages = lambda *p: one(spark, T.format_pages(F.array(*[F.lit(x) for x in p]).cast("array<int>")))
    assert pages(7) == "page 7"
    assert pages(9, 3, 3, 0) == "pages 3-9"
    assert pages() == "pages unknown"
    once = T.wrap_leaf_body(F.lit(" body "), F.array(F.lit(2)))
    assert one(spark, once) == "## Source 1 (page 2)\n\nbody\n"
    assert one(spark, T.wrap_leaf_body(once, F.array(F.lit(2)))) == one(spark, once)
