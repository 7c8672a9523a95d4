"""Table-shaped inputs: page texts, bookmarks, chapter files, and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T


def nonblank_pages(pages: DataFrame, native: str = "native_text", ocr: str = "ocr_text") -> DataFrame:
    """Pages that carry any text."""
    return pages.filter(T.strip(F.concat_ws("", native, ocr)) != "")


def valid_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks with a level, a page and a title."""
    rows = bookmarks.withColumn("title", T.strip(F.col("title")))
    return rows.filter((F.col("level") >= 1) & (F.col("page") >= 1) & (F.col("title") != ""))


def concat_chapter_files(pages: DataFrame, book: str, file: str, page: str, out: str = "book_page") -> DataFrame:
    """Pages of a book's chapter files, numbered on through the files in file-name order.

    Only one row per file goes to the window, so pages are joined and not sorted per book.
    """
    sizes = pages.groupBy(book, file).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(book).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(book, file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return pages.join(offsets, [book, file]).withColumn(out, (F.col(page) + F.col("_off")).cast("int")).drop("_off")


def allowed_source(url: Column, hosts: list[str] = K.ALLOWED_HOSTS) -> Column:
    """True when the URL's host is on the list."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin([h.lower() for h in hosts]), F.lit(False))
