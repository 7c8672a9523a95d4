"""The registered queries of this subpackage, on whole tables with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafloom.llm import align, bpe, editcount, jaccard, licenses, packing, pieces, quality, spelling, substring, suffix, toxicity, vectors
from leafloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is judged by itself, rows that repeat an id too; null texts have no words and fail; an empty table gives no rows (see `quality`)."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id: rows without an id go, of rows that repeat an id the least text counts; null texts have no words; whole texts of any length (see `substring`)."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored, null and empty texts too; rows that repeat an id are scored each; the fold is a matter of the id alone (see `toxicity`)."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id, like `op2_substring`; of equal passages the one that starts first stays (see `suffix`)."""
    return suffix.passages(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id; documents without words are linked with nothing; copies of a text are in one component (see `jaccard`)."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty: the end id alone; every row is kept (see `pieces`)."""
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, zero and non-finite vectors link with nothing; vectors of other lengths do not meet (see `vectors`)."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts give no rows; rows that repeat an id are scanned each; whole texts, line by line (see `licenses`)."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_editcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after personal data is masked and repeated lines are deleted."""
    return editcount.recount(editcount.cleaning_edits(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are their end id alone; repeated rows are packed as often as they occur; a text longer than a sequence is cut over several (see `packing`)."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids; every row is kept (see `bpe`)."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, and texts that a tokenizer does not give back, have zeros; every row is kept (see `align`)."""
    return align.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of the corpus; null texts have none (see `spelling`)."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_substring, op3_toxicity, op4_suffix, op5_jaccard, op6_pieces, op7_vectors, op8_licenses, op9_editcount, op10_packing, op11_bytes, op12_alignment, op13_spelling)}

SQL: dict[str, str] = {"op1_quality": quality.LINES_SQL}
