"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom import constants as K


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when one is empty or zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def similarity_bucket(similarity: Column, grey: float = K.GREY_SIMILARITY, auto: float = K.AUTO_SIMILARITY) -> Column:
    return F.when(similarity < grey, "different").when(similarity < auto, "grey").otherwise("auto")


def token_slot(token: Column, dim: int = K.EMBED_DIM) -> Column:
    """Slot of a token in the hashed bag of words."""
    if dim < K.MIN_EMBED_DIM:
        raise ValueError(f"dim must be at least {K.MIN_EMBED_DIM}")
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def unit_weights(slots: Column) -> Column:
    """Distinct values of an array with their weights, as structs ``(slot, weight)``: counts, scaled to length 1.

    The counts are lengths of runs in the sorted array, so a vector is made within its row, in linear time but for the sort.
    """
    from leafloom.functions.text import let

    def counted(s: Column) -> Column:
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda a: F.zip_with(a, F.slice(F.concat(a, F.array(F.size(s))), F.lit(2), F.size(a)), lambda x, y: F.struct(F.get(s, x).alias("slot"), (y - x).cast("bigint").alias("n"))))

    def scaled(c: Column) -> Column:
        length = F.sqrt(F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"] * e["n"]))
        return let(length, lambda n: F.transform(c, lambda e: F.struct(e["slot"].alias("slot"), (e["n"] / n).alias("weight"))))

    return let(let(F.array_sort(slots), counted), scaled)


def embed_signature(title: Column, body: Column) -> Column:
    """Text that stands for a leaf: its title and the head of its body."""
    from leafloom.functions.text import strip

    return strip(F.concat(title, F.lit("\n\n"), F.substring(body, 1, K.SIGNATURE_BODY_CHARS)))
