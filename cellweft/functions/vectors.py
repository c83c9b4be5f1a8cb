"""Functions on array<float> vectors as Spark column expressions; sums are made in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM = 1e-8
NORM_FLOOR = 1e-12
COSINE_EPS = 1e-6


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    squares = F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: str | Column) -> Column:
    """Unit length; a zero vector stays zero."""

    def scale(p: Column) -> Column:
        return F.transform(p["v"], lambda x: x.cast("double") / p["n"])

    # as an element of an array the norm is computed once per row, not once per component
    pair = F.struct(_col(v).alias("v"), F.greatest(norm(v), F.lit(NORM_FLOOR)).alias("n"))
    return F.get(F.transform(F.array(pair), scale), F.lit(0))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(COSINE_EPS))


def add_vectors(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") + y.cast("double"))


def hashed_features(tokens: str | Column, dim: int) -> Column:
    """Signed feature hashing of tokens: place and sign of a token come from its md5."""

    def number(w: Column) -> Column:
        return F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")

    hashes = F.transform(_col(tokens), lambda w: F.struct((number(w) % dim).alias("at"), F.when(number(F.concat(w, F.lit("#"))) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))

    def vector(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.aggregate(F.filter(h, lambda x: x["at"] == i), F.lit(0.0), lambda s, x: s + x["sign"]),
        )

    return F.get(F.transform(F.array(hashes), vector), F.lit(0))


def rounded_text(v: str | Column, digits: int = 4) -> Column:
    """Components as whole multiples of 10^-digits, for reports."""
    scale = 10**digits
    return F.array_join(F.transform(_col(v), lambda x: F.round(x.cast("double") * scale).cast("bigint").cast("string")), " ")
