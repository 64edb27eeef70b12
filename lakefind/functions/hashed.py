"""A vector of a text without a model: its tokens' hashes, counted and of length 1. A stand-in where no embedder is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, tokens

DIM = 64


def hashed(text: Column, dim: int = DIM) -> Column:
    """array<double> of dim numbers: how many tokens fall to each place, square root, length 1; all zero without tokens."""
    places = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = let(F.array_sort(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sqrt(F.size(F.filter(p, lambda x: x == i)).cast("double"))))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(F.struct(counts.alias("v")), lambda s: let(F.struct(s["v"].alias("v"), norm(s["v"]).alias("n")), lambda t: F.transform(t["v"], lambda x: x / F.greatest(t["n"], F.lit(1e-12)))))
