"""Similarity expressions over embedding arrays and over bags of words."""

from __future__ import annotations

import math
from collections import Counter
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(vector: Column, query: list[float]) -> Column:
    """Sum of products in double precision.

    Measured on 64 dimensions, the array functions are about five times as fast as the products
    written out one by one, whose generated method outgrows the JIT compiler.
    """
    constant = F.array(*[F.lit(float(q)) for q in query])
    products = F.zip_with(vector, constant, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine similarity; NULL for vectors of another length or of zero length."""
    size = math.sqrt(sum(float(q) * float(q) for q in query))
    similarity = F.try_divide(dot(vector, query), norm(vector) * F.lit(size))
    return F.when(F.size(vector) == len(query), F.lit(1.0) - similarity)


def words(text: Column) -> Column:
    """Lower-case ASCII words and digits of a text, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def word_counts(text: Column) -> Column:
    """ARRAY<STRUCT<word, n>>: how often each word of a text occurs, in word order.

    The sorted words of a row are cut where they change, so the work is that of the sort and
    no row has to be exploded and grouped.
    """

    def starts(w: Column) -> Column:
        changes = F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i))
        return F.filter(changes, lambda i: i.isNotNull())

    def runs(w: Column, at: Column) -> Column:
        def run(begin: Column, j: Column) -> Column:
            end = F.coalesce(F.get(at, j + 1), F.size(w))
            return F.struct(F.get(w, begin).alias("word"), (end - begin).cast("double").alias("n"))

        return F.transform(at, run)

    return bound(F.sort_array(words(text)), lambda w: bound(starts(w), lambda at: runs(w, at)))


def word_weights(text: Column) -> Column:
    """ARRAY<STRUCT<word, weight>>: `word_counts` scaled to length 1."""

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c["n"] * c["n"]))
        return bound(
            length,
            lambda size: F.transform(
                counts, lambda c: F.struct(c["word"].alias("word"), (c["n"] / size).alias("weight"))
            ),
        )

    return bound(word_counts(text), scaled)


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once: a lambda argument is a value, a plain expression
    inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def query_weights(text: str) -> dict[str, float]:
    """Unit-length word weights of a query string, the same words as `words`."""
    counts = Counter(w for w in re.split("[^a-z0-9]+", text.lower()) if w)
    size = math.sqrt(sum(n * n for n in counts.values()))
    return {w: n / size for w, n in sorted(counts.items())}
