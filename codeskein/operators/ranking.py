"""Top-k search, scores, final order and context packing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeskein.functions import text, vectors


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First `k` rows in the given order with `rank` 1..k. Only those rows meet in one task."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest(
    embedded: DataFrame, query: list[float], k: int = 10, types: Iterable[str] = ()
) -> DataFrame:
    """Exact k nearest by cosine distance: (rank, id, distance). The type filter comes first."""
    types = list(types)
    rows = embedded.filter(F.col("type").isin(*types)) if types else embedded
    scored = rows.select("id", vectors.cosine_distance(F.col("embedding"), query).alias("distance"))
    return ranked(scored, k, F.col("distance").asc_nulls_last(), F.col("id"))


def word_vectors(documents: DataFrame, *carry: str) -> DataFrame:
    """(word, id, type, weight) and the columns to carry: unit-length bags of words as posting rows.

    One row per word and document instead of one wide vector per document, so a search reads
    only the words it asks for. A document is worked on within its own row: nothing is shuffled,
    and a word that is in every document makes no large group.
    """
    weighted = vectors.word_weights(F.col("document"))
    # The outer form keeps the optimizer from computing the array once more to find empty ones.
    rows = documents.select("id", "type", *carry, F.explode_outer(weighted).alias("entry"))
    return rows.filter("entry IS NOT NULL").select("entry.word", "id", "type", "entry.weight", *carry)


def nearest_by_words(
    postings: DataFrame, ids: DataFrame, query: str, k: int = 10, types: Iterable[str] = ()
) -> DataFrame:
    """k nearest documents to a query text by cosine over words: (rank, id, distance).

    `ids` lists all documents (id, type): where fewer than `k` share a word with the query, the
    rest of the places goes to documents at distance 1, by id.
    """
    types = list(types)
    if types:
        postings = postings.filter(F.col("type").isin(*types))
        ids = ids.filter(F.col("type").isin(*types))
    weights = vectors.query_weights(query)
    q = F.lit(0.0)
    if weights:
        postings = postings.filter(F.col("word").isin(*weights))
        pairs = [F.lit(x) for kv in weights.items() for x in kv]
        q = F.create_map(*pairs)[F.col("word")]
    else:
        postings = postings.filter(F.lit(False))
    # Rounded, so that equal texts tie whatever the order in which their parts were summed.
    distance = F.round(F.lit(1.0) - F.sum(F.col("weight") * q), 12)
    matched = postings.groupBy("id").agg(distance.alias("distance"))
    order = (F.col("distance"), F.col("id"))
    best = matched.orderBy(*order).limit(k)
    # Up to k of the first 2k ids may be matched ones, so k others are always among them.
    others = ids.select("id").orderBy("id").limit(2 * k)
    others = others.join(best.select("id"), "id", "left_anti").withColumn("distance", F.lit(1.0))
    return ranked(best.unionByName(others), k, *order)


def similarity(distance: Column) -> Column:
    """1 - distance; a missing distance counts as 0."""
    return F.lit(1.0) - F.coalesce(distance, F.lit(0.0))


def pack_context(rows: DataFrame, *order: Column, max_length: int = 4000) -> DataFrame:
    """One row (context): blocks in order, up to the first that would pass `max_length`.

    No more blocks fit than `max_length` divided by the length of the shortest one, empty ones aside;
    cutting there loses nothing and keeps the running sum to about as many rows.
    """
    blocks = rows.withColumn("block", text.context_block())
    size = F.length("block")
    least, empty = blocks.agg(F.min(F.when(size > 0, size)), F.count_if(F.coalesce(size, F.lit(0)) == 0)).first()
    most = max_length // least + 1 + empty if least else max(1, empty)
    kept = ranked(blocks, most, *order)
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = kept.withColumn("total", F.sum(F.length("block")).over(so_far)).filter(F.col("total") <= max_length)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return fitting.agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context"))
