"""Equi-joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / SHARES of the rows is hot; so there are fewer than SHARES hot keys.
SHARES = 1000


def left_join_split(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, n_rows: int, shares: int = SHARES) -> DataFrame:
    """`rows` left-joined with `found`, which has each key once and in `weight` how many rows at most carry it.

    The weights of the keys add up to at most a small multiple of `n_rows` (one per level of a tree, say), so only so
    many times `shares` rows of `found` can be hot. These are broadcast and their rows are not shuffled; all
    other keys are shuffled, and none of them has more than 1 / `shares` of the rows. Keys are never null.
    `found` brings its columns besides the keys, `weight` included.
    """
    hot = F.broadcast(found.where(F.col(weight) * shares > n_rows))
    cold = found.where(F.col(weight) * shares <= n_rows)
    at_hot = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left")
    return at_hot.select(*rest.columns).unionByName(rest)
