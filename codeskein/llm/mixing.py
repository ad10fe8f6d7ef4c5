"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw.

Rates need one aggregation by source, the bounds of the draws counts by source and size; the draw itself is a map.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeskein.llm._tables import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Bins of draws in [0, 1) by which a level's bound is found.
BINS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons, nulls written as `null`."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


@dataclass
class SourceTargets:
    """`table`: source, source_size, weight, target, rate; `level`: target per unit of weight where no cap holds."""

    table: DataFrame
    level: float


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> SourceTargets:
    """Targets of all sources of `sizes` (source, size).

    Sources in code point order, null last, take the `weights` in turn and share `share` times the total size.
    A target stops at `most` times its source's size; what is above goes to the others by weight until none is
    above. Each round of that is two sums over the table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = scratch.keep(
        totals.withColumn("missing", F.col("source").isNull())
        .repartitionByRange(F.col("missing"), F.col("source"))
        .sortWithinPartitions("missing", "source")
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    parts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ahead, before = {}, 0
    for part in sorted(parts):
        ahead[part], before = before, before + parts[part]
    inside = F.row_number().over(Window.partitionBy("part").orderBy("missing", "source"))
    base = F.create_map(*[F.lit(x) for pair in ahead.items() for x in pair])[F.col("part")] if ahead else F.lit(0)
    turn = F.pmod(base + inside - 1, F.lit(len(weights))).cast("int")
    weighted = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    weighted = scratch.keep(weighted.select("source", "source_size", "weight"), "weights")

    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while total:
        low = cap <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        fixed, left, n = weighted.agg(
            F.coalesce(F.sum(F.when(low, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~low, F.col("weight"))), F.lit(0.0)), F.count_if(low)
        ).first()
        if n == capped or not left:
            break
        level, capped = (share * total - fixed) / left, n
    table = weighted.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
    table = table.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    return SourceTargets(scratch.keep(table, "targets"), level)


def size_level(size: Column) -> Column:
    """Ascending in size: the number of decimal digits and the first two of them; fewer than 2,000 levels."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).alias("level")


def draw(doc_id: Column, source: Column) -> Column:
    return unit_hash(doc_id, source, F.lit("draw"))


def quotas(levels: DataFrame, sources: DataFrame) -> DataFrame:
    """`levels` (source, level, n) with the columns of `sources` and `quota`, how many of the n get one copy more.

    Level after level a source's running count times the fraction, plus a start in [0, 1) hashed from the source, gains a
    whole number now and then: that many are drawn. So a level's quota is n times the fraction on average, and
    all quotas of a source together are within one of it.
    """
    of = sources.withColumnRenamed("source", "_of")
    rows = levels.join(of, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("level"))
    part, start = F.col("rate") - F.floor("rate"), unit_hash(F.col("source"), F.lit("start"))
    return rows.withColumn("upto", upto).withColumn("quota", F.floor(F.col("upto") * part + start) - F.floor((F.col("upto") - F.col("n")) * part + start)).drop("upto")


def strata(sizes: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Per (source, level) of `sizes` (doc_id, source, size): source_size, target, rate, and `bound`, the largest draw that gets a
    copy more (null: none does).

    The bound is the quota-th smallest draw of the level. It is found by counts of BINS bins of draws; only rows of the one
    bin that holds it are ranked, so no task ranks a level.
    """
    keys = sizes.select("source", size_level(F.col("size")), draw(F.col("doc_id"), F.col("source")).alias("draw")).distinct()
    keys = scratch.keep(keys.withColumn("bin", F.floor(F.col("draw") * BINS).cast("int")), "keys")
    bins = scratch.keep(keys.groupBy("source", "level", "bin").agg(F.count("*").alias("n")), "bins")
    levels = scratch.keep(quotas(bins.groupBy("source", "level").agg(F.sum("n").alias("n")), sources), "levels")

    def at(one: DataFrame, other: DataFrame, *columns: str):
        return [one["source"].eqNullSafe(other["source"]), *[one[c] == other[c] for c in columns]]

    counted = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source", "level").orderBy("bin")))
    found = counted.join(levels, at(counted, levels, "level")).where((counted["upto"] >= levels["quota"]) & (counted["upto"] - counted["n"] < levels["quota"]))
    last = found.select(counted["source"], counted["level"], counted["bin"], (levels["quota"] - counted["upto"] + counted["n"]).alias("nth"))
    last = scratch.keep(last, "last-bins")
    inside = keys.join(last, at(keys, last, "level", "bin")).select(keys["source"], keys["level"], keys["draw"], "nth")
    place = F.row_number().over(Window.partitionBy("source", "level").orderBy("draw"))
    bounds = inside.withColumn("place", place).where("place = nth").selectExpr("source", "level", "draw AS bound")
    whole = levels.join(bounds, at(levels, bounds, "level"), "left")
    return scratch.keep(whole.select(*[levels[c] for c in ("source", "level", "source_size", "target", "rate")], "bound"), "strata")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, size: Column | None = None) -> DataFrame:
    """`docs` with `size`, `source_size`, `target` and `copies`: floor(rate), and one more for the rows that are drawn.

    `size` defaults to the number of words of `text` (null: 0). A row is drawn by a hash of doc_id and source, with the fraction
    of its source's rate as its probability. Rows of about one size share a quota (`quotas`), so that totals come near
    their targets; where the line lies among them is decided by the hashes alone. Reruns agree, and rows that repeat a
    doc_id within a source and level share their draw. A null source is a source. Columns of `docs` with the four new names
    are replaced; other columns pass. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = n_words(F.col("text")) if size is None else size.cast("long")
    passed = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*passed, size.alias("size"))
    slim = scratch.keep(sized.select("doc_id", "source", "size"), "sizes")
    of = strata(slim, source_targets(slim, scratch, weights, share, most).table, scratch)
    joined = sized.join(of, sized["source"].eqNullSafe(of["source"]) & (size_level(sized["size"]) == of["level"]), "left")
    extra = F.coalesce(draw(sized["doc_id"], sized["source"]) <= of["bound"], F.lit(False))
    added = [sized["size"], of["source_size"], of["target"], (F.floor(of["rate"]) + extra.cast("long")).alias("copies")]
    return joined.select(*[sized[c] for c in passed], *added)


def emitted(mix: DataFrame) -> DataFrame:
    """Every row `copies` times, without the columns that `mixed` adds."""
    kept = F.struct(*[c for c in mix.columns if c not in ("size", "source_size", "target", "copies")])
    rows = mix.where("copies > 0").select(F.explode(F.array_repeat(kept, F.col("copies").cast("int"))).alias("row"))
    return rows.select("row.*")
