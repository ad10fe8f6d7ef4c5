"""A Merkle manifest of a table of documents, with a proof for every row found by pointer jumping.

Each language has a tree of fan-out 8 over its rows in ascending doc_id; the roots of these trees, in order of the language, are
the leaves of a top tree. H is the lowercase hex SHA-256 of its inputs put together, digests as hex text.

Eight rows share all of their way but its first step, so the nodes that jump are the runs of rows and what lies
above them. A node holds a pointer to an ancestor and the segment towards it: for each level what stands before and behind
the node's ancestor among its siblings. A self-join replaces the pointer by the ancestor's own one and appends the
ancestor's segment, which doubles the distance, so a tree of height h takes about log2(h) joins. At the end each run hands
its segment to its rows. Everything is built-in functions; digests are 32 bytes each where they are stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeskein.llm._hot import left_join_split
from codeskein.llm._tables import Scratch, partitions

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The top tree among tree names; a language's tree is `=` and the language, that of null is `-`, which sorts first.
TOP = "^"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _packed(text: Column) -> Column:
    """The 32 bytes of the SHA-256 of a text."""
    return F.unhex(F.sha2(text, 256))


def row_text(fields: dict[str, Column]) -> Column:
    """What a leaf hashes: of each field `-` if it is null, else its UTF-8 byte count, a colon and the value."""
    parts = []
    for value in fields.values():
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def lower_cased(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows`, written, with `at` (0, 1, ... inside the group in the given order) and `members`, the group's size.

    Rows are dealt by ranges of group, order and a tie number, so neither one group nor one key of it is bound to
    one task. What is then added to a row's place are sums over (range, group), of which there are no more than ranges
    and groups together.
    """
    n = partitions(rows.sparkSession)
    keyed = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(n, group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    placed = scratch.keep(dealt.withColumn("place", F.monotonically_increasing_id()), f"{name}-placed")
    stretch = F.shiftright("place", 33).alias("stretch")
    spans = placed.groupBy(group, stretch).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    everyone = Window.partitionBy(group)
    before = everyone.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        group, "stretch", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(everyone).alias("members")
    )
    spans = scratch.keep(spans, f"{name}-spans")
    joined = placed.withColumn("stretch", stretch).join(spans, [group, "stretch"])
    return joined.select(*rows.columns, (F.col("place") + F.col("shift")).alias("at"), "members")


def _runs(nodes: DataFrame, kid: list[str]) -> DataFrame:
    """Nodes (tree, at, members, span, digest) one level up, each with its children (`kid` columns) in order.

    The one node of a tree of one row passes as a run that is not hashed (`lone`).
    """
    up = nodes.groupBy("tree", "members", F.floor(F.col("at") / FAN).alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", *kid))).alias("kids"), F.sum("span").alias("span")
    )
    lone = F.col("members") == 1
    together = F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), "")
    return up.select(
        "tree",
        F.col("up").alias("at"),
        F.floor((F.col("members") + (FAN - 1)) / FAN).alias("members"),
        "span",
        F.when(lone, F.col("kids")[0]["digest"]).otherwise(_packed(together)).alias("digest"),
        lone.alias("lone"),
        "kids",
    )


def _climb(scratch: Scratch, first: DataFrame, name: str) -> list[DataFrame]:
    """The written levels above and with `first`, until each tree has one node; a level has an eighth of the rows below it."""
    levels = [first]
    while True:
        up = scratch.keep(_runs(levels[-1].where("members > 1"), ["span"]), f"{name}-{len(levels) + 1}")
        if up.isEmpty():
            return levels
        levels.append(up)


def _step(kids: str, place: str) -> Column:
    """The digests before and behind a child among its siblings, packed."""
    digests = F.transform(kids, lambda k: k["digest"])

    def packed(part: Column) -> Column:
        return F.aggregate(part, F.lit(b""), lambda a, b: F.concat(a, b))

    before = packed(F.slice(digests, F.lit(1), F.col(place)))
    return F.struct(before.alias("before"), packed(F.slice(digests, F.col(place) + 2, F.lit(FAN))).alias("behind"))


def _links(parents: DataFrame, level: int, of: list[Column], root_here: bool, subroot: Column) -> DataFrame:
    """For each child of `parents` (a level of a tree) the pointer to its parent, null where that is the root of all."""
    kids = parents.select("tree", "at", "members", "kids", F.posexplode("kids").alias("pos", "kid"))
    rooted = (F.col("members") == 1) & F.lit(root_here)
    up = {"up_tree": F.col("tree"), "up_level": F.lit(level), "up_at": F.col("at")}
    pointers = [F.when(~rooted, value).alias(name) for name, value in up.items()]
    return kids.select(*of, *pointers, F.array(_step("kids", "pos")).alias("path"), subroot.alias("subroot"), F.col("kid.span").alias("span"))


class Manifest:
    """The trees over written leaves (tree, at, members, span, digest, ...).

    `runs` are the lowest nodes, with the rows that they hold in `kids`; `root` is the root's hex digest, None without rows; `ways`
    has for every run (tree, at) that is not the root the whole `path` to the root, and the `subroot` on it.
    """

    def __init__(self, scratch: Scratch, leaves: DataFrame, n_rows: int, keep: list[str]):
        self.runs = scratch.keep(_runs(leaves, keep), "runs-1")
        self.root, self.ways = None, None
        if not n_rows:
            return
        levels = _climb(scratch, self.runs, "runs")
        tops = [part.where("members = 1").select("tree", F.lit(k + 1).alias("level"), "span", "digest") for k, part in enumerate(levels)]
        subroots = numbered(scratch, reduce(DataFrame.unionByName, tops).withColumn("all", F.lit(0)), "all", ["tree"], "subroots")
        subroots = scratch.keep(subroots.select(F.lit(TOP).alias("tree"), "at", "members", "span", "digest", F.col("tree").alias("of"), "level"), "subroots")
        self.only = subroots.count() == 1
        above = [] if self.only else _climb(scratch, scratch.keep(_runs(subroots, ["of", "level", "span"]), "top-1"), "top")
        peak = above[-1] if above else subroots
        self.root = peak.where("members = 1").select(_hex(F.col("digest"))).first()[0]

        none, own = F.lit(None).cast("string"), _hex(F.col("kid.digest"))
        links = []
        for trees, base in ((levels, False), (above, True)):
            for k, parents in enumerate(trees):
                if k == 0 and base:
                    links.append(_links(parents, 1, [F.col("kid.of").alias("tree"), F.col("kid.level").alias("level"), F.lit(0).cast("long").alias("at")], True, own))
                elif k:
                    links.append(_links(parents, k + 1, [F.col("tree"), F.lit(k).alias("level"), F.col("kid.at").alias("at")], base or self.only, none))
        if not links:
            return
        ways = scratch.keep(reduce(DataFrame.unionByName, links), "ways-0")
        distance, steps, k = 1, len(levels) - 1 + len(above), 0
        while distance < steps:
            ways, k, distance = scratch.keep(self._doubled(ways, n_rows), f"ways-{k + 1}"), k + 1, 2 * distance
            scratch.drop(f"ways-{k - 1}")
        self.ways = ways.where("level = 1").select("tree", "at", "path", "subroot")

    @staticmethod
    def _doubled(ways: DataFrame, n_rows: int) -> DataFrame:
        """Every pointer replaced by the pointer of the node it points to, with the segments put together."""
        keys = ["up_tree", "up_level", "up_at"]
        arrived, open_ = ways.where("up_tree IS NULL"), ways.where("up_tree IS NOT NULL")
        found = ways.select(
            *[F.col(c).alias(f"up_{c}") for c in ("tree", "level", "at")],
            *[F.col(c).alias(f"next_{c}") for c in [*keys, "path", "subroot", "span"]],
        )
        both = left_join_split(open_, found, keys, "next_span", n_rows)
        moved = both.select(
            "tree", "level", "at", *[F.col(f"next_{c}").alias(c) for c in keys],
            F.concat("path", "next_path").alias("path"), F.coalesce("subroot", "next_subroot").alias("subroot"), "span",
        )
        return arrived.unionByName(moved)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf's hex digest and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(_hex(s["before"]), below, _hex(s["behind"])), 256))


def proved(docs: DataFrame, altered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """For each row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `altered` is what stands in place of the text when a row is checked, where the condition `changed` holds; the manifest and
    all siblings are those of the original table. `proof_sha256` is H of all siblings on the way to the root. A row is
    verified if its text, as it stands now, still leads to the root.

    Rows ascend by doc_id inside their language, null first, equal ids by their leaf; repeated rows are leaves of their own. Nulls
    in the five fields are hashed as `-`; empty texts as `0:`. A lone row of a language is its subroot; a lone row of
    the table is the root and has an empty proof. No rows give no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    fields = {name: F.col(name) for name in FIELDS}
    now = _packed(row_text(fields | {"text": altered})) if altered is not None else F.lit(None).cast("binary")
    leaves = docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        "doc_id",
        _packed(row_text(fields)).alias("digest"),
        (F.when(changed, now) if changed is not None else now).alias("now"),
    )
    leaves = numbered(scratch, leaves, "tree", ["doc_id", "digest"], "leaves")
    n_rows = spark.read.parquet(f"{scratch.folder}/leaves-placed").count()
    made = Manifest(scratch, leaves.withColumn("span", F.lit(1).cast("long")), n_rows, ["doc_id", "now"])
    if made.root is None:
        return spark.createDataFrame([], SCHEMA).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    nowhere = F.expr("CAST(array() AS array<struct<before: binary, behind: binary>>)")
    if made.ways is None:
        runs = made.runs.withColumns({"path": nowhere, "subroot": F.lit(made.root)})
    else:
        runs = made.runs.join(made.ways, ["tree", "at"], "left")
    root = F.lit(made.root)
    rows = runs.select("lone", "kids", "path", "subroot", F.posexplode("kids").alias("pos", "kid")).select(
        F.col("kid.doc_id").alias("doc_id"),
        _hex(F.col("kid.digest")).alias("leaf"),
        F.coalesce("subroot", root).alias("subroot"),
        root.alias("root"),
        _hex(F.coalesce("kid.now", "kid.digest")).alias("now"),
        F.when(F.col("lone"), F.coalesce("path", nowhere)).otherwise(F.concat(F.array(_step("kids", "pos")), F.coalesce("path", nowhere))).alias("path"),
    )
    siblings = F.array_join(F.transform("path", lambda s: F.concat(_hex(s["before"]), _hex(s["behind"]))), "")
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.col("now")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )
