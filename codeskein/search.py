"""The collection of searchable documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeskein.functions.vectors import query_weights
from codeskein.operators import ranking
from codeskein.session import cut, release, remove, spread, work_folder
from codeskein.versions import Layout, VersionedTables

_DOCUMENTS = "id string, document string, type string, name string, metadata map<string,string>"
_POSTINGS = "word string, id string, type string, weight double"
_EMBEDDINGS = "id string, type string, embedding array<double>"
_schema_of = T.StructType.fromDDL
_FIELDS = ("id", "document", "type", "name", "metadata")


class VectorStore:
    """Documents with cosine search in versioned tables, below `path` or, without one, in the work folder of the session.

    Without `embed` a document's vector is its bag of words, kept as posting rows sorted by word, so
    that a search opens only the files that hold its words. `embed` may be any
    expression from a text column to an array of numbers (a built-in or a Pandas UDF around a
    model); vectors are then stored and compared in full.

    A change is one commit that brings the documents with their vectors and deletes what they replace; nothing
    else is written. `compact` merges what changes have left; after `merge_after` runs that happens by itself.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        collection_name: str = "code_embeddings",
        embed: Callable[[Column], Column] | None = None,
        **options: int,
    ):
        self.spark, self.embed = spark, embed
        self.path = f"{str(path).rstrip('/')}/{collection_name}" if path else None
        self._vectors = "embeddings" if embed else "postings"
        documents = Layout(_schema_of(_DOCUMENTS), ("id",), ("id",))
        vectors = Layout(_schema_of(_EMBEDDINGS), ("id",), ("id",)) if embed else Layout(_schema_of(_POSTINGS), ("id",), ("word",))
        folder = self.path or f"{work_folder(spark)}/vectors-{uuid.uuid4().hex}"
        self.tables = VersionedTables(spark, folder, {"documents": documents, self._vectors: vectors}, **options)

    @property
    def documents(self) -> DataFrame:
        return self.tables.rows("documents").all()

    # --- changing ---

    def _vector_rows(self, documents: DataFrame) -> DataFrame:
        if self.embed:
            return documents.select("id", "type", self.embed(F.col("document")).alias("embedding"))
        return ranking.word_vectors(spread(documents, "id"))

    def _put(self, documents: DataFrame, replace: bool) -> int:
        """Write documents, each id once, with their vectors."""
        if "metadata" not in documents.columns:
            documents = documents.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        rows = cut(documents.select(*_FIELDS), "documents")
        count = rows.count()
        if count or replace:
            names = ("documents", self._vectors)
            dead = {} if replace else dict.fromkeys(names, rows.select("id"))
            self.tables.commit({"documents": rows, self._vectors: self._vector_rows(rows)}, dead, names if replace else ())
        release(rows)
        return count

    def replace_all(self, documents: DataFrame) -> int:
        """Make `documents` (id, document, type, name[, metadata]) the whole collection; returns its size."""
        return self._put(documents, True)

    def add(self, documents: DataFrame) -> int:
        """Insert or replace by id; only the given documents are written and taken apart. Returns their number."""
        return self._put(documents, False)

    def renew(self, documents: DataFrame) -> int:
        """Make `documents` the whole collection, but write only what differs from it; returns the size.

        One join by id finds new, changed and missing documents; a document that is the same keeps its vector.
        """
        if "metadata" not in documents.columns:
            documents = documents.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        wanted = cut(documents.select(*_FIELDS), "documents")

        def as_one(names: tuple[str, ...]) -> Column:
            return F.struct(*[F.map_entries(n).alias(n) if n == "metadata" else F.col(n) for n in names])

        rest = _FIELDS[1:]
        old = self.documents.select(F.col("id").alias("_id"), as_one(rest).alias("_old"))
        both = wanted.select("*", as_one(rest).alias("_new")).join(old, F.col("id") == F.col("_id"), "full_outer")
        changed = cut(both.filter("_old IS NULL OR _new IS NULL OR _old != _new").drop("_old", "_new"), "changed")
        if not changed.isEmpty():
            new = changed.filter("id IS NOT NULL").select(*_FIELDS)
            gone = changed.filter("_id IS NOT NULL").select(F.col("_id").alias("id"))
            self.tables.commit({"documents": new, self._vectors: self._vector_rows(new)}, dict.fromkeys(("documents", self._vectors), gone))
        count = wanted.count()
        release(wanted, changed)
        return count

    def delete(self, ids: Iterable[str]) -> None:
        ids = list(ids)
        if ids:
            self._drop(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_where(self, condition: Column) -> None:
        """Remove the documents for which a condition on their fields holds."""
        self._drop(self.documents.filter(F.coalesce(condition, F.lit(False))).select("id"))

    def _drop(self, ids: DataFrame) -> None:
        gone = cut(ids.select("id"), "deleted")
        if not gone.isEmpty():
            self.tables.commit(dead=dict.fromkeys(("documents", self._vectors), gone))
        release(gone)

    def compact(self) -> None:
        """Merge what changes have left."""
        self.tables.compact()

    def close(self) -> None:
        """A collection without a path is deleted; nothing else is held open."""
        if self.path is None:
            remove(self.spark, self.tables.path)

    # --- reading ---

    def get(self, ids: Iterable[str]) -> DataFrame:
        return self.tables.rows("documents").near("id", list(ids))

    def count(self) -> int:
        return self.documents.count()

    def search(self, query: str, n_results: int = 10, types: Iterable[str] = (), where: Column | None = None) -> DataFrame:
        """(rank, id, distance) of the nearest documents among those of the types for which `where` holds.

        `where` is a condition on id, document, type, name and metadata.
        """
        rows, listed = self.tables.rows(self._vectors), self.documents
        vectors = rows.all() if self.embed else rows.near("word", list(query_weights(query)))
        if where is not None:
            listed = listed.filter(where)
            vectors = vectors.join(listed.select("id"), "id")
        if self.embed:
            row = self.spark.range(0, 1, 1, 1).select(self.embed(F.lit(query)).alias("v")).first()
            return ranking.nearest(vectors, [float(x) for x in row["v"]], n_results, types)
        return ranking.nearest_by_words(vectors, listed.select("id", "type"), query, n_results, types)

    def with_documents(self, hits: DataFrame) -> DataFrame:
        """Hits of a search with document, type, name and metadata."""
        found = self.tables.rows("documents").near("id", hits)
        return found.join(hits, "id").select(*hits.columns, *[f for f in _FIELDS if f not in hits.columns])
