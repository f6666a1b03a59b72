"""A stored vector index for approximate cosine search: coarse lists, product-coded residuals, exact ranking of the best.

Centroids of the lists and the codebooks are fitted on a sample of at most ``SAMPLE`` rows, those with the smallest hashes of
their keys; all rows are then assigned to lists and coded, in tasks. Two tables are partitioned by list: ``codes`` (a byte for
each part of a vector) and ``vectors``. A search takes the lists in the order of their centroids until they hold a
share of all rows, scores their codes from a table of partial products, and ranks the best ``rerank`` of them by their
vectors. Rows that a filter leaves out are gone before anything is scored.

Null vectors, vectors of no length and those with another number of components than most of the sample aren't indexed.
"""

from __future__ import annotations

import json
import posixpath
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.operators.search import cosine_of

SAMPLE, LISTS, PARTS, ENTRIES, ROUNDS = 20_000, 256, 16, 256, 8


def fitted(rows: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's centroids from the first rows; an empty one stays."""
    c = rows[:k].copy()
    for _ in range(ROUNDS):
        near = nearest(rows, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1) - 2 * rows @ centroids.T).argmin(axis=1)


def unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` components that have a length, scaled to one, and which rows they are."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    rows = np.array(column.take(pa.array(at)).to_pylist(), dtype=np.float64).reshape(len(at), width)  # a null component becomes NaN
    length = np.sqrt((rows * rows).sum(axis=1))
    ok = np.isfinite(length) & (length > 0)
    return rows[ok] / length[ok, None], at[ok]


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    books: np.ndarray
    sizes: dict[int, int]

    @staticmethod
    def write(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """Index ``vectors``; keys are longs."""
        spark = vectors.sparkSession
        own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
        some = [r["v"] for r in own.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()]
        width = Counter(map(len, some)).most_common(1)[0][0] if some else PARTS
        sample, _ = unit(pa.array(some, pa.list_(pa.float64())), width)
        parts = PARTS if width % PARTS == 0 and width else 1
        centroids = fitted(sample, max(1, min(LISTS, int(len(sample) ** 0.5)))) if len(sample) else np.zeros((1, width))
        rest = sample - centroids[nearest(sample, centroids)] if len(sample) else np.zeros((1, width))
        books = np.stack([fitted(np.ascontiguousarray(x), min(ENTRIES, len(rest))) for x in np.split(rest, parts, axis=1)])

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, at = unit(batch.column(1), width)
                list_ = nearest(rows, centroids) if len(rows) else np.zeros(0, np.int64)
                left = np.split(rows - centroids[list_], parts, axis=1)
                codes = np.stack([nearest(np.ascontiguousarray(x), b) for x, b in zip(left, books, strict=True)], axis=1).astype(np.uint8) if len(rows) else np.zeros((0, parts), np.uint8)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list_.astype(np.int32))], ["key", "v", "code", "list"])

        rows = own.mapInArrow(code, "key long, v array<double>, code binary, list int")
        dealt = rows.repartition("list", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("list", "key")
        dealt.write.mode("overwrite").partitionBy("list").parquet(posixpath.join(path, "rows"))
        stored = spark.read.schema("key long, v array<double>, code binary, list int").parquet(posixpath.join(path, "rows"))
        sizes = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # LISTS at most
        model = json.dumps({"centroids": centroids.tolist(), "books": books.tolist(), "sizes": sorted(sizes.items())})
        spark.createDataFrame([(model,)], "model string").coalesce(1).write.mode("overwrite").text(posixpath.join(path, "model"))
        return VectorIndex(spark, path, centroids, books, sizes)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        m = json.loads(spark.read.text(posixpath.join(path, "model")).first()[0])  # type: ignore[index]
        return VectorIndex(spark, path, np.array(m["centroids"]), np.array(m["books"]), dict(m["sizes"]))

    def rows(self) -> DataFrame:
        return self.spark.read.schema("key long, v array<double>, code binary, list int").parquet(posixpath.join(self.path, "rows"))

    def probed(self, query: np.ndarray, share: float) -> list[int]:
        """Lists in the order of their centroids until they hold ``share`` of all rows."""
        order = np.argsort(-(self.centroids @ query), kind="stable")
        held = np.cumsum([self.sizes.get(int(i), 0) for i in order])
        return order[: int(np.searchsorted(held, share * held[-1])) + 1].tolist()

    def candidates(self, queries: dict[int, list[float]], rerank: int, share: float, allowed: DataFrame | None = None) -> DataFrame:
        """(query, key, list, near): of each query the best ``rerank`` rows by their codes. ``queries`` are a few vectors; ``allowed`` (key) filters first."""
        if not self.sizes:
            return self.spark.createDataFrame([], "query long, key long, list int, near double")
        known = {q: np.array(v, dtype=np.float64) / (np.sqrt(np.dot(v, v)) or 1.0) for q, v in queries.items()}
        lists = {q: self.probed(v, share) for q, v in known.items()}
        read = self.rows().select("key", "code", "list").where(F.col("list").isin(sorted({x for own in lists.values() for x in own})))
        read = read if allowed is None else read.join(allowed.select("key"), "key", "left_semi")
        centroids, books = self.centroids, self.books

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, list_ = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(keys), len(books))
                for q, v in known.items():
                    table = np.einsum("pew,pw->pe", books, v.reshape(len(books), -1))
                    score = (centroids @ v)[list_] + table[np.arange(len(books)), codes].sum(axis=1)
                    own = np.flatnonzero(np.isin(list_, lists[q]))
                    best = own[np.lexsort((keys[own], -score[own]))[:rerank]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(keys[best]), pa.array(list_[best]), pa.array(score[best])], ["query", "key", "list", "near"])

        found = read.mapInArrow(near, "query long, key long, list int, near double")
        order = Window.partitionBy("query").orderBy(F.desc("near"), "key")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rerank).drop("r")

    def search(self, queries: dict[int, list[float]], k: int, rerank: int, share: float = 1.0, allowed: DataFrame | None = None) -> DataFrame:
        """(query, doc, score, rank): the best k of the candidates by exact cosine, ties by key."""
        some = self.candidates(queries, rerank, share, allowed)
        known = self.spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries.items()], "query long, q array<double>")
        rows = some.join(self.rows().select("list", "key", "v"), ["list", "key"]).join(F.broadcast(known), "query")
        scored = rows.select("query", F.col("key").alias("doc"), F.round(cosine_of(F.col("v"), F.col("q")), 6).alias("score")).where("score is not null")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
