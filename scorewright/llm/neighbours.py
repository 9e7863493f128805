"""Approximate nearest neighbours by inner product with an inverted multi-index.

The halves of the vectors are quantised separately; a cell is a pair of centroids.  A
query goes through the pairs in the order of their summed inner products, with a heap
over the two sorted lists, until the cells hold enough entries; all entries of these
cells are then scored exactly, in double precision.

Equal vectors are one entry: a cell's size counts it once, so copies do not use up a search,
and it brings along the k + 1 rows of smallest id, which are all of its rows that the k best
of any query can hold (a row is no neighbour of itself).

The codebooks are fitted on a bounded sample of the entries; every row is indexed.  Their
size follows the number of entries up to ``Shape.most_centroids``, so that cells keep their
size until then and grow with the table beyond.  What tasks are handed is bounded: the
codebooks and the number of entries of each cell.  Cells with the same first centroid
stand on one shelf; shelves are dealt into blocks of entries, and their probes into
teams, so a shelf that very many probes meet is scored by many tasks; each hands on its
best rows only.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, nor do rows without an id; equal scores go by the
smaller id; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.sources.storage import materialize


@dataclass(frozen=True)
class Shape:
    """Bounds of the index and of a search.

    A search goes on until its cells hold ``share`` of all distinct vectors, and ``least`` at least.
    Vectors without structure need a large share: on the uniform test vectors a half finds
    more than nine tenths of the true neighbours.
    """

    sample: int = 20_000
    per_cell: int = 12
    most_centroids: int = 512
    share: float = 0.5
    least: int = 6_000
    block: int = 2_048


def quantiser(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the points by Lloyd's rounds from evenly drawn starts."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centroids)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, column, k) for column in points.T], 1)
        filled = sizes > 0
        centroids[filled] = sums[filled] / sizes[filled, None]
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _nearest(vectors[:, :half], self.first) * len(self.second) + _nearest(
            vectors[:, half:], self.second
        )

    def best_cells(self, query: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Filled cells by falling summed inner product, until they hold enough entries."""
        half = self.first.shape[1]
        scores = self.first @ query[:half], self.second @ query[half:]
        orders = [np.argsort(-s, kind="stable") for s in scores]
        a, b = (s[o].tolist() for s, o in zip(scores, orders))
        rows, columns = (o.tolist() for o in orders)
        heap, seen, found, held = [(-a[0] - b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * len(b) + columns[j]
            if sizes[cell]:
                found.append(cell)
                held += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-a[x] - b[y], x, y))
        return found


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(vector, lambda x: x != 0)


def _part_taking(vectors: DataFrame, vector: str) -> DataFrame:
    """uid, vec_id, vector (doubles) of the rows that take part; written."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), "n").limit(1).select("n").scalar()
    return materialize(
        rows.where(F.size("vector") == usual).withColumn("uid", F.monotonically_increasing_id()),
        "vectors",
    )


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """uid, vec_id, vector, place of the first k + 1 rows of each vector; written.

    The limit of the window is applied before the shuffle too, so a vector that very many
    rows share is a few rows of each task.
    """
    of_vector = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id", "uid")
    first = rows.withColumn("place", F.row_number().over(of_vector)).where(F.col("place") <= k + 1)
    return materialize(first.select("uid", "vec_id", "vector", "place"), "distinct-vectors")


def _fit(entries: DataFrame, shape: Shape) -> Codebooks | None:
    rows = entries.where("place = 1")
    n = rows.count()
    if not n:
        return None
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(shape.sample).select("vector")
    points = np.array([row["vector"] for row in drawn.collect()])
    k = 1 << max(0, round(np.log2(np.sqrt(n / shape.per_cell)))) if n > shape.per_cell else 1
    k = min(k, shape.most_centroids, len(points))
    half = max(1, points.shape[1] // 2)
    return Codebooks(quantiser(points[:, :half], k), quantiser(points[:, half:], k))


def _indexed(books):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = books.value.cells(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells, pa.int32())],
                    ["uid", "vec_id", "vector", "place", "cell"],
                )

    return made


def _probing(books, sizes, enough: int):
    """For each query and first centroid that it meets, the second centroids to look at."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, shelves, wanted = [], [], []
            n_second = len(books.value.second)
            for i, query in enumerate(_matrix(batch.column(2)) if batch.num_rows else ()):
                cells = np.sort(books.value.best_cells(query, sizes.value, enough))
                shelf, begins = np.unique(cells // n_second, return_index=True)
                taken += [i] * len(shelf)
                shelves += shelf.tolist()
                wanted += [part % n_second for part in np.split(cells, begins[1:])]
            rows = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(shelves, pa.int32()), pa.array(wanted, pa.list_(pa.int32()))],
                ["uid", "vec_id", "vector", "shelf", "cells"],
            )

    return made


#: Matrix products may differ from sums by less than this part of the scores.
_CLOSE = 1e-9


def _best(q: np.ndarray, entries: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int):
    """Places and exact scores of the k best entries, equal ones by the smaller id."""
    looked_at = np.flatnonzero(rough > -np.inf)
    if len(looked_at) > k:
        values = rough[looked_at]
        edge = np.partition(values, len(values) - k)[len(values) - k]
        looked_at = looked_at[values >= edge - _CLOSE * (1 + np.abs(values).max())]
    scores = (entries[looked_at] * q).sum(axis=1)
    order = np.lexsort((ids[looked_at], -scores))[:k]
    return looked_at[order], scores[order]


def _scored(k: int):
    """The k best entries for each probe; the rows of a shelf's part follow each other,
    entries before probes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            key = np.stack([column[c].to_numpy() for c in ("shelf", "block", "team")], 1)
            own, vec = column["uid"].to_numpy(), column["vec_id"].to_numpy()
            probe, matrix = column["probe"].to_numpy(zero_copy_only=False), _matrix(column["vector"])
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            found = []
            for begin, end in zip([0, *edges], [*edges, len(key)]):
                if tuple(key[begin]) != part:
                    part, held = tuple(key[begin]), []
                split = begin + int((~probe[begin:end]).sum())
                if split > begin:
                    second = np.array([c.as_py()[0] for c in column["cells"][begin:split]])
                    held.append((own[begin:split], vec[begin:split], second, matrix[begin:split]))
                if split == end or not held:
                    continue
                uids, ids, second, entries = (np.concatenate(x) for x in zip(*held))
                rough = matrix[split:end] @ entries.T
                for i, cells in enumerate(column["cells"][split:end], split):
                    now = np.where(np.isin(second, cells.values.to_numpy()), rough[i - split], -np.inf)
                    now[uids == own[i]] = -np.inf
                    best, scores = _best(matrix[i], entries, ids, now, k)
                    found.append(
                        (np.full(len(best), own[i]), np.full(len(best), vec[i]), ids[best], scores)
                    )
            if found:
                arrays = [pa.array(np.concatenate(values)) for values in zip(*found)]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "query_id", "vec_id", "score"])

    return made


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vector: str = "embedding",
    shape: Shape = Shape(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k entries found with the largest inner product.

    ``is_query`` chooses the queries by ``vec_id``; a row is no neighbour of itself.
    """
    spark = vectors.sparkSession
    rows = _part_taking(vectors, vector)
    distinct = _entries(rows, k)
    books = _fit(distinct, shape)
    kind = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], kind)
    shared = spark.sparkContext.broadcast(books)
    columns = "uid long, vec_id long, vector array<double>"
    index = materialize(
        distinct.mapInArrow(_indexed(shared), f"{columns}, place int, cell int"),
        "vector-index",
    )
    counts = index.where("place = 1").groupBy("cell").agg(F.count("*").alias("size"))
    sizes = np.zeros(len(books.first) * len(books.second), np.int64)
    for row in counts.collect():  # a row per pair of centroids at most
        sizes[row["cell"]] = row["size"]
    enough = max(shape.least, int(shape.share * sizes.sum()))
    queries = rows.where(is_query).select("uid", "vec_id", "vector")
    probing = _probing(shared, spark.sparkContext.broadcast(sizes), enough)
    probes = materialize(
        queries.mapInArrow(probing, f"{columns}, shelf int, cells array<int>"), "probes"
    )
    n_second = len(books.second)
    entries = index.withColumns(
        {
            "shelf": F.floor(F.col("cell") / n_second).cast("int"),
            "cells": F.array((F.col("cell") % n_second).cast("int")),
        }
    )
    in_shelf = entries.groupBy("shelf").agg(F.count("*").alias("size"))
    probed = probes.groupBy("shelf").agg(F.count("*").alias("probes"))
    parts = materialize(  # a row per first centroid at most
        in_shelf.join(probed, "shelf").select(
            "shelf",
            F.ceil(F.col("size") / shape.block).cast("int").alias("blocks"),
            F.ceil(F.col("probes") / shape.block).cast("int").alias("teams"),
        ),
        "shelf-parts",
    )
    block = F.pmod(F.xxhash64("uid"), "blocks").cast("int")
    team = F.pmod(F.xxhash64("uid"), "teams").cast("int")
    key = ["shelf", "block", "team"]
    wanted = [*key, "probe", "uid", "vec_id", "vector", "cells"]
    entry_rows = (
        entries.join(parts, "shelf")
        .withColumn("block", block)
        .withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1)))
        .withColumn("probe", F.lit(False))
    )
    probe_rows = (
        probes.join(parts, "shelf")
        .withColumn("team", team)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("probe", F.lit(True))
    )
    both = entry_rows.select(*wanted).unionByName(probe_rows.select(*wanted))
    dealt = both.repartition(*key).sortWithinPartitions(*key, "probe", "uid")
    found = dealt.mapInArrow(_scored(k), "uid long, query_id long, vec_id long, score double")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
