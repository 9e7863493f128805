"""Hard negatives by integer inner products, behind angular triangle filters.

Vectors become integers.  Every row stores its norm and its angles to a few reference
directions.  By the triangle inequality the angle between two rows lies between the
difference and the sum of their angles to one direction, so cosines lie in an interval;
times the norms, and widened by more than any rounding, that bounds the inner product.

Rows are put in the order of (nearest direction, label, angle) and cut into tiles, anchors
into teams.  Three levels of the same bound decide what is scored: a team meets a tile only
if the intervals of the two allow a wanted score, entries of the tile are sorted by their
angle and only the window of angles that can hold one is multiplied, and only scores in the
wanted range go on.  Every score that is returned is an exact integer.

1. home: each anchor meets its own tile; the last of its best scores there is a threshold;
2. positives: the other tiles that can beat the threshold, and the best of both;
3. negatives: tiles that can hold a score in the range that an anchor's positives ask for.

A tile or team has a fixed number of rows, whatever label or vector repeats, and only tables
with a row per tile, team or pair of them are joined to choose the work.  Vectors without
structure leave little to prune: the work then grows with anchors times rows, in blocks.

Defined results: rows with a null id, label or vector, with a null or non-finite component,
with a component of ``LARGEST`` or more after scaling, or of another length than most take
no part; zero vectors do, with score 0.  Equal scores go by the smaller id, repeated rows
are rows of their own (also as positives of each other), an empty table gives an empty
result, an anchor without positives or negatives has no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.llm.neighbours import quantiser
from scorewright.operators.ranking import global_rank
from scorewright.sources.storage import materialize

#: Components stay below this, so that sums of products fit into 64 bits.
LARGEST = 1 << 26
#: Angles are off by less than this; products of norms by less than this part.
_ANGLE, _PART = 1e-6, 1e-9
#: Anchors that are multiplied at once.
_CHUNK = 64


@dataclass(frozen=True)
class Rule:
    """How many partners, and the range of negative scores in percent of the positive's."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256


@dataclass(frozen=True)
class Shape:
    references: int = 16
    sample: int = 20_000
    tile: int = 2_048
    team: int = 2_048


def _part_taking(vectors: DataFrame, vector: str, label: Column, rule: Rule) -> DataFrame:
    """uid, vec_id, label, vector (integers), written."""
    finite = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        & (F.abs(F.floor(rule.scale * x.cast("double"))) < LARGEST),
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.when(finite, F.transform(vector, lambda x: F.floor(rule.scale * x.cast("double")).cast("int")))
        .alias("vector"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), "n").limit(1).select("n").scalar()
    return materialize(
        rows.where(F.size("vector") == usual).withColumn("uid", F.monotonically_increasing_id()),
        "integer-vectors",
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _directions(rows: DataFrame, shape: Shape) -> np.ndarray | None:
    """Unit vectors in the middle of groups of a bounded sample."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(shape.sample).select("vector")
    points = np.array([row["vector"] for row in drawn.collect()], np.float64)
    if not len(points):
        return None
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    units = points / np.where(norms > 0, norms, 1)
    found = quantiser(units, min(shape.references, len(units)))
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    axis = np.eye(1, found.shape[1])
    return np.where(norms > 1e-9, found / np.where(norms > 1e-9, norms, 1), axis)


def _measuring(shared):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("vector")).astype(np.float64)
            norms = np.linalg.norm(points, axis=1)
            cosines = points @ directions.T / np.where(norms > 0, norms, 1)[:, None]
            angles = np.arccos(np.clip(cosines, -1, 1))
            near = angles.argmin(axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, angles.size + 1, angles.shape[1]), pa.int32()), angles.ravel()
            )
            far = angles[np.arange(len(near)), near]
            values = [*batch.columns, *map(pa.array, (norms, near, far)), lists]
            yield pa.RecordBatch.from_arrays(
                values, [*batch.schema.names, "norm", "near", "far", "angles"]
            )

    return measured


_ORDER = ["near", "label", "far", "uid"]


def _extent(rows: DataFrame, key: str, n_references: int, *more: Column) -> DataFrame:
    """A row per block of rows: the intervals of its labels, norms and angles."""
    angles = [F.col("angles")[i] for i in range(n_references)]
    return rows.groupBy(key).agg(
        F.min("label").alias("label_from"),
        F.max("label").alias("label_to"),
        F.min("norm").alias("norm_from"),
        F.max("norm").alias("norm_to"),
        F.array(*[F.min(a) for a in angles]).alias("angle_from"),
        F.array(*[F.max(a) for a in angles]).alias("angle_to"),
        *more,
    )


def _meetings(tiles: DataFrame, teams: DataFrame, n_teams: int, wanted: Column) -> DataFrame:
    """(tile, team) pairs whose intervals allow a score between ``least`` and ``most``."""
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_teams - 1).cast("long"))
    both = (
        tiles.withColumn("team", F.explode(numbers))
        .alias("a")
        .join(teams.alias("b"), "team")
    )
    apart = F.expr(
        "array_max(transform(sequence(0, size(a.angle_from) - 1), i -> greatest(0D,"
        " a.angle_from[i] - b.angle_to[i], b.angle_from[i] - a.angle_to[i])))"
    )
    beyond = F.expr(
        "array_min(transform(sequence(0, size(a.angle_from) - 1), i -> a.angle_to[i] + b.angle_to[i]))"
    )
    highest = F.expr("a.norm_to * b.norm_to") * F.cos(F.greatest(F.lit(0.0), apart - _ANGLE))
    lowest = F.expr("a.norm_from * b.norm_from") * F.cos(F.least(F.lit(np.pi), beyond + _ANGLE))
    reaches = (F.col("least") <= 0) | (highest * (1 + _PART) + 1 >= F.col("least"))
    stays = (lowest <= 0) | (lowest * (1 - _PART) - 1 <= F.col("most"))
    return both.where(wanted & F.coalesce(reaches, F.lit(True)) & F.coalesce(stays, F.lit(True))).select(
        "tile", "team"
    )


_FIELDS = [
    "tile", "team", "probe", "uid", "vec_id", "label", "vector", "norm", "angles", "home", "scores", "ids",
]


def _dealt(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Entries, then anchors, of each (tile, team), one after the other in one task."""
    none = F.lit(None).cast("array<long>")
    rows = entries.withColumns(
        {"probe": F.lit(False), "home": F.col("tile"), "scores": none, "ids": none}
    )
    both = rows.select(*_FIELDS).unionByName(anchors.withColumn("probe", F.lit(True)).select(*_FIELDS))
    key = ["tile", "team"]
    return both.repartition(*key).sortWithinPartitions(*key, "probe", "uid").select(*_FIELDS)


@dataclass
class _Block:
    """Entries of a tile in the order of their angle to one direction, the tightest."""

    uid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    norm: np.ndarray
    angles: np.ndarray
    direction: int = 0

    def in_order(self) -> _Block:
        direction = int(self.angles.mean(axis=0).argmin())
        order = np.argsort(self.angles[:, direction], kind="stable")
        parts = (self.uid, self.vec_id, self.label, self.vector, self.norm, self.angles)
        return _Block(*[p[order] for p in parts], direction)

    def window(self, norms: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> slice:
        """The entries that can score between least and most with one of the anchors."""
        angles = self.angles[:, self.direction]
        begin, end = 0, len(angles)
        if (least > 0).all():
            highest = norms * self.norm.max() * (1 + _PART) + 1
            reach = np.arccos(np.minimum(1, least / highest)) + _ANGLE
            begin = int(np.searchsorted(angles, (at - reach).min()))
            end = int(np.searchsorted(angles, (at + reach).max(), side="right"))
        lowest = norms * self.norm.min() * (1 - _PART) - 1
        if ((lowest > 0) & (most < lowest)).all():
            inner = np.arccos(np.maximum(-1, most / lowest)) - at - _ANGLE
            begin = max(begin, int(np.searchsorted(angles, inner.min())))
        return slice(begin, max(begin, end))

    def scores(self, anchors: np.ndarray, norms: np.ndarray, part: slice) -> np.ndarray:
        """Exact inner products [anchor, entry] of the part."""
        entries = self.vector[part]
        if norms.max() * self.norm.max() < 1 << 52:  # no partial sum can leave the doubles' integers
            return (anchors.astype(np.float64) @ entries.astype(np.float64).T).astype(np.int64)
        return anchors.astype(np.int64) @ entries.astype(np.int64).T


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, dict]]:
    """Tile, its entries and a batch of anchors, for each part of the sorted rows."""
    key, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = dict(zip(batch.schema.names, batch.columns))
        keys = np.stack([column[c].to_numpy() for c in ("tile", "team")], 1)
        values = {c: column[c].to_numpy() for c in ("uid", "vec_id", "label", "norm", "home")}
        values |= {c: _matrix(column[c]) for c in ("vector", "angles")}
        probe = column["probe"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *edges], [*edges, len(keys)]):
            if tuple(keys[begin]) != key:
                key, held, block = tuple(keys[begin]), [], None
            split = begin + int((~probe[begin:end]).sum())
            if split > begin:
                fields = ("uid", "vec_id", "label", "vector", "norm", "angles")
                held.append([values[f][begin:split] for f in fields])
            if split < end and held:
                block = block or _Block(*map(np.concatenate, zip(*held))).in_order()
                anchors = {f: v[split:end] for f, v in values.items()}
                for f in ("scores", "ids"):
                    anchors[f] = column[f].slice(split, end - split).to_pylist()
                yield int(key[0]), block, anchors


def _first(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((uids[places], ids[places], -scores[places]))][:k]


def _chunks(block: _Block, anchors: dict, least: np.ndarray, most: np.ndarray):
    """Anchors in the order of their angle, each with the window's part and its scores."""
    at = anchors["angles"][:, block.direction]
    order = np.argsort(at, kind="stable")
    for begin in range(0, len(order), _CHUNK):
        own = order[begin : begin + _CHUNK]
        norms = anchors["norm"][own]
        part = block.window(norms, at[own], least[own], most[own])
        if part.stop > part.start:
            yield own, part, block.scores(anchors["vector"][own], norms, part)


def _batch(found: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if found:
        arrays = [pa.array(np.concatenate([np.atleast_1d(x) for x in v])) for v in zip(*found)]
        yield pa.RecordBatch.from_arrays(arrays, names)


_NO_LIMIT = np.iinfo(np.int64).max

_POSITIVES = "uid long, score long, id long, other long"


def _positive_parts(k: int, at_home: bool):
    """The k best entries of the anchor's label; ``scores`` may hold its threshold."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, block, anchors in _parts(batches):
            least = np.array([(s or [-_NO_LIMIT])[0] for s in anchors["scores"]])
            most = np.full(len(least), _NO_LIMIT)
            found = []
            for own, part, scores in _chunks(block, anchors, least, most):
                for i, row in zip(own, scores):
                    if not at_home and anchors["home"][i] == tile:
                        continue
                    allowed = (block.label[part] == anchors["label"][i]) & (row >= least[i])
                    places = np.flatnonzero(allowed & (block.uid[part] != anchors["uid"][i]))
                    ids, uids = block.vec_id[part][places], block.uid[part][places]
                    best = _first(row[places], ids, uids, k)
                    uid = np.full(len(best), anchors["uid"][i])
                    found.append((uid, row[places][best], ids[best], uids[best]))
            yield from _batch(found, ["uid", "score", "id", "other"])

    return made


_NEGATIVES = (
    "uid long, anchor_id long, place long, positive_id long, positive_score long,"
    " negative_id long, negative_score long, other long"
)


def _negative_parts(rule: Rule):
    """For each anchor and positive the best entries of other labels in the range."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, anchors in _parts(batches):
            limits = [_limits(scores, rule) for scores in anchors["scores"]]
            least = np.array([min(low for low, _ in own) for own in limits])
            most = np.array([max(high for _, high in own) for own in limits])
            found = []
            for own, part, scores in _chunks(block, anchors, least, most):
                for i, row in zip(own, scores):
                    allowed = (row >= least[i]) & (row <= most[i])
                    places = np.flatnonzero(allowed & (block.label[part] != anchors["label"][i]))
                    values = row[places]
                    ids, uids = block.vec_id[part][places], block.uid[part][places]
                    for place, (low, high) in enumerate(limits[i]):
                        within = np.flatnonzero((values >= low) & (values <= high))
                        best = within[_first(values[within], ids[within], uids[within], rule.negatives)]
                        n = len(best)
                        given = (
                            anchors["uid"][i], anchors["vec_id"][i], place,
                            anchors["ids"][i][place], anchors["scores"][i][place],
                        )
                        same = [np.full(n, x, np.int64) for x in given]
                        found.append((*same, ids[best], values[best], uids[best]))
            yield from _batch(found, [f.split()[0] for f in _NEGATIVES.split(",")])

    return made


def _limits(scores: list[int], rule: Rule) -> list[tuple[int, int]]:
    """Least and most score of a negative for each positive."""
    return [(-(-rule.low * s // 100), rule.high * s // 100) for s in scores]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    vector: str = "embedding",
    rule: Rule = Rule(),
    shape: Shape = Shape(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` chooses the anchors by ``vec_id``.  An anchor's positives are the highest
    scores of its own label; negatives are the highest scores of other labels between
    ``low`` and ``high`` percent of the positive's score.
    """
    spark = vectors.sparkSession
    kind = (
        "anchor_id long, positive_id long, rank int, negative_id long,"
        " positive_score long, negative_score long"
    )
    rows = _part_taking(vectors, vector, F.col("label") if label is None else label, rule)
    directions = _directions(rows, shape)
    if directions is None:
        return spark.createDataFrame([], kind)
    columns = "vec_id long, label long, vector array<int>, uid long"
    measured = rows.select("vec_id", "label", "vector", "uid").mapInArrow(
        _measuring(spark.sparkContext.broadcast(directions)),
        f"{columns}, norm double, near long, far double, angles array<double>",
    )
    entries = materialize(
        global_rank(measured, _ORDER)
        .withColumn("tile", F.floor((F.col("rank") - 1) / shape.tile))
        .drop("rank", "n"),
        "tiles",
    )
    none = F.lit(None).cast("array<long>")
    anchors = materialize(
        global_rank(entries.where(is_anchor), _ORDER)
        .withColumn("team", F.floor((F.col("rank") - 1) / shape.team))
        .withColumns({"home": F.col("tile"), "scores": none, "ids": none})
        .drop("rank", "n", "tile"),
        "teams",
    )
    last_team = anchors.agg(F.max("team")).first()[0]
    if last_team is None:
        return spark.createDataFrame([], kind)
    n = len(directions)
    tiles = materialize(_extent(entries, "tile", n), "tile-extents")

    # home
    alone = F.lit(-1).cast("long").alias("team")
    guests = anchors.drop("team").select("*", F.col("home").alias("tile"), alone)
    hosts = entries.join(anchors.select(F.col("home").alias("tile")).distinct(), "tile", "left_semi")
    at_home = materialize(
        _dealt(hosts.select("*", alone), guests).mapInArrow(
            _positive_parts(rule.positives, True), _POSITIVES
        ),
        "positives-at-home",
    )

    # positives
    last = at_home.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    full = last.where(F.col("n") == rule.positives).select("uid", F.array("score").alias("scores"))
    placed = materialize(anchors.drop("scores").join(full, "uid", "left"), "thresholds")
    least = F.min(F.coalesce(F.col("scores")[0].cast("double"), F.lit(float("-inf")))).alias("least")
    most = F.lit(float("inf")).alias("most")
    same_label = F.expr("a.label_from <= b.label_to AND b.label_from <= a.label_to")
    elsewhere = _met(entries, tiles, placed, n, last_team + 1, same_label, least, most).mapInArrow(
        _positive_parts(rule.positives, False), _POSITIVES
    )
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")
    chosen = (
        at_home.unionByName(elsewhere)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= rule.positives)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("p"))
        .select("uid", F.col("p.score").alias("scores"), F.col("p.id").alias("ids"))
    )
    paired = materialize(anchors.drop("scores", "ids").join(chosen, "uid"), "anchors-with-positives")

    # negatives
    scores = F.col("scores")
    least = F.min(F.least(F.array_min(scores), F.lit(0).cast("long")) * 1.0)
    lowest = F.min(F.array_min(scores) * (rule.low / 100) - 1)
    least = F.when(F.min(F.array_min(scores)) > 0, lowest).otherwise(least).alias("least")
    most = F.max(F.array_max(scores) * (rule.high / 100) + 1).alias("most")
    one_label = "a.label_from = a.label_to AND b.label_from = b.label_to AND a.label_from = b.label_from"
    other_label = F.expr(f"NOT ({one_label})")
    negatives = _met(entries, tiles, paired, n, last_team + 1, other_label, least, most).mapInArrow(
        _negative_parts(rule), _NEGATIVES
    )
    order = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id", "other")
    return (
        negatives.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rule.negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _met(
    entries: DataFrame,
    tiles: DataFrame,
    anchors: DataFrame,
    n_references: int,
    n_teams: int,
    wanted: Column,
    least: Column,
    most: Column,
) -> DataFrame:
    """Entries and anchors of the tiles and teams that meet, dealt to tasks."""
    teams = _extent(anchors, "team", n_references, least, most)
    pairs = materialize(_meetings(tiles, teams, n_teams, wanted), "meetings")
    return _dealt(entries.join(pairs, "tile"), anchors.join(pairs, "team"))
