"""Embedding near-duplicates by tiles over principal axes, with bounds on what is left of each product.

Vectors are scaled to length one and turned onto the principal axes of a bounded sample, which loses nothing: a turn
keeps all products.  A tree of medians over the leading axes gives leaves, leaves give blocks of about
``BLOCK`` vectors with bounding boxes, and blocks whose boxes are further apart than the threshold allows never
meet.  Two blocks that meet are compared tile by tile: products of the leading axes first, then what
the lengths of the remaining parts can add at most; a tile stops as soon as no pair can reach the threshold.
A tile returns sums of links per vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import scratch, stored
from claimloom.llm.simhash import forest
from claimloom.operators.components import components

THRESHOLD = 0.95
#: Vectors that the axes and the tree are fitted on at most; all vectors are compared.
SAMPLE = 8192
BLOCK = 1024
#: Leaves of the tree at most, and axes that it and the boxes use.
LEAVES, BOX_AXES = 1024, 8
#: Bytes of vectors that one broadcast holds.
TILE_BYTES = 16 << 20
#: Axes compared before the bound is tried again.
STEP = 16
_SLACK = 1e-9


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector array<double>) -> (id, dim, raw): raw bytes of valid vectors, null for the others."""
    for batch in batches:
        raw, dims = [], []
        for v in batch.column(1):
            values = None
            if v.is_valid and v.values is not None and v.values.null_count == 0:
                values = np.asarray(v.values.cast(pa.float64()), np.float64)
                if not len(values) or not np.isfinite(values).all() or not values.any():
                    values = None
            raw.append(None if values is None else values.tobytes())
            dims.append(0 if values is None else len(values))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "dim", "raw"]
        )


class Axes:
    """Principal axes of one dimension and a tree of medians on the leading ones."""

    def __init__(self, sample: np.ndarray, leaves: int):
        unit = _scaled(sample)
        _, vectors = np.linalg.eigh(unit.T @ unit)
        self.turn = np.ascontiguousarray(vectors[:, ::-1])
        self.cuts: list[tuple[int, float]] = []
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, leaves)))), int(np.log2(LEAVES))))
        points = (unit @ self.turn)[:, :BOX_AXES]
        level = [points]
        for _ in range(self.depth):
            below = []
            for part in level:
                spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
                axis = int(np.argmax(spread))
                cut = float(np.median(part[:, axis])) if len(part) else 0.0
                self.cuts.append((axis, cut))
                below += [part[part[:, axis] <= cut], part[part[:, axis] > cut]] if len(part) else [part, part]
            level = below

    def turned(self, raw: np.ndarray) -> np.ndarray:
        return _scaled(raw) @ self.turn

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        axes = np.array([a for a, _ in self.cuts] or [0])
        cuts = np.array([c for _, c in self.cuts] or [0.0])
        for _ in range(self.depth):
            right = points[np.arange(len(points)), axes[node]] > cuts[node]
            node = 2 * node + 1 + right
        return node


def _scaled(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    raw = raw / big  # lengths of very large and very small components neither overflow nor vanish
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _matrix(raws: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r) for r in raws), np.float64).reshape(-1, dim)


def _placed(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, Axes] = held.value
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            raws = batch.column(2).to_pylist()
            leaf = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in axes:
                    leaf[at] = axes[dim].leaf(axes[dim].turned(_matrix([raws[k] for k in at], dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


_BLOCK = "block bigint, dim int, leaf bigint, n int, ids array<bigint>, copies array<bigint>, raws binary, low array<double>, high array<double>"


def _packed(held):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        raw = _matrix(list(group["raw"]), dim)
        axes = held.value.get(dim)
        points = (axes.turned(raw) if axes else _scaled(raw))[:, :BOX_AXES]
        return pd.DataFrame(
            {
                "block": [int(group["block"].iloc[0])],
                "dim": [dim],
                "leaf": [int(group["leaf"].iloc[0])],
                "n": [len(group)],
                "ids": [group["rep"].tolist()],
                "copies": [group["copies"].tolist()],
                "raws": [raw.tobytes()],
                "low": [points.min(axis=0).tolist()],
                "high": [points.max(axis=0).tolist()],
            }
        )

    return run


class _Block:
    def __init__(self, row: dict, axes: dict[int, Axes]):
        self.number, self.dim = row["block"], row["dim"]
        self.raw = np.frombuffer(row["raws"], np.float64).reshape(-1, self.dim)
        own = axes.get(self.dim)
        self.unit = own.turned(self.raw) if own else _scaled(self.raw)
        self.low, self.high = np.array(row["low"]), np.array(row["high"])
        self.copies = np.array(row["copies"], np.int64)
        # lengths of what is left after each step of axes
        squares = np.cumsum((self.unit**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(squares), 1))], axis=1))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _reach(threshold: float) -> float:
    """The distance of two vectors of length one whose cosine is the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)


def _near(tile: list[dict], reach: float) -> Column:
    """Whether a block's box is within reach of the box around all blocks of a tile, in its dimension."""
    out = F.lit(False)
    for dim in sorted({row["dim"] for row in tile}):
        low = np.min([row["low"] for row in tile if row["dim"] == dim], axis=0).tolist()
        high = np.max([row["high"] for row in tile if row["dim"] == dim], axis=0).tolist()
        gaps = [F.greatest(F.lit(0.0), F.get("low", F.lit(k)) - high[k], low[k] - F.get("high", F.lit(k))) for k in range(len(low))]
        out = out | ((F.col("dim") == dim) & (sum((g * g for g in gaps), F.lit(0.0)) <= reach * reach))
    return out


def linked(a: _Block, b: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` with a cosine of at least ``threshold``; each pair once if a is b."""
    reach = _reach(threshold)
    none = np.empty(0, np.int64)
    if a.dim != b.dim:
        return none, none
    gap = np.maximum(0, np.maximum(a.low - b.high, b.low - a.high))
    if np.sqrt((gap**2).sum()) > reach:
        return none, none
    rows, cols = np.arange(len(a.unit)), np.arange(len(b.unit))
    sums = np.zeros((len(rows), len(cols)))
    for start in range(0, a.dim, STEP):
        stop = min(start + STEP, a.dim)
        sums += a.unit[rows, start:stop] @ b.unit[cols, start:stop].T
        can = sums + np.outer(a.rest[rows, stop], b.rest[cols, stop]) >= threshold - _SLACK
        in_rows, in_cols = can.any(axis=1), can.any(axis=0)
        if not in_rows.any():
            return none, none
        if in_rows.mean() < 0.7 or in_cols.mean() < 0.7:
            rows, cols = rows[in_rows], cols[in_cols]
            sums = sums[np.ix_(in_rows, in_cols)]
    r, c = np.nonzero(sums >= threshold - _SLACK)
    near = np.abs(sums[r, c] - threshold) <= _SLACK
    r, c = rows[r], cols[c]
    if near.any():  # so close that the turn could decide: the given vectors decide
        ok = np.ones(len(r), bool)
        ok[near] = _cosines(a.raw[r[near]], b.raw[c[near]]) >= threshold
        r, c = r[ok], c[ok]
    if a.number == b.number:
        r, c = r[r < c], c[r < c]
    return r, c


_LINKS = "u bigint, links bigint, v bigint"


def _tiles(held_axes, held_blocks, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = held_axes.value
        fixed = [(_Block(row, axes), pa.array(row["ids"], pa.int64())) for row in held_blocks.value]
        for batch in batches:
            for row in batch.to_pylist():
                a, a_ids = _Block(row, axes), pa.array(row["ids"], pa.int64())
                for b, b_ids in fixed:
                    if a.number < b.number:
                        continue
                    r, c = linked(a, b, threshold)
                    if not len(r):
                        continue
                    same = a.number == b.number
                    ids = a_ids if same else pa.concat_arrays([a_ids, b_ids])
                    copies = a.copies if same else np.concatenate([a.copies, b.copies])
                    c = c if same else c + len(a_ids)
                    links = np.zeros(len(ids), np.int64)
                    np.add.at(links, r, copies[c])
                    np.add.at(links, c, copies[r])
                    # rows of the forest: a vector, its links here, and a vector it hangs together with
                    root = forest(len(ids), r, c)
                    at = pa.array(np.flatnonzero(links))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), pa.array(links[at]), ids.take(pa.array(root[np.flatnonzero(links)]))], names=["u", "links", "v"]
                    )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component, kept): one row per row of ``vectors``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
    different dimensions link with nothing of each other.  Equal vectors are compared once and counted as often
    as they occur, each row by its own vector.  Rows that share an id are one node of a component, whatever their vectors.  A row with
    a null id is a vector like any other but names no component; where all ids of a component are null, so is its name.
    Other columns are ignored; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    kind = vectors.schema[id_col].dataType.simpleString()
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(given.mapInArrow(_unit, f"id {kind}, dim int, raw binary"), "vectors")
    # classes of equal vectors are known by numbers of their own, as ids may repeat or be missing
    classes = rows.where("raw is not null").groupBy("dim", "raw").agg(F.count("*").alias("copies"))
    reps = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    valid = stored(rows.where("raw is not null").join(reps, ["dim", "raw"]).select("id", "rep", "copies"), "vector-rows")
    dims = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect()}
    axes = {}
    for dim, size in dims.items():
        some = reps.where(F.col("dim") == dim).select("raw").orderBy(F.xxhash64("raw")).limit(SAMPLE).collect()
        axes[dim] = Axes(_matrix([r["raw"] for r in some], dim), -(-size // BLOCK))
    held = context.broadcast(axes)
    placed = stored(_with_leaf(reps, held), "vector-leaves")
    counts = sorted((r["dim"], r["leaf"], r["count"]) for r in placed.groupBy("dim", "leaf").count().collect())
    first, number, where = 0, [], []
    for dim, leaf, n in counts:
        blocks = -(-n // BLOCK)
        where.append((dim, leaf, first, blocks))
        number += [dim] * blocks
        first += blocks
    if not where:
        found = None
    else:
        plan = spark.createDataFrame(where, "dim int, leaf bigint, first bigint, blocks bigint")
        block = F.col("first") + F.pmod(F.xxhash64("raw", F.lit(3)), F.col("blocks"))
        packed = (
            placed.join(F.broadcast(plan), ["dim", "leaf"])
            .withColumn("block", block)
            .groupBy("block")
            .applyInPandas(_packed(held), _BLOCK)
        )
        blocks = stored(packed, "vector-blocks")
        paths, at = [], 0
        while at < len(number):
            stop, size = at, 0
            while stop < len(number) and size < TILE_BYTES:
                size += BLOCK * number[stop] * 8
                stop += 1
            these = [r.asDict() for r in blocks.where((F.col("block") >= at) & (F.col("block") < stop)).collect()]
            tile = context.broadcast(these)
            out = scratch(spark, "vector-links")
            # blocks that no vector of the tile can reach are neither shuffled nor compared
            later = blocks.where((F.col("block") >= at) & _near(these, _reach(threshold)))
            later = later.repartition(max(2, min(context.defaultParallelism * 4, len(number) - at)), "block")
            later.mapInArrow(_tiles(held, tile, threshold), _LINKS).write.parquet(out)
            tile.unpersist()
            paths.append(out)
            at = stop
        found = spark.read.schema(_LINKS).parquet(*paths)
    if found is None:
        found = spark.createDataFrame([], _LINKS)
    others = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("others"))
    named = valid.where("id is not null")
    torn = named.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v != last")
    one_id = named.join(torn, "id").select(F.col("rep").alias("u"), "v")
    hangs = components(found.select("u", "v").union(one_id)).withColumnRenamed("node", "rep")
    least = valid.groupBy("rep").agg(F.min("id").alias("least")).join(hangs, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = least.groupBy("component").agg(F.min("least").alias("name"))
    of_class = stored(
        least.join(names, "component").join(others, "rep", "left").select("rep", F.coalesce("others", F.lit(0)).alias("others"), "name"), "vector-components"
    )
    out = valid.join(of_class, "rep").select("id", (F.col("copies") - 1 + F.col("others")).alias("n_links"), F.col("name").alias("component"))
    # a vector that links with nothing still shares the node of its id
    nodes = out.where("id is not null").select("id", "component").distinct()
    alone = rows.where("raw is null and id is not null").select("id").join(nodes, "id", "left")
    alone = alone.select("id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
    nameless = rows.where("raw is null and id is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    out = out.union(alone).union(nameless)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def _with_leaf(reps: DataFrame, held) -> DataFrame:
    return reps.select("rep", "dim", "raw", "copies").mapInArrow(
        _placed(held), "rep bigint, dim int, raw binary, copies bigint, leaf bigint"
    )
