"""Embedding near-duplicates by an epsilon grid order join (operator 2).

Unit vectors with a cosine of at least c are at most ``sqrt(2 - 2c)`` apart, and so are their
projections on the leading principal directions. Vectors are sorted by the grid cells of these
projections and cut into blocks of the sequence. Pairs of sequence intervals are joined recursively,
from long intervals down to blocks: each round splits both intervals of a pair and drops the pairs
whose bounding boxes are provably too far apart. Only the remaining pairs of blocks are compared.

Equal vectors are one class with a weight, so copies are never expanded into pairs; a pair of blocks
returns a count and one link for each vector, not all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.llm.columnar import bound_batches
from vecmill.llm.components import components
from vecmill.session import cut_lineage

COSINE = 0.93
DIRECTIONS = 6
BLOCK = 512
FAN_BITS = 4
# Bits of a block's number within its partition.
PART_BITS = 24


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """A matrix of the column's vectors, filled with zeros to ``size``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), size))
    if len(lengths) and (lengths == size).all():
        return flat.reshape(len(column), size)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    # First by the largest component, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(classes: DataFrame, size: int) -> np.ndarray:
    """Leading principal directions of the unit vectors: second moments summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_vectors(batch.column("embedding"), size))
                total += unit.T @ unit
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), size).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), rows], ["i", "row"])

    parts = classes.select("embedding").mapInArrow(run, "i long, row array<double>")
    # Each direction is a task's row of the matrix, so the sum is of as many rows as a vector has.
    summed = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(size)]).toPandas()
    matrix = summed.sort_values("i")[[f"c{j}" for j in range(size)]].to_numpy(float)
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return vectors[:, np.argsort(-values)[:DIRECTIONS]]


def _projected(classes: DataFrame, size: int, directions: np.ndarray, reach: float) -> DataFrame:
    names = [f"cell{j}" for j in range(directions.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _unit(_vectors(batch.column("embedding"), size)) @ directions
                cells = np.floor(at / reach).astype(np.int32)
                place = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), at.shape[1]).cast(pa.list_(pa.float64()))
                arrays = [*batch.columns, place, *[pa.array(c) for c in cells.T]]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "place", *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, place array<double>, {', '.join(f'{n} int' for n in names)}")


def _blocks(sorted_rows: DataFrame, size: int, label_type: str, single: bool) -> DataFrame:
    """Consecutive rows of one label as blocks with their bounding boxes."""

    def emit(rows: list[pa.RecordBatch], serial: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        chunk = lambda name: table.column(name).combine_chunks()
        place = chunk("place")
        place = place.flatten().to_numpy().reshape(len(place), -1)
        # As in the table: single precision travels as such and is made unit length where it is compared.
        own = _vectors(chunk("embedding"), size).astype(np.float32 if single else np.float64)
        columns = [
            pa.array([serial]), table.column("label").slice(0, 1).combine_chunks(), table.column("dims").slice(0, 1).combine_chunks(),
            pa.array([place.min(axis=0).tolist()]), pa.array([place.max(axis=0).tolist()]),
            pa.array([chunk("node").to_pylist()]), pa.array([chunk("copies").to_pylist()]), pa.array([own.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["serial", "label", "dims", "low", "high", "ids", "copies", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, count, key = TaskContext.get().partitionId() << PART_BITS, [], 0, None
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist()))
            at = 0
            while at < batch.num_rows:
                if held and (keys[at] != key or count >= BLOCK):
                    yield emit(held, serial)
                    serial, held, count = serial + 1, [], 0
                key, end = keys[at], at + 1
                while end < batch.num_rows and keys[end] == key and count + end - at < BLOCK:
                    end += 1
                held.append(batch.slice(at, end - at))
                count, at = count + end - at, end
        if held:
            yield emit(held, serial)

    schema = f"serial long, label {label_type}, dims int, low array<double>, high array<double>, ids array<long>, copies array<long>, own binary"
    return sorted_rows.mapInArrow(run, schema)


def _near_blocks(blocks: DataFrame, reach: float, dims: int) -> DataFrame:
    """Pairs of blocks that may hold linked vectors: intervals of the sequence, split in rounds."""
    boxes = cut_lineage(blocks.select("serial", "label", "dims", "low", "high"), "boxes")
    last = boxes.agg(F.max(F.col("serial").bitwiseAND((1 << PART_BITS) - 1)), F.max(F.shiftright("serial", PART_BITS))).first()
    # The sequence numbers without the unused bits between a partition and the blocks in it.
    low_bits = int(last[0]).bit_length()
    sequence = F.shiftleft(F.shiftright("serial", PART_BITS), low_bits) + F.col("serial").bitwiseAND((1 << PART_BITS) - 1)
    boxes = boxes.withColumn("sequence", sequence)
    top = max(1, -(-(int(last[1]).bit_length() + low_bits) // FAN_BITS))

    def level(k: int) -> DataFrame:
        node = F.shiftright("sequence", FAN_BITS * k)
        return boxes.groupBy("label", "dims", node.alias("node")).agg(
            *[F.min(F.col("low")[j]).alias(f"low{j}") for j in range(dims)],
            *[F.max(F.col("high")[j]).alias(f"high{j}") for j in range(dims)],
        )

    def side(frame: DataFrame, name: str) -> DataFrame:
        renamed = frame.select("label", "dims", F.col("node").alias(name), *[F.col(f"{x}{j}").alias(f"{name}_{x}{j}") for x in ("low", "high") for j in range(dims)])
        return renamed.withColumn(f"{name}_up", F.shiftright(name, FAN_BITS))

    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col(f"a_low{j}") - F.col(f"b_high{j}"), F.col(f"b_low{j}") - F.col(f"a_high{j}")), 2)
        for j in range(dims)
    )
    pairs = level(top).select("label", "dims", F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(top - 1, -1, -1):
        nodes = cut_lineage(level(k), "intervals")
        up = pairs.select("label", "dims", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
        found = up.join(side(nodes, "a"), ["label", "dims", "a_up"]).join(side(nodes, "b"), ["label", "dims", "b_up"])
        pairs = cut_lineage(found.where((F.col("a") <= F.col("b")) & (gap <= reach * reach)).select("label", "dims", "a", "b"), "pairs")
    named = boxes.select("sequence", "serial")
    pairs = pairs.join(named.select(F.col("sequence").alias("a"), F.col("serial").alias("first")), "a")
    pairs = pairs.join(named.select(F.col("sequence").alias("b"), F.col("serial").alias("second")), "b")
    return pairs.select(F.col("first").alias("a"), F.col("second").alias("b"))


def _local_roots(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each vector reaches within the pair of blocks."""
    a, b = ids_a.copy(), ids_b.copy()
    most = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], most).min(axis=0))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], most).min(axis=1))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compare(pairs: DataFrame, blocks: DataFrame, cosine: float, single: bool) -> DataFrame:
    """``node, root, links`` of each class that has a link in a pair of blocks."""
    side = lambda x: blocks.select(F.col("serial").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("ids", "copies", "own")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids_a, ids_b = np.array(row["ids_a"]), np.array(row["ids_b"])
                unit_a, unit_b = (
                    _unit(np.frombuffer(row[c], np.float32 if single else np.float64).reshape(len(ids), -1).astype(np.float64))
                    for c, ids in (("own_a", ids_a), ("own_b", ids_b))
                )
                product = unit_a @ unit_b.T
                linked = product >= cosine
                for i, j in zip(*np.nonzero(np.abs(product - cosine) < 1e-12)):
                    linked[i, j] = math.fsum(unit_a[i] * unit_b[j]) >= cosine
                if row["a"] == row["b"]:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                root_a, root_b = _local_roots(linked, ids_a, ids_b)
                links_a, links_b = linked @ np.array(row["copies_b"]), linked.T @ np.array(row["copies_a"])
                some_a = linked.any(axis=1)
                out = [(ids_a[some_a], root_a[some_a], links_a[some_a])]
                if row["a"] != row["b"]:
                    some_b = linked.any(axis=0)
                    out.append((ids_b[some_b], root_b[some_b], links_b[some_b]))
                arrays = [pa.array(np.concatenate(x)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "root", "links"])

    return joined.mapInArrow(run, "node long, root long, links long")


def _numbered(members: DataFrame) -> DataFrame:
    """``members`` with a number ``node`` that only one class has: its smallest id, or, where classes
    have the same one (repeated ids with different vectors), a number that is no id."""
    several = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    if several.isEmpty():
        return members.withColumn("node", F.col("class_id"))
    low, high = members.agg(F.min("class_id"), F.max("class_id")).first()
    base = high + 1 if high < 1 << 61 else low - (1 << 61)
    shared = members.join(several, "class_id", "left_semi").withColumn("node", F.lit(base) + F.monotonically_increasing_id())
    alone = members.join(several, "class_id", "left_anti").withColumn("node", F.col("class_id"))
    return cut_lineage(alone.unionByName(shared.select(*alone.columns)), "vector-classes")


def _components(found: DataFrame, members: DataFrame) -> DataFrame:
    """``node, component`` with the smallest id of each component; its smallest number unless a class
    in it has a number that is no id."""
    roots = components(found, "node", "root")
    named = members.where("node != class_id").select("node", "class_id")
    if named.isEmpty():
        return roots
    smallest = roots.join(members.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("smallest"))
    changed = named.join(roots, "node").select("component").distinct().join(smallest, "component")
    return roots.join(changed, "component", "left").select("node", F.coalesce("smallest", "component").alias("component"))


def link(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows are compared when their labels are equal and not null. A vector that is null, empty or zero,
    or holds a null or a component that is not finite, has no links; vectors of different lengths
    have none with each other. ``n_links`` counts the other rows with a cosine of at least
    ``cosine``; ``component_id`` is the smallest id reachable. Repeated rows count as rows. Rows
    without an id come back without links. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    keyed = rows.select("vec_id", "embedding", "label", usable.alias("usable")).withColumn(
        "class_key", F.when(F.col("usable"), F.struct("label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")))
    )
    good = keyed.where("usable")
    members = good.groupBy("class_key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    members = _numbered(cut_lineage(members, "vector-classes"))
    leaders = good.join(members, (F.col("vec_id") == F.col("class_id")) & (good["class_key"] == members["class_key"]))
    classes = leaders.select("node", "copies", "label", F.size("embedding").alias("dims"), "embedding").dropDuplicates(["node"])
    classes = cut_lineage(classes, "vector-leaders")
    size = classes.agg(F.max("dims")).first()[0]
    if size is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    directions = _directions(classes, size)
    cells = [f"cell{j}" for j in range(directions.shape[1])]
    order = ["label", "dims", *cells, "node"]
    placed = _projected(classes, size, directions, reach)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(count, *order).sortWithinPartitions(*order)
    single = isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    blocks = cut_lineage(_blocks(ordered, size, rows.schema["label"].dataType.simpleString(), single), "blocks")
    found = cut_lineage(_compare(_near_blocks(blocks, reach, directions.shape[1]), blocks, cosine, single), "vector-links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = (
        members.join(totals, "node", "left")
        .join(_components(found, members), "node", "left")
        .select(
            "class_key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    joined = keyed.select("vec_id", "class_key").join(result, "class_key", "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
