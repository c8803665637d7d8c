"""Embedding near-duplicates by collision-counting projections.

Vectors of length 1 are projected on ``lines`` random lines. Around every
vector as a query stands a window on each line, and a pair's collisions are the
lines on which one stands in the other's window. Of a pair at the threshold, a
line's window holds the other with a known probability, so the count that such
pairs reach in all but ``miss`` of all cases is a binomial quantile; pairs of
that count are verified by their exact cosine.

A window on one line holds a fixed share of all vectors, so counting over all
of them would be dearer than all cosines at any size. Vectors are therefore
dealt into small cells first, by the signs of further projections, in as many
tables as it takes for a pair at the threshold to share a cell in all but
``miss`` of all cases. A cell's first line is sorted, and only the pairs in its
query-centred windows go on to be counted on the other lines.

Cells carry sketches, the places on the lines as single bytes, and no vectors;
a vector travels only once for each candidate pair left after the count.
Windows are wider by the rounding, so that no collision is lost. A cell larger
than ``most`` is first thinned by its leader: members whose cosine with it
reaches the threshold are connected already, and of pairs within one component
none is looked at again. What is left is cut into tiles; none is skipped.

Cells and windows find links cheaply, but not all of them: a pair at the
threshold may share no cell, lie too far apart on the first line, or miss the
count. What they find orders the vectors, components together and by their
first cell, and in this order the vectors are cut into blocks. Every pair of
blocks is then gone through by cosines, so that no link is lost. Left out is
only what can hold none: rows that lie farther from a block's centre than its
radius and the threshold's angle together, and blocks of one component. Blocks
lie in the shared folder and are read from there, so disk grows with the
vectors; the cosines grow with their square where nothing can be left out.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import components, only, settle, shared_dir, small

#: Pairs of places that a task compares at once.
PAIRS = 1 << 20
#: A line is cut into so many steps of one size; what lies beyond its ends counts as its ends.
STEPS, ENDS = 254, 4.0
#: Bytes of a block's vectors at most, and blocks that a task holds against one.
BLOCK_BYTES, PARTNERS = 8 << 20, 512


def least_count(lines: int, p: float, miss: float) -> int:
    """The largest count that at least 1 - miss of binomial draws reach."""
    total, count = 0.0, 0
    for k in range(lines + 1):
        total += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if total > miss:
            return k
        count = k
    return count


def plan(n: int, threshold: float, miss: float, cell: int) -> tuple[int, int]:
    """(bits, tables): signs that name a cell, and tables of cells, for n vectors."""
    bits = max(0, round(math.log2(max(n, 1) / cell)))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if not bits else max(1, math.ceil(math.log(miss) / math.log(1 - share)))


def unit_vectors(lists: pa.Array) -> np.ndarray:
    """A matrix of the lists, which are of one length, each scaled to length 1."""
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    rows = flat.reshape(len(lists), -1)
    # a copy of other scale is the same direction; scaling by the largest first keeps the squares finite
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def sketch(places: np.ndarray) -> np.ndarray:
    """Places on the lines as bytes."""
    return np.clip(np.floor((places + ENDS) * (STEPS / (2 * ENDS))), 0, STEPS).astype(np.uint8)


def reach_of(width: float) -> int:
    """How far two bytes of places at most ``width`` apart can be apart."""
    return math.floor(width * STEPS / (2 * ENDS)) + 1


def _dealer(seed: int, bits: int, tables: int, lines: int):
    def deal(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                every = np.flatnonzero(dims == dim)
                for own in np.array_split(every, max(1, len(every) * int(dim) >> 20)):
                    own = pa.array(own)
                    unit = unit_vectors(batch.column("v").take(own))
                    ways = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), max(1, bits) * tables))
                    signs = (unit @ ways > 0).reshape(len(unit), tables, -1)[:, :, :bits]
                    cells = (signs * (1 << np.arange(bits))).sum(2) if bits else np.zeros((len(unit), tables), np.int64)
                    cells = cells + (np.arange(tables) << max(bits, 1)) + (int(dim) << 44)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * tables, pa.int32()), pa.array(cells.ravel(), pa.int64()))
                    on = sketch(unit @ np.random.default_rng([seed + 1, int(dim)]).standard_normal((int(dim), lines)))
                    marks = pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer((np.arange(len(unit) + 1) * lines).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(on))])
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(own), lists, marks], names=["vec_id", "cells", "marks"])

    return deal


def window_pairs(group: np.ndarray, marks: np.ndarray, side: np.ndarray, reach: int, least: int):
    """Yield (p, q), the places in the rows of pairs of one group that collide on at least ``least`` lines. Rows come by group; side: a row meets rows of another side, or those of side 0 each other."""
    order = np.lexsort((marks[:, 0], group))
    key = np.unique(group, return_inverse=True)[1][order].astype(np.int64) * 1024 + marks[order, 0]
    # a pair is met once, from its lower place on the first line
    ends = np.searchsorted(key, key + reach, side="right")
    count = ends - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    marks, side = marks[order], side[order]
    lines = marks.shape[1]
    at = 0
    while at < len(key):
        till = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        for piece in range(total[at], total[till], 4 * PAIRS):  # one row of a huge window
            these = np.arange(piece, min(piece + 4 * PAIRS, total[till]))
            p = np.searchsorted(total, these, side="right") - 1
            q = these - total[p] + p + 1
            meet = (side[p] != side[q]) | (side[p] == 0)
            p, q = p[meet], q[meet]
            hits = np.ones(len(p), np.int16)
            for k in range(1, lines):
                a, b = marks[p, k], marks[q, k]
                hits += (np.maximum(a, b) - np.minimum(a, b)) <= reach
                if k % 4 == 3:  # pairs that can't come up to the count any more go
                    keep = hits + (lines - 1 - k) >= least
                    p, q, hits = p[keep], q[keep], hits[keep]
            keep = hits >= least
            yield order[p[keep]], order[q[keep]]
        at = till


def _counter(lines: int, reach: int, least: int):
    """Candidate pairs of the cells of a partition, whose rows come sorted by cell."""

    def count(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            rows = rows.combine_chunks()
            ids, root = np.asarray(rows["vec_id"]), np.asarray(rows["root"])
            marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(-1, lines)
            group = np.unique(np.stack([np.asarray(rows["cell"]), np.asarray(rows["tile"])]), axis=1, return_inverse=True)[1].ravel()
            seen = []
            for p, q in window_pairs(group, marks, np.asarray(rows["side"]), reach, least):
                a, b = ids[p], ids[q]
                new = root[p] != root[q]
                seen.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[new], axis=0))
            pairs = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 1 << 17:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            cell, tile = np.asarray(rows["cell"]), np.asarray(rows["tile"])
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1]))
            if len(change):
                cut = int(change[-1]) + 1
                yield flush(rows.slice(0, cut))
                rows = rows.slice(cut)
            held, size = rows.to_batches(), rows.num_rows
        if held:
            yield flush(pa.Table.from_batches(held))

    return count


def _cosines(batches):
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            for some in np.array_split(np.flatnonzero(dims == dim), max(1, (dims == dim).sum() * int(dim) >> 19)):
                x, y = (unit_vectors(batch.column(c).take(pa.array(some))) for c in ("v", "w"))
                near[some] = np.einsum("ij,ij->i", x, y) >= np.asarray(batch.column("least"))[some]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])


def verified(own: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose vectors in own (vec_id, v, dim) have at least the cosine."""
    left = pairs.join(own.select(F.col("vec_id").alias("a"), "v", "dim"), "a")
    both = left.join(own.select(F.col("vec_id").alias("b"), F.col("v").alias("w")), "b")
    return both.select("a", "b", "v", "w", "dim", F.lit(threshold).alias("least")).mapInArrow(_cosines, "a bigint, b bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, lines: int = 24, reach: float = 1.6, miss: float = 0.02, cell: int = 64, most: int = 4096, seed: int = 7) -> DataFrame:
    """(vec_id, duplicate_of): each vector that is a near copy, with the least vec_id of its group, the groups being connected by pairs of at least the cosine ``threshold``.

    vectors needs vec_id and embedding. ``reach``: half a window, in distances
    of a pair at the threshold; ``miss``: share of such pairs that may share no
    cell, and again that may miss the count. ``cell``: vectors in a cell on
    average; ``most``: in one that is counted as a whole. These steer only what
    is found early: pairs that cells and windows leave out are found by
    comparing blocks, all with all, and every link is verified.

    Null and empty vectors, and those with nulls, infinities or NaN or of zeros
    only, are nobody's copies. Vectors of different dimension aren't compared;
    very long ones are compared whole.
    Rows with a null vec_id are left out; of rows that share one, the least
    embedding counts. Equal vectors are one from the start. Ties don't arise:
    ids are ordered. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    rows = only(vectors, vec_id="vec_id", v="embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), "v")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & sound)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    # -0.0 and 0.0 are one number
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    # equal vectors are found by two hashes, 128 bits together
    named = rows.select("vec_id", F.xxhash64("v").alias("x"), F.xxhash64("v", F.lit(1)).alias("y"))
    equal = settle(named.groupBy("x", "y").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = settle(named.join(small(equal), ["x", "y"]).where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b")))
    own = rows.join(small(copies.select(F.col("b").alias("vec_id"))), "vec_id", "left_anti").select("vec_id", "v", F.size("v").alias("dim"))
    bits, tables = plan(own.count(), threshold, miss, cell)
    width = reach * math.sqrt(2 - 2 * threshold)
    least = least_count(lines, math.erf(reach / math.sqrt(2)), miss)
    dealt = settle(own.mapInArrow(_dealer(seed, bits, tables, lines), "vec_id bigint, cells array<bigint>, marks binary"))
    placed = dealt.select("vec_id", "marks", F.explode("cells").alias("cell"))
    sizes = settle(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("vec_id").alias("leader")).where(F.col("n") > most))
    links = copies
    placed = placed.withColumn("root", F.col("vec_id"))
    if not sizes.isEmpty():
        led = placed.join(small(sizes), "cell").where("vec_id <> leader").select(F.col("leader").alias("a"), F.col("vec_id").alias("b")).distinct()
        # only verified links connect
        links = settle(copies.unionByName(verified(own, led, threshold)))
        roots = components(links)
        placed = placed.drop("root").join(small(settle(roots.withColumnsRenamed({"node": "vec_id"}))), "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))
        placed = _tiled(settle(placed), sizes, most)
    else:
        placed = placed.withColumn("tile", F.lit(0)).withColumn("side", F.lit(0))
    sorted_ = placed.select("cell", "tile", "side", "vec_id", "root", "marks").repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    pairs = settle(sorted_.mapInArrow(_counter(lines, reach_of(width), least), "a bigint, b bigint").distinct())
    roots = settle(components(links.unionByName(verified(own, pairs, threshold))))
    rest = settle(_remaining(own, dealt, roots, threshold))
    if not rest.isEmpty():
        roots = components(rest.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return roots.where("node <> root").select(F.col("node").alias("vec_id"), F.col("root").alias("duplicate_of"))


def _block_writer(folder: str, n: int):
    """Writes the rows, which come in order, as blocks, and gives each one's file, size, centre, radius and range of roots."""

    def write(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, count = TaskContext.get(), 0
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                every = np.flatnonzero(dims == dim)
                # small tables give enough blocks for all cores, too
                most = max(1, min(BLOCK_BYTES // (8 * int(dim)), max(256, n // 48)))
                for own in np.array_split(every, -(-len(every) // most)):
                    unit = unit_vectors(batch.column("v").take(pa.array(own)))
                    roots = np.asarray(batch.column("root").take(pa.array(own)))
                    centre = unit.mean(0)
                    size = math.sqrt(centre @ centre)
                    centre = centre / size if size > 1e-9 else unit[0]
                    radius = math.acos(max(-1.0, min(1.0, float((unit @ centre).min())))) + 1e-6
                    # a task that is tried again writes files of its own; only those of the one that ended are named
                    name = f"block-{task.partitionId():06d}-{count:06d}-{task.taskAttemptId()}-{os.getpid()}"
                    count += 1
                    with fs.open_output_stream(f"{path}/{name}") as f:
                        f.write(roots.tobytes() + unit.tobytes())
                    row = {"name": name, "dim": int(dim), "n": len(own), "centre": centre.tobytes(), "radius": radius, "low": int(roots.min()), "high": int(roots.max())}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("name", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()), ("low", pa.int64()), ("high", pa.int64())]))

    return write


def partners(i: int, g: int) -> range:
    """The blocks, modulo g, that block i is held against: itself, and of every two blocks one against the other."""
    return range(i, i + 1 + (g - 1) // 2 + (g % 2 == 0 and i < g // 2))


class _Merged:
    """Which roots were linked so far, and the links."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def of(self, root: int) -> int:
        while root in self.up:
            root = self.up[root]
        return root

    def labels(self, roots: np.ndarray) -> np.ndarray:
        if not self.up:
            return roots
        own, back = np.unique(roots, return_inverse=True)
        moved = np.flatnonzero(np.isin(own, np.fromiter(self.up, np.int64)))
        own[moved] = [self.of(r) for r in own[moved].tolist()]
        return own[back]

    def link(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.of(a), self.of(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((min(a, b), max(a, b)))


def link_blocks(x: np.ndarray, x_roots: np.ndarray, y: np.ndarray, y_roots: np.ndarray, threshold: float, merged: _Merged) -> None:
    """Link the roots of all rows of x and y, which are of length 1, whose cosine is at least the threshold, as far as they aren't linked."""
    dim = x.shape[1]
    low, y_low = x.astype(np.float32), y.astype(np.float32).T
    # what single precision can be off by, at most
    bound = np.float32(threshold - (dim + 8) * 2.0**-23)
    step = max(1, PAIRS // max(1, len(y)))
    y_now = merged.labels(y_roots)
    for at in range(0, len(x), step):
        p, q = np.divmod(np.flatnonzero(low[at : at + step] @ y_low >= bound), len(y))
        p += at
        x_now = merged.labels(x_roots[at : at + step])
        while len(p):
            new = x_now[p - at] != y_now[q]
            p, q = p[new], q[new]
            take = max(1, (1 << 19) // dim)
            some, p, other, q = p[:take], p[take:], q[:take], q[take:]
            near = np.einsum("ij,ij->i", x[some], y[other]) >= threshold
            found = np.unique(np.stack([x_now[some[near] - at], y_now[other[near]]], 1), axis=0)
            if len(found):
                merged.link(found)
                x_now, y_now = merged.labels(x_roots[at : at + step]), merged.labels(y_roots)


def _linker(folder: str, blocks, threshold: float, parts: int):
    """Links between roots that blocks give; an id names a block and a part of its partners."""

    def link(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        names, dims, counts, centres, radii, lows, highs = blocks.value
        angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

        def read(k: int) -> tuple[np.ndarray, np.ndarray]:
            with fs.open_input_file(f"{path}/{names[k]}") as f:
                data = f.read()
            return np.frombuffer(data, np.int64, counts[k]), np.frombuffer(data, np.float64, offset=8 * counts[k]).reshape(counts[k], dims[k])

        def least(radius: float) -> float:
            """The least cosine with a block's centre of what can be near one of its rows."""
            return math.cos(min(math.pi, radius + angle)) - 1e-9

        for batch in batches:
            for unit in batch.column("id").to_pylist():
                i, part = divmod(unit, parts)
                merged, own = _Merged(), None
                mine = np.frombuffer(centres[i], np.float64)
                for k in partners(i, len(names))[part * PARTNERS : (part + 1) * PARTNERS]:
                    k %= len(names)
                    if dims[k] != dims[i] or lows[i] == highs[i] == lows[k] == highs[k]:
                        continue
                    other = np.frombuffer(centres[k], np.float64)
                    if mine @ other < least(radii[i] + radii[k]):
                        continue
                    own = own or read(i)
                    roots, y = own if k == i else read(k)
                    x_in, y_in = own[1] @ other >= least(radii[k]), y @ mine >= least(radii[i])
                    link_blocks(own[1][x_in], own[0][x_in], y[y_in], roots[y_in], threshold, merged)
                links = np.array(merged.links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return link


def _remaining(own: DataFrame, dealt: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the roots of components, as many as connect all that vectors of at least the cosine connect. roots: (node, root), settled, of what is linked already."""
    spark = own.sparkSession
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    rows = own.join(small(roots.withColumnsRenamed({"node": "vec_id"})), "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))
    rows = rows.join(dealt.select(F.col("vec_id").alias("root"), F.col("cells")[0].alias("home")), "root")
    ordered = rows.orderBy("home", "root", "vec_id").select("root", "dim", "v")
    kinds = "name string, dim int, n int, centre binary, radius double, low bigint, high bigint"
    found = settle(ordered.mapInArrow(_block_writer(folder, dealt.count()), kinds)).orderBy("name").collect()
    g = len(found)
    parts = max(1, -(-(g // 2 + 1) // PARTNERS))
    shared = spark.sparkContext.broadcast(tuple(list(column) for column in zip(*found)) or ([],) * 7)
    return spark.range(0, g * parts, 1, max(1, min(g * parts, 1 << 16))).mapInArrow(_linker(folder, shared, threshold, parts), "a bigint, b bigint")


def _tiled(placed: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """placed with tile and side: small cells as they are; of a large one, the members of its largest component as shares, and every other member with each of these, and with each other."""
    large = placed.join(small(sizes.select("cell")), "cell")
    parts = large.groupBy("cell", "root").agg(F.count("*").alias("n"))
    main = settle(parts.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("total")).select("cell", F.col("m.root").alias("main"), F.ceil(F.col("m.n") / most).cast("int").alias("shares"), F.ceil((F.col("total") - F.col("m.n")) / most).cast("int").alias("others")))
    rows = large.join(small(main), "cell")
    share = F.pmod(F.xxhash64("vec_id"), F.greatest("shares", F.lit(1))).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.greatest("others", F.lit(1))).cast("int")
    # tiles of (block of others, share of the main component), and of (block, block)
    inside = rows.where("root = main and others > 0").withColumn("share", share).select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("block"))
    inside = inside.withColumn("tile", F.xxhash64(F.lit(1), "share", "block").cast("bigint")).withColumn("side", F.lit(1))
    outside = rows.where("root <> main").withColumn("block", block)
    across = outside.select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).withColumn("tile", F.xxhash64(F.lit(1), "share", "block").cast("bigint")).withColumn("side", F.lit(2))
    among = outside.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    among = among.withColumn("tile", F.xxhash64(F.lit(2), F.least("block", "other"), F.greatest("block", "other")).cast("bigint"))
    among = among.withColumn("side", F.when(F.col("block") == F.col("other"), 0).otherwise(F.when(F.col("block") < F.col("other"), 1).otherwise(2)))
    columns = ["cell", "tile", "side", "vec_id", "root", "marks"]
    rest = placed.join(small(sizes.select("cell")), "cell", "left_anti").withColumn("tile", F.lit(0).cast("bigint")).withColumn("side", F.lit(0))
    return rest.select(columns).unionByName(inside.select(columns)).unionByName(across.select(columns)).unionByName(among.select(columns))
