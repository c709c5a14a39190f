"""k-means over a VA-file: vectors as cells of a few bits, bounds from lookup tables, full vectors on demand.

Each component becomes a whole number and falls into one of ``2 ** bits`` cells of its dimension,
cut at approximate quantiles between the exact extremes. Tasks write flat files of blocks: ids,
cells (two to a byte, at 4 bits) and, behind them, the full vectors. A round reads the cells
alone: for each centroid, tables of the smallest and the largest squared distance of every cell
to its component add up to an interval that holds the vector's distance. Where one centroid's
interval lies below all others the vector is decided; where intervals overlap the vector itself
is read at its place in the file and the exact distances decide. So is one that changes its
centroid, because only such vectors change the centroids' exact sums: they go off one sum and
onto the other.

A round's table has one row for each block: the centroid of each of its vectors (a byte or two),
and what the block adds to the sums. The driver holds the centroids and sums, ``k`` times the
dimension whole numbers.

Files are written under another name and moved when whole, and a repeated task writes the same
file again, so lost executors do no harm.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component
take no part. Rows without an id are clustered but do not start a centroid; repeated rows are a
vector each, and of rows with one id the smaller vector comes first among the starts. With fewer
vectors than centroids there are that many centroids. Ties go to the smaller number, empty
centroids stay. Scaled components beyond 2 ** 26 raise an error (squared distances must fit in 64
bits). An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dealt, fs_path, scratch, stored

BLOCK = 4096            # vectors
SLICE = 1024            # vectors whose distances are held at once
GAP = 16                # unneeded vectors between needed ones that one read runs over
LARGEST = 2 ** 26
NONE = 0xFFFF
ROUND = "file string, at bigint, n int, label binary, sums array<bigint>, counts array<bigint>, fetched bigint"


def scaled(df: DataFrame, id_col: str, vec: str, dim: int, scale: int) -> DataFrame:
    """id, v: floor(scale * component) as long, of the vectors that take part."""
    v = F.col(f"`{vec}`")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                         & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), whole.alias("v"))


def cell_edges(rows: DataFrame, dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(inner cuts, least and greatest value of each cell) by dimension, from one aggregate."""
    n = 2 ** bits
    at = [i / n for i in range(1, n)]
    got = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(
        F.percentile_approx("x", at, 100 * n).alias("cuts"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    cuts, ends = np.zeros((dim, n - 1), np.int64), np.zeros((dim, 2, n), np.int64)
    for r in got:
        cuts[r.d] = np.sort(r.cuts)
        ends[r.d, 0] = [r.lo, *cuts[r.d]]
        ends[r.d, 1] = np.maximum([*(cuts[r.d] - 1), r.hi], ends[r.d, 0])
    if len(got) and max(abs(int(ends.min())), abs(int(ends.max()))) > LARGEST:
        raise ValueError(f"scaled components must lie within {LARGEST}")
    return cuts, ends


def pack_cells(x: np.ndarray, cuts: np.ndarray, bits: int) -> np.ndarray:
    """Cells of vectors (rows), several to a byte."""
    per = 8 // bits
    out = np.zeros((len(x), -(-x.shape[1] // per)), np.uint8)
    for d in range(x.shape[1]):
        out[:, d // per] |= (np.searchsorted(cuts[d], x[:, d], side="right") << (bits * (d % per))).astype(np.uint8)
    return out


def lookup(ends: np.ndarray, centroids: np.ndarray, bits: int) -> np.ndarray:
    """Table [byte position, byte value, 2 k]: what a byte of cells adds to the least and to the
    greatest squared distance from each centroid."""
    per, (dim, _, n), k = 8 // bits, ends.shape, len(centroids)
    lo, hi, c = ends[:, 0, :, None], ends[:, 1, :, None], centroids.T[:, None, :]
    least = np.square(np.maximum(np.maximum(lo - c, c - hi), 0))
    most = np.square(np.maximum(np.abs(c - lo), np.abs(hi - c)))
    both = np.concatenate([least, most], axis=2)            # dim, cell, 2 k
    values = np.arange(256)
    table = np.zeros((-(-dim // per), 256, 2 * k), np.int64)
    for d in range(dim):
        table[d // per] += both[d, (values >> (bits * (d % per))) & (n - 1)]
    return table


def bounds(cells: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible squared distance of each vector from each centroid."""
    total = np.zeros((len(cells), table.shape[2]), np.int64)
    for j in range(table.shape[0]):
        total += table[j, cells[:, j]]
    k = table.shape[2] // 2
    return total[:, :k], total[:, k:]


def decide(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid of the smallest upper bound, whether another one's interval reaches it)."""
    best = np.argmin(most, axis=1)
    top = most[np.arange(len(best)), best][:, None]
    number = np.arange(most.shape[1])[None, :]
    rival = (least < top) | ((least == top) & (number < best[:, None]))
    rival[np.arange(len(best)), best] = False
    return best, rival.any(axis=1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(centroids)), np.int64)
    for a in range(0, len(x), SLICE):
        out[a:a + SLICE] = np.square(x[a:a + SLICE, None, :] - centroids[None]).sum(axis=2)
    return out


class Block:
    """A block of a file: ids, cells and vectors at their places."""

    def __init__(self, file, at: int, n: int, dim: int, width: int):
        self.file, self.at, self.n, self.dim, self.width = file, at, n, dim, width

    @staticmethod
    def data(ids: list, x: np.ndarray, cells: np.ndarray) -> bytes:
        none = np.array([i is None for i in ids], "u1")
        return none.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + cells.tobytes() + x.astype("<i4").tobytes()

    def ids(self) -> list:
        raw = self.file.read_at(9 * self.n, self.at)
        none = np.frombuffer(raw, "u1", self.n)
        return [None if x else i for i, x in zip(np.frombuffer(raw, "<i8", self.n, self.n).tolist(), none)]

    def cells(self) -> np.ndarray:
        raw = self.file.read_at(self.width * self.n, self.at + 9 * self.n)
        return np.frombuffer(raw, np.uint8).reshape(self.n, self.width)

    def vectors(self, which: np.ndarray | None = None) -> np.ndarray:
        """All vectors, or those of the given ascending numbers."""
        start, size = self.at + (9 + self.width) * self.n, 4 * self.dim
        which = np.arange(self.n) if which is None else which
        out = np.empty((len(which), self.dim), np.int64)
        ends = [0, *(np.flatnonzero(np.diff(which) > GAP) + 1).tolist(), len(which)]
        for a, z in itertools.pairwise(ends):
            if a < z:
                lo, hi = int(which[a]), int(which[z - 1]) + 1
                got = np.frombuffer(self.file.read_at((hi - lo) * size, start + lo * size), "<i4").reshape(-1, self.dim)
                out[a:z] = got[which[a:z] - lo]
        return out


def build(rows: DataFrame, folder: str, dim: int, cuts: np.ndarray, bits: int) -> DataFrame:
    """Write the files; return file, at, n of each block."""
    fs, path = fs_path(folder)
    fs.create_dir(path, recursive=True)

    def make(batches):
        task = TaskContext.get()
        name = f"cells-{task.partitionId():07d}.va"
        part, out, at, found = "", None, 0, []
        ids, held, n = [], [], 0

        def flush(size):
            nonlocal ids, held, n, at
            x = np.concatenate(held)
            data = Block.data(ids[:size], x[:size], pack_cells(x[:size], cuts, bits))
            found.append((at, size))
            at += out.write(data)
            ids, held, n = ids[size:], [x[size:]], n - size

        for b in batches:
            if not len(b):
                continue
            if out is None:
                fs, path = fs_path(folder)
                part = f"{path}/.{name}.{task.taskAttemptId()}"
                out = fs.open_output_stream(part)
            ids += b.column("id").to_pylist()
            held.append(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            n += len(b)
            while n >= BLOCK:
                flush(BLOCK)
        if out is not None:
            if n:
                flush(n)
            out.close()
            fs.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([a for a, _ in found], pa.int64()),
                                              pa.array([m for _, m in found], pa.int32())], ["file", "at", "n"])

    return stored(rows.mapInArrow(make, "file string, at bigint, n int"), "blocks")


def _each(folder: str, batches, dim: int, width: int):
    """(row, block) of every row of a round's table."""
    fs, path = fs_path(folder)
    for b in batches:
        for r in b.to_pylist():
            with fs.open_input_file(f"{path}/{r['file']}") as file:
                yield r, Block(file, r["at"], r["n"], dim, width)


def assign(blocks: DataFrame, folder: str, ends: np.ndarray, centroids: np.ndarray, bits: int) -> DataFrame:
    """One round: the new centroid of each vector, and what moved off and onto each centroid's sum."""
    k, dim = centroids.shape
    width = -(-dim // (8 // bits))

    def work(batches):
        table = lookup(ends, centroids, bits)
        for r, block in _each(folder, batches, dim, width):
            old = np.frombuffer(r["label"], "<u2").astype(np.int64)
            label, open_ = decide(*bounds(block.cells(), table))
            need = np.flatnonzero(open_ | (label != old))
            x = block.vectors(need)
            apart = open_[need]
            label[need[apart]] = np.argmin(distances(x[apart], centroids), axis=1)
            sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
            was, now = old[need], label[need]
            for c in range(k):
                come, gone = (now == c) & (was != c), (was == c) & (now != c)
                sums[c] = x[come].sum(axis=0) - x[gone].sum(axis=0)
                counts[c] = come.sum() - gone.sum()
            yield pa.RecordBatch.from_pylist([{**r, "label": label.astype("<u2").tobytes(), "sums": sums.ravel().tolist(),
                                               "counts": counts.tolist(), "fetched": len(need)}], schema=SCHEMA)

    return stored(dealt(blocks).mapInArrow(work, ROUND), "round")


SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int32()), ("label", pa.binary()),
                    ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("fetched", pa.int64())])


def _added(done: DataFrame, column: str, size: int) -> list[int]:
    """Sums of an array column by position."""
    got = done.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("s"))
    out = [0] * size
    for r in got.collect():
        out[r.i] = int(r.s)
    return out


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of 'seed:id'."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = rows.where(F.col("id").isNotNull()).orderBy(h, "v").limit(k).select("v").collect()
    return np.array([r.v for r in got], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", dim: int = 64, scale: int = 1024,
            k: int = 8, rounds: int = 10, seed: int = 3, bits: int = 4, log: list | None = None) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes
    part. ``log`` gets the number of full vectors that each round read."""
    if bits not in (1, 2, 4, 8) or not 0 < k < NONE:
        raise ValueError("bits are 1, 2, 4 or 8, and centroids fewer than 65,535")
    spark = df.sparkSession
    rows = scaled(df, id_col, vec, dim, scale)
    centroids = starts(rows, k, seed)
    schema = "id bigint, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame([], schema + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    k = len(centroids)
    cuts, ends = cell_edges(rows, dim, bits)
    folder = scratch(spark, "cells")
    blocks = build(rows, folder, dim, cuts, bits)
    label = F.unhex(F.repeat(F.lit(f"{NONE:04X}"), F.col("n")))
    blocks = blocks.withColumn("label", label)
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    for turn in range(rounds + 1):
        done = assign(blocks, folder, ends, centroids, bits)
        blocks = done.select("file", "at", "n", "label")
        if log is not None:
            log.append(done.agg(F.sum("fetched")).first()[0])
        if turn == rounds:
            break
        moved, counts = _added(done, "sums", k * dim), [a + b for a, b in zip(counts, _added(done, "counts", k))]
        sums = [[a + b for a, b in zip(s, moved[c * dim:(c + 1) * dim])] for c, s in enumerate(sums)]
        new = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids.tolist())], np.int64)
        if (new == centroids).all():        # every further round would be the same
            break
        centroids = new
    width = -(-dim // (8 // bits))

    def last(batches):
        for r, block in _each(folder, batches, dim, width):
            c = np.frombuffer(r["label"], "<u2").astype(np.int32)
            d = np.square(block.vectors() - centroids[c]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids(), pa.int64()), pa.array(c), pa.array(d)], ["id", "cluster", "distance"])

    got = stored(dealt(blocks).mapInArrow(last, schema), "clusters")
    inertia = {r.cluster: int(r.s) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    facts = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, m)).encode()).hexdigest())
         for c, m in enumerate(centroids.tolist())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return got.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
