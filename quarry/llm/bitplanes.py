"""Token-id files of bit-plane shuffled chunks.

Documents are laid out in ascending order of their id over numbered files: Spark range-partitions
and sorts the rows, and each task encodes its texts and writes one file. A file is a row of
chunks of ``block`` ids. A chunk's ids are transposed into byte planes (all lowest bytes, then
all second bytes, ...) or bit planes, and each plane is a Zstandard frame of its own; a plane of
zeros takes no space. Behind the ids of a chunk come the planes of the lengths and ids of the
documents that start in it. The file's end is the chunk index (places, counts and plane lengths),
so that any chunk is read with one seek. All numbers are little-endian:

    magic | chunk | chunk | ... | index (Zstandard) | index offset, index bytes, block, planes | magic

Reading takes the files of a folder, their indexes alone give every file's first place in the
whole sequence (a prefix scan in two levels over one row per file), and runs of chunks are then
read in parallel. A run holds the documents that start in it; the last one may be read on into
further chunks. Memory is one chunk and the document at hand.

Files are written under another name and moved when whole, and a repeated task writes the same
file again, so lost executors do no harm.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with the same
id (or none) keep the table's order and spread over files as other rows do; an empty table gives
an empty result; ids are integers of up to 64 bits; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import dealt, fs_path, small, stored, text_of
from quarry.llm.encoder import encoder

MAGIC = b"idplane1"
TAIL = struct.Struct("<QQIB")       # index offset, index bytes, block, planes of one id
BLOCK = 65_536                      # ids of a chunk
RUN = 16                            # chunks that one reader row covers
LEVEL = 3                           # of Zstandard
GROUP_FILES = 1024                  # files whose places one task sums
FACTS = 5                           # of a chunk: ids, first id, documents, place of the first one, offset


def planes_of(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte (or bit) planes of unsigned integers, lowest first; empty for a plane of zeros."""
    width = values.dtype.itemsize
    whole = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    out = []
    for plane in whole:
        if not plane.any():
            out += [b""] * (8 if bits else 1)
        elif not bits:
            out.append(plane.tobytes())
        else:
            apart = np.unpackbits(np.ascontiguousarray(plane)[:, None], axis=1, bitorder="little")
            out += [p.tobytes() if p.any() else b"" for p in np.packbits(apart.T, axis=1)]
    return out


def values_of(planes: list[bytes], n: int, dtype: str, bits: bool = False) -> np.ndarray:
    """The inverse of ``planes_of`` for ``n`` values."""
    width = np.dtype(dtype).itemsize
    whole = np.zeros((n, width), np.uint8)
    for k in range(width):
        if not bits:
            if planes[k]:
                whole[:, k] = np.frombuffer(planes[k], np.uint8)
        elif any(planes[8 * k:8 * k + 8]):
            apart = np.zeros((8, n), np.uint8)
            for b, p in enumerate(planes[8 * k:8 * k + 8]):
                if p:
                    apart[b] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
            whole[:, k] = np.packbits(apart.T, axis=1, bitorder="little")[:, 0]
    return whole.view(dtype)[:, 0]


class ChunkWriter:
    """Writes documents, one after another, into an open file."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = LEVEL):
        import zstandard
        self.out, self.block, self.bits = out, block, bits
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.parts, self.held, self.docs, self.index = [], 0, [], []
        self.first = self.begin = 0
        self.at = out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        """A document of 32-bit ids."""
        if not self.docs:
            self.begin = self.first + self.held // 4
        self.docs.append((doc, len(ids) // 4))
        size, at = 4 * self.block, 0
        while len(ids) - at >= size - self.held:
            part = ids[at:at + size - self.held]
            at += len(part)
            self.parts.append(part)
            self.held = size
            self._flush()
        if at < len(ids):
            self.parts.append(ids[at:] if at else ids)
            self.held += len(ids) - at

    def _flush(self) -> None:
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        who = [d for d, _ in self.docs]
        none = np.array([d is None for d in who], "u1")
        frames = [self.pack(p) if p else b"" for p in (
            *planes_of(ids, self.bits), *planes_of(np.array([n for _, n in self.docs], "<u8")),
            *planes_of(np.array([d or 0 for d in who], "<i8")), *planes_of(none))]
        self.index.append([len(ids), self.first, len(who), self.begin, self.at, *map(len, frames)])
        self.at += self.out.write(b"".join(frames))
        self.first += len(ids)
        self.parts, self.held, self.docs = [], 0, []

    def close(self) -> None:
        if self.held or self.docs:
            self._flush()
        index = self.pack(np.array(self.index, "<i8").tobytes())
        end = index + TAIL.pack(self.at, len(index), self.block, 32 if self.bits else 4) + MAGIC
        self.size = self.at + self.out.write(end)
        self.out.close()


class ChunkReader:
    """Chunks of an open file of known length."""

    def __init__(self, file, length: int):
        import zstandard
        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        end = file.read_at(TAIL.size + len(MAGIC), length - TAIL.size - len(MAGIC))
        if end[TAIL.size:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of id planes, or cut off")
        at, size, self.block, self.planes = TAIL.unpack(end[:TAIL.size])
        self.index = np.frombuffer(self.unpack(file.read_at(size, at)), "<i8").reshape(-1, FACTS + self.planes + 17)
        self.chunks = len(self.index)
        self.n_ids = int(self.index[:, 0].sum())
        self.at, self.held = -1, None       # the chunk at hand

    def _frames(self, k: int, lo: int, hi: int) -> list[bytes]:
        sizes = self.index[k, FACTS:].tolist()
        at = int(self.index[k, 4]) + sum(sizes[:lo])
        data, out = self.file.read_at(sum(sizes[lo:hi]), at), []
        place = 0
        for n in sizes[lo:hi]:
            out.append(self.unpack(data[place:place + n]) if n else b"")
            place += n
        return out

    def ids(self, k: int) -> np.ndarray:
        return values_of(self._frames(k, 0, self.planes), int(self.index[k, 0]), "<u4", self.planes == 32)

    def documents(self, k: int) -> tuple[list, list[int]]:
        """Ids and lengths of the documents that start in chunk ``k``."""
        n, f = int(self.index[k, 2]), self._frames(k, self.planes, self.planes + 17)
        none = values_of(f[16:], n, "u1")
        who = values_of(f[8:16], n, "<i8").tolist()
        return [None if x else d for d, x in zip(who, none)], values_of(f[:8], n, "<u8").tolist()

    def read(self, lo: int, hi: int):
        """(document id, first place in the file, slices of its 32-bit ids) of the documents that
        start in chunks ``lo`` to ``hi - 1``; each document's slices are read as they are taken."""
        for k in range(lo, min(hi, self.chunks)):
            if not self.index[k, 2]:
                continue
            who, lengths = self.documents(k)
            place = int(self.index[k, 3])
            for doc, n in zip(who, lengths):
                yield doc, place, self._slices(place, n)
                place += n

    def _slices(self, place: int, n: int):
        while n:
            c = place // self.block
            if c != self.at:
                self.at, self.held = c, self.ids(c)
            part = self.held[place - c * self.block:][:n]
            if not len(part):
                raise ValueError("the file's index and its chunks disagree")
            yield part
            place, n = place + len(part), n - len(part)


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text",
          bits: bool = False, block: int = BLOCK) -> DataFrame:
    """Write the files into ``folder``, a new one; return file, documents, ids and bytes of each."""
    fs, path = fs_path(folder)
    fs.create_dir(path, recursive=True)
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(f"`{text}`").alias("text"))
    # Rows of one id are told apart by their number, so that a hot id falls into several ranges.
    rows = src.withColumn("n", F.monotonically_increasing_id())
    keys = F.asc_nulls_first("id"), F.asc("n")
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    end = struct.pack("<I", end_id)

    def make(batches):
        enc, out, name, part = encoder(tokenizer), None, "", ""
        task = TaskContext.get()
        docs = ids = 0
        for b in batches:
            for doc, t in zip(b.column("id").to_pylist(), b.column("text")):
                if out is None:
                    fs, path = fs_path(folder)
                    name = f"ids-{task.partitionId():07d}.planes"
                    part = f"{path}/.{name}.{task.taskAttemptId()}"
                    out = ChunkWriter(fs.open_output_stream(part), block, bits)
                data = enc.text(t.as_py()) + end
                docs, ids = docs + 1, ids + len(data) // 4
                out.add(doc, data)
        if out is not None:
            out.close()
            fs.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "documents": [docs], "ids": [ids], "bytes": [out.size]})

    return stored(rows.mapInArrow(make, "file string, documents bigint, ids bigint, bytes bigint"), "planes")


def _open(fs, path: str, name: str, length: int):
    file = fs.open_input_file(f"{path}/{name}")
    return file, ChunkReader(file, length)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """name, part, length, chunks, ids of each file in the folder, and the place of its first id."""
    listed = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary") \
        .format("binaryFile").option("pathGlobFilter", "ids-*.planes").load(folder).select("path", "length")
    pattern = r"ids-(\d+)\.planes$"
    listed = listed.select(F.regexp_extract("path", pattern, 0).alias("name"),
                           F.regexp_extract("path", pattern, 1).cast("bigint").alias("part"), "length")

    def look(batches):
        fs, path = fs_path(folder)
        for b in batches:
            chunks, ids = [], []
            for name, length in zip(b.column("name").to_pylist(), b.column("length").to_pylist()):
                file, got = _open(fs, path, name, length)
                with file:
                    chunks.append(got.chunks)
                    ids.append(got.n_ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.int64()), pa.array(ids, pa.int64())],
                                             ["name", "part", "length", "chunks", "ids"])

    files = stored(listed.mapInArrow(look, "name string, part bigint, length bigint, chunks bigint, ids bigint"), "files") \
        .withColumn("group", F.floor(F.col("part") / GROUP_FILES))
    sums = files.groupBy("group").agg(F.sum("ids").alias("sum"))
    sums = sums.select("group", (F.sum("sum").over(Window.orderBy("group")) - F.col("sum")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("group").orderBy("part")) - F.col("ids")
    return files.withColumn("inside", inside).join(small(sums), "group") \
        .withColumn("first", F.col("before") + F.col("inside")).drop("group", "before", "inside")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """id, start, n_tokens, ids_crc32, file, chunk run and, if asked for, the ids of every document."""
    runs = dealt(files_of(spark, folder).where("chunks > 0")
                 .withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / RUN)))))
    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string, run bigint" + ", ids array<bigint>" * with_ids

    def load(batches):
        fs, path = fs_path(folder)
        for b in batches:
            for name, length, first, run in zip(*(b.column(c).to_pylist() for c in ("name", "length", "first", "run"))):
                file, got = _open(fs, path, name, length)
                with file:
                    rows = {k: [] for k in ("id", "start", "n_tokens", "ids_crc32", "ids")}
                    held = 0

                    def batch():
                        n = len(rows["id"])
                        cols = {k: pa.array(v, pa.int64()) for k, v in rows.items() if k != "ids"}
                        cols |= {"file": pa.array([name] * n), "run": pa.array([run] * n, pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.array(rows["ids"], pa.list_(pa.int64()))
                        return pa.RecordBatch.from_pydict(cols)

                    for doc, at, parts in got.read(run * RUN, (run + 1) * RUN):
                        crc = n = 0
                        kept = []
                        for p in parts:
                            crc, n = zlib.crc32(p, crc), n + len(p)
                            if with_ids:
                                kept.append(p)
                        for k, v in zip(rows, (doc, first + at, n, crc, np.concatenate(kept).tolist() if kept else [])):
                            rows[k].append(v)
                        held += n
                        if len(rows["id"]) >= 10_000 or with_ids and held >= 1_000_000:
                            yield batch()
                            rows, held = {k: [] for k in rows}, 0
                    if rows["id"]:
                        yield batch()

    return runs.mapInArrow(load, schema)
