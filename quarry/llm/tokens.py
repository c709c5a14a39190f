"""Token counts of flat token files by a separator scan.

Token files hold 16-bit ids, documents one after another, each closed by a separator id; nothing
says where a document starts. Files of a stream follow each other, and documents run across
them. The scan reads blocks of fixed size in any order, finds the separators of a block at once,
and keeps per block the number of separators, the tokens before the first and after the last,
and the counts in between. A prefix scan over these block rows (without the counts in between, in
two levels) gives each block its first document's number and the tokens carried into it, which
stitches documents across blocks.

Files are written under another name and moved when whole; a repeated task writes the same again.

Defined cases: a null or empty text is a document of no tokens; tokens after the last separator
are a document with ``closed`` false; repeated rows are counted each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import fs_path, stored, text_of
from quarry.llm.encoder import encoder

WIDTH = 2
FILE_TOKENS = 4_000_000
BLOCK_TOKENS = 500_000
RUN_BLOCKS = 1024


def write(df: DataFrame, folder: str, tokenizer: str, separator: int, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Write the token files, a stream per task; return who wrote what: id, stream, ordinal."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text"))

    def make(batches):
        enc = encoder(tokenizer, "<u2", True)
        fs, path = fs_path(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        stream, end = task.partitionId(), separator.to_bytes(WIDTH, "little")
        room, parts, out, ordinal = 0, [], None, 0

        def put(data: bytes):
            nonlocal room, out
            at = 0
            while at < len(data):
                if not room:
                    if out is not None:
                        out.close()
                    name = f"stream-{stream:06d}-{len(parts):06d}.bin"
                    parts.append((f"{path}/.{name}.{task.taskAttemptId()}", f"{path}/{name}"))
                    out, room = fs.open_output_stream(parts[-1][0]), FILE_TOKENS * WIDTH
                out.write(data[at:at + room])
                n = min(room, len(data) - at)
                at, room = at + n, room - n

        for b in batches:
            for t in b.column("text"):
                put(enc.text(t.as_py()) + end)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([stream] * len(b), pa.int32()),
                 pa.array(range(ordinal, ordinal + len(b)), pa.int64())], ["id", "stream", "ordinal"])
            ordinal += len(b)
        if out is not None:
            out.close()
        for a, z in parts:
            fs.move(a, z)

    kind = src.schema["id"].dataType.simpleString()
    return stored(src.mapInArrow(make, f"id {kind}, stream int, ordinal bigint"), "written")


def scan(spark: SparkSession, folder: str, separator: int) -> DataFrame:
    """stream, ordinal, n_tokens, closed of every document in the folder's files."""
    files = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary") \
        .format("binaryFile").option("pathGlobFilter", "stream-*.bin").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"stream-(\d+)-(\d+)\.bin$", 0)
    number = lambda i: F.regexp_extract("path", r"stream-(\d+)-(\d+)\.bin$", i).cast("int")
    size = BLOCK_TOKENS * WIDTH
    blocks = files.select(name.alias("name"), number(1).alias("stream"), number(2).alias("file"), "length",
                          F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / size))).alias("block"))
    blocks = blocks.repartition("name", "block")

    def look(batches):
        fs, path = fs_path(folder)
        for b in batches:
            out = {k: [] for k in ("tokens", "seps", "head", "tail", "between")}
            for f, n, k in zip(*(b.column(c).to_pylist() for c in ("name", "length", "block"))):
                with fs.open_input_file(f"{path}/{f}") as file:
                    ids = np.frombuffer(file.read_at(min(size, n - k * size), k * size), "<u2")
                at = np.flatnonzero(ids == separator)
                out["tokens"].append(len(ids))
                out["seps"].append(len(at))
                out["head"].append(int(at[0]) if len(at) else len(ids))
                out["tail"].append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                out["between"].append((np.diff(at) - 1).tolist())
            cols = [pa.array(out[k], pa.int64()) for k in ("tokens", "seps", "head", "tail")]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("stream", "file", "block")] + cols + [pa.array(out["between"], pa.list_(pa.int64()))],
                ["stream", "file", "block", "tokens", "seps", "head", "tail", "between"])

    got = stored(blocks.mapInArrow(look, "stream int, file int, block bigint, tokens bigint, seps bigint, head bigint, "
                                         "tail bigint, between array<bigint>"), "blocks")
    # In two levels over narrow rows: within runs of a file's blocks, and over one row for each run.
    key = ["stream", "file", "run"]
    w = Window.partitionBy(*key).orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = got.drop("between").withColumn("run", F.floor(F.col("block") / RUN_BLOCKS)) \
        .withColumn("upto", F.sum("tokens").over(w)) \
        .withColumn("last", F.when(F.col("seps") > 0, F.col("upto") - F.col("tail"))) \
        .withColumn("seen", F.coalesce(F.sum("seps").over(before), F.lit(0))) \
        .withColumn("cut", F.max("last").over(before))
    w = Window.partitionBy("stream").orderBy("file", "run")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*key).agg(F.sum("tokens").alias("t"), F.sum("seps").alias("s"), F.max("last").alias("l")) \
        .withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))) \
        .withColumn("seps0", F.coalesce(F.sum("s").over(before), F.lit(0))) \
        .withColumn("cut0", F.max(F.col("base") + F.col("l")).over(before)) \
        .withColumn("whole", F.sum("t").over(Window.partitionBy("stream"))).drop("t", "s", "l")
    # Where the block ends, in tokens from the stream's start, and what runs into it since the last separator.
    rows = rows.join(runs, key).select(
        "stream", "file", "block", (F.col("seps0") + F.col("seen")).alias("first"),
        (F.col("base") + F.col("upto") - F.col("tokens") - F.coalesce(F.col("base") + F.col("cut"), F.col("cut0"), F.lit(0))).alias("carry"),
        (F.col("base") + F.col("upto") == F.col("whole")).alias("final"))
    got = got.join(rows, ["stream", "file", "block"])
    inside = F.when(F.col("seps") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("between"))) \
        .otherwise(F.array().cast("array<bigint>"))
    closed = got.select("stream", "first", F.posexplode(inside).alias("i", "n_tokens")) \
        .select("stream", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    # What follows a stream's last separator.
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tokens"))
    loose = got.where(F.col("final") & (rest > 0) & (F.col("tokens") > 0)) \
        .select("stream", (F.col("first") + F.col("seps")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(loose)
