"""Best-fit packing of token sequences under several capacities.

A document's token ids (closed by an end id) are cut into pieces of at most one sequence. Pieces
are packed in groups of bounded size: in order of falling length, each goes to the open bin that
fits it best in all of residual tokens, residual documents and residual attention cost (the sum
of squared lengths): the smallest weighted norm of what stays free, or the largest weighted dot
product of need and free room. A group wastes at most about one sequence, whatever its size.

With ``order``, groups are consecutive ranges of the rows' order, of ``GROUP_SEQUENCES`` sequences'
tokens each; sequences are numbered by the mean place of their tokens, and pieces lie in them in
order. So what holds for ranges of the rows holds for ranges of sequences.

Texts are read once; only piece rows (no ids) are shuffled.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; ties go
to the first bin; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import running, stored, text_of
from quarry.llm.encoder import encoder

GROUP_PIECES = 20_000
GROUP_SEQUENCES = 128       # of ordered rows: half a million tokens, some 33 blocks of the mixture


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
           limit: int = 4096, end_id: int = 1, keep: list[str] | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32 and the ``keep`` columns of each piece of each row."""
    keep = keep or []
    src = df.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text"),
                    *[F.col(f"`{k}`") for k in keep])
    end = np.asarray([end_id], "<u4").tobytes()

    def make(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column("text")):
                ids = enc.text(t.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *[batch.column(k).take(at) for k in keep]],
                ["id", "piece", "start", "length", "ids_crc32", *keep])

    kind = src.schema["id"].dataType.simpleString()
    more = "".join(f", `{k}` {src.schema[k].dataType.simpleString()}" for k in keep)
    return src.mapInArrow(make, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def best_fit(length: np.ndarray, caps: tuple[float, float, float], weights: tuple[float, float, float],
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; every bin keeps within all capacities."""
    cap, w = np.asarray(caps, float), np.asarray(weights, float)
    need = np.column_stack([length, np.ones(len(length)), np.square(length, dtype=float)])
    if len(need) and (need > cap).any():
        raise ValueError("a piece is larger than an empty bin")
    order = np.argsort(-length, kind="stable")
    free = np.empty((max(len(length), 1), 3))       # of open bins, in the order they opened
    number = np.empty(max(len(length), 1), np.int64)
    used, opened = 0, 0
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i in order:
        left = free[:used] - need[i]
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            rest = left[fits] / cap
            if rule == "norm":
                at = fits[np.argmin(np.square(rest) @ w)]
            else:
                at = fits[np.argmax((free[fits] / cap) @ (w * need[i] / cap))]
        else:
            at, free[used], number[used] = used, cap, opened
            used, opened = used + 1, opened + 1
        bins[i], offset[i] = number[at], cap[0] - free[at, 0]
        free[at] -= need[i]
        if (free[at, :2] < 1).any():                # nothing fits any more
            free[at:used - 1], number[at:used - 1] = free[at + 1:used].copy(), number[at + 1:used].copy()
            used -= 1
    return bins, offset


def _places(rows: DataFrame, slot: str, row: str) -> DataFrame:
    """Add _at, the tokens before each piece in the order of slot, row, id and piece."""
    inside = Window.partitionBy(slot).orderBy(row, "id", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = rows.groupBy(slot).agg(F.sum("length").alias("_sum"))
    per = running(per, [], slot, "_sum", "_ahead").drop("_sum")
    return rows.withColumn("_at", F.sum("length").over(inside) - F.col("length")).join(per, slot) \
        .withColumn("_at", F.col("_at") + F.col("_ahead")).drop("_ahead")


def pack(rows: DataFrame, limit: int = 4096, max_docs: int | None = None, max_attention: float | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
         order: tuple[str, str] | None = None) -> DataFrame:
    """Add sequence_id and offset to piece rows (``pieces``). ``order`` names two columns, a slot (a
    whole number) and a place in it, whose order the sequences follow; the result has neither."""
    rows = stored(rows, "pieces")
    caps = (float(limit), float(max_docs or limit), float(max_attention or limit * limit))
    keep = [f for f in rows.schema if f.name not in (order or ())]
    if order:
        dealt = _places(rows, *order).withColumn("g", F.floor(F.col("_at") / (limit * GROUP_SEQUENCES))).drop(*order)
    else:
        groups = max(1, rows.count() // GROUP_PIECES)
        # The stored rows' numbers spread them evenly, whatever their ids are.
        dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    by = ["_at"] if order else ["id", "piece"]

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(by, kind="stable", ignore_index=True)
        length = part["length"].to_numpy()
        b, at = best_fit(length, caps, weights, rule)
        if order:
            place = (part["_at"].to_numpy() - part["_at"].iloc[0] + length / 2) * length
            mean = np.bincount(b, place) / np.bincount(b, length)
            rank = np.empty(len(mean), np.int64)
            rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
            b = rank[b]
            at = pd.Series(length).groupby(b).cumsum().to_numpy() - length
        part["sequence_id"] = (int(key[0]) << 32) + b
        part["offset"] = at
        return part[[f.name for f in keep] + ["sequence_id", "offset"]]

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in keep)}, sequence_id bigint, offset bigint"
    return dealt.groupBy("g").applyInPandas(fill, schema)
