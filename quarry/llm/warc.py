"""WARC archives with an externally merged index.

Pages are written as gzip-per-record WARC files, one for each partition, into a shared folder.
Each file yields a run of index entries sorted by URL key and timestamp. The runs are dealt to
ranges of (key, time, id), so that even one hot URL splits, and within a range a loser tree
merges them: (part, pos) is the global order of all capture histories. Records are then read
back at the offsets of the merged index.

A payload that others share is written once, as the response of the smallest id; the others are
revisits that refer to it. Who refers to whom is found on (id, digest) rows alone.

Records have the fields that the standard demands of their type: record ids made of file and
place, dates, target URIs, the HTTP head before a payload (a revisit has the head alone) and a
revisit's profile. Page ids are in fields of their own.

Files are written under another name and moved when whole, and a repeated task writes the same
file again, so lost executors do no harm.

Defined cases: a null html is an empty payload; null URLs sort first; null ids refer to the
smallest id of their payload; repeated rows are a record each; an empty table gives an empty
result; further columns are ignored. A page without a URL has the target ``urn:page:`` and its id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import time
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fs_path, scratch, stored

ENTRY = "file string, offset bigint, length bigint, url_key string, ts bigint, id bigint"
RANGE_ROWS = 50_000
# Fixed value: the standard's name of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"       # page ids, in fields of their own


def url_key(url: str | None) -> str:
    """Host labels from the right, then port, path and query, in lower case, without fragment."""
    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3].lower() or "/")


class LoserTree:
    """Smallest head of k sorted iterators; each step replays one path from leaf to root."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)           # losers; tree[0] is the winner
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0:                            # the other side has not come yet
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i], i
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def _record(kind: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(body)))])
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + body + b"\r\n\r\n", 4, mtime=0)


def _date(ts: int) -> str:
    """Seconds since 1970 as the standard writes times; others than of the years 1970 to 9999 are cut to them."""
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(min(max(ts, 0), 253_402_300_799)))


def _record_id(*what) -> str:
    """The same for the same record however often its task runs."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, what)))}>"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[:int(headers["Content-Length"])]


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def assign(pages: DataFrame, id_col: str, html: str, min_bytes: int) -> DataFrame:
    """id, sha, refers: the smallest id with the same payload, if that is another one."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    ids = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.sha1(body.cast("binary")).alias("sha"),
                       F.octet_length(body).alias("size"))
    ids = stored(ids, "digests")
    first = ids.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("c")) \
        .where(F.col("c") > 1).drop("c")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return ids.join(first, "sha").where(other).select("id", "sha", F.col("first").alias("refers")).distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html",
          ts: Column | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives into ``folder`` and return their index entries: a sorted run per file."""
    ts = F.lit(0) if ts is None else ts
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url}`").alias("url"),
                        body.cast("binary").alias("body"), ts.cast("bigint").alias("ts"),
                        F.sha1(body.cast("binary")).alias("sha"))
    again = assign(pages, id_col, html, min_bytes).withColumnRenamed("id", "_id").withColumnRenamed("sha", "_sha")
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left") \
        .select("id", "url", "ts", "sha", F.octet_length("body").alias("size"), "refers",
                F.when(F.col("refers").isNull(), F.col("body")).alias("body"))

    def save(batches):
        fs, path = fs_path(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        part = f"{path}/.{name}.{task.taskAttemptId()}"
        entries, out, at = [], None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(part)
                    info = _record("warcinfo", [
                        ("WARC-Record-ID", _record_id(folder, name)), ("WARC-Date", _date(r["ts"] or 0)), ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                date = r["ts"] or 0
                heads = [("WARC-Record-ID", _record_id(folder, name, at)), ("WARC-Date", _date(date)),
                         ("WARC-Target-URI", _clean(r["url"]) or f"urn:page:{r['id']}"),
                         ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["sha"])).decode()),
                         ("Content-Type", "application/http; msgtype=response"), (PAGE, "" if r["id"] is None else str(r["id"]))]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
                if r["body"] is None:
                    data = _record("revisit", [*heads, ("WARC-Profile", PROFILE), (REFERS, str(r["refers"]))], http)
                else:
                    data = _record("response", heads, http + r["body"])
                out.write(data)
                entries.append((url_key(r["url"]), date, r["id"], name, at, len(data)))
                at += len(data)
        if out is None:
            return
        out.close()
        fs.move(part, f"{path}/{name}")
        entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[4]))
        for a in range(0, len(entries), 10_000):
            k, t, i, f, o, n = zip(*entries[a:a + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(f), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(k), pa.array(t, pa.int64()),
                 pa.array(i, pa.int64())], ["file", "offset", "length", "url_key", "ts", "id"])

    return stored(rows.mapInArrow(save, ENTRY), "runs")


def merge(runs: DataFrame) -> DataFrame:
    """The entries with part and pos: ordered by them, all captures by URL key, time and id."""
    n = max(1, runs.count() // RANGE_ROWS + 1)
    dealt = runs.repartitionByRange(n, "url_key", "ts", "id", "file", "offset") \
        .sortWithinPartitions("file", "url_key", "ts", F.asc_nulls_first("id"), "offset")

    def work(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (
            "url_key", "ts", "id", "file", "offset", "length")))]
        key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4])
        slices = [[(key(r), r) for r in g] for _, g in itertools.groupby(rows, key=lambda r: r[3])]
        part = TaskContext.get().partitionId()
        got = [head[1] for head, _ in LoserTree(slices)]
        if got:
            k, t, i, f, o, m = zip(*got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f), pa.array(o, pa.int64()), pa.array(m, pa.int64()), pa.array(k), pa.array(t, pa.int64()),
                 pa.array(i, pa.int64()), pa.array([part] * len(got), pa.int32()), pa.array(range(len(got)), pa.int64())],
                ["file", "offset", "length", "url_key", "ts", "id", "part", "pos"])

    return dealt.mapInArrow(work, ENTRY + ", part int, pos bigint")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the merged index names; payload sizes and digests are of what was read."""
    def load(batches):
        fs, path = fs_path(folder)
        name, file = None, None
        for b in batches:
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for f, o, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(f"{path}/{f}")
                head, body = parse(file.read_at(n, o))
                num = lambda k: int(head[k]) if head.get(k) else None
                kind = head["WARC-Type"]
                digest = head["WARC-Payload-Digest"][5:]
                http, _, body = body.partition(b"\r\n\r\n")
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                out["page_id"].append(num(PAGE))
                out["payload_bytes"].append(len(body) if kind == "response" else int(http.rpartition(b" ")[2]))
                out["payload_digest"].append(digest)
                out["record_type"].append(kind)
                out["refers_to"].append(num(REFERS))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), types)] + [b.column(c) for c in ("url_key", "ts", "part", "pos")],
                [*out, "url_key", "ts", "part", "pos"])
        if file is not None:
            file.close()

    rows = index.repartition("file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(load, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                 "refers_to bigint, url_key string, ts bigint, part int, pos bigint")


def round_trip(pages: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write, merge the index, and read back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    index = stored(merge(write(pages, folder, **kw)), "index")
    return read(index, folder)
