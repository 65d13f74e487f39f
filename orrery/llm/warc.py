"""WARC archives: written in parallel, read back by stream, indexed by an external merge.

- ``write``: every task writes one archive of gzip members into the shared folder. Equal payloads
  (by SHA-1 and length) are stored once: the smallest id is a *response*, the others *revisit* it.
  What the tasks wrote is listed in a checkpointed manifest; files of failed attempts are not in it.
- ``read``: archives are streamed member by member, one record in memory at a time.
- ``histories``: an external merge. Every task sorts the captures it read by URL key, time and id and
  writes them as a run into the shared folder. Ranges with common bounds, drawn from a sample of the
  runs, are merged each by its own task: a loser tree over all runs, which streams a few rows of each
  at a time. The captures of all archives are in one global order then: the history of each URL key,
  however many it has. Bounds are whole sort keys, so one URL may take many ranges.

Defined results: a null payload is empty; a null URL is written as ``urn:none`` and has an empty
key; a null id comes after all others among equal payloads; repeated rows with the smallest id are
each a response; an empty table gives an empty manifest. Ids are whole numbers. Further columns of
the pages are not read; of records a column ``url_key`` is replaced and others are kept.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orrery.session import cut, fresh_path

MIN_BYTES = 0
EPOCH = 1_700_000_000  # captures without a time are dated by their id from here, in seconds
RECORD = ("target string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
          "id long, verified boolean, archive string")
RANGE_ROWS = 1_000_000  # records a merge task is meant to have
MAX_TASKS = 4096  # tasks that read archives, and with it runs that a merge meets
SAMPLES = 100  # rows drawn per bound; they set how even the ranges are, not what is in them
RUN_BLOCK, RUN_BATCH = 1 << 20, 1000  # bytes of a row group of a run, rows that a merge holds of each run


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the path: neighbours in a site sort together."""
    found = re.search(r"://([^/?#]*)([^#]*)", url or "")
    if not found:
        return ""
    host = found[1].lower().rsplit("@", 1)[-1].split(":")[0]
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/").lower()


def _open(folder: str):
    """The file system and path of a folder given with or without a scheme."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def plan_revisits(pages: DataFrame, id_column: str, payload_column: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, refers_to) of the rows whose payload an earlier id has; payloads meet as digests only."""
    payload = F.coalesce(F.encode(payload_column, "UTF-8"), F.lit(b""))
    keys = pages.select(F.col(id_column).alias("id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("bytes"))
    keys = keys.filter(F.col("bytes") >= min_bytes)
    # from a checkpoint, so that a very frequent payload can be split in the join
    first = cut(keys.groupBy("sha1", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = keys.join(first, ["sha1", "bytes"]).filter("first is not null and (id is null or id > first)")
    return later.select(F.col("id").alias("_id"), F.col("first").alias("_refers_to"), F.col("sha1").alias("_sha1")).distinct()


def write(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
          folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all rows; (archive, records) of every file that counts, checkpointed."""
    spark = pages.sparkSession
    target = folder or fresh_path(spark, "warc")
    revisits = plan_revisits(pages, id_column, payload_column, min_bytes)
    held = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(payload_column).alias("payload"))
    sha1 = F.sha1(F.coalesce(F.encode("payload", "UTF-8"), F.lit(b"")))
    rows = held.join(revisits, held["id"].eqNullSafe(revisits["_id"]) & (sha1 == revisits["_sha1"]), "left").select(
        "id", "url", "payload", "_refers_to")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(target)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for key, url, payload, first in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                out.write(gzip.compress(_record(key, url, (payload or "").encode(), first), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            path = f"{target.rstrip('/')}/{name.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

    return cut(rows.mapInArrow(store, "archive string, records long"))


def _record(key, url: str | None, payload: bytes, first) -> bytes:
    revisit = first is not None
    digest = digest_of(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    date = np.datetime_as_string(np.datetime64(EPOCH + (key or 0) % 10**9, "s")) + "Z"
    target = re.sub(r"[\r\n]", "%0A", url) if url is not None else "urn:none"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}",
        f"WARC-Record-ID: <urn:capture:{'' if key is None else key}>", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:capture:{first}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of each record of an open archive."""
    with gzip.GzipFile(fileobj=stream) as members:
        while line := members.readline():
            if not line.strip():
                continue
            headers = {}
            while (line := members.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name] = value.strip()
            block = members.read(int(headers["Content-Length"]))
            head, _, payload = block.partition(b"\r\n\r\n")
            yield headers, head, payload


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives; ``verified`` compares a response with its digest."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("target", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("id", pa.int64()), ("verified", pa.bool_()),
                            ("archive", pa.string())])
        rows = []
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _open(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    for headers, head, payload in records_of(stream):
                        number = re.findall(rb"Content-Length: (\d+)", head)
                        digest = headers["WARC-Payload-Digest"].partition(":")[2]
                        own, first = (_number(headers.get(n)) for n in ("WARC-Record-ID", "WARC-Refers-To"))
                        full = headers["WARC-Type"] == "response"
                        rows.append((headers["WARC-Target-URI"], headers["WARC-Date"], headers["WARC-Type"], digest, int(number[0]),
                                     first, own, not full or digest_of(payload) == digest, archive))
                        if len(rows) == 1000:
                            yield _batch(rows, schema)
                            rows = []
        if rows:
            yield _batch(rows, schema)

    # a given number, as the few bytes of the list would be put into one task
    spread = manifest.select("archive").repartition(max(min(manifest.count(), MAX_TASKS), 1))
    return spread.mapInArrow(scan, RECORD)


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:capture:").removesuffix(">")
    return int(digits) if digits else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def merge_runs(runs: list) -> Iterator:
    """Sorted runs as one sorted stream: a tree of losers, one comparison per level and item."""
    k = len(runs)
    if not k:
        return
    ended = object()
    streams = [iter(run) for run in runs]
    heads = [next(stream, ended) for stream in streams]

    def before(a: int, b: int) -> bool:
        if heads[a] is ended or heads[b] is ended:
            return heads[b] is ended and (heads[a] is not ended or a < b)
        return (heads[a], a) < (heads[b], b)

    # node i has children 2i and 2i+1; leaves are k..2k-1; each inner node keeps the loser of its match
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads[best] is not ended:
        yield heads[best]
        heads[best] = next(streams[best], ended)
        node = (best + k) // 2
        while node:
            if before(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def _place(key: str, date: str, own: int | None) -> tuple:
    """Sort key of a capture; null ids last."""
    return key, date, own is None, own or 0


def _slice(path: str, system: fs.FileSystem, number: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """(key, run, row, batch, row of the batch) of a run's captures from ``low`` up to ``high`` (left out)."""
    with system.open_input_file(path) as stream:
        held = pq.ParquetFile(stream)
        at, groups = held.schema_arrow.names.index("url_key"), []
        for group in range(held.metadata.num_row_groups):
            bounds = held.metadata.row_group(group).column(at).statistics
            known = bounds is not None and bounds.has_min_max
            if known and (low is not None and bounds.max < low[0] or high is not None and bounds.min > high[0]):
                continue
            groups.append(group)
        row = 0
        for batch in held.iter_batches(RUN_BATCH, row_groups=groups, use_threads=False):
            keys = list(map(_place, *(batch.column(name).to_pylist() for name in ("url_key", "date", "id"))))
            first = bisect_left(keys, low) if low is not None else 0
            last = bisect_left(keys, high) if high is not None else len(keys)
            for i in range(first, last):
                yield keys[i], number, row + i, batch, i
            if last < len(keys):
                return
            row += len(keys)


def _taken(merged: list[tuple]) -> Iterator[pa.RecordBatch]:
    batches, starts, total, places = [], {}, 0, []
    for *_, batch, row in merged:
        if id(batch) not in starts:
            starts[id(batch)] = total
            batches.append(batch)
            total += batch.num_rows
        places.append(starts[id(batch)] + row)
    if places:
        yield from pa.Table.from_batches(batches).take(pa.array(places, pa.int64())).combine_chunks().to_batches()


def write_runs(records: DataFrame) -> str:
    """Writes the records with ``url_key`` as sorted runs, one per task; their folder."""
    records = records.drop("url_key")
    names = records.columns

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("target")
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([url_key(u) for u in batch.column(at).to_pylist()], pa.string())], [*names, "url_key"])

    keyed = records.mapInArrow(key, StructType([*records.schema.fields, StructField("url_key", StringType())]))
    folder = fresh_path(records.sparkSession, "runs")
    keyed.sortWithinPartitions("url_key", "date", F.col("id").asc_nulls_last()).write.option("parquet.block.size", RUN_BLOCK).parquet(folder)
    return folder


def histories(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """The records with ``url_key``, in the global order of URL key, date and id (null ids last).

    Partitions are the ranges in order. Without ``partitions`` there is a task per core at least.
    """
    spark = records.sparkSession
    folder = write_runs(records)
    runs = spark.read.parquet(folder)
    rows = runs.count()
    ranges = partitions or max(spark.sparkContext.defaultParallelism, math.ceil(rows / RANGE_ROWS))
    # a sample of about SAMPLES rows per range
    drawn = runs.select("url_key", "date", "id").sample(min(1.0, ranges * SAMPLES / max(rows, 1)), seed=1).collect()
    drawn = sorted(_place(*row) for row in drawn)
    bounds = [None, *(drawn[len(drawn) * i // ranges] if drawn else None for i in range(1, ranges)), None]
    system, base = _open(folder)
    files = sorted(info.path for info in system.get_file_info(fs.FileSelector(base)) if info.path.endswith(".parquet"))
    shared = spark.sparkContext.broadcast((folder, files, bounds))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, files, bounds = shared.value
        system, _ = _open(folder)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                low, high = bounds[at], bounds[at + 1]
                if at and low is None:
                    continue
                merged = []
                for item in merge_runs([_slice(path, system, number, low, high) for number, path in enumerate(files)]):
                    merged.append(item)
                    if len(merged) == 5 * RUN_BATCH:
                        yield from _taken(merged)
                        merged = []
                yield from _taken(merged)

    return spark.range(0, ranges, 1, ranges).mapInArrow(merge, runs.schema)
