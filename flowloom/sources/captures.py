"""Capture files and request columns.

Reading is three steps. ``index_captures`` walks the record headers of every file
and cuts it into chunks at record boundaries, without keeping frame bytes.
``read_frames`` then reads the chunks in parallel, so a file with most of the bytes
is spread over many tasks. Header decoding is left to native expressions
(``functions.frames``).

Nothing is lost without a word: a file that can't be walked to its end is an error as a whole, and ``read_captures``
fails on it unless it is told to keep errors as rows.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.frames import header_fields
from flowloom.session import materialize

CHUNK_BYTES = 64 << 20
READ_BUFFER = 4 << 20
BATCH_BYTES = 16 << 20

# File magic numbers, little-endian view, to (byte order, ticks per second).
PCAP_MAGIC = {0xA1B2C3D4: ("<", 10**6), 0xD4C3B2A1: (">", 10**6),
              0xA1B23C4D: ("<", 10**9), 0x4D3CB2A1: (">", 10**9)}
PCAPNG_MAGIC = 0x0A0D0D0A
GZIP_MAGIC = b"\x1f\x8b"
NG_INTERFACE, NG_PACKET, NG_SIMPLE, NG_ENHANCED = 1, 2, 3, 6

INDEX_SCHEMA = ("capture STRING, chunk INT, start BIGINT, stop BIGINT, first_frame BIGINT, "
                "byte_order STRING, ticks BIGINT, link_types ARRAY<INT>, link_ticks ARRAY<BIGINT>, "
                "ng BOOLEAN, error STRING")
FRAME_SCHEMA = "capture STRING, frame_no BIGINT, ts_us BIGINT, link_type INT, frame BINARY"
READ_ERRORS = (OSError, EOFError, struct.error, zlib.error, ValueError)


class CaptureError(ValueError):
    """A capture that breaks its format."""


def open_path(path: str) -> BinaryIO:
    """A seekable stream of a file path or of any URI Arrow knows (file, hdfs, s3, gs); compressed files are
    decompressed on the way."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if path.startswith("file:"):
        path = unquote(urlparse(path).path)
    if "://" not in path:
        f = open(path, "rb")
    else:
        system, name = fs.FileSystem.from_uri(path)
        f = io.BufferedReader(system.open_input_file(name), READ_BUFFER)
    compressed = f.read(2) == GZIP_MAGIC
    f.seek(0)
    return gzip.GzipFile(fileobj=f) if compressed else f


def _classic_records(f: BinaryIO, at: int, stop: int | None, order: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(record start, data start, data length, seconds, ticks) of a classic capture."""
    head = struct.Struct(order + "IIII")
    f.seek(at)
    while stop is None or at < stop:
        raw = f.read(16)
        if len(raw) < 16:
            return
        sec, frac, size, _ = head.unpack(raw)
        yield at, at + 16, size, sec, frac
        at += 16 + size
        f.seek(at)


def _ng_blocks(f: BinaryIO, at: int, stop: int | None, order: str) -> Iterator[tuple[int, int, int, str]]:
    """(block start, type, length, byte order); a section header may switch the order."""
    f.seek(at)
    while stop is None or at < stop:
        raw = f.read(12)
        if len(raw) < 12:
            return
        kind = struct.unpack("<I", raw[:4])[0]
        if kind == PCAPNG_MAGIC:
            order = "<" if raw[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack(order + "II", raw[:8])
        if size < 12 or size % 4:
            raise CaptureError(f"block length {size} at byte {at}")
        yield at, kind, size, order
        at += size
        f.seek(at)


def _ng_interface(f: BinaryIO, at: int, size: int, order: str) -> tuple[int, int]:
    """(link type, ticks per second) of an interface block."""
    f.seek(at + 8)
    body = f.read(size - 12)
    link, ticks, pos = struct.unpack(order + "H", body[:2])[0], 10**6, 8
    while pos + 4 <= len(body):
        code, n = struct.unpack(order + "HH", body[pos:pos + 4])
        if code == 0:
            break
        if code == 9 and n >= 1:
            v = body[pos + 4]
            ticks = 2 ** (v & 0x7F) if v & 0x80 else 10 ** v
        pos += 4 + n + (-n % 4)
    return link, ticks


def _check_frame_block(f: BinaryIO, at: int, kind: int, order: str, interfaces: int) -> None:
    """A frame must name an interface of its section."""
    number = 0
    if kind != NG_SIMPLE:
        f.seek(at + 8)
        raw = f.read(4)
        number = struct.unpack(order + ("I" if kind == NG_ENHANCED else "H"), raw[:4 if kind == NG_ENHANCED else 2])[0]
    if number >= interfaces:
        raise CaptureError(f"frame at byte {at} names interface {number} of {interfaces}")


def index_stream(f: BinaryIO, name: str, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of one capture; constant memory whatever its size."""
    raw = f.read(24)
    magic = struct.unpack("<I", raw[:4])[0] if len(raw) >= 4 else 0
    if magic in PCAP_MAGIC and len(raw) == 24:
        order, ticks = PCAP_MAGIC[magic]
        link = struct.unpack(order + "I", raw[20:24])[0] & 0xFFFF
        base = dict(byte_order=order, ticks=ticks, link_types=[link], link_ticks=[ticks], ng=False)
        steps = ((a, d + n, True, None) for a, d, n, _, _ in _classic_records(f, 24, None, order))
    elif magic == PCAPNG_MAGIC:
        base = dict(byte_order="<", ticks=10**6, link_types=[], link_ticks=[], ng=True)
        steps = ((a, a + n, k in (NG_PACKET, NG_SIMPLE, NG_ENHANCED), (k, n, o)) for a, k, n, o in _ng_blocks(f, 0, None, "<"))
    else:
        yield dict(capture=name, error="not a capture file")
        return
    base["capture"] = name
    chunk, frame, first, start, stop, state = 0, 0, 0, None, None, base
    for at, stop, is_frame, block in steps:
        if start is None:
            start, first, state = at, frame, dict(base)
        if block is not None:
            kind, size, order = block
            if kind == PCAPNG_MAGIC:
                base.update(byte_order=order, link_types=[], link_ticks=[])
            elif kind == NG_INTERFACE:
                link, ticks = _ng_interface(f, at, size, order)
                base.update(link_types=[*base["link_types"], link], link_ticks=[*base["link_ticks"], ticks])
            elif is_frame:
                _check_frame_block(f, at, kind, order, len(base["link_types"]))
        frame += is_frame
        if stop - start >= chunk_bytes:
            yield dict(state, chunk=chunk, start=start, stop=stop, first_frame=first)
            chunk, start = chunk + 1, None
    if start is not None:
        yield dict(state, chunk=chunk, start=start, stop=stop, first_frame=first)


def index_file(path: str, chunk_bytes: int) -> list[dict]:
    """Chunk rows of one file, or a single row with ``error`` if any part of it can't be walked.

    A compressed file is one chunk: its bytes can only be reached from the start.
    """
    try:
        with open_path(path) as f:
            return list(index_stream(f, path, 1 << 62 if isinstance(f, gzip.GzipFile) else chunk_bytes))
    except READ_ERRORS as exc:
        return [dict(capture=path, error=f"{type(exc).__name__}: {exc}")]


def chunk_frames(f: BinaryIO, row: dict) -> Iterator[tuple[int, int, int, bytes]]:
    """(frame number, microseconds, link type, bytes) of one chunk. A cut-off last frame is kept as it is."""
    frame = row["first_frame"]
    if not row["ng"]:
        for _, at, size, sec, frac in _classic_records(f, row["start"], row["stop"], row["byte_order"]):
            f.seek(at)
            yield frame, sec * 10**6 + frac * 10**6 // row["ticks"], row["link_types"][0], f.read(size)
            frame += 1
        return
    links, ticks = list(row["link_types"]), list(row["link_ticks"])
    for at, kind, size, order in _ng_blocks(f, row["start"], row["stop"], row["byte_order"]):
        if kind == PCAPNG_MAGIC:
            links, ticks = [], []
        elif kind == NG_INTERFACE:
            link, tick = _ng_interface(f, at, size, order)
            links.append(link)
            ticks.append(tick)
        elif kind in (NG_ENHANCED, NG_PACKET):
            f.seek(at + 8)
            # The older packet block has a 16-bit interface number and a count of drops in its place.
            iface, high, low, kept, _ = struct.unpack(
                order + ("IIIII" if kind == NG_ENHANCED else "HxxIIII"), f.read(20))
            yield frame, ((high << 32) | low) * 10**6 // ticks[iface], links[iface], f.read(kept)
            frame += 1
        elif kind == NG_SIMPLE:
            f.seek(at + 8)
            length = struct.unpack(order + "I", f.read(4))[0]
            yield frame, 0, links[0], f.read(min(length, size - 16))
            frame += 1


FRAMES = pa.schema([("capture", pa.string()), ("frame_no", pa.int64()), ("ts_us", pa.int64()),
                    ("link_type", pa.int32()), ("frame", pa.binary())])


def _frame_batches(f: BinaryIO, row: dict, batch_rows: int) -> Iterator[pa.RecordBatch]:
    numbers, times, links, frames, held = [], [], [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array([row["capture"]] * len(numbers), pa.string()), pa.array(numbers, pa.int64()),
                   pa.array(times, pa.int64()), pa.array(links, pa.int32()), pa.array(frames, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=FRAMES)

    for number, ts, link, data in chunk_frames(f, row):
        numbers.append(number)
        times.append(ts)
        links.append(link)
        frames.append(data)
        held += len(data)
        if len(numbers) == batch_rows or held >= BATCH_BYTES:
            yield batch()
            numbers, times, links, frames, held = [], [], [], [], 0
    if numbers:
        yield batch()


def index_captures(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of all capture files under ``path``; a bad file gives one row with ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    names = [part.strip().split(" ")[0] for part in INDEX_SCHEMA.split(",")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([[row.get(n) for n in names] for row in rows], columns=names, dtype=object)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                rows = index_file(p, chunk_bytes)
                if rows:
                    yield frame(rows)

    return files.mapInPandas(walk, INDEX_SCHEMA)


# What one task reads: a few chunks of full length, or many small ones with the same bytes on average.
CHUNKS_PER_TASK = 4
TASK_BYTES = CHUNKS_PER_TASK * CHUNK_BYTES
SMALL_BYTES, SMALL_CHUNKS_PER_TASK = 1 << 20, 1024


def _deal(chunks: DataFrame, n: int, tasks: int) -> DataFrame:
    return chunks.repartition(max(tasks, min(n, chunks.sparkSession.sparkContext.defaultParallelism), 1))


def read_frames(index: DataFrame, batch_rows: int = 4096, chunks_per_task: int | None = None) -> DataFrame:
    """Frames of indexed chunks, each chunk on its own wherever it lands. Pass a stored index: it is counted.

    The number of tasks follows the captures' bytes; few chunks get a task each. It is set here because index rows are
    tiny: a partition count left to the runtime would be merged down to one. Chunks are dealt one by one, those below
    ``SMALL_BYTES`` apart from the others: a folder of small files is read by few tasks, and no task gets more than
    ``CHUNKS_PER_TASK`` of the others. ``chunks_per_task`` deals all alike instead.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_path(row["capture"]) as f:
                    yield from _frame_batches(f, row, batch_rows)

    good = index.filter(F.col("error").isNull())
    if chunks_per_task:
        chunks = good.count()
        dealt = _deal(good, chunks, -(-chunks // chunks_per_task))
    else:
        size = F.col("stop") - F.col("start")
        small = size < SMALL_BYTES
        found = good.agg(F.count_if(small).alias("small"), F.count_if(~small).alias("large"),
                         F.coalesce(F.sum(F.when(small, size)), F.lit(0)).alias("small_bytes")).first()
        tasks = max(-(-found["small"] // SMALL_CHUNKS_PER_TASK), -(-found["small_bytes"] // TASK_BYTES))
        dealt = _deal(good.filter(small), found["small"], tasks)
        if found["large"]:
            large = _deal(good.filter(~small), found["large"], -(-found["large"] // CHUNKS_PER_TASK))
            dealt = dealt.unionByName(large) if found["small"] else large
    return dealt.mapInArrow(read, FRAME_SCHEMA)


def capture_errors(index: DataFrame) -> DataFrame:
    """capture, error of the files that can't be read."""
    return index.filter(F.col("error").isNotNull()).select("capture", "error")


def read_captures(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, udp_zero_ok: bool = False,
                  on_error: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Packet rows of all capture files: IPv4 only, in the wire schema plus ``ts_us``.

    ``on_error="fail"`` raises if any file can't be read to its end; ``"keep"`` returns (packets of the good files,
    capture and error of the others).
    """
    index = materialize(index_captures(spark, path, chunk_bytes), "capture-index")
    errors = capture_errors(index)
    if on_error == "fail" and (first := errors.first()) is not None:
        raise CaptureError(f"{first['capture']}: {first['error']}")
    packets = header_fields(read_frames(index), udp_zero_ok).withColumnRenamed("frame_no", "arrival")
    return (packets, errors) if on_error == "keep" else packets


# --- captures inside a request column ------------------------------------------------

# Fixed value: strict base64 text.
BASE64_TEXT = "\\A[A-Za-z0-9+/]*={0,2}\\z"


def strict_base64(text: Column) -> Column:
    """Decoded bytes, null for anything but whole strict base64."""
    ok = text.rlike(BASE64_TEXT) & (F.length(text) % 4 == 0)
    return F.when(ok, F.try_to_binary(text, F.lit("base64")))


def decode_captures(requests: DataFrame, raw: str | None = None, text: str | None = None,
                    fields: str | None = None) -> DataFrame:
    """Add ``content`` and ``error``. Raw bytes win over a base64 text, that over a map's
    ``pcap_base64`` or ``pcap`` entry; anything else is an error value."""
    options = []
    if raw:
        options.append(F.col(raw))
    if text:
        options.append(strict_base64(F.col(text)))
    if fields:
        entry = [F.try_element_at(F.col(fields), F.lit(k)) for k in ("pcap_base64", "pcap")]
        kind = requests.schema[fields].dataType.valueType.simpleString()
        options.append(F.coalesce(*[F.when(F.length(e) > 0, e) for e in entry])
                       if kind == "binary" else strict_base64(F.coalesce(*[F.when(e != "", e) for e in entry])))
    content = F.coalesce(*options)
    return (requests.withColumn("content", content)
            .withColumn("error", F.when(F.col("content").isNull(),
                                        "Could not find pcap bytes in the request.")))


def frames_of_content(requests: DataFrame, capture: str, content: str = "content", batch_rows: int = 4096) -> DataFrame:
    """Frames of captures held in a BINARY column (request-sized, one row each). Bytes that are no whole capture give
    one row with a null ``frame`` and the reason in ``error``."""
    schema = FRAMES.append(pa.field("error", pa.string()))

    def failed(name: str, error: str) -> pa.RecordBatch:
        values = [[name], [None], [None], [None], [None], [error]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    def frames(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
        f: BinaryIO = io.BytesIO(data)
        if data[:2] == GZIP_MAGIC:
            f = gzip.GzipFile(fileobj=f)
        try:
            index = list(index_stream(f, name, 1 << 62))
            bad = [row["error"] for row in index if row.get("error")]
            if bad:
                raise CaptureError(bad[0])
            found = [b for row in index for b in _frame_batches(f, row, batch_rows)]
        except READ_ERRORS as exc:
            yield failed(name, f"{type(exc).__name__}: {exc}")
            return
        for b in found:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.string())], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from frames(row["capture"], bytes(row["content"]))

    rows = requests.select(F.col(capture).cast("string").alias("capture"), F.col(content).alias("content"))
    return rows.filter(F.col("content").isNotNull()).mapInArrow(read, FRAME_SCHEMA + ", error STRING")
