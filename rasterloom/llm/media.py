"""Media columns: texts kept losslessly as 8-bit samples in Ogg streams, and read back.

Writing lays packets of samples and a checksum packet into two logical streams of one physical
stream. Reading verifies every page's checksum, demultiplexes the pages by serial number, puts
packets together again from the lacing values (over page ends too), and derives times from granule
positions, which count the samples that end on a page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.common import table

FRAME, PAD, RATE = 576, 255, 48_000
SAMPLES, CHECK = 1, 2  # serial numbers of the two logical streams
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, from 0.

    zlib's CRC has the same polynomial reflected; with every byte's bits turned round, the register
    started at 0 and the result turned back, both are the same sum.
    """
    turned = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(turned.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lacing_of(size: int) -> bytes:
    """A packet's lacing values: 255 for each full segment, then the rest, which ends the packet."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[bytes], granules: list[int], number: int = 0, flags: int = 0, segments: int = 255) -> list[bytes]:
    """Packets as pages of up to ``segments`` segments; packets go on over page ends."""
    lacing = b"".join(lacing_of(len(p)) for p in packets)
    body = b"".join(packets)
    ends = np.cumsum([len(p) // 255 + 1 for p in packets])  # segments up to each packet's end
    out, at = [], 0
    for s in range(0, len(lacing), segments):
        part = lacing[s : s + segments]
        done = int(np.searchsorted(ends, s + len(part), "right")) - 1  # the last packet that ends on this page
        fresh = done >= 0 and ends[done] > s
        size = sum(part)
        last = s + segments >= len(lacing)
        cont = CONTINUED if s and lacing[s - 1] == 255 else 0
        out.append(page(serial, number, granules[done] if fresh else -1, cont | (FIRST if number == 0 and not s else 0) | (flags if last else 0), part, body[at : at + size]))
        at += size
        number += 1
    return out


def write_ogg(samples: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A physical stream of two logical ones: the samples in packets of ``frame``, and their checksum."""
    frames = [samples[i : i + frame] for i in range(0, len(samples), frame)]
    head = struct.pack("<8sIIQ", b"PCM8raw\0", rate, frame, len(samples))
    check = struct.pack("<8sI", b"CRC32\0\0\0", zlib.crc32(samples))
    data = stream_pages(SAMPLES, frames, [min((i + 1) * frame, len(samples)) for i in range(len(frames))], 1, LAST)
    half = len(data) // 2
    return b"".join([*stream_pages(SAMPLES, [head], [0]), *stream_pages(CHECK, [check[:8]], [0]), *data[:half], *stream_pages(CHECK, [check[8:]], [len(samples)], 1, LAST), *data[half:]])


@dataclass
class Logical:
    """One logical stream: its packets, the granule position at which each page ends, and their pages."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    number: int = 0
    ended: bool = False


class BadOgg(ValueError):
    pass


def read_ogg(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial number. Raises BadOgg where pages, checksums or packets are broken."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise BadOgg("cut page header")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise BadOgg("no page where one should begin")
        lacing = data[at + 27 : at + 27 + n]
        begin = at + 27 + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise BadOgg("cut page")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise BadOgg("page checksum")
        if flags & FIRST:
            if serial in streams:
                raise BadOgg("stream begins twice")
            streams[serial] = Logical()
        own = streams.get(serial)
        if own is None or own.ended or own.number != number:
            raise BadOgg("page out of order")
        if bool(flags & CONTINUED) != bool(own.open):
            raise BadOgg("packet without its beginning or end")
        own.number += 1
        own.ended = bool(flags & LAST)
        start = here = begin
        for v in lacing:
            here += v
            if v < 255:
                own.packets.append(b"".join([*own.open, data[start:here]]) if own.open else data[start:here])
                own.open.clear()
                start = here
        if start < here:
            own.open.append(data[start:here])
        elif lacing and lacing[-1] == 255:
            own.open.append(b"")
        if granule >= 0:
            own.granules.append(granule)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise BadOgg("stream without its end")
    return streams


def read_samples(data: bytes) -> tuple[bytes, str]:
    """The samples and a line of features: packets, pages, seconds, mean, power, crossings of the middle."""
    streams = read_ogg(data)
    own, check = streams[SAMPLES], streams[CHECK]
    _, rate, _, size = struct.unpack("<8sIIQ", own.packets[0])
    samples = b"".join(own.packets[1:])
    if len(samples) != size or struct.unpack("<I", check.packets[1])[0] != zlib.crc32(samples):
        raise BadOgg("samples don't match their checksum")
    a = np.frombuffer(samples, np.uint8)
    total, power = int(a.sum(dtype=np.int64)), int((a.astype(np.int32) ** 2).sum(dtype=np.int64))
    high = a >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    times = ",".join(f"{g / rate:.6f}" for g in own.granules[-2:])
    n = max(len(a), 1)
    return samples, f"packets={len(own.packets) - 1};pages={own.number};ends={times};mean={total / n:.6f};power={power / n:.6f};crossings={crossings}"


def ogg_column(docs: DataFrame, text: str = "text", key: str = "doc_id", frame: int = FRAME) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, media (the text's UTF-8 bytes, padded to whole frames, as Ogg).

    Null counts as empty; an empty text is one frame of padding. Equal texts give equal media. Keys keep
    their type. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b"")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                media = [write_ogg(t.ljust(max(1, -(-len(t) // frame)) * frame, bytes([PAD])), frame) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["k", "n_bytes", "media"])

    return rows.mapInArrow(run, StructType([rows.schema["k"]]).add("n_bytes", "long").add("media", "binary")).withColumnRenamed("k", key)


def read_media(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Key, n_bytes, media, payload, feature and error of each row; broken or null media give null payload and say why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for m in part.column(2).to_pylist():
                    try:
                        if m is None:
                            raise BadOgg("no media")
                        out.append((*read_samples(m), None))
                    except (BadOgg, struct.error, KeyError, IndexError) as e:
                        out.append((None, None, str(e) or type(e).__name__))
                got = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *got], names=["k", "n_bytes", "media", "payload", "feature", "error"])

    rows = df.select(F.col(f"`{key}`").alias("k"), "n_bytes", F.col(f"`{media}`").alias("media"))
    schema = StructType(list(rows.schema.fields)).add("payload", "binary").add("feature", "string").add("error", "string")
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_media(ogg_column(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
