"""Media columns: content-addressed payloads in tar shards of the shared folder.

``store`` writes payloads and leaves rows of (digest, shard, offset, length); a shard holds
one copy of each different payload, named by its SHA-256.  ``read_headers`` fills metadata
columns from reads of the first bytes of each payload only; ``read`` gets whole payloads
back.  ``catalog`` names one place for each digest over all shards.

Payloads here are 8-bit greyscale PNG images of ``WIDTH`` samples a line: lossless, and their
size is known from 33 bytes.

A shard is written under a name of its own by each attempt of a task and is referred to
only by the rows of the attempt that ended well, so a lost executor leaves at most a file
that nothing names.

Defined results: a null text is an empty one; an empty payload is one line of padding;
equal texts give equal values everywhere; an empty table writes no shard and gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import open_shared
from .storage import materialize, new_path
from .textcore import Texts, sliced

WIDTH = 576
PAD = 255
#: A new shard begins beyond this size.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes, width: int = WIDTH) -> bytes:
    """text and padding up to a positive multiple of width."""
    return text + bytes([PAD]) * (-len(text) % width or (width if not text else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """Lines of 8-bit grey samples as PNG, without line filters."""
    lines = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    raw = np.zeros((len(lines), width + 1), dtype=np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> dict[str, int]:
    """Metadata from the first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png made (checked by its CRCs)."""
    head, at, packed = png_header(data), 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered PNG, which this reader doesn't know")
    return lines[:, 1:].tobytes()


def feature(samples: bytes, head: dict[str, int]) -> str:
    """Size, mean, and a 16-bin histogram of samples in thousandths."""
    x = np.frombuffer(samples, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{head['width']}x{head['height']}x{head['bit_depth']};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};" + ",".join(map(str, bins.tolist()))


class ShardWriter:
    """Tar shards of one task; put() returns where a payload is."""

    def __init__(self, folder: str):
        self.store, self.base = open_shared(folder)
        self.out = None

    def _open(self) -> None:
        self.store.create_dir(self.base, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.out = self.store.open_output_stream(f"{self.base}/{self.name}")
        self.at, self.held = 0, {}

    def put(self, data: bytes) -> tuple[str, str, int, int]:
        if self.out is not None and self.at > SHARD_BYTES:
            self.close()
        if self.out is None:
            self._open()
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.held:
            info = tarfile.TarInfo(digest)
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.out.write(data)
            self.out.write(bytes(-len(data) % 512))
            self.held[digest] = (self.name, self.at + 512, len(data))
            self.at += 512 + len(data) + -len(data) % 512
        return digest, *self.held[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length.  Materialize it: each run writes shards anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder)
        for b in sliced(batches, limit=8 << 20):
            texts = Texts(b.column("text"))
            rows = [shards.put(encode_png(payload(texts.raw(i), width), width)) for i in range(texts.n)]
            digest, shard, offset, length = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(texts.offsets)), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        shards.close()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def catalog(rows: DataFrame) -> DataFrame:
    """One place for each digest, whatever the number of shards and rows that have it."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")


class ShardReader:
    """Reads ranges of shards, one file open at a time."""

    def __init__(self, folder: str):
        self.store, self.base = open_shared(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.base}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


def read_headers(rows: DataFrame, folder: str) -> DataFrame:
    """rows with width, height and bit_depth from the first bytes of each payload."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder)
        for b in batches:
            heads = [png_header(reader.read(s, o, min(n, HEADER_BYTES))) for s, o, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            more = [pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "bit_depth")]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*kept, "width", "height", "bit_depth"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, width int, height int, bit_depth int")


def read_back(rows: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder)
        known: dict[tuple[str, int], tuple] = {}
        for b in batches:
            out = []
            for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                told = known.get((shard, offset))
                if told is None:
                    data = reader.read(shard, offset, length)
                    samples = decode_png(data)
                    told = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, png_header(data[:HEADER_BYTES])))
                    if len(known) > 50_000:
                        known.clear()
                    known[shard, offset] = told
                out.append(told)
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(b.column(c) for c in ("shard", "offset", "width", "height"))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width int, height int")


def report(docs: DataFrame) -> DataFrame:
    """Stores all texts, fills the header columns, and reads everything back."""
    folder = new_path(docs.sparkSession, "media")
    rows = materialize(store(docs, folder), "media-rows")
    told = read_back(read_headers(rows, folder), folder)
    # where a payload lies differs from run to run, so that doesn't belong in the result
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def members(data: bytes) -> list[str]:
    """Names in a shard, by the standard reader."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return t.getnames()
