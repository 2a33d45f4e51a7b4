"""Media columns: magic bytes found by Aho-Corasick, structures confirmed by format validators, types corrected, media carved."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced

# Signatures of the formats that have a validator here.
MAGIC = {
    b"RIFF": "wav",
    b"\x89PNG\r\n\x1a\n": "png",
    b"P5": "pgm",
    b"P6": "ppm",
    b"BM": "bmp",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
}
BLOCK = 192


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 strings, which stand for bytes one to one."""
    machine = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        machine.add_word(magic.decode("latin-1"), (kind, len(magic)))
    machine.make_automaton()
    return machine


def wav_length(b: bytes, at: int) -> int:
    """RIFF/WAVE: the chunks must tile the declared size and hold fmt and data."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, i, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return 0
    while i + 8 <= end:
        name, size = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        seen.add(name)
        i += 8 + size + size % 2
    return end - at if i == end and {b"fmt ", b"data"} <= seen else 0


def png_length(b: bytes, at: int) -> int:
    """PNG: chunks from IHDR to IEND with right checksums."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, i)[0], b[i + 4 : i + 8]
        if i + 12 + size > len(b) or first and name != b"IHDR":
            return 0
        if zlib.crc32(b[i + 4 : i + 8 + size]) != struct.unpack_from(">I", b, i + 8 + size)[0]:
            return 0
        i, first = i + 12 + size, False
        if name == b"IEND":
            return i - at
    return 0


def netpbm_length(b: bytes, at: int, channels: int) -> int:
    """Binary PGM and PPM of 8 bits: three header numbers, one white space, then width * height * channels samples."""
    numbers, i = [], at + 2
    while len(numbers) < 3:
        j = i
        while j < len(b) and b[j : j + 1].isspace():
            j += 1
        k = j
        while k < len(b) and k - j < 10 and 48 <= b[k] <= 57:
            k += 1
        if j == i or k == j:
            return 0
        numbers.append(int(b[j:k]))
        i = k
    end = i + 1 + numbers[0] * numbers[1] * channels
    ok = numbers[2] == 255 and numbers[0] and numbers[1] and b[i : i + 1].isspace() and end <= len(b)
    return end - at if ok else 0


def bmp_length(b: bytes, at: int) -> int:
    """BMP of 24 bits without compression: offsets, sizes and dimensions must agree."""
    if len(b) < at + 54:
        return 0
    size, reserved, offset, header, w, h, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    rows = abs(h) * ((w * bits + 31) // 32 * 4)
    ok = not reserved and header == 40 and planes == 1 and bits == 24 and not packed and w > 0 and h and size == offset + rows
    return size if ok and offset >= 54 and at + size <= len(b) else 0


def gif_length(b: bytes, at: int) -> int:
    """GIF: blocks must parse up to the trailer."""
    if len(b) < at + 14:
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0)
        else:
            return 0
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return 0


def jpeg_length(b: bytes, at: int) -> int:
    """JPEG: marker segments up to the scan, then entropy-coded bytes up to the end marker."""
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        marker, size = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if not 0xC0 <= marker <= 0xFE or size < 2:
            return 0
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if marker == 0xDA:
            end = b.find(b"\xff\xd9", i)
            return end + 2 - at if frame and end >= 0 else 0
    return 0


def valid_length(kind: str, b: bytes, at: int) -> int:
    """Bytes of the well-formed medium of this kind that begins at `at`; 0 if there is none."""
    if kind in ("pgm", "ppm"):
        return netpbm_length(b, at, 1 if kind == "pgm" else 3)
    return {"wav": wav_length, "png": png_length, "bmp": bmp_length, "gif": gif_length, "jpeg": jpeg_length}[kind](b, at)


def sniff(b: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """The media in a byte string as (kind, offset, length), from left to right; what lies inside a medium is not looked at."""
    found, free = [], 0
    hits = sorted((last - n + 1, kind) for last, (kind, n) in machine.iter(b.decode("latin-1")))
    for at, kind in hits:
        if at >= free and (n := valid_length(kind, b, at)):
            found.append((kind, at, n))
            free = at + n
    return found


SNIFFED = "actual string, corrected boolean, media array<struct<kind:string,offset:bigint,length:bigint,data:binary>>"


def sniff_media(df: DataFrame, data: str = "data", declared: str = "declared") -> DataFrame:
    """Add `actual` (the type of a medium at offset 0, else null), `corrected` (it differs from the declared one) and `media`
    (every embedded medium with its bytes).

    Null or empty data give null, false and no media; a null declared type counts as wrong when a type is found. Other columns
    are kept; columns named actual, corrected or media are replaced. One row is held at a time, so memory follows the longest.
    """
    df = df.drop("actual", "corrected", "media")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), SNIFFED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))
        for batch in sliced(batches):
            names, blobs = batch.schema.names, batch.column(data).to_pylist()
            said = batch.column(declared).to_pylist()
            media = [sniff(b, machine) if b else [] for b in blobs]
            actual = [m[0][0] if m and m[0][1] == 0 else None for m in media]
            carved = [
                [{"kind": k, "offset": at, "length": n, "data": b[at : at + n]} for k, at, n in m]
                for m, b in zip(media, blobs, strict=True)
            ]
            added = [
                pa.array(actual, pa.string()),
                pa.array([a is not None and a != s for a, s in zip(actual, said, strict=True)], pa.bool_()),
                pa.array(carved, kinds),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "actual", "corrected", "media"])

    return df.mapInArrow(run, schema)


def padded(text: str | None) -> tuple[int, bytes]:
    """The length of the text's UTF-8 bytes, and those with spaces up to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % BLOCK or (BLOCK if not raw else 0))


def stored(payload: bytes) -> bytes:
    """A lossless medium of 8-bit samples: by the payload's checksum a WAV, PGM, PPM or PNG file."""
    width, rows = 64, len(payload) // BLOCK
    kind = zlib.crc32(payload) % 4
    if kind == 0:
        fmt = struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)
        return b"RIFF" + struct.pack("<I", 28 + len(payload) + 8) + b"WAVEfmt \x10\0\0\0" + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    if kind == 1:
        return b"P5\n%d %d\n255\n" % (BLOCK, rows) + payload
    if kind == 2:
        return b"P6\n%d %d\n255\n" % (width, rows) + payload
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK))
    header = struct.pack(">IIBBBBB", width, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def samples(kind: str, b: bytes) -> bytes:
    """The 8-bit samples of a medium that stored() wrote."""
    if kind == "wav":
        return b[44 : 44 + struct.unpack_from("<I", b, 40)[0]]
    if kind in ("pgm", "ppm"):
        return b.split(b"\n", 3)[3]
    i, packed = 8, []
    while i < len(b):
        size = struct.unpack_from(">I", b, i)[0]
        if b[i + 4 : i + 8] == b"IDAT":
            packed.append(b[i + 8 : i + 8 + size])
        i += 12 + size
    lines = zlib.decompress(b"".join(packed))
    return b"".join(lines[i + 1 : i + 1 + BLOCK] for i in range(0, len(lines), BLOCK + 1))


# Kinds that stored() writes.
WRITTEN = ("wav", "pgm", "ppm", "png")
# Declared types of the query's objects, right for some and wrong for others.
DECLARED = ("wav", "png", "ppm")

STORED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media_offset", pa.int64()), ("data", pa.binary())]
)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text (null: empty) as an object of bytes: its medium alone, or after a text preamble for every fifth payload checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, payload = padded(text)
                crc = zlib.crc32(payload)
                before = b"Content-Type: application/octet-stream\r\n\r\n" if crc % 5 == 0 else b""
                rows.append((doc_id, n, DECLARED[crc % 3], len(before), before + stored(payload)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STORED, strict=True)],
                schema=STORED,
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, declared string, media_offset long, data binary"
    )


READ = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ]
)


def read_back(sniffed: DataFrame) -> DataFrame:
    """From what sniff_media carved: the samples, their digests and a feature string (type, correction, place, mean and spread).

    An object with several media gives a row for each, by place; one without any has a row with nulls for all that is read back.
    Media of kinds that stored() does not write have no samples: nulls but for their length and digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in sliced(batches):
            rows = []
            for r, medium in ((r, m) for r in batch.to_pylist() for m in (r["media"] or [None])):
                if medium is None:
                    rows.append((r["doc_id"], r["n_bytes"], *[None] * 6))
                    continue
                if medium["kind"] not in WRITTEN:
                    rows.append((r["doc_id"], r["n_bytes"], None, None, None, medium["length"], hashlib.sha256(medium["data"]).hexdigest(), None))
                    continue
                payload = samples(medium["kind"], medium["data"])
                values = np.frombuffer(payload, np.uint8)
                feature = (
                    f"type={medium['kind']};declared={r['declared']};corrected={int(r['declared'] != medium['kind'])};"
                    f"offset={medium['offset']};samples={len(values)};mean={values.mean():.6f};std={values.std():.6f}"
                )
                rows.append(
                    (r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                     medium["length"], hashlib.sha256(medium["data"]).hexdigest(), feature)
                )
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)],
                schema=READ,
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniffed.mapInArrow(run, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as media bytes of some declared type, sniffed, carved and read back."""
    return read_back(sniff_media(text_media(documents(spark, sf_dir))))
