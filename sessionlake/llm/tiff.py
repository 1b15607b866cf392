"""TIFF as a media column: one row per page of each file.

A reader walks the chain of image directories of either byte order, takes the
strips or tiles of each page, undoes their compression (none, PackBits, LZW,
deflate) and the horizontal predictor, and puts the samples together. A writer
stores 8-bit samples in the same ways, for round trips.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlake.llm import columns

# Fixed values of the format: tags, compressions, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, END_OF_DATA, FIRST_CODE, MOST_CODES = 256, 257, 258, 4096


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a signed count, then that many bytes as they are, or one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        count = data[at]
        if count < 128:
            out += data[at + 1 : at + 2 + count]
            at += 2 + count
        else:
            if count > 128:
                out += data[at + 1 : at + 2] * (257 - count)
            at += 2 if count > 128 else 1
    return bytes(out)


_RUNS = re.compile(rb"(.)\1{1,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of two to 128 equal bytes as one, what is between them as it is."""
    out, at = bytearray(), 0

    def plain(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUNS.finditer(data):
        if len(run[0]) == 2 and run.start() > at:  # two equal bytes among others cost less as they are
            continue
        plain(run.start())
        out.extend((257 - len(run[0]), run[0][0]))
        at = run.end()
    plain(len(data))
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes from the high bit down; the width of a code grows one entry before the table is full."""
    padded = np.zeros(len(data) + 2, np.uint32)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    window = (padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]).tolist()  # the 24 bits from each byte on
    out: list[bytes] = []
    put = out.append
    single = [bytes([b]) for b in range(256)] + [b"", b""]
    entries, size, last = single.copy(), FIRST_CODE, b""
    add = entries.append
    at, width, full, mask, end = 0, 9, 511, 511, 8 * len(data)
    while at + width <= end:
        code = window[at >> 3] >> 24 - width - (at & 7) & mask
        at += width
        if code < size and code != CLEAR and code != END_OF_DATA:
            entry = entries[code]
        elif code == CLEAR:
            entries, size, last = single.copy(), FIRST_CODE, b""
            add = entries.append
            width, full, mask = 9, 511, 511
            continue
        elif code == END_OF_DATA:
            break
        elif last and code == size:
            entry = last + last[:1]
        else:
            raise ValueError("a code that the table does not have")
        put(entry)
        if last and size < MOST_CODES:
            add(last + entry[:1])
            size += 1
            if size == full and width < 12:
                width, full = width + 1, 2 * full + 1
                mask = full
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, widths = [CLEAR], [(0, 9)]  # the codes, and from which of them on they have how many bits
    put = codes.append
    if data:
        table: dict[int, int] = {}  # a code and the byte that follows it: the code of both
        following, full = FIRST_CODE, 512
        prefix = data[0]
        for byte in data[1:]:
            key = prefix << 8 | byte
            code = table.get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            table[key] = following
            following += 1
            if following == full:
                widths.append((len(codes), widths[-1][1] + 1))
                full *= 2
            elif following == MOST_CODES - 1:
                put(CLEAR)
                table, following, full = {}, FIRST_CODE, 512
                widths.append((len(codes), 9))
            prefix = byte
        put(prefix)
        if following + 1 == full and widths[-1][1] < 12:
            widths.append((len(codes), widths[-1][1] + 1))
    put(END_OF_DATA)
    starts = np.array([w[0] for w in widths])
    size = np.repeat([w[1] for w in widths], np.diff(np.append(starts, len(codes))))
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - size[:, None]]).tobytes()


UNPACK = {NONE: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, ADOBE_DEFLATE: zlib.decompress, DEFLATE: zlib.decompress}
PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, ADOBE_DEFLATE: lambda data: zlib.compress(data, 6), DEFLATE: lambda data: zlib.compress(data, 6)}


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes  # rows from the top, samples of a pixel together, in the machine's little-endian order


def _directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The fields of each image directory, along the chain; a loop in the chain ends it."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(f"{order}H", data, at)
        fields = {}
        for k in range(count):
            tag, kind, many = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind not in FIELD_CODES:
                continue
            place = at + 10 + 12 * k
            if FIELD_BYTES[kind] * many > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            fields[tag] = struct.unpack_from(f"{order}{many}{FIELD_CODES[kind]}", data, place)
        yield fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; 8- and 16-bit samples."""
    swap = data[:2] == b"MM"
    for index, f in enumerate(_directories(data)):
        first = lambda tag, other: f.get(tag, (other,))[0]  # noqa: E731, B023
        width, height, samples, bits = first(WIDTH, 0), first(HEIGHT, 0), first(SAMPLES, 1), first(BITS, 1)
        compression, predictor, separate = first(COMPRESSION, NONE), first(PREDICTOR, 1), first(PLANAR, 1) == 2
        if bits not in (8, 16) or len(set(f.get(BITS, (bits,)))) > 1 or compression not in UNPACK or predictor not in (1, 2):
            raise ValueError(f"page {index}: samples, compression or predictor of a kind that is not read")
        tiled = TILE_OFFSETS in f
        block_w, block_h = (first(TILE_WIDTH, width), first(TILE_HEIGHT, height)) if tiled else (width, min(height, first(ROWS_PER_STRIP, height)))
        offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
        kind = np.dtype("u1" if bits == 8 else ">u2" if swap else "<u2")
        across, down = -(-width // block_w) if block_w else 0, -(-height // block_h) if block_h else 0
        planes, depth = (samples, 1) if separate else (1, samples)
        canvas = np.zeros((height, width, samples), kind.newbyteorder("<"))
        for n, (offset, count) in enumerate(zip(offsets, counts)):
            plane, rest = divmod(n, across * down)
            row, column = divmod(rest, across)
            if plane >= planes:
                break
            rows = block_h if tiled else min(block_h, height - row * block_h)
            raw = np.frombuffer(UNPACK[compression](data[offset : offset + count]), np.uint8)[: rows * block_w * depth * kind.itemsize]
            block = np.zeros(rows * block_w * depth * kind.itemsize, np.uint8)
            block[: len(raw)] = raw
            block = block.view(kind).reshape(rows, block_w, depth).astype(kind.newbyteorder("<"))
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            y, x = row * block_h, column * block_w
            part = block[: height - y, : width - x]
            if separate:
                canvas[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
            else:
                canvas[y : y + part.shape[0], x : x + part.shape[1]] = part
        yield Page(index, width, height, samples, bits, compression, predictor, tiled, canvas.tobytes())


def write(images: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 2, block: tuple[int, int] | int = 64, order: str = "<") -> bytes:
    """A file of pages, each (height, width, samples) of 8 bits. block: rows of a strip, or (height, width) of a tile."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        tiled = not isinstance(block, int)
        rows, across = block if tiled else (block, width)
        offsets, counts = [], []
        for y in range(0, height, rows):
            for x in range(0, width, across):
                part = image[y : y + rows, x : x + across]
                if tiled:
                    whole = np.zeros((rows, across, samples), np.uint8)
                    whole[: part.shape[0], : part.shape[1]] = part
                    part = whole
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = PACK[compression](part.tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        if len(out) % 2:
            out += b"\0"
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2])]
        if not tiled:
            fields += [(STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [samples]), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        else:
            fields += [(SAMPLES, 3, [samples])]
        fields += [(PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tiled:
            fields += [(TILE_WIDTH, 4, [across]), (TILE_HEIGHT, 4, [rows]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        values = {}
        for tag, kind, value in fields:
            data = struct.pack(f"{order}{len(value)}{FIELD_CODES[kind]}", *value)
            if len(data) > 4:
                values[tag] = len(out)
                out += data + b"\0" * (len(data) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields))
        for tag, kind, value in fields:
            data = struct.pack(f"{order}I", values[tag]) if tag in values else struct.pack(f"{order}{len(value)}{FIELD_CODES[kind]}", *value).ljust(4, b"\0")
            out += struct.pack(f"{order}HHI", tag, kind, len(value)) + data
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGES = "file_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
#: Bytes of samples that are held before they are sent on, unless one file has more.
HELD_BYTES = 4 << 20
_KINDS = [pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]


def read_pages(files: DataFrame, file_id: str = "file_id", data: str = "data", keep: list[str] | None = None) -> DataFrame:
    """PAGES: one row per page of each file, with its samples, and the columns to keep, repeated.

    A null or broken file gives one row whose page is null and whose error says
    why, after the pages that could be read. Rows that repeat give their pages
    again. Columns that are not kept are left out; kept ones may not be named as
    those of PAGES. An empty table gives no rows. No shuffle: pages stay where
    files are, in the order of the files.
    """
    own = [F.col(file_id).cast("long").alias("file_id"), F.col(data).cast("binary").alias("data")]
    source = files.select(*own, *[F.col(c) for c in keep or []])
    names = [c.split()[0] for c in PAGES.split(", ")]
    schema = StructType([*StructType.fromDDL(PAGES).fields, *source.schema.fields[2:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, size = [], [], 0

            def told() -> pa.RecordBatch:
                kept = [batch.column(2 + n).take(pa.array(places, pa.int64())) for n in range(batch.num_columns - 2)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)), *kept], names=[*names, *batch.schema.names[2:]])  # noqa: B023

            for place, (key, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                try:
                    for p in pages(value.as_py() or b""):
                        rows.append((key, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None))
                        size += len(p.pixels)
                except (ValueError, IndexError, KeyError, struct.error, zlib.error) as why:
                    rows.append((key, *[None] * 9, f"{type(why).__name__}: {why}"))
                places += [place] * (len(rows) - len(places))
                if size >= HELD_BYTES:
                    yield told()
                    rows, places, size = [], [], 0
            if rows:
                yield told()

    return source.mapInArrow(work, schema)


#: A payload is stored in rows of so many samples, and in pages of at most so many rows.
ROW, PAGE_ROWS, UNIT = 24, 2730, 576
#: Rows of a strip, and rows and columns of a tile.
STRIP, TILE = 1024, (256, 16)
STORED = [PACKBITS, LZW, ADOBE_DEFLATE, DEFLATE]


def store(text: bytes) -> tuple[bytes, int]:
    """(file, payload's bytes): the text and bytes 255 up to a positive multiple of UNIT, as pages of 8-bit samples.

    The payload's digest chooses the compression, the predictor, and strips or
    tiles, so that all of them occur and equal texts are stored equally.
    """
    size = max(1, -(-len(text) // UNIT)) * UNIT
    payload = np.full(size, 255, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    pick = hashlib.sha256(payload.tobytes()).digest()
    grid = payload.reshape(-1, ROW, 1)
    images = [grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)]
    return write(images, STORED[pick[0] % len(STORED)], 1 + pick[1] % 2, TILE if pick[2] % 2 else STRIP, "<>"[pick[3] % 2]), size


STORED_FILES = "file_no long, data binary, doc_id long, n_bytes long, media_bytes long, media_sha256 string"


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """STORED_FILES: each row's whole text as a file, numbered within its partition. A null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for start, texts in columns.slices(batch, "text"):
                rows = []
                for own in texts:
                    data = own.encode("utf-8", "replace")
                    media, _ = store(data)
                    rows.append((number, media, len(data), len(media), hashlib.sha256(media).hexdigest()))
                    number += 1
                no, media, n, size, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(media, pa.binary()), batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest)], names=[c.split()[0] for c in STORED_FILES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, STORED_FILES)


ROUND_TRIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long, codec string"


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a TIFF file, read back into a row per page, and the pages of each file told together: digests and a feature of what was read.

    feature: mean, standard deviation and share of non-ASCII samples of the
    samples read, to six digits. codec: compression, predictor, and strips or
    tiles. A null text is empty, which is one unit of bytes 255. Rows that
    repeat and null ids stay; other columns are left out; an empty table gives no
    rows. Pages follow each other as they were read, so nothing is shuffled.
    """
    read = read_pages(stored(docs, doc_id, text), "file_no", "data", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    names = [c.split()[0] for c in ROUND_TRIP.split(", ")]
    part = read.select("file_id", "page", "compression", "predictor", "tiled", "pixels", "error", "doc_id", "n_bytes", "media_bytes", "media_sha256")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        rows: list[tuple] = []
        values = np.arange(256)

        def end() -> None:
            counts = own["counts"]
            total = counts.sum()
            mean = float((counts * values).sum() / total)
            spread = float(np.sqrt((counts * (values - mean) ** 2).sum() / total))
            rows.append((own["doc_id"], own["n_bytes"], int(total), own["digest"].hexdigest(), zlib.crc32(own["tail"][-32:]), own["media_bytes"], own["media_sha256"], f"{mean:.6f},{spread:.6f},{counts[128:].sum() / total:.6f}", own["pages"], own["codec"]))

        def told() -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 3, pa.string(), *[pa.int64()] * 2, *[pa.string()] * 2, pa.int64(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            if rows:
                yield told()
            for k, (page, error) in enumerate(zip(batch.column(1).to_pylist(), batch.column(6).to_pylist())):
                if error is not None:
                    raise ValueError(f"a stored file that cannot be read: {error}")
                if page == 0:
                    if own:
                        end()
                    at = lambda c, k=k, batch=batch: batch.column(c)[k].as_py()
                    own = {"doc_id": at(7), "n_bytes": at(8), "media_bytes": at(9), "media_sha256": at(10), "codec": f"{at(2)}/{at(3)}/{'tiles' if at(4) else 'strips'}", "counts": np.zeros(256, np.int64), "digest": hashlib.sha256(), "tail": b"", "pages": 0}
                pixels = batch.column(5)[k].as_buffer().to_pybytes()
                own["counts"] += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                own["digest"].update(pixels)
                own["tail"] = (own["tail"] + pixels)[-32:]
                own["pages"] += 1
        if own:
            end()
        if rows:
            yield told()

    return part.mapInArrow(fold, ROUND_TRIP)
