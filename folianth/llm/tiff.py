"""TIFF columns: walk image directories, decode strips and tiles, undo predictors, a row per page.

A page that can't be decoded gives a row with its ``page`` and an ``error``, and the walk goes on; a damaged
chain of directories ends it with such a row. Samples of 1, 2 and 4 bits become a byte each. What a page decodes
to is bounded by what its strips and tiles can hold (``EXPANSION``) and by its own size, so a small file that claims a huge page is
an error and no huge array; texts of any length make pages of that length. Bytes beyond a page's samples are not decoded.
Nulls and empty or damaged files give one row with ``page`` 0, null measures and an ``error``;
repeated rows give repeated pages; other columns of the input pass through only if named in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K

# Fixed values of the TIFF 6.0 specification and its supplements: tags, compressions, value types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
FILL_ORDER = 266
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}

#: No tag: tells of a tag whose values lie outside the file.
DAMAGED = -1
#: Payload rows are this many samples wide.
ROW = 64
STRIP_ROWS = 1024


#: Bytes that a byte of each compression can stand for, at most.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2600, DEFLATE: 1100, OLD_DEFLATE: 1100}


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """PackBits runs: 0..127 copies n + 1 bytes, -1..-127 repeats one byte 1 - n times, -128 is skipped; ends after ``most`` bytes."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, widened one code early; ends after ``most`` bytes."""
    out = bytearray()
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    single = [bytes((x,)) for x in range(256)]
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [*single, b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        out += entry
        last = entry
        if most is not None and len(out) >= most:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table = {bytes((x,)): x for x in range(256)}
    size, width = 258, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    run = b""
    for x in data:
        longer = run + bytes((x,))
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = size
        size += 1
        width = min(12, size.bit_length())
        if size == 4094:
            put(256)
            table = {bytes((y,)): y for y in range(256)}
            size, width = 258, 9
        run = longer[-1:]
    if run:
        put(table[run])
        size += 1
        width = min(12, size.bit_length())
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int = 0) -> bytes:
    """Deflate with its checksum, ``most`` bytes of it."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, most)
    if most and len(out) < most or not most:
        out += stream.flush()
        if not stream.eof:
            raise ValueError("incomplete deflate data")
    return out


_decode = {NONE: lambda data, most: bytes(data[:most]), LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
_encode = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def undo_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    """Rows x columns x samples: 2 sums differences along the row, with wrap-around; 3 is undone on bytes (``join_bytes``)."""
    if predictor in (1, 3):
        return block
    if predictor != 2:
        raise ValueError(f"predictor {predictor} is not supported")
    return np.cumsum(block, axis=1, dtype=block.dtype)


def join_bytes(raw: bytes, high: int, wide: int, deep: int, size: int) -> np.ndarray:
    """Predictor 3: rows hold the differences of all first bytes, then all second ones, the highest first; gives unsigned samples."""
    rows = np.frombuffer(raw, np.uint8, high * wide * deep * size).reshape(high, wide * size, deep)
    planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(high, size, wide * deep)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(high, wide, deep)


def unpack_samples(raw: bytes, high: int, wide: int, deep: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, high bits first; each row begins a byte."""
    rows = np.unpackbits(np.frombuffer(raw, np.uint8, high * -(-wide * deep * bits // 8)).reshape(high, -1), axis=1)
    samples = rows[:, : wide * deep * bits].reshape(high, wide, deep, bits)
    return (samples << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The byte order and the integer tags of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("damaged directory chain")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list[int]] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPE_CODES:
                continue
            form = f"{order}{n}{TYPE_CODES[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            try:
                tags[tag] = list(struct.unpack_from(form, data, place))
            except struct.error as e:
                tags[DAMAGED] = [f"tag {tag}: {e}"]
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_page(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    """The samples of one directory, as rows x columns x samples."""
    if DAMAGED in tags:
        raise ValueError(tags[DAMAGED][0])
    one = lambda tag, otherwise: tags.get(tag, [otherwise])[0]
    width, length, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits = set(tags.get(BITS, [1]))
    if bits not in ({1}, {2}, {4}, {8}, {16}, {32}):
        raise ValueError(f"bits per sample {sorted(bits)} are not supported")
    depth, predictor = bits.pop(), one(PREDICTOR, 1)
    if depth < 8 and predictor != 1 or depth == 8 and predictor == 3:
        raise ValueError(f"predictor {predictor} is not defined for {depth} bits")
    kind = np.dtype(f"{order}u{max(1, depth // 8)}")
    flip = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256)) if one(FILL_ORDER, 1) == 2 else None
    split = one(PLANAR, 1) == 2 and samples > 1
    planes, deep = (samples, 1) if split else (1, samples)
    if one(COMPRESSION, NONE) not in _decode:
        raise ValueError(f"compression {one(COMPRESSION, NONE)} is not supported")
    decode = _decode[one(COMPRESSION, NONE)]
    if TILE_OFFSETS in tags:
        w, h, starts, counts = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, starts, counts = width, min(one(ROWS_PER_STRIP, length), length), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if min(w, h, width, length) <= 0:
        raise ValueError("an image without samples")
    across, down = -(-width // w), -(-length // h)
    if len(starts) < across * down * planes or len(starts) != len(counts):
        raise ValueError("strips or tiles are missing")
    held = sum(min(c, max(0, len(data) - at)) for at, c in zip(starts, counts)) * EXPANSION[one(COMPRESSION, NONE)]
    if -(-width * samples * depth // 8) * length > held:
        raise ValueError("strips or tiles are too short for the size of the page")
    out = np.zeros((length, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, (y, x) = k // (across * down), divmod(k % (across * down), across)
        high = h if TILE_OFFSETS in tags else min(h, length - y * h)
        raw = data[starts[k] : starts[k] + counts[k]]
        need, stored = high * w * deep, high * -(-w * deep * depth // 8)
        if stored > len(raw) * EXPANSION[one(COMPRESSION, NONE)]:
            raise ValueError("a strip or tile is too short")
        raw = decode(raw.translate(flip) if flip else raw, stored)
        if len(raw) < stored:
            raise ValueError("a strip or tile is too short")
        if depth < 8:
            block = unpack_samples(raw, high, w, deep, depth)
        elif predictor == 3:
            block = join_bytes(raw, high, w, deep, kind.itemsize).astype(out.dtype)
        else:
            block = np.frombuffer(raw, kind, need).astype(out.dtype).reshape(high, w, deep)
        block = undo_predictor(block, predictor)[: length - y * h, : width - x * w]
        out[y * h : y * h + block.shape[0], x * w : x * w + block.shape[1], plane : plane + deep] = block
    return out


def read_pages(data: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    for order, tags in directories(data):
        yield tags, read_page(data, order, tags)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file with a directory for each array of rows x columns (x samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        length, width, samples = page.shape
        high, wide = tile or (min(strip_rows, length), width)
        starts, counts = [], []
        for y in range(0, length, high):
            for x in range(0, width, wide):
                block = page[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                packed = _encode[compression](np.ascontiguousarray(block).tobytes())
                starts.append(len(out))
                counts.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        entries = {WIDTH: [width], LENGTH: [length], BITS: [8 * page.itemsize] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [samples], PREDICTOR: [predictor]}
        entries |= {TILE_WIDTH: [wide], TILE_LENGTH: [high], TILE_OFFSETS: starts, TILE_COUNTS: counts} if tile else {ROWS_PER_STRIP: [high], STRIP_OFFSETS: starts, STRIP_COUNTS: counts}
        far = {}
        for tag, values in entries.items():
            if len(values) > 1:
                far[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag in sorted(entries):
            out += struct.pack("<HHII", tag, 4, len(entries[tag]), far.get(tag, entries[tag][0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_payload(text: bytes) -> bytes:
    """The bytes, filled up with 0 to a positive multiple of one row."""
    return text + b"\0" * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def text_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Store each text losslessly as one 8-bit grey page: columns ``keep``, n_bytes, media."""
    names = list(keep)

    def store(batches):
        for batch in batches:
            column = batch.column(len(names))
            n, media = [], []
            for x in column:
                raw = (x.as_py() or "").encode()
                n.append(len(raw))
                media.append(write_tiff([np.frombuffer(text_payload(raw), np.uint8).reshape(-1, ROW)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", "media"])

    picked = docs.select(*names, docs[text].alias("__text"))
    schema = T.StructType([*picked.schema.fields[: len(names)], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return picked.mapInArrow(K.released(store), schema)


def describe(samples: np.ndarray) -> str:
    """Size, mean, spread, entropy and edge strength of a page's samples."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256) if samples.itemsize == 1 else np.unique(flat, return_counts=True)[1]
    share = counts[counts > 0] / flat.size
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    wide = samples.astype(np.int32) if samples.itemsize < 4 else samples.astype(np.int64)
    edge = float(np.abs(np.diff(wide, axis=1)).mean()) if samples.shape[1] > 1 else 0.0
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]};mean={flat.mean():.4f};std={math.sqrt(float(flat.var())):.4f};entropy={entropy:.4f};edge={edge:.4f}"


PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()),
    T.StructField("predictor", T.IntegerType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()), T.StructField("error", T.StringType()),
]


def tiff_pages(media: DataFrame, content: str = "media", keep: tuple[str, ...] = ("doc_id",), pixels: bool = False) -> DataFrame:
    """One row per page of each file: ``keep``, measures and digests of what was decoded; with ``pixels`` also the samples."""
    names = list(keep)
    fields = [*PAGE_FIELDS, *([T.StructField("pixels", T.BinaryType())] if pixels else [])]

    def rows(data: bytes | None) -> Iterator[tuple]:
        digest = None if data is None else hashlib.sha256(data).hexdigest()
        size = None if data is None else len(data)
        failures = (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError)

        def failed(k: int, e: Exception) -> tuple:
            return (k, *[None] * 9, size, digest, None, f"{type(e).__name__}: {e}"[:200], *([None] if pixels else []))

        k = 0
        try:
            for order, tags in directories(data or b""):
                try:
                    page = read_page(data, order, tags)
                    raw = page.tobytes()
                    one = lambda tag, tags=tags: tags.get(tag, [1])[0]
                    row = (k, page.shape[1], page.shape[0], page.shape[2], one(BITS), one(COMPRESSION), one(PREDICTOR), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), size, digest, describe(page), None, *([raw] if pixels else []))
                except failures as e:
                    row = failed(k, e)
                yield row
                k += 1
        except failures as e:
            yield failed(k, e)

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            source, found = [], []
            for i, x in enumerate(batch.column(len(names))):
                for row in rows(x.as_py()):
                    source.append(i)
                    found.append(row)
            take = pa.array(source, pa.int64())
            columns = [pa.array([r[j] for r in found], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns[: len(names)]], *columns], [*names, *[f.name for f in fields]])

    picked = media.select(*names, media[content].alias("__content"))
    return picked.mapInArrow(K.released(read), T.StructType([*picked.schema.fields[: len(names)], *fields]))
