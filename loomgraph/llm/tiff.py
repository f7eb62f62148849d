"""TIFF media columns: a reader that emits one row per page, and a writer.

The reader walks the chain of image directories in either byte order, decodes
uncompressed, PackBits, LZW and deflate segments (strips or tiles), undoes the
horizontal predictor for 8- and 16-bit chunky samples, and returns one page
per directory.  Bad bytes give a row with ``error`` set, never an exception.
Directories are visited once (loops end the walk), and no page larger than
``MAX_PAGE`` bytes is allocated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODEC_NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
MAX_PAGE = 1 << 28
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

WIDTH = 64  # samples in a row of a stored payload
PAGE_ROWS = 512
TILE = 64
LZW_SHARE = 8  # of pages without many runs, those whose checksum leaves 0 modulo this are stored with LZW


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more become repeats, everything between them literals."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    cuts = np.flatnonzero(np.diff(raw)) + 1
    starts = np.concatenate(([0], cuts))
    lengths = np.diff(np.concatenate((starts, [len(raw)])))
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for at in range(0, len(literal), 128):
            part = literal[at : at + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        if length < 3:
            literal.extend(data[start : start + length])
            continue
        flush()
        while length:
            take = min(length, 128)
            if take == 1:
                out += bytes((0, data[start]))
            else:
                out += bytes((257 - take, data[start]))
            length -= take
    flush()
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, width, held, bits, last = bytearray(), 9, 0, 0, None
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257 or len(out) >= size:
            break
        if last is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            if len(table) < 4096:
                table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    out, held, bits, width, code_next = bytearray(), 256, 9, 9, 258
    prefix = b""

    def drain() -> None:
        nonlocal held, bits
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    drain()
    for at in range(len(data)):
        longer = prefix + data[at : at + 1]
        if longer in table:
            prefix = longer
            continue
        held, bits = (held << width) | table[prefix], bits + width
        drain()
        table[longer] = code_next
        code_next += 1
        if code_next > (1 << width) - 1:
            width += 1
        if code_next >= 4094:
            held, bits = (held << min(width, 12)) | 256, bits + min(width, 12)
            drain()
            table = {bytes((i,)): i for i in range(256)}
            width, code_next = 9, 258
        prefix = data[at : at + 1]
    if prefix:
        held, bits = (held << width) | table[prefix], bits + width
        drain()
        code_next += 1
        if code_next > (1 << width) - 1 and width < 12:
            width += 1
    held, bits = (held << width) | 257, bits + width
    drain()
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


def decompress(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        out = data[:size]
    elif codec == PACKBITS:
        out = packbits_decode(data, size)
    elif codec == LZW:
        out = lzw_decode(data, size)
    elif codec in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {codec} is not supported")
    if len(out) < size:
        raise ValueError(f"segment has {len(out)} of {size} bytes")
    return out[:size]


class Page(dict):
    """One directory's image: sizes, codec and its samples as row-major bytes."""


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a file in directory order; a broken image gives an error page, a broken directory one that ends the walk."""
    if media is None or media[:2] not in (b"II", b"MM"):
        yield Page(page=0, error="not a TIFF file")
        return
    order = "<" if media[:2] == b"II" else ">"
    try:
        magic, at = struct.unpack(order + "HI", media[2:8])
        if magic != 42:
            raise ValueError("bad magic number")
    except (struct.error, ValueError) as e:
        yield Page(page=0, error=str(e))
        return
    if not at:
        yield Page(page=0, error="no image directory")
    seen: set[int] = set()
    number = 0
    while at and at not in seen:
        seen.add(at)
        try:
            tags, after = _directory(media, at, order)
        except (struct.error, ValueError, KeyError, IndexError) as e:
            yield Page(page=number, error=f"{type(e).__name__}: {e}")
            return
        try:
            page = _image(media, tags, order)
        except (struct.error, ValueError, LookupError, ArithmeticError, zlib.error) as e:
            page = Page(error=f"{type(e).__name__}: {e}")
        page["page"] = number
        yield page
        number, at = number + 1, after


def _directory(media: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", media, at)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
        size = TYPE_BYTES.get(kind, 0) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", media, where)
        if kind in (1, 3, 4) and where + size <= len(media):
            tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", media, where))
    return tags, struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def _image(media: bytes, tags: dict[int, list[int]], order: str) -> Page:
    width, height = tags[256][0], tags[257][0]
    bits = tags.get(258, [1])
    samples = tags.get(277, [1])[0]
    codec, predictor = tags.get(259, [NONE])[0], tags.get(317, [1])[0]
    if set(bits) not in ({8}, {16}) or tags.get(284, [1])[0] != 1:
        raise ValueError(f"{bits} bits or separate planes are not supported")
    each = bits[0] // 8
    if not 0 < width * height * samples * each <= MAX_PAGE:
        raise ValueError("image size out of range")
    kind = np.dtype(np.uint8 if each == 1 else order + "u2")
    image = np.zeros((height, width, samples), kind)
    tiled = 322 in tags
    if tiled:
        wide, tall = tags[322][0], tags[323][0]
        across = -(-width // wide)
        places, lengths = tags[324], tags[325]
    else:
        wide, tall, across = width, min(tags.get(278, [height])[0], height), 1
        places, lengths = tags[273], tags[279]
    if wide < 1 or tall < 1 or wide * tall * samples * each > MAX_PAGE:
        raise ValueError("segment size out of range")
    for k, (place, length) in enumerate(zip(places, lengths, strict=True)):
        top, left = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - top)
        if top >= height or rows <= 0:
            raise ValueError("more segments than the image has")
        block = np.frombuffer(decompress(media[place : place + length], codec, rows * wide * samples * each), kind).reshape(rows, wide, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        image[top : top + rows, left : left + wide] = block[: height - top, : width - left]
    if len(places) < -(-height // tall) * across:
        raise ValueError("segments are missing")
    return Page(width=width, height=height, bits=bits[0], samples=samples, codec=CODEC_NAMES[codec], tiled=tiled, predictor=predictor, data=image.tobytes(), error=None)


def encode(payload: bytes, page_rows: int = PAGE_ROWS, codec: int | None = None, tiled: bool | None = None, predictor: int | None = None) -> bytes:
    """Store bytes (a positive multiple of 64) as grey 8-bit pages of 64 samples a row.

    Unless given, the codec follows the page's bytes alone, at any size:
    PackBits where runs dominate; of the others one in ``LZW_SHARE`` LZW, by
    checksum, and the rest deflated tiles; both with horizontal differences.
    Equal payloads give equal files.
    """
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for at in range(0, len(payload), page_rows * WIDTH):
        data = payload[at : at + page_rows * WIDTH]
        rows = len(data) // WIDTH
        raw = np.frombuffer(data, np.uint8).reshape(rows, WIDTH)
        kind = codec
        if kind is None:
            runs = np.count_nonzero(np.diff(raw.ravel())) + 1
            kind = PACKBITS if runs * 8 < len(data) else DEFLATE if zlib.crc32(data) % LZW_SHARE else LZW
        tile = (kind == DEFLATE) if tiled is None else tiled
        differ = (2 if kind in (DEFLATE, LZW) and codec is None else 1) if predictor is None else predictor
        parts = [_segment(raw[top : top + TILE], kind, differ, TILE if tile else None) for top in range(0, rows, TILE)]
        places = []
        for part in parts:
            places.append(len(out))
            out += part + b"\0" * (len(part) & 1)
        lengths = [len(p) for p in parts]
        tags: list[tuple[int, list[int]]] = [(256, [WIDTH]), (257, [rows]), (258, [8]), (259, [kind]), (262, [1])]
        tags += [] if tile else [(273, places)]
        tags += [(277, [1])] + ([] if tile else [(278, [TILE]), (279, lengths)]) + [(317, [differ])]
        tags += [(322, [WIDTH]), (323, [TILE]), (324, places), (325, lengths)] if tile else []
        entries = bytearray()
        for tag, values in tags:
            if len(values) == 1:
                entries += struct.pack("<HHII", tag, 4, 1, values[0])
            else:
                entries += struct.pack("<HHII", tag, 4, len(values), len(out))
                out += struct.pack(f"<{len(values)}I", *values)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _segment(raw: np.ndarray, codec: int, predictor: int, rows: int | None) -> bytes:
    if rows is not None and len(raw) < rows:
        raw = np.concatenate((raw, np.zeros((rows - len(raw), raw.shape[1]), np.uint8)))
    if predictor == 2:
        raw = np.concatenate((raw[:, :1], np.diff(raw, axis=1)), axis=1)
    data = raw.tobytes()
    return {NONE: lambda d: d, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}[codec](data)


PAGE_SCHEMA = "page int, width int, height int, bits int, samples int, codec string, tiled boolean, predictor int, data binary, error string"


def read_pages(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per page of every file in ``media``: the key, ``PAGE_SCHEMA``'s columns.

    A null or foreign value gives one row with ``error``; an empty table gives
    no rows; repeated rows give repeated pages; other columns are dropped.  A
    key named like a page's column is returned with ``_key`` after its name.
    """
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("samples", pa.int32()), ("codec", pa.string()), ("tiled", pa.bool_()), ("predictor", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                found = list(pages(one.column("media")[0].as_py()))
                rows = pa.RecordBatch.from_pylist([{n: p.get(n) for n in names} for p in found], schema=types)
                keys = pa.concat_arrays([one.column("key")] * len(found))
                yield pa.RecordBatch.from_arrays([keys, *rows.columns], ["key", *names])

    return df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media")).mapInArrow(run, f"key {kind}, {PAGE_SCHEMA}").withColumnRenamed("key", key if key not in names else f"{key}_key")


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (64 if not text else -len(text) % 64)


def features(found: list[Page]) -> str:
    """Page count, codecs, size and first-order statistics of all samples, from integer sums."""
    counts = np.zeros(256, np.int64)
    rough = 0
    for p in found:
        raw = np.frombuffer(p["data"], np.uint8)
        counts += np.bincount(raw, minlength=256)
        rough += int(np.count_nonzero(raw[1:] != raw[:-1]))
    n = int(counts.sum())
    share = counts[counts > 0] / n
    mean = int((counts * np.arange(256)).sum()) / n
    return f"pages={len(found)};rows={sum(p['height'] for p in found)};codecs={'+'.join(sorted({p['codec'] for p in found}))};mean={mean:.3f};entropy={float(-(share * np.log2(share)).sum()):.4f};edges={rough}"


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media_digest(docs: DataFrame) -> DataFrame:
    """Store each whole text as a TIFF file, read its pages back, and describe both.

    One row per input row, from ``doc_id`` and ``text`` alone; null text is
    empty text (one row of 64 zero samples), a null id stays null.  Narrow:
    no shuffle, one text at a time in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").cast(pa.large_binary()):
                raw = text.as_py() or b""
                media = encode(payload_of(raw))
                found = list(pages(media))
                if bad := [p["error"] for p in found if p["error"]]:
                    raise ValueError(f"stored media cannot be read back: {bad[0]}")
                back = b"".join(p["data"] for p in found)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(found))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST_SCHEMA)
