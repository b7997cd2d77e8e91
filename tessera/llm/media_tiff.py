"""Media columns: TIFF images in a binary column, decoded to one row per page.

`decode_pages` walks the chain of image directories of each TIFF, decodes strips or tiles (stored, PackBits, LZW,
deflate), undoes the horizontal predictor and yields one row per page. `encode_tiff` is the writer that
goes with it, and the one through which the query stores payloads. Both work on 8-bit samples; the reader also takes 16-bit ones and
either byte order.

Defined cases: a null or unreadable image gives one row with page -1 and the reason in `error`; a directory that
points back to one already seen ends the walk with an error row, as does a page larger than the file can hold; an image without pages gives no further row. Null
text is stored as the empty payload, padded to one row of 576 bytes of value 255. Equal texts give equal bytes. Tiles may be larger than their page by up to
4,096 samples; an image with larger ones is an error row. Repeated rows are images of their own; extra columns are ignored; an empty table gives an empty result.
Everything is a narrow map over rows: no shuffle, and a task holds one Arrow batch of images at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

WIDTH = 576
# Fixed values of the TIFF 6.0 format.
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: No codec here makes more of a byte than this; a page that claims more is not in the file.
LARGEST_RATIO = 4096
_T = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def plain(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(bytes((len(part) - 1,)) + part)

    for run in _RUN.finditer(data):
        plain(run.start())
        at = run.end()
        out.append(bytes((257 - (at - run.start()), data[run.start()])))
    plain(len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


#: Codes between two clear codes, and the width in bits of each: one more once the table has grown to its last code.
_LZW_RUN = 4094 - 258 + 1
_LZW_WIDTHS = np.array([max(9, (259 + j - 1).bit_length()) for j in range(_LZW_RUN)])
_LZW_ENDS = np.r_[0, np.cumsum(_LZW_WIDTHS)]


def _bits(codes: np.ndarray, width: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)


def lzw_encode(data: bytes) -> bytes:
    runs, codes, table, free, code = [], [], {}, 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        known = table.get(key)
        if known is not None:
            code = known
            continue
        codes.append(code)
        table[key] = free
        free, code = free + 1, byte
        if free == 4094:
            runs.append([*codes, 256])
            codes, table, free = [], {}, 258
    runs.append([*codes, *([code] if code >= 0 else []), 257])
    parts = [_bits(np.array([256]), 9)]
    for run in runs:
        values, widths = np.array(run), _LZW_WIDTHS[: len(run)]
        parts += [_bits(values[widths == w], w) for w in range(9, 13)]
    return np.packbits(np.concatenate(parts)).tobytes()


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """The decoded bytes; decoding ends with the table in which `size` is reached."""
    got = 0
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    at, out = 9, []  # past the first clear code
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    while True:
        n = int(np.searchsorted(_LZW_ENDS, len(bits) - at, "right")) - 1
        codes = np.concatenate([bits[at + lo : at + hi].reshape(-1, w) @ (1 << np.arange(w - 1, -1, -1)) for w, lo, hi in _lzw_spans(n)]) if n else np.zeros(0, np.int64)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        if not len(stop):
            raise ValueError("LZW data end without an end code")
        words, last = single.copy(), b""
        for code in codes[: stop[0]].tolist():
            if code < len(words):
                word = words[code]
            elif code == len(words) and last:
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            if last:
                words.append(last + word[:1])
            out.append(word)
            got += len(word)
            last = word
        if codes[stop[0]] == 257 or size is not None and got >= size:
            return b"".join(out)
        at += int(_LZW_ENDS[stop[0] + 1])


def _lzw_spans(n: int) -> list[tuple[int, int, int]]:
    """(width, first bit, end bit) of the first n codes of a run."""
    spans = []
    for width in range(9, 13):
        own = np.flatnonzero(_LZW_WIDTHS[:n] == width)
        if len(own):
            spans.append((width, int(_LZW_ENDS[own[0]]), int(_LZW_ENDS[own[-1] + 1])))
    return spans


def _pack(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6) if compression == DEFLATE else data


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression} is not known")


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of 8-bit pages, (height, width) or (height, width, samples). tile: (height, width), multiples of 16."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        cube = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = cube.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:height, :width] = cube
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, len(padded), th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [cube[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            raw = block.tobytes()
            if compression == PACKBITS:  # each row of a strip is packed by itself
                n = block.shape[1] * samples
                packed = b"".join(packbits_encode(raw[i : i + n]) for i in range(0, len(raw), n))
            else:
                packed = _pack(raw, compression)
            offsets.append(len(out)), counts.append(len(packed))
            out += packed
        tags = {"width": (4, [width]), "height": (4, [height]), "bits": (3, [8] * samples), "compression": (3, [compression]), "photometric": (3, [2 if samples == 3 else 1]), "samples": (3, [samples]), "planar": (3, [1]), "predictor": (3, [predictor])}
        if tile:
            tags |= {"tile_width": (4, [tile[1]]), "tile_height": (4, [tile[0]]), "tile_offsets": (4, offsets), "tile_counts": (4, counts)}
        else:
            tags |= {"strip_offsets": (4, offsets), "rows_per_strip": (4, [rows_per_strip]), "strip_counts": (4, counts)}
        entries = []
        for name, (kind, values) in sorted(tags.items(), key=lambda kv: _T[kv[0]]):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", _T[name], kind, len(values)) + raw.ljust(4, b"\0"))
        if len(out) % 2:
            out += b"\0"
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def read_pages(blob: bytes) -> Iterator[np.ndarray]:
    """Each page of a TIFF as (height, width, samples)."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack_from(order + "H", blob, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", blob, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a cycle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", blob, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
            size = _SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", blob, at + 10 + 12 * i)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{'BHI'[{1: 0, 3: 1, 4: 2}[kind]]}", blob, place)
        one = lambda name, other=None: tags.get(_T[name], (other,))[0]
        width, height, samples = one("width"), one("height"), one("samples", 1)
        compression, predictor, bits = one("compression", 1), one("predictor", 1), one("bits", 1)
        if bits not in (8, 16) or one("planar", 1) != 1 and samples > 1:
            raise ValueError("only interleaved samples of 8 or 16 bits are read")
        dtype = np.dtype(f"{order}u{bits // 8}")
        if width * height * samples * dtype.itemsize > LARGEST_RATIO * len(blob):
            raise ValueError("a page is larger than the file can hold")
        tiled = _T["tile_offsets"] in tags
        bw, bh = (one("tile_width"), one("tile_height")) if tiled else (width, min(height, one("rows_per_strip", height)))
        across = -(-width // bw)
        if bw > width + 4096 or bh > height + 4096:
            raise ValueError("a tile is larger than its page")
        page = np.zeros((-(-height // bh) * bh, across * bw, samples), dtype)
        places = zip(tags[_T["tile_offsets" if tiled else "strip_offsets"]], tags[_T["tile_counts" if tiled else "strip_counts"]])
        for k, (start, length) in enumerate(places):
            y, x = k // across * bh, k % across * bw
            rows = bh if tiled else min(bh, height - y)
            raw = _unpack(blob[start : start + length], compression, rows * bw * samples * dtype.itemsize)
            block = np.frombuffer(raw, dtype, rows * bw * samples).reshape(rows, bw, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
            page[y : y + rows, x : x + bw] = block
        yield page[:height, :width]
        at = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)[0]


def features(samples: np.ndarray) -> str:
    """A short digest of what a page shows: mean, deviation, entropy (bits) of the samples and a 64-bit difference hash."""
    flat = samples.reshape(-1)
    share = np.bincount(flat, minlength=256)[:256] / max(1, flat.size)
    some = share[share > 0]
    levels = np.arange(256)
    mean = float((share * levels).sum())
    sd = float(np.sqrt(max(0.0, (share * levels**2).sum() - mean**2)))
    edges = np.linspace(0, flat.size, 66).astype(np.int64)[:-1]
    sums = np.add.reduceat(flat.astype(np.int64), np.minimum(edges, flat.size - 1))
    sizes = np.maximum(1, np.diff(np.r_[edges, flat.size]))
    cells = sums / sizes
    bits = "".join("1" if b else "0" for b in cells[1:] > cells[:-1])
    return f"mean={mean:.4f};sd={sd:.4f};entropy={-(some * np.log2(some)).sum():.4f};dhash={int(bits, 2):016x}"


#: What a file that is not as it should be can raise on the way.
_BROKEN = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)
_PAGES = "page int, width int, height int, n_samples int, samples binary, feature string, error string"


def decode_pages(df: DataFrame, key: str, image: str) -> DataFrame:
    """One row per page of the TIFF in column `image`: key, page, width, height, n_samples, samples (row by row), feature, error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = {n: [] for n in ("key", "page", "width", "height", "n_samples", "samples", "feature", "error")}

            def add(*values):
                for column, v in zip(rows.values(), values):
                    column.append(v)

            for k, blob in zip(batch.column(0), batch.column(1).to_pylist()):
                k = k.as_py()
                if blob is None:
                    add(k, -1, None, None, None, None, None, "no image")
                    continue
                try:
                    for i, page in enumerate(read_pages(blob)):
                        native = page.astype(page.dtype.newbyteorder("="))
                        add(k, i, page.shape[1], page.shape[0], page.shape[2], native.tobytes(), features(native if native.dtype == np.uint8 else (native >> 8).astype(np.uint8)), None)
                except _BROKEN as e:
                    add(k, -1, None, None, None, None, None, str(e) or type(e).__name__)
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    return df.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInArrow(run, f"key {kind}, {_PAGES}")


#: Rows of a page; a longer payload has more pages.
PAGE_ROWS = 1024


def text_image(payload: bytes) -> bytes:
    """The TIFF that stores a payload of a positive multiple of WIDTH bytes, on as many pages as it needs.

    Its checksum chooses the form: PackBits in strips, LZW or deflate in strips after horizontal differencing, or deflate in tiles.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    form = zlib.crc32(payload) % 4
    if form == 0:
        return encode_tiff(pages, PACKBITS)
    if form == 1:
        return encode_tiff(pages, LZW, predictor=2)
    return encode_tiff(pages, DEFLATE, tile=(16, 192)) if form == 2 else encode_tiff(pages, DEFLATE, predictor=2)


def images_of_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, image): each whole text as a TIFF, padded with bytes 255 to a positive multiple of WIDTH."""

    def run(batches):
        for batch in batches:
            sizes, images = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                images.append(text_image(raw + b"\xff" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "image"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, image binary")


def image_payloads(df: DataFrame, key: str, image: str) -> DataFrame:
    """One row per image: key, n_pages, payload (the samples of its pages end to end), the feature of the whole, and error.

    For payloads that were dealt to pages to be stored. An image that cannot be read has no payload; rows leave in batches of bounded size.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            types = [batch.schema.field(0).type, pa.int32(), pa.binary(), pa.string(), pa.string()]
            made = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["key", "n_pages", "payload", "feature", "error"])
            for k, blob in zip(batch.column(0), batch.column(1)):
                try:
                    pages = [x.tobytes() for x in read_pages(blob.as_py())]
                    payload = b"".join(pages)
                    rows.append((k.as_py(), len(pages), payload, features(np.frombuffer(payload, np.uint8)), None))
                    held += len(payload)
                except _BROKEN as e:
                    rows.append((k.as_py(), None, None, None, str(e) or type(e).__name__))
                if held > C.CHUNK_BYTES:
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()

    return df.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInArrow(run, f"key {kind}, n_pages int, payload binary, feature string, error string")


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = images_of_texts(C.table(spark, sf_dir, "documents")).withColumn("stored", F.struct("doc_id", "n_bytes", F.octet_length("image").cast("long").alias("media_bytes"), F.sha2("image", 256).alias("media_sha256")))
    read = image_payloads(stored, "stored", "image")
    tail = F.crc32(F.substring("payload", -32, 32))
    return read.select(
        "key.doc_id", "key.n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"), "key.media_bytes", "key.media_sha256", "feature", "n_pages", "error",
    )
