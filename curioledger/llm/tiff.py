"""TIFF media columns: pages out of stored bytes, and texts stored as pages.

Reading walks the chain of image directories, classic or big, in either byte order; strips and
tiles are decoded from PackBits, LZW, deflate or plain bytes, horizontal predictors undone, and
edge tiles cut to the page. ``pages`` emits one row per page.

Writing serves the query: a payload goes into 8-bit grey pages of 64 columns and 32 rows. A hash of
the payload, whatever its length, chooses between LZW, PackBits and deflate, strips and tiles, and
with or without a predictor, so each of them is written and read at every size.
"""

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle

WIDTH = 64
PAGE_ROWS = 32
STRIP_ROWS = 16
TILE = 32

# Fixed values of the format: tag numbers, compression numbers, and bytes of a value by type.
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_AT, TAG_SAMPLES, TAG_STRIP_ROWS, TAG_STRIP_BYTES, TAG_PLANAR = 273, 277, 278, 279, 284
TAG_PREDICTOR, TAG_TILE_WIDTH, TAG_TILE_HEIGHT, TAG_TILE_AT, TAG_TILE_BYTES = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
INTEGERS = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}

PAGE = "page int, width int, height int, samples int, bits int, compression int, pixels binary"


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


# Three to 128 equal bytes.
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def plain(start: int, end: int) -> None:
        for k in range(start, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(bytes([len(part) - 1]) + part)

    for run in _RUN.finditer(data):
        plain(at, run.start())
        out.append(bytes([257 - len(run[0]), data[run.start()]]))
        at = run.end()
    plain(at, len(data))
    return b"".join(out)


_CLEAR, _END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a width grows one code early, as the format has it."""
    out = bytearray()
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            table = [bytes([b]) for b in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table:
            raise ValueError("an LZW stream begins with a clear code")
        if code < len(table):
            entry = table[code]
        elif last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code ahead of its table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Strings are known by the code of all but their last byte, and that byte."""
    held, bits, width = _CLEAR, 9, 9
    table: dict[int, int] = {}
    following, prefix = 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        longer = prefix << 8 | byte
        code = table.get(longer)
        if code is not None:
            prefix = code
            continue
        held, bits = held << width | prefix, bits + width
        table[longer] = following
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
        if following == 4094:
            held, bits = held << width | _CLEAR, bits + width
            table = {}
            following, width = 258, 9
        prefix = byte
    if prefix >= 0:
        held, bits = held << width | prefix, bits + width
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    held, bits = held << width | _END, bits + width
    pad = -bits % 8
    return (held << pad).to_bytes((bits + pad) // 8, "big")


DECODERS = {
    PLAIN: bytes,
    LZW: lzw_decode,
    DEFLATE: zlib.decompress,
    OLD_DEFLATE: zlib.decompress,
    PACKBITS: unpack_bits,
}
ENCODERS = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


class _Reader:
    """Directories of one file."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None:
            raise ValueError("no TIFF byte order")
        magic = self.number("H", 2)
        if magic not in (42, 43):
            raise ValueError("no TIFF magic number")
        self.big = magic == 43

    def number(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def directories(self) -> Iterator[dict[int, list[int]]]:
        """Integer tags of each directory; a chain that turns back on itself is an error."""
        word, count, entry, head = ("Q", "Q", 20, 8) if self.big else ("I", "H", 12, 4)
        at, seen = self.number(word, head), set()
        while at:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            entries = self.number(count, at)
            at += struct.calcsize(count)
            tags = {}
            for k in range(entries):
                own = at + k * entry
                tag, kind = self.number("H", own), self.number("H", own + 2)
                number = self.number(word, own + 4)
                value = own + 4 + struct.calcsize(word)
                if TYPE_BYTES.get(kind, 1) * number > struct.calcsize(word):
                    value = self.number(word, value)
                if kind in INTEGERS:
                    tags[tag] = list(struct.unpack_from(f"{self.order}{number}{INTEGERS[kind]}", self.data, value))
            yield tags
            at = self.number(word, at + entries * entry)

    def part(self, tags: dict, at: int, size: int, rows: int, columns: int) -> np.ndarray:
        """One strip or tile as rows, columns and samples."""
        code = tags.get(TAG_COMPRESSION, [PLAIN])[0]
        if code not in DECODERS:
            raise ValueError(f"compression {code}")
        samples = 1 if tags.get(TAG_PLANAR, [1])[0] == 2 else tags.get(TAG_SAMPLES, [1])[0]
        bits = tags.get(TAG_BITS, [1])[0]
        if bits not in (8, 16):
            raise ValueError(f"samples of {bits} bits")
        kind = np.dtype(f"{self.order}u{bits // 8}")
        raw = DECODERS[code](self.data[at : at + size])
        wanted = rows * columns * samples * kind.itemsize
        if len(raw) < wanted:
            raise ValueError("a strip or tile is too short")
        part = np.frombuffer(raw[:wanted], kind).reshape(rows, columns, samples)
        predictor = tags.get(TAG_PREDICTOR, [1])[0]
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor}")
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        return part

    def page(self, tags: dict) -> np.ndarray:
        width, height = tags[TAG_WIDTH][0], tags[TAG_HEIGHT][0]
        samples, planes = tags.get(TAG_SAMPLES, [1])[0], 1
        if tags.get(TAG_PLANAR, [1])[0] == 2:
            planes, samples = samples, 1
        kind = np.dtype(f"{self.order}u{tags.get(TAG_BITS, [1])[0] // 8 or 1}")
        out = np.zeros((height, width, samples * planes), kind)
        if TAG_TILE_AT in tags:
            deep, wide = tags[TAG_TILE_HEIGHT][0], tags[TAG_TILE_WIDTH][0]
            places = [(y, x) for y in range(0, height, deep) for x in range(0, width, wide)]
            starts, sizes = tags[TAG_TILE_AT], tags[TAG_TILE_BYTES]
        else:
            deep, wide = min(tags.get(TAG_STRIP_ROWS, [height])[0], height) or 1, width
            places = [(y, 0) for y in range(0, height, deep)]
            starts, sizes = tags[TAG_STRIP_AT], tags[TAG_STRIP_BYTES]
        for plane in range(planes):
            own = slice(plane * len(places), (plane + 1) * len(places))
            for (y, x), at, size in zip(places, starts[own], sizes[own], strict=True):
                rows = deep if TAG_TILE_AT in tags else min(deep, height - y)
                part = self.part(tags, at, size, rows, wide)
                part = part[: height - y, : width - x]
                out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + samples] = part
        return out


def read_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Tags and samples of every page, in the order of the directories."""
    reader = _Reader(data)
    for tags in reader.directories():
        yield tags, reader.page(tags)


def write_pages(pages: list[np.ndarray], compression: int, predictor: bool = False, tiled: bool = False, order: str = "<", big: bool = False) -> bytes:
    """A file of grey or multi-sample pages of 8 or 16 bits."""
    word, count, entry, head = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "H", 43 if big else 42))
    out += struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)
    for page in pages:
        height, width, samples = page.shape
        kind = page.dtype.newbyteorder(order)
        deep, wide = (TILE, TILE) if tiled else (STRIP_ROWS, width)
        starts, sizes = [], []
        for y in range(0, height, deep):
            for x in range(0, width, wide):
                part = page[y : y + deep, x : x + wide]
                if tiled and part.shape[:2] != (deep, wide):
                    tile = np.zeros((deep, wide, samples), page.dtype)
                    tile[: part.shape[0], : part.shape[1]] = part
                    part = tile
                if predictor:
                    part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
                raw = ENCODERS[compression](part.astype(kind).tobytes())
                starts.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = {
            TAG_WIDTH: [width],
            TAG_HEIGHT: [height],
            TAG_BITS: [8 * page.dtype.itemsize] * samples,
            TAG_COMPRESSION: [compression],
            TAG_PHOTOMETRIC: [2 if samples == 3 else 1],
            TAG_SAMPLES: [samples],
            TAG_PREDICTOR: [2 if predictor else 1],
        }
        if tiled:
            tags |= {TAG_TILE_WIDTH: [wide], TAG_TILE_HEIGHT: [deep], TAG_TILE_AT: starts, TAG_TILE_BYTES: sizes}
        else:
            tags |= {TAG_STRIP_AT: starts, TAG_STRIP_ROWS: [deep], TAG_STRIP_BYTES: sizes}
        placed = []
        for tag in sorted(tags):
            short = max(tags[tag]) < 65536 and tag not in (TAG_STRIP_AT, TAG_TILE_AT)
            kind_number, kind_code = (3, "H") if short else (4, "I")
            value = struct.pack(f"{order}{len(tags[tag])}{kind_code}", *tags[tag])
            room = struct.calcsize(word)
            if len(value) > room:
                at = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack(order + word, at)
            placed.append(struct.pack(order + "HH" + word, tag, kind_number, len(tags[tag])) + value.ljust(room, b"\0"))
        # The directory before, or the header, points here.
        struct.pack_into(order + word, out, head, len(out))
        out += struct.pack(order + count, len(placed)) + b"".join(placed)
        head = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


def payload_of(text: bytes | None) -> bytes:
    """A text's bytes, filled with zeros to a positive multiple of the width."""
    data = text or b""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def stored_form(payload: bytes) -> bytes:
    """The payload as a TIFF of grey pages, in the form that its hash chooses."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    pages = [grid[at : at + PAGE_ROWS] for at in range(0, len(grid), PAGE_ROWS)]
    mark = hashlib.sha256(payload).digest()
    # Half of the texts go by deflate, which packs them best, a quarter by each of the others.
    compression = (LZW, PACKBITS, DEFLATE, DEFLATE)[mark[0] % 4]
    # Texts gain nothing from differences of neighbours, so fewer have them.
    return write_pages(pages, compression, predictor=mark[1] % 4 == 0, tiled=mark[2] % 2 == 0)


def media_column(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: every whole text stored as TIFF; null texts are empty."""

    def store(texts: pd.Series) -> pd.Series:
        return pd.Series([stored_form(payload_of(t)) for t in texts], dtype=object)

    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), F.pandas_udf(store, "binary")(text).alias("media"))


def page_rows(data: bytes | None) -> Iterator[dict]:
    """The pages of a file as rows; where it breaks, a row with the error follows those decoded."""
    names = [field.split()[0] for field in PAGE.split(", ")] + ["error"]
    try:
        for number, (tags, page) in enumerate(read_pages(data or b"")):
            little = page.astype(page.dtype.newbyteorder("<"))
            code = tags.get(TAG_COMPRESSION, [PLAIN])[0]
            height, width, samples = page.shape
            bits = 8 * page.dtype.itemsize
            values = (number, width, height, samples, bits, code, little.tobytes(), None)
            yield dict(zip(names, values, strict=True))
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as broken:
        yield dict.fromkeys(names) | {"error": f"{type(broken).__name__}: {broken}"}


def pages(media: DataFrame, key: str, content: str = "media") -> DataFrame:
    """One row per page of every file: the key, ``PAGE`` columns, and ``error`` where a file breaks.

    Null files give one row with an error and no page; of a file that breaks later the pages before
    come too. Pixels are samples row by row in little-endian order. Repeated rows each give their
    pages; an empty table none.
    """

    def read(files: pd.Series) -> pd.Series:
        return pd.Series([list(page_rows(data)) for data in files])

    fields = PAGE.replace(" int", ":int").replace(" binary", ":binary")
    kind = f"array<struct<{fields.replace(', ', ',')},error:string>>"
    rows = media.select(F.col(key), F.explode(F.pandas_udf(read, kind)(F.col(content))).alias("_p"))
    return rows.select(key, "_p.*")


def _features(grid: np.ndarray, count: int) -> str:
    """Pages, mean and spread in thousandths, entropy in thousandths of a bit, and an average hash."""
    flat = grid.reshape(-1)
    seen = np.bincount(flat, minlength=256)
    share = seen[seen > 0] / len(flat)
    total = int((seen * np.arange(256)).sum())
    squares = int((seen * np.arange(256) ** 2).sum())
    n = len(flat)
    mean, variance = 1000 * total // n, (1000 * (squares * n - total * total)) // (n * n)
    entropy = round(-float((share * np.log2(share)).sum()) * 1000) + 0
    bands = np.add.reduceat(flat.astype(np.int64), np.arange(64) * n // 64) * 64
    bits = "".join("1" if b > total else "0" for b in bands)
    return f"pages={count};mean={mean};variance={variance};entropy={entropy};hash={int(bits, 2):016x}"


def _described(files: pd.Series) -> pd.DataFrame:
    """The features of files from the rows of their pages, as ``pages`` emits them."""
    rows = []
    for data in files:
        found = list(page_rows(data))
        if found[-1]["error"]:
            raise ValueError(found[-1]["error"])
        payload = b"".join([page["pixels"] for page in found])
        grid = np.frombuffer(payload, np.uint8)
        rows.append(
            (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-WIDTH:]),
                len(data),
                hashlib.sha256(data).hexdigest(),
                _features(grid, len(found)),
            )
        )
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pd.DataFrame(rows, columns=names)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every whole text of ``docs(doc_id, text)`` as TIFF, read it back and describe it.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature``. A null text is an empty one, and both are 64 zeros; long texts make
    several pages; equal texts give equal values; repeated rows and null ids each come back; an
    empty table gives no rows. Other columns are not read.
    """
    stored = settle(media_column(docs))
    kind = (
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string"
    )
    described = F.pandas_udf(_described, kind)(F.col("media"))
    return stored.select("doc_id", "n_bytes", described.alias("d")).select("doc_id", "n_bytes", "d.*")
