"""Hierarchical multi-length packing of documents into training sequences.

Each document is cut into whole windows and a rest. Rests are routed to context tiers by length, and
each tier is packed into windows of its own size, from the longest tier down: a rest opens a window
of its tier, and the gap is filled with the longest rests of the shorter tiers that fit. Windows that
stay open are dissolved, emptiest first: their rests are cut into powers of two, which fill the gaps
of the others exactly. So the windows of every tier end full, and at most one sequence per group of
documents is padded. At last the sequences of a group are dealt to steps of like numbers of tokens.

Cuts depend on the document alone, so one pass tokenises and sums up all pieces; what is shuffled
is one narrow row per document. Groups are dealt by a hash of id and place of a row, so that equal rows
do not meet, and packed on their own.
"""

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .tokens import encoder

WINDOW = 1024
TIERS = (64, 128, 256, 512, 1024)
GROUP_DOCS = 8192
STEP_SEQUENCES = 64
END_ID = 0

_CUTS = "tokens long, whole array<long>, rest_crc long, part_crcs array<long>"


def parts_of(rest: int) -> list[int]:
    """The powers of two that make up a rest, largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cutter(path: str, doc_id: pa.Field):
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
    names = ["tokens", "whole", "rest_crc", "part_crcs"]
    schema = pa.schema([doc_id, *map(pa.field, names, kinds)])
    end = END_ID.to_bytes(4, "little")

    def cut(text: str | None) -> tuple:
        ids = encoder(path).packed(text or "") + end
        tokens = len(ids) // 4
        at = tokens // WINDOW * WINDOW
        whole = [zlib.crc32(ids[4 * k : 4 * (k + WINDOW)]) for k in range(0, at, WINDOW)]
        rest_crc, crcs = zlib.crc32(ids[4 * at :]), []
        for part in parts_of(tokens - at):
            crcs.append(zlib.crc32(ids[4 * at : 4 * (at + part)]))
            at += part
        return tokens, whole, rest_crc, crcs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(text.as_py()) for text in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(doc_id.type), *arrays], schema=schema)

    return run


def plan(rests: list[int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(row, start, length)`` within the rests; every token lies in one."""
    by_length: dict[int, list[int]] = {}
    for row, rest in enumerate(rests):
        if rest:
            by_length.setdefault(rest, []).append(row)
    lengths = sorted(by_length)

    def take(most: int) -> tuple[int, int] | None:
        at = bisect_right(lengths, most) - 1
        if at < 0:
            return None
        length = lengths[at]
        row = by_length[length].pop()
        if not by_length[length]:
            del lengths[at]
        return row, length

    # The longest rest left opens a window of its tier; only shorter ones are there to fill it.
    full, open_ = [], []
    while found := take(WINDOW):
        pieces, gap = [], TIERS[bisect_left(TIERS, found[1])]
        while found:
            pieces.append((found[0], 0, found[1]))
            gap -= found[1]
            found = take(gap) if gap else None
        (open_ if gap else full).append((gap, pieces))
    full = [pieces for _, pieces in full]

    # Emptiest windows are dissolved until their parts close all gaps that are left.
    open_.sort(key=lambda w: (w[0], w[1]))
    parts: dict[int, list[tuple[int, int, int]]] = {}
    sizes: list[int] = []

    def give(piece: tuple[int, int, int]) -> None:
        parts.setdefault(piece[2], []).append(piece)
        insort(sizes, piece[2])

    def fill(pieces: list, gap: int) -> int:
        while gap and (at := bisect_right(sizes, gap) - 1) >= 0:
            size = sizes.pop(at)
            pieces.append(parts[size].pop())
            gap -= size
        return gap

    while open_:
        open_ = [(fill(pieces, gap), pieces) for gap, pieces in open_]
        full += [pieces for gap, pieces in open_ if not gap]
        open_ = sorted(((g, p) for g, p in open_ if g), key=lambda w: (w[0], w[1]))
        if open_:
            for row, start, length in open_.pop()[1]:
                for part in parts_of(length):
                    give((row, start, part))
                    start += part

    # Powers of two, largest first, close windows exactly; the last ones stand in their own tier.
    while sizes and sum(sizes) >= WINDOW:
        pieces: list = []
        fill(pieces, WINDOW)
        full.append(pieces)
    last: list = []
    while sizes:
        size = sizes.pop()
        piece = parts[size].pop()
        if size >= TIERS[0]:
            full.append([piece])
        else:
            last.append(piece)
    return full + [last] if last else full


def _packer(doc_id: pa.Field):
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
    schema = pa.schema([doc_id, *(pa.field(n, pa.int64()) for n in names)])

    def pack(rows: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("tokens", "ascending"), ("rest_crc", "ascending")]
        rows = rows.sort_by(order)
        group = rows["group"][0].as_py()
        tokens = rows["tokens"].to_pylist()
        whole, rest_crc, part_crcs = (rows[c].to_pylist() for c in ("whole", "rest_crc", "part_crcs"))

        def crc(row: int, start: int, length: int) -> int:
            rest = tokens[row] % WINDOW
            if length == rest:
                return rest_crc[row]
            # Parts come in descending powers of two: those before this one are the higher bits.
            return part_crcs[row][(rest // (2 * length)).bit_count()]

        sequences = [
            [(row, WINDOW * k, WINDOW, value)]
            for row, crcs in enumerate(whole)
            for k, value in enumerate(crcs)
        ]
        for pieces in plan([t % WINDOW for t in tokens]):
            sequences.append([(r, tokens[r] // WINDOW * WINDOW + s, n, crc(r, s, n)) for r, s, n in pieces])

        lengths = np.array([sum(p[2] for p in s) for s in sequences], np.int64)
        tiers = np.array(TIERS)[np.searchsorted(TIERS, lengths)]
        # Longest first, there and back over the steps, so that steps hold like numbers of tokens.
        steps = -(-len(sequences) // STEP_SEQUENCES)
        turn, place = np.divmod(np.arange(len(sequences)), max(steps, 1))
        step = np.empty(len(sequences), np.int64)
        step[np.argsort(-lengths, kind="stable")] = np.where(turn % 2, steps - 1 - place, place)

        out, picked = [], []
        for number, pieces in enumerate(sequences):
            offset = 0
            base = ((group << 32) + number, int(tiers[number]), (group << 32) + int(step[number]))
            for row, start, length, value in pieces:
                picked.append(row)
                out.append((start, length, value, tokens[row], base[0], offset, *base[1:]))
                offset += length
        arrays = np.array(out, np.int64).reshape(-1, len(names)).T
        ids = rows["doc_id"].take(pa.array(picked, pa.int64())).combine_chunks()
        return pa.Table.from_arrays([ids, *map(pa.array, arrays)], schema=schema)

    return pack


def pack(docs: DataFrame, tokenizer: str, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` in sequences of at most ``WINDOW`` tokens.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every machine. Returns
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and the context ``tier``
    and ``step_id`` of the sequence. A null or empty text is the end id alone; long texts make as
    many whole windows as they fill; repeated rows and null ids are packed like any other; equal
    lengths are taken in order of doc_id; an empty table gives no rows. Other columns are not read.
    """
    # Not the name of a column, so nothing of the table can clash with it.
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_id = pa.field("doc_id", {"int": pa.int32()}.get(kind, pa.int64()))
    texts = docs.select(F.col("doc_id"), F.col("text"))
    cut = texts.mapInArrow(_cutter(tokenizer, doc_id), f"doc_id {kind}, {_CUTS}")
    cut = settle(cut.withColumn("place", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group_docs))
    # Not the hash of the doc_id itself, by which the rows of a group would share a shuffle partition.
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "place", F.lit(6)), F.lit(groups))).drop("place")
    pieces = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long, tier long, step_id long"
    )
    return dealt.groupBy("group").applyInArrow(_packer(doc_id), pieces)
