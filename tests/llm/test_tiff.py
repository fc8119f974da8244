import struct
import zlib

import numpy as np
import pytest

from curioledger.llm import tiff


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("big", [False, True])
def test_pages_come_back(compression, order, tiled, predictor, big):
    rng = np.random.default_rng(7)
    pages = [
        rng.integers(0, 4, (300, 70, 1), np.uint8),
        rng.integers(0, 256, (5, 3, 3), np.uint8),
        rng.integers(0, 65536, (65, 64, 1)).astype(np.uint16),
        np.zeros((1, 1, 1), np.uint8),
    ]
    data = tiff.write_pages(pages, compression, predictor, tiled, order, big)
    found = [page for _, page in tiff.read_pages(data)]
    assert len(found) == len(pages)
    for ours, theirs in zip(found, pages, strict=True):
        assert (ours == theirs).all()


@pytest.mark.parametrize("size", [0, 1, 2, 255, 256, 257, 3000, 20_000, 70_000])
@pytest.mark.parametrize("symbols", [1, 2, 256])
def test_codes_of_any_length(size, symbols):
    data = np.random.default_rng(size).integers(0, symbols, size, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_codes_as_the_format_has_them():
    # The sample of the format's description, in both codes.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10
    assert tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # Clear, 7, 258, 8, 8, 258, 6, 6, end: nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(stream) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_one_row_per_page(spark):
    grid = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    good = tiff.write_pages([grid, grid + 1], tiff.LZW)
    ring = bytearray(tiff.write_pages([grid], tiff.PLAIN))
    struct.pack_into("<I", ring, len(ring) - 4, struct.unpack_from("<I", ring, 4)[0])
    rows = [(1, good, "x"), (2, None, "x"), (3, b"II*", "x"), (4, bytes(ring), "x"), (1, good, "x"), (None, good, None)]
    files = spark.createDataFrame(rows, "key long, media binary, page string")
    found = tiff.pages(files, "key").collect()
    assert sorted((r["key"] or 0, r["page"]) for r in found if r["error"] is None) == [
        (0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (4, 0),
    ]
    assert sorted(r["key"] for r in found if r["error"]) == [2, 3, 4]
    first = next(r for r in found if r["key"] == 1 and r["page"] == 0)
    assert (first["width"], first["height"], first["samples"], first["bits"]) == (4, 3, 1, 8)
    assert bytes(first["pixels"]) == grid.tobytes()
    assert tiff.pages(files.limit(0), "key").count() == 0


def test_pages_before_a_broken_one_come_too(spark):
    grid = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    data = bytearray(tiff.write_pages([grid, grid + 1], tiff.DEFLATE))
    second = data.rindex(tiff.ENCODERS[tiff.DEFLATE]((grid + 1).tobytes()))
    data[second : second + 4] = b"\xff" * 4
    rows = spark.createDataFrame([(1, bytes(data))], "key long, media binary")
    found = sorted(tiff.pages(rows, "key").collect(), key=lambda r: r["error"] or "")
    assert [(r["page"], r["error"] is None) for r in found] == [(0, True), (None, False)]
    assert bytes(found[0]["pixels"]) == grid.tobytes()


def test_unknown_predictors_are_errors():
    data = bytearray(tiff.write_pages([np.zeros((2, 2, 1), np.uint8)], tiff.PLAIN, predictor=True))
    at = data.index(struct.pack("<HHIH", tiff.TAG_PREDICTOR, 3, 1, 2))
    struct.pack_into("<H", data, at + 8, 3)
    with pytest.raises(ValueError, match="predictor 3"):
        list(tiff.read_pages(bytes(data)))


def test_every_form_serves_many_documents():
    """Codec, layout and predictor go by a hash: each serves over a tenth of the given texts."""
    pq = __import__("pyarrow.parquet", fromlist=["x"])
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[::10]
    seen = {}
    for text in texts:
        payload = tiff.payload_of((text or "").encode())
        tags = [t for t in tiff._Reader(tiff.stored_form(payload)).directories()]
        code = tags[0][tiff.TAG_COMPRESSION][0]
        tiled, predicted = tiff.TAG_TILE_AT in tags[0], tags[0][tiff.TAG_PREDICTOR][0] == 2
        for form in (code, "tiles" if tiled else "strips", "predictor" if predicted else "none"):
            seen[form] = seen.get(form, 0) + 1
        if len(tags) > 1:
            seen["pages"] = seen.get("pages", 0) + 1
    forms = (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE, "strips", "tiles", "predictor", "pages")
    assert all(seen[f] > len(texts) / 10 for f in forms), seen


def test_features_of_texts(spark):
    texts = [None, "", "a", "a", "é" * 40, "ab\n" * 500, "x" * 300_000, "y" * 64]
    schema = "doc_id long, text string, media string, n_bytes string"
    docs = spark.createDataFrame([(k, t, "m", "n") for k, t in enumerate(texts)], schema)
    found = {r["doc_id"]: r for r in tiff.media_features(docs).collect()}
    for k, text in enumerate(texts):
        payload = tiff.payload_of((text or "").encode())
        row = found[k]
        assert row["n_bytes"] == len((text or "").encode())
        assert row["payload_bytes"] == len(payload) == max(64, -(-row["n_bytes"] // 64) * 64)
        assert row["payload_sha256"] == __import__("hashlib").sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])
    assert found[2][1:] == found[3][1:] and found[0][1:] == found[1][1:]
    assert found[6]["feature"].startswith(f"pages={-(-300_032 // 64 // tiff.PAGE_ROWS)};")
    assert tiff.media_features(docs.limit(0)).count() == 0
