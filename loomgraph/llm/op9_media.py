"""Media columns: payloads stored in progressive JPEG files, and RGB tensors from them.

A payload of 64 n bytes is n blocks of a colour picture with chroma of half the
resolution: of six blocks in a row four are luminance, then one of each chroma, as a
macroblock has them; byte b is the quantized coefficient b + 256, the format's own
unit, so nothing is lost. The file has a scan for the lowest coefficients of all
components, scans for spectral bands of each, and one more of each for the lowest bit.
It is read back by accumulating its scans into coefficient arrays; the payload is the
coefficients, the features come from the full-resolution RGB tensor: inverse
transform, chroma repeated to full resolution, colours converted.

Null text is an empty payload, one block of zeros. Texts are whole, whatever their
length (a wide picture where one column of macroblocks would be too high). Equal texts
give equal files. Rows are independent; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import progressive_jpeg as jpeg

OFFSET, HIGHEST = 256, 4095
#: Spectral bands of the luminance and of each chroma.
BANDS, CHROMA = ((1, 5), (6, 63)), ((1, 63),)


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of 64."""
    return data + b"\x00" * (-len(data) % 64 or (0 if data else 64))


def store(payload: bytes) -> bytes:
    """The file of a payload whose length is a positive multiple of 64."""
    n = len(payload) // 64
    units = -(-n // 6)
    across = -(-units // HIGHEST)
    down = -(-units // across)
    coefs = np.full((down * across * 6, 64), OFFSET, np.int32)
    coefs[:n] += np.frombuffer(payload, np.uint8).reshape(n, 64)
    coefs = coefs.reshape(down, across, 6, 64)
    luma = coefs[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * down, 2 * across, 64)
    parts = [jpeg.Component(luma, 2, 2), jpeg.Component(coefs[:, :, 4]), jpeg.Component(coefs[:, :, 5])]
    return jpeg.encode(jpeg.Image(16 * across, 16 * down, parts, struct.pack(">Q", n)), BANDS, 1, CHROMA)


def load(media: bytes) -> tuple[bytes, jpeg.Image]:
    """(payload, image) of a stored file."""
    image = jpeg.decode(media)
    n = struct.unpack(">Q", image.comment)[0]
    luma, cb, cr = (p.coefs for p in image.parts)
    down, across = cb.shape[:2]
    coefs = np.empty((down, across, 6, 64), np.int32)
    coefs[:, :, :4] = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    coefs[:, :, 4], coefs[:, :, 5] = cb, cr
    return (coefs.reshape(-1, 64)[:n] - OFFSET).astype(np.uint8).tobytes(), image


def features(rgb: np.ndarray) -> str:
    """Size and the channels' rounded means and deviations of an RGB tensor."""
    out, squares = [f"{rgb.shape[1]}x{rgb.shape[0]}"], np.arange(256, dtype=np.int64) ** 2
    n = rgb.shape[0] * rgb.shape[1]
    for k in range(3):
        counts = np.bincount(rgb[..., k].reshape(-1), minlength=256)
        mean = int(counts @ np.arange(256)) / n
        out.append(f"{mean:.3f}±{max(0.0, int(counts @ squares) / n - mean**2) ** 0.5:.3f}")
    return " ".join(out)


_TENSOR = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text in a file of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(run, "id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of stored files (id, n_bytes, media), without the files."""

    def run(batches):
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for media in batch.column(2):
                m = media.as_py()
                payload, image = load(m)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(jpeg.to_rgb(image))))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    return stored.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def rgb_tensors(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, width, height, rgb): full-resolution tensors, height x width x 3 bytes; null media, null tensor."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))

    def run(batches):
        for batch in batches:
            for node, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = m.as_py()
                rgb = None if data is None else jpeg.to_rgb(jpeg.decode(data))
                row = (node, None, None, None) if rgb is None else (node, rgb.shape[1], rgb.shape[0], rgb.tobytes())
                yield pa.record_batch([pa.array([x], t.type) for x, t in zip(row, _TENSOR)], schema=_TENSOR)

    return rows.mapInArrow(run, "id long, width int, height int, rgb binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's text stored as a progressive JPEG and read back."""
    out = read_back(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.withColumnRenamed("id", "doc_id")
