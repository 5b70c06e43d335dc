"""Byte-level BPE by a segment tree over byte positions, and decoding.

Each match of the pattern is encoded by itself: a whole match that is a token is
that token; otherwise a segment tree holds, for every position of a live piece,
the rank of its pair with the next piece, and its root the leftmost minimum. A
merge is three point updates, so a match of n bytes takes O(n log n) steps.
Distinct matches are encoded once per worker while the cache lasts; a full cache
becomes the older generation and the one before it goes, so memory is bounded.

Null text is an empty one: no ids. Rows are independent, repeats agree, texts are
never cut. Extra columns are ignored. The rank file is read from its path on
every executor and never copied.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_worker, scratch

CACHE, ROWS = 150_000, 256
#: Above every rank; vocabularies are smaller.
NO_RANK = (1 << 24) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a file of base64 and number lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match of the pattern.

    ``tree`` is the segment tree over the m places where two bytes meet: leaf m + i
    holds (rank, i) of the pair of pieces that starts at byte i as one number, an
    inner node the lower of its two, so tree[1] is the leftmost minimum of all.
    Numbers stay as small as the match allows.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if not n:
        return []
    m = n - 1
    shift = n.bit_length()
    place, dead = (1 << shift) - 1, NO_RANK << shift
    tree = [dead] * max(m, 2)
    tree[m:] = [get(piece[i : i + 2], NO_RANK) << shift | i for i in range(m)]
    for i in range(m - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 2))  # of the live piece that starts here
    before = list(range(-1, n + 1))  # start of the live piece before
    while (low := tree[1]) < dead:
        a = low & place
        b = end[a]
        end[a] = c = end[b]
        before[c] = a
        p = before[a]
        # the pair of b is gone, those of a and of the piece before it are new
        if c < n:
            i, value = m + b, dead
            while i and tree[i] != value:
                tree[i] = value
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
            value = get(piece[a : end[c]], NO_RANK) << shift | a
        else:
            value = dead
        i = m + a
        while i and tree[i] != value:
            tree[i] = value
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
        if p >= 0:
            i, value = m + p, get(piece[p:c], NO_RANK) << shift | p
            while i and tree[i] != value:
                tree[i] = value
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Pieces(dict):
    """Matches to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = encode_piece(piece.encode("utf-8"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.findall = regex.compile(pattern).findall
        self.pieces = Pieces(self.ranks)

    def encode(self, text: str) -> bytes:
        """Packed ids of the text."""
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder; its cache serves the worker's later tasks too."""
    if (path, pattern) not in scratch:
        fresh_worker()
        scratch[path, pattern] = ByteBpe(path, pattern)
    return scratch[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, and of ids and decoded what ``keep`` names.

    Rows leave the worker ROWS at a time, so long outputs don't pile up.
    """
    kinds = {"ids": pa.binary(), "decoded": pa.binary()}
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [(k, kinds[k]) for k in keep])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = coder(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), []
                for node, text in zip(part.column(0).to_pylist(), part.column(1)):
                    packed = bpe.encode(text.as_py() or "")
                    decoded = bpe.decode(packed)
                    own = {"ids": packed, "decoded": decoded}
                    out.append((node, len(packed) // 4, sha(packed), sha(decoded), *[own[k] for k in keep]))
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    ddl = ", ".join(["id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *[f"{k} binary" for k in keep]])
    return rows.mapInArrow(run, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: ids of every document and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=())
    return out.withColumnRenamed("id", "doc_id")
