"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is encoded separately.  A segment tree over the byte positions of a piece
holds, at every node, the least rank of the pairs that start below it; the leftmost least pair is found from
the root, and a merge makes three point updates (the pair before, the merged pair, the position that vanished),
so a piece of n bytes takes O(n log n) whatever its length.  Pieces are remembered in a bounded cache of two
generations (some 70 MB a worker), which a worker forgets when it goes on to another operator.

Defined results: null text is encoded as empty text; an empty text has no ids; ids are little-endian unsigned
32-bit integers in a binary column; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import CACHES, appended, documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = 1 << 62
CACHED_PIECES, CACHED_BYTES = 200_000, 64  # a generation of pieces, and the longest piece that is remembered


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: merge the leftmost pair of least rank until no pair is in the vocabulary."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * leaves)
    get = ranks.get
    for i in range(n - 1):
        tree[leaves + i] = get(piece[i : i + 2], NONE)
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) < NONE:
        node = 1
        while node < leaves:
            node += node
            if tree[node] != least:
                node += 1
        i = node - leaves
        j = after[i]
        k = after[i] = after[j]
        tree[leaves + j] = NONE
        if k < n:
            before[k] = i
            tree[node] = get(piece[i : after[k]], NONE)
        else:
            tree[node] = NONE
        changed = (node, leaves + j)
        if (h := before[i]) >= 0:
            tree[leaves + h] = get(piece[h:k], NONE)
            changed = (leaves + h, node, leaves + j)
        for node in changed:  # each walks up as far as anything changes
            node >>= 1
            while node:
                left, right = tree[node + node], tree[node + node + 1]
                if right < left:
                    left = right
                if tree[node] == left:
                    break
                tree[node] = left
                node >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """piece (str) -> its packed ids.  A full generation becomes the old one, of which only what is used again stays."""

    def __init__(self, ranks, most: int):
        super().__init__()
        self.ranks, self.old, self.most = ranks, {}, most

    def __missing__(self, piece: str) -> bytes:
        if (packed := self.old.get(piece)) is None:
            data = piece.encode("utf-8")
            ids = merge_piece(data, self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) > CACHED_BYTES:
                return packed
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary file of base64 token and rank lines."""

    def __init__(self, path: str, pattern: str, pieces: int = CACHED_PIECES):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (1 + max(self.ranks.values(), default=0))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # the library's \s is Unicode's White_Space, without the four information separators
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pieces = _Pieces(self.ranks, pieces)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, pieces: int = CACHED_PIECES) -> Codec:
    return Codec(path, pattern, pieces)


CACHES["bpe"] = codec.cache_clear


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add the ids of each whole text as packed little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(VOCABULARY)
    return appended(df, text_col, [(ids_col, T.BinaryType(), pa.binary())], lambda text: (codec(path, pattern).encode(text or ""),), "bpe")


def decode(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add the bytes of packed ids; null ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    return appended(df, ids_col, [(bytes_col, T.BinaryType(), pa.binary())], lambda packed: (codec(path, pattern).decode(packed or b""),), "bpe")


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN, pieces: int = CACHED_PIECES) -> DataFrame:
    """Add the ids of each whole text and the bytes that they decode to, in one pass; ``pieces`` bounds a worker's cache."""
    path = path or public_tokenizers.path(VOCABULARY)

    def both(text):
        own = codec(path, pattern, pieces)
        packed = own.encode(text or "")
        return packed, own.decode(packed)

    return appended(df, text_col, [(ids_col, T.BinaryType(), pa.binary()), (bytes_col, T.BinaryType(), pa.binary())], both, "bpe")


def digests(docs: DataFrame, keep: list[str] = (), pieces: int = CACHED_PIECES) -> DataFrame:
    """doc_id, the kept columns, n_tokens, ids_sha256, decoded_sha256 of documents."""
    back = round_trip(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").cast("string").alias("text")), pieces=pieces)
    return back.select(
        "doc_id", *keep, F.expr("div(octet_length(token_ids), 4)").cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES = {}
