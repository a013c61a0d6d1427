"""Problem 7: encode every document with a public byte-level BPE vocabulary.

Each text is cut by the vocabulary's pattern into pieces; the merges of a piece run on a segment tree
over its byte positions. A leaf holds the rank of the pair that starts at that position, an inner node
the least rank below it, so the leftmost pair of least rank is found by one descent and a merge costs
three point updates, O(n log n) for a piece of n bytes even where a script writes no blanks. Pieces
repeat, so each Python worker keeps a bounded table of pieces it has met.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from noteloom.session import spread, table

#: Splits text before the merges of a rank file (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; beyond it the table starts anew.
PIECES_KEPT = 200_000
NONE = 1 << 30


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by merging the leftmost pair of least rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    end = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))  # where the token before it starts
    for i in range(n - 1):
        tree[width + i] = ranks.get(piece[i : i + 2], NONE)
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(leaf: int, rank: int) -> None:
        node = width + leaf
        tree[node] = rank
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while (least := tree[1]) < NONE:
        node = 1
        while node < width:
            node = 2 * node if tree[2 * node] == least else 2 * node + 1
        at = node - width
        gone = end[at]
        stop = end[at] = end[gone]
        put(gone, NONE)
        if stop < n:
            before[stop] = at
            put(at, ranks.get(piece[at : end[stop]], NONE))
        else:
            put(at, NONE)
        if at:
            put(before[at], ranks.get(piece[before[at] : stop], NONE))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


#: Pieces by vocabulary (the hash of its file).
_kept: dict[str, dict[str, list[int]]] = {}


def encode(text: str | None, ranks: dict[bytes, int], pattern, kept: dict[str, list[int]] | None = None) -> list[int]:
    """The ids of a text; null and empty texts have none. Special tokens have no meaning here. ``kept`` remembers
    the pieces of this vocabulary."""
    ids: list[int] = []
    if not text:
        return ids
    kept = {} if kept is None else kept
    for piece in pattern.findall(text):
        found = kept.get(piece)
        if found is None:
            found = merge_piece(piece.encode("utf-8", "surrogatepass"), ranks)
            if len(kept) >= PIECES_KEPT:
                kept.clear()
            if len(piece) <= 256:
                kept[piece] = found
        ids += found
    return ids


def encode_documents(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, ids: bool = True
) -> DataFrame:
    """One row for each row of ``documents``: its id and ``ids`` (array<int>), or with ``ids=False``
    ``n_tokens`` alone.

    Null and empty texts have an empty list (0 tokens); strings that look like special tokens are
    ordinary text; repeated rows stay repeated; extra columns are ignored. The vocabulary (a fixed file
    of about 1 MB) is the only thing broadcast."""
    import regex

    spark = documents.sparkSession
    path = path or vocabulary_path()
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    with open(path, "rb") as source:
        vocabulary = hashlib.file_digest(source, "sha256").hexdigest()
    pattern_text = PATTERN

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, table_of_ranks = regex.compile(pattern_text), ranks.value
        kept = _kept.setdefault(vocabulary, {})
        for batch in stream:
            # a batch may hold very long texts: the result leaves in slices
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [encode(t, table_of_ranks, pattern, kept) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = np.fromiter((i for one in found for i in one), dtype=np.int32, count=int(offsets[-1]))
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                else:
                    out = pa.array(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[id_column, "ids" if ids else "n_tokens"])

    kind = dict(documents.dtypes)[id_column]
    return spread(documents.select(id_column, text_column), id_column).mapInArrow(
        batches, f"`{id_column}` {kind}, " + ("ids array<int>" if ids else "n_tokens int")
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
