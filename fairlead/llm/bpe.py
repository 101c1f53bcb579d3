"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where the splitting pattern is sure to end a match, so pieces can be encoded on their own; a stretch
without such a place is split by the pattern itself and each match is encoded separately. Ids decode to raw bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are handed to the library at once.
PIECE = 65_536
#: Rows whose ids are handed on at once.
SLICE = 500
#: A space between two visible ASCII characters starts a match in every pattern of this family.
_SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """The text in order, as (piece, whether it is short enough for the library)."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + max(size, 2) - 1)
        end = cut.start() if cut else len(text)
        yield text[start:end], end - start <= 4 * size
        start = end
    yield text[start:], True


def encode(text: str, path: str, pattern: str, size: int = PIECE) -> list[int]:
    """Ids of a text, as if it was encoded in one go, special strings taken as ordinary text."""
    library = encoding(path, pattern)
    if len(text) <= size:
        return library.encode_ordinary(text)
    ids: list[int] = []
    for piece, short in pieces(text, size):
        if short:
            ids += library.encode_ordinary(piece)
        else:
            for match in _matcher(pattern).finditer(piece):
                ids += library._core_bpe.encode_single_piece(match.group().encode())
    return ids


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of a list of ids, whether or not they are valid UTF-8."""
    return encoding(path, pattern).decode_bytes(ids)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: their ids and texts are held on both sides of the exchange with Spark."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row's whole text. Null and empty texts have no ids; repeated rows repeat."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            # Four bytes an id: the lists of a whole batch would take ten times as much.
            parts = [np.array(encode(t.as_py() or "", path, pattern), np.int32) for t in batch.column(1)]
            edges = np.cumsum([0, *map(len, parts)])
            ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes) of every row's ``ids``; null ids decode to no bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = pa.array((decode(i.values.to_numpy(zero_copy_only=False).tolist() if i.is_valid else [], path, pattern) for i in batch.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "ids", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(task, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Digests of what ``encoded`` and ``decoded`` return: doc_id, n_tokens, ids_sha256, decoded_sha256.

    With ``with_ids`` the ids follow as an array, which makes the result the encoded corpus.

    One row per input row, repeated rows included. Null and empty texts have no tokens and the digests of no bytes.
    A null doc_id is passed on. Other columns are ignored.
    """
    tokens = encoded(docs, path, pattern)
    written = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"))
    # The row goes through the decoder in the place of its id, so nothing has to be joined back.
    back = decoded(tokens.select(written.alias("doc_id"), "ids"), path, pattern)
    return back.select("doc_id.doc_id", "doc_id.n_tokens", "doc_id.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"), *(["ids"] if with_ids else []))
