"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Long texts are cut before the library's own pattern runs, at places where a match of the pattern must end
anyway, so memory and time of one call stay bounded and the ids are those of the whole text. Decoding joins the
raw bytes of the ids, which need not be whole characters one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fernsift.llm.shared import arrow_rows, column, pieces_of

PIECE = 1 << 16
#: A match ends between these two characters, whatever stands around them: a letter or digit before white
#: space; else a letter or digit before another class (but not beside what special tokens are made of).
_AT_SPACE = regex.compile(r"[\p{L}\p{N}](?=\s)")
_AT_CLASS = regex.compile(r"\p{L}(?=[^\p{L}\s'|<>])|\p{N}(?=[^\p{N}\s'|<>])")


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a text into pieces of about ``size`` that are encoded apart with the same result.

    A stretch of one class without any such place stays whole, however long it is.
    """
    start = 0
    while len(text) - start > size:
        found = _AT_SPACE.search(text, start + size // 2, start + size) or _AT_CLASS.search(text, start + size // 2, start + size)
        if not found:
            found = _AT_SPACE.search(text, start + size) or _AT_CLASS.search(text, start + size)
            if not found:
                break
        yield text[start : found.end()]
        start = found.end()
    if start < len(text) or not text:
        yield text[start:]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        ranks = read_ranks(rank_file)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of one text, piece by piece."""
        for piece in safe_pieces(text) if len(text) > PIECE else (text,):
            if len(piece) <= 4 * PIECE:
                yield self.library.encode_ordinary(piece)
            else:  # a stretch that can't be cut: match by match, as the library's matcher recurses
                for match in self.matches.finditer(piece):
                    yield self.library._encode_single_piece(match.group())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``ids ARRAY<INT>`` of every whole text; a null text is an empty one and has no ids.

    ``rank_file`` is a path that every executor can open. Rows stay as they are, also repeated ones and
    those with null keys; other columns are not returned.
    """

    def make(batch: pa.RecordBatch):
        own = codec(rank_file, pattern)
        for part in pieces_of(batch, text):
            ids = [[i for piece in own.encode(t or "") for i in piece] for t in column(part, text).to_pylist()]
            yield {k: column(part, k) for k in keys} | {"ids": ids}

    return arrow_rows(docs.select(*keys, text), make, f"{_schema(docs, keys)}, ids ARRAY<INT>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``decoded BINARY`` of rows with ``ids``; null ids are no ids."""

    def make(batch: pa.RecordBatch):
        own = codec(rank_file, pattern)
        ids = column(batch, "ids").to_pylist()
        yield {k: column(batch, k) for k in keys} | {"decoded": [own.decode(x or []) for x in ids]}

    return arrow_rows(tokens.select(*keys, "ids"), make, f"{_schema(tokens, keys)}, decoded BINARY")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``keys``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes decoded from the ids. A
    null text is an empty one. Ids are hashed piece by piece, so a very long text needs no more than its pieces.
    """

    def make(batch: pa.RecordBatch):
        own = codec(rank_file, pattern)
        rows = [_digests(own, t or "") for t in (x.as_py() for x in column(batch, text))]
        yield {k: column(batch, k) for k in keys} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows) if rows else ((), (), ()), strict=True))

    return arrow_rows(docs.select(*keys, text), make, f"{_schema(docs, keys)}, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING")


def _digests(own: Codec, text: str) -> tuple[int, str, str]:
    of_ids, of_bytes, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in own.encode(text):
        if ids:
            of_ids.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
            of_bytes.update(own.decode(ids))
            n += len(ids)
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def _schema(df: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
