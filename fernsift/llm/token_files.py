"""Token ids as files of raw ids, with a minimal perfect hash from document keys to places in them.

``write`` sorts documents by key over the cluster; each task encodes its range and writes one shard, two files:

- ``<shard>.ids``: the ids of its documents one after the other, as little-endian unsigned integers of 16 bits if the
  vocabulary allows, else 32. Nothing else, so the file can be mapped into memory as it is.
- ``<shard>.idx``: the place of each row in the first file, the perfect hash of the shard's keys, and by place a key's
  fingerprint, first row and number of rows.

``manifest.json`` lists the shards in key order with their first and last key. A file appears under its name only when
it is whole, and a repeated task writes the same bytes, so a lost executor leaves no half shards.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsift.llm.bpe import safe_pieces
from fernsift.llm.perfect_hash import PerfectHash, build, fingerprints, key_hashes
from fernsift.llm.shared import column, file_system, pieces_of

#: Parts of a text that the vocabulary's pattern never joins: a word with the blank before it, the full stop or comma
#: after a word of Latin letters, and all but the last of several blanks. Only for texts without other white space.
_UNIT = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,]?(?:[ \n]|\Z))|[.,](?=[ \n]|\Z)|[ \n]?[^ \n]+|[ \n]+(?=[ \n][^ \n])|[ \n]+")
_OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")  # white space but blank and line feed
KEPT_UNITS = 800_000
LONGEST_UNIT = 48
JOINED_UNITS = 1000  # new units that the library gets as one text
AT_ONCE = 1 << 20  # ids of neighbouring rows that are read in one request
LOOKED_UP = 1 << 24  # ids that a task looks up, about
LONGEST_PART = 1 << 23  # characters of texts that are cut into units at once


class Encoder:
    """The tokenizers library behind a bounded cache of units, as most words come again and again."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        tokens = self.library.get_vocab()
        self.length = np.zeros(max(tokens.values(), default=-1) + 1, np.int64)  # bytes that each id stands for, in a byte-level vocabulary
        self.length[list(tokens.values())] = [len(t) for t in tokens]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = [array(self.code, x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Raw ids of short units that begin with their only blank or line feed. The pattern parts a text before it, so many units are one
        text, whose ids are dealt out by the bytes they stand for. Where an id reaches over the end of a unit each unit is encoded by itself."""
        parts = [units[i : i + JOINED_UNITS] for i in range(0, len(units), JOINED_UNITS)]
        out: list[bytes] = []
        for part, ids in zip(parts, self._plain(["".join(p) for p in parts]), strict=True):
            lengths = np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in part), np.int64, len(part))
            upto, ends = np.cumsum(lengths), np.cumsum(self.length[np.frombuffer(ids, self.type)])
            at = np.searchsorted(ends, upto)
            if len(ends) and ends[-1] == upto[-1] and np.array_equal(ends[at], upto):
                cuts = [0, *((at + 1) * self.type.itemsize).tolist()]
                out += map(ids.__getitem__, map(slice, cuts, cuts[1:]))
            else:
                out += self._plain(part)
        return out

    def _learn(self, units: set[str]) -> list[str]:
        """Make all of these units known; returns those that are too long to be kept."""
        known = self.known
        new = list(units.difference(known))
        if len(known) + len(new) > KEPT_UNITS:
            known.clear()
            new = list(units)
        apart = [u for u in new if u[0] in " \n" and len(u) <= LONGEST_UNIT and u[-1] not in " \n"]
        known.update(zip(apart, self._joined(apart), strict=True))
        if len(apart) < len(new):
            others = list(set(new).difference(apart))
            known.update(zip(others, self._plain(others), strict=True))
        return [u for u in new if len(u) > LONGEST_UNIT]

    def encode(self, text: str) -> Iterator[bytes]:
        """Raw ids of a text, piece by piece."""
        for piece in safe_pieces(text):
            if _OTHER_SPACE.search(piece):
                yield from self._plain([piece])
                continue
            units = _UNIT.findall(piece)
            long = self._learn(set(units))
            yield b"".join(map(self.known.__getitem__, units))
            for u in long:
                del self.known[u]

    def encode_all(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """Raw ids of several texts, whose new units are given to the library together."""
        if sum(map(len, texts)) > LONGEST_PART:
            yield from map(self.encode, texts)
            return
        odd = [bool(_OTHER_SPACE.search(t)) for t in texts]
        units = [[] if o else _UNIT.findall(t) for t, o in zip(texts, odd, strict=True)]
        long = self._learn(set().union(*units))
        known = self.known.__getitem__
        made = [None if o else b"".join(map(known, u)) for u, o in zip(units, odd, strict=True)]
        for u in long:
            del self.known[u]
        for text, ids in zip(texts, made, strict=True):
            yield iter((ids,)) if ids is not None else self.encode(text)


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def _write_shard(folder: str, shard: int, rows: Iterator[tuple[object, Iterator[bytes]]], kind: np.dtype, end: int | None) -> dict | None:
    files, path = file_system(folder)
    name, mine = f"{shard:06d}", f"{path}/.{shard:06d}-{TaskContext.get().taskAttemptId()}"
    starts, keys, first_row, at = [0], [], [], 0
    tail = b"" if end is None else np.array([end], kind).tobytes()
    out = None
    for key, parts in rows:
        if out is None:
            out = files.open_output_stream(f"{mine}.ids", buffer_size=1 << 20)
        for part in parts:
            out.write(part)
            at += len(part)
        out.write(tail)
        at += len(tail)
        if not keys or key != keys[-1]:
            keys.append(key)
            first_row.append(len(starts) - 1)
        starts.append(at // kind.itemsize)
    if out is None:
        return None
    out.close()
    hashes = key_hashes(keys)
    levels = build(hashes)
    places = PerfectHash(levels).places(hashes)
    by_place = np.empty(len(keys), [("print", "<u4"), ("row", "<u8"), ("rows", "<u4")])
    by_place["print"][places] = fingerprints(hashes)
    by_place["row"][places] = first_row
    by_place["rows"][places] = np.diff([*first_row, len(starts) - 1])
    head = json.dumps({"rows": len(starts) - 1, "keys": len(keys), "type": kind.str, "levels": [len(x) for x in levels]}).encode()
    with files.open_output_stream(f"{mine}.idx") as index:
        index.write(len(head).to_bytes(8, "little") + head + np.array(starts, "<u8").tobytes())
        for x in levels:
            index.write(x.tobytes())
        index.write(by_place.tobytes())
    for suffix in ("ids", "idx"):
        files.move(f"{mine}.{suffix}", f"{path}/{name}.{suffix}")
    return {"shard": name, "rows": len(starts) - 1, "tokens": starts[-1], "first": keys[0], "last": keys[-1]}


def write(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = None,
    shards: int | None = None,
) -> list[dict]:
    """Encode whole texts and write them to ``folder`` in ascending key order; returns the shards.

    Keys are integers or strings; a null key sorts first and can be asked for. A null or empty text has no ids but the
    end id. Rows of one key stay together, ordered by text. An empty table gives no shards. ``shards`` is the number of
    ranges, by default what the session's shuffle settings give.
    """
    spark = docs.sparkSession
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)

        def rows():
            for batch in batches:
                for part in pieces_of(batch, "text"):
                    texts = [t or "" for t in column(part, "text").to_pylist()]
                    yield from zip(column(part, "key").to_pylist(), own.encode_all(texts), strict=True)

        told = _write_shard(folder, TaskContext.get().partitionId(), rows(), own.type, end_id)
        if told:
            yield pa.RecordBatch.from_pydict({"told": [json.dumps(told)]})

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranged = narrow.repartitionByRange(shards, "key") if shards else narrow.repartitionByRange("key")
    told = ranged.sortWithinPartitions("key", "text").mapInArrow(run, "told STRING").collect()  # one row per shard
    manifest, tokens = sorted((json.loads(r.told) for r in told), key=lambda x: x["shard"]), 0
    for x in manifest:
        x["start"], tokens = tokens, tokens + x["tokens"]
    with files.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """One shard opened for reading."""

    def __init__(self, folder: str, told: dict):
        files, path = file_system(folder)
        with files.open_input_file(f"{path}/{told['shard']}.idx") as index:
            head = json.loads(index.read(int.from_bytes(index.read(8), "little")))
            self.starts = np.frombuffer(index.read(8 * (head["rows"] + 1)), "<u8").astype(np.int64)
            self.hash = PerfectHash([np.frombuffer(index.read(n), np.uint8) for n in head["levels"]])
            self.by_place = np.frombuffer(index.read(16 * head["keys"]), [("print", "<u4"), ("row", "<u8"), ("rows", "<u4")])
        self.type, self.base = np.dtype(head["type"]), told["start"]
        self.ids = files.open_input_file(f"{path}/{told['shard']}.ids")

    def rows_of(self, keys: list) -> list[tuple[int, int]]:
        """(first row, number of rows) of each key; no rows if the fingerprint differs."""
        hashes = key_hashes(keys)
        places = self.hash.places(hashes)
        entry = self.by_place[np.maximum(places, 0)]
        right = (places >= 0) & (entry["print"] == fingerprints(hashes))
        return [(int(r), int(n) if ok else 0) for r, n, ok in zip(entry["row"], entry["rows"], right, strict=True)]

    def read(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each row from ``first`` up to ``last`` begins among the shard's ids, and where the last ends; the ids), in one request."""
        places = self.starts[first : last + 2]
        self.ids.seek(int(places[0]) * self.type.itemsize)
        return places, np.frombuffer(self.ids.read(int(places[-1] - places[0]) * self.type.itemsize), self.type)


class Reader:
    """Keyed access to a written folder; holds one open shard."""

    def __init__(self, folder: str):
        files, path = file_system(folder)
        with files.open_input_file(f"{path}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.folder, self.at, self.shard = folder, -1, None
        self.null = [x["last"] is None for x in self.manifest].count(True)  # shards of null keys only
        self.lasts = [x["last"] for x in self.manifest[self.null :]]

    def find(self, keys: list) -> Iterator[tuple[object, int, np.ndarray]]:
        """(key, start, ids) of every row of the keys; neighbours in key order cost one shard."""
        shard_of = lambda k: 0 if k is None else self.null + bisect_left(self.lasts, k)
        for at, run in groupby(keys, shard_of):
            if at < len(self.manifest):
                yield from self._in(at, list(run))

    def _in(self, at: int, keys: list) -> Iterator[tuple[object, int, np.ndarray]]:
        if at != self.at:
            self.at, self.shard = at, Shard(self.folder, self.manifest[at])
        asked = [(k, r) for k, (row, n) in zip(keys, self.shard.rows_of(keys), strict=True) for r in range(row, row + n)]
        starts, done = self.shard.starts, 0
        while done < len(asked):
            first, upto = asked[done][1], done + 1
            while upto < len(asked) and asked[upto][1] == asked[upto - 1][1] + 1 and starts[asked[upto][1] + 1] - starts[first] <= AT_ONCE:
                upto += 1
            places, ids = self.shard.read(first, asked[upto - 1][1])
            for (k, _), a, b in zip(asked[done:upto], places[:-1].tolist(), places[1:].tolist(), strict=True):
                yield k, self.shard.base + a, ids[a - int(places[0]) : b - int(places[0])]
            done = upto


def lookup(keys: DataFrame, folder: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """Rows of the keys that the folder holds: the key, ``start``, ``n_tokens`` and ``ids ARRAY<INT>``.

    ``start`` is the number of ids of all rows before. With ``digest`` the ids are given by ``ids_crc32`` instead, the
    unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. Keys that are not there give no row; a key
    asked for twice is answered once. Keys are sorted over the cluster first, so that a task opens few shards; the number of tasks
    follows the ids that the folder holds, as keys tell little of them.
    """
    kind = keys.schema[key].dataType.simpleString()
    last = "ids_crc32 LONG" if digest else "ids ARRAY<INT>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, before = Reader(folder), ...
        for batch in batches:
            asked, out, size = [], [], 0
            for k in batch.column(0).to_pylist():
                if k != before:
                    asked.append(k)
                before = k
            for k, start, ids in reader.find(asked):
                out.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32)))
                size += 1 if digest else len(ids)
                if size > 1 << 20:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [as_arrow.field(0).type, pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[key, "start", "n_tokens", last.split()[0]])

    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = keys.select(key)
    as_arrow = to_arrow_schema(narrow.schema)
    ranges = max(1, -(-sum(x["tokens"] for x in Reader(folder).manifest) // LOOKED_UP), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return narrow.repartitionByRange(ranges, key).sortWithinPartitions(key).mapInArrow(run, f"`{key}` {kind}, start LONG, n_tokens LONG, {last}")
