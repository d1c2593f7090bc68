import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fernsift.llm import perfect_hash, queries, token_files
from fernsift.llm.shared import shared_folder
from tests.conftest import SMALL

FILE = public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = [*range(5000), *map(str, range(500)), None]
    hashes = perfect_hash.key_hashes(keys)
    levels = perfect_hash.build(hashes)
    places = perfect_hash.PerfectHash(levels).places(hashes)
    assert sorted(places.tolist()) == list(range(len(keys)))
    assert len(perfect_hash.build(perfect_hash.key_hashes([]))) == 0


def test_units_do_not_change_ids():
    own, rng = token_files.Encoder(FILE), random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("abA1 \n\t'.,é中|<\x1c\xa0") for _ in range(rng.randint(0, 50)))
        ids = np.frombuffer(b"".join(own.encode(text)), own.type).tolist()
        assert ids == own.library.encode(text, add_special_tokens=False).ids


def test_units_joined_for_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "JOINED_UNITS", 7)
    own, rng = token_files.Encoder(FILE), random.Random(5)
    units = {rng.choice(" \n") + "".join(rng.choice("abA1'.,é中|<>-s") for _ in range(rng.randint(1, 9))) for _ in range(500)}
    units = [*units, " <|endoftext|>", " a<|endoftext|>b"]
    assert own._joined(units) == own._plain(units)
    own.length[:] += 1  # no unit ends where an id does
    assert own._joined(units) == own._plain(units)
    assert own._joined([]) == []


def test_white_space_that_parts_no_units():
    other = {c for c in map(chr, range(0x110000)) if c.isspace()} - {" ", "\n"}
    assert {c for c in map(chr, range(0x110000)) if token_files._OTHER_SPACE.search(c)} == other


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_UNITS", 5)
    own = token_files.Encoder(FILE)
    for text in ("one two three four five", "six seven one", "one two eight nine ten"):
        ids = np.frombuffer(b"".join(own.encode(text)), own.type).tolist()
        assert ids == own.library.encode(text, add_special_tokens=False).ids


def test_query_equals_library(spark):
    library = Tokenizer.from_file(FILE)
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op1_token_files(spark, SMALL).collect()}
    start = 0
    for key, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)


def test_edges(spark, edge_docs, no_docs):
    folder = shared_folder(spark, "edges")
    manifest = token_files.write(edge_docs, folder, FILE, end_id=2, shards=3)
    assert sum(x["rows"] for x in manifest) == edge_docs.count()
    got = token_files.lookup(edge_docs.select("doc_id"), folder).collect()
    assert len(got) == edge_docs.count()  # rows of a repeated or null key come back once each
    library = Tokenizer.from_file(FILE)
    wanted = sorted((r.doc_id is None, r.doc_id or 0, crc([*library.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in edge_docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, crc(r.ids)) for r in got) == wanted
    strangers = spark.createDataFrame([(-5,), (10**12,), (77,)], "doc_id LONG")
    assert token_files.lookup(strangers, folder).count() == 0
    empty = shared_folder(spark, "empty")
    assert token_files.write(no_docs, empty, FILE) == []
    assert token_files.lookup(strangers, empty, digest=True).count() == 0


def test_text_keys(spark):
    docs = spark.createDataFrame([(k, f"text of {k}") for k in "bcaed"], "doc_id STRING, text STRING")
    folder = shared_folder(spark, "named")
    token_files.write(docs, folder, FILE, shards=2)
    rows = token_files.lookup(docs.select("doc_id"), folder).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == list("abcde")


@pytest.mark.parametrize("end", [None, 2])
def test_same_files_again(spark, end):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id LONG, text STRING")
    told = [token_files.write(docs, shared_folder(spark, "twice"), FILE, end_id=end, shards=4) for _ in range(2)]
    assert told[0] == told[1]
