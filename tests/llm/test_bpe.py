import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fernsift.llm import bpe, queries
from tests.conftest import SMALL

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_do_not_change_ids(plain):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab1 \n\t'.,sté中。|<²") for _ in range(800))
        pieces = list(bpe.safe_pieces(text, 40))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 400_000, "!" * 300_000, "a" * 300_000, "中文" * 100_000 + " x", "\n" * 300_000 + "x"])
def test_stretches_without_a_cut(text):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = [i for p in own.encode(text) for i in p]
    assert own.decode(ids) == text.encode()


def test_query_equals_library(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op8_bpe_round_trip(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark, edge_docs, no_docs):
    got = bpe.decode(bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    wanted = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in edge_docs.collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in got) == wanted
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
