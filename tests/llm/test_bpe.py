"""BPE against the tokenizers library, and the round trip."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from duoclass.llm.bpe import Bpe, decode, digests, encode, encode_decode
from duoclass.llm.tokenfiles import bpe_json, tokenizer_path
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame

# All kinds of white space, digits, letters and marks that split pieces.
POOL = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​ 　﻿aB'sTrelldv1²½๑Ⅷ٣漢字かé😀<|>endoftext.,!$_—ǅʰ\x00\x7f\xad"


@pytest.fixture(scope="module")
def both():
    return Bpe(**bpe_json()), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_equals_library(both):
    mine, lib = both
    r = random.Random(3)
    texts = ["", "ab" * 5000, "x" * 3000, " " * 500 + "a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext|"]
    texts += ["".join(r.choice(POOL) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [t for _, t, *_ in awkward_docs() if t]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids, repr(t[:80])
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_decodes_any_ids(both):
    """Ids in any order, so bytes that are no whole characters."""
    mine, lib = both
    r = random.Random(4)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_small_vocabulary_merges_in_rank_order():
    from duoclass.llm.bpe import byte_letters

    letters = byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"bc": 256, "ab": 257, "abc": 258, "aa": 259, "aaa": 260}
    b = Bpe(vocab, [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "a"), ("aa", "a")], {})
    assert b.encode("abc") == [vocab["a"], 256]
    assert b.encode("aaaaa") == [259, 260]
    assert b.encode("abab") == [257, 257]


def test_short_pieces_merge_as_the_queue_does(both, monkeypatch):
    """op10_bpe: lists for short pieces, the queue for the rest, and a cache that holds a table's words."""
    from duoclass.llm import bpe

    mine = both[0]
    r = random.Random(5)
    pieces = ["".join(r.choice("aabcehinorst 'é字") for _ in range(r.randint(1, bpe.SHORT // 3))) for _ in range(3000)] + ["a" * k for k in range(1, 41)]
    start = [[mine.single[b] for b in p.encode()] for p in pieces]
    short = [mine._merge_short(list(x)) for x in start]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [mine.merge(list(x)) for x in start] == short
    monkeypatch.undo()
    fresh, n = Bpe(**bpe_json()), 250_000
    words = " ".join(f"w{k}" for k in range(n))
    first = fresh.encode(words)
    fresh.merge = None        # every piece is known by now
    assert fresh.encode(words) == first


def test_awkward_rows(spark, both):
    df = awkward_frame(spark).withColumnRenamed("source", "bpe_ids")
    out = encode_decode(df, "text")
    assert out.columns == [c for c in df.columns if c != "bpe_ids"] + ["bpe_ids", "bpe_text"]
    rows = out.collect()
    assert len(rows) == len(awkward_docs())
    for r in rows:
        assert r["bpe_ids"] == both[1].encode(r["text"] or "", add_special_tokens=False).ids
        assert r["bpe_text"] == (r["text"] or "")
    d = {r["doc_id"]: r for r in digests(out).collect()}
    for k, t, *_ in awkward_docs():
        if k is None:
            continue  # two rows without an id
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        assert d[k]["n_tokens"] == len(ids)
        assert d[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert d[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "Hello wörld\n"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["bpe_text"] for r in decode(encode(df)).collect()}
    assert got == {1: "Hello wörld\n", 2: ""}
    none = decode(spark.createDataFrame([(None,)], "bpe_ids array<int>")).first()
    assert none["bpe_text"] is None


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], DOC_SCHEMA), "text").count() == 0
