"""Token counts against the library's unigram model, ties included."""

import random

import pytest
from tokenizers import Tokenizer, models

from duoclass.llm.tokencount import Counter, count_tokens
from duoclass.llm.tokenfiles import unigram_pieces
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame


def library(pieces, fall):
    low = min(s for _, s in pieces)
    vocab = [("<unk>", low)] + pieces + ([(f"<0x{i:02X}>", low) for i in range(256)] if fall else [])
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=fall))
    return lambda y: len(t.encode("▁" + y.replace(" ", "▁")).ids) if y else 0


@pytest.mark.parametrize("scores", ["file", "ties", "random"])
def test_equals_library(scores):
    r = random.Random(1)
    pieces = unigram_pieces()
    if scores == "ties":
        pieces = [(p, -float(r.randint(1, 6))) for p, _ in pieces]
    elif scores == "random":
        pieces = [(p, -r.random() * 9) for p, _ in pieces]
    pool = "abcé漢字 ▁ the  ion\n\t😀ñ🜀ꙮ"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [t for _, t, *_ in awkward_docs() if t]
    for fall in (True, False):
        c, lib = Counter(pieces, fall), library(pieces, fall)
        for t in texts:
            assert c.count(t) == lib(t), repr(t[:80])


def test_rejects_other_vocabularies():
    with pytest.raises(ValueError):
        Counter([("a", -1.0)])
    with pytest.raises(ValueError):
        Counter([("▁", -1.0), ("a▁b", -1.0)])


def test_awkward_rows(spark):
    df = awkward_frame(spark).withColumnRenamed("source", "n_tokens")
    rows = count_tokens(df).collect()
    c = Counter(unigram_pieces())
    assert len(rows) == df.count()
    assert all(r["n_tokens"] == c.count(r["text"] or "") for r in rows)
    assert all(r["n_tokens"] == 0 for r in rows if not r["text"])


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
