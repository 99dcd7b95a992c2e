"""Packing: ids against the library, places against the rules, figures against bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duoclass.llm import packing
from duoclass.llm.packing import Bins, WordBpe, pack, sequences, token_pieces
from duoclass.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids + [1]


def coder():
    with open(PATH, encoding="utf-8") as f:
        return WordBpe(f.read())


def test_ids_equal_library():
    r = random.Random(3)
    pool = ["the", "The", " ", "\n", "\t", "\x0b", "\x1c", "é", "É", "é", "İ", "ΣΑΣ", "漢", "😀", " ", "\u0085", " ", "<|endoftext|>", "<|startoftext|", "'s", "'LL",
            "don't", "12", "½", "...", "ﬁ", "ǅ", "ñ", "ß", "­", "​", "\u0000", "Å", "ͅ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [t for _, t, *_ in awkward_docs() if t]
    texts += [chr(c) + "x" + chr(c) for c in range(1, 0x600)] + [chr(c) for c in range(0x1E00, 0x2100)]
    c = coder()
    for t, x in zip(texts, c.encode([t.encode() for t in texts])):
        assert np.frombuffer(x, "<u4").tolist() == ids_of(t)[:-1], repr(t[:60])


def test_runs_are_looked_up_in_small_blocks():
    """op12_packing: the runs of a batch are not looked up all at once."""
    c, sizes = coder(), []
    values = c.runs.values
    c.runs.values = lambda parts: sizes.append(sum(map(len, parts))) or values(parts)
    texts = [f"text {k} of a batch, " * 100 for k in range(200)] + ["", "x" * 60_000, " "]
    got = c.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t)[:-1] for t in texts]
    assert len(sizes) > 5 and sorted(sizes)[-2] <= packing.LOOKUP_BYTES < max(sizes) == 60_000


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 500)
    c = coder()
    for t in ["word  é " * 900, "x" * 3000 + " y", ""]:
        assert np.frombuffer(c.encode_long(t.encode()), "<u4").tolist() == ids_of(t)[:-1]


def check(rows, capacity):
    """Pieces lie end to end in their sequences; the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_query_against_library(spark):
    rows = QUERIES["op12_packing"](spark, SF001).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    total = n = 0
    for d, t in docs.items():
        ids = ids_of(t)
        total += len(ids)
        for p in range(0, len(ids), 4096):
            part = ids[p:p + 4096]
            r = got[d, p // 4096]
            n += 1
            assert (r["start"], r["length"], r["ids_crc32"]) == (p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert n == len(rows)
    assert check(rows, 4096) <= -(-total // 4096) + 1


def test_squares():
    """Each choice is the one with the smallest sum of squares, by trying all."""
    r = random.Random(4)
    size = 30
    bins, level = Bins(size), []
    for _ in range(400):
        n = r.randint(1, size)

        def cost(b):
            open_ = defaultdict(int)
            for i, x in enumerate(level):
                x += n if i == b else 0
                if x < size:
                    open_[size - x] += 1
            return sum(v * v for v in open_.values())

        fits = [b for b in range(len(level)) if level[b] + n <= size]
        b, off = bins.place(n)
        if not fits:
            assert b == len(level) and off == 0
            level.append(n)
        else:
            assert off == level[b] and cost(b) == min(map(cost, fits))
            least = [x for x in fits if cost(x) == cost(b)]
            assert level[b] == max(level[x] for x in least)
            level[b] += n
    assert sorted(bins.with_room(3)) == [b for b, x in enumerate(level) if size - x > 3]


@pytest.mark.parametrize("group_rows", [40, 10 ** 6])
def test_groups_and_rounds(spark, group_rows):
    r = random.Random(5)
    lengths = [min(64, max(1, int(r.lognormvariate(2.5, 1)))) for _ in range(2000)] + [None, 0, -3, 65, 64, 64]
    df = spark.createDataFrame([(i, n, "s") for i, n in enumerate(lengths)], "id long, length long, sequence_id string").drop("sequence_id")
    df = df.withColumn("offset", F.lit("mine"))
    rows = pack(df, capacity=64, group_rows=group_rows).collect()
    assert sorted(x["id"] for x in rows) == list(range(len(lengths)))
    out = [x for x in rows if x["sequence_id"] is None]
    assert sorted(str(x["length"]) for x in out) == ["-3", "0", "65", "None"] and all(x["offset"] is None for x in out)
    n = check([x for x in rows if x["sequence_id"] is not None], 64)
    least = -(-sum(x for x in lengths if x and 0 < x <= 64) // 64)
    assert n <= least + (1 if group_rows > 2000 else 25)


def test_one_size_that_never_fills(spark):
    """Half-full sequences can't be improved: rounds end, every row is placed."""
    rows = pack(spark.createDataFrame([(i, 2500) for i in range(300)], "id long, length int"), group_rows=50).collect()
    assert check(rows, 4096) == 300 and len(rows) == 300


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, t) for i, t, *_ in awkward_docs()], "doc_id long, text string")
    packed = pack(token_pieces(df, capacity=512), capacity=512)
    got = {r["sequence_id"]: r for r in sequences(packed).collect()}
    for r in packed.collect():
        s = got[r["sequence_id"]]
        assert s["ids"][4 * r["offset"]:4 * (r["offset"] + r["length"])] == r["ids"]
    assert sum(s["n_ids"] for s in got.values()) == sum(len(ids_of(t)) for _, t, *_ in awkward_docs())


def test_awkward_columns_and_empty_table(spark):
    df = awkward_frame(spark).withColumnRenamed("source", "ids").withColumnRenamed("host", "piece").withColumnRenamed("pl", "sequence_id")
    pieces = token_pieces(df)
    assert pieces.columns == ["doc_id", "lang", "n_chars", "doc", "sequence_id", "piece", "start", "length", "ids"]
    rows = pack(pieces.drop("ids")).collect()
    assert check(rows, 4096) >= 1
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) for _, t, *_ in awkward_docs())
    assert pack(token_pieces(spark.createDataFrame([], DOC_SCHEMA))).count() == 0
