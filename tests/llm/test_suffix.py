"""Suffix sorting and passage removal against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duoclass.llm import suffix as S
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame


def removed(docs: dict[int, bytes], n: int) -> dict[int, tuple]:
    """Brute force: (bytes, removed, spans, kept) in the order of the ids."""
    seen, out = set(), {}
    for k in sorted(docs):
        b = docs[k]
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p:p + n]
            if w in seen:
                gone[p:p + n] = b"\1" * n
            else:
                seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 3, 200]), st.integers(2, 300))
def test_suffix_order(seed, letters, n):
    r = random.Random(seed)
    b = bytes(r.randrange(letters) for _ in range(n)) + bytes(60)
    t = np.frombuffer(b, np.uint8)
    order = S.suffix_order(t, 24)
    assert sorted(order.tolist()) == list(range(len(b)))
    keys = [b[i:i + 24] for i in order]
    assert keys == sorted(keys)
    same = S.equal_neighbours(t, order, 20)
    for x in range(1, len(b)):
        i, j = order[x - 1], order[x]
        assert same[x] == (max(i, j) + 20 <= len(b) and b[i:i + 20] == b[j:j + 20])


def test_only_small_suffixes_are_sorted_directly():
    """A falling text has no suffix smaller than its successor: all are induced."""
    t = np.frombuffer(bytes(range(200, 0, -1)), np.uint8)
    assert S.suffix_order(t, 104).tolist() == list(range(199, -1, -1))


def test_runs_cover_every_window_once():
    b = np.frombuffer(b"abcabcabc" * 120 + bytes(random.Random(5).randrange(4) for _ in range(900)), np.uint8)
    _, _, st_, ln, _ = S.runs_of(b)
    assert st_[0] == 0 and (st_[1:] == (st_ + ln)[:-1]).all() and (st_ + ln)[-1] == len(b) - S.MIN_LEN + 1
    assert ln.max() <= S.MAX_RUN


def test_equal_windows_have_equal_names():
    r = random.Random(9)
    core = bytes(r.randrange(97, 123) for _ in range(140))
    texts = [np.frombuffer(bytes(r.randrange(97, 123) for _ in range(k)) + core + b"tail" * 30, np.uint8) for k in (10, 333)]
    names = []
    for k, b in zip((10, 333), texts):
        name, _, st_, ln, _ = S.runs_of(b)
        per_window = np.repeat(name, ln)
        names.append(per_window[k:k + 41])
    assert (names[0] == names[1]).all()


def test_remove_spans():
    kept, gone, spans = S.remove_spans(b"0123456789", np.array([7, 1, 2, 9]), np.array([9, 3, 4, 30]))
    assert (kept, gone, spans) == (b"0456", 6, 2)
    assert S.remove_spans(b"abc", np.array([5]), np.array([9])) == (b"abc", 0, 0)


@pytest.mark.parametrize("group_runs", [1024, 2])
def test_awkward_rows(spark, group_runs):
    docs = {k: (t or "").encode() for k, t, *_ in awkward_docs() if k is not None}
    exp = removed(docs, 100)
    df = awkward_frame(spark).withColumnRenamed("source", "sa_bytes")
    out = S.dedup_passages(df, "doc_id", "text", group_runs=group_runs)
    assert out.columns == [c for c in df.columns if c != "sa_bytes"] + ["sa_bytes", "sa_removed", "sa_spans", "sa_kept"]
    rows = out.collect()
    assert len(rows) == len(awkward_docs())
    for r in rows:
        got = (r["sa_bytes"], r["sa_removed"], r["sa_spans"], bytes(r["sa_kept"]))
        if r["doc_id"] is None:
            b = (r["text"] or "").encode()
            assert got == (len(b), 0, 0, b)
        else:
            assert got == exp[r["doc_id"]], r["doc_id"]


def test_hot_passage_over_many_documents(spark):
    """One passage in every document, in changing surroundings: salted blocks agree."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    hot = word(230)
    docs = {i: (word(r.randint(0, 150)) + hot[r.randint(0, 40):] + word(r.randint(0, 90))).encode() for i in range(150)}
    exp = removed(docs, 100)
    df = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["sa_bytes"], x["sa_removed"], x["sa_spans"], bytes(x["sa_kept"]))
           for x in S.dedup_passages(df, group_runs=16).collect()}
    assert got == exp


def test_long_text_in_pieces():
    """Runs of a text longer than a piece: together they cover all of its windows."""
    b = np.frombuffer(bytes(random.Random(1).randrange(97, 110) for _ in range(5000)), np.uint8)
    old, S.PIECE = S.PIECE, 1000
    try:
        at = 0
        for lo, piece in S._pieces(b, 100):
            assert lo == at
            _, _, _, ln, _ = S.runs_of(piece)
            at += int(ln.sum())
        assert at == len(b) - 99
    finally:
        S.PIECE = old


def test_empty_table(spark):
    assert S.dedup_passages(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_as_text_leaves_no_half_characters(spark):
    """A passage of two-byte letters behind one ASCII letter: cuts fall between bytes."""
    r = random.Random(11)
    body = "".join(chr(0x430 + r.randrange(32)) for _ in range(90))
    rows = [(1, "x" + body), (2, "\u0451" + body[1:] + "end"), (3, None), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exp = removed({k: (t or "").encode() for k, t in rows}, 100)
    got = {x["doc_id"]: x["sa_kept"] for x in S.dedup_passages(df, as_text=True).collect()}
    assert got == {k: (e[3].decode("utf-8", "ignore") if e[1] else None) for k, e in exp.items()}
    assert got[2] and got[1] is None
