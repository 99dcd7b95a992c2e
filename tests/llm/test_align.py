"""Cross-tokenizer alignment against both libraries on whole texts and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from duoclass.llm import align
from duoclass.llm.bpe import byte_letters
from duoclass.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = {c: b for b, c in enumerate(byte_letters())}


def brute(text):
    """(a ids, b ids, groups, links) or None."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(bytes_a), spans(bytes_b)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, links = [], []
    at_a = at_b = 0
    for hi in cuts:
        to_a = next(i + 1 for i in range(at_a, len(sa)) if sa[i][1] == hi)
        to_b = next(i + 1 for i in range(at_b, len(sb)) if sb[i][1] == hi)
        ga, gb = list(zip(a[at_a:to_a], sa[at_a:to_a])), list(zip(b[at_b:to_b], sb[at_b:to_b]))
        at_a, at_b = to_a, to_b
        groups.append(",".join(str(i) for i, _ in ga) + "|" + ",".join(str(i) for i, _ in gb))
        links += [(x, y) for x, (s, e) in ga for y, (t, f) in gb if s < f and t < e]
    return a, b, groups, links


def expected(texts):
    parts = [brute(t) for t in texts]
    count = Counter(x for p in parts if p for x in p[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for p in parts:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links = p
            out.append((len(a), len(b), len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                        hashlib.sha256(";".join(g).encode()).hexdigest()))
    return out


def fuzz(n, seed=1):
    r = random.Random(seed)
    pool = ["the", " ", "  ", "\n", "\t", "é", "漢字", "😀", " ", " ", "<|endoftext|>", "<0x0A>", "ﬁ", "é", "▁", "'s", "123", "...", "</s>",
            "\x1c", "Ünder", "\u0085", "​", "\u0000", "word"]
    return ["".join(r.choice(pool[:-3] if r.random() < .97 else pool) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("most", [10 ** 9, 40, 0])
def test_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(align, "MOST_PAIRS", most)
    monkeypatch.setattr(align.text_measures, "__defaults__", (most,))
    texts = fuzz(500) + [t for _, t, *_ in awkward_docs()] + ["a  b", " a", "a ", "  ", "\n x", "x \n", "▁", "a ▁b"]
    got = align.align_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = expected(texts)
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[2:] == want[r["doc_id"]], repr(texts[r["doc_id"]])


def test_query_equals_brute_force(spark):
    rows = QUERIES["op11_token_alignment"](spark, SF001).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([d for d, _ in docs], expected([t for _, t in docs])))
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in rows)


def test_long_texts_and_bounded_memory(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        raw = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    monkeypatch.setattr(align, "RUN_CACHE", 400)
    al = align.Aligner(raw, model)
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(20_000))
    for t in [text, "x" * 5000, text[:3000]]:
        got, want = al.align([t])[0], brute(t)
        assert got[:3] == (len(want[0]), len(want[1]), len(want[2])) and len(got[4]) == len(want[3])
        assert got[3] == hashlib.sha256(";".join(want[2]).encode()).hexdigest()
        assert not al.runs.new or max(map(len, al.runs.new)) <= 64


class Counted:
    """Tokenizer B that counts the strings it is given."""

    def __init__(self, inner):
        self.inner, self.strings = inner, 0

    def encode(self, strings, **options):
        self.strings += len(strings)
        return self.inner.encode(strings, **options)


@pytest.mark.parametrize("bad", [0, 1])
def test_runs_are_tokenised_many_in_one_string(bad):
    """a string for each new run took most of the time; a run whose bytes differ costs its own lot only."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        raw = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    al = align.Aligner(raw, model)
    al.b = counted = Counted(al.b)
    r = random.Random(3)
    words = list({"".join(r.choice("abcdeéß漢.,'\n1") for _ in range(r.randint(1, 9))) + "x" for _ in range(4000)})
    words = [w for w in words if align.clean(w)]
    texts = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)] + ["a \u2581b c", " of  it"] * bad
    got = al.align(texts)
    assert counted.strings <= len(words) // 64 + 1 + 80 * bad
    for t, x in zip(texts, got):
        want = brute(t)
        if want is None:
            assert x is None
        else:
            assert x[:4] == (len(want[0]), len(want[1]), len(want[2]), hashlib.sha256(";".join(want[2]).encode()).hexdigest())
            assert Counter(x[4].tolist()) == Counter(al.code_of(a, b) for a, b in want[3])


def test_awkward_columns_and_empty_table(spark):
    df = awkward_frame(spark).withColumnRenamed("source", "n_links").withColumnRenamed("host", "key").withColumnRenamed("lang", "code")
    rows = align.align_documents(df).collect()
    assert len(rows) == df.count()
    want = dict(zip([x[1] for x in awkward_docs()], expected([x[1] for x in awkward_docs()])))
    assert all(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == want[r["text"]] for r in rows)
    assert {r["key"] for r in rows} == {"h", None}
    assert align.align_documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
