"""The pipeline's stages against brute force on the small tables, and on awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from duoclass.llm.common import cut
from duoclass.llm.tokenfiles import tokenizer_path
from tests.conftest import SF001
from tests.llm.fixtures import awkward_frame
from tests.llm.test_contain import brute as leaks
from tests.llm.test_minhash import groups
from tests.llm.test_suffix import removed


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, written as run() does."""
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for name, f in P.STAGES:
        made = cut(f(spark, docs, SF001), f"t-{name}")
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_stage_keeps_clean_documents(stages):
    before, after = map(rows, stages[0])
    assert set(after) == {k for k, r in before.items() if r["text"] and any(c.isalpha() for c in r["text"])}


def test_near_duplicate_stage(stages):
    before, after = map(rows, stages[1])
    exp = groups({k: r["text"] for k, r in before.items()}, 5)
    assert set(after) == {k for k, (_, _, kept) in exp.items() if kept}


def test_passage_stage(stages):
    before, after = map(rows, stages[2])
    exp = removed({k: r["text"].encode() for k, r in before.items()}, 100)
    for k, (_, gone, _, kept) in exp.items():
        t = kept.decode("utf-8", "ignore")
        if gone and not t.strip(" "):
            assert k not in after
        else:
            assert after[k]["text"] == t
            assert after[k]["n_chars"] == (len(t) if gone else before[k]["n_chars"])


def test_leak_stage(spark, stages):
    before, after = map(rows, stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, *_ in leaks([(k, r["text"]) for k, r in before.items()], items)}
    assert set(after) == set(before) - hit


def test_token_stage(stages):
    before, after = map(rows, stages[4])
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert set(before) == set(after)
    for k, r in before.items():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        assert after[k]["n_tokens"] == len(ids)
        assert after[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert after[k]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, P.run(spark, SF001).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_awkward_rows_pass_all_stages(spark):
    docs = cut(awkward_frame(spark), "t-awkward")
    for name, f in P.STAGES:
        docs = cut(f(spark, docs, SF001), f"t-{name}")
    got = [r["doc_id"] for r in docs.collect()]
    assert got.count(None) == 1          # the row with a text and no id stays, as it is
    assert 5 not in got and 6 not in got and 7 not in got
    assert -4 in got and 1 not in got and 2 not in got and 17 not in got


def test_no_documents(spark):
    docs = cut(awkward_frame(spark).limit(0), "t-none")
    for name, f in P.STAGES:
        docs = cut(f(spark, docs, SF001), f"t-{name}")
    assert docs.count() == 0


def test_registered():
    q = E.queries()
    assert "pipeline" in q and all(any(x.startswith(f"op{n}_") for x in q) for n in range(1, 11))
    assert set(E.oracle_sql()) <= set(q)


def test_clashing_columns_are_kept(spark):
    """Input columns may have the names that operators use."""
    names = ["_gone", "lang_pred", "lang_score", "sa_removed", "sa_kept", "kept", "component_id", "_text"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    docs = cut(docs, "t-clash")
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, SF001)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names), name
