"""Language model: sums over segmentations by brute force, held-out accuracy, edge rows."""

import math
import random
from fractions import Fraction

import pytest

from duoclass.llm import langid as L
from duoclass.llm import queries as Q
from tests.conftest import SF01
from tests.llm.fixtures import DOC_SCHEMA, awkward_frame


def all_segmentations(m: L.Model, s: str, lang: int) -> float:
    if not s:
        return 1.0
    total = 0.0
    for j in range(1, len(s) + 1):
        p = m.probs.get(s[:j])
        if p is None and j == 1:
            p = m.unknown
        if p is not None:
            total += p[lang] * all_segmentations(m, s[j:], lang)
    return total


def small_model() -> L.Model:
    return L.Model(["de", "en"], {"a": (0.2, 0.1), "b": (0.1, 0.2), "ab": (0.3, 0.1), "ba": (0.05, 0.2), "aba": (0.1, 0.3), "▁": (0.1, 0.05), "▁a": (0.15, 0.05)})


@pytest.mark.parametrize("s", ["▁a", "▁ab", "▁abab", "▁bababa", "▁axb", "aaaa", "x"])
def test_forward_sums_all_segmentations(s):
    m = small_model()
    for lang in (0, 1):
        assert math.isclose(math.exp(m.log_probs(s)[lang]), all_segmentations(m, s, lang), rel_tol=1e-9)


def test_expected_uses_cover_the_text():
    """Expected uses, weighted by length, add up to the length of the part."""
    m = small_model()
    for s in ("▁abab", "▁bxab"):
        e, c = m.expected(s, 1)
        assert math.isclose(sum((j - i) * x for (i, j, _), x in zip(e, c)), len(s), rel_tol=1e-9)


def test_parts():
    assert L.parts_of("Ab1cd, É!") == ["▁ab", "▁cd", "▁é"]
    assert L.parts_of("123 ½ ²") == []
    assert L.parts_of("x" * 1000) == ["▁" + "x" * 1000]


def test_long_parts_do_not_vanish():
    """Nothing is cut and nothing underflows: unknown letters, and the exact sum by fractions."""
    m = L.Model(["a"], {})
    assert math.isclose(m.log_probs("x" * 5000)[0], 5000 * math.log(L.UNKNOWN), rel_tol=1e-12)
    pieces = {"a": (0.3, 1e-9), "aa": (0.2, 0.25), "aaa": (1e-7, 0.1), "aaaaaaa": (0.0125, 1e-12)}
    m = L.Model(["u", "v"], pieces)
    for n in (31, 32, 33, 100, 700):
        for lang, x in enumerate(m.log_probs("a" * n)):
            sums = [Fraction(1)]
            for i in range(1, n + 1):
                sums.append(sum((Fraction(p[lang]) * sums[i - len(s)] for s, p in pieces.items() if len(s) <= i), Fraction(0)))
            exact = math.log(sums[n].numerator) - math.log(sums[n].denominator)
            assert math.isclose(x, exact, rel_tol=1e-12)
            e, c = m.expected("a" * n, lang)
            assert math.isclose(sum((j - i) * y for (i, j, _), y in zip(e, c)), n, rel_tol=1e-9)


def test_predictions_equal_a_plain_scorer(spark):
    """The whole stage beside sums by logarithms, without caches and blocks."""
    r = random.Random(5)
    docs = [(i, "".join(r.choice("abé ") for _ in range(r.choice([3, 40, 900]))) + "漢" * r.choice([0, 70]), r.choice(["x", "y"])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    m = L.train(df)

    def total(text, lang):
        out = 0.0
        for s in L.parts_of(text):
            a = [0.0] + [-math.inf] * len(s)
            for i, j, p in m.edges(s):
                x, y = a[j], a[i] + math.log(p[lang])
                a[j] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
            out += a[-1]
        return out

    for r_ in L.predict_language(df, m).collect():
        t = [total(r_["text"], k) for k in range(len(m.languages))]
        if not L.parts_of(r_["text"]):
            assert r_["lang_pred"] == "und"
            continue
        assert r_["lang_pred"] == m.languages[t.index(max(t))]
        assert math.isclose(r_["lang_score"], 1 / sum(math.exp(x - max(t)) for x in t), rel_tol=1e-6)


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in Q.op1_language_id(spark, SF01).collect()}
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()
    held = [(rows[r["doc_id"]]["lang_pred"], r["lang"]) for r in truth if rows[r["doc_id"]]["held_out"] and r["lang"]]
    assert len(held) > 200
    assert sum(a == b for a, b in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_awkward_rows(spark):
    df = awkward_frame(spark).withColumnRenamed("source", "lang_score")
    out = L.predict_language(df, L.train(df), "text").collect()
    assert len(out) == df.count()
    for r in out:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == "en" and r["lang_score"] == 1.0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    model = L.train(empty)
    assert model.languages == []
    assert L.predict_language(empty, model).count() == 0
    rows = L.predict_language(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), model).collect()
    assert (rows[0]["lang_pred"], rows[0]["lang_score"]) == ("und", 0.0)


def test_language_of_copies(spark):
    """A language of 4,000 copies of 20 texts is learned from those texts, not from a share of their rows."""
    de = [f"der hund und die katze schlafen nicht im haus nummer {'x' * i}" for i in range(20)]
    en = [f"the dog and the cat do not sleep in the house number {'x' * i}" for i in range(40)]
    df = spark.createDataFrame([(de[i % 20], "de") for i in range(4000)] + [(t, "en") for t in en], "text string, lang string")
    model = L.train(df, sample_docs=50)
    assert len({p[0] for p in model.probs.values()}) > 1
    out = L.predict_language(spark.createDataFrame([(t,) for t in de + en], "text string"), model).collect()
    assert [r["lang_pred"] for r in out] == ["de"] * 20 + ["en"] * 40


def test_ties_take_the_first_language(spark):
    df = spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string")
    out = L.predict_language(df, L.train(df)).collect()
    assert {r["lang_pred"] for r in out} == {"a"} and all(abs(r["lang_score"] - 0.5) < 1e-9 for r in out)
