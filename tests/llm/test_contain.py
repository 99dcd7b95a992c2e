"""Containment search against brute force; plan without Python."""

import random
import re

from duoclass.llm import contain as C
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame, prose

ITEMS = "item_id long, text string, n long, h string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(texts, k=5):
    out = set()
    for t in texts:
        w = words(t)
        out |= {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
    return out


def brute(docs, items, percent=80):
    d, i = {}, {}
    for k, t, *_ in docs:
        d.setdefault(k, []).append(t)
    for k, t, *_ in items:
        i.setdefault(k, []).append(t)
    out = set()
    for a, x in d.items():
        for b, y in i.items():
            s = set()
            for t in y:
                s |= grams([t], min(5, len(words(t)))) if words(t) else set()
            n = len(s & set().union(*(grams(x, k) for k in range(1, 6))))
            if a is not None and b is not None and s and n * 100 >= len(s) * percent:
                out.add((a, b, len(s), n))
    return out


def found(out):
    return {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in out.collect()}


def test_items_of_all_sizes(spark):
    """Whole items, items just above and just below the threshold, in short and long texts."""
    r = random.Random(8)
    items, docs = [], []
    for i, n in enumerate([5, 6, 9, 12, 16, 25, 40, 80, 200]):
        w = prose(500 + i, n).split()
        items.append((i, " ".join(w), 0, ""))
        for j in range(12):
            x = list(w)
            for _ in range(j % 4):
                x[r.randrange(n)] = "zzz"
            if j >= 8:
                x = x[: max(5, n * (j + 1) // 13)]
            docs.append((100 * i + j, prose(i * 50 + j, r.choice([0, 30, 900])) + " " + " ".join(x) + " " + prose(j, 20), None, None, None, 1, 1, ""))
    df = spark.createDataFrame(docs, DOC_SCHEMA).repartition(4)
    exp = brute(docs, items)
    assert len(exp) > 30
    assert found(C.contained_items(df, spark.createDataFrame(items, ITEMS))) == exp
    assert found(C.contained_items(df, spark.createDataFrame(items, ITEMS), percent=50)) == brute(docs, items, 50)


def test_awkward_rows(spark):
    docs = awkward_docs()
    a = docs[0][1]
    items = [(1, a[:200], 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, "too few words here", 0, ""), (5, "word word word word word word", 0, ""),
             (None, a, 0, ""), (6, a[:100].upper().replace(" ", " - "), 0, ""), (1, a[:200], 0, ""), (7, "short", 0, "")]
    got = C.contained_items(awkward_frame(spark), spark.createDataFrame(items, ITEMS))
    assert found(got) == brute(docs, items)
    assert got.count() == len(found(got))


def test_short_items_word_for_word(spark):
    """Items of one to four words are found as they stand, and only so."""
    docs = [(1, "The quick, brown fox jumps over it", "", "", 0, 0, 0, ""), (2, "quick fox brown", "", "", 0, 0, 0, ""), (3, "fox", "", "", 0, 0, 0, ""),
            (4, "a quick brown fox", "", "", 0, 0, 0, ""), (5, "", "", "", 0, 0, 0, ""), (6, None, "", "", 0, 0, 0, ""), (7, "...", "", "", 0, 0, 0, "")]
    items = [(1, "quick brown fox", 0, ""), (2, "FOX", 0, ""), (3, "a quick brown fox", 0, ""), (4, "...", 0, ""), (5, "quick brown fox jumps over it", 0, ""),
             (6, "fox brown", 0, "")]
    df = spark.createDataFrame(docs, DOC_SCHEMA)
    got = found(C.contained_items(df, spark.createDataFrame(items, ITEMS)))
    assert {(a, b) for a, b, *_ in got} == {(1, 1), (4, 1), (1, 2), (2, 2), (3, 2), (4, 2), (4, 3), (1, 5), (2, 6)}
    assert got == brute(docs, items)


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([(1, prose(1, 20), 0, "")], ITEMS)
    assert C.contained_items(none, item).count() == 0
    assert C.contained_items(awkward_frame(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert C.contained_items(none, item).columns == C.contained_items(none, spark.createDataFrame([], ITEMS)).columns


def test_sketch_is_the_bottom(spark):
    sets = C.item_sets(spark.createDataFrame([(1, prose(1, 29), 0, "")], ITEMS), "item_id", "text", 5)[0]
    low = sorted(r["h"] for r in sets.collect())
    got = sorted(r["h"] for r in C.sketches(sets, 80).collect())
    assert got == low[: len(low) - -(-len(low) * 80 // 100) + 1]
