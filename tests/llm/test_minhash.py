"""Near-duplicate groups against brute force on full sets."""

import random

import numpy as np
import pytest

from duoclass.llm import minhash as M
from duoclass.llm.common import cut
from duoclass.llm.components import connected_components
from tests.llm.fixtures import DOC_SCHEMA, awkward_docs, awkward_frame, components, prose


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def groups(docs: dict, k: int, percent: int = 80):
    s = {i: shingles(t, k) for i, t in docs.items()}
    links = []
    for a in s:
        for b in s:
            if a < b and s[a] and s[b]:
                n = len(s[a] & s[b])
                if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                    links.append((a, b))
    low = components(s, links)
    return {i: (len(s[i]), low[i], low[i] == i) for i in s}


def test_shingle_set_sizes():
    for t in ("", " \n", "a", "a b", "A b c d e", "a b c d a b c d a b c d", "é漢 x\x0by\x0cz w", prose(1, 300)):
        for k in (1, 4, 5):
            assert len(M.shingle_set(np.frombuffer(t.encode(), np.uint8), k)) == len(shingles(t, k)), (t, k)
    one, two = (M.shingle_set(np.frombuffer(x, np.uint8), 4) for x in (b"Hello  World a\tB c", b"hello world A b C"))
    assert (one == two).all()


def test_bins_estimate_similarity():
    """The share of equal bins follows the sets' similarity, also for small sets."""
    r = np.random.default_rng(4)
    for n in (6, 40, 2000):
        hits = []
        for _ in range(60):
            x = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            y = x.copy()
            y[: n // 6] = r.integers(0, 1 << 63, n // 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            j = (n - n // 6) / (n + n // 6)
            same = M.band_keys(np.unique(x)) == M.band_keys(np.unique(y))
            hits.append(same.mean() - j**4)
        assert abs(np.mean(hits)) < 0.12


@pytest.mark.parametrize("k", [4, 5])
def test_awkward_rows(spark, k):
    rows = awkward_docs()
    exp = groups({i: t for i, t, *_ in rows if i is not None}, k)
    got = M.near_duplicate_groups(awkward_frame(spark), "doc_id", "text", shingle_words=k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == exp[r["doc_id"]], r["doc_id"]


def test_chains_that_a_star_misses(spark):
    """Versions drift: neighbours are near copies, the ends aren't, ids are shuffled."""
    r = random.Random(2)
    docs, ids = {}, list(range(1000, 1120))
    r.shuffle(ids)
    for c in range(4):
        w = prose(100 + c, 120).split()
        for _ in range(30):
            docs[ids.pop()] = " ".join(w)
            for _ in range(3):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    exp = groups(docs, 4)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in M.near_duplicate_groups(df, shingle_words=4).collect()}
    assert got == exp


def test_empty_table(spark):
    assert M.near_duplicate_groups(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    r = random.Random(6)
    names = list(range(400))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(200)] + [(names[250], names[i]) for i in range(251, 400)]
    edges += [(5, 5), (None, 3), (7, None)]
    low = components(names, [e for e in edges if None not in e])
    got = {x["node"]: x["component"] for x in connected_components(cut(spark.createDataFrame(edges, "u long, v long"), "t")).collect()}
    in_edges = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {n: low[n] for n in in_edges}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
