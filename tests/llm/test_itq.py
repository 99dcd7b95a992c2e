"""Embedding groups against brute force, and recall near the threshold."""

import math

import numpy as np

from duoclass.llm import itq as I
from tests.llm.fixtures import components

SCHEMA = "vec_id long, embedding array<float>, label int, id long, d string"


def brute(rows, min_cos=0.98):
    ok = {}
    for n, (k, v, label, *_) in enumerate(rows):
        if k is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        ok[n] = (k, label, x / np.linalg.norm(x))
    links, deg = [], {n: 0 for n in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][2]) == len(ok[b][2]) and ok[a][2] @ ok[b][2] >= min_cos:
                links.append((ok[a][0], ok[b][0]))
                deg[a] += 1
                deg[b] += 1
    low = components({r[0] for r in rows if r[0] is not None}, links)
    return sorted(str((r[0], deg[n], low.get(r[0]), r[0] is None or low[r[0]] == r[0])) for n, r in enumerate(rows))


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in I.embedding_groups(df, **kw).collect())
    assert got == brute(rows)


def near(r, v, cos):
    u = r.standard_normal(len(v))
    u -= (u @ v) * v
    u /= np.linalg.norm(u)
    return cos * v + math.sqrt(1 - cos * cos) * u


def test_awkward_rows(spark):
    r = np.random.default_rng(1)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(r.standard_normal(16))
    a, b = unit(), unit()
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [
        (5, f(a), 1, 0, ""), (9, f(a * 7), 1, 0, ""), (2, f(near(r, a, 0.995)), 1, 0, ""), (3, f(a), 2, 0, ""), (4, f(a), None, 0, ""),
        (6, None, 1, 0, ""), (7, [], 1, 0, ""), (8, [0.0] * 16, 1, 0, ""), (10, [float("nan")] + f(a)[1:], 1, 0, ""),
        (11, [float("inf")] + f(a)[1:], 1, 0, ""), (12, [None] + f(a)[1:], 1, 0, ""), (13, f(a)[:8], 1, 0, ""), (14, f(a)[:8], 1, 0, ""),
        (15, f(b), 1, 0, ""), (16, f(-b), 1, 0, ""), (17, f(b), 1, 0, ""), (18, f(b), 1, 0, ""), (None, f(b), 1, 0, ""),
        (19, [1e-30] * 16, 3, 0, ""), (20, [2e30] * 16, 3, 0, ""), (21, [-0.0, 1.0], 4, 0, ""), (22, [0.0, 1.0], 4, 0, ""),
        (23, [1.0], 5, 0, ""), (24, [2.0], 5, 0, ""), (25, [-2.0], 5, 0, "")]
    check(spark, rows + [rows[0]])


def test_hot_group_and_recall_near_the_threshold(spark):
    """A group larger than a block, and pairs just above and below the threshold."""
    r = np.random.default_rng(2)
    rows, k = [], 0
    hub = r.standard_normal(64)
    hub /= np.linalg.norm(hub)
    for _ in range(I.BLOCK + 100):
        rows.append((k, [float(x) for x in np.float32(near(r, hub, 0.999))], 0, 0, ""))
        k += 1
    for _ in range(150):
        v = r.standard_normal(64)
        v /= np.linalg.norm(v)
        for c in (1.0, 0.981, 0.979):
            rows.append((k, [float(x) for x in np.float32(near(r, v, c) if c < 1 else v)], 1 + k % 3 * 0, 0, ""))
            k += 1
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["vec_id"]: x["n_links"] for x in I.embedding_groups(df).collect()}
    u = np.array([x[1] for x in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.array([x[2] for x in rows])
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    exp = link.sum(axis=1)
    found = sum(got.values())
    assert found >= 0.99 * exp.sum()
    assert all(got[i] <= exp[i] for i in got)
    tail = [i for i in range(I.BLOCK + 100, k)]
    assert sum(got[i] for i in tail) >= 0.97 * exp[tail].sum() > 0


def test_empty_table(spark):
    assert I.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_is_one():
    r = np.random.default_rng(0)
    w = I.learn_rotation(r.standard_normal((500, 24)), 24, 1)
    assert np.allclose(w.T @ w, np.eye(24))


def test_other_number_types(spark):
    for kind in ("double", "int", "decimal(10,2)"):
        df = spark.sql(f"SELECT id, CAST(array(id % 3 + 1, 2, 3, 4) AS array<{kind}>) AS embedding, 'x' AS label FROM range(9)")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in I.embedding_groups(df, "id", "embedding").collect()}
        v = np.array([[k % 3 + 1, 2, 3, 4] for k in range(9)], float)
        u = v / np.linalg.norm(v, axis=1)[:, None]
        link = u @ u.T >= 0.98
        assert {k: got[k][0] for k in range(9)} == {k: int(link[k].sum()) - 1 for k in range(9)}


def test_codes_differ_where_vectors_do():
    r = np.random.default_rng(3)
    x = r.standard_normal((40, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1] = near(r, x[0], 0.98)
    code = np.concatenate([I.substrings(x @ w >= 0, 12) for w in I.rotations_for({}, 64, 3)], axis=1).astype(np.int32)
    everyone = np.arange(40)
    assert set(I.near_codes(code, everyone, everyone, 180)) == {0, 1}
    assert set(I.near_codes(code, np.arange(1), np.arange(1, 40), 180)) == {0, 1}


def test_substrings():
    r = np.random.default_rng(3)
    for bits, sub, tables, width in ((64, 12, 5, 12), (64, 20, 3, 20), (24, 12, 2, 12), (7, 12, 1, 7)):
        signs = r.random((50, bits)) < 0.5
        keys = I.substrings(signs, sub)
        assert keys.shape == (50, tables) and keys.max() < 2**width
        assert sum(bin(int(k)).count("1") for k in keys.ravel()) == signs[:, :tables * width].sum()


def test_plan_follows_the_number_of_vectors():
    """Buckets stay small as vectors grow, and a pair at the threshold keeps its chance."""
    p = 1 - math.acos(0.98) / math.pi
    for n in (0, 1, 10**4, 10**6, 10**9):
        bits, rotations = I.plan(n, 0.98)
        assert n / 2**bits <= I.BUCKET and (1 - p**bits) ** (rotations * (64 // bits)) <= I.MISS * 1.01
    assert I.plan(10**9, 0.98)[0] > I.plan(10**4, 0.98)[0]


def test_plan_follows_the_dimensions():
    """Short codes have fewer tables a rotation, so they get more rotations."""
    p = 1 - math.acos(0.98) / math.pi
    for d in (1, 2, 8, 16, 24, 32, 64, 300):
        bits, rotations = I.plan(1000, 0.98, d)
        tables, width = I.shape(min(I.CODE_BITS, d), bits)
        assert (1 - p**width) ** (rotations * tables) <= I.MISS * 1.01
    assert I.plan(1000, 0.98, 64) == I.plan(1000, 0.98)


def test_few_dimensions_lose_no_pairs(spark):
    """Pairs at the threshold in 2 and 16 dimensions, each pair with a label of its own."""
    r = np.random.default_rng(6)
    rows = []
    for k in range(1000):
        v = r.standard_normal(16 if k % 2 else 2)
        v /= np.linalg.norm(v)
        rows += [(2 * k + j, [float(x) for x in np.float32(x)], k, 0, "") for j, x in enumerate((v, near(r, v, 0.9801)))]
    got = sum(x["n_links"] for x in I.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got >= 2 * 998
