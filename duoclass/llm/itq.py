"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

1. Rotations are learned on a bounded sample by iterative quantisation: starting from a
   random one, the signs of the rotated vectors and the rotation that fits them best
   are computed in turn, which spreads the variance over the bits.  Vectors are scaled to
   length one and not centred: centring would widen the angle of near copies wherever
   the mean is long, and the angle is what decides.
2. The signs under each rotation are a code of up to 64 bits, cut into as many substrings
   of ``SUB_BITS`` bits or more as fit.  Each substring is the key of one table, so two
   vectors whose codes differ in fewer places than there are tables meet in at least one.
   Substrings grow with the logarithm of the number of vectors, so that buckets don't
   grow with it, and rotations are added until at most ``MISS`` of the pairs at the
   threshold share no table (:func:`plan`).
3. Members of a bucket are compared by their codes first.  Those with no other within
   ``NEAR_SHARE`` of the bits drop out, so few vectors are sent to the tables at all (at a
   cosine of 0.98 about 6 per cent of the bits differ, of unrelated vectors half).
4. The rest are compared with their original vectors.  A pair belongs to the first table
   in which its substrings agree, so no pair is counted twice and none is written: a
   bucket gives each member its number of links and one edge to the smallest member that
   it is connected with.

Equal vectors are one class with a weight.  A bucket of more than ``BLOCK`` members is
compared in pairs of blocks, each a task's small piece; nothing is capped.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoclass.llm.common import batch_of, cut, prepare, small_or_shuffled
from duoclass.llm.components import connected_components

SAMPLE_ROWS = 10_000      # vectors that the rotations are learned on, at most
SAMPLE_CELLS = 4_000_000  # and their components
CODE_BITS = 64
SUB_BITS = 12             # bits of a substring, at least
BUCKET = 256              # vectors of a bucket aimed at
MISS = 1e-4               # of the pairs at the threshold
NEAR_SHARE = 0.25
FEW_DIMS = 8              # below, too few bits for NEAR_SHARE to tell anything
ROUNDS = 30
BLOCK = 512


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """(dimensions, bits): principal directions and the rotation that fits their signs."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    bits = min(bits, d)
    _, v = np.linalg.eigh(x.T @ x)
    w = v[:, ::-1][:, :bits]
    y = x @ w
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds if len(x) else 0):
        b = np.where(y @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(y.T @ b, full_matrices=False)
        r = u @ vt
    return w @ r


def plan(n: int, min_cos: float, d: int = CODE_BITS) -> tuple[int, int]:
    """(bits of a substring, rotations) for ``n`` vectors of ``d`` dimensions.

    A bit differs with probability angle / pi.  :func:`shape` gives a code's tables.
    """
    bits = min(max(SUB_BITS, math.ceil(math.log2(max(n, 1) / BUCKET + 1))), 24)
    p = 1 - math.acos(min(1.0, min_cos)) / math.pi
    each, width = shape(min(CODE_BITS, d), bits)
    tables = math.log(MISS) / math.log(1 - min(p**width, 1 - 1e-9))
    return bits, max(1, math.ceil(tables / each))


def rotations_for(sample: dict[int, np.ndarray], d: int, n: int) -> list[np.ndarray]:
    """``n`` learned rotations of ``d`` dimensions; random ones if none were sampled."""
    x = sample.get(d, np.zeros((0, d)))
    return [learn_rotation(x, CODE_BITS, 100 + i) for i in range(n)]


def shape(bits: int, sub_bits: int) -> tuple[int, int]:
    """(substrings, their width) of a code; bits beyond them aren't used."""
    return max(1, bits // sub_bits), min(bits, sub_bits)


def substrings(signs: np.ndarray, sub_bits: int) -> np.ndarray:
    """(rows, tables) keys of ``sub_bits`` bits, or of all bits where there are fewer."""
    tables, width = shape(signs.shape[1], sub_bits)
    used = signs[:, :tables * width].astype(np.int64).reshape(len(signs), tables, width)
    return (used << np.arange(width)).sum(axis=2)


def linkable(col) -> tuple[list, list]:
    """(place, vector) of the vectors that can link with others."""
    at, out = [], []
    for i, v in enumerate(col):
        if not v.is_valid:
            continue
        values = v.values
        if values is None or not len(values) or values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False)
        if np.isfinite(x).all() and x.any():
            at.append(i)
            out.append(x + x.dtype.type(0))  # no minus zeros
    return at, out


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors of one number of dimensions as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(batches):
    """(id, label, d, print, vec) of the rows that can link; vec in the column's precision."""
    for rb in batches:
        at, rows = linkable(rb.column(2))
        vec = [x.tobytes() for x in rows]
        take = pa.array(at, pa.int64())
        yield batch_of(["id", "label", "d", "print", "vec"], rb.column(0).take(take), rb.column(1).take(take),
                       pa.array([len(x) for x in rows], pa.int32()),
                       pa.array([blake2b(v, digest_size=16).digest() for v in vec], pa.binary()), pa.array(vec, pa.binary()))


def _bucket_rows(models, kind: str, with_vec: bool, plans: dict[int, tuple[int, int]]):
    """A row per vector and table; the vector itself only where it is asked for."""
    def run(batches):
        made = models.value
        for rb in batches:
            label, d, ids, w = rb.column(0), rb.column(1).to_numpy(), rb.column(2), rb.column(3)
            for dim in np.unique(d):
                at = np.flatnonzero(d == dim)
                x = units(rb.column(4).take(pa.array(at)).to_pylist(), kind)
                sub_bits, rotations = plans[int(dim)]
                if dim not in made:
                    made[dim] = rotations_for({}, int(dim), rotations)
                keys = np.concatenate([substrings(x @ r >= 0, sub_bits) for r in made[dim]], axis=1)
                code = [k.tobytes() for k in keys.astype(np.int32)]
                tables = keys.shape[1]
                idx = pa.array(np.repeat(at, tables))
                rep = np.repeat(np.arange(len(at)), tables)
                yield batch_of(["label", "d", "t", "key", "id", "w", "code", "vec"], label.take(idx),
                               pa.array(np.full(len(rep), dim), pa.int32()), pa.array(np.tile(np.arange(tables), len(at)), pa.int32()),
                               pa.array(keys.ravel(), pa.int64()), ids.take(idx), w.take(idx),
                               pa.array(code, pa.binary()).take(pa.array(rep)),
                               rb.column(4).take(idx) if with_vec else pa.nulls(len(rep), pa.binary()))

    return run


def compare(t: int, ids, w, code, vec, left, right, min_cos: float):
    """(ids, links, root id) of the members linked in this bucket by its own pairs.

    ``left`` and ``right`` are the members compared with each other; where they are the
    same, each pair counts once.
    """
    x, y = vec[left], vec[right]
    a, b = np.nonzero(x @ y.T >= min_cos)
    a, b = left[a], right[b]
    keep = a < b if left is right or np.array_equal(left, right) else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    if t and len(a):
        # a pair that agrees in an earlier table is that table's
        own = ~(code[a, :t] == code[b, :t]).any(axis=1)
        a, b = a[own], b[own]
    if not len(a):
        return None
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, w[b])
    np.add.at(links, b, w[a])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    low = rank.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[order][low]  # jump to the label of the label
        if np.array_equal(low, before):
            break
    m = np.flatnonzero(links)
    return ids[m], links[m], ids[order][low[m]]


GROUP = ["label", "d", "t", "key", "i", "j"]


def _groups(batches, work):
    """``work`` on each bucket (or pair of its blocks) with two members or more."""
    group, key = [], None
    for rb in batches:
        for r in zip(*(c.to_pylist() for c in rb.columns)):
            if r[:6] != key:
                if len(group) > 1:
                    yield work(group)
                group, key = [], r[:6]
            group.append(r)
    if len(group) > 1:
        yield work(group)


def _sides(rows):
    """Members of the two blocks that are compared (the same for a block with itself)."""
    i, j = rows[0][4], rows[0][5]
    side = np.array([r[8] for r in rows])
    left = np.flatnonzero(side == i)
    return left, left if i == j else np.flatnonzero(side == j)


def _codes(rows) -> np.ndarray:
    return np.frombuffer(b"".join(r[9] for r in rows), np.int32).reshape(len(rows), -1)


def near_codes(code: np.ndarray, left: np.ndarray, right: np.ndarray, n_bits: int) -> np.ndarray:
    """Members with another one whose code differs in at most NEAR_SHARE of the bits."""
    used = np.flatnonzero(np.bitwise_or.reduce(code, axis=0)[:, None] >> np.arange(32) & 1)
    bits = ((code[:, :, None] >> np.arange(32)) & 1).reshape(len(code), -1)[:, used].astype(np.float32) * 2 - 1
    # agreements less differences; a bit that no member has set agrees everywhere
    rest = n_bits - len(used)
    near = bits[left] @ bits[right].T + rest >= n_bits * (1 - 2 * NEAR_SHARE)
    if left is right:
        np.fill_diagonal(near, False)
    return np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])


def _near_rows(plans: dict[int, tuple[int, int]]):
    def work(rows):
        left, right = _sides(rows)
        if rows[0][1] < FEW_DIMS:
            return [rows[i][6] for i in np.union1d(left, right)]
        sub_bits, rotations = plans[rows[0][1]]
        n_bits = rotations * math.prod(shape(min(CODE_BITS, rows[0][1]), sub_bits))
        hit = near_codes(_codes(rows), left, right, n_bits) if len(left) and len(right) else []
        return [rows[i][6] for i in hit]

    def run(batches):
        seen: set = set()
        for ids in _groups(batches, work):
            seen.update(ids)
            if len(seen) > 100_000:
                yield batch_of(["id"], pa.array(list(seen), pa.int64()))
                seen = set()
        if seen:
            yield batch_of(["id"], pa.array(list(seen), pa.int64()))

    return run


def _link_rows(min_cos: float, kind: str):
    names = ["id", "links", "root"]

    def work(rows):
        left, right = _sides(rows)
        if not len(left) or not len(right):
            return None
        ids, w = (np.array([r[c] for r in rows], np.int64) for c in (6, 7))
        return compare(rows[0][2], ids, w, _codes(rows), units([r[10] for r in rows], kind), left, right, min_cos)

    def run(batches):
        out, size = [], 0
        for x in _groups(batches, work):
            if x:
                out.append(x)
                size += len(x[0])
                if size > 50_000:
                    yield batch_of(names, *(np.concatenate(c) for c in zip(*out)))
                    out, size = [], 0
        if out:
            yield batch_of(names, *(np.concatenate(c) for c in zip(*out)))

    return run


def _dealt(buckets: DataFrame) -> DataFrame:
    """Bucket rows with the blocks they are compared in, a bucket's rows together."""
    at = ["label", "d", "t", "key"]
    large = cut(buckets.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
                .select(*at, F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "itq-large")
    k = F.coalesce("k", F.lit(1))
    sized = buckets.join(small_or_shuffled(large, large.count()), at, "left")
    return (sized.withColumn("side", F.pmod(F.xxhash64("id"), k).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), k - 1)))
            .withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
            .select(*GROUP, "id", "w", "side", "code", "vec").repartition(*GROUP).sortWithinPartitions(*GROUP))


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     min_cos: float = 0.98, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``.

    Vectors are compared within a label and a number of dimensions.  Vectors that are
    null, empty, zero or hold a null or non-finite component, rows without a label and
    rows without an id link with nothing; a row without an id has no component and is
    kept.  Rows that repeat an id are vectors of their own under one id.  Other columns
    aren't read.
    """
    spark = df.sparkSession
    prepare(spark)
    single = df.schema[vec_col].dataType.elementType.typeName() == "float"
    kind = "f4" if single else "f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                     F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    known = cut(rows.where("id IS NOT NULL AND label IS NOT NULL")
                .mapInArrow(_classes, "id long, label string, d int, print binary, vec binary"), "itq-vectors")
    classes = cut(known.groupBy("label", "print").agg(F.min("id").alias("id"), F.count("*").alias("w"),
                                                      F.first("d").alias("d"), F.first("vec").alias("vec")), "itq-classes")
    n, d = classes.agg(F.count("*"), F.max("d")).first()
    take = max(1, min(sample_rows, SAMPLE_CELLS // max(d or 1, 1)))
    share = int(min(1.0, 1.2 * take / max(n, 1)) * (1 << 30))
    sample: dict[int, list] = {}
    for r in classes.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < share).select("d", "vec").limit(take).toLocalIterator():
        sample.setdefault(r["d"], []).append(bytes(r["vec"]))
    arrays = {k: units(x, kind) for k, x in sample.items()}
    most = classes.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n")).collect()
    plans = {r["d"]: plan(r["n"], min_cos, r["d"]) for r in most}
    models = spark.sparkContext.broadcast({k: rotations_for(arrays, k, plans[k][1]) for k in arrays})

    schema = "label string, d int, t int, key long, id long, w long, code binary, vec binary"
    members = classes.select("label", "d", "id", "w", "vec")
    near = cut(_dealt(members.mapInArrow(_bucket_rows(models, kind, False, plans), schema)).mapInArrow(_near_rows(plans), "id long").distinct(), "itq-near")
    members = members.join(small_or_shuffled(near, near.count()), "id", "left_semi").select("label", "d", "id", "w", "vec")
    linked = cut(_dealt(members.mapInArrow(_bucket_rows(models, kind, True, plans), schema))
                 .mapInArrow(_link_rows(min_cos, kind), "id long, links long, root long"), "itq-links")
    parts = connected_components(linked.select("id", "root").distinct(), "id", "root")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    found = (classes.select("label", "print", "id", "w").join(counts, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
             .select("label", "print", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id")))
    good = known.select("id", "label", "print").join(found, ["label", "print"]).select("id", "n_links", "component_id")
    # rows that can't link have no class
    rest = rows.mapInArrow(_unlinked, "id long").select("id", F.lit(0).cast("long"), F.col("id"))
    out = good.union(rest).toDF("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unlinked(batches):
    for rb in batches:
        ok = np.zeros(rb.num_rows, bool)
        ok[linkable(rb.column(2))[0]] = True
        ok &= rb.column(0).is_valid().to_numpy(zero_copy_only=False) & rb.column(1).is_valid().to_numpy(zero_copy_only=False)
        yield batch_of(["id"], rb.column(0).filter(pa.array(~ok)))
