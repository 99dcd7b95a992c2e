"""Near-duplicate groups: one-permutation MinHash, optimal densification, banded stars.

1. Every text becomes its set of hashed word shingles.  One hash of each shingle gives
   both its bin (top bits) and its rank, so one pass over the set fills all bins; an
   empty bin takes the value of the first filled one in a random order of its own
   (the same for every document), which keeps bins independent.
2. Documents with equal sets form one class, represented by the smallest id; only
   representatives are compared.
3. Bands of bins are buckets.  Candidates of a bucket form a star around its smallest
   member, so the pairs of a bucket grow with its members, not with their square.
4. Candidates are confirmed on the full sets (intersection and union), linked, and
   joined to components.  A star can miss a link between two of its leaves.  Buckets
   that still hold several components get a second centre, the pivot, and then all
   pairs across components that can be links at all: how much two sets share with a
   common pivot, and how many of their other shingles anyone else has, bounds their
   overlap and tells independent edits of one text apart without comparing them.
   Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoclass.llm.common import (BYTE_HASH, as_bytes, batch_of, cut, drop, mix, no_state, powers, prefix_sums, prepare,
                                 small_or_shuffled)
from duoclass.llm.components import connected_components

BINS = 128
BANDS = 32         # of 4 bins: at a similarity of 0.8 one pair in 2e7 shares no bucket
_BIN_SHIFT = np.uint64(64 - 7)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(977)
# place of each bin in the order that an empty bin tries the others in
_ORDER = np.argsort(_RANDOM.random((BINS, BINS)), axis=1).argsort(axis=1)
_BAND_MUL = _RANDOM.integers(0, 1 << 63, (BANDS, BINS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_MUL = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(b: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text's bytes.

    A-Z are lower-cased and words are separated by ASCII white space; with fewer than
    ``k`` words the whole sequence is the one shingle, without words there is none.
    """
    gap = _SPACE[b]
    edge = np.empty(len(b) + 1, bool)
    edge[0], edge[-1] = len(b) and not gap[0], len(b) and not gap[-1]
    edge[1:-1] = gap[1:] != gap[:-1]
    at = np.flatnonzero(edge)
    st, en = at[::2], at[1::2]
    if not len(st):
        return np.zeros(0, np.uint64)
    s = prefix_sums(BYTE_HASH[_LOWER[b]])
    w = mix((s[en] - s[st]) * powers(len(b) + 1)[1][st] + (en - st).astype(np.uint64))
    n = min(k, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h += mix(w[j:j + len(h)] * _WORD_MUL[j % 64] + np.uint64(j))
    return np.unique(mix(h + np.uint64(n)))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One bucket name per band of a non-empty set's densified bins."""
    b = (s >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))  # the set is sorted: the least of each bin
    filled = b[first]
    v = np.zeros(BINS, np.uint64)
    v[filled] = s[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        v[empty] = s[first][np.argmin(_ORDER[np.ix_(empty, filled)], axis=1)]
    return mix((v.reshape(BANDS, -1) * _BAND_MUL).sum(axis=1, dtype=np.uint64)
               + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _features(k: int):
    def run(batches):
        no_state()
        for rb in batches:
            data, off = as_bytes(rb.column(1))
            size, print_, bands = [], [], []
            for i in range(rb.num_rows):
                s = shingle_set(data[off[i]:off[i + 1]], k)
                size.append(len(s))
                print_.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(s) if len(s) else None)
            yield batch_of(["doc", "n", "print", "bands"], rb.column(0), pa.array(size, pa.int64()),
                           pa.array(print_, pa.binary()), pa.array(bands, pa.list_(pa.int64())))

    return run


def _sets(k: int):
    def run(batches):
        for rb in batches:
            data, off = as_bytes(rb.column(1))
            for lo in range(0, rb.num_rows, 200):
                part = rb.slice(lo, 200)
                sets = [shingle_set(data[off[i]:off[i + 1]], k).view(np.int64) for i in range(lo, lo + part.num_rows)]
                yield batch_of(["doc", "s"], part.column(0), pa.array(sets, pa.list_(pa.int64())))

    return run


def _overlaps(pairs: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) with their full sets' sizes and intersection: na, nb, both.

    The sets of the documents in ``pairs`` are made from their texts again; both sides
    of the pairs read one exchange of them.
    """
    ids = pairs.select("a").union(pairs.select("b")).distinct().toDF("doc")
    sets = text.join(small_or_shuffled(ids, ids.count()), "doc", "left_semi").mapInArrow(_sets(k), "doc long, s array<long>")
    a = sets.select(F.col("doc").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("doc").alias("b"), F.col("s").alias("sb"))
    return (pairs.join(a, "a").join(b, "b")
            .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both")))


def _linked(percent: int):
    """100 * intersection >= percent * union."""
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _close_sizes(x: str, y: str, percent: int):
    """Sets of such sizes can reach the similarity at all."""
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def _labelled(inside: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    keys = ["key", "band"]
    m = inside.join(labels, inside["doc"] == labels["node"], "left").select(
        *keys, "doc", "n", F.coalesce("component", "doc").alias("label"))
    open_ = (m.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo <> hi").select(*keys))
    return m.join(open_, keys).select(*keys, "doc", "n")


def _shared(members: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """(doc, s): how many of a member's shingles any other member has.

    Links of a document lie among the members, so its other shingles are in no
    intersection.
    """
    ids = members.select("doc").distinct()
    sets = text.join(small_or_shuffled(ids, ids.count()), "doc", "left_semi").mapInArrow(_sets(k), "doc long, s array<long>")
    rows = sets.select("doc", F.explode("s").alias("g"))
    often = rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    return rows.join(often, "g").groupBy("doc").agg(F.count("*").alias("s"))


def _pivots(members: DataFrame) -> DataFrame:
    """(a, b, n, s): members with their buckets' pivots b, the member of a bucket with the
    smallest share of shingles of its own (of an edited text that is mostly the original)."""
    keys = ["key", "band"]
    best = members.groupBy(*keys).agg(F.min(F.struct((-F.col("s") / F.col("n")).alias("r"), "doc")).alias("p"))
    return members.join(best, keys).select(F.col("doc").alias("a"), F.col("p.doc").alias("b"), "n", "s").distinct()


def _cross_pairs(around: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs with a common pivot in two components that can be links.

    Two sets share at most the fewer shingles that they have in common with the pivot,
    and the fewer of the others that any other member has.
    """
    m = (around.where(100 * F.col("s") >= percent * F.col("n")).join(labels, F.col("a") == labels["node"], "left")
         .select(F.col("b").alias("p"), F.col("a").alias("doc"), "n", "both", (F.col("s") - F.col("both")).alias("rest"),
                 F.coalesce("component", "a").alias("label")))
    other = m.select("p", *[F.col(x).alias(f"{x}2") for x in ("doc", "n", "both", "rest", "label")])
    most = F.least("both", "both2") + F.greatest(F.least("rest", "rest2"), F.lit(0))
    return (m.join(other, "p")
            .where((F.col("doc") < F.col("doc2")) & (F.col("label") != F.col("label2"))
                   & (100 * most >= percent * (F.col("n") + F.col("n2") - most)))
            .select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct())


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                          percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``df``.

    A null or empty text and one of white space only has an empty set and is linked
    with nothing.  A row without an id gets no component and is kept.  Rows that repeat
    an id get a row each by their own text.  Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    text = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    # made twice (here and for the result), which costs less than a written copy
    feat = text.mapInArrow(_features(shingle_words), "doc long, n long, print binary, bands array<long>")
    classes = cut(feat.where("doc IS NOT NULL AND n > 0").groupBy("print")
                  .agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "mh-classes")
    keys = ["key", "band"]
    member = classes.select(F.col("rep").alias("doc"), "n", F.posexplode("bands").alias("band", "key"))
    low = (member.groupBy(*keys).agg(F.min(F.struct("doc", "n")).alias("c"), F.count("*").alias("m"))
           .where("m > 1").select(*keys, "c"))
    inside = cut(member.join(low, keys).select(*keys, "doc", "n", "c"), "mh-buckets")
    stars = (inside.where((F.col("doc") != F.col("c.doc")) & _close_sizes("n", "c.n", percent))
             .select(F.col("c.doc").alias("a"), F.col("doc").alias("b")).distinct())
    linked = _linked(percent)
    labels = connected_components(_overlaps(stars, text, shingle_words).where(linked), "a", "b")

    # buckets with several components: every member against its buckets' pivots, then the
    # pairs of two components that the overlaps with a common pivot don't rule out
    members = _labelled(inside, labels)
    members = members.join(_shared(members, text, shingle_words), "doc")
    pivots = cut(_pivots(members), "mh-pivots")
    around = cut(pivots.join(_overlaps(pivots.where("a <> b").select("a", "b"), text, shingle_words), ["a", "b"]), "mh-around")
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stars
    labels = connected_components(links.union(around.where(linked).select("a", "b")), "a", "b")
    pairs = cut(_cross_pairs(around, labels, percent), "mh-pairs")
    if not pairs.isEmpty():
        links = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        more = _overlaps(pairs, text, shingle_words).where(linked).select("a", "b")
        labels = connected_components(links.union(more), "a", "b")
    for t in (pivots, around, pairs):
        drop(t)
    drop(inside)

    rep = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        F.col("print"), F.coalesce("component", "rep").alias("component"))
    out = feat.select("doc", "n", "print").join(rep, "print", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
