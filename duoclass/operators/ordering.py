"""Seeded shuffles, splits, mini-batches and row slices on an exact global index.

Recipe: an exact 0-based position in a total order without one big sort task.

1. Give every row a bucket that is *monotone* in the order: the leading hex digits
   of the md5 order key (hash order, uniform by construction), or the bin of an
   approximate quantile of a unique key (key order).
2. Count rows per bucket (map-side partial aggregation; one row per bucket).
3. A running sum over the bucket counts gives each bucket's offset.  The table
   has as many rows as buckets; it is broadcast up to ``BROADCAST_BUCKETS`` of
   them and joined with a shuffle beyond.
4. ``row_number()`` inside the bucket, plus the offset.

There are at least as many buckets as shuffle partitions and, in hash order, as many
as it takes for about ``rows_per_bucket`` rows each; no bucket can be hot, as the hash
is uniform and the key order requires unique keys.  Rows without a key come last.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from duoclass.functions.columns import round_half_away
from duoclass.functions.hashing import hex_bucket, seeded_hex

ROWS_PER_BUCKET = 2_000_000
MAX_HEX_CHARS = 8        # 4 billion buckets
MAX_KEY_BUCKETS = 65_536  # cut points that reach the driver, in key order
BROADCAST_BUCKETS = 1 << 20  # an offsets table of ~16 MB
# Size parameter of the quantile sketch (its rank error is about 1.7 / size).
LEAST_SKETCH, MOST_SKETCH, SKETCH_PER_BUCKET = 1024, 65_535, 8
SKETCH_ERROR = 1e-3      # of the row cap's thresholds; fixes the size of their sketch


def _least_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _offsets(df: DataFrame, bucket: str) -> DataFrame:
    """(bucket, rows, rows in all buckets before it); one row per bucket."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(bucket, "_n", F.coalesce(before, F.lit(0)).alias("_off"))


def _index_from_buckets(df: DataFrame, bucket: str, order: list[Column | str], name: str,
                        n_buckets: int) -> DataFrame:
    offsets = _offsets(df, bucket).drop("_n")
    joined = df.join(F.broadcast(offsets) if n_buckets <= BROADCAST_BUCKETS else offsets, bucket)
    w = Window.partitionBy(bucket).orderBy(*order)
    return joined.withColumn(name, (F.row_number().over(w) - F.lit(1) + F.col("_off")).cast("long")
                             ).drop("_off", bucket)


def _hex_chars_for(df: DataFrame, n_rows: int, rows_per_bucket: int) -> int:
    need = max(_least_buckets(df), n_rows / float(rows_per_bucket))
    return int(min(MAX_HEX_CHARS, max(1, math.ceil(math.log(need, 16)))))


def _hashed(df: DataFrame, key: str, seed: int | str, h: str, n_chars: int) -> DataFrame:
    """The order hash and its bucket; rows without a key are in the last bucket."""
    return (df.withColumn(h, seeded_hex(seed, F.col(key)))
              .withColumn("_b", F.coalesce(hex_bucket(F.col(h), n_chars), F.lit(16 ** n_chars))))


def shuffled_index(df: DataFrame, key: str, seed: int | str, name: str = "ix",
                   n_rows: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
                   keep_hash: bool = False) -> DataFrame:
    """Position of each row in the seeded permutation ``order by md5(seed:key), key``.

    ``key`` must be unique.  Equal to ``row_number() over (order by md5(...), key) - 1``.
    """
    n = n_rows if n_rows is not None else df.count()
    n_chars = _hex_chars_for(df, n, rows_per_bucket)
    h = "_h" if not keep_hash else f"{name}_hash"
    out = _index_from_buckets(_hashed(df, key, seed, h, n_chars), "_b",
                              [F.col(h).asc_nulls_last(), F.col(key)], name, 16 ** n_chars + 1)
    return out if keep_hash else out.drop(h)


def quantile_sketch(df: DataFrame, col: str, k: int) -> DataFrame:
    """One row with a mergeable quantile sketch (KLL) of a numeric column's values.

    Its size is fixed by ``k``, however many rows there are.  Each input partition makes one;
    they are merged in two levels, so no task receives one from every partition.
    """
    v = df.select(F.col(col).cast("double").alias("_q")).where("_q IS NOT NULL AND NOT isnan(_q)")
    salts = max(1, math.isqrt(v.rdd.getNumPartitions()))
    parts = v.groupBy((F.spark_partition_id() % salts).alias("_salt")).agg(F.kll_sketch_agg_double("_q", F.lit(k)).alias("_s"))
    return parts.agg(F.kll_merge_agg_double("_s", F.lit(k)).alias("sketch"), F.count("*").alias("parts"))


def quantile_cuts(df: DataFrame, col: str, n_buckets: int) -> list[float]:
    """``n_buckets - 1`` approximate quantiles of a numeric column, deduplicated.

    Read from a sketch of fixed size on the executors; only the cut points reach the driver -
    a list whose length is the caller's bound.
    """
    if n_buckets <= 1:
        return []
    sketch = quantile_sketch(df, col, min(MOST_SKETCH, max(LEAST_SKETCH, SKETCH_PER_BUCKET * n_buckets)))
    # a literal of one string: thousands of literal columns would take seconds to build
    ranks = F.split(F.lit(",".join(repr(i / n_buckets) for i in range(1, n_buckets))), ",").cast("array<double>")
    q = sketch.where("parts > 0").select(F.kll_sketch_get_quantile_double("sketch", ranks).alias("q")).first()
    return sorted({float(c) for c in (q["q"] if q else []) if c is not None and not math.isnan(c)})


def key_buckets(df: DataFrame, key: str, n_buckets: int, out: str = "_b") -> tuple[DataFrame, int]:
    """Monotone buckets of a numeric column from approximate quantiles (Spark ML's
    Bucketizer bins by binary search inside the JVM)."""
    cuts = quantile_cuts(df, key, n_buckets)
    return bucketize(df, key, cuts, out), len(cuts) + 1


def bucketize(df: DataFrame, col: str, cuts: list[float], out: str = "_b") -> DataFrame:
    """Monotone bucket index from sorted cut points (binary search in the JVM)."""
    splits = [-math.inf] + sorted(set(cuts)) + [math.inf]
    tmp = f"{out}_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    # null and NaN go to a bucket of their own, after all others
    return (b.transform(df.withColumn(tmp, F.col(col).cast("double"))).drop(tmp)
             .withColumn(out, F.coalesce(F.col(out), F.lit(float(len(splits) - 1)))))


def ordered_index(df: DataFrame, key: str, name: str = "ix", n_rows: int | None = None,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Position of each row in ``order by key`` (file order when ``key`` is the row id).

    ``key`` must be unique and numeric.
    """
    n = n_rows if n_rows is not None else df.count()
    nb = int(min(MAX_KEY_BUCKETS, max(_least_buckets(df), math.ceil(n / float(rows_per_bucket)))))
    b, nb = key_buckets(df, key, nb)
    return _index_from_buckets(b, "_b", [F.col(key).asc_nulls_last()], name, nb + 1)


def split_bounds(n: int, train_frac: float, drop_edges: bool) -> tuple[int, int, int, int]:
    """[train_lo, train_hi) and [test_lo, test_hi) on a 0-based index of n rows.

    ``k = round(train_frac * n)`` (halves away from zero).  With ``drop_edges`` the
    last row of each side is lost, as in the slicing ``[0:k-1]`` / ``[k:n-1]`` the
    shuffled split was written with.
    """
    k = round_half_away(train_frac * n)
    d = 1 if drop_edges else 0
    return 0, max(0, k - d), k, max(k, n - d)


def _label_split(ix: Column, n: int, train_frac: float, drop_edges: bool) -> Column:
    a, b, c, d = split_bounds(n, train_frac, drop_edges)
    return (F.when((ix >= F.lit(a)) & (ix < F.lit(b)), F.lit("train"))
            .when((ix >= F.lit(c)) & (ix < F.lit(d)), F.lit("test")))


def split_shuffled(df: DataFrame, key: str, seed: int | str, train_frac: float = 0.67,
                   drop_edges: bool = False, n_rows: int | None = None) -> DataFrame:
    """Seeded shuffle, then the first ``round(p*n)`` positions train, the rest test.

    Adds ``ix`` (position in the permutation) and ``split``; with ``drop_edges`` the
    two rows the slicing lost are removed.
    """
    n = n_rows if n_rows is not None else df.count()
    ixd = shuffled_index(df, key, seed, "ix", n_rows=n)
    return ixd.withColumn("split", _label_split(F.col("ix"), n, train_frac, drop_edges)).filter(
        F.col("split").isNotNull())


def split_ordered(df: DataFrame, key: str, train_frac: float = 0.67, n_rows: int | None = None) -> DataFrame:
    """No shuffle: the first ``round(p*n)`` rows in key order train, the rest test."""
    n = n_rows if n_rows is not None else df.count()
    ixd = ordered_index(df, key, "ix", n_rows=n)
    return ixd.withColumn("split", _label_split(F.col("ix"), n, train_frac, False))


def minibatches(df: DataFrame, batch_size: int, ix: str = "ix", short: bool = True,
                n_rows: int | None = None) -> DataFrame:
    """Assign ``batch = ix div B`` and ``pos`` inside it; keep ``n div B`` batches.

    ``short=True`` reproduces slices ``[jB, (j+1)B - 1)``: the last position of every
    batch is dropped, so a batch has B-1 rows.  The tail after the last full batch
    is dropped either way.
    """
    n = n_rows if n_rows is not None else df.count()
    nb = n // batch_size
    B = F.lit(int(batch_size))
    out = (df.withColumn("batch", (F.col(ix) / B).cast("long"))
             .withColumn("pos", (F.col(ix) % B).cast("long"))
             .filter(F.col("batch") < F.lit(nb)))
    if short:
        out = out.filter(F.col("pos") != F.lit(batch_size - 1))
    return out


def row_slices(df: DataFrame, size: int, ix: str = "ix", n_rows: int | None = None) -> DataFrame:
    """The slices a sparse training loop feeds: ``slice(data, j*size, size)`` for
    ``j < n div size``; a slice whose end reaches the last row runs to the end.
    Adds ``slice`` and ``row`` (position inside the slice, rows re-indexed from 0).
    """
    n = n_rows if n_rows is not None else df.count()
    nb = n // size
    j = F.least((F.col(ix) / F.lit(size)).cast("long"), F.lit(max(nb - 1, 0)))
    # A slice with start + size >= n runs to the end; all earlier ones are exact.
    last_runs_to_end = (nb > 0) and (nb * size >= n)
    in_range = F.col(ix) < F.lit(nb * size) if not last_runs_to_end else F.lit(True)
    out = df.filter(in_range).withColumn("slice", j)
    return out.withColumn("row", (F.col(ix) - F.col("slice") * F.lit(size)).cast("long"))


def row_slice(df: DataFrame, start: int, size: int = -1, ix: str = "ix",
              n_rows: int | None = None) -> DataFrame:
    """One slice ``[start, start+size)``; ``size=-1`` or an overrun runs to the end."""
    n = n_rows if n_rows is not None else df.count()
    if size == -1 or start + size >= n:
        cond = F.col(ix) >= F.lit(start)
    else:
        cond = (F.col(ix) >= F.lit(start)) & (F.col(ix) < F.lit(start + size))
    return df.filter(cond).withColumn("row", (F.col(ix) - F.lit(start)).cast("long"))


def first_rows(df: DataFrame, key: str, n: int, name: str = "ix", n_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows in ``order by key`` (unique numeric key), with their index.

    A row cap should not cost a global sort or a shuffle of every row.  An approximate
    quantile gives a key threshold that passes somewhat more than ``n`` rows;
    ``key <= t`` is pushed down to the scan and counted.  The quantile's error is fixed
    (``SKETCH_ERROR`` of the rows looked at), so its sketch doesn't grow with the table;
    instead the threshold is sharpened on the rows that pass until few too many do.
    The exact index is then computed on those rows only.
    """
    total = n_rows if n_rows is not None else df.count()
    if n >= total:
        return ordered_index(df, key, name, n_rows=total)
    # a literal of the key's own type keeps the comparison pushable to the scan
    integral = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    head, m = df.filter(F.col(key).isNotNull()), total
    while m > n + n // 5 + 1000:
        frac = min(1.0, n / m + 2 * SKETCH_ERROR)
        t = head.select(F.col(key).cast("double").alias("_k")).approxQuantile("_k", [frac], SKETCH_ERROR)
        if not t:
            break
        lit = F.lit(int(math.ceil(t[0]))).cast(df.schema[key].dataType) if integral else F.lit(t[0])
        low = df.filter(F.col(key) <= lit)
        k = low.count()
        if k < n or k >= m:
            break
        head, m = low, k
    if m == total:
        head = df
    return ordered_index(head, key, name, n_rows=m).filter(F.col(name) < F.lit(n))


def split_shuffled_fast(df: DataFrame, key: str, seed: int | str, train_frac: float = 0.67,
                        drop_edges: bool = False, n_rows: int | None = None,
                        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Same rows and ``split`` labels as :func:`split_shuffled`, without the global index.

    A bucket that holds no split boundary lies wholly inside one side and its rows are
    labelled by the join with the bucket table; only the rows of the at most three
    boundary buckets are ranked.
    """
    n = n_rows if n_rows is not None else df.count()
    a, b, c, d = split_bounds(n, train_frac, drop_edges)
    n_chars = _hex_chars_for(df, n, rows_per_bucket)
    hb = _hashed(df, key, seed, "_h", n_chars)

    def side(ix: Column) -> Column:
        return (F.when((ix >= a) & (ix < b), F.lit("train")).when((ix >= c) & (ix < d), F.lit("test"))
                .otherwise(F.lit("drop")))

    inside = F.lit(False)
    for p in (b, c, d):
        inside = inside | ((F.col("_off") < p) & (F.col("_off") + F.col("_n") > p))
    buckets = _offsets(hb, "_b").select("_b", "_off", F.when(~inside, side(F.col("_off"))).alias("split"))
    joined = hb.join(F.broadcast(buckets) if 16 ** n_chars < BROADCAST_BUCKETS else buckets, "_b")
    w = Window.partitionBy("_b").orderBy(F.col("_h").asc_nulls_last(), key)
    ranked = (joined.filter(F.col("split").isNull())
              .withColumn("split", side(F.row_number().over(w) - F.lit(1) + F.col("_off"))))
    out = joined.filter(F.col("split").isNotNull()).unionByName(ranked)
    return out.filter(F.col("split") != F.lit("drop")).drop("_h", "_b", "_off")
