"""Benchmark decontamination: size-partitioned MinHash containment search, then exact.

DataFrame functions only.  A document contains an item when it holds at least
``percent`` per cent of the item's distinct word shingles.

* Sketch of an item: the bottom of its shingles in hash order.  An item of n shingles
  may miss at most n - ceil(n * percent / 100) of them, so with one more than that in
  its sketch every containing document shares at least one sketch value: the search
  loses nothing.
* Items are partitioned by size (powers of two).  All items of a partition have their
  sketches below one hash value, its ceiling, which falls as items grow.  A document
  is searched in a partition only if it has enough shingles for its smallest item, and
  only with its own hashes up to the ceiling.
* Candidates (document, item) are confirmed on the full sets: the item's shingles that
  the document holds are counted exactly.

The document side is one pass over the text without a shuffle as long as the items'
sketches are small (their rows are counted before they are broadcast); beyond that
they meet in a shuffle join.  Candidate documents are read again for the confirmation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoclass.llm.common import cut, prepare, small_or_shuffled



def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.split(F.regexp_replace(low, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"[^\p{L}\p{N}]+")


def shingles(w: Column, k: int) -> Column:
    """Structs of ``k`` words in a row; none where there are fewer words."""
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, F.lit(j + 1), n).alias(f"w{j}") for j in range(k)])


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.col(f"g.w{j}") for j in range(k)])


def shingle_rows(df: DataFrame, id_cols: list[str], text_col: str, ks: list[int]) -> DataFrame:
    """One row (ids, n places of that length, h) per shingle place of each text, for each of
    the lengths ``ks``."""
    w = df.select(*id_cols, words(F.col(text_col)).alias("w"))
    parts = [w.select(*id_cols, (F.size("w") - (k - 1)).alias("n_places"), F.explode(shingles(F.col("w"), k)).alias("g"))
             .select(*id_cols, "n_places", _hash(k).alias("h")) for k in ks]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def item_sets(items: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, list[int]]:
    """(item, h, n): each item's distinct shingles and their number; the shingles' lengths.

    An item of fewer than ``k`` words (but one or more) has its whole sequence as its only
    shingle, so texts are searched for sequences of that length as well.
    """
    own = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).where("item IS NOT NULL")
    w = words(F.col("t"))
    n = F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w))
    sized = own.select("item", "t", n.alias("n_words"))
    short = sorted(r["n_words"] for r in sized.where(F.col("n_words").between(1, k - 1)).select("n_words").distinct().collect())
    rows = shingle_rows(own, ["item"], "t", [k]).select("item", "h")
    for m in short:
        rows = rows.unionByName(shingle_rows(sized.where(F.col("n_words") == m), ["item"], "t", [m]).select("item", "h"))
    sets = rows.distinct()
    return sets.join(sets.groupBy("item").agg(F.count("*").alias("n")), "item"), [k, *short]


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """(item, h, n, part): the bottom of each item's shingles that no containing text can miss."""
    need = F.ceil(F.col("n") * percent / 100)
    of_item = (sets.groupBy("item", "n").agg(F.sort_array(F.collect_list("h")).alias("hs"))
               .select("item", "n", F.slice("hs", F.lit(1), (F.col("n") - need + 1).cast("int")).alias("hs")))
    return of_item.select("item", "n", F.floor(F.log2("n")).cast("int").alias("part"), F.explode("hs").alias("h"))


def contained_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents and the items that they contain.

    ``n_item`` is the number of the item's distinct shingles, ``n_shared`` how many of
    them the document holds.  Texts and items that are null, empty or shorter than
    ``shingle_words`` words have no shingles and contain nothing.  Rows without an id are
    left out (no pair could name them).  Rows that repeat an id are one document (one
    item) with all their shingles.  Other columns aren't read.
    """
    spark = df.sparkSession
    prepare(spark)
    k = shingle_words
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).where("doc IS NOT NULL")
    sets, ks = item_sets(items, item_col, item_text_col, k)
    sets = cut(sets, "bench-sets")
    sketch = cut(sketches(sets, percent), "bench-sketches")
    least = F.ceil(F.col("low") * percent / 100)
    parts = sketch.groupBy("part").agg(F.max("h").alias("ceiling"), F.min("n").alias("low")).select("part", "ceiling", least.alias("least"))
    # one row per partition of sizes: at most 64 by construction
    bounds = F.broadcast(parts.agg(F.max("ceiling").alias("top"), F.min("least").alias("fewest")))
    probes = sketch.join(F.broadcast(parts), "part").select("item", "h", "ceiling", "least")
    grams = shingle_rows(docs, ["doc"], "t", ks)
    bound = bounds.first()
    if bound is None or bound["top"] is None:
        kinds = [f"{c} {t.simpleString()}" for c, t in (("doc_id", docs.schema["doc"].dataType), ("item_id", sets.schema["item"].dataType))]
        return spark.createDataFrame([], ", ".join([*kinds, "n_item long", "n_shared long"]))
    grams = grams.where((F.col("h") <= bound["top"]) & (F.col("n_places") >= bound["fewest"]))
    n_probes = sketch.count()
    found = (grams.join(small_or_shuffled(probes, n_probes), "h")
             .where((F.col("h") <= F.col("ceiling")) & (F.col("n_places") >= F.col("least")))
             .select("doc", "item").distinct())
    pairs = cut(found, "bench-candidates")
    ids = pairs.select("doc").distinct()
    some = docs.join(small_or_shuffled(ids, pairs.count()), "doc", "left_semi")
    held = shingle_rows(some, ["doc"], "t", ks).select("doc", "h")
    counted = (held.join(small_or_shuffled(sets, sets.count()), "h").distinct()
               .groupBy("doc", "item", "n").agg(F.count("*").alias("n_shared"))
               .where(F.col("n_shared") * 100 >= F.col("n") * percent))
    exact = counted.join(pairs, ["doc", "item"], "left_semi")
    return exact.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_item"), "n_shared")
