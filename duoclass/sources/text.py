"""Readers for the line layouts the classifier scripts consume.

All parsing is built-in Spark SQL expressions (split / transform / try_cast), so it
stays inside whole-stage codegen.  A malformed row is never fatal: it gets
``ok = false`` and can be counted with :func:`quarantine_report`; the reference
failed the whole job on one bad field.

Layouts (one example per line):

* dense CSV            ``f0,f1,...,f(d-1),label``
* keyed sparse         ``key<TAB>L i:v i:v ...``       (indices as written, 0-based)
* svmlight             ``L i:v i:v ...``               (base 0 or 1, auto-detected)
* one-hot tokens       ``L tok tok ...``               (feature = last char of a token)
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from duoclass.session import MAX_BROADCAST_CELLS, scratch_path

FEATS_TYPE = "array<struct<i:int,v:double>>"


def read_lines(spark: SparkSession, path: str, row_id: str | None = "row_id") -> DataFrame:
    """``spark.read.text`` plus an exact 0-based row number in input order."""
    df = spark.read.text(path)
    return with_row_id(df, row_id) if row_id else df


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Exact dense row number in file order (path, then position in the file),
    without sorting or a single task.

    ``monotonically_increasing_id`` puts the partition id in the upper 31 bits and
    the position inside the partition in the lower 33.  A file scan packs splits
    by size, so partition order is not path order; but inside one file, splits keep
    their offset order.  One aggregate counts rows per (file, partition) - one row
    per file split, a table bounded by the number of splits - and a running sum in
    (file, partition) order gives each split its offset.  The plan must be
    deterministic in its partitioning (a file scan is), which is why the id is
    taken right at the scan.
    """
    mask = F.lit((1 << 33) - 1)
    mid = (df.withColumn("_mid", F.monotonically_increasing_id())
             .withColumn("_file", F.input_file_name()))
    pid = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(mask)
    counts = mid.groupBy("_file", pid.alias("_pid")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(local).alias("_base"))
    w = Window.orderBy("_file", "_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_file", "_pid", "_base", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per file split: broadcast while that count is within the bound
    n_parts = df.rdd.getNumPartitions()
    side = F.broadcast(offs) if n_parts <= MAX_BROADCAST_CELLS // 4 else offs
    joined = mid.withColumn("_pid", pid).join(side, ["_file", "_pid"])
    rid = (F.col("_off") + local - F.col("_base")).cast("long")
    return joined.withColumn(name, rid).drop("_mid", "_pid", "_off", "_base", "_file")


def _all_ok(arr: Column, pred) -> Column:
    return F.coalesce(F.forall(arr, pred), F.lit(True))


def csv_width(lines: DataFrame, value: str = "value", sep: str = ",") -> int:
    """Feature width = the field count that most lines have (of equals the larger one), less
    the label.  One aggregate; a line too long or too short decides nothing."""
    counts = lines.groupBy(F.size(F.split(F.col(value), sep)).alias("n")).agg(F.count("*").alias("rows"))
    top = counts.where("n > 0").agg(F.max(F.struct("rows", "n")).alias("top")).first()["top"]
    return max(0, top["n"] - 1) if top else 0


def parse_dense_csv(lines: DataFrame, value: str = "value", sep: str = ",",
                    width: int | str | None = "common") -> DataFrame:
    """``f0,...,label`` -> ``label DOUBLE, features ARRAY<DOUBLE>, ok``; other columns kept.

    ``ok`` is false where a field is no number or the field count isn't ``width + 1``.
    ``width='common'`` takes the field count that most lines have, so no blank, short or
    overlong line decides over the others; ``width=None`` takes every row of two or more
    fields.  No row is removed here.
    """
    fields = F.split(F.col(value), sep)
    n = F.size(fields)
    w = csv_width(lines, value, sep) if width == "common" else width
    cells = F.transform(fields, lambda f: F.trim(f).try_cast("double"))
    out = (lines.withColumn("_cells", cells).withColumn("label", F.element_at("_cells", -1))
                .withColumn("features", F.slice("_cells", 1, F.greatest(F.size("_cells") - 1, F.lit(0)))))
    ok = (n == F.lit(w + 1)) if w is not None else (n >= 2)
    return out.withColumn("ok", ok & _all_ok(F.col("_cells"), lambda x: x.isNotNull())).drop(value, "_cells")


def _feats_from_tokens(tokens: Column, base: int | Column = 0) -> Column:
    """``i:v`` tokens -> cells; a token without exactly one colon gives a null cell."""
    b = base if isinstance(base, Column) else F.lit(base)

    def cell(t):
        parts = F.split(t, ":")
        one = F.size(parts) == 2
        return F.struct(F.when(one, F.get(parts, F.lit(0)).try_cast("int") - b).alias("i"),
                        F.when(one, F.get(parts, F.lit(1)).try_cast("double")).alias("v"))
    return F.transform(tokens, cell)


def _feats_ok(feats: Column, width: int | None) -> Column:
    def good(f):
        c = f["i"].isNotNull() & f["v"].isNotNull() & (f["i"] >= 0)
        if width is not None:
            c = c & (f["i"] < F.lit(width))
        return c
    return _all_ok(feats, good)


def parse_keyed_sparse(lines: DataFrame, value: str = "value", width: int | None = None,
                       truncate: bool = False) -> DataFrame:
    """``key<TAB>L i:v ...`` -> ``key, label, feats ARRAY<STRUCT<i,v>>, n_empty, ok``.

    Indices are used as written (0-based).  With ``width`` an index >= width makes
    the row bad, unless ``truncate`` is set, in which case such cells are dropped
    before anything is densified.
    """
    t = lines.withColumn("_k", F.substring_index(F.col(value), "\t", 1)).withColumn(
        "_t", F.when(F.instr(F.col(value), "\t") > 0,
                     F.expr(f"substr(`{value}`, instr(`{value}`, '\t') + 1)")))
    return _parse_labelled(t, width, truncate, base=0, key="_k").drop(value).withColumnRenamed("_k", "key")


def _parse_labelled(t: DataFrame, width: int | None, truncate: bool, base, key: str | None) -> DataFrame:
    text = F.col("_t")
    label_tok = F.substring_index(text, " ", 1)
    rest = F.when(F.instr(text, " ") > 0, F.expr("substr(_t, instr(_t, ' ') + 1)")).otherwise(F.lit(""))
    raw = F.split(rest, " ")
    n_empty = F.size(F.filter(raw, lambda x: x == F.lit(""))) - F.when(rest == F.lit(""), 1).otherwise(0)
    feats = _feats_from_tokens(F.filter(raw, lambda x: x != F.lit("")), base)
    t = (t.withColumn("label", label_tok.try_cast("double"))
          .withColumn("feats", feats)
          .withColumn("n_empty", n_empty.cast("int")))
    if truncate and width is not None:
        t = t.withColumn("feats", F.filter("feats", lambda f: f["i"].isNull() | (f["i"] < F.lit(width))))
        check_width = None
    else:
        check_width = width
    ok = text.isNotNull() & F.col("label").isNotNull() & _feats_ok(F.col("feats"), check_width)
    return t.withColumn("ok", ok).drop("_t")


def _svm_text(value: Column) -> Column:
    """A line without its ``# comment`` and ``qid:`` token, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(value, r"#.*$", ""), r"\bqid:\S*", "")
    return F.regexp_replace(F.trim(bare), r"\s+", " ")


def svmlight_base(lines: DataFrame, value: str = "value") -> int:
    """Index base of an svmlight text: 0 if any index is 0, else 1 (one scalar job)."""
    toks = F.filter(F.split(_svm_text(F.col(value)), " "), lambda x: F.instr(x, ":") > 0)
    idx = F.array_min(F.transform(toks, lambda x: F.substring_index(x, ":", 1).try_cast("int")))
    m = lines.select(F.min(idx).alias("m")).first()["m"]
    return 0 if (m is not None and m == 0) else 1


def parse_svmlight(lines: DataFrame, value: str = "value", base: int | str = "auto",
                   width: int | None = None, truncate: bool = False) -> DataFrame:
    """``L i:v ...`` -> ``label, feats (0-based), n_empty, ok``.

    ``base='auto'`` follows the usual loader heuristic (any index 0 means 0-based).
    Spark's own ``libsvm`` source only reads 1-based, ascending files and throws on
    index 0; this reader takes both.  Comments and ``qid:`` tokens are ignored, and
    lines with nothing else on them are no rows, as in the format.
    """
    b = svmlight_base(lines, value) if base == "auto" else int(base)
    t = lines.withColumn("_t", _svm_text(F.col(value))).filter(F.coalesce(F.col("_t") != "", F.lit(True)))
    return _parse_labelled(t, width, truncate, base=b, key=None).drop(value)


def parse_onehot_tokens(lines: DataFrame, n_tokens: int, value: str = "value") -> DataFrame:
    """Label = first character; feature k = last character of space token k, as int.

    Token 0 is the one that holds the label character, as in the layout this
    mirrors, so feature 0 repeats the label.
    """
    toks = F.split(F.col(value), " ")
    feats = F.transform(F.slice(toks, 1, n_tokens), lambda tk: F.substring(tk, -1, 1).try_cast("int"))
    label = F.substring(F.col(value), 1, 1).try_cast("double")
    out = lines.withColumn("label", label).withColumn("features", feats)
    ok = label.isNotNull() & (F.size(toks) >= n_tokens) & _all_ok(F.col("features"), lambda x: x.isNotNull())
    return out.withColumn("ok", ok).drop(value)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("ok")).drop("ok")


def quarantine_report(parsed: DataFrame) -> DataFrame:
    """One row: rows read, rows kept, rows quarantined, empty tokens skipped."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("ok").cast("long")).alias("n_ok"),
            F.sum((~F.col("ok")).cast("long")).alias("n_bad")]
    if "n_empty" in parsed.columns:
        aggs.append(F.sum(F.col("n_empty").cast("long")).alias("n_empty_tokens"))
    return parsed.agg(*aggs)


def scan(lines: DataFrame, parse, good_path: str | None = None, value: str = "value") -> tuple[DataFrame, DataFrame, dict]:
    """Read, parse and part the rows in one pass: (good rows, quarantine, counts).

    ``parse`` is one of the parsers, with its parameters.  All rows are written once, parted
    by ``ok``, below ``good_path`` (or the checkpoint root): the good ones as parsed, the bad
    ones with their line.  The counts (``n_rows``, ``n_ok``, ``n_bad``, ``n_empty_tokens``)
    are observed while writing, so they are of the same reading.  A null line is bad.
    """
    spark = lines.sparkSession
    path = good_path or scratch_path(spark, "scan", uuid.uuid4().hex[:12])
    line = f"_line_{uuid.uuid4().hex[:8]}"
    parsed = parse(lines.withColumn(line, F.col(value)))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), F.sum(ok.cast("long")).alias("n_ok"), F.sum((~ok).cast("long")).alias("n_bad")]
    if "n_empty" in parsed.columns:
        counts.append(F.sum(F.col("n_empty").cast("long")).alias("n_empty_tokens"))
    out = parsed.observe(seen, *counts).withColumn("ok", ok).withColumn(line, F.when(~ok, F.col(line)))
    out.write.partitionBy("ok").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    good = back.where("ok").drop("ok", line)
    bad = back.where("NOT ok").select(F.col(line).alias("line"), *[c for c in lines.columns if c != value and c in back.columns])
    return good, bad, {k: v or 0 for k, v in seen.get.items()}
