"""Suffix-array deduplication of repeated passages (two-stage suffix sorting).

Every byte covered by a ``MIN_LEN``-byte string that also starts earlier (smaller
document, or earlier in the same one) is removed.  Strings are judged on the input.

How the work is spread:

1. Every window of ``MIN_LEN`` bytes is named by the smallest hash of the
   ``KGRAM``-byte strings in it.  Consecutive windows of one name form a run; equal
   windows have equal names, so only runs whose name occurs again can matter.  The
   names are counted with a map-side combined aggregation and the repeated ones kept.
2. Runs of repeated names with equal bytes (two independent 64-bit names and the
   length) are represented by their earliest occurrence; in the others every window
   starts earlier too, and they are removed without being sorted.
3. The remaining distinct runs are dealt out by name and suffix-sorted in blocks:
   suffixes smaller than their successors are sorted directly, the rest are induced
   by scanning the buckets of first bytes, and adjacent common prefixes of at least
   ``MIN_LEN`` bytes give the classes of equal windows.
4. A name with more than ``GROUP_RUNS`` distinct runs is salted over several blocks.
   What is first in its block there meets the other blocks under a 128-bit name of
   the window itself, so that a hot passage never needs one task.

The text is shuffled once (by document) and that exchange serves both the cutting
of the runs and the final removal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.llm.common import (BYTE_HASH, BYTE_HASH2, as_bytes, batch_of, cut, mix, no_state, powers, prefix_sums,
                                 prepare, shuffle_partitions)

MIN_LEN = 100      # bytes of a string that counts as repeated
KGRAM = 28         # bytes of the strings that name a window
MAX_RUN = 256      # windows of one run (longer runs are cut; nothing is lost)
GROUP_RUNS = 1024  # distinct runs of one name in one block
BLOCK_BYTES = 3 << 19  # text sorted at once (some 40 bytes of memory each)
PIECE = 1 << 20    # window starts of a document handled at once


def pack(start: np.ndarray, length: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """start, number of windows (1 to 256) and self flag in one long."""
    return (start.astype(np.int64) << 9) | ((length.astype(np.int64) - 1) << 1) | flag.astype(np.int64)


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p >> 9, ((p >> 1) & 255) + 1


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    d = 1
    while d * 2 <= width:
        a = op(a[:-d], a[d:])
        d *= 2
    return op(a[:len(a) - (width - d)], a[width - d:]) if d < width else a


def runs_of(b: np.ndarray, min_len: int = MIN_LEN, k: int = KGRAM):
    """(name, second name, start, windows, self flag) of the runs of one text.

    The flag marks names that occur again close by in the same text, as only such a
    run can hold two equal windows.
    """
    w = min_len - k + 1
    s1, s2 = prefix_sums(BYTE_HASH[b]), prefix_sums(BYTE_HASH2[b])
    inv = powers(len(b) + 1)[1]
    h = mix((s1[k:] - s1[:-k]) * inv[:len(b) - k + 1])
    m = _sliding(np.minimum, h, w)
    change = np.empty(len(m), bool)
    change[0] = True
    np.not_equal(m[1:], m[:-1], out=change[1:])
    st = np.flatnonzero(change)
    ln = np.diff(np.append(st, len(m)))
    if ln.max() > MAX_RUN:
        parts = -(-ln // MAX_RUN)
        off = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        st = np.repeat(st, parts) + off * MAX_RUN
        ln = np.diff(np.append(st, len(m)))
    padded = np.zeros(len(m) + 2 * (w - 1), np.uint64)
    padded[w - 1:w - 1 + len(m)] = m
    occ = np.flatnonzero(_sliding(np.maximum, padded, w) == h)
    o = np.lexsort((occ, h[occ]))
    ho, po = h[occ][o], occ[o]
    near = (ho[1:] == ho[:-1]) & (po[1:] - po[:-1] <= w)
    name = m[st]
    again = np.isin(name, ho[1:][near]) if near.any() else np.zeros(len(st), bool)
    end = st + ln + min_len - 1
    content = mix((s2[end] - s2[st]) * inv[st] ^ (ln.astype(np.uint64) << np.uint64(48)))
    return name.view(np.int64), content.view(np.int64), st, ln, again


def _pieces(b: np.ndarray, min_len: int):
    for lo in range(0, len(b) - min_len + 1, PIECE):
        yield lo, b[lo:lo + PIECE + min_len - 1]


def _run_rows(min_len: int, k: int, content: bool):
    def run(batches):
        no_state()
        for rb in batches:
            data, off = as_bytes(rb.column(1))
            ids = rb.column(0).to_numpy(zero_copy_only=False)
            out = [[] for _ in range(4)]
            size = 0
            for i in range(len(ids)):
                b = data[off[i]:off[i + 1]]
                if len(b) < min_len:
                    continue
                for lo, piece in _pieces(b, min_len):
                    name, second, st, ln, again = runs_of(piece, min_len, k)
                    for o, x in zip(out, (name, second, np.full(len(st), ids[i], np.int64), pack(st + lo, ln, again))):
                        o.append(x)
                    size += len(st)
                if size > 100_000:
                    yield _emit(out, content)
                    out, size = [[] for _ in range(4)], 0
            if size:
                yield _emit(out, content)

    return run


def _emit(out, content: bool) -> pa.RecordBatch:
    name, second, doc, p = (np.concatenate(x) for x in out)
    if content:
        return batch_of(["m", "ch", "doc", "pl"], name, second, doc, p)
    return batch_of(["m", "f"], name, (p & 1).astype(np.int32))


# ------------------------------------------------------------------ suffix sorting

def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` in the order of their suffixes' first ``depth`` bytes.

    Two stages: suffixes smaller than their successors are sorted directly on
    8-byte words down to ``depth``; every other suffix is induced by scanning the
    buckets of first bytes in ascending order.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    # kind: a suffix is small when the next different byte is larger
    turn = np.flatnonzero(t[1:] != t[:-1])
    up = np.zeros(n, bool)
    if len(turn):
        nxt = np.searchsorted(turn, np.arange(n - 1))
        ok = nxt < len(turn)
        e = turn[np.minimum(nxt, len(turn) - 1)]
        up[:-1] = ok & (t[e] < t[e + 1])
    padded = np.zeros(n + 16 + depth, np.uint64)
    padded[:n] = t
    word = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + len(word)]
    small = np.flatnonzero(up)
    small = small[np.argsort(word[small], kind="stable")]
    if len(small) > 1:
        k = word[small]
        first = np.empty(len(small) + 1, bool)
        first[0] = first[-1] = True
        first[1:-1] = k[1:] != k[:-1]
        for d in range(8, depth, 8):
            open_ = np.flatnonzero(~(first[:-1] & first[1:]))
            if not len(open_):
                break
            g = np.cumsum(first[:-1])[open_]
            k = word[small[open_] + d]
            o = np.lexsort((k, g))
            small[open_] = small[open_][o]
            k = k[o]
            diff = np.empty(len(open_), bool)
            diff[0] = True
            diff[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
            first[open_] |= diff
    cut_at = np.searchsorted(t[small], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[t[n - 1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        large = [np.concatenate(heads[c])] if heads[c] else []
        while large and len(large[-1]):
            p = large[-1] - 1
            p = p[p >= 0]
            large.append(p[t[p] == c])
        part = np.concatenate([*large, small[cut_at[c]:cut_at[c + 1]]]) if large else small[cut_at[c]:cut_at[c + 1]]
        if not len(part):
            continue
        order.append(part)
        p = part - 1
        p = p[p >= 0]
        ch = t[p]
        p, ch = p[ch > c], ch[ch > c]
        if len(p):
            o = np.argsort(ch, kind="stable")
            p, ch = p[o], ch[o]
            at = np.append(np.flatnonzero(np.append(True, ch[1:] != ch[:-1])), len(p))
            for lo, hi in zip(at[:-1], at[1:]):
                heads[ch[lo]].append(p[lo:hi])
    return np.concatenate(order)


def equal_neighbours(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the order: do its first ``length`` bytes equal the place before?"""
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order))
    at = at[(order[at] + length <= len(t)) & (order[at - 1] + length <= len(t))]
    padded = np.append(t, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(len(t), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + len(t)]
    for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = at[word[order[at] + d] == word[order[at - 1] + d]]
    same[at] = True
    return same


def sort_block(snips: list, doc: np.ndarray, start: np.ndarray, min_len: int):
    """For the windows of a block of runs: is it the first of its class, has it equals?

    ``snips`` are the runs' bytes in the order of (doc, start).  Returns arrays over
    all windows in that order: run index, offset, position in the joined text, and
    whether an equal window of the block comes before it; and the joined text.
    """
    lens = np.array([len(s) for s in snips])
    t = np.frombuffer(b"".join(snips) + bytes(2 * min_len), np.uint8)
    base = np.cumsum(lens) - lens
    n_win = lens - min_len + 1
    run = np.repeat(np.arange(len(snips)), n_win)
    offset = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    pos = base[run] + offset
    valid = np.zeros(len(t), bool)
    valid[pos] = True
    order = suffix_order(t, -(-min_len // 8) * 8)
    cls = np.cumsum(~equal_neighbours(t, order, min_len)) - 1
    at = valid[order]
    order, cls = order[at], cls[at]
    low = np.full(cls[-1] + 1 if len(cls) else 0, len(t), np.int64)
    np.minimum.at(low, cls, order)
    later = np.zeros(len(t), bool)
    later[order] = low[cls] != order
    return run, offset, pos, later[pos], t


def _window_names(t: np.ndarray, pos: np.ndarray, min_len: int):
    inv = powers(len(t) + 1)[1]
    out = []
    for table in (BYTE_HASH, BYTE_HASH2):
        s = prefix_sums(table[t])
        out.append(mix((s[pos + min_len] - s[pos]) * inv[pos]).view(np.int64))
    return out


SORTED = T.StructType([T.StructField(c, T.LongType()) for c in ("k1", "k2", "doc", "pl", "kind")])


def _sort_rows(min_len: int):
    """Suffix-sort the partition's runs in blocks that end between two names.

    Out: kind 0, a run of windows that have an earlier equal (k1, k2 = doc, pl);
    kind 1, a window that is first in its block of a salted name (k1, k2 = its name).
    """
    def flush(rows):
        doc, start, salted, snip = rows
        doc, start, salted = np.concatenate(doc), np.concatenate(start), np.concatenate(salted)
        o = np.lexsort((start, doc))
        # a row that repeats a document has its runs once
        again = [False] + [doc[x] == doc[y] and start[x] == start[y] and snip[x] == snip[y] for x, y in zip(o, o[1:])]
        o = o[~np.array(again)]
        doc, start, salted = doc[o], start[o], salted[o]
        snip = [snip[i] for i in o]
        run, offset, pos, later, t = sort_block(snip, doc, start, min_len)
        # neighbouring later windows of one run as one row
        new = np.empty(len(run) + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = (run[1:] != run[:-1]) | (later[1:] != later[:-1])
        a = np.flatnonzero(new)
        lo, ln = a[:-1], np.diff(a)
        keep = later[lo]
        lo, ln = lo[keep], ln[keep]
        d = doc[run[lo]]
        p = pack(start[run[lo]] + offset[lo], ln, np.zeros(len(lo), np.int64))
        cols = [[d], [p], [d], [p], [np.zeros(len(d), np.int64)]]
        f = np.flatnonzero(~later & salted[run])
        if len(f):
            n1, n2 = _window_names(t, pos[f], min_len)
            one = pack(start[run[f]] + offset[f], np.ones(len(f), np.int64), np.zeros(len(f), np.int64))
            for c, x in zip(cols, (n1, n2, doc[run[f]], one, np.ones(len(f), np.int64))):
                c.append(x)
        return batch_of(SORTED.names, *(np.concatenate(c) for c in cols))

    def run(batches):
        rows, size, last = ([], [], [], []), 0, None
        for rb in batches:
            m = rb.column(0).to_numpy()
            salt = rb.column(1).to_numpy()
            doc, p, salted = (rb.column(i).to_numpy() for i in (2, 3, 4))
            snip = rb.column(5).to_pylist()
            start, _ = unpack(p)
            edge = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (salt[1:] != salt[:-1])))
            for lo, hi in zip(edge, np.append(edge[1:], len(m))):
                key = (m[lo], salt[lo])
                if size > BLOCK_BYTES and key != last:
                    yield flush(rows)
                    rows, size = ([], [], [], []), 0
                for r, x in zip(rows[:3], (doc[lo:hi], start[lo:hi], salted[lo:hi] > 0)):
                    r.append(x)
                rows[3].extend(snip[lo:hi])
                size += sum(map(len, snip[lo:hi]))
                last = key
        if size:
            yield flush(rows)

    return run


CUT = T.StructType([T.StructField("m", T.LongType()), T.StructField("salt", T.LongType()),
                    T.StructField("doc", T.LongType()), T.StructField("pl", T.LongType()),
                    T.StructField("salted", T.IntegerType()), T.StructField("snip", T.BinaryType())])


def _cut_rows(id_at: int, text_at: int, list_at: int, min_len: int):
    def run(batches):
        for rb in batches:
            lists = rb.column(list_at)
            use = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if not len(use):
                continue
            data, off = as_bytes(rb.column(text_at))
            ids = rb.column(id_at).to_numpy(zero_copy_only=False)
            for i in use:
                f = lists[i].values
                m, p, salt, salted = (f.field(j).to_numpy() for j in range(4))
                st, ln = unpack(p)
                b = data[off[i]:off[i + 1]].tobytes()
                snip = [b[s:e] for s, e in zip(st.tolist(), (st + ln + min_len - 1).tolist())]
                ok = np.array([len(s) for s in snip]) == ln + min_len - 1
                for lo in range(0, len(st), 20_000):
                    x = slice(lo, lo + 20_000)
                    k = ok[x]
                    yield batch_of(CUT.names, m[x][k], salt[x][k], np.full(k.sum(), ids[i], np.int64), p[x][k],
                                   salted[x][k].astype(np.int32),
                                   pa.array([s for s, good in zip(snip[x], k) if good], pa.binary()))

    return run


def remove_spans(b: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs)."""
    end = np.minimum(end, len(b))
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.append(True, s[1:] > e[:-1])
    lo = s[new]
    hi = e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
    good = hi > lo
    lo, hi = lo[good], hi[good]
    if not len(lo):
        return b, 0, 0
    kept = b"".join(b[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(b)]))
    return kept, int((hi - lo).sum()), len(lo)


def _remove_rows(names: list[str], text_at: int, list_at: int, min_len: int, as_text: bool):
    """``as_text``: the kept bytes as text without the bytes of cut characters, null where
    nothing was removed."""
    def run(batches):
        for rb in batches:
            data, off = as_bytes(rb.column(text_at))
            lists = rb.column(list_at)
            kept, gone, spans, size = [], [], [], []
            for i in range(rb.num_rows):
                b = data[off[i]:off[i + 1]].tobytes()
                x = (b, 0, 0)
                if lists[i].is_valid:
                    st, ln = unpack(lists[i].values.to_numpy())
                    x = remove_spans(b, st, st + ln + min_len - 1)
                kept.append(x[0] if not as_text else x[0].decode("utf-8", "ignore") if x[1] else None)
                gone.append(x[1])
                spans.append(x[2])
                size.append(len(b))
            yield batch_of(names, *[rb.column(i) for i in range(list_at)], pa.array(size, pa.int64()),
                           pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()))

    return run


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                   kgram: int = KGRAM, group_runs: int = GROUP_RUNS, as_text: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with ``sa_bytes``, ``sa_removed``, ``sa_spans`` (long)
    and ``sa_kept`` (binary: the bytes that stay, joined).  ``as_text`` gives these as a
    string instead, where a character that was cut in half goes as a whole; null where
    nothing was removed.

    A null or empty text and a text shorter than ``min_len`` bytes lose nothing.  A row
    without an id has no place in the order: it loses nothing and is no earlier
    occurrence.  Rows that repeat an id are one document: rows with the same text get the
    same result; of rows with other texts each loses what any of them loses at its place.
    Columns of ``df`` with the names above are replaced.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("sa_bytes", "sa_removed", "sa_spans", "sa_kept", "_sa_key", "_sa_doc", "_sa_list")
    key = F.col(id_col).cast("long")
    text = df.select(key.alias("doc"), text_col).where("doc IS NOT NULL")
    names = text.mapInArrow(_run_rows(min_len, kgram, False), "m long, f int")
    rep = cut(names.groupBy("m").agg(F.count("*").alias("n"), F.max("f").alias("f"))
              .where("n > 1 OR f > 0").select("m"), "sa-names")
    runs = text.mapInArrow(_run_rows(min_len, kgram, True), "m long, ch long, doc long, pl long")
    cand = cut(runs.join(rep, "m"), "sa-runs")
    size = (F.shiftright("pl", 1).bitwiseAND(F.lit(255)) + 1)
    flag = F.col("pl").bitwiseAND(F.lit(1))
    first = cut(cand.groupBy("m", "ch").agg(F.min(F.struct("doc", "pl")).alias("a"), F.max(flag).alias("f")), "sa-first")
    stat = (first.groupBy("m").agg(F.count("*").alias("n"), F.max("f").alias("f"),
                                   F.sum((F.shiftright("a.pl", 1).bitwiseAND(F.lit(255)) + min_len).cast("long")).alias("b"))
            .where("n > 1 OR f > 0").withColumn("k", F.ceil(F.col("n") / group_runs)))
    total = stat.agg(F.sum("b")).first()[0] or 0
    part = (first.join(stat.select("m", "k"), "m")
            .select("m", F.col("a.doc").alias("doc"), F.col("a.pl").alias("pl"),
                    F.pmod(F.xxhash64("a.doc", "ch"), F.col("k")).alias("salt"), (F.col("k") > 1).cast("int").alias("salted")))
    lists = part.groupBy(F.col("doc").alias("_sa_doc")).agg(F.collect_list(F.struct("m", "pl", "salt", "salted")).alias("_sa_list"))

    cols = df.columns
    keyed = df.withColumn("_sa_key", key)
    joined = keyed.join(lists, F.col("_sa_key") == F.col("_sa_doc"), "left").select(*cols, "_sa_key", "_sa_list")
    snips = joined.mapInArrow(_cut_rows(len(cols), cols.index(text_col), len(cols) + 1, min_len), CUT)
    parts = shuffle_partitions(spark, total, 4 * BLOCK_BYTES)
    ranked = (snips.repartition(parts, "m", "salt").sortWithinPartitions("m", "salt")
              .mapInArrow(_sort_rows(min_len), SORTED))
    # what is first in its block meets the other blocks of its name (once each, so never many)
    low = F.min(F.struct("doc", "pl")).over(Window.partitionBy("k1", "k2", "kind"))
    sorted_out = (ranked.withColumn("low", low).where("kind = 0 OR struct(doc, pl) <> low").select("doc", "pl"))
    copies = (cand.join(first.select("m", "ch", "a"), ["m", "ch"]).where("struct(doc, pl) <> a").select("doc", "pl"))
    gone = sorted_out.union(copies).groupBy(F.col("doc").alias("_sa_doc")).agg(F.collect_list("pl").alias("_sa_list"))
    out = T.StructType([*(f for f in df.schema.fields), T.StructField("sa_bytes", T.LongType()),
                        T.StructField("sa_removed", T.LongType()), T.StructField("sa_spans", T.LongType()),
                        T.StructField("sa_kept", T.StringType() if as_text else T.BinaryType())])
    # the same exchange of the text by document as above
    last = keyed.join(gone, F.col("_sa_key") == F.col("_sa_doc"), "left").select(*cols, "_sa_key", "_sa_list")
    return (last.select(*cols, "_sa_list")
            .mapInArrow(_remove_rows(out.names, cols.index(text_col), len(cols), min_len, as_text), out))
