"""Alignment of two tokenizers over the same texts.

Equal texts are brought together by a shuffle on the full text, and each different text is
tokenised and aligned once.  Its pairs of overlapping tokens are written; summed over the
texts, weighted by how often each text occurs, they give the corpus's pair counts.  These
are looked up again for every text's links, and the texts' measures are joined to the rows.

Tokenizer A is a byte-level BPE file (its text has a space put before it), B a sentencepiece
file with byte fallback (which puts that space itself).  Neither makes a token across a
single space between two other characters, so a text is aligned run by run, and runs met
before are remembered.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.llm.common import batch_of, cut, prepare, worker_state
from duoclass.llm.partcache import PartCache, blocks
from duoclass.llm.tokenfiles import tokenizer_path

MOST_PAIRS = 200_000       # pairs whose counts are broadcast, the most frequent ones; others are joined
RUN_CACHE = 400_000        # runs that a worker keeps (some 350 bytes each)
TOGETHER = 64              # runs that are tokenised in one string
BLOCK_CHARS = 500_000
OUT_LINKS = 500_000        # different links of one output batch


class Aligner:
    """Runs of text -> (groups as text, codes of links), remembered by run."""

    def __init__(self, raw_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        from duoclass.llm.bpe import byte_letters

        self.a = Tokenizer.from_str(raw_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(byte_letters())}
        entries = json.loads(raw_a)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for s, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # what stands for a token in the text of groups: ids inside a group, the last A, the last B
        # (A's ids end with a point, until a text's tokens are counted)
        self.a_text = np.array([f"{i}{end}" for end in ".|" for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.b_bytes))], object)
        self.runs = PartCache(self._align, RUN_CACHE)

    def code_of(self, a, b):
        return a * len(self.b_bytes) + b

    def _encoded(self, strings: list[str]) -> list[tuple | None]:
        """(A's ids, B's ids) of each string, None where the joined bytes of its tokens differ."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in strings], add_special_tokens=False)]
        ids_b = self.b.encode(strings, num_threads=1)
        out: list = []
        for s, x, y in zip(strings, ids_a, ids_b):
            same = b"".join(map(self.a_bytes.__getitem__, x)) == b" " + s.encode() == b"".join(map(self.b_bytes.__getitem__, y))
            out.append((x, y) if same else None)
        return out

    def _align(self, keys: list[str]) -> list[tuple]:
        """(groups, codes) of each run; (None,) where the joined bytes of its tokens differ
        from it, and for a run whose ends aren't clean (see ``runs_of``).

        Clean runs are tokenised many in one string, as they stand in texts; those of a
        string whose bytes differ are tokenised again one by one.
        """
        out: list = [(None,)] * len(keys)
        plain = [i for i, k in enumerate(keys) if clean(k)]
        lots = [plain[lo:lo + TOGETHER] for lo in range(0, len(plain), TOGETHER)]
        alone = [i for i, k in enumerate(keys) if k[:1] == " "]
        good: list[int] = []
        ids: list[tuple] = []
        for lot, x in zip(lots, self._encoded([" ".join(map(keys.__getitem__, lot)) for lot in lots])):
            if x is None:
                alone += lot
            else:
                good += lot
                ids.append(x)
        for i, x in zip(alone, self._encoded([keys[i][keys[i][:1] == " ":] for i in alone])):
            if x is not None:
                good.append(i)
                ids.append(x)
        if not good:
            return out
        # a run's bytes with the space before it; marked runs have that space already
        till = np.cumsum([len(keys[i].encode()) + (keys[i][:1] != " ") for i in good])
        a = np.fromiter(chain.from_iterable(x for x, _ in ids), np.int64)
        b = np.fromiter(chain.from_iterable(y for _, y in ids), np.int64)
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        mark = np.zeros(int(end_a[-1]) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        ends = np.flatnonzero(mark)                      # each ends exactly one overlap
        codes = self.code_of(a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)])
        stop_a, stop_b = mark[end_a] == 3, mark[end_b] == 3
        group_a, group_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b
        till_a, till_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        # tokens in the order of the groups' text: a group's A tokens, then its B tokens
        place_a = np.arange(len(a)) + np.concatenate([[0], till_b])[group_a]
        place_b = np.arange(len(b)) + till_a[group_b]
        texts = np.empty(len(a) + len(b), object)
        texts[place_a] = self.a_text[a + stop_a * len(self.a_bytes)]
        texts[place_b] = self.b_text[b + stop_b * len(self.b_bytes)]
        texts = texts.tolist()
        last = np.searchsorted(ends, till, "right").tolist()
        upto = (np.searchsorted(end_a, till, "right") + np.searchsorted(end_b, till, "right")).tolist()
        lo = t0 = 0
        for i, hi, t1 in zip(good, last, upto):
            out[i] = ("".join(texts[t0:t1]), codes[lo:hi].tobytes())
            lo, t0 = hi, t1
        return out

    def align(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, sha256 of the groups, codes of all links) of each text, None
        where the joined bytes of A's or B's tokens differ from the text."""
        lists = [t.split(" ") for t in texts]
        got = self.runs.values([p for x in lists for p in x])
        out, at = [], 0
        for t, x in zip(texts, lists):
            own = got[at:at + len(x)]
            at += len(x)
            if (None,) in own:
                own = self.runs.values(runs_of(x))
                if (None,) in own:
                    own = self._align([" " + t])
                    if own[0][0] is None:
                        out.append(None)
                        continue
            groups, codes = zip(*own)
            g = "".join(groups)
            n_groups = g.count(";")
            out.append((g.count(".") + g.count("|"), g.count(",") + n_groups, n_groups,
                        hashlib.sha256(g[:-1].replace(".", ",").encode()).hexdigest(), np.frombuffer(b"".join(codes), np.int64)))
        return out


def clean(part: str) -> bool:
    """Whether a part between spaces begins and ends with something else than white space."""
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


def runs_of(parts: list[str]) -> list[str]:
    """Parts between spaces, joined again wherever a token could reach across the space:
    beside an empty part and beside white space.  A joined or unclean run is marked by a
    space before it."""
    out = []
    for p in parts:
        if out and not (out[-1] and not out[-1][-1].isspace() and p and not p[0].isspace()):
            out[-1] += " " + p
        else:
            out.append(p)
    return [r if clean(r) and " " not in r else " " + r for r in out]


_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(sent_a, sent_b, key: str, names: list[str]):
    def run(batches):
        aligner = worker_state(key, lambda: Aligner(sent_a.value, sent_b.value))
        for rb in batches:
            texts = rb.column(2).to_pylist()
            for lo, hi in blocks([len(t) for t in texts], BLOCK_CHARS):
                rows, links, total, start = [], [], 0, lo
                for i, r in enumerate(aligner.align(texts[lo:hi])):
                    if r is None:
                        rows.append((0, 0, 0, 0, ""))
                        links.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    else:
                        rows.append((r[0], r[1], r[2], len(r[4]), r[3]))
                        links.append(np.unique(r[4], return_counts=True))
                        total += len(links[-1][0])
                    if total >= OUT_LINKS or lo + i == hi - 1:
                        yield _aligned_batch(rb, names, start, lo + i + 1, rows, links)
                        rows, links, total, start = [], [], 0, lo + i + 1

    return run


def _aligned_batch(rb, names, lo, hi, rows, links):
    off = np.concatenate([[0], np.cumsum([len(c) for c, _ in links])])
    code = pa.array(np.concatenate([c for c, _ in links]))
    used = pa.array(np.concatenate([n for _, n in links]).astype(np.int64))
    lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([code, used], ["code", "used"]))
    cols = list(zip(*rows))
    return batch_of(names, rb.column(0).slice(lo, hi - lo), rb.column(1).slice(lo, hi - lo),
                    *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), lists)


def text_key(col: str) -> Column:
    """SHA-256 of a text (32 bytes): stands for it once equal texts have met."""
    return F.unhex(F.sha2(F.col(col).cast("binary"), 256))


def align_texts(df: DataFrame, text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row for each different text that is neither null nor empty.

    ``key`` (its SHA-256), ``times`` (rows that hold it), ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``groups_sha256`` and ``links``: its different pairs of overlapping tokens
    (``code`` = A's id times B's vocabulary size, plus B's id) and how often it has each.
    A text whose joined token bytes differ from a space and the text has zeros, '' and none.
    """
    spark = df.sparkSession
    prepare(spark)
    with open(path_a or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        raw_a = f.read()
    with open(path_b or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model_b = f.read()
    key = f"align-{hashlib.blake2b(raw_a.encode() + model_b, digest_size=8).hexdigest()}"
    texts = df.select(F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")
    once = texts.groupBy("text").agg(F.count("*").alias("times")).select(text_key("text").alias("key"), "times", "text")
    long = T.LongType()
    out = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("times", long), *(T.StructField(c, long) for c in _MEASURES),
                        T.StructField("groups_sha256", T.StringType()),
                        T.StructField("links", T.ArrayType(T.StructType([T.StructField("code", long), T.StructField("used", long)])))])
    sc = spark.sparkContext
    return once.mapInArrow(_aligned(sc.broadcast(raw_a), sc.broadcast(model_b), key, out.names), out)


def vocabulary_size(path_b: str | None = None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b or tokenizer_path("piece_bpe_32k.model")).get_piece_size()


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(code, a, b, count, best) of every pair of tokens that is linked anywhere.

    ``count``: links of the whole table that hold the pair (each text counts as often as it
    occurs); ``best``: whether no pair of the same B token has more.
    """
    pairs = (aligned.select("times", F.inline("links")).groupBy("code").agg(F.sum(F.col("used") * F.col("times")).alias("count"))
             .withColumn("b", F.col("code") % b_size))
    pairs = cut(pairs, "pair-counts")
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))     # a row for each B token: its vocabulary's size at most
    return pairs.join(F.broadcast(top), "b").select("code", F.floor(F.col("code") / b_size).alias("a"), "b", "count",
                                                    (F.col("count") == F.col("top")).alias("best"))


def _frequent_from(pairs: DataFrame, most: int) -> int | None:
    """The lowest power of two that at most ``most`` pairs reach with their count; None if
    all pairs are that few."""
    size = {r["p"]: r["n"] for r in pairs.groupBy(F.length(F.bin("count")).alias("p")).agg(F.count("*").alias("n")).collect()}
    if sum(size.values()) <= most:
        return None
    total = 0
    for p in sorted(size, reverse=True):
        if total + size[p] > most:
            return 1 << p
        total += size[p]
    return 0


def text_measures(aligned: DataFrame, pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(key, n_best, count_sum): of each text's links, how many are the most frequent pair of
    their B token, and the sum of their pairs' counts.

    Counts of at most ``most`` frequent pairs are broadcast, which settles most links where
    they are; links of rarer pairs are joined by a shuffle, in which no pair is frequent.
    """
    links = aligned.select("key", F.inline("links"))
    least = _frequent_from(pairs, most)
    counts = pairs.select("code", "count", "best")

    def sums(x: DataFrame) -> DataFrame:
        return x.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("used")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("used") * F.col("count")).alias("count_sum"))

    if least is None:
        return sums(links.join(F.broadcast(counts), "code"))
    many = counts.where(F.col("count") >= least)
    few = counts.where(F.col("count") < least)
    parts = sums(links.join(F.broadcast(many), "code")).unionByName(sums(links.join(F.broadcast(many.select("code")), "code", "left_anti").join(few, "code")))
    return parts.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(df: DataFrame, text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum`` and ``groups_sha256`` of their texts.

    Null and empty texts, and texts whose joined token bytes differ from a space and the
    text, have zeros and ''.  Rows that repeat count each time.  Very long texts are aligned
    whole.  Columns of ``df`` with these names are replaced; an empty table gives an empty one.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    df = df.drop(*[c for c in new if c != text_col])
    aligned = cut(align_texts(df, text_col, path_a, path_b), "aligned")
    pairs = cut(pair_counts(aligned, vocabulary_size(path_b)), "pairs")
    by_key = (aligned.drop("links", "times").join(text_measures(aligned, pairs), "key", "left")
              .select("key", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"))
    own = f"_text_{uuid.uuid4().hex[:8]}"
    filled = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    rows = df.where(filled).withColumn(own, text_key(text_col)).join(by_key.withColumnRenamed("key", own), own).select(*df.columns, *new)
    none = df.where(~F.coalesce(filled, F.lit(False))).select("*", *(F.lit(0).cast("long").alias(c) for c in new[:-1]), F.lit("").alias(new[-1]))
    return rows.unionByName(none)
