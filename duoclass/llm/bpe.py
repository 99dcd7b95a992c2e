"""Byte-level BPE encoding and decoding.

Encoding a piece of text keeps its symbols in a doubly linked list and all adjacent
mergeable pairs in a priority queue ordered by (merge rank, place).  Popping a pair
merges it unless the entry is stale: one of its symbols was merged away or the pair
standing there now is another one.  A short piece, as nearly all are, keeps its symbols and
the ranks of its pairs in two lists instead and takes the least rank each time, the leftmost
of equal ones, as the queue does.  Decoding concatenates the vocabulary strings of
the ids and reads the bytes as UTF-8.

Texts are cut into pieces by the tokenizer's pattern, so a piece met before in the
same worker is looked up (two bounded generations of a cache); pieces themselves may
be as long as a text.
"""

from __future__ import annotations

import heapq
import json
from hashlib import blake2b
from itertools import chain, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.llm.common import batch_of, prepare, worker_state
from duoclass.llm.tokenfiles import bpe_json

# The split pattern of byte-level BPE files (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHE = 300_000        # pieces of one generation of the cache (some 75 MB)
CACHE_CHARS = 64       # longer pieces are not kept
SHORT = 40             # symbols of a piece that is merged in lists
NO_RANK = 1 << 62      # of a pair that isn't merged
OUT_IDS = 400_000      # ids of one output batch


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary strings."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class Bpe:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letter = byte_letters()
        of_letter = {c: b for b, c in enumerate(letter)}
        self.single = [vocab.get(c) for c in letter]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.least = {pair: r for pair, (r, _) in self.rank.items()}
        self.made = {r: made for r, made in self.rank.values()}
        size = max([*vocab.values(), *added.values()], default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            known = all(c in of_letter for c in s)
            self.bytes[i] = bytes(of_letter[c] for c in s) if known else s.encode()
        for s, i in added.items():
            self.bytes[i] = s.encode()
        self.added = added
        self.split_added = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.pattern = regex.compile(SPLIT)
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one piece to the end."""
        n = len(ids)
        if n <= SHORT:
            return self._merge_short(ids)
        rank = self.rank
        heap = []
        for i in range(n - 1):
            hit = rank.get((ids[i], ids[i + 1]))
            if hit:
                heap.append((hit[0], i, hit[1]))
        if not heap:
            return ids
        heapq.heapify(heap)
        prev = list(range(-1, n - 1))
        nxt = list(range(1, n + 1))
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            r, i, made = pop(heap)
            a = ids[i]
            if a < 0:
                continue  # merged into the symbol before it
            j = nxt[i]
            if j >= n:
                continue
            hit = rank.get((a, ids[j]))
            if hit is None or hit[0] != r:
                continue  # another pair stands here now
            ids[i] = made
            ids[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                hit = rank.get((made, ids[k]))
                if hit:
                    push(heap, (hit[0], i, hit[1]))
            h = prev[i]
            if h >= 0:
                hit = rank.get((ids[h], made))
                if hit:
                    push(heap, (hit[0], h, hit[1]))
        return [x for x in ids if x >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.least.get
        ranks = list(map(get, zip(ids, ids[1:]), repeat(NO_RANK)))
        while ranks:
            r = min(ranks)
            if r == NO_RANK:
                break
            i = ranks.index(r)
            made = self.made[r]
            ids[i] = made
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((made, ids[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = get((ids[i - 1], made), NO_RANK)
        return ids

    def piece(self, s: str) -> tuple[int, ...]:
        got = self.old.get(s)
        if got is None:
            single = self.single
            # a byte without a symbol of its own is dropped, as no unknown token is set
            got = tuple(self.merge([x for x in map(single.__getitem__, s.encode()) if x is not None]))
        if len(s) <= CACHE_CHARS:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[s] = got
        return got

    def _plain(self, text: str) -> list[int]:
        pieces = self.pattern.findall(text)
        got = list(map(self.new.get, pieces))
        if None in got:
            new = self.new
            for at, x in enumerate(got):
                if x is None:
                    p = pieces[at]
                    got[at] = new.get(p) or self.piece(p)
                    new = self.new
        return list(chain.from_iterable(got))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of added tokens in it become those tokens."""
        if self.split_added is None or not self.split_added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _coder(handle) -> Bpe:
    """One coder for each worker process and model."""
    return worker_state(handle.key, lambda: Bpe(**json.loads(handle.value)))


class _Handle:
    """A broadcast model with a name that is stable across tasks."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.key = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def share_bpe(spark, path: str | None = None) -> _Handle:
    raw = json.dumps(bpe_json(path))
    return _Handle(spark.sparkContext.broadcast(raw), f"bpe-{blake2b(raw.encode(), digest_size=8).hexdigest()}")


def _stage(handle, names: list[str], text_at: int, todo: str):
    def run(batches):
        coder = _coder(handle)
        for rb in batches:
            lo, ids, texts, total = 0, [], [], 0
            for i, t in enumerate(rb.column(text_at)):
                x = coder.encode(t.as_py() or "")
                ids.append(x)
                texts.append(coder.decode(x) if todo == "both" else None)
                total += len(x)
                if total >= OUT_IDS or i == rb.num_rows - 1:
                    cols = [rb.column(j).slice(lo, i + 1 - lo) for j in range(rb.num_columns)]
                    if todo == "both":
                        yield batch_of(names, *cols, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string()))
                    else:
                        yield batch_of(names, *cols, pa.array(ids, pa.list_(pa.int32())))
                    lo, ids, texts, total = i + 1, [], [], 0

    return run


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with ``bpe_ids`` (array of int).

    A null or empty text has no ids.  Rows that repeat are encoded each; a text of any
    length is encoded whole.  A column of ``df`` with that name is replaced.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("bpe_ids")
    out = T.StructType([*df.schema.fields, T.StructField("bpe_ids", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_stage(share_bpe(spark, path), out.names, df.columns.index(text_col), "encode"), out)


def decode(df: DataFrame, ids_col: str = "bpe_ids", path: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with ``bpe_text``; null ids give a null text."""
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("bpe_text")
    handle = share_bpe(spark, path)
    at = df.columns.index(ids_col)
    out = T.StructType([*df.schema.fields, T.StructField("bpe_text", T.StringType())])

    def run(batches):
        coder = _coder(handle)
        for rb in batches:
            texts = [None if not x.is_valid else coder.decode(x.as_py()) for x in rb.column(at)]
            yield batch_of(out.names, *rb.columns, pa.array(texts, pa.string()))

    return df.mapInArrow(run, out)


def encode_decode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``encode`` and the ``decode`` of its ids in one pass: ``bpe_ids``, ``bpe_text``.

    A null or empty text has no ids and an empty ``bpe_text``; otherwise as ``encode``.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("bpe_ids", "bpe_text")
    out = T.StructType([*df.schema.fields, T.StructField("bpe_ids", T.ArrayType(T.IntegerType())),
                        T.StructField("bpe_text", T.StringType())])
    return df.mapInArrow(_stage(share_bpe(spark, path), out.names, df.columns.index(text_col), "both"), out)


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of an encoded and decoded table."""
    return coded.select("doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"))
