"""Packing of token pieces into sequences by sums of squares.

Documents are encoded with a word-end BPE file, an end id follows each, and longer ones are
cut into pieces of the capacity.  A piece goes to the open sequence for which the sum, over
all residual gaps, of the squared number of open sequences with that gap becomes smallest
(of equals, the one with the smallest gap); a sequence is opened where none has room.

Pieces are dealt evenly into groups of bounded size and streamed longest first, so a task
holds only its open sequences.  Sequences that keep much room are then taken apart and their
pieces packed again over the groups, until one group is left or nothing is gained.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.llm.common import batch_of, cut, drop, no_state, prepare, small_or_shuffled, worker_state
from duoclass.llm.partcache import PartCache, blocks
from duoclass.llm.tokenfiles import tokenizer_path

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 20_000       # pieces of one packing group, about
ROOM = 64                 # a sequence with more than a ROOM-th of its capacity free is packed again
WORD_CACHE = 400_000      # words whose ids a worker keeps (some 200 bytes each)
RUN_CACHE = 800_000       # and runs
BLOCK_BYTES = 1_000_000
LOOKUP_BYTES = 50_000     # texts whose runs are looked up at once, so that what was found stays near
OUT_IDS = 1_000_000       # ids of one output batch

# Runs, in UTF-8, of letters, digits and signs below U+0250 that no normal form changes and
# whose classes and lower case are the same in every Unicode version; others are left to the
# library, as are those with "<", which added tokens begin with.
_PLAIN = re.compile(rb"(?:[!-;=-~]|\xc2[\xa1-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc3\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")


class WordBpe:
    """Ids of runs of text between ASCII white space, as the tokenizers library gives them.

    White space ends every word and no normal form reaches across it, so the ids of a text
    are those of its runs, one after the other.
    """

    def __init__(self, raw: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(raw)
        self.whole.no_truncation()
        self.whole.no_padding()
        d = json.loads(raw)
        kinds = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        pre = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = False
        if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] \
                and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]:
            plain = True
        if not plain or any(c.isspace() for t in d["added_tokens"] for c in t["content"]) \
                or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError("not a word-end BPE file whose words white space ends")
        if any(not t["content"].startswith("<") for t in d["added_tokens"]):
            raise ValueError("added tokens that don't begin with < are not supported")
        from duoclass.llm.bpe import byte_letters

        self.letters = "".join(byte_letters())
        self.packed = [i.to_bytes(4, "little") for i in range(max(d["model"]["vocab"].values()) + 1)]
        self.words = PartCache(self._words, WORD_CACHE)
        self.runs = PartCache(self._runs, RUN_CACHE)
        # a line end, which no run holds, is a word of its own that parts the runs
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"] + r"|\n")

    def _words(self, words: list[str]) -> list[bytes]:
        out, packed, split, letters = [], self.packed, self.whole.model.tokenize, self.letters
        for w in words:
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(letters)
            out.append(b"".join([packed[t.id] for t in split(w)]) if w != "\n" else b"")
        return out

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        out: list = [None] * len(runs)
        plain = [i for i, r in enumerate(runs) if _PLAIN.fullmatch(r)]
        words = self.pattern.findall(b"\n".join([runs[i] for i in plain] + [b""]).decode().lower())
        ids = self.words.values(words)
        whole, lo, at = b"".join(ids), 0, 0
        ends = iter(plain)
        for w, x in zip(words, ids):
            if w == "\n":
                out[next(ends)] = whole[lo:at]
                lo = at
            else:
                at += len(x)
        if len(plain) < len(runs):
            for i, r in enumerate(runs):
                if out[i] is None:
                    out[i] = b"".join(map(self.packed_any, self.whole.encode(r.decode(), add_special_tokens=False).ids))
        return out

    @staticmethod
    def packed_any(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text (in UTF-8)."""
        out = []
        for lo, hi in blocks(list(map(len, texts)), LOOKUP_BYTES):
            lists = [t.split() for t in texts[lo:hi]]
            flat = self.runs.values(list(chain.from_iterable(lists)))
            at = 0
            for x in lists:
                out.append(b"".join(flat[at:at + len(x)]))
                at += len(x)
        return out

    def encode_long(self, text: bytes) -> bytes:
        """The same for one long text, a block at a time."""
        out, at = [], 0
        while at < len(text):
            space = re.compile(rb"[ \t-\r]").search(text, at + BLOCK_BYTES)
            end = space.start() if space else len(text)
            out += self.encode([text[at:end]])
            at = end
        return b"".join(out)


def _pieces(sent, key: str, names: list[str], text_at: int, keep: list[int], capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = worker_state(key, lambda: WordBpe(sent.value))
        for rb in batches:
            col = pc.fill_null(rb.column(text_at).cast(pa.large_string()), "").cast(pa.large_binary())
            for lo, hi in blocks(pc.binary_length(col).to_pylist(), BLOCK_BYTES):
                texts = col.slice(lo, hi - lo).to_pylist()
                coded = coder.encode(texts) if hi - lo > 1 or len(texts[0]) <= BLOCK_BYTES else [coder.encode_long(texts[0])]
                row, piece, start, ids, total = [], [], [], [], 0
                for i, x in enumerate(coded):
                    x += end
                    for j, at in enumerate(range(0, len(x), 4 * capacity)):
                        row.append(lo + i)
                        piece.append(j)
                        start.append(at // 4)
                        ids.append(x[at:at + 4 * capacity])
                        total += capacity
                        if total >= OUT_IDS:
                            yield _piece_batch(rb, names, keep, row, piece, start, ids)
                            row, piece, start, ids, total = [], [], [], [], 0
                if row:
                    yield _piece_batch(rb, names, keep, row, piece, start, ids)

    return run


def _piece_batch(rb, names, keep, row, piece, start, ids):
    at = pa.array(row, pa.int64())
    return batch_of(names, *(rb.column(i).take(at) for i in keep), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()))


def token_pieces(df: DataFrame, text_col: str = "text", path: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a text's ids: the columns of ``df`` but the text, with
    ``piece`` (from 0), ``start`` (ids of the text before it), ``length`` and ``ids``
    (little-endian unsigned 32-bit).

    ``end_id`` follows the ids of every text, so a null or empty text gives one piece of
    one id.  A text of any length is encoded whole, a block at a time.  Rows that repeat are
    pieces of their own.  Columns of ``df`` with these names are replaced.
    """
    spark = df.sparkSession
    prepare(spark)
    new = ["piece", "start", "length", "ids"]
    df = df.drop(*[c for c in new if c != text_col])
    keep = [i for i, c in enumerate(df.columns) if c != text_col]
    out = T.StructType([*(df.schema.fields[i] for i in keep), T.StructField("piece", T.IntegerType()),
                        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids", T.BinaryType())])
    with open(path or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        raw = f.read()
    key = f"words-{blake2b(raw.encode(), digest_size=8).hexdigest()}"
    return df.mapInArrow(_pieces(spark.sparkContext.broadcast(raw), key, out.names, df.columns.index(text_col), keep, capacity, end_id), out)


class Bins:
    """Open sequences of one group, by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = 0
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        # Twice the number of open sequences of each gap.  Place 0 stands for full ones, which
        # don't count: -1 there makes an exact fit's change of the sum (1 - 2n) come out
        # beside the others' (2 + 2 * (n of the new gap - n of the old one)), less 2.
        self.twice = np.zeros(capacity, np.int64)
        self.twice[0] = -1
        self.none = np.full(capacity, 1 << 60, np.int64)
        self.change = np.zeros(capacity, np.int64)

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``capacity`` ids."""
        size = self.capacity
        if length < size:
            d = self.change[:size - length]
            np.subtract(self.twice[:size - length], self.twice[length:], out=d)
            d += self.none[length:]
            rest = int(d.argmin())
            if d[rest] < 1 << 59:
                gap = length + rest
                b = self.open[gap].pop()
                self.twice[gap] -= 2
                if not self.open[gap]:
                    self.none[gap] = 1 << 60
                self._put(rest, b)
                return b, size - gap
        b = self.n
        self.n += 1
        self._put(size - length, b)
        return b, 0

    def _put(self, gap: int, b: int) -> None:
        if gap:
            self.open[gap].append(b)
            self.twice[gap] += 2
            self.none[gap] = 0

    def with_room(self, room: int) -> list[int]:
        """Sequences with more than ``room`` ids free."""
        return [b for x in self.open[room + 1:] for b in x]


def _pack(names: list[str], kept: int, length_at: int, capacity: int, round_no: int, before: tuple[int, int] | None):
    """Streams one group; its last rows have no columns but the ids of sequences with room.

    ``before``: places of the sequence and the offset that the pieces had.  They stay where
    packing again doesn't need fewer sequences.
    """
    room = capacity // ROOM

    def run(batches):
        from pyspark import TaskContext

        no_state()
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        bins = Bins(capacity)
        held, old = [], set()
        schema = None
        for rb in batches:
            schema = rb.schema
            placed = [bins.place(n) for n in rb.column(length_at).to_pylist()]
            seq = pa.array([base + b for b, _ in placed], pa.int64())
            off = pa.array([o for _, o in placed], pa.int64())
            cols = [rb.column(i) for i in range(kept)]
            if before is None:
                yield batch_of(names, *cols, seq, off, pa.nulls(len(placed), pa.int64()))
            else:
                old.update(rb.column(before[0]).to_pylist())
                held.append((rb, seq, off))
        better = bins.n < len(old)
        for rb, seq, off in held:
            cols = [rb.column(i) for i in range(kept)]
            new = (seq, off) if better else (rb.column(before[0]), rb.column(before[1]))
            yield batch_of(names, *cols, *new, pa.nulls(rb.num_rows, pa.int64()))
        again = bins.with_room(room) if before is None or better else []
        if again:
            n = len(again)
            yield batch_of(names, *(pa.nulls(n, schema.field(i).type) for i in range(kept)), pa.nulls(n, pa.int64()),
                           pa.nulls(n, pa.int64()), pa.array([base + b for b in again], pa.int64()))

    return run


def pack(df: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``sequence_id`` and ``offset`` of each piece.

    Pieces of one sequence lie end to end from offset 0.  Rows whose length is null, below
    1 or above ``capacity`` are in no sequence (null in both columns).  Rows that repeat are
    pieces of their own.  Columns of ``df`` with these two names are replaced.  An empty
    table gives an empty one.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop(*[c for c in ("sequence_id", "offset") if c != length_col])
    mark = f"_room_{uuid.uuid4().hex[:8]}"
    kept = len(df.columns)
    length_at = df.columns.index(length_col)
    out = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                        T.StructField(mark, T.LongType())])
    fits = F.col(length_col).between(1, capacity)
    table = cut(df, "pack-in")
    n = table.where(fits).count()
    by = [F.col(length_col).desc(), *(F.col(c) for c, f in zip(df.columns, df.schema.fields) if isinstance(f.dataType, (T.LongType, T.IntegerType, T.StringType)))]
    dealt = table.where(fits).repartition(max(1, math.ceil(n / group_rows))).sortWithinPartitions(*by)
    done = cut(dealt.mapInArrow(_pack(out.names, kept, length_at, capacity, 0, None), out), "pack-0")
    result = [table.where(~F.coalesce(fits, F.lit(False))).select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))]
    for round_no in range(1, 64):
        again = done.where(F.col(mark).isNotNull()).select(F.col(mark).alias("sequence_id"))
        n_again = again.count()
        rows = done.where(F.col(mark).isNull()).drop(mark)
        if round_no == 1:
            n_groups = max(1, math.ceil(n / group_rows))
        if n_groups == 1 or n_again < 2:
            result.append(rows)
            break
        ids = small_or_shuffled(again, n_again)
        result.append(rows.join(ids, "sequence_id", "left_anti").select(*out.names[:-1]))
        open_rows = rows.join(ids, "sequence_id", "left_semi").select(*out.names[:-1])
        n_open = open_rows.count()
        groups = max(1, math.ceil(n_open / group_rows))
        if groups >= n_groups:
            groups = n_groups - 1     # fewer groups every round, so that it ends
        n_groups = groups
        dealt = open_rows.repartition(n_groups, "sequence_id").sortWithinPartitions(*by)
        done = cut(dealt.mapInArrow(_pack(out.names, kept, length_at, capacity, round_no, (kept, kept + 1)), out), f"pack-{round_no}")
    whole = result[0]
    for x in result[1:]:
        whole = whole.unionByName(x)
    return whole


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, n_ids, ids) of packed pieces: their ids end to end.

    At most ``capacity`` pieces meet in a group, as each has one id or more.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    joined = packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")).alias("ids"))
    return joined.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids")
