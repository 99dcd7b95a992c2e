"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each place; the pass keeps
the best score and the number of tokens of the best path to each place, and no paths.
Ties go the tokenizer's way: of equally good paths to a place the one whose last piece
starts first wins, and a letter without a piece of its own is reached as unknown only
by a strictly better score.

No piece holds a word mark after another letter, so every best path passes each place
between a letter and a mark, and a text is the sum of the units between them; a unit
met before in the same worker is looked up.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duoclass.llm.common import batch_of, prepare, worker_state
from duoclass.llm.tokenfiles import unigram_pieces

MARK = "▁"
UNKNOWN_PENALTY = 10.0   # an unknown letter scores this much below the worst piece
CACHE = 150_000          # units of one generation of the cache
CACHE_CHARS = 64
_UNIT = regex.compile("▁*[^▁]+|▁+")


class Counter:
    """Counts the tokens of texts under (piece, score) pairs.

    ``byte_fallback``: a run of unknown letters counts as its bytes, else as one token.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        if not any(p == MARK for p, _ in pieces) or any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("needs a vocabulary with word marks at the start of pieces")
        self.byte_fallback = byte_fallback
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.letters = {p for p, _ in pieces if len(p) == 1}
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def unit(self, s: str) -> int:
        """Tokens of the best path through ``s``."""
        n = len(s)
        best = [-math.inf] * (n + 1)
        count = [0] * (n + 1)
        open_ = [False] * (n + 1)  # does the best path end in an unknown letter?
        best[0] = 0.0
        letters, unknown, fall = self.letters, self.unknown, self.byte_fallback
        at = 0  # places up to here are settled

        def step(to: int) -> None:
            # the unknown edges are the last ones into a place: their letter starts latest
            nonlocal at
            while at < to:
                c = s[at]
                if c not in letters and best[at] + unknown > best[at + 1]:
                    best[at + 1] = best[at] + unknown
                    if fall:
                        count[at + 1] = count[at] + len(c.encode())
                    else:
                        count[at + 1] = count[at] + (not open_[at])
                    open_[at + 1] = True
                at += 1

        for last, (length, score) in self.auto.iter(s):
            end = last + 1
            if at < last:
                step(last)
            x = best[end - length] + score
            if x > best[end]:  # longest pieces of an end come first
                best[end] = x
                count[end] = count[end - length] + 1
                open_[end] = False
        step(n)
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text: spaces are word marks and one stands before it."""
        if not text:
            return 0
        units = _UNIT.findall(MARK + text.replace(" ", MARK))
        got = list(map(self.new.get, units))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self._look(units[i])
        return sum(got)

    def _look(self, s: str) -> int:
        n = self.new.get(s)
        if n is None:
            n = self.old.get(s)
            if n is None:
                n = self.unit(s)
            if len(s) <= CACHE_CHARS:
                if len(self.new) >= CACHE:
                    self.old, self.new = self.new, {}
                self.new[s] = n
        return n


def count_tokens(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with ``n_tokens`` (long).

    A null or empty text has 0 tokens.  A column of ``df`` with that name is replaced.
    The vocabulary (a file of fixed size) is sent to the tasks once.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("n_tokens")
    sent = spark.sparkContext.broadcast(unigram_pieces(path))
    key, at = f"count-{uuid.uuid4().hex}", df.columns.index(text_col)
    out = T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType())])
    names = out.names

    def run(batches):
        c = worker_state(key, lambda: Counter(sent.value))
        for rb in batches:
            yield batch_of(names, *rb.columns, pa.array([c.count(t.as_py() or "") for t in rb.column(at)], pa.int64()))

    return df.mapInArrow(run, out)
