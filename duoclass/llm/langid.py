"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, which a
forward pass adds up; a text's score is the sum of its words' logarithms.  The piece
probabilities are fitted by expectation maximisation (forward and backward passes over
the words of a bounded sample of labelled texts), each round one Spark aggregation.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.llm.common import batch_of, cut, drop, prepare, worker_state
from duoclass.llm.partcache import PartCache
from duoclass.llm.tokenfiles import unigram_pieces

SAMPLE_DOCS = 1000   # about so many distinct labelled texts of a language are learned from
ROUNDS = 3           # of expectation maximisation
SHORT = 32           # letters up to which a run's probability can't leave the range of a double
SMOOTH = 0.1         # added to every piece's expected count
UNKNOWN = 1e-8       # probability of a letter outside the vocabulary, in every language
CACHE = 400_000      # runs whose scores a worker keeps (some 200 bytes each)
BLOCK_CHARS = 2_000_000
UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters, lower case, with or without the mark of a word's start."""
    out = {}
    for piece, _ in unigram_pieces(path):
        bare = piece[1:] if piece.startswith("▁") else piece
        if (bare == "" or _LETTERS.fullmatch(bare)) and piece == piece.lower():
            out[piece] = None
    return list(out)


def parts_of(text: str) -> list[str]:
    """Runs of letters, lower-cased and marked at their start."""
    return ["▁" + w for w in _LETTERS.findall(text.lower())]


class Model:
    """languages, and for each piece its probability in each of them."""

    def __init__(self, languages: list[str], probs: dict[str, tuple[float, ...]]):
        self.languages, self.probs = languages, probs
        self.unknown = (UNKNOWN,) * len(languages)
        self.longest = max(map(len, probs), default=1)

    def edges(self, s: str) -> list[tuple[int, int, tuple[float, ...]]]:
        """Pieces found in ``s`` as (start, end, probabilities), by start."""
        get, top, n = self.probs.get, self.longest, len(s)
        out = []
        for i in range(n):
            p = get(s[i:i + 1])
            out.append((i, i + 1, self.unknown if p is None else p))
            for j in range(i + 2, min(n, i + top) + 1):
                p = get(s[i:j])
                if p is not None:
                    out.append((i, j, p))
        return out

    def log_probs(self, s: str) -> list[float]:
        """Logarithm of the summed probability of all segmentations, by language."""
        e, n = self.edges(s), len(s)
        if n > SHORT:
            return [self._scaled(e, n, self.longest, lang)[2] for lang in range(len(self.languages))]
        out = []
        for lang in range(len(self.languages)):
            a = [0.0] * (n + 1)
            a[0] = 1.0
            for i, j, p in e:
                a[j] += a[i] * p[lang]
            out.append(math.log(a[n]))
        return out

    @staticmethod
    def _scaled(e: list, n: int, longest: int, lang: int) -> tuple[list[float], list[float], float]:
        """Forward sums of a run of any length: a[i] * exp(shift[i]) for each place, and the
        logarithm of the last.  What lies ahead is scaled up whenever a sum becomes small."""
        a, shift = [0.0] * (n + 1), [0.0] * (n + 1)
        a[0], done, at = 1.0, 0.0, 0
        for i, j, p in e:
            if i != at:
                at = i
                if a[i] < 1e-100:
                    up = 1.0 / a[i]
                    done += math.log(a[i])
                    for k in range(i, min(n, i + longest) + 1):
                        a[k] *= up
                shift[i] = done
            a[j] += a[i] * p[lang]
        shift[n] = done
        return a, shift, math.log(a[n]) + done

    def expected(self, s: str, lang: int) -> tuple[list, list[float]]:
        """Expected uses of each piece over all segmentations (forward and backward)."""
        e, n = self.edges(s), len(s)
        if n > SHORT:
            a, up, total = self._scaled(e, n, self.longest, lang)
            back = sorted(((n - j, n - i, p) for i, j, p in e), key=lambda x: x[0])
            b, down, _ = self._scaled(back, n, self.longest, lang)
            return e, [math.exp(math.log(a[i]) + up[i] + math.log(p[lang]) + math.log(b[n - j]) + down[n - j] - total) for i, j, p in e]
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        a[0] = b[n] = 1.0
        for i, j, p in e:
            a[j] += a[i] * p[lang]
        for i, j, p in reversed(e):
            b[i] += b[j] * p[lang]
        return e, [a[i] * p[lang] * b[j] / a[n] for i, j, p in e]


def _word_counts(batches):
    for rb in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            seen[lang].update(parts_of(text or ""))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        if rows:
            lang, w, n = zip(*rows)
            yield batch_of(["lang", "part", "n"], pa.array(lang), pa.array(w), pa.array(n, pa.int64()))


def _expected_counts(model):
    def run(batches):
        m = model.value
        total: dict[tuple[int, str], float] = defaultdict(float)
        at = {x: i for i, x in enumerate(m.languages)}
        for rb in batches:
            for lang, s, n in zip(*(rb.column(i).to_pylist() for i in range(3))):
                e, c = m.expected(s, at[lang])
                for (i, j, p), x in zip(e, c):
                    if p is not m.unknown:
                        total[at[lang], s[i:j]] += n * x
        if total:
            yield batch_of(["l", "piece", "c"], pa.array([k[0] for k in total], pa.int32()),
                           pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.float64()))

    return run


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None,
          sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit the piece probabilities on rows with a language and a text.

    Of a language with more than ``sample_docs`` different texts, those whose hash falls
    below the matching share of the hash range are used (equal texts once).  What reaches the
    driver is a number for each language and piece, however large the table.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    h = F.xxhash64("text")
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = vocabulary(path)
    if not languages:
        return Model([], {})
    share = spark.createDataFrame([(x, min(1.0, sample_docs / sizes[x])) for x in languages], "lang string, share double")
    sample = (rows.join(F.broadcast(share), "lang").where(F.pmod(h, F.lit(1 << 30)) < F.col("share") * (1 << 30))
              .groupBy("lang", h.alias("h")).agg(F.first("text").alias("text")).select("lang", "text"))
    words = cut(sample.mapInArrow(_word_counts, "lang string, part string, n long")
                .groupBy("lang", "part").agg(F.sum("n").alias("n")), "lang-words")
    one = (1.0 / len(pieces),) * len(languages)
    model = Model(languages, dict.fromkeys(pieces, one))
    dealt = words.repartition(spark.sparkContext.defaultParallelism)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        found = (dealt.mapInArrow(_expected_counts(sent), "l int, piece string, c double")
                 .groupBy("l", "piece").agg(F.sum("c").alias("c")).collect())
        counts = np.full((len(languages), len(pieces)), SMOOTH)
        at = {p: i for i, p in enumerate(pieces)}
        for r in found:
            counts[r["l"], at[r["piece"]]] += r["c"]
        probs = (counts / counts.sum(axis=1, keepdims=True)).T
        model = Model(languages, {p: tuple(x) for p, x in zip(pieces, probs.tolist())})
        sent.unpersist()
    drop(words)
    return model


class _Scores:
    """Scores of the runs a worker has met, as bytes of a row of doubles."""

    def __init__(self, model: Model):
        self.model = model
        self.kept = PartCache(self._score, CACHE)

    def _score(self, parts: list[str]) -> list[bytes]:
        return [np.array(self.model.log_probs(s)).tobytes() for s in parts]

    def rows(self, parts: list[str]) -> np.ndarray:
        """A row for each part."""
        return np.frombuffer(b"".join(self.kept.values(parts))).reshape(len(parts), -1)


def _blocks(col):
    """Row ranges of at most BLOCK_CHARS bytes (or one row)."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > BLOCK_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(col):
        yield lo, len(col)


def _predict(sent, key: str, names: list[str], text_at: int):
    def run(batches):
        scores = worker_state(key, lambda: _Scores(sent.value))
        languages = scores.model.languages
        for rb in batches:
            pred, score = [], []
            for lo, hi in _blocks(rb.column(text_at)):
                lists = [parts_of(t) if t else [] for t in rb.column(text_at).slice(lo, hi - lo).to_pylist()]
                flat = [s for x in lists for s in x]
                total = np.zeros((len(lists), len(languages)))
                if flat and languages:
                    lens = np.array([len(x) for x in lists])
                    full = np.flatnonzero(lens)
                    starts = (np.cumsum(lens) - lens)[full]
                    total[full] = np.add.reduceat(scores.rows(flat), starts, axis=0)
                for x, t in zip(lists, total):
                    if not x or not languages:
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                    else:
                        best = int(np.argmax(t))
                        pred.append(languages[best])
                        score.append(float(1.0 / np.exp(t - t[best]).sum()))
            yield batch_of(names, *rb.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()))

    return run


def predict_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``lang_pred`` and ``lang_score``.

    ``lang_pred`` is the likeliest learned language (of equals the first in order) and
    ``lang_score`` its probability against the others, 0 to 1.  A text that is null or
    has no letter, or any text where nothing was learned, is ``und`` with score 0.  Rows that
    repeat are predicted each; a text or a run of letters of any length is scored whole.
    Columns of ``df`` with these two names are replaced.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop("lang_pred", "lang_score")
    out = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()),
                        T.StructField("lang_score", T.DoubleType())])
    sent = spark.sparkContext.broadcast(model)
    return df.mapInArrow(_predict(sent, f"lang-{uuid.uuid4().hex}", out.names, df.columns.index(text_col)), out)
