"""Toxicity by maximum-scoring segments of token log-odds.

Learning (only from rows outside the held-out fold, at most ``FIT_ROWS`` of
them, taken in the order of a hash of the id, one of each group of copies and
near copies by least hashes of five-word shingles): every word, and every word
beginning of 4, 5 and 6 letters, gets the log-odds of its document counts in
toxic against other rows under a Dirichlet prior, and the z-value of these
odds.  Features whose z and odds are both clear make the lexicon; a word scores
by its clearest feature.

Scoring a text: each word adds its log-odds, at every place where it stands,
less a small drift.  One linear pass (Ruzzo and Tompa) finds all maximal scoring segments.  Their scores are
put on one scale by extreme-value statistics: lambda solves the sum of
p(word) * exp(lambda * score) = 1 over the background of other rows, K is
counted on them, and a segment of score S in a text of n words has
E = K n exp(-lambda S) expected equals by chance, so that the chance of one at
all is P = 1 - exp(-E).  Segments with P up to ``P_MAX`` are reported as toxic
passages.  The document's statistic is its best segment's -ln P (0 without a
segment); a logistic curve fitted on the learning rows turns it into the
probability returned.

Cases: null and empty texts have no segment and get the score of a text
without evidence; a label without an id or value is ignored; if an id has
several labels the toxic one counts; without labels of both kinds every
document gets the share of toxic labels (0 without any); repeated rows are
scored alike; whole texts are read whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stretches, at, mixed64, positional, restore, take, text_chunks, word_bounds, word_hashes, write_shared

FIT_ROWS = 50_000
FOLDS = 5
PRIOR = 0.5
MIN_Z = 3.5
MIN_ODDS = 0.7
MAX_ODDS = 8.0
PREFIXES = (6, 5, 4)
DRIFT = 0.05
P_MAX = 0.01
BACKGROUND_SCORE = 2.0
SHINGLE = 5
SCORED_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


class _Scores(dict):
    """word -> score without drift (0: not in the lexicon); remembers up to ``SCORED_WORDS`` words."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        w = word.lower()
        found = [self.lexicon[k] for k in ["=" + w, *(w[:n] for n in PREFIXES if len(w) > n)] if k in self.lexicon]
        s = max(found, key=lambda f: abs(f[1]))[0] if found else 0.0
        if len(self) >= SCORED_WORDS:
            self.clear()
        self[word] = s
        return s


def scored(words: list[str], scores: _Scores) -> list[tuple[int, float]]:
    """(word number, score) of the words that have a score, at every place where they stand."""
    return [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s]


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word).

    ``hits``: (word number, score) of the words that have one, ascending; every
    word costs ``drift``.  Words without a score only lower the running sum, so
    the pass touches the hits alone.
    """
    # Sum before, sum after, first, last, and the nearest earlier entry with a smaller sum before.
    stack: list[tuple[float, float, int, int, int]] = []
    total, at_word = 0.0, 0
    for i, s in hits:
        total -= drift * (i - at_word)
        at_word = i + 1
        before, total = total, total + s - drift
        if total <= before:
            continue
        left, right, first = before, total, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, right, first, i, j))
    return [(r - lo, a, b) for lo, r, a, b, _ in stack]


@dataclass
class Model:
    lexicon: dict[str, tuple[float, float]]  # feature -> (odds, z); "=word" is a whole word
    lam: float
    k: float
    bias: float
    slope: float
    share: float

    def statistic(self, best: float, words: int) -> float:
        """-ln of the chance that a text of so many words has such a segment; 0 without one."""
        if best <= 0:
            return 0.0
        minus_ln_e = self.lam * best - math.log(self.k * words)
        return min(40.0, minus_ln_e if minus_ln_e > 25 else -math.log(-math.expm1(-math.exp(-minus_ln_e))))

    def probability(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * x))))

    def score(self, texts, scores: _Scores | None = None):
        """(probability, passages) of each text; a passage is (start, end, -ln P)."""
        scores = _Scores(self.lexicon) if scores is None else scores
        for text in texts:
            words = _WORD.findall(text) if text else []
            if not self.lexicon:
                yield self.share, []
                continue
            found = segments(scored(words, scores))
            best = max((s for s, _, _ in found), default=0.0)
            spans = []
            clear = [(self.statistic(s, len(words)), a, b) for s, a, b in found]
            clear = [c for c in clear if c[0] >= -math.log(P_MAX)]
            if clear:
                places = [m.span() for m in _WORD.finditer(text)]
                spans = [(places[a][0], places[b][1], x) for x, a, b in clear]
            yield self.probability(self.statistic(best, len(words))), spans


def _sketch(batches):
    """(id, toxic, m0 .. m3): least hashes of the five-word shingles of a text."""
    import pyarrow as pa
    for b in batches:
        for i, j, buf, offs in text_chunks(b.column(1), 2 << 20):
            start, end, row = word_bounds(buf, offs)
            least = np.zeros((4, j - i), np.uint64)
            if len(start):
                n = np.bincount(row, minlength=j - i)
                first = np.cumsum(n) - n
                at = np.arange(len(start))
                stop = np.minimum(at + SHINGLE, np.repeat(first + n, n))
                whole = (stop - at == SHINGLE) | (at == np.repeat(first, n))  # a short text is one shingle
                at, stop, row = at[whole], stop[whole], row[whole]
                h = Stretches(word_hashes(buf, start, end)).of(at, stop - at)
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                for k in range(4):
                    least[k, row[begin]] = np.minimum.reduceat(mixed64(h ^ np.uint64(k * 7919 + 1)), begin)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *[pa.array(x.view(np.int64)) for x in least]],
                ["id", "toxic", "m0", "m1", "m2", "m3"])


def _labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """Texts and labels to learn from, one of each group of copies and near copies."""
    def with_text(lab: DataFrame) -> DataFrame:
        # At most fit_rows rows of a few bytes: the documents themselves are never shuffled.
        return take(docs, "doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("lab_id"))

    lab = (take(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
           .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "lab_id"))
    lab = write_shared(lab, "fit-labels")
    kind = lab.schema["lab_id"].dataType.simpleString()
    sketched = with_text(lab).select("lab_id", "text", "toxic").mapInArrow(
        _sketch, f"id {kind}, toxic int, m0 long, m1 long, m2 long, m3 long")
    # A text that shares a least hash with one of a smaller id is a copy or near copy of it.
    for k in range(4):
        sketched = sketched.withColumn(f"f{k}", F.min("id").over(Window.partitionBy(f"m{k}")))
    lab = write_shared(sketched.filter(" and ".join(f"f{k} = id" for k in range(4)))
                       .select(F.col("id").alias("lab_id"), "toxic").distinct(), "fit-rows")
    return with_text(lab).select("text", "toxic")


def _count_words(batches):
    """(word, toxic documents, other documents, times in other documents), partial."""
    import pyarrow as pa

    def rows(c):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.string()), pa.array([v[0] for v in c.values()], pa.int64()),
             pa.array([v[1] for v in c.values()], pa.int64()), pa.array([v[2] for v in c.values()], pa.int64())],
            ["word", "t", "c", "times"])

    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w, times in Counter(_WORD.findall((text or "").lower())).items():
                v = counts.setdefault(w, [0, 0, 0])
                v[0 if toxic else 1] += 1
                v[2] += 0 if toxic else times
        if len(counts) > 200_000:
            yield rows(counts)
            counts = {}
    yield rows(counts)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    train = _labelled(docs, labels, fit_rows)
    words = write_shared(train.mapInArrow(_count_words, "word string, t long, c long, times long").groupBy("word")
                         .agg(*[F.sum(n).alias(n) for n in ("t", "c", "times")]), "word-counts")
    nt, nc, stood = words.agg(F.sum("t"), F.sum("c"), F.sum("times")).first()
    if not nt or not nc:
        n = train.agg(F.avg("toxic")).first()[0]
        return Model({}, 1.0, 1.0, 0.0, 0.0, float(n or 0.0))
    feats = F.array(F.concat(F.lit("="), F.col("word")),
                    *[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIXES])
    f = (words.select(F.explode(feats).alias("f"), "t", "c", "times").filter("f is not null").groupBy("f")
         .agg(*[F.sum(n).alias(n) for n in ("t", "c", "times")]))
    a, b = F.col("t") + PRIOR, F.col("c") + PRIOR
    odds = F.log(a / (nt + PRIOR - F.col("t"))) - F.log(b / (nc + PRIOR - F.col("c")))
    f = f.filter((F.col("t") <= nt) & (F.col("c") <= nc)).withColumn("odds", F.greatest(F.lit(-MAX_ODDS), F.least(F.lit(MAX_ODDS), odds)))
    f = f.withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b))
    # Learned from at most fit_rows rows, so the lexicon is bounded too.
    kept = f.filter((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS)).select("f", "odds", "z", "times").collect()
    lexicon = {r.f: (r.odds, r.z) for r in kept}
    if not lexicon:
        return Model({}, 1.0, 1.0, 0.0, 0.0, float(train.agg(F.avg("toxic")).first()[0]))
    # Background of the other rows: share of the places where each lexicon word stands (smoothed), the rest neutral.
    own = [(r.odds - DRIFT, (r.times + PRIOR) / stood) for r in kept if r.f.startswith("=")]
    lam = _lambda(own)

    def best(batches):
        import pyarrow as pa
        scores = _Scores(lexicon)
        for b in batches:
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = _WORD.findall(text or "")
                out.append((max((s for s, _, _ in segments(scored(ws, scores))), default=0.0), len(ws), toxic))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.float64()),
                                              pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], pa.int32())], ["best", "n", "toxic"])

    got = train.mapInArrow(best, "best double, n long, toxic int").toPandas()  # three numbers for each fitted row
    other = got[got.toxic == 0]
    chance = int((other.best >= BACKGROUND_SCORE).sum())
    k = (chance + PRIOR) / (max(int(other.n.sum()), 1) * math.exp(-lam * BACKGROUND_SCORE))
    model = Model(lexicon, lam, k, 0.0, 1.0, float((got.toxic > 0).mean()))
    x = np.array([model.statistic(b, n) for b, n in zip(got.best, got.n)])
    model.bias, model.slope = _logistic(x, (got.toxic.to_numpy() > 0).astype(float))
    return model


def _lambda(own: list[tuple[float, float]]) -> float:
    """Positive root of sum p exp(lambda s) = 1, neutral words scoring -DRIFT."""
    rest = max(1.0 - sum(p for _, p in own), 0.0)

    def over(lam: float) -> float:
        return rest * math.exp(-lam * DRIFT) + sum(p * math.exp(min(lam * s, 700.0)) for s, p in own) - 1.0

    lo, hi = 1e-3, 1e-3
    while over(hi) < 0 and hi < 50:
        hi *= 1.5
    if hi == lo:
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if over(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Bias and slope of a one-variable logistic curve (Newton steps)."""
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages: array of (start, end, minus_ln_p) by code point, end exclusive."""
    def run(batches):
        import pyarrow as pa
        scores = _Scores(model.lexicon)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("minus_ln_p", pa.float64())])
        for b in batches:
            got = list(model.score(b.column(1).to_pylist(), scores))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()),
                 pa.array([[dict(zip(("start", "end", "minus_ln_p"), s)) for s in g[1]] for g in got], pa.list_(span))],
                ["doc_id", "score", "passages"])

    src = take(docs, "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,minus_ln_p:double>>")


def reject_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows scored ``limit`` or more, all columns kept."""
    model = fit(docs, labels, fit_rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([p for p, _ in model.score(texts)], dtype=float)

    p, names = positional(docs)
    return restore(p.filter(score(at(names, "text")) < limit), names)
