"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on statistics of labelled texts; every path from a root is
a conjunctive rule.  A lasso-penalised logistic regression gives the rules their
weights, most of them zero, and what remains is compiled into one Spark column
expression over the statistics.  Labels, language, source and id are no inputs.

Learning is bounded: about ``SAMPLE_ROWS`` labels at most, chosen by hashed id and
label, reach the driver, and only as statistics; an id with several labels counts
with each of them, one with several texts by the least.  Everything is scored.

Defined results: a null text counts as empty; the empty text has statistics of
zero and a score like any other; equal texts have equal scores; repeated rows
get a row each; a null id is not held out (``held_out`` false) and never learnt
from; an empty table gives no rows; without labels of both kinds every
score is the share of good labels, one half if there are none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS = 60, 3, 32
#: Penalties that are tried on a fifth of the sample, and how much more loss the
#: larger ones may have.
PENALTIES = (0.03, 0.01, 0.003, 0.001)
TOLERANCE = 0.002

STATISTICS = (
    "chars", "words", "lines", "word_length", "word_length_spread", "long_words", "short_words",
    "letters", "upper", "digits", "spaces", "stops", "commas", "marks", "odd_marks", "high_bytes",
    "capital_words", "upper_words", "marked_words", "bare_marks", "distinct_words", "commonest_word", "repeated_next",
    "repeated_pairs", "distinct_lines", "commonest_line", "words_a_line", "stops_a_word", "entropy", "shortest_line",
)

_BYTES = np.arange(256)
_LETTER = (((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_PLAIN_MARK = np.isin(_BYTES, list(b".,;:'\"-()?"))
_MARK = ~_LETTER & ~_DIGIT & ~_SPACE
_MARKS = bytes(np.flatnonzero(_MARK).tolist())


def statistics(text: str | None) -> list[float]:
    """The numbers that rules speak about, in the order of ``STATISTICS``."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(raw), len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = np.fromiter(map(len, words), np.int64, w)
    marks = int(count[_MARK].sum())
    plain = int(count[_PLAIN_MARK].sum())
    letters = max(1, int(count[_LETTER].sum()))
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_kinds = Counter(lines)
    ends = Counter(x[-1] for x in words)
    begins = Counter(x[0] for x in words)
    odd_ends = sum(c for b, c in ends.items() if _MARK[b] and not _PLAIN_MARK[b])
    bare = sum(c for x, c in kinds.items() if not x.strip(_MARKS))
    upper = sum(c for x, c in kinds.items() if len(x) > 1 and x.isupper())
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = count[count > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(len(lines))), float(size.mean()), float(size.std()), float((size > 12).mean()), float((size < 3).mean()),
        letters / n, int(count[_UPPER].sum()) / letters, int(count[_DIGIT].sum()) / n, int(count[_SPACE].sum()) / n, int(count[46]) / n, int(count[44]) / n, marks / n, (marks - plain) / n, int(count[128:].sum()) / n,
        sum(c for b, c in begins.items() if _UPPER[b]) / w, upper / w, odd_ends / w, bare / w, len(kinds) / w, max(kinds.values()) / w, same / w,
        1 - pairs / max(1, w - 1) if w > 1 else 0.0, len(line_kinds) / max(1, len(lines)), max(line_kinds.values(), default=0) / max(1, len(lines)), float(np.log1p(w / max(1, len(lines)))), int(count[46]) / w, float(-(p * np.log2(p)).sum()), float(np.log1p(min(map(len, lines), default=0))),
    ]


#: A name that no input has.
COLUMN = "__statistics"


def with_statistics(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``df``, the text only if asked for, and an array ``COLUMN``."""
    common.ship(df.sparkSession)
    keep = [c for c in df.columns if c != text] + [text] * keep_text
    width = len(df.columns) - (not keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                made = [statistics(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(made, pa.list_(pa.float64()))], [*keep, COLUMN])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(COLUMN, T.ArrayType(T.DoubleType(), False), False)])
    return df.select(*(df[c] for c in keep), *([] if keep_text else [df[text]])).mapInArrow(common.task(run), schema)


#: A rule holds where each (statistic, above, value) does: > value, or <= value.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, statistics_: Column) -> Column:
        """The score as one expression."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            cond = None
            for f, above, value in rule:
                s = F.get(statistics_, F.lit(f))
                one = s > F.lit(float(value)) if above else s <= F.lit(float(value))
                cond = one if cond is None else cond & one
            z = z + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, value in rule:
        out &= (x[:, f] > value) == above
    return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: Rule, rules: dict[Rule, None], step: np.ndarray) -> None:
    """One tree on binned ``x`` by the squared loss of the residual ``g``."""
    base = g[rows].mean() if len(rows) else 0.0
    step[rows] = base
    if path:
        rules[path] = None
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-6 * len(rows), -1, -1)
    total, n = g[rows].sum(), len(rows)
    for f in features:
        code = x[rows, f]
        c = np.bincount(code, minlength=BINS + 1)
        s = np.bincount(code, g[rows], minlength=BINS + 1)
        nl, sl = np.cumsum(c)[:-1], np.cumsum(s)[:-1]
        ok = (nl >= 5) & (n - nl >= 5)
        if not ok.any():
            continue
        gain = np.where(ok, sl**2 / np.maximum(nl, 1) + (total - sl) ** 2 / np.maximum(n - nl, 1) - total**2 / n, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), k)
    _, f, k = best
    if f < 0:
        return
    value = float(cuts[f][k])
    low = x[rows, f] <= k
    _grow(x, cuts, g, rows[low], features, depth - 1, (*path, (f, False, value)), rules, step)
    _grow(x, cuts, g, rows[~low], features, depth - 1, (*path, (f, True, value)), rules, step)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Rule]:
    """Paths of boosted trees, each grown on part of the rows and statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    cuts = [np.append(c, np.full(BINS + 1 - len(c), np.inf)) for c in cuts]
    z, rules = np.full(len(y), 0.0), {}
    for _ in range(TREES):
        g = y - 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        features = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
        step = np.zeros(len(y))
        made: dict[Rule, None] = {}
        _grow(binned, cuts, g, rows, features, DEPTH, (), made, step)
        for r in made:
            rules[tuple(sorted(r))] = None
        # Add the tree's leaf values to every row, not only to its own.
        leaves = [r for r in made if not any(len(o) > len(r) and o[: len(r)] == r for o in made)]
        for r in leaves:
            own = holds(r, x)
            inside = np.intersect1d(np.flatnonzero(own), rows, assume_unique=True)
            if len(inside):
                z[own] += 0.5 * 4 * g[inside].mean()
    return list(rules)


def lasso(h: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the penalised logistic loss."""
    n, m = h.shape
    scale = np.sqrt(np.maximum(h.mean(0) * (1 - h.mean(0)), 1e-4))
    a = (h - h.mean(0)) / scale
    v = np.ones(m) / max(1, np.sqrt(m))
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * float(np.linalg.norm(a @ v) ** 2) / n + 0.25)
    w, b, u, c, t = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(m), 0.0, 1.0
    c = b
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ u + c))) - y
        new = u - rate * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    weight = w / scale
    return float(b - (h.mean(0) * weight).sum()), weight


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules, then weights with the penalty that does best on rows left out."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(p / (1 - p))), [])
    rules = tree_rules(x, y)
    h = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    some = (h.mean(0) > 0.002) & (h.mean(0) < 0.998)
    rules, h = [r for r, s in zip(rules, some, strict=True) if s], h[:, some]
    if not rules:
        return fit(x[:0], y[:0])
    out = np.arange(len(y)) % 5 == 0
    loss = []
    for p in PENALTIES:
        b, w = lasso(h[~out], y[~out], p)
        s = np.clip(1 / (1 + np.exp(-(h[out] @ w + b))), 1e-6, 1 - 1e-6)
        loss.append(-(y[out] * np.log(s) + (1 - y[out]) * np.log(1 - s)).mean())
    # The largest penalty that is about as good as the best: fewer rules.
    penalty = next(p for p, v in zip(PENALTIES, loss, strict=True) if v <= min(loss) + TOLERANCE)
    b, w = lasso(h, y, penalty)
    return Ensemble(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """From a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = common.sampled(known, SAMPLE_ROWS, "doc_id", "quality")
    # Two numbers for each of at most SAMPLE_ROWS rows are broadcast.
    texts = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    # An id that stands on many rows has one text here, the least.
    one = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = with_statistics(one).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows[COLUMN].tolist(), float).reshape(len(rows), len(STATISTICS))
    return fit(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """``docs`` with its text replaced by ``score``."""
    return with_statistics(docs.withColumn("text", common.text_or_empty())).withColumn("score", model.column(F.col(COLUMN))).drop(COLUMN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
