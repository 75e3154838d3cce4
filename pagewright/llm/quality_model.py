"""Quality classifier: a sparse ensemble of rules compiled to Spark columns.

1. Statistics of every whole text are computed as columns.
2. Small gradient-boosted trees are grown on labelled rows, and each path from a root to a node becomes a rule: a
   conjunction of comparisons of statistics.
3. A logistic model with a lasso penalty weighs the rules; most weights become zero.
4. The rules that are left are compiled into one Spark expression, which scores every document.

Labelled rows are learned from only if the CRC-32 of the doc_id as text, modulo ``FOLDS``, is not zero.  Of those, at
most ``MOST_LABELLED`` ids are used, the first by a hash of the doc_id; where ids repeat in the documents, at most twice
as many texts.  Labels, language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have all statistics zero and get the score that the rules give them; with no
labels, or labels of one kind, every score is the labels' mean (0.5 without labels); rows that repeat a doc_id get a
row each; long texts are read whole; an empty table gives an empty result; other columns are left aside, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_of

FOLDS = 5
MOST_LABELLED = 20_000
THRESHOLD = 0.3
STATS = (
    "log_words", "word_chars", "symbols", "upper", "digits", "shouts", "stops", "pipes", "other_bytes",
    "distinct_words", "same_next", "repeated_triples", "marked_words", "line_words", "repeated_lines", "top_word",
)


def statistics(raw: bytes) -> list[float]:
    """Statistics of a text in UTF-8; shares are of bytes, words or lines, and of an empty text 0."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    share = lambda chars: float(counts[list(chars)].sum()) / size
    times = Counter(words)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = sum(1 for w in words if w[-1] in b"#*$%&!|<>~^" or w[0] in b"#*$%&|<>~^")
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, share(b"#*$%&|<>~^_={}[]\\"), share(range(65, 91)), share(b"0123456789"), share(b"!?"), share(b".,;:"), share(b"|"),
        float(counts[128:].sum()) / size, len(times) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, (1 - len(set(triples)) / len(triples)) if triples else 0.0,
        marked / n, n / len(lines), 1 - len(set(lines)) / len(lines), max(times.values()) / n,
    ]


def with_statistics(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics) of every document."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_buffer().to_pybytes()) for x in batch.column(1).cast(pa.binary())], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], ["doc_id", *STATS])

    return documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, bound)


def grown_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48) -> list[Rule]:
    """The paths of gradient-boosted trees on logistic loss, each once."""
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)  # bin > i means x > bounds[i]
    raw = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    least = max(5.0, 0.002 * len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        level: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for step in range(depth + 1):
            following = []
            for rule, rows in level:
                best = (1e-6, -1, 0)
                if step < depth and len(rows) >= 2 * least:
                    g, w = gradient[rows], weight[rows]
                    base = g.sum() ** 2 / (w.sum() + 1)
                    for j, b in enumerate(bounds):
                        gs, ws, ns = (np.bincount(binned[rows, j], v, minlength=len(b) + 1)[:-1].cumsum() for v in (g, w, None))
                        gain = gs**2 / (ws + 1) + (g.sum() - gs) ** 2 / (w.sum() - ws + 1) - base
                        gain[(ns < least) | (len(rows) - ns < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), j, int(gain.argmax()))
                if best[1] < 0:
                    raw[rows] += rate * gradient[rows].sum() / (weight[rows].sum() + 1)
                    continue
                _, j, i = best
                above = binned[rows, j] > i
                for side in (False, True):
                    longer = (*rule, (j, side, float(bounds[j][i])))
                    rules[tuple(sorted(longer))] = None
                    following.append((longer, rows[above == side]))
            level = following
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Whether each row satisfies each rule."""
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for j, above, bound in rule:
            out[:, k] &= (x[:, j] > bound) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of least logistic loss plus ``penalty`` times the weights' sizes, by accelerated proximal steps."""
    z = z.astype(float)
    n = len(y)
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    bias, weights = 0.0, np.zeros(z.shape[1])
    ahead_b, ahead_w, pace = bias, weights, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(ahead_b + z @ ahead_w))) - y
        new_b = ahead_b - step * error.mean()
        moved = ahead_w - step * (z.T @ error) / n
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead_b, ahead_w = new_b + (pace - 1) / next_pace * (new_b - bias), new_w + (pace - 1) / next_pace * (new_w - weights)
        bias, weights, pace = new_b, new_w, next_pace
    return float(bias), weights


Model = tuple[float, list[tuple[float, Rule]]]


def fit(x: np.ndarray, y: np.ndarray, *, penalty: float = 0.001) -> Model:
    """The intercept and the weighted rules."""
    if len(y) == 0 or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), []
    rules = grown_rules(x, y)
    z = holds(rules, x)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules = [rules[i] for i in sorted(first)]
    z = holds(rules, x)
    bias, weights = lasso_logistic(z, y, penalty)
    return bias, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-4]


def compiled(model: Model) -> Column:
    """The score as a Spark column over the statistics."""
    bias, rules = model
    total = F.lit(bias)
    for weight, rule in rules:
        condition = F.lit(True)
        for j, above, bound in rule:
            stat = F.col(STATS[j])
            condition = condition & ((stat > F.lit(bound)) if above else (stat <= F.lit(bound)))
        total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def is_held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # so many rows at most: a bounded sample, by its documented parameter
    sample = documents.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, y double")
    held = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = with_statistics(held).join(F.broadcast(sample), "doc_id").select("doc_id", "y", *STATS).orderBy("doc_id", *STATS).limit(2 * most).collect()
    table = np.array([r[1:] for r in rows], float).reshape(-1, 1 + len(STATS))
    return fit(table[:, 1:], table[:, 0])


def score(documents: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's score and prediction."""
    scored = with_statistics(documents).select("doc_id", is_held_out().alias("held_out"), compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
