"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Cyclic boosting adds shallow trees over one feature's bins after the other, and then over
chosen pairs of features; summed up, the trees are lookup tables, so that scoring a document is a handful of additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, quoted, settle, steps, strings
from .textstats import COUNTS, counts, with_counts

# Shares that say something at any length; zero denominators count as 1.
RATIOS = {
    "log_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "bangs": ("n_bangs", "n_words"), "bars": ("n_bars", "n_words"), "capitals": ("n_upper", "n_chars"), "digits": ("n_digits", "n_chars"),
    "stops": ("n_stops", "n_words"), "ascii_lower": ("n_lower", "n_chars"), "same_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "variety": ("n_distinct_words", "n_words"), "short_words": ("n_short_words", "n_words"),
    "endings": ("n_ended_lines", "n_lines"), "line_length": ("n_words", "n_lines"),
}
NAMES = list(RATIOS)
# Labelled rows that a model is fitted on at most, taken in an order set by a hash of the key.
MAX_TRAIN_ROWS = 60_000


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    out = []
    for over, under in RATIOS.values():
        x = columns[over].astype(float)
        out.append(np.log1p(x) if under is None else x / np.maximum(columns[under], 1))
    return np.stack(out, axis=1) if out else np.empty((0, 0))


@dataclass
class Model:
    edges: list[np.ndarray]            # of each feature: upper bounds of the bins but the last
    base: float
    single: list[np.ndarray]           # of each feature: a value for each bin
    pairs: list[tuple[int, int, np.ndarray]]  # features and their table of values

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for i, table in enumerate(self.single):
            out += table[bins[:, i]]
        for i, j, table in self.pairs:
            out += table[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(self.bins(x)), -500, 500)))


def _leaf(g, h):
    return g / (h + 1.0)


def _stump_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins, grown best split first; its value for each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            won = gain(a, cut) + gain(cut, b) - gain(a, b)
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    value = np.zeros(len(g))
    for a, b in parts:
        value[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return value


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either axis of a table: its gain and its value for each cell."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = g.shape
    r, c = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    if n < 2 or m < 2:
        return 0.0, np.zeros(g.shape)
    box = lambda t: (t[r, c], t[r, -1:].reshape(-1, 1) - t[r, c], t[-1, c].reshape(1, -1) - t[r, c], t[-1, -1] - t[r, -1:].reshape(-1, 1) - t[-1, c].reshape(1, -1) + t[r, c])
    gs, hs = box(cg), box(ch)
    won = sum(a ** 2 / (b + 1.0) for a, b in zip(gs, hs, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    value = np.zeros(g.shape)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, m)), (slice(i + 1, n), slice(0, j + 1)), (slice(i + 1, n), slice(j + 1, m)))):
        value[rows, cols] = _leaf(gs[k][i, j], hs[k][i, j])
    return float(won[i, j]), value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, max_bins: int = 32, leaves: int = 3) -> Model:
    """Boost the main effects in turn, then the ``n_pairs`` pairs with the largest gain on what is left.

    With no rows the score is 0.5 everywhere; with one class only, the smoothed share of that class.
    """
    k = len(NAMES)
    if not len(y):
        return Model([np.empty(0)] * k, 0.0, [np.zeros(1)] * k, [])
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower")) for i in range(k)]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [])
    bins = model.bins(x)
    odds = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i in range(k):
            g, h = slopes()
            size = len(edges[i]) + 1
            step = rate * _stump_tree(np.bincount(bins[:, i], g, size), np.bincount(bins[:, i], h, size), leaves)
            model.single[i] += step
            odds += step[bins[:, i]]

    def grid(i, j, w):
        n, m = len(edges[i]) + 1, len(edges[j]) + 1
        return np.bincount(bins[:, i] * m + bins[:, j], w, n * m).reshape(n, m)

    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for won, i, j in gains[:n_pairs] if won > 1e-6]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            odds += step[bins[:, i], bins[:, j]]
    return model


def held_out(key: str, folds: int = 5) -> F.Column:
    return F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % folds == 0


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the counts of labelled rows outside the held-out fold, at most ``max_rows`` of them (the sample's documented bound)."""
    known = only(labels, **{key: key, "_y": label}).filter(F.col("_y").isNotNull() & ~held_out(key)).distinct()
    rows = stats.join(known, key)
    total = rows.count()
    place = F.pmod(F.xxhash64(F.lit(7), F.col(quoted(key))), F.lit(1 << 30))
    if total > max_rows:  # before the limit, so that no task brings more than its share
        rows = rows.filter(place < int((1 << 30) * max_rows / total))
    sample = rows.orderBy(place, F.col(quoted(key)), "_y", *COUNTS).limit(max_rows).select("_y", *COUNTS).toPandas()
    return fit(features({c: sample[c].to_numpy() for c in COUNTS}), sample["_y"].to_numpy().astype(float))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3,
             max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) for each row.

    One pass makes the counts of each whole text, which are settled; the model is fitted on a bounded sample of labelled
    rows and scores the counts in place. Only the text is an input of the score. Null and empty texts are scored as texts
    without words; equal texts get equal scores; a label of null is no label; a key labelled both ways trains both ways;
    without labels every score is 0.5.
    """
    stats = settle(with_counts(df, key, text))
    model = train(stats, labels, key, label, max_rows)
    names, kind = [f.name for f in stats.schema], stats.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in COUNTS}
            yield pa.RecordBatch.from_arrays([batch.column(names.index(key)), pa.array(np.round(model.score(features(columns)), 9))], names=[key, "score"])

    scored = stats.mapInArrow(run, f"{quoted(key)} {kind}, score double")
    return scored.select(F.col(quoted(key)), held_out(key).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3,
              max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``df`` with a score of ``cut`` or more, in all their columns. The text is counted a second time in its own row
    rather than moved to meet its score."""
    model = train(settle(with_counts(df, key, text)), labels, key, label, max_rows)
    at = df.columns.index(text)

    def run(batches):
        for batch in steps(batches, at):
            score = np.round(model.score(features(counts(strings(batch.column(at))))), 9)
            yield batch.filter(pa.array(score >= cut))

    return df.mapInArrow(run, df.schema)
