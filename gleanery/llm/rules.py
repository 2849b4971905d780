"""Quality rules that vote or abstain; expectation-maximisation turns the votes into a probability of quality."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, settle
from .textstats import with_counts

GOOD, BAD, NONE = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Votes BAD outside ``[low, high]``, GOOD inside ``[good_low, good_high]``, else abstains; abstains without words and where
    the denominator is under ``least``."""

    name: str
    over: str
    under: str
    low: float = -math.inf
    high: float = math.inf
    good_low: float = -math.inf
    good_high: float = math.inf
    least: int = 0

    def vote(self) -> Column:
        value = F.col(self.over) / F.greatest(F.col(self.under), F.lit(1))
        bad = (value < self.low) | (value > self.high)
        good = (value >= self.good_low) & (value <= self.good_high)
        return F.when((F.col("n_words") == 0) | (F.col(self.under) < self.least), NONE).when(bad, BAD).when(good, GOOD).otherwise(NONE)


RULES = (
    Rule("symbols", "n_symbols", "n_words", high=0.1, good_high=0.01),
    Rule("bangs", "n_bangs", "n_words", high=0.1, good_high=0.05),
    Rule("capitals", "n_upper", "n_chars", high=0.3, good_high=0.1),
    Rule("same_lines", "n_dup_lines", "n_lines", high=0.5, good_high=0.1),
    Rule("repeats", "n_repeat_words", "n_words", high=0.3, good_high=0.1),
    Rule("word_length", "word_chars", "n_words", low=2.5, high=11, good_low=3, good_high=9),
    Rule("variety", "n_distinct_words", "n_words", low=0.15, good_low=0.3),
    Rule("endings", "n_ended_lines", "n_lines", low=0.1, good_low=0.5, least=3),
)


def base_failed() -> Column:
    """The contract's hard failure: under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(patterns: np.ndarray, times: np.ndarray, rounds: int = 100, prior: float = 1.0, false_alarm: float = 1e-3) -> dict:
    """Expectation-maximisation over distinct vote patterns (one row each) with their counts.

    Each rule has, for good and for bad documents, its own chance of saying BAD when it votes; abstaining says nothing.
    ``prior`` pseudo-counts keep chances off 0 and 1. It starts from "some rule says BAD", and a rule says BAD of a good
    document with a chance of at most ``false_alarm``, so that the classes keep their meaning (else a common kind of junk that
    trips a single rule would count as good); where the votes hold no BAD, every document stays good. Returns log-odds: ``bias``, and ``good`` and ``bad``
    for each rule's vote.
    """
    k = patterns.shape[1]
    total = times.sum()
    is_bad, is_good = patterns == BAD, patterns == GOOD
    p_bad = np.where(is_bad.any(axis=1), 0.95, 0.02)
    for _ in range(rounds):
        share = (np.dot(times, p_bad) + prior) / (total + 2 * prior)
        says = []
        for weight, lean in ((times * p_bad, 2.0), (times * (1 - p_bad), 0.02)):
            says.append((weight @ is_bad + prior * lean) / (weight @ (is_bad | is_good) + prior * (lean + 1)))
        # A rule that says BAD more often of good documents than of bad ones tells nothing.
        in_good = np.minimum(says[1], false_alarm)
        in_bad = np.maximum(says[0], in_good)
        bias = math.log(1 - share) - math.log(share)
        w_bad, w_good = np.log(in_good) - np.log(in_bad), np.log1p(-in_good) - np.log1p(-in_bad)
        odds = bias + is_bad @ w_bad + is_good @ w_good
        new = 1 / (1 + np.exp(np.clip(odds, -500, 500)))
        moved, p_bad = np.abs(new - p_bad).max(initial=0), new
        if moved < 1e-9:
            break
    return {"bias": bias if total else 0.0, "bad": w_bad.tolist() if total else [0.0] * k, "good": w_good.tolist() if total else [0.0] * k}


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, keep_from: float = 0.5) -> DataFrame:
    """(key, counts..., vote_<rule>..., p_quality, base_failed, kept) for each row.

    The text is read once; its counts are settled and counted by vote pattern. Only the pattern counts (at most
    3 ** rules rows, whatever the input) reach the driver. Null and empty texts have no words: they fail the base and no
    rule votes. Equal texts get equal verdicts; repeated rows are judged each; an empty table gives an empty result.
    """
    stats = with_counts(df, key, text)
    votes = settle(stats.select("*", *[r.vote().alias(f"vote_{r.name}") for r in rules]))
    names = [f"vote_{r.name}" for r in rules]
    seen = votes.groupBy(*names).count().collect()
    patterns = np.array([[row[n] for n in names] for row in seen], int).reshape(len(seen), len(rules))
    model = fit(patterns, np.array([row["count"] for row in seen], float))
    odds = F.lit(model["bias"])
    for i, n in enumerate(names):
        odds = odds + F.when(F.col(n) == BAD, model["bad"][i]).when(F.col(n) == GOOD, model["good"][i]).otherwise(0.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    failed = base_failed()
    return votes.select(F.col(quoted(key)), *[c for c in votes.columns if c != key], F.round(p, 9).alias("p_quality"),
                        failed.alias("base_failed"), (~failed & (p >= keep_from)).alias("kept"))
