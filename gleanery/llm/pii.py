"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides on added spans.

Only column functions touch the text. The driver sees one row for each pattern of votes, a number fixed by the labelers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.arrays import let, let_all, running_total

from .common import quoted, settle

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# The contract's expressions, written so that a long run is scanned once: a match can start only at the head of its run (or
# where the last match ended), and possessive repeats never give back. The matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Only chains of 12 to 19 digits; a chain's start has no digit, nor digit and separator, before it, and none follow its end.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SECRET = r"(?i)(?<![a-z0-9_])(?:api_?key|access_?key|token|secret|password|passwd)\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9+/_=.-]{8,}+"

# Issuer prefixes of payment cards, frequent country codes, endings of addresses, reserved networks.
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|65|62)"
COUNTRY_CODE = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
MAIL_ENDING = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|ca|ch|at|it|nl)$"
RESERVED_IP = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\."
CUES = {
    "email": r"(?i)mail|contact|write|schreib|escrib|écri", "ip": r"(?i)\bip\b|host|server|address|login",
    "card": r"(?i)card|visa|credit|karte|tarjeta|carte", "phone": r"(?i)phone|tel\b|tel\.|call|mobile|fax|ruf|llam",
    "secret": r"(?i)auth|bearer|login|credential|export|config",
}
AGAINST = r"(?i)order|invoice|isbn|version|serial|article|figure|page|\bno\.|\bnr\.|#$"
LABELERS = ("shape", "gazetteer", "context", "variety")
CONTEXT_CHARS = 40


def _found(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start,end,match>>: leftmost non-overlapping matches by code points, ends exclusive; empty where ``gate`` fails.

    Matches and the gaps between them add up to the text, so their lengths give every place.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(v: Column) -> Column:
        # Gap and match lengths in turn: what comes before each, added up in blocks.
        lengths = F.flatten(F.transform(v["matches"], lambda m, i: F.array(F.length(F.get(v["gaps"], i)), F.length(m))))
        return let(running_total(lengths), lambda before: F.transform(v["matches"], lambda m, i: F.struct(
            before[2 * i + 1].alias("start"), (before[2 * i + 1] + F.length(m)).alias("end"), m.alias("match"))))

    return F.when(gate & text.rlike(pattern), let_all({"gaps": gaps, "matches": matches}, placed)).otherwise(none)


def luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(match))
    return F.length(_digits(match)).between(9, 15)


def candidates(df: DataFrame, key: str, text: str, carry: Column | None = None) -> DataFrame:
    """(_key, base, more), and ``_carry`` where it is given: valid base spans, and spans that only the labelers can decide on, which may overlap base spans.
    Only a local number inside a base phone span is no candidate: it is the same number, and covered under the same kind.

    A span is (start, kind_no, end, kind, base, votes...). Everything happens in the text's own row.
    """
    t = F.col("_x")
    digit, at = t.rlike("[0-9]"), F.contains(t, F.lit("@"))
    kept = [] if carry is None else [carry.alias("_carry")]
    rows = df.select(F.col(quoted(key)).alias("_key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_x"), *kept)
    rows = rows.select(
        "*", _found(t, EMAIL, at).alias("email"), _found(t, IP, digit).alias("ip"), _found(t, CARD, digit).alias("card"),
        _found(t, PHONE, digit & F.contains(t, F.lit("+"))).alias("phone"), _found(t, LOCAL_PHONE, digit).alias("local"),
        _found(t, SECRET, F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))).alias("secret"))

    def spans(column: str, kind: str, base: bool) -> Column:
        def make(x):
            m = x["match"]
            left = F.substring(t, F.greatest(x["start"] - (CONTEXT_CHARS - 1), F.lit(1)), F.least(x["start"], F.lit(CONTEXT_CHARS)))
            return F.struct(x["start"], F.lit(KINDS.index(kind)).alias("kind_no"), x["end"], F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                            *[v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(kind, m, left, base), strict=True)])

        kept = F.col(column) if kind == "secret" else F.filter(column, lambda x: _valid(kind, x["match"]) if base else ~_valid("card", x["match"]) if column == "card" else F.lit(True))
        return F.transform(kept, make)

    held = [c for c in rows.columns if c in ("_key", "_carry")]
    rows = rows.select(*held, F.array_sort(F.concat(*[spans(k, k, True) for k in BASE])).alias("base"),
                       F.concat(spans("card", "card", False), spans("local", "phone", False), spans("secret", "secret", False)).alias("more"))
    told = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["kind_no"] == m["kind_no"]) & (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return rows.select(*held, "base", told.alias("more"))


def _votes(kind: str, match: Column, left: Column, base: bool) -> tuple[Column, ...]:
    """One vote of each labeler: 1 personal, -1 not, 0 abstains."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    if kind == "secret":
        value = F.regexp_extract(match, r"[=:]\x20*[\"']?(.*)$", 1)
        shape = F.when((F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]"), yes).otherwise(no)
        gazetteer = yes
        variety = F.size(F.array_distinct(F.split(value, "")))
        varied = F.when(variety >= 8, yes).when(variety <= 3, no).otherwise(none)
    else:
        shape = yes if base else no if kind == "card" else none
        variety = F.size(F.array_distinct(F.split(_digits(match), "")))
        varied = none if kind in ("email", "ip") else F.when(variety >= 4, yes).when(variety <= 2, no).otherwise(none)
        gazetteer = {"email": F.when(match.rlike(MAIL_ENDING), yes).otherwise(none), "ip": F.when(match.rlike(RESERVED_IP), no).otherwise(none),
                     "card": F.when(match.rlike(CARD_PREFIX), yes).otherwise(no),
                     "phone": F.when(match.rlike(COUNTRY_CODE), yes).otherwise(none)}[kind]
    return shape, gazetteer, F.when(left.rlike(AGAINST), no).when(left.rlike(CUES[kind]), yes).otherwise(none), varied


def _design(patterns: list[tuple]) -> np.ndarray:
    """One column for each (labeler, vote) and for each kind, after a constant one."""
    rows = [[1.0, *[float(v == w) for v in p[1:] for w in (1, -1)], *[float(p[0] == k) for k in KINDS]] for p in patterns]
    return np.array(rows).reshape(len(rows), 1 + 2 * len(LABELERS) + len(KINDS))


def train(patterns: list[tuple], base: np.ndarray, times: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the span classifier from distinct (kind, votes...) patterns.

    Expectation-maximisation estimates, for true and for false spans, how often each labeler votes each way, starting from the
    labelers' majority; base spans count as true throughout. A logistic regression (Newton steps, ridge of 1) is then fitted to
    the resulting probabilities.
    """
    x = _design(patterns)
    if not len(patterns):
        return np.zeros(x.shape[1])
    votes = np.array([p[1:] for p in patterns])
    p_true = np.where(base, 1.0, 1 / (1 + np.exp(-1.5 * votes.sum(axis=1))))
    for _ in range(rounds):
        odds = np.log((times @ p_true + 1) / (times @ (1 - p_true) + 1))
        total = np.full(len(patterns), odds)
        for j in range(votes.shape[1]):
            for value in (1, -1):
                hit, cast = votes[:, j] == value, votes[:, j] != 0
                true = ((times * p_true) @ hit + (2 if value == 1 else 1)) / ((times * p_true) @ cast + 3)
                false = ((times * (1 - p_true)) @ hit + (1 if value == 1 else 2)) / ((times * (1 - p_true)) @ cast + 3)
                total += hit * np.log(true / false)
        p_true = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(total, -500, 500))))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (times * (p_true - p)) - w)
    return w


def _probability(span: Column, w: np.ndarray) -> Column:
    odds = F.lit(float(w[0]))
    at = 1
    for name in LABELERS:
        odds = odds + F.when(span[name] == 1, float(w[at])).when(span[name] == -1, float(w[at + 1])).otherwise(0.0)
        at += 2
    for i in range(len(KINDS)):
        odds = odds + F.when(span["kind_no"] == i, float(w[at + i])).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def weights(found: DataFrame) -> np.ndarray:
    """The classifier trained on all candidates; the driver sees their vote patterns only."""
    one = F.explode(F.concat("base", "more"))
    seen = found.select(one.alias("s")).select("s.*").groupBy("kind", *LABELERS, "base").count().collect()
    return train([(r["kind"], *[r[n] for n in LABELERS]) for r in seen], np.array([r["base"] for r in seen], bool), np.array([r["count"] for r in seen], float))


def _decided(found: DataFrame, w: np.ndarray, add_from: float) -> tuple[Column, Column]:
    """The base spans and all spans, with their probabilities."""
    scored = lambda c: F.transform(c, lambda s: s.withField("p", F.round(_probability(s, w), 6)))
    base, more = scored("base"), scored("more")
    return base.alias("base"), F.array_sort(F.concat(base, F.filter(more, lambda s: s["p"] >= add_from))).alias("spans")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", add_from: float = 0.8) -> DataFrame:
    """(key, base, spans) for each row: arrays of (start, kind_no, end, kind, base, votes..., p), by start and kind.

    ``base`` holds the base spans, ``spans`` those and every added span whose probability is at least ``add_from``. The text is
    read once; only its candidates are settled. Null and empty texts have no spans; repeated rows are searched each; places
    count code points, ends are exclusive; an empty table gives an empty result.
    """
    found = settle(candidates(df, key, text))
    return found.select(F.col("_key").alias(key), *_decided(found, weights(found), add_from))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", add_from: float = 0.8) -> DataFrame:
    """``df`` with every span of ``find`` replaced by its kind in angle brackets; null texts stay null.

    The candidates are made twice, once to train and once in the row that is rewritten, so that no text is moved.
    """
    w = weights(candidates(df, key, text))
    found = candidates(df, key, text, F.struct(*[F.col(quoted(c)) for c in df.columns]))
    rows = found.select("_carry", _decided(found, w, add_from)[1])
    old = F.col("_carry")[text]
    return rows.select(*[(redacted(old, F.col("spans")) if c == text else F.col("_carry")[c]).alias(c) for c in df.columns])


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; a span that starts inside an earlier one is covered by it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        end = F.greatest(acc["at"], s["end"])
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(end.alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(end.alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), "")))
