"""Span algebra: a span is struct<start, end> of inclusive token positions.

Lists of spans meet by halving in sorted ends and by running extremes, so that work follows the spans that go in and come out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import count_below, indices, let, let_all, running_max

SPANS = "array<struct<start:int,end:int>>"
# Lists up to this length are looked through one by one, which is quicker than halving.
FEW = 64


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def spans_of(positions: Column) -> Column:
    return F.transform(positions, lambda p: span(p, p))


def to(a: Column, b: Column) -> Column:
    return span(F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"]))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (a["end"] >= b["start"])


def surrounds(a: Column, b: Column) -> Column:
    return (a["start"] < b["start"]) & (a["end"] > b["end"])


def is_within(a: Column, b: Column) -> Column:
    return (a["start"] >= b["start"]) & (a["end"] <= b["end"])


def is_before(a: Column, b: Column) -> Column:
    return a["end"] < b["start"]


def is_after(a: Column, b: Column) -> Column:
    return a["start"] > b["end"]


def touches(a: Column, b: Column) -> Column:
    return (a["start"] == b["end"] + 1) | (a["end"] == b["start"] - 1)


def distance_to(a: Column, b: Column) -> Column:
    return F.when(overlaps(a, b), 0).when(a["end"] < b["start"], b["start"] - a["end"]).otherwise(a["start"] - b["end"])


def tidy(spans: Column) -> Column:
    return let(F.sort_array(spans), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def _by_start(b: Column, body) -> Column:
    """Spans by start, with ``starts``, ``reach`` (the largest end so far) and ``nearest`` (the smallest end from here on)."""
    def ends(s: Column) -> dict[str, Column]:
        # Where ends rise with starts, each end is itself the largest so far and the smallest from there on.
        rising = F.sort_array(s["end"]) == s["end"]
        backwards = F.reverse(F.transform(s["end"], lambda e: -e))
        return {"b": s, "starts": s["start"], "reach": F.when(rising, s["end"]).otherwise(running_max(s["end"])),
                "nearest": F.when(rising, s["end"]).otherwise(F.transform(F.reverse(running_max(backwards)), lambda e: -e))}

    return let(F.sort_array(b), lambda s: let_all(ends(s), body))


def near(a: Column, b: Column, slop: int, ordered: bool = True, mindist: int = 1) -> Column:
    """Merged spans of the pairs whose distance is between ``mindist`` and ``slop``."""
    apart = max(mindist, 1)

    def cut(spans: Column, first: Column, stop: Column) -> Column:
        return F.slice(spans, first + 1, F.greatest(stop - first, F.lit(0)))

    def pairs(a: Column, v: Column, w: Column) -> Column:
        def partners(x: Column) -> Column:
            found = [cut(v["b"], count_below(v["starts"], x["end"] + apart), count_below(v["starts"], x["end"] + slop + 1))]
            if mindist <= 0 <= slop:
                found.append(cut(v["b"], count_below(v["starts"], x["start"]), count_below(v["starts"], x["end"] + 1)))
                if not ordered:
                    earlier = cut(v["b"], count_below(v["reach"], x["start"]), count_below(v["starts"], x["start"]))
                    found.append(F.filter(earlier, lambda y: y["end"] >= x["start"]))
            out = [F.transform(f, lambda y: to(x, y)) for f in found]
            if not ordered:
                before = cut(w["spans"], count_below(w["ends"], x["start"] - slop), count_below(w["ends"], x["start"] - apart + 1))
                out.append(F.transform(before, lambda y: to(x, y)))
            return F.concat(*out)

        return F.flatten(F.transform(a, partners))

    def with_ends(v: Column) -> Column:
        if ordered:
            return pairs(a, v, v)
        turned = F.sort_array(F.transform(v["b"], lambda y: F.struct(y["end"].alias("end"), y["start"].alias("start"))))
        return let(turned, lambda t: let_all({"spans": t, "ends": F.transform(t, lambda y: y["end"])}, lambda w: pairs(a, v, w)))

    if mindist <= 0:
        return tidy(_by_start(b, with_ends))

    # The outermost ends sort out most lists, and decide for lists of one span.
    def within(first: Column, second: Column) -> Column:
        return (F.array_max(second["start"]) >= F.array_min(first["end"]) + apart) & (F.array_min(second["start"]) <= F.array_max(first["end"]) + slop)

    def close(x: Column, y: Column) -> Column:
        after = (y["start"] >= x["end"] + apart) & (y["start"] <= x["end"] + slop)
        return after if ordered else after | ((y["end"] >= x["start"] - slop) & (y["end"] <= x["start"] - apart))

    def each(x: Column) -> Column:
        return F.transform(F.filter(b, lambda y: close(x, y)), lambda y: to(x, y))

    meet = within(a, b) if ordered else within(a, b) | within(b, a)
    single = (F.size(a) == 1) & (F.size(b) == 1)
    few = F.size(b) <= FEW
    return F.when(~meet, F.array().cast(SPANS)).when(single, F.array(to(F.get(a, F.lit(0)), F.get(b, F.lit(0))))) \
        .when(few, tidy(F.flatten(F.transform(a, each)))).otherwise(tidy(_by_start(b, with_ends)))


def merge(spans: Column) -> Column:
    """Merge overlapping or touching spans."""
    def joined(v: Column, opens: Column) -> Column:
        closes = F.filter(v["reach"], lambda e, i: F.coalesce(F.get(v["starts"], i + 1) > e + 1, F.lit(True)))
        return F.when(F.size(opens) == F.size(v["starts"]), v["b"]).otherwise(F.zip_with(opens, closes, span))

    def build(v: Column) -> Column:
        return let(F.filter(v["starts"], lambda x, i: (i == 0) | (x > F.get(v["reach"], i - 1) + 1)), lambda opens: joined(v, opens))

    # Most lists hold one span.
    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(_by_start(s, build)))


def free_of(a: Column, b: Column) -> Column:
    """The a-spans that overlap no b-span."""
    def free(v: Column, x: Column) -> Column:
        return let(count_below(v["starts"], x["end"] + 1), lambda n: (n == 0) | (F.get(v["reach"], n - 1) < x["start"]))

    few = F.filter(a, lambda x: ~F.exists(b, lambda y: overlaps(x, y)))
    return F.when(F.size(b) <= FEW, few).otherwise(_by_start(b, lambda v: F.filter(a, lambda x: free(v, x))))


def around(a: Column, b: Column) -> Column:
    """The a-spans that hold a b-span."""
    few = F.filter(a, lambda x: F.exists(b, lambda y: is_within(y, x)))
    return F.when(F.size(b) <= FEW, few).otherwise(_by_start(b, lambda v: F.filter(a, lambda x: F.get(v["nearest"], count_below(v["starts"], x["start"])) <= x["end"])))
