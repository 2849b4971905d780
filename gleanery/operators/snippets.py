"""Snippets: fragments of a document around matched tokens, scored, ranked and formatted.

Input rows carry the text, its tokens with character ranges and the wanted terms, e.g. ``[query_id, doc_id, text, terms]``.
Everything happens inside the row. A fragment is struct<start, end, matches array<struct<term, start, end, boost>>>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import indices, let, let_all, running_total, runs
from ..functions.tokens import DEFAULT_PATTERN, Filter, an_simple

MATCH = "struct<term:string,start:int,end:int,boost:double>"
FRAGMENTS = f"array<struct<start:int,end:int,matches:array<{MATCH}>>>"


def marked_tokens(text: Column, terms: Column, analyzer: Filter | None = None) -> Column:
    """Tokens with ``hit`` set where the term is wanted."""
    tokens = (analyzer or an_simple(chars=True))(text)
    return F.transform(tokens, lambda t: F.struct(
        t["term"].alias("term"), t["startchar"].alias("start"), t["endchar"].alias("end"), F.array_contains(terms, t["term"]).alias("hit")))


def _match(t: Column) -> Column:
    return F.struct(t["term"].alias("term"), t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), F.lit(1.0).alias("boost"))


def _matches(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: t["hit"]), _match)


def _fragment(start: Column, end: Column, matches: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), matches.cast(f"array<{MATCH}>").alias("matches"))


def snippet_whole(text: Column, terms: Column) -> Column:
    return F.array(_fragment(F.lit(0), F.length(text), _matches(marked_tokens(text, terms))))


def snippet_sentence(text: Column, terms: Column, maxchars: int = 200, enders: str = ".!?") -> Column:
    """Sentences that hold a match. A sentence ends after a token followed by one ender but not by two."""
    quoted = "".join("\\" + c for c in enders)
    gaps = F.split(text, DEFAULT_PATTERN, -1)

    def numbered(v: Column) -> Column:
        ends = F.transform(v["tokens"], lambda t, i: F.get(v["gaps"], i + 1).rlike(f"^[{quoted}](?![{quoted}])").cast("int"))
        return let_all({"ends": ends, "before": running_total(ends)}, lambda e: F.transform(v["tokens"], lambda t, i: F.struct(
            e["before"][i].alias("no"), (e["ends"][i] == 1).alias("closed"), t["term"].alias("term"), t["start"].alias("start"),
            t["end"].alias("end"), t["hit"].alias("hit"))))

    def sentence(g: Column) -> Column:
        width = F.aggregate(g, F.lit(0), lambda acc, t: acc + t["end"] - t["start"])
        last = F.element_at(g, -1)
        keep = F.exists(g, lambda t: t["hit"]) & (~last["closed"] | (width <= maxchars))
        return F.when(keep, _fragment(g[0]["start"], last["end"], _matches(g)))

    rows = let_all({"tokens": marked_tokens(text, terms), "gaps": gaps}, numbered)
    return F.filter(runs(rows, "no", sentence), lambda f: f.isNotNull())


def _reach(widths: Column, at: Column, chars: Column | int, most: int) -> Column:
    """The first token from ``at`` on where the widths of the tokens from ``at`` add up to ``chars``; the number of tokens if they
    never do. ``widths[i]`` is the width of the tokens before i; every token has a character, so ``most`` of them are enough."""
    ahead = F.slice(widths, at + 2, F.lit(most + 1))
    short = F.size(F.filter(ahead, lambda w: w - F.get(widths, at) < chars))
    return F.when(short < F.size(ahead), at + short).otherwise(F.size(widths) - 1)


def snippet_context(text: Column, terms: Column, maxchars: int = 200, surround: int = 20) -> Column:
    """Matches with ``surround`` characters of tokens on both sides, merged where they touch, cut where they pass ``maxchars``.

    Every match has two bounds on the cumulative token widths: how far its own surroundings reach, and where a fragment that
    opens with it is too long. A fragment opens with the first match beyond the last fragment's end; its left edge is the
    farthest token within ``surround`` characters of the token before the match, and not inside the last fragment. Where there
    is none, the first match reaches twice as far to the right. Surroundings that end exactly with a token also use up the next one. The widths of all tokens from the opening match on count as
    length; the token that goes beyond still belongs to the fragment, but is no match of it.
    """
    none = F.array().cast("array<int>")
    shape = "array<struct<first:int,reach:int,skip:int,cut:int,hits:array<int>>>"

    def bounds(v: Column) -> Column:
        tokens, widths = v["tokens"], v["widths"]

        def one(h: Column) -> Column:
            near = F.size(F.filter(F.slice(tokens, F.greatest(h - surround, F.lit(0)) + 1, F.least(h, F.lit(surround))),
                                   lambda t: tokens[h - 1]["end"] - t["start"] <= surround))
            def right(chars: int) -> Column:
                return let(_reach(widths, h, F.lit(chars), chars), lambda r: F.struct(r.alias("reach"), F.coalesce((F.get(widths, r + 1) - widths[h] == chars).cast("int"), F.lit(0)).alias("skip")))

            return F.struct(h.alias("at"), (h - F.when(h > 0, near).otherwise(0)).alias("left"), right(surround).alias("plain"), right(2 * surround).alias("wide"),
                            _reach(widths, h, F.lit(maxchars + 1), maxchars + 1).alias("cut"))

        hits = F.filter(indices(F.size(tokens)), lambda i: tokens[i]["hit"])
        return F.transform(hits, one)

    def gather(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        over = F.coalesce(F.least(last["reach"], last["cut"]), F.lit(-1))
        free = over + 1 + F.when(last["reach"] < last["cut"], last["skip"]).otherwise(0)
        left = F.least(F.greatest(b["left"], F.coalesce(free, F.lit(0))), b["at"])
        side = F.when(left < b["at"], b["plain"]).otherwise(b["wide"])
        opened = F.struct(left.alias("first"), side["reach"].alias("reach"), side["skip"].alias("skip"), b["cut"].alias("cut"),
                          F.when(b["cut"] > b["at"], F.array(b["at"])).otherwise(none).alias("hits"))
        longer = F.struct(last["first"].alias("first"), b["plain"]["reach"].alias("reach"), b["plain"]["skip"].alias("skip"), last["cut"].alias("cut"),
                          F.concat(last["hits"], F.array(b["at"])).alias("hits"))
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(b["at"] > over, F.concat(acc, F.array(opened))).when(b["at"] < last["cut"], F.concat(before, F.array(longer))).otherwise(acc).cast(shape)

    def fragments(v: Column) -> Column:
        tokens = v["tokens"]
        found = F.aggregate(v["bounds"], F.array().cast(shape), gather)
        return F.transform(F.filter(found, lambda f: F.size(f["hits"]) > 0), lambda f: _fragment(
            tokens[f["first"]]["start"], tokens[F.least(f["reach"], f["cut"], F.size(tokens) - 1)]["end"], F.transform(f["hits"], lambda h: _match(tokens[h]))))

    def measured(tokens: Column) -> Column:
        widths = F.transform(tokens, lambda t: (t["end"] - t["start"]).cast("int"))
        before = let(widths, lambda w: running_total(F.concat(w, F.array(F.lit(0)))))
        return let_all({"tokens": tokens, "widths": before}, lambda v: let_all({"tokens": v["tokens"], "bounds": bounds(v)}, fragments))

    return let(marked_tokens(text, terms), measured)


def snippet_pinpoint(text: Column, terms: Column, maxchars: int = 200, surround: int = 20, autotrim: bool = False) -> Column:
    """One fragment per match, taking in the following matches up to the first that lies more than ``surround`` behind the one
    before it, ends more than ``maxchars`` after the fragment's first match, or finds ``maxchars`` of matches in it already."""
    def fragments(v: Column) -> Column:
        ms, widths = v["ms"], v["widths"]

        def one(m: Column, i: Column) -> Column:
            # A match has a character at least, so that no more than maxchars of them can fit.
            ahead = F.slice(indices(F.size(ms)), i + 2, F.lit(maxchars))
            beyond = F.filter(ahead, lambda k: (ms[k]["end"] - ms[k - 1]["end"] > surround) | (ms[k]["end"] - m["start"] > maxchars) | (widths[k] - widths[i] >= maxchars))
            n = F.coalesce(F.array_min(beyond), i + 1 + F.size(ahead)) - i
            return _fragment(F.greatest(F.lit(0), m["start"] - surround), F.least(F.length(text), ms[i + n - 1]["end"] + surround), F.slice(ms, i + 1, n))

        return F.transform(ms, one)

    def measured(ms: Column) -> Column:
        return let_all({"ms": ms, "widths": running_total(F.transform(ms, lambda m: m["end"] - m["start"]))}, fragments)

    out = let(_matches(marked_tokens(text, terms)), measured)
    return F.transform(out, lambda f: _trim(text, f)) if autotrim else out


def _trim(text: Column, f: Column) -> Column:
    """Without the words that the ends cut through, as far as no match is lost."""
    body = F.substring(text, f["start"] + 1, f["end"] - f["start"])
    head, tail = (F.length(F.regexp_extract(body, p, 0)) for p in ("^[^ ]* ", " [^ ]*$"))
    return _fragment(F.least(f["start"] + head, f["matches"][0]["start"]), F.greatest(f["end"] - tail, F.element_at(f["matches"], -1)["end"]), f["matches"])


# ---- rank and format ------------------------------------------------------------------------------------------------

def fragment_score(f: Column) -> Column:
    """Summed boosts times 100 per distinct term."""
    boosts = F.aggregate(f["matches"], F.lit(0.0), lambda acc, m: acc + m["boost"])
    return boosts * 100 * F.size(F.array_distinct(F.transform(f["matches"], lambda m: m["term"])))


ORDERS: dict[str, Callable[[Column], Column]] = {
    "first": lambda f: f["start"].cast("double"), "score": lambda f: -f["score"],
    "longer": lambda f: -(f["end"] - f["start"]).cast("double"), "shorter": lambda f: (f["end"] - f["start"]).cast("double"),
}


def snippet_rank(fragments: Column, top: int = 3, minscore: float = 1.0, order: str = "first") -> Column:
    """The ``top`` best fragments scoring above ``minscore``, put in ``order``."""
    scored = F.transform(fragments, lambda f: F.struct((-fragment_score(f)).alias("k"), f["start"].alias("start"), f["end"].alias("end"),
                                                       fragment_score(f).alias("score"), f["matches"].alias("matches")))
    best = F.slice(F.sort_array(F.filter(scored, lambda f: f["score"] > minscore)), F.lit(1), F.lit(top))
    keyed = F.transform(best, lambda f: F.struct(ORDERS[order](f).alias("k"), f["start"].alias("start"), f["end"].alias("end"),
                                                 f["score"].alias("score"), f["matches"].alias("matches")))
    return F.transform(F.sort_array(keyed), lambda f: F.struct(f["start"], f["end"], f["score"], f["matches"]))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def snippet_format(text: Column, fragments: Column, style: str = "html", tag: str = "strong", between: str = "...",
                   classname: str = "match", termclass: str = "term", classes: int = 5) -> Column:
    """Fragments as one string. ``html`` wraps matches and numbers each term's class, ``upper`` shouts, ``plain`` copies."""
    plain = escape_html if style == "html" else (lambda s: s)
    seen = F.array_distinct(F.flatten(F.transform(fragments, lambda f: F.transform(f["matches"], lambda m: m["term"]))))

    def word(m: Column, body: Column, order: Column) -> Column:
        if style == "upper":
            return F.upper(body)
        if style != "html":
            return body
        number = F.pmod(F.array_position(order, m["term"]).cast("int") - 1, F.lit(classes)).cast("string")
        return F.concat(F.lit(f'<{tag} class="{classname} {termclass}'), number, F.lit('">'), plain(body), F.lit(f"</{tag}>"))

    def one(f: Column, order: Column) -> Column:
        def build(body: Column) -> Column:
            cut = lambda a, b: F.substring(body, a - f["start"] + 1, b - a)
            start = F.struct(f["start"].alias("at"), F.lit("").alias("out"))

            def step(acc: Column, m: Column) -> Column:
                clash = m["start"] < acc["at"]
                grown = F.concat(acc["out"], plain(cut(acc["at"], m["start"])), word(m, cut(m["start"], m["end"]), order))
                return F.struct(F.when(clash, acc["at"]).otherwise(m["end"]).alias("at"), F.when(clash, acc["out"]).otherwise(grown).alias("out"))

            return F.aggregate(f["matches"], start, step, lambda acc: F.concat(acc["out"], plain(cut(acc["at"], f["end"]))))

        return let(F.substring(text, f["start"] + 1, f["end"] - f["start"]), build)

    return let(seen, lambda order: F.array_join(F.transform(fragments, lambda f: one(f, order)), between))


def snippets(rows: DataFrame, fragmenter: Callable[[Column, Column], Column] = snippet_sentence, top: int = 3, order: str = "first") -> DataFrame:
    """Rows (text, terms, ...) with their ranked fragments."""
    return rows.withColumn("fragments", snippet_rank(fragmenter(F.col("text"), F.col("terms")), top, 1.0, order))
