"""Tokenizers and token filters as column expressions.

A token list is ``array<struct<term, pos[, startchar, endchar, boost]>>`` on the document's row. Tokenizers build it
from a string column, filters map it to another list; nothing here shuffles.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import indices, let, let_all, running_total

Filter = Callable[[Column], Column]

# Word characters, the default token pattern and the 34 stop words.
WORD = r"[\p{L}\p{N}_]"
DEFAULT_PATTERN = rf"{WORD}++(?:\.{WORD}++)*+"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "not",
    "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your",
)
DELIMITERS = "-_'\"()!@#$%^&*[]{}<>|;:,./?`~=+"


def number(terms: Column, first: int = 0) -> Column:
    """Attach consecutive positions to an array of strings."""
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), (i + first).cast("int").alias("pos")))


# ---- tokenizers -----------------------------------------------------------------------------------------------

def tok_id(text: Column) -> Column:
    return F.when(text.isNotNull(), number(F.array(text), first=1))


def tok_regex(text: Column, pattern: str = DEFAULT_PATTERN, chars: bool = False) -> Column:
    """Every match of ``pattern``; ``chars=True`` adds the character range of each match."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    if not chars:
        return number(found)
    # split() gives the text between the matches, so a match starts after all earlier gaps and matches.
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def place(v: Column) -> Column:
        widths = F.transform(v["found"], lambda t, i: F.length(t) + F.get(v["gaps"], i + 1))
        return let(running_total(widths), lambda before: F.transform(v["found"], lambda t, i: F.struct(
            t.alias("term"), i.cast("int").alias("pos"),
            (before[i] + v["gaps"][0]).alias("startchar"),
            (before[i] + v["gaps"][0] + F.length(t)).alias("endchar"))))

    return let_all({"found": found, "gaps": gaps}, place)


def tok_regex_gaps(text: Column, pattern: str = r"\s+") -> Column:
    """The text between matches, empties dropped."""
    return number(F.filter(F.split(text, pattern, -1), lambda t: t != ""))


def tok_charset(text: Column, source: str, target: str, keep: str = "") -> Column:
    """Map each character of ``source`` to the one in ``target``; ``keep`` maps to itself; any other breaks a token."""
    known = "".join(dict.fromkeys(target + keep))
    quoted = "".join("\\" + c if c in r"\[]^-&" else c for c in known)
    mapped = F.translate(text, source, target)
    return number(F.filter(F.split(mapped, f"[^{quoted}]+", -1), lambda t: t != ""))


def tok_space(text: Column) -> Column:
    return number(F.regexp_extract_all(text, F.lit(r"([^ \t\r\n]+)"), F.lit(1)))


def tok_comma(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"([^,]+)"), F.lit(1))
    return number(F.filter(F.transform(runs, _strip), lambda t: t != ""))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _grams(text: Column, sizes: Column) -> Column:
    """Grams of each size at each start, ordered by start then size, as structs (term, start)."""
    def at(v: Column) -> Column:
        return F.flatten(F.transform(indices(F.size(v["chars"])), lambda i: F.transform(
            F.filter(v["sizes"], lambda n: i + n <= F.size(v["chars"])),
            lambda n: F.struct(F.array_join(F.slice(v["chars"], i + 1, n), "").alias("term"), i.alias("start")))))

    return let_all({"chars": F.filter(F.split(text, ""), lambda c: c != ""), "sizes": sizes}, at)


def tok_ngram(text: Column, minsize: int, maxsize: int | None = None, query: bool = False) -> Column:
    """Character n-grams, numbered by start. A query is cut only at size ``min(maxsize, length)``."""
    maxsize = maxsize or minsize
    if query:
        sizes = F.filter(F.array(F.least(F.lit(maxsize), F.length(text))), lambda n: n > 0)
    else:
        sizes = F.sequence(F.lit(minsize), F.lit(maxsize))
    return F.transform(_grams(text, sizes), lambda g: F.struct(g["term"].alias("term"), g["start"].alias("pos")))


def tok_path(text: Column, query: bool = False) -> Column:
    """``/a/b/c`` gives ``/a``, ``/a/b``, ``/a/b/c``; a query keeps the whole value."""
    if query:
        return number(F.array(text))
    parts = F.regexp_extract_all(text, F.lit("([^/]+)"), F.lit(1))
    gaps = F.split(text, "[^/]+", -1)

    def cut(v: Column) -> Column:
        widths = F.transform(v["parts"], lambda p, i: F.length(p) + F.length(v["gaps"][i]))
        return let(running_total(widths), lambda before: F.transform(
            v["parts"], lambda p, i: F.substring(v["text"], F.lit(1), before[i] + widths[i])))

    return number(let_all({"parts": parts, "gaps": gaps, "text": text}, cut))


# ---- filters --------------------------------------------------------------------------------------------------

def map_terms(fn: Filter) -> Filter:
    """A filter that rewrites each term and keeps the rest of the token."""
    return lambda tokens: F.transform(tokens, lambda t: t.withField("term", fn(t["term"])))


f_lower: Filter = map_terms(F.lower)
f_strip: Filter = map_terms(_strip)
f_reverse: Filter = map_terms(F.reverse)


def f_stop(stoplist: Sequence[str] | None = STOP_WORDS, minsize: int = 2, maxsize: int | None = None,
           renumber: bool = True) -> Filter:
    """Drop stop words and sizes out of bounds; survivors count on from the first survivor's own position."""
    def keep(t: Column) -> Column:
        ok = F.length(t["term"]) >= minsize
        if maxsize is not None:
            ok = ok & (F.length(t["term"]) <= maxsize)
        if stoplist:
            ok = ok & ~t["term"].isin(*stoplist)
        return ok

    def apply(tokens: Column) -> Column:
        kept = F.filter(tokens, keep)
        return _renumber(kept) if renumber else kept

    return apply


def _renumber(tokens: Column) -> Column:
    return let(tokens, lambda k: F.transform(k, lambda t, i: t.withField("pos", (F.get(k, F.lit(0))["pos"] + i).cast("int"))))


def f_substitute(pattern: str, replacement: str) -> Filter:
    return map_terms(lambda t: F.regexp_replace(t, pattern, replacement))


# Letters that Unicode does not decompose, and letters that stand for two.
STROKED = {"ð": "d", "đ": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ŀ": "l", "ł": "l", "ŋ": "n", "ø": "o", "ŧ": "t", "ƀ": "b", "ƒ": "f", "ɨ": "i", "ƶ": "z"}
LIGATURES = (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th"), ("ĳ", "ij"))


def _base_letters() -> tuple[str, str]:
    """Every lower-case letter of the alphabets with accents (Latin, Greek, Cyrillic and their extensions) that Unicode decomposes into
    one letter and marks, and that letter."""
    found = dict(STROKED)
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        letters = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(letters) == 1 and letters[0] != chr(code) and chr(code).lower() == chr(code):
            found[chr(code)] = letters[0]
    return "".join(found), "".join(found.values())


ACCENTED, UNACCENTED = _base_letters()


def fold_accents(text: Column) -> Column:
    """Case and accent folding; marks that stand apart from their letter go."""
    out = F.regexp_replace(F.translate(F.lower(text), ACCENTED, UNACCENTED), "[\u0300-\u036F]+", "")
    for letter, pair in LIGATURES:
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


f_fold_accents: Filter = map_terms(fold_accents)


def f_ngram(minsize: int, maxsize: int | None = None, at: str | None = None, query: bool = False) -> Filter:
    """Grams of each token; ``at="start"`` keeps prefixes, ``at="end"`` suffixes. The token's position stays.

    A query token is cut only at size ``min(maxsize, length)``; tokens shorter than ``minsize`` go either way.
    """
    maxsize = maxsize or minsize

    def grams(t: Column) -> Column:
        n = F.length(t["term"])
        if query:
            sizes = F.filter(F.array(F.least(F.lit(maxsize), n)), lambda s: n >= minsize)
        else:
            sizes = F.filter(F.sequence(F.lit(minsize), F.lit(maxsize)), lambda s: s <= n)
        if at == "start":
            return F.transform(sizes, lambda s: t.withField("term", F.substring(t["term"], F.lit(1), s)))
        if at == "end":
            return F.transform(sizes, lambda s: t.withField("term", F.substring(t["term"], n - s + 1, s)))
        return F.transform(_grams(t["term"], sizes),
                           lambda g: t.withField("term", g["term"]))

    return lambda tokens: F.flatten(F.transform(tokens, grams))


def f_intraword(delims: str = DELIMITERS, splitwords: bool = True, splitnums: bool = True,
                mergewords: bool = False, mergenums: bool = False) -> Filter:
    """Split tokens at delimiters, case changes and letter/digit changes; drop a possessive ``'s``; renumber.

    A merge adds the joined run of word (or number) parts at the position of the run's last part.
    """
    cls = "".join("\\" + c for c in delims)
    rules = [rf"[{cls}]+"]
    if splitwords:
        rules.append(r"(?<=\p{Ll})(?=\p{Lu})")
    if splitnums:
        rules += [r"(?<=[\p{Ll}\p{Lu}])(?=\p{Nd})", r"(?<=\p{Nd})(?=[\p{Ll}\p{Lu}])"]
    boundary = "|".join(rules)
    possessive = rf"(?<=[\p{{Ll}}\p{{Lu}}])'[Ss](?=$|[{cls}])"
    sep = "\u0001"

    def parts(term: Column) -> Column:
        marked = F.regexp_replace(F.when(term.contains("'"), F.regexp_replace(term, possessive, sep)).otherwise(term), boundary, sep)
        cut = F.filter(F.split(marked, f"{sep}+", -1), lambda p: p != "")
        # Most tokens have nothing to split.
        return F.when(term.rlike(r"^(?:\p{Ll}+|\p{Lu}+|\p{Nd}+)$"), F.array(term)).otherwise(cut)

    def kind(part: Column) -> Column:
        return F.when(part.rlike(r"^\p{L}+$"), F.lit("w")).when(part.rlike(r"^\p{Nd}+$"), F.lit("n")).otherwise(F.lit("x"))

    def merged(v: Column, i: Column) -> Column:
        """The joined run that ends at part ``i``, or an empty array."""
        ks, ps = v["kinds"], v["parts"]
        wanted = F.lit(False)
        if mergewords:
            wanted = wanted | (ks[i] == "w")
        if mergenums:
            wanted = wanted | (ks[i] == "n")
        ends = (i + 1 >= F.size(ks)) | (F.get(ks, i + 1) != ks[i])
        # The run starts after the last earlier part of another kind.
        begin = F.coalesce(F.array_max(F.filter(indices(i), lambda j: ks[j] != ks[i])) + 1, F.lit(0))
        return F.when(wanted & ends & (i - begin >= 1),
                      F.array(F.array_join(F.slice(ps, begin + 1, i - begin + 1), ""))).otherwise(F.array().cast("array<string>"))

    def split(v: Column) -> Column:
        """Per source token, the list of (term, step) with the step inside the token's parts."""
        plain = F.transform(v["parts"], lambda p, i: F.array(F.struct(p.alias("term"), i.alias("step"))))
        if mergewords or mergenums:
            plain = F.transform(v["parts"], lambda p, i: F.concat(
                F.array(F.struct(p.alias("term"), i.alias("step"))),
                F.transform(merged(v, i), lambda m: F.struct(m.alias("term"), i.alias("step")))))
        return F.flatten(plain)

    def expand(source: Column) -> Column:
        return let(source, spread)

    def spread(tokens: Column) -> Column:
        if mergewords or mergenums:
            lists = F.transform(tokens, lambda t: let(parts(t["term"]), lambda p: F.struct(
                p.alias("parts"), F.transform(p, kind).alias("kinds"))))
        else:
            lists = F.transform(tokens, lambda t: F.struct(parts(t["term"]).alias("parts")))

        def out(v: Column) -> Column:
            counts = F.transform(v["lists"], lambda x: F.size(x["parts"]))
            first = F.get(v["tokens"], F.lit(0))["pos"]
            return let(running_total(counts), lambda before: F.flatten(F.transform(
                v["lists"], lambda x, k: F.transform(split(x), lambda s: F.struct(
                    s["term"].alias("term"), (first + before[k] + s["step"]).cast("int").alias("pos"))))))

        return let_all({"lists": lists, "tokens": tokens}, out)

    return expand


def f_biword(sep: str = "-") -> Filter:
    """Adjacent pairs; a lone token passes through."""
    return f_shingle(2, sep)


def f_shingle(size: int, sep: str = "-") -> Filter:
    """Adjacent ``size``-tuples, at the first token's position; fewer tokens than ``size`` give one joined token."""
    def tuples(k: Column) -> Column:
        def joined(i: Column) -> Column:
            return F.get(k, i).withField("term", F.array_join(F.slice(k, i + 1, F.lit(size))["term"], sep))

        return F.when(F.size(k) >= size, F.transform(F.slice(k, F.lit(1), F.size(k) - (size - 1)), lambda t, i: joined(i))) \
            .when(F.size(k) > 0, F.array(joined(F.lit(0)))).otherwise(k)

    return lambda tokens: let(tokens, tuples)


def f_tee(*chains: Filter) -> Filter:
    """The outputs of several chains, token by token."""
    def both(tokens: Column) -> Column:
        outs = let(tokens, lambda ts: F.array(*[c(ts) for c in chains]))
        return let(outs, lambda o: let(F.array_max(F.transform(o, lambda x: F.size(x))), lambda longest: F.flatten(F.transform(
            indices(longest), lambda i: F.filter(F.transform(o, lambda x: F.get(x, i)), lambda t: t.isNotNull())))))

    return both


def f_term_boost(delim: str = "^", default: float = 1.0) -> Filter:
    """``render^2`` becomes term ``render`` with boost 2.0."""
    def split(t: Column) -> Column:
        at = F.instr(t["term"], delim)
        cut = F.when(at > 0, F.substring(t["term"], F.lit(1), at - 1)).otherwise(t["term"])
        value = F.when(at > 0, F.substring(t["term"], at + len(delim), F.length(t["term"]))).try_cast("double")
        return t.withField("term", cut).withField("boost", F.coalesce(value, F.lit(default)))

    return lambda tokens: F.transform(tokens, split)


def f_boost_pattern(pattern: str, group: int = 1, default: float = 1.0) -> Filter:
    """Boost read from a group of ``pattern``; the match is removed from the term."""
    def split(t: Column) -> Column:
        value = F.regexp_extract(t["term"], pattern, group).try_cast("double")
        return t.withField("term", F.regexp_replace(t["term"], pattern, "")).withField("boost", F.coalesce(value, F.lit(default)))

    return lambda tokens: F.transform(tokens, split)


# ---- analyzers: a tokenizer followed by filters --------------------------------------------------------------

def chain(tokenizer: Filter, *filters: Filter) -> Filter:
    def run(text: Column) -> Column:
        out = tokenizer(text)
        for f in filters:
            out = f(out)
        return out

    return run


def an_id(lowercase: bool = False) -> Filter:
    return chain(tok_id, f_lower) if lowercase else tok_id


def an_regex(pattern: str = DEFAULT_PATTERN, gaps: bool = False) -> Filter:
    return (lambda c: tok_regex_gaps(c, pattern)) if gaps else (lambda c: tok_regex(c, pattern))


def an_keyword(lowercase: bool = False, commas: bool = False) -> Filter:
    tok = tok_comma if commas else tok_space
    return chain(tok, f_lower) if lowercase else tok


def an_simple(pattern: str = DEFAULT_PATTERN, chars: bool = False) -> Filter:
    return chain(lambda c: tok_regex(c, pattern, chars), f_lower)


def an_standard(stoplist: Sequence[str] | None = STOP_WORDS, minsize: int = 2, maxsize: int | None = None,
                pattern: str = DEFAULT_PATTERN, chars: bool = False) -> Filter:
    return chain(lambda c: tok_regex(c, pattern, chars), f_lower, f_stop(stoplist, minsize, maxsize))


def an_fancy(stoplist: Sequence[str] | None = STOP_WORDS, minsize: int = 2, maxsize: int | None = None) -> Filter:
    return chain(lambda c: tok_regex_gaps(c, r"\s+"), f_intraword(), f_lower, f_stop(stoplist, minsize, maxsize))


def an_ngram(minsize: int, maxsize: int | None = None, query: bool = False) -> Filter:
    return chain(lambda c: tok_ngram(c, minsize, maxsize, query), f_lower)


def an_ngram_words(minsize: int, maxsize: int | None = None, at: str | None = None, query: bool = False) -> Filter:
    return chain(tok_regex, f_lower, f_ngram(minsize, maxsize, at, query))


def f_by_mode(index: Filter, query: Filter) -> Callable[[str], Filter]:
    """One chain for the corpus, another for queries; call the result with the mode."""
    return lambda mode: query if mode == "query" else index
