"""Language profiles against a plain version, on held-out labels and on odd rows."""

import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import langid
from gleanery.llm.queries import op12_language_id

SAMPLES = {
    "en": "The river runs past the old mill and the children watch it from the bridge. Nobody knows how deep the water is below the wheel, and nobody asks.",
    "de": "Der Fluss fließt an der alten Mühle vorbei und die Kinder sehen ihm von der Brücke aus zu. Niemand weiß, wie tief das Wasser unter dem Rad ist.",
    "fr": "La rivière passe devant le vieux moulin et les enfants la regardent depuis le pont. Personne ne sait quelle est la profondeur de l'eau sous la roue.",
    "ru": "Река течёт мимо старой мельницы, и дети смотрят на неё с моста. Никто не знает, как глубока вода под колесом.",
}


def plain_grams(text):
    words = re.sub(r" +", " ", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())).strip()
    t = f" {words} "
    found = Counter()
    if not words:
        return found
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i: i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                found[g] += 1
    return found


def profile(counts, longest):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], len(c[0]), c[0]))[:longest])}


def plain(rows, longest):
    counts = {}
    for key, text, lang in rows:
        if lang is not None and key is not None and zlib.crc32(str(key).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: profile(c, longest) for lang, c in counts.items()}
    out = []
    for key, text, _ in rows:
        own = profile(plain_grams(text), longest)
        pred, score = "und", 0.0
        if own and profiles:
            off = sorted((sum(abs(r - p[g]) if g in p else longest for g, r in own.items()), lang) for lang, p in profiles.items())
            second = off[1][0] if len(off) > 1 else longest * len(own)
            pred, score = off[0][1], (second - off[0][0]) / max(second, 1)
        out.append((key, key is not None and zlib.crc32(str(key).encode()) % 4 == 2, pred, round(score, 9)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def documents(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("gram", F.lit("x")).withColumn("n", F.lit(1)).withColumn("score", F.lit(2)).withColumn("_x", F.lit("y"))

    return build


def mixed():
    rows = []
    for i in range(240):
        lang = sorted(SAMPLES)[i % 4]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(words[(i * 3) % 11: (i * 3) % 11 + 3 + i % 13]) + ("!\n123 " if i % 2 else ""), None if i % 17 == 0 else lang))
    return rows


ODD = [(500, None, "en"), (501, "", "en"), (502, " 12 -- !!\n", "fr"), (503, "x", None), (504, "ÄÖ\U0001F600 ß é", "de"), (504, "ÄÖ\U0001F600 ß é", "de"), (None, SAMPLES["fr"], "ru"), (505, "漢字かな", None)]


@pytest.mark.parametrize("longest", [langid.PROFILE, 25, 1])
def test_against_a_plain_version(documents, longest):
    rows = mixed() + ODD
    for parts in (1, 7):
        got = langid.identify(documents(rows).repartition(parts), longest=longest).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got), key=str) == plain(rows, longest)


def test_a_long_text_is_counted_in_pieces(monkeypatch, documents):
    rows = [(i, SAMPLES[lang] * 40, lang) for i, lang in enumerate(SAMPLES)]
    whole = {g: c for g, c in zip(*[x.tolist() for x in langid.gram_counts([" " + plain_text(rows[1][1]) + " "])[1:]], strict=True)}
    monkeypatch.setattr(langid, "STEP", 97)
    cut = {g: c for g, c in zip(*[x.tolist() for x in langid.gram_counts([" " + plain_text(rows[1][1]) + " "])[1:]], strict=True)}
    assert whole == cut and sum(whole.values()) == sum(plain_grams(rows[1][1]).values())


def plain_text(text):
    return " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split())


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op12_language_id(spark, sf).join(docs, "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.98


def test_no_labels_one_label_and_no_rows(documents):
    none = langid.identify(documents([(0, "some words", None), (1, "more words", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = {r["doc_id"]: r for r in langid.identify(documents([(0, "some words", "en"), (1, "漢", None), (2, "?", None)])).collect()}
    assert one[0]["lang_pred"] == "en" and one[0]["score"] > 0 and one[1]["lang_pred"] == "en" and one[1]["score"] == 0 and one[2]["lang_pred"] == "und"
    blank = {r["lang_pred"] for r in langid.identify(documents([(0, None, "en"), (1, "word", None)])).collect()}
    assert blank == {"und", "en"}
    assert langid.identify(documents([])).count() == 0
