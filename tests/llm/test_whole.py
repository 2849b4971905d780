"""The whole job where a smaller one would pass the other tests."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from gleanery.llm import pii  # noqa: E402


def shingles(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def first_of_near_copies(texts, size=5):
    """The place of the first text that each one reaches through pairs at 0.8, from all pairs."""
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_dedup_stage_compares_five_words(spark, make):
    r = random.Random(11)
    texts = []
    for doc in range(6):
        base = [f"w{doc}x{i}" for i in range(100)]
        texts.append(" ".join(base))
        for changed in (1, 2, 4, 5, 5):
            w = list(base)
            for i in r.sample(range(5, 95, 6), changed):
                w[i] = f"new{r.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    texts += ["one two three four", "one two three five", "One two three four", "", None]
    roots = first_of_near_copies(texts)
    expected = [i for i, root in enumerate(roots) if i == root]
    between = [(i, j) for i in range(36) for j in range(i) if roots[i] != roots[j] and len(shingles(texts[i], 2) & shingles(texts[j], 2)) >= 0.8 * len(shingles(texts[i], 2) | shingles(texts[j], 2))]
    assert len(between) >= 6 and len(expected) < len(texts) - 6
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, make(texts), "").collect()) == expected


def found_spans(make, texts):
    rows = pii.find(make(texts)).select("doc_id", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect()
    out = {r["doc_id"]: r["text"] for r in pii.redact(make(texts)).collect()}
    return {r["doc_id"]: (r["b"].split(","), r["s"].split(","), out[r["doc_id"]]) for r in rows}


def test_secrets_around_base_spans_vanish_whole(make):
    hexed = 'api_key = "ab4111111111111111cdef0123456789abcdef01"'
    based = "auth token: Zm9vYmFy+491511234567/QxYz01Kd"
    nested = "call +1 (555) 010-0199 or 555-010-0199"
    mailed = "see a@b.token=4dbebab91ab85687d33eea now"
    got = found_spans(make, [hexed, based, nested, mailed])
    assert got[0][0] == ["card:13:29"] and {"card:13:29", f"secret:0:{len(hexed) - 1}"} <= set(got[0][1]) and got[0][2] == '<SECRET>"'
    assert got[1][0] == ["phone:20:33"] and {"phone:20:33", f"secret:5:{len(based)}"} <= set(got[1][1]) and got[1][2] == "auth <SECRET>"
    assert [s for s in got[2][1] if s.startswith("phone")] == ["phone:5:22", "phone:26:38"] and got[2][2] == "call <PHONE> or <PHONE>"
    assert got[3][0] == ["email:4:13"] and "secret:8:36" in got[3][1] and got[3][2] == "see <EMAIL> now"


def test_long_secrets_vanish_whole(make):
    r = random.Random(4)
    value = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/_.-") for _ in range(1000))
    huge = "token=" + "aB3/" * 250_000
    got = found_spans(make, [f'config token = "{value}" end', f"secret:{value[:200]}", huge])
    assert f"secret:7:{7 + len('token = ') + 1 + 1000}" in got[0][1] and got[0][2] == 'config <SECRET>" end'
    assert got[1][2] == "<SECRET>" and f"secret:0:{len(huge)}" in got[2][1]
