"""One query for each operator; the digest columns of the contracts are made here."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, gam, langid, licenses, merkle, mixing, neardup, pii, repeats, rules, topk, whitening
from .common import settle
from .registry import ORACLES, QUERIES, query, table  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf):
    ids = bpe.encode(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN, ["doc_id", "n_tokens", "ids"])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op3_quality_rules")
def op3_quality_rules(spark, sf):
    return rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


@query("op5_quality_gam")
def op5_quality_gam(spark, sf):
    return gam.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_pii_spans")
def op1_pii_spans(spark, sf):
    found = pii.find(table(spark, sf, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in pii.BASE], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (WITH RECURSIVE r(node, seen) AS (SELECT a, a FROM edge UNION SELECT r.node, e.b FROM r JOIN edge e ON e.a = r.seen) SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON node = doc_id
"""


@query("op2_minhash_neardup", OP2_SQL)
def op2_minhash_neardup(spark, sf):
    return neardup.classes(table(spark, sf, "documents"))


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""


@query("op4_va_topk", OP4_SQL)
def op4_va_topk(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), lambda i: i % 20 == 0)


def _share_sql(name: str, source: str, parent: str, child: str) -> str:
    """CTE ``name``: the children of ``source`` with their share ``given`` of the parent's ``budget``."""
    by = f"(PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {child}"
    return (f"{name}_a AS (SELECT *, greatest(0, budget - coalesce(sum(cap) OVER {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest, "
            f"sum(weight) OVER {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, row_number() OVER {by}) AS i FROM {source} WHERE weight > 0), "
            f"{name}_b AS (SELECT *, cap * w <= rest * weight AS is_full FROM {name}_a), "
            f"{name}_c AS (SELECT *, arg_min(rest, i) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS r0, arg_min(w, i) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS w0 FROM {name}_b), "
            f"{name} AS (SELECT * EXCLUDE (budget), CASE WHEN is_full THEN cap ELSE least(cap, (weight * r0) // w0) END AS given FROM {name}_c)")


OP8_SQL = (r"""
WITH d AS (SELECT doc_id, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' ELSE 'prose' END AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 2 AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'prose' THEN 9 ELSE 1 END AS weight, 0 AS root, (SELECT sum(tokens)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain),
""" + _share_sql("s1", "n1", "root", "domain") + """,
n2 AS (SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(given) AS budget FROM leaf l JOIN s1 USING (domain) GROUP BY l.domain, lang),
""" + _share_sql("s2", "n2", "domain", "lang") + """,
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, 1 AS weight, given AS budget FROM leaf l JOIN s2 ON l.domain = s2.domain AND l.lang = s2.lang),
""" + _share_sql("s3", "n3", "domain, lang", "source") + """,
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 2 END::BIGINT AS whole, (given - CASE WHEN tokens > 0 THEN given // tokens ELSE 2 END * tokens)::BIGINT AS rest FROM s3),
j AS (SELECT doc_id, d.domain, d.lang, d.source, tokens, whole, rest FROM d JOIN p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || whole || ':' || doc_id)) AS used FROM j WHERE whole < 2 AND rest > 0)
SELECT doc_id, domain, lang, source, tokens, unnest(range(whole))::INTEGER AS epoch FROM j
UNION ALL SELECT doc_id, domain, lang, source, tokens, whole::INTEGER FROM u WHERE used <= rest
""")


@query("op8_mixing", OP8_SQL)
def op8_mixing(spark, sf):
    return mixing.select(table(spark, sf, "documents"))


_TEMPLATES = [(i, name, w) for i, (name, w) in enumerate((name, licenses.words_of(t)) for name, texts in licenses.TEMPLATES.items() for t in texts)]
OP7_SQL = (r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(len(ws) - 4)) AS pos, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, pos, array_to_string(ws[pos + 1: pos + 5], ' ') AS sh FROM s),
t(template, license, class, sh) AS (VALUES """
    + ", ".join(f"({i}, '{name}', {licenses.length_class(len(w) - 4)}, '{' '.join(w[k: k + 5])}')" for i, name, w in _TEMPLATES for k in range(len(w) - 4))
    + """),
n AS (SELECT template, count(DISTINCT sh) AS n FROM t GROUP BY template),
m AS (SELECT DISTINCT doc_id, template, license, class, pos, sh FROM h JOIN t USING (sh)),
v AS (SELECT *, pos // class AS win FROM m UNION SELECT *, greatest(pos // class - 1, 0) FROM m),
c AS (SELECT doc_id, template, license, win, count(DISTINCT sh) AS k, min(pos) AS a, max(pos) AS b FROM v GROUP BY ALL)
SELECT doc_id, license, round(max(k / n), 6) AS containment, min(a)::INTEGER AS first_word, (max(b) + 4)::INTEGER AS last_word
FROM c JOIN n USING (template) WHERE k / n >= 0.8 GROUP BY doc_id, license
""")


@query("op7_license_scan", OP7_SQL)
def op7_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(role) + 1 + length(escaped) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op9_chat_tree", OP9_SQL)
def op9_chat_tree(spark, sf):
    told = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'")
    turns = settle(chat.turns_of(told.unionByName(extra)))
    return chat.read_back(*chat.tree(turns))


@query("op6_repeated_bytes")
def op6_repeated_bytes(spark, sf):
    return repeats.digest(repeats.remove(table(spark, sf, "documents")))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _levels_sql(name: str, base: str, tree: str, levels: int) -> str:
    """CTEs ``name``0 .. of a forest's levels (tree, j, d, n: nodes of that level) and the runs of 16 that each closes. A tree of one node stays."""
    out = [f"{name}0 AS (SELECT {tree} AS tree, row_number() OVER (PARTITION BY {tree} ORDER BY o1 NULLS FIRST, d) - 1 AS j, d, count(*) OVER (PARTITION BY {tree}) AS n FROM {base})"]
    for k in range(levels):
        out.append(f"{name}{k}r AS (SELECT tree, j // 16 AS j, list(d ORDER BY j) AS run, any_value(n) AS n FROM {name}{k} GROUP BY tree, j // 16)")
        out.append(f"{name}{k + 1} AS (SELECT tree, j, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d, (n + 15) // 16 AS n FROM {name}{k}r)")
    return ", ".join(out)


def _climb_sql(name: str, start: str, level: str, levels: int) -> str:
    """CTEs ``name``0 .. that carry (place, f, proof) of each row of ``start`` up the levels named ``level``."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        left = f"CASE WHEN r.n = 1 THEN '' ELSE array_to_string(r.run[:s.place % 16], '') END"
        right = f"CASE WHEN r.n = 1 THEN '' ELSE array_to_string(r.run[s.place % 16 + 2:], '') END"
        out.append(f"{name}{k}s AS (SELECT s.* EXCLUDE (place), s.place // 16 AS place, r.n AS rn, {left} AS l, {right} AS r FROM {name}{k} s JOIN {level}{k}r r ON r.tree = s.tree AND r.j = s.place // 16)")
        out.append(f"{name}{k + 1} AS (SELECT * EXCLUDE (rn, l, r) REPLACE (CASE WHEN rn = 1 THEN f ELSE sha256(l || f || r) END AS f, proof || l || r AS proof) FROM {name}{k}s)")
    return ", ".join(out)


# Six levels hold 16 million rows of a source, and as many sources.
_SOURCE_LEVELS, _TOP_LEVELS = 6, 6
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


OP11_SQL = f"""
WITH doc AS (SELECT doc_id, doc_id AS o1, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS name, {_leaf_sql('text')} AS d,
  CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf_sql(_LOW)} END AS changed FROM documents),
{_levels_sql('a', 'doc', 'name', _SOURCE_LEVELS)},
sub AS (SELECT tree AS name, tree AS o1, d FROM a{_SOURCE_LEVELS}),
{_levels_sql('b', "(SELECT '' AS t0, * FROM sub)", 't0', _TOP_LEVELS)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, d) - 1 AS place FROM doc),
{_climb_sql('c', "SELECT doc_id, name AS tree, d AS leaf, place, place AS position, coalesce(changed, d) AS f, '' AS proof FROM ranked", 'a', _SOURCE_LEVELS)},
lifted AS (SELECT c.* EXCLUDE (tree, place), '' AS tree, s.d AS subroot, s.place FROM c{_SOURCE_LEVELS} c JOIN (SELECT *, row_number() OVER (ORDER BY name) - 1 AS place FROM sub) s ON s.name = c.tree),
{_climb_sql('e', "SELECT * FROM lifted", 'b', _TOP_LEVELS)}
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified,
  CAST(position + {' + '.join(f'position // {16 ** k}' for k in range(1, 9))} AS BIGINT) AS position
FROM e{_TOP_LEVELS} JOIN b{_TOP_LEVELS} t ON true
"""


@query("op11_merkle_log", OP11_SQL)
def op11_merkle_log(spark, sf):
    docs = table(spark, sf, "documents").select(*merkle.FIELDS)
    text = F.col(f"c{merkle.FIELDS.index('text')}")
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changes = F.crc32(F.col(f"c{merkle.FIELDS.index('doc_id')}").cast("string").cast("binary")) % 5 == 0
    return merkle.verify(merkle.manifest(docs, {"text": low}, changes))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, lang, {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 4 = 2 AS held_out, regexp_matches(coalesce(text, ''), '\p{{L}}') AS lettered,
  ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g'), ' ') || ' ' AS t FROM documents),
p AS (SELECT doc_id, lang, held_out, t, unnest(range(1, length(t) + 1)) AS i FROM d WHERE lettered),
g AS (SELECT doc_id, lang, held_out, substr(t, i, 1) AS gram FROM p WHERE substr(t, i, 1) <> ' '
  UNION ALL SELECT doc_id, lang, held_out, substr(t, i, 2) FROM p WHERE i < length(t)
  UNION ALL SELECT doc_id, lang, held_out, substr(t, i, 3) FROM p WHERE i < length(t) - 1 AND substr(t, i + 1, 1) <> ' '),
n AS (SELECT doc_id, any_value(lang) AS lang, any_value(held_out) AS held_out, gram, count(*) AS n FROM g GROUP BY doc_id, gram),
l AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS r FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY r < {langid.PROFILE}),
langs AS (SELECT DISTINCT lang FROM d WHERE NOT held_out AND lang IS NOT NULL),
o AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS r FROM n QUALIFY r < {langid.PROFILE}),
s AS (SELECT doc_id, langs.lang, sum(coalesce(abs(o.r - l.r), {langid.PROFILE}))::BIGINT AS off, count(*) * {langid.PROFILE} AS most FROM o CROSS JOIN langs LEFT JOIN l ON l.lang = langs.lang AND l.gram = o.gram GROUP BY ALL),
b AS (SELECT doc_id, lang, off, lead(off, 1, most) OVER w AS next, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY off, lang))
SELECT doc_id, d.held_out, coalesce(b.lang, '{langid.UNKNOWN}') AS lang_pred, coalesce((next - off) / greatest(next, 1), 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) WHERE k IS NULL OR k = 1
"""


@query("op12_language_id", OP12_SQL)
def op12_language_id(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query("op13_whitening")
def op13_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
