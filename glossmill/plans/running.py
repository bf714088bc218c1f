"""Queries over running text without spaces, and archives: turns of conversations are spelled with Han characters, so that words have to be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice as A
from ..functions import rules as R
from ..functions import segment as G
from .registry import ENDS, query, read

LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz,.", "天地玄黄宇宙洪荒日月盈昃辰宿列張寒来暑往秋収冬蔵閏余，。"
PARTICLES = sorted(G.PARTICLES)
MOST = 8

# --- the same in SQL ----------------------------------------------------------------------------

COUNTS = f"words AS (SELECT translate(w, '{LETTERS}', '{HAN}') AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) WHERE length(w) <= {MOST} GROUP BY w)"
BIG = 1 << 40


def _parts(source: str, name: str) -> str:
    """All places of words of `lex` in the texts s of (id, s): id, e (end), l (length), word."""
    most = "(SELECT max(length(word)) FROM lex)"
    return f"{name} AS MATERIALIZED (SELECT id, e, l, word FROM (SELECT id, e, l, substr(s, e - l + 1, l) AS word FROM (SELECT id, s, e, unnest(range(1, least(e, {most}) + 1)) AS l FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS e FROM {source}))) JOIN lex USING (word))"


def _costs(parts: str) -> str:
    """cost(word, cost) from how often each word stands anywhere in the texts."""
    return f"uses AS (SELECT lex.word, 1 + coalesce(n, 0) AS n FROM lex LEFT JOIN (SELECT word, count(*) AS n FROM {parts} GROUP BY word) u ON u.word = lex.word), cost AS MATERIALIZED (SELECT word, floor(100 * ln((SELECT sum(n) FROM uses) / n) + 0.5)::BIGINT AS cost FROM uses)"


def _bounds(source: str, parts: str, name: str) -> str:
    """id and `bounds`, the places where words of the path of least cost start or end, from the last to 0."""
    return f"""{name}_a AS (SELECT id, e, l * {BIG} + cost * {A.PER_WORD} + 1 AS x FROM {parts} JOIN cost USING (word) UNION ALL SELECT id, e, {BIG} + CASE WHEN substr(s, e, 1) IN ('，', '。') THEN 0 ELSE {A.UNKNOWN}::BIGINT * {A.PER_WORD} END + 1 FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS e FROM {source})),
        {name}_l AS (SELECT id, list(x ORDER BY e) AS es FROM (SELECT id, e, list(x) AS x FROM {name}_a GROUP BY id, e) GROUP BY id),
        {name}_b AS (SELECT id, es, list_reduce(list_prepend([0::BIGINT], es), lambda st, x: list_append(st, list_min(list_transform(x, lambda y: st[len(st) - y // {BIG} + 1] + y % {BIG})))) AS best FROM {name}_l),
        {name} AS MATERIALIZED (SELECT id, list_reduce(list_prepend([len(es)::BIGINT], list_transform(range(len(es)::BIGINT, 0, -1), lambda t: [t])), lambda acc, t: CASE WHEN acc[len(acc)] = t[1] THEN list_append(acc, t[1] - list_max(list_transform(list_filter(es[t[1]], lambda y: best[t[1] - y // {BIG} + 1] + y % {BIG} = best[t[1] + 1]), lambda y: y // {BIG}))) ELSE acc END) AS bounds FROM {name}_b)"""


#: Turns are told apart by this.
_ID = "conv_id * 1000000 + turn * 10 + (role = 'user')::INT AS id"

# --- regional terms -----------------------------------------------------------------------------

TERMS = 40


def borderless(w: str) -> bool:
    return not any(w[:k] == w[-k:] for k in range(1, len(w)))


#: Turns that a task works on; their texts are short, so that splits of a file would hold very many.
TASK_TURNS = 4000


def turns(spark, sf):
    """All turns, dealt by number, as the work on each is dear."""
    t = read(spark, sf, "conversations")
    return t.select("conv_id", "turn", "role", "text").repartition(max(1, -(-t.count() // TASK_TURNS)), "conv_id", "turn", "role")


def spelled(spark, sf):
    text = F.translate(F.regexp_replace(F.lower("text"), "[^a-z,.]", ""), LETTERS, HAN)
    return turns(spark, sf).select("conv_id", "turn", "role", F.lower("text").alias("plain"), text.alias("s"))


def spelled_words(spark, sf):
    words = spelled(spark, sf).select(F.explode(F.regexp_extract_all("plain", F.lit("([a-z]+)"), F.lit(1))).alias("w")).where(F.length("w") <= MOST)
    return words.groupBy(F.translate("w", LETTERS, HAN).alias("word")).agg(F.count("*").alias("n"))


_BORDER = "len(list_filter(range(1, length({0})), lambda k: left({0}, k) = right({0}, k))) = 0"
POLICY = f"""ranked AS (SELECT word AS term, row_number() OVER (ORDER BY n DESC, word) AS r FROM words WHERE length(word) BETWEEN 2 AND 4 AND {_BORDER.format("word")} ORDER BY n DESC, word LIMIT {TERMS}),
    policy AS (SELECT term, r % 3 = 0 AS prefix, CASE WHEN r % 4 = 0 THEN after END AS context, CASE WHEN r % 5 = 0 AND {_BORDER.format("(term || after)")} THEN term || after END AS phrase FROM (SELECT term, r, lead(term) OVER (ORDER BY r) AS after FROM ranked))"""


@query(f"""WITH {COUNTS}, t AS MATERIALIZED (SELECT {_ID}, conv_id, turn, role, translate(regexp_replace(lower(text), '[^a-z,.]', '', 'g'), '{LETTERS}', '{HAN}') AS s FROM conversations), lex AS (SELECT word FROM words WHERE n >= 3), {_parts("t", "parts")}, {_costs("parts")}, {_bounds("t", "parts", "cuts")}, {POLICY},
    hits AS (SELECT id, s, p.*, e - l AS a, e AS b FROM parts JOIN policy p ON word = term JOIN t USING (id)),
    good AS (SELECT id, term, a FROM hits JOIN cuts USING (id) WHERE list_contains(bounds, a) AND (list_min(list_filter(bounds, lambda x: x > a)) = b OR prefix AND list_min(list_filter(bounds, lambda x: x > a)) > b)
        AND (context IS NULL OR contains(regexp_extract(left(s, a::BIGINT), '[^，。]*$') || term || regexp_extract(substr(s, (b + 1)::BIGINT), '^[^，。]*'), context))
        AND (phrase IS NULL OR s <> phrase AND len(list_filter(range(greatest(0, b - length(phrase)), a + 1), lambda x: substr(s, (x + 1)::BIGINT, length(phrase)) = phrase)) = 0)),
    said AS (SELECT id, string_agg(term || '>' || reverse(term) || '@' || a, ',' ORDER BY a, length(term) DESC, term) AS matches FROM good GROUP BY id)
    SELECT conv_id, turn, role, coalesce(matches, '') AS matches FROM t LEFT JOIN said USING (id)""")
def regional_terms(spark, sf):
    """All turns against a policy of frequent words, some of which may be the start of longer ones, need a context or are excused by a phrase; cut by costs learned from the turns."""
    t, words = spelled(spark, sf), spelled_words(spark, sf)
    lattice = A.learn_lattice(words.where("n >= 3"), t, "word", "s", rounds=1)
    common = words.where(F.length("word").between(2, 4)).where(" and ".join(f"(length(word) <= {k} or left(word, {k}) <> right(word, {k}))" for k in range(1, 4)))
    terms = [r.word for r in common.orderBy(F.desc("n"), "word").limit(TERMS).collect()]
    policy = []
    for r, (term, after) in enumerate(zip(terms, [*terms[1:], ""], strict=True), 1):
        phrase = [term + after] if r % 5 == 0 and after and borderless(term + after) else None
        policy.append({"term": term, "replacement": term[::-1], "prefix": r % 3 == 0, "context": [after] if r % 4 == 0 and after else None, "allowed": phrase})
    found = G.find_regional_terms(t, "s", policy, lattice=lattice)
    said = F.transform("regional", lambda x: F.concat(x["term"], F.lit(">"), x["replacement"], F.lit("@"), x["index"].cast("string")))
    return found.select("conv_id", "turn", "role", F.array_join(said, ",").alias("matches"))


# --- sentences ----------------------------------------------------------------------------------

#: Turns whose sentences are cut by a lattice of their own.
SHARE_TURNS = 2000
_ENDS = "[" + ", ".join(repr(e) for e in ENDS) + "]"
_HAN = f"translate({{0}}, '{LETTERS}', '{HAN}')"
SENTENCES = f"""said AS (SELECT conv_id, turn, role, unnest(string_split(lower(text), '.')) AS t, generate_subscripts(string_split(lower(text), '.'), 1) AS no FROM conversations),
    turns AS (SELECT conv_id * 1000000000 + turn * 1000000 + (role = 'user')::INT * 100000 + no AS id, conv_id, turn, role, no, regexp_extract_all(t, '[a-z]+') AS w FROM said WHERE regexp_matches(t, '[a-z]')),
    sen AS MATERIALIZED (SELECT id, conv_id, turn, role, no, w, array_to_string(list_transform(w, lambda x, i: {_HAN.format("x")} || {_ENDS}[1 + (length(x) + i) % {len(ENDS)}] || CASE WHEN i % 5 = 0 THEN '。' WHEN i % 3 = 1 THEN 'は' WHEN i % 3 = 2 THEN 'を' ELSE '' END), '') AS s FROM turns),
    asked AS MATERIALIZED (SELECT id, conv_id, turn, role, no, s, unnest([{_HAN.format("w[1 + no % len(w)]")} || 'る', {_HAN.format("reverse(w[1 + (7 * no + turn) % len(w)])")} || 'る', {_HAN.format("w[1 + no % len(w)]")} || 'い']) AS h FROM sen)"""
_JRULES = "jrules(suffix, repl) AS (VALUES " + ", ".join(f"('{s}', '{r}')" for _, s, r, _ in R.japanese_suffixes()) + ")"
_NAMES = ", ".join(f"'{p}'" for p in PARTICLES)


@query(f"""WITH {SENTENCES}, {COUNTS}, lex AS (SELECT word || 'る' AS word FROM words WHERE n >= 3 UNION SELECT h FROM asked UNION SELECT unnest([{_NAMES}])), {_parts("sen", "parts")}, {_costs("parts")}, {_bounds("sen", "parts", "cuts")}, {_JRULES},
    toks AS (SELECT id, b - n AS a, b, substr(s, b - n + 1, n) AS w FROM (SELECT id, b, b - lag(b) OVER (PARTITION BY id ORDER BY b) AS n FROM (SELECT id, unnest(bounds) AS b FROM cuts)) JOIN sen USING (id) WHERE n IS NOT NULL),
    places AS (SELECT id, h, unnest(list_filter(range(length(s)), lambda i: substr(s, (i + 1)::BIGINT, length(h)) = h)) AS k FROM asked WHERE contains(s, h)),
    starts AS (SELECT id, b AS k FROM toks WHERE w IN ('。', {_NAMES}) UNION SELECT id, 0 FROM cuts),
    ends AS (SELECT id, a AS k FROM toks UNION SELECT id, b FROM toks),
    direct AS (SELECT id, h FROM places JOIN starts USING (id, k) UNION SELECT p.id, h FROM places p JOIN ends x ON x.id = p.id AND x.k = p.k JOIN ends y ON y.id = p.id AND y.k = p.k + length(h)),
    forms AS (SELECT DISTINCT id, h, left(h, length(h) - length(repl)) || suffix AS f FROM asked JOIN jrules ON ends_with(h, repl) AND length(h) > length(repl)),
    spots AS (SELECT id, h, f, s, unnest(list_filter(range(length(s)), lambda i: substr(s, (i + 1)::BIGINT, length(f)) = f)) AS k FROM forms ANTI JOIN direct USING (id, h) JOIN sen USING (id) WHERE f <> h AND length(f) <= greatest(12, length(h) + 8) AND contains(s, f)),
    pieces AS (SELECT id AS id0, h, regexp_extract(left(s, k::BIGINT), '[^。]*$') || h || regexp_extract(substr(s, (k + length(f) + 1)::BIGINT), '^[^。]*') AS s FROM spots),
    bent AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s) AS id, s FROM (SELECT DISTINCT s FROM pieces)),
    {_parts("bent", "parts2")}, {_bounds("bent", "parts2", "cuts2")},
    toks2 AS (SELECT s, substr(s, b - n + 1, n) AS w FROM (SELECT id, b, b - lag(b) OVER (PARTITION BY id ORDER BY b) AS n FROM (SELECT id, unnest(bounds) AS b FROM cuts2)) JOIN bent USING (id) WHERE n IS NOT NULL),
    used AS (SELECT id, h FROM direct UNION SELECT id0, h FROM pieces JOIN toks2 ON pieces.s = toks2.s AND h = w)
    SELECT conv_id, turn, role, no, h AS headword, used.h IS NOT NULL AS used FROM asked LEFT JOIN used USING (id, h)""")
def japanese_sentence_uses(spark, sf):
    """All sentences of all turns as stems with endings; three headwords each: one that may be inflected in it, one spelled backwards, one with another ending."""
    han = lambda c: F.translate(c, LETTERS, HAN)
    ends = F.array(*map(F.lit, ENDS))
    joint = lambda i: F.when(i % 5 == 0, "。").when(i % 3 == 1, "は").when(i % 3 == 2, "を").otherwise("")
    t = read(spark, sf, "conversations")
    shares = max(1, -(-t.count() // SHARE_TURNS))
    t = t.withColumn("share", F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(shares))).repartition(shares, "share")
    said = t.select("share", "conv_id", "turn", "role", F.posexplode(F.split(F.lower("text"), "[.]")).alias("at", "t"))
    sen = said.select("share", "conv_id", "turn", "role", (F.col("at") + 1).cast("long").alias("no"), F.regexp_extract_all("t", F.lit("([a-z]+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    sen = sen.withColumn("s", F.array_join(F.transform("w", lambda x, i: F.concat(han(x), F.element_at(ends, 1 + (F.length(x) + i + 1) % len(ENDS)), joint(i + 1))), ""))
    word = lambda k: F.element_at("w", (1 + k % F.size("w")).cast("int"))
    heads = F.array(F.concat(han(word(F.col("no"))), F.lit("る")), F.concat(han(F.reverse(word(7 * F.col("no") + F.col("turn")))), F.lit("る")), F.concat(han(word(F.col("no"))), F.lit("い")))
    sen = sen.select("share", "conv_id", "turn", "role", "no", "s", heads.alias("heads"))
    asked = sen.select(F.explode("heads").alias("word"))
    known = spelled_words(spark, sf).where("n >= 3").select(F.concat("word", F.lit("る")).alias("word")).unionByName(asked).unionByName(spark.createDataFrame([(p,) for p in PARTICLES], "word string"))
    used = G.headwords_used(sen, "s", "heads", known, "share")
    return used.select("conv_id", "turn", "role", "no", F.explode(F.arrays_zip("heads", "used")).alias("x")).select("conv_id", "turn", "role", "no", F.col("x.heads").alias("headword"), F.col("x.used").alias("used"))
