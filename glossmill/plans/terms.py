"""Queries of single functions, sources and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import lookup as L
from ..operators import merge as M
from ..operators import order as O
from ..operators import release as P
from ..operators import retain as T
from ..operators import stats as S
from ..operators import validate as V
from ..sources import files as I
from ..sources.shared import new_folder as folder
from ..streaming import evidence as ST
from .registry import ENTRIES, EVIDENCE, FORMS, LEMMAS, RANKED, SENSES, SURFACES, BENT, evidence_entries, examples, forms, glosses, ja_entries, lexicon, prod, query, read, rel, senses, surfaces, tokens


def pick(items, i):
    return F.element_at(F.array(*map(F.lit, items)), i.cast("int"))


# --- functions ----------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, sha256(nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) || 'fi12') AS query FROM conversations")
def normalized_queries(spark, sf):
    """Turns as queries, with characters behind them that only compatibility forms unite."""
    text = F.concat(F.lit("　"), "text", F.lit("ﬁ①２ "))
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2(X.normalize_query(text), 256).alias("query"))


CODES = [" EN ", "ja", "Zh-TW", "fr", "", "ko", "DE", "zh-cn"]


@query("SELECT c_custkey, CASE WHEN l NOT IN ('fr', '') THEN l END AS lang, coalesce(CASE WHEN c_custkey % 2 = 0 THEN l IN ('en', 'de', 'zh-tw', 'zh-cn', 'ko', 'ja') ELSE l IN ('en', 'ja', 'zh-tw') END, false) AS valid FROM (SELECT c_custkey, lower(trim(['" + "', '".join(CODES) + "'][1 + c_nationkey % 8])) AS l FROM customer)")
def explanation_pairs(spark, sf):
    lang = X.parse_explanation_lang(pick(CODES, 1 + F.col("c_nationkey") % 8))
    dictionary = F.when(F.col("c_custkey") % 2 == 0, "ja").otherwise("en")
    return read(spark, sf, "customer").select("c_custkey", lang.alias("lang"), F.coalesce(X.valid_pair(dictionary, lang), F.lit(False)).alias("valid"))


PARTS = ["Adj", " adv", "noun", "name", "prep", "Proper noun", "verb", "symbol", "pron"]
KEYS = ["n-1", "v", "a", "s-2", "r", "x", " n "]


@query(f"SELECT p_partkey, ['adjective', 'adverb', 'noun', NULL, 'preposition', NULL, 'verb', NULL, 'pronoun'][1 + p_size % {len(PARTS)}] AS wiktionary, ['noun', 'verb', 'adjective', 'adjective', 'adverb', NULL, 'noun'][1 + p_partkey % {len(KEYS)}] AS wordnet FROM part")
def part_of_speech_names(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.wiktionary_pos(pick(PARTS, 1 + F.col("p_size") % len(PARTS))).alias("wiktionary"), X.wordnet_pos(pick(KEYS, 1 + F.col("p_partkey") % len(KEYS))).alias("wordnet"))


@query("SELECT p_partkey, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), '|') AS qualifiers FROM (SELECT p_partkey, list_filter([p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END, p_type, p_brand, CASE WHEN p_size % 3 = 0 THEN p_name END], lambda x: x IS NOT NULL) AS q FROM part)")
def qualifier_lists(spark, sf):
    p = read(spark, sf, "part")
    tags = F.array(F.concat(F.lit(" "), "p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit("  "))
    topics = F.array(F.concat(F.col("p_type"), F.lit(" ")), F.col("p_brand"))
    note = F.when(F.col("p_size") % 3 == 0, F.col("p_name"))
    return p.select("p_partkey", F.array_join(X.qualifiers(tags, topics, note), "|").alias("qualifiers"))


NUMERIC = "regexp_full_match({0}, '\\p{{N}}+[\\p{{N}}\\p{{P}}\\s]*')"
UNSAFE = "regexp_matches({0}, '[\\p{{Cc}}]|<[^>]+>|(?i:https?://|www\\.)')"


@query(f"SELECT conv_id, turn, role, query, query <> '' AND length(query) <= 80 AND NOT {UNSAFE.format('query')} AND NOT {NUMERIC.format('query')} AND (turn % 3 <> 1) AND length(trim(text)) <= 500 AND NOT {UNSAFE.format('trim(text)')} AS good FROM (SELECT conv_id, turn, role, text, unnest(string_split(text, ' ')) AS query FROM conversations)")
def lookup_requests(spark, sf):
    """Every word of every turn as a request, the turn as its sentence, and a reading that is no kana in each third turn."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.explode(F.split("text", " ")).alias("query"))
    reading = F.when(F.col("turn") % 3 == 0, "よみ").when(F.col("turn") % 3 == 1, "yomi")
    return c.select("conv_id", "turn", "role", "query", X.is_lookup_candidate(F.col("query"), reading, F.col("text")).alias("good"))


@query("SELECT word, length(trim(word)) BETWEEN 1 AND 80 AND regexp_full_match(word, '[\\p{Latin}\\p{M}][\\p{Latin}\\p{M}''’.\\-/ ]*') AND regexp_matches(word, '\\p{L}') AND NOT regexp_matches(word, '(?i:www\\.)') AS english, length(word) <= 1 AS short FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents)")
def english_words(spark, sf):
    """All words between white space of all documents."""
    w = read(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return w.select("word", X.is_english_text(F.col("word")).alias("english"), X.is_short_ambiguous(F.col("word")).alias("short"))


@query(f"WITH {SENSES} SELECT sense_id, lang, sense_id % 3 <> 1 AND CASE lang WHEN 'ja' THEN sense_id % 2 = 0 ELSE sense_id % 2 = 1 AND (sense_id % 5) < 3 END AS complete FROM senses")
def complete_examples(spark, sf):
    """An example per sense: blank in a third of them, translated in each odd one, with a blank translation in two fifths."""
    k = F.col("sense_id")
    said = F.struct(F.col("lang"), F.when(k % 5 < 3, "so").otherwise(" ").alias("text"))
    none = F.array().cast("array<struct<lang:string,text:string>>")
    example = F.struct(F.when(k % 3 != 1, F.concat(F.lit("x"), k.cast("string"))).otherwise("　").alias("text"), F.when(k % 2 == 1, F.array(said)).otherwise(none).alias("translations"))
    return senses(spark, sf).select("sense_id", "lang", X.has_complete_example(F.array(example), "ja", F.col("lang")).alias("complete"))


@query("SELECT o_orderkey, concat_ws('|', 'p', o_orderpriority, 'v' || o_custkey, 'low', CASE WHEN o_orderkey % 3 = 0 THEN 'flex' ELSE 'unset' END, strftime(o_orderdate, '%Y-%m-%d')) AS generation_id FROM orders")
def generation_ids(spark, sf):
    o = read(spark, sf, "orders")
    tier = F.when(F.col("o_orderkey") % 3 == 0, "flex")
    return o.select("o_orderkey", X.generation_id(F.lit("p"), F.col("o_orderpriority"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")), F.lit("low"), tier, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("generation_id"))


@query("SELECT p_partkey, lower(p_type) || '␟' || p_name AS pair FROM part")
def term_pairs(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.term_pair_key(F.concat(F.lit(" "), "p_type"), F.concat("p_name", F.lit("　"))).alias("pair"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS reading FROM part")
def kanji_readings(spark, sf):
    """No kana in a fourth of the parts; else two: the first for all or for one spelling, the second for the part's name."""
    p, k = read(spark, sf, "part"), F.col("p_size") % 4
    kana = lambda text, to: F.struct(F.col(text).alias("text"), to.alias("appliesToKanji"))
    first = kana("p_brand", F.when(k == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("other"))))
    second = kana("p_type", F.when((k == 1) & (F.col("p_partkey") % 2 == 0), F.array("p_name")).otherwise(F.array().cast("array<string>")))
    both = F.array(first, second)
    return p.select("p_partkey", X.reading_for_kanji(F.when(k != 3, both).otherwise(F.slice(both, 1, 0)), F.col("p_name")).alias("reading"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' || p_type WHEN p_size % 3 = 1 THEN p_type END AS gloss FROM part")
def gloss_texts(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_size") % 3
    given = F.when(k == 0, F.array("p_name", "p_type")).when(k == 1, F.array(F.lit(None).cast("string"), F.col("p_type"))).otherwise(F.array(F.lit(" ")))
    return p.select("p_partkey", X.sense_gloss_text(given).alias("gloss"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1, 3) AS form FROM customer")
def inflection_statements(spark, sf):
    """Glosses that only say of which word they are a form, and such that say more."""
    k = F.col("c_custkey") % 4
    gloss = F.when(k == 0, F.concat(F.lit("The plural form of "), "c_name", F.lit("; more than one "), "c_name", F.lit("."))).when(k == 1, F.concat("c_mktsegment", F.lit(" is the Past  tense and the past participle of "), "c_name")).when(k == 2, F.concat(F.lit("plural of "), "c_name", F.lit("; a lexeme of its own"))).otherwise(F.concat(F.lit("alternative third-person singular or comparative of "), "c_name"))
    return read(spark, sf, "customer").select("c_custkey", X.states_only_inflection(gloss).alias("form"))


# --- evidence -----------------------------------------------------------------------------------


@query(f"WITH {EVIDENCE}, o AS (SELECT ordinal, row_number() OVER (PARTITION BY word ORDER BY ordinal) - 1 AS n FROM tr) SELECT ordinal, 'wiktionary-en:v1:' || word || ':noun:0:' || n || '#' || CASE WHEN scope = 'sense-local' THEN 'senses[0].' ELSE '' END || 'translations[0]' AS evidence_id, CASE WHEN scope = 'sense-local' OR hint = 0 THEN 's1' WHEN hint = 1 THEN 's2' END AS source_sense_id FROM rej JOIN o USING (ordinal)")
def evidence_ids(spark, sf):
    return E.evidence_rows(evidence_entries(spark, sf), "wiktionary", "en", "v1").select("ordinal", "evidence_id", "source_sense_id")


@query(f"WITH {EVIDENCE}, j AS (SELECT term, arg_min('j' || p, p) AS s FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN '銀行' ELSE 'ぎんこう' END AS term, p_partkey AS p FROM part) GROUP BY 1), t AS (SELECT s_nationkey % 5 AS k, arg_min('t' || s_suppkey, s_suppkey) AS s FROM supplier GROUP BY 1) SELECT ordinal, CASE WHEN lang = 'ja' THEN j.s ELSE t.s END AS support, lang = 'zh' AND t.s IS NOT NULL AS taiwan_support, CASE WHEN lang = 'zh' AND t.s IS NOT NULL THEN 'zh-tw' ELSE locale END AS locale FROM rej LEFT JOIN j USING (term) LEFT JOIN (SELECT word AS tw, '銀行' AS tt, s FROM (SELECT DISTINCT word FROM rej) JOIN t ON length(word) % 5 = k) t ON tw = word AND tt = rej.term")
def corroborated_evidence(spark, sf):
    """Supports of Japanese terms and of pairs of a segment and a Chinese term; of several the first by number counts."""
    ja = read(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, "銀行").otherwise("ぎんこう").alias("term"), F.concat(F.lit("j"), F.col("p_partkey").cast("string")).alias("support"), F.col("p_partkey").alias("ordinal"))
    segments = read(spark, sf, "customer").select("c_mktsegment").distinct()
    tw = read(spark, sf, "supplier").join(F.broadcast(segments), F.length("c_mktsegment") % 5 == F.col("s_nationkey") % 5)  # at most five segments
    tw = tw.select(F.col("c_mktsegment").alias("english"), F.lit("銀行").alias("chinese"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("support"), F.col("s_suppkey").alias("ordinal"))
    rows = E.corroborate(E.evidence_rows(evidence_entries(spark, sf), "wiktionary", "en", "v1"), ja, tw)
    return rows.select("ordinal", "support", "taiwan_support", "locale")


@query(f"WITH {EVIDENCE}, g AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS n FROM rej WHERE rejection IS NULL), c AS (SELECT (SELECT count(*) // 2 FROM customer) // 2 AS cap) SELECT (SELECT count(*) FROM customer) AS entries_read, (SELECT count(*) FROM customer WHERE c_custkey <= coalesce((SELECT ordinal FROM g WHERE n = cap + 1), 1e18)) AS english_entries, least(cap, (SELECT count(*) FROM g)) AS entries_with_evidence, least(cap, (SELECT count(*) FROM g)) AS rows_emitted, (SELECT count(*) FROM g) > cap AS truncated FROM c")
def evidence_totals(spark, sf):
    entries = evidence_entries(spark, sf)
    cap = entries.count() // 2 // 2
    out = E.evidence_totals(entries, E.evidence_rows(entries, "wiktionary", "en", "v1"), total=cap)
    return out.select(*(F.col(c).cast("boolean" if c == "truncated" else "long").alias(c) for c in out.columns))


# --- lookups ------------------------------------------------------------------------------------

ASKED = "asked AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS query FROM conversations)"


@query(f"WITH {ASKED}, terms AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS term, item_id FROM benchmark) SELECT query, item_id AS entry_id FROM asked JOIN terms ON query = term WHERE query <> ''")
def exact_lookup(spark, sf):
    """The words of conversations among those of benchmark items."""
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    asked = read(spark, sf, "conversations").select(F.explode(split).alias("query")).where("query <> ''")
    terms = read(spark, sf, "benchmark").select(F.explode(F.array_distinct(split)).alias("term"), F.col("item_id").alias("entry_id"))
    return L.lookup_exact(asked, terms)


@query(f"WITH {LEMMAS} SELECT surface AS query, lemma, 'e_' || lemma AS entry_id FROM lemmas")
def candidates_english(spark, sf):
    terms = lexicon(spark, sf).select("term", F.concat(F.lit("e_"), "term").alias("entry_id"))
    return L.lookup_candidates_english(tokens(spark, sf).withColumnRenamed("surface", "query"), terms)


@query(f"WITH {SURFACES}, {BENT}, {FORMS}, {RANKED}, tries AS (SELECT query, query AS term, 0 AS rank, -1 AS ord FROM surfaces UNION ALL SELECT query, term, CASE WHEN low THEN 20 ELSE 10 END, ord FROM bent2), best AS (SELECT *, min(rank) OVER (PARTITION BY query) AS tier FROM tries JOIN ranked USING (term)), once AS (SELECT *, row_number() OVER (PARTITION BY query, entry_id ORDER BY ord, place) AS n FROM best WHERE rank = tier) SELECT query, entry_id, (row_number() OVER (PARTITION BY query ORDER BY ord, place))::BIGINT AS place FROM once WHERE n = 1")
def candidates_japanese(spark, sf):
    return L.lookup_candidates_japanese(surfaces(spark, sf), forms(spark, sf), ja_entries(spark, sf)).select("query", "entry_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {LEMMAS} SELECT surface, surface || CASE length(surface) % 3 WHEN 0 THEN 's' WHEN 1 THEN 'ed' ELSE 'x' END AS input, length(surface) % 3 <> 2 AS related FROM tokens")
def related_headwords(spark, sf):
    """Surfaces proposed for inputs that are inflections of them, and for others."""
    ends = F.element_at(F.array(F.lit("s"), F.lit("ed"), F.lit("x")), (1 + F.length("surface") % 3).cast("int"))
    rows = tokens(spark, sf).select("surface", F.concat("surface", ends).alias("input"))
    return rows.withColumn("related", L.related_headword(F.col("surface"), [F.col("input"), F.lit(" "), F.lit(None).cast("string")], "en"))


# --- order, guards, tallies ---------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) - 1 AS entry_order, (sum(o_orderkey) OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) - o_orderkey)::BIGINT AS before FROM orders")
def entry_order(spark, sf):
    """A running number and a running sum in an order whose first keys have few values."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return O.global_numbers(o, ["o_orderpriority", "o_orderstatus", "o_orderkey"], {"entry_order": F.lit(1), "before": F.col("o_orderkey")}).select("o_orderkey", "entry_order", "before")


@query(f"WITH {SENSES}, {ENTRIES}, g AS (SELECT DISTINCT entry_id, lang FROM senses WHERE generation_id IS NOT NULL AND entry_id NOT IN (SELECT entry_id FROM prod WHERE source = 'generated')) SELECT (SELECT count(*) FROM prod WHERE source = 'generated' AND entry_id % 5 <> 0) AS entries, (SELECT count(*) FROM g WHERE entry_id % 5 <> 0) AS groups, (SELECT count(*) FROM examples x WHERE x.sense_id % 8 = 0 AND x.sense_id NOT IN (SELECT sense_id FROM senses JOIN g USING (entry_id, lang)) AND x.sense_id NOT IN (SELECT sense_id FROM senses WHERE entry_id IN (SELECT entry_id FROM prod WHERE source = 'generated'))) AS examples")
def accepted_content(spark, sf):
    return T.accepted_content(prod(spark, sf), senses(spark, sf), examples(spark, sf), prod(spark, sf).where("entry_id % 5 = 0"))


@query("SELECT s.stage, o.outcome, count(c_custkey) AS n FROM (VALUES ('examples', 1), ('fallback', 2), ('secondary', 3)) s(stage, i), LATERAL (SELECT unnest(CASE i WHEN 1 THEN ['imported', 'unmatched', 'ambiguous', 'invalid'] WHEN 2 THEN ['entries', 'senses', 'reference-only'] ELSE ['imported', 'dropped'] END) AS outcome) o LEFT JOIN customer ON c_custkey % 3 + 1 = i AND outcome = CASE WHEN i = 1 AND c_nationkey % 2 = 0 THEN 'imported' WHEN i = 1 THEN 'ambiguous' WHEN i = 2 THEN 'senses' ELSE 'dropped' END GROUP BY 1, 2")
def stage_counters(spark, sf):
    i = F.col("c_custkey") % 3
    outcome = F.when((i == 0) & (F.col("c_nationkey") % 2 == 0), "imported").when(i == 0, "ambiguous").when(i == 1, "senses").otherwise("dropped")
    tagged = read(spark, sf, "customer").select(pick(["examples", "fallback", "secondary"], i + 1).alias("stage"), outcome.alias("outcome"))
    return S.import_stats(tagged, {k: S.STAGES[k] for k in ("examples", "fallback", "secondary")})


@query("SELECT c_mktsegment AS lang, count(*) FILTER (WHERE e AND NOT r) AS eligible, count(*) FILTER (WHERE e AND NOT r AND m) AS imported, count(*) FILTER (WHERE NOT e AND NOT r) AS evidence_only, count(*) FILTER (WHERE e AND NOT r AND NOT m) AS unmatched, count(*) FILTER (WHERE r) AS rejected FROM (SELECT c_mktsegment, c_custkey % 5 = 0 AS r, c_custkey % 2 = 0 AS e, c_nationkey % 3 <> 0 AS m FROM customer) GROUP BY 1")
def language_import_stats(spark, sf):
    k = F.col("c_custkey")
    return S.language_import_stats(read(spark, sf, "customer").select(F.col("c_mktsegment").alias("lang"), (k % 5 == 0).alias("rejected"), F.when(k % 2 == 0, "direct-import").otherwise("authoring-evidence").alias("role"), (F.col("c_nationkey") % 3 != 0).alias("matched")))


@query("SELECT p_partkey || '/0' AS key, 'headword' AS problem FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey || '/0', 'part-of-speech-not-in-vocabulary' FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO') UNION ALL SELECT p_partkey::VARCHAR, 'source-left-out' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey::VARCHAR, 'unknown-source' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey::VARCHAR, 'pronunciation-lost' FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey || '/0', 'no-glosses' FROM part WHERE p_size % 3 = 0")
def authored_english(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_size")
    who = F.col("p_partkey").alias("candidate_id")
    c = p.select(who, F.lit(0).alias("sense_no"), F.when(k % 7 == 0, F.lit("7up!")).otherwise(F.col("p_name")).alias("headword"), F.col("p_type").alias("pos"), F.array(F.when(k % 5 == 0, "made-up").otherwise("oewn")).alias("sources"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("ipa"), F.array(F.when(k % 3 == 0, " ").otherwise("a thing")).alias("glosses"))
    one = lambda v: p.select(who, F.lit(v).alias("value"))
    known = p.select(F.lit("pos").alias("kind"), F.col("p_type").alias("code")).where("code in ('ECONOMY', 'PROMO')")
    return V.validate_authored_english(c, one("oewn"), one("a"), known).select(F.col("key").cast("string").alias("key"), "problem")


@query("SELECT conv_id || '/' || turn || '/' || role AS key, 'headword-not-used' AS problem FROM conversations WHERE NOT list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), ['the', 'thes', 'thees', 'theed', 'theing']) UNION ALL SELECT conv_id || '/' || turn || '/' || role, 'language' FROM conversations WHERE trim(text) = '' OR regexp_matches(text, '[\\p{Hiragana}\\p{Katakana}\\p{Han}\\p{Hangul}]')")
def example_problems(spark, sf):
    c = read(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("example_id"), "text")
    return V.validate_examples(c, X.english_sentence_contains(F.col("text"), F.lit("the")), X.invalid_explanation_text(F.lit("en"), F.col("text"))).select(F.col("key").cast("string").alias("key"), "problem")


GRAFTED = f"{SENSES}, {ENTRIES}, rs AS (SELECT * FROM senses WHERE sense_id % 2 = 0 AND entry_id IN (SELECT entry_id FROM rel)), moved AS (SELECT p.entry_id, min(r.entry_id) AS replacement FROM prod p JOIN rel r USING (term) WHERE p.source = 'generated' GROUP BY p.entry_id), whole AS (SELECT sense_id FROM senses WHERE entry_id IN (SELECT entry_id FROM prod WHERE source = 'generated' AND entry_id NOT IN (SELECT entry_id FROM moved))), ours AS (SELECT s.sense_id, coalesce(m.replacement, s.entry_id) AS entry_id, s.lang, s.entry_id AS origin FROM senses s JOIN (SELECT DISTINCT entry_id, lang FROM senses WHERE generation_id IS NOT NULL) g USING (entry_id, lang) LEFT JOIN moved m USING (entry_id) WHERE s.sense_id NOT IN (SELECT sense_id FROM whole)), free AS (SELECT o.* FROM ours o WHERE entry_id IN (SELECT entry_id FROM rel) AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.entry_id = o.entry_id AND rs.lang = o.lang)), kept AS (SELECT sense_id, entry_id, lang FROM (SELECT *, min(origin) OVER (PARTITION BY entry_id, lang) AS m FROM free) WHERE origin = m)"


@query(f"WITH {GRAFTED}, s AS (SELECT sense_id FROM rs UNION ALL SELECT sense_id FROM kept UNION ALL SELECT sense_id FROM whole), k AS (SELECT sense_id FROM kept UNION SELECT sense_id FROM whole) SELECT 'entries' AS kind, entry_id AS id, 0 AS position FROM rel UNION ALL SELECT 'entries', entry_id, 0 FROM prod WHERE source = 'generated' AND entry_id NOT IN (SELECT entry_id FROM moved) UNION ALL SELECT 'senses', sense_id, 0 FROM s UNION ALL SELECT DISTINCT 'glosses', sense_id, position FROM glosses WHERE sense_id IN (SELECT sense_id FROM rs) OR sense_id IN (SELECT sense_id FROM k) UNION ALL SELECT 'examples', sense_id, position FROM examples WHERE sense_id IN (SELECT sense_id FROM s)")
def graft_tables(spark, sf):
    """All four tables after a graft; every example is authored, so it comes back wherever its sense stands."""
    s, g, x = senses(spark, sf), glosses(spark, sf), examples(spark, sf)
    rs = s.where("sense_id % 2 = 0").join(rel(spark, sf).select("entry_id"), "entry_id", "left_semi").select(s.columns)
    own = lambda t: t.join(rs.select("sense_id"), "sense_id", "left_semi")
    out = T.graft_tables({"entries": prod(spark, sf), "senses": s, "glosses": g, "examples": x}, {"entries": rel(spark, sf), "senses": rs, "glosses": own(g), "examples": own(x).where("false")}, ("1", "2"))
    one = lambda kind, key, place: out[kind].select(F.lit(kind).alias("kind"), F.col(key).alias("id"), place.alias("position"))
    return one("entries", "entry_id", F.lit(0)).unionByName(one("senses", "sense_id", F.lit(0))).unionByName(one("glosses", "sense_id", F.col("position"))).unionByName(one("examples", "sense_id", F.col("position")))


# --- sources and sinks: written from the tables, and read back ----------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def jsonl_round_trip(spark, sf):
    """Customers as lines of JSON in key order, with a blank line behind each and a mistyped name in each seventh."""
    path = folder(spark, "jsonl")
    named = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit('{"c_custkey":'), F.col("c_custkey").cast("string"), F.lit(',"c_name":["x"],"c_acctbal":'), F.col("c_acctbal").cast("string"), F.lit("}"))).otherwise(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")))
    P.in_release_order(read(spark, sf, "customer"), "c_custkey").select(F.concat(named, F.lit("\n\n")).alias("value")).write.text(path)
    rows = I.read_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double")
    rows = rows.withColumn("c_name", F.when(~F.col("c_name").startswith("["), F.col("c_name")))
    rows = rows.select("c_custkey", "c_name", "c_acctbal", F.col("ordinal.file").alias("file"), F.col("ordinal.block").alias("block"), F.col("ordinal.place").alias("n"))
    return O.global_number(rows, ["file", "block", "n"], "place").select("c_custkey", "c_name", "c_acctbal", "place")


@query("SELECT n_name AS key, n_regionkey AS region FROM nation JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = n_nationkey")
def keyed_json_round_trip(spark, sf):
    """One file per region that has suppliers: a JSON object of nations."""
    path = folder(spark, "keyed")
    n = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().join(read(spark, sf, "nation"), "n_nationkey")
    each = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct("n_regionkey")))).alias("m"))  # a region has few nations
    each.repartition("n_regionkey").select(F.to_json("m").alias("value"), F.col("n_regionkey").alias("r")).write.partitionBy("r").text(path)
    return I.read_keyed_json(spark, f"{path}/r=*/*.txt", "struct<n_regionkey:long>").select("key", F.col("value.n_regionkey").alias("region"))


@query("SELECT o_custkey::VARCHAR AS entry_id, (1 + o_orderkey % 5)::INT AS n, count(*) AS rows FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1, 2")
def level_lists_round_trip(spark, sf):
    """Orders as five level lists; each thirteenth row has no number for an id."""
    path = folder(spark, "levels")
    o = read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 13 == 0, "x1").otherwise(F.col("o_custkey").cast("string")).alias("jmdict_seq"), F.lit("か").alias("kana"), F.lit("").alias("kanji"), F.col("o_orderpriority").alias("waller_definition"), (1 + F.col("o_orderkey") % 5).alias("n"))
    for n in range(1, 6):
        o.where(F.col("n") == n).drop("n").write.option("header", True).csv(f"{path}/n{n}.csv")
    return I.read_level_lists(spark, path).groupBy("entry_id", "n").agg(F.count("*").alias("rows"))


@query("SELECT c_custkey::VARCHAR AS evidence_id, 'Customer' AS source, c_name AS headword, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS reading FROM customer")
def evidence_index_round_trip(spark, sf):
    path = folder(spark, "index")
    c = read(spark, sf, "customer")
    empty = F.array().cast("array<string>")
    sense = F.struct(F.col("c_custkey").cast("string").alias("evidenceId"), empty.alias("partOfSpeech"))
    c.select(F.to_json(F.struct(F.lit("Customer").alias("source"), F.col("c_custkey").cast("string").alias("sourceEntryId"), F.col("c_name").alias("headword"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("reading"), F.array(sense).alias("senses"))).alias("value")).write.text(path)
    return I.read_evidence_index(spark, [path]).select("evidence_id", "source", "headword", "reading")


@query(f"WITH {SENSES} SELECT sense_id, entry_id, lang FROM senses")
def canonical_snapshot(spark, sf):
    """Tables written as canonical Parquet, and of three two carried into a snapshot."""
    a, b = folder(spark, "canonical"), folder(spark, "snapshot")
    I.write_canonical({"senses": senses(spark, sf), "glosses": glosses(spark, sf), "attempts": examples(spark, sf)}, a)
    I.snapshot_tables(spark, a, b, ["senses", "glosses"])
    got = I.read_canonical(spark, b, ["senses", "glosses"])
    return got["senses"].select("sense_id", "entry_id", "lang")


@query(f"WITH {SENSES} SELECT entry_id, string_agg(lang || ':' || n, ',' ORDER BY lang) AS languages, dense_rank() OVER (ORDER BY entry_id) - 1 AS place FROM (SELECT entry_id, lang, count(*) AS n FROM senses GROUP BY 1, 2) GROUP BY entry_id")
def release_jsonl(spark, sf):
    """The release as JSON lines, read back: languages with their number of senses, and the place of the line over all files."""
    path = folder(spark, "release")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("text"), F.lit(True).alias("common"), F.lit("kana").alias("kind"))
    s = senses(spark, sf)
    own = lambda t: t.join(s.select("sense_id", "entry_id"), "sense_id")
    P.export_jsonl(P.nest_entries(c, c, s, own(glosses(spark, sf)), own(examples(spark, sf))), path)
    lines = I.with_ordinal(spark.read.text(path)).select(F.from_json("value", "entry_id long, languages map<string,array<struct<sense_id:long>>>").alias("e"), "ordinal").select("e.*", "ordinal")
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("languages"), lambda x: F.concat_ws(":", x["key"], F.size(x["value"]).cast("string")))), ",")
    flat = lines.select("entry_id", listed.alias("languages"), F.col("ordinal.file").alias("file"), F.col("ordinal.place").alias("n"))
    return O.global_number(flat, ["file", "n"], "place").select("entry_id", "languages", "place")


@query("SELECT * FROM (SELECT ordinal, term, row_number() OVER (ORDER BY ordinal) - 1 AS place FROM (SELECT c_custkey AS ordinal, c_mktsegment AS term FROM customer))")
def evidence_jsonl(spark, sf):
    """Evidence written as ordered lines, read back in their order."""
    path = folder(spark, "evidence")
    I.write_evidence(read(spark, sf, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("term")), path, ["ordinal"])
    lines = I.with_ordinal(spark.read.text(path)).select(F.from_json("value", "ordinal long, term string").alias("e"), F.col("ordinal.file").alias("file"), F.col("ordinal.place").alias("n"))
    return O.global_number(lines, ["file", "n"], "place").select("e.ordinal", "e.term", "place")


@query("SELECT event_type AS outcome, user_id, count(*) AS n, sum(event_id % 100)::BIGINT AS input_tokens FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2")
def attempt_log(spark, sf):
    """Events appended to the attempt log of two dictionaries in two steps, and one of them read."""
    path = folder(spark, "attempts")
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("traceId"), F.col("event_type").alias("outcome"), (F.col("event_id") % 100).alias("inputTokens")))
    rows = read(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "ja").otherwise("en").alias("dictionary"), body.alias("attempt_json"), F.col("event_id").alias("id"))
    I.append_attempts(rows.where("id % 2 = 0"), path)
    I.append_attempts(rows.where("id % 2 = 1"), path)
    return I.read_attempts(spark, path, "ja").groupBy("outcome", F.col("traceId").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.sum("inputTokens").alias("input_tokens"))


@query(f"WITH {SENSES} SELECT count(DISTINCT lang) AS languages, count(*) AS senses, (SELECT count(*) FROM glosses) AS glosses, true AS verified, '2' AS schema FROM senses")
def release_manifest(spark, sf):
    """A staged release with checksums and a manifest; its files are verified against the checksums the manifest states."""
    path, s = folder(spark, "published"), senses(spark, sf)
    I.publish_staged(spark, lambda p: s.select(F.to_json(F.struct("*")).alias("value")).write.text(p), lambda p: spark.read.text(p).limit(1).count(), path)
    sums = I.file_checksums(spark, f"{path}/part-*")
    sources = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("role"))
    P.write_manifest(f"{path}-manifest", S.language_coverage(s, glosses(spark, sf), examples(spark, sf)), {"senses": s, "glosses": glosses(spark, sf)}, sources, sums, {"schema": "2"})
    kind = "schema string, rows struct<senses:long,glosses:long>, coverage map<string,struct<senses:long>>, artifacts array<struct<file:string,sha256:string,bytes:long>>"
    m = spark.read.text(f"{path}-manifest").select(F.from_json("value", kind).alias("m")).select("m.*")
    wrong = I.verify_checksums(sums, m.select(F.inline("artifacts"))).agg(F.count("*").alias("wrong"))
    return m.crossJoin(wrong).select(F.size("coverage").cast("long").alias("languages"), F.col("rows.senses").alias("senses"), F.col("rows.glosses").alias("glosses"), (F.col("wrong") == 0).alias("verified"), "schema")  # one row each


@query("SELECT s_nationkey AS n, 'nation' || s_nationkey AS key, count(*) AS value FROM supplier GROUP BY 1")
def metadata_rows(spark, sf):
    """Counts of the suppliers by nation as metadata rows."""
    counts = {f"nation{r[0]}": r[1] for r in read(spark, sf, "supplier").groupBy("s_nationkey").count().collect()}  # as many as there are nations
    m = I.build_metadata(spark, counts)
    return m.select(F.substring("key", 7, 9).cast("long").alias("n"), "key", F.col("value").cast("long").alias("value"))


@query(f"WITH {SENSES}, r AS (SELECT s_suppkey AS ordinal, s_suppkey * 3 AS sense_id, ['ko', 'en', 'fr'][1 + s_suppkey % 3] AS lang FROM supplier), j AS (SELECT r.*, s.entry_id FROM r JOIN senses s USING (sense_id) WHERE r.lang <> 'fr' AND NOT EXISTS (SELECT 1 FROM senses h WHERE h.entry_id = s.entry_id AND h.lang = r.lang)) SELECT sense_id, entry_id, lang, 1 AS position, 'g' || ordinal AS text FROM j UNION ALL SELECT sense_id, entry_id, lang, 2, 'second' FROM j WHERE ordinal % 2 = 0")
def attached_legacy_glosses(spark, sf):
    """The glosses that come in: blank ones are passed over, and the places of the others close up."""
    k = F.col("s_suppkey")
    given = F.array(F.concat(F.lit("g"), k.cast("string")), F.lit("  "), F.when(k % 2 == 0, F.lit("second")))
    rows = read(spark, sf, "supplier").select(k.alias("ordinal"), (k * 3).alias("sense_id"), pick(["ko", "en", "fr"], 1 + k % 3).alias("lang"), given.alias("glosses"))
    return M.attach_legacy_glosses(rows, senses(spark, sf), ["en", "ko", "ja"])[0].select("sense_id", "entry_id", "lang", "position", "text")


@query(f"WITH {EVIDENCE} SELECT word, term, lang, scope, ambiguity::INT AS ambiguity, rejection, count(*) AS n FROM rej GROUP BY ALL")
def stream_evidence(spark, sf):
    """The evidence filter as a stream over the dump's files, as far as they are there now, into a table."""
    path = folder(spark, "stream")
    evidence_entries(spark, sf).drop("ordinal").write.json(f"{path}/in")
    rows = ST.stream_evidence(ST.read_stream(spark, f"{path}/in", 16), "wiktionary", "en", "v1")
    job = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("word", "term", "lang", "scope", F.size("ambiguity").alias("ambiguity"), "rejection").agg(F.count("*").alias("n"))


@query("SELECT p_brand || ':' || p_partkey AS id, p_name AS kana, p_type AS gloss, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal FROM part")
def lexicon_round_trip(spark, sf):
    """A lexicon document for each brand of parts, its words in key order, read back."""
    path = folder(spark, "lexicon")
    gloss = F.struct(F.lit("eng").alias("lang"), F.col("p_type").alias("text"))
    word = F.struct(F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.array(F.struct(F.col("p_name").alias("text"), F.lit(True).alias("common"))).alias("kana"), F.array(F.struct(F.array(gloss).alias("gloss"))).alias("sense"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", word.alias("w")))), lambda x: x["w"])
    docs = read(spark, sf, "part").groupBy("p_brand").agg(listed.alias("words"))  # the format has all words of a document in one value
    docs.repartition("p_brand").select(F.to_json(F.struct(F.lit("1").alias("version"), "words")).alias("value"), F.translate("p_brand", "#", "_").alias("b")).write.partitionBy("b").text(path)
    words, _ = I.read_lexicon_json(spark, f"{path}/b=*/*.txt")
    return words.select("id", F.col("kana")[0]["text"].alias("kana"), F.col("sense")[0]["gloss"][0]["text"].alias("gloss"), F.col("ordinal").cast("long").alias("ordinal"))
