"""All queries of the library over the given tables, and the SQL that states the same.

The tables hold no dictionary, so each query shapes them first: tokens of documents are surfaces,
parts are entries, orders are senses, events are attempts, and so on. Shapes are written once in
Spark (functions named after what they make) and once in SQL (WITH clauses of the same names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import evidence as E
from ..operators import lookup as L
from ..operators import merge as M
from ..operators import order as O
from ..operators import release as P
from ..operators import retain as T
from ..operators import stats as S
from ..operators import validate as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more, running, stores, terms  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more, running, stores, terms  # noqa: F401

    return dict(_SQL)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- shapes -------------------------------------------------------------------------------------

COUNTED = "counted AS (SELECT t AS term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS t FROM documents) WHERE t <> '' GROUP BY t)"
TOKENS = COUNTED + ", tokens AS (SELECT term AS surface FROM counted)"
LEXICON = "lexicon AS (SELECT term FROM counted WHERE n >= 3)"


def counted(spark: SparkSession, sf: str) -> DataFrame:
    """The words of all documents with their number. Surfaces and lexicon are both filters on it, so that the documents are read and shuffled once."""
    words = read(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("surface")).where("surface <> ''")
    return words.groupBy("surface").agg(F.count("*").alias("n"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return counted(spark, sf).where("n >= 1").select("surface")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return counted(spark, sf).where("n >= 3").select(F.col("surface").alias("term"))


def _english_case(s: str) -> str:
    """The suffix rules as a SQL list, in order, with nulls where a rule does not fit."""
    out = []
    for suffix, replacement in R.ENGLISH_SUFFIXES:
        n = len(suffix)
        stem = f"left({s}, length({s}) - {n})"
        fits = f"{s} LIKE '%{suffix}' AND length({s}) > {n}"
        out.append(f"CASE WHEN {fits} THEN {stem} || '{replacement}' END")
        if not replacement:
            out.append(f"CASE WHEN {fits} AND length({s}) - {n} > 2 AND substr({s}, length({s}) - {n}, 1) = substr({s}, length({s}) - {n} - 1, 1) AND substr({s}, length({s}) - {n}, 1) IN ({', '.join(repr(c) for c in R.DOUBLED)}) THEN left({s}, length({s}) - {n} - 1) END")
    return "[" + ", ".join(out) + "]"


CANDIDATES = f"cand AS (SELECT surface, list_filter({_english_case('surface')}, lambda x: x IS NOT NULL AND x <> surface) AS c FROM tokens)"
LEMMAS = f"{TOKENS}, {LEXICON}, {CANDIDATES}, tried AS (SELECT surface, unnest(list_concat([surface], c)) AS term, generate_subscripts(list_concat([surface], c), 1) AS rank FROM cand), lemmas AS (SELECT surface, arg_min(term, rank) AS lemma FROM tried JOIN lexicon USING (term) GROUP BY surface)"


# --- English morphology and lookup --------------------------------------------------------------


@query(f"WITH {TOKENS}, {CANDIDATES} SELECT surface, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS candidates, len(list_filter(c, lambda x, i: list_position(c, x) = i))::BIGINT AS n FROM cand")
def english_candidates(spark, sf):
    c = X.english_lemma_candidates(F.col("surface"))
    return tokens(spark, sf).select("surface", F.array_join(c, ",").alias("candidates"), F.size(c).cast("long").alias("n"))


@query(f"WITH {LEMMAS} SELECT surface, lemma FROM tokens LEFT JOIN lemmas USING (surface)")
def resolve_lemma(spark, sf):
    return L.resolve_lemma(tokens(spark, sf), lexicon(spark, sf))


def _terms(spark, sf):
    return lexicon(spark, sf).select("term", F.concat(F.lit("e_"), "term").alias("entry_id"))


def _term_senses(spark, sf):
    return _terms(spark, sf).select("entry_id", F.when(F.length("term") % 3 == 0, "ja").otherwise("en").alias("lang"))


@query(f"WITH {LEMMAS} SELECT surface AS query, lemma, 'e_' || lemma AS entry_id FROM lemmas WHERE length(lemma) % 3 <> 0")
def lookup_english(spark, sf):
    return L.lookup_english(tokens(spark, sf).withColumnRenamed("surface", "query"), _terms(spark, sf), _term_senses(spark, sf), "en")


@query(f"WITH {LEMMAS}, asked AS (SELECT conv_id, turn, role, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS surface FROM (SELECT conv_id, turn, role, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM conversations)), ends AS (SELECT *, surface || 'zz' AS query, CASE WHEN place % 2 = 0 THEN surface END AS lemma_given FROM asked WHERE surface <> '') SELECT conv_id, turn, role, place, CASE WHEN place % 3 = 0 THEN query ELSE e.surface END AS query, CASE WHEN place % 3 <> 0 OR place % 2 = 0 THEN CASE WHEN length(l.lemma) % 3 <> 0 THEN 'e_' || l.lemma END END AS entry_id, '' AS alternatives FROM ends e LEFT JOIN lemmas l ON l.surface = e.surface")
def lookup_batch(spark, sf):
    """One answer for every word of every turn; each third word is asked misspelled, half of those with their lemma. Misses stay null, repeats repeat."""
    req = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("place", "word")).where("word <> ''")
    wrong = F.col("place") % 3 == 0
    req = req.select("conv_id", "turn", "role", "place", F.when(wrong, F.concat("word", F.lit("zz"))).otherwise(F.col("word")).alias("query"), F.when(F.col("place") % 2 == 0, F.col("word")).alias("lemma"))
    req = req.withColumn("request_no", F.struct("conv_id", "turn", "role", "place"))
    asked = req.select("query").unionByName(req.where("lemma is not null").select(F.col("lemma").alias("query"))).distinct()
    known = tokens(spark, sf).withColumnRenamed("surface", "query")
    hits = L.lookup_english(asked.join(known, "query", "left_semi"), _terms(spark, sf), _term_senses(spark, sf), "en").withColumn("place", F.lit(1))
    return L.lookup_batch(req, hits).select("request_no.conv_id", "request_no.turn", "request_no.role", "request_no.place", "query", "entry_id", "alternatives")


@query(f"WITH {LEMMAS} SELECT surface AS headword, term AS base FROM (SELECT surface, arg_min(term, rank) AS term FROM tried JOIN lexicon USING (term) WHERE rank > 1 GROUP BY surface)")
def inflected_proposals(spark, sf):
    return L.inflected_proposals(tokens(spark, sf).withColumnRenamed("surface", "headword"), lexicon(spark, sf), X.english_lemma_candidates(F.col("headword")))


@query("SELECT count(*) AS terms, count(*) FILTER (WHERE n = 1) AS single, round(count(*) FILTER (WHERE n = 1) / count(*), 9) AS share FROM (SELECT t, count(DISTINCT source) AS n FROM (SELECT source, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS t FROM documents) WHERE t <> '' GROUP BY t)")
def single_entry_share(spark, sf):
    """Words as terms, the sources that use them as entries."""
    terms = read(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term"), F.col("source").alias("entry_id")).where("term <> ''")
    return S.single_entry_share(terms).withColumn("share", F.round("share", 9))


# --- Japanese morphology and lookup -------------------------------------------------------------

STEMS = ["食べ", "書か", "読み", "見", "話し", "高", "行っ", "飲ん", "泳い", "知っ", "買わ", "待た"]
ENDS = ["ました", "ない", "た", "て", "られる", "くなかった", "ます", "だ", "って", "んだ", "なかった", "られました", "る", ""]
_VALUES = ", ".join(f"({i}, '{s}', '{r}', '{w}')" for i, s, r, w in R.japanese_suffixes())
SURFACES = f"{COUNTED}, surfaces AS (SELECT term || [{', '.join(repr(s) for s in ENDS)}][1 + length(term) % {len(ENDS)}] AS query FROM counted UNION SELECT [{', '.join(repr(s) for s in STEMS)}][1 + o_orderkey % {len(STEMS)}] || [{', '.join(repr(s) for s in ENDS)}][1 + (o_orderkey // 12 + o_custkey) % {len(ENDS)}] AS query FROM orders)"
BENT = f"jrules(ord, suffix, repl, reason) AS (VALUES {_VALUES}), bent AS (SELECT query, left(query, length(query) - length(suffix)) || repl AS term, ord, reason FROM surfaces JOIN jrules ON ends_with(query, suffix) AND length(query) > length(suffix)), bent2 AS (SELECT query, term, min(ord) AS ord, arg_min(reason, ord) AS reason, array_to_string(list_distinct(list(reason ORDER BY ord)), '') AS any_reason, bool_or(reason LIKE '%potential%' OR reason LIKE '%passive%') AS low FROM bent WHERE term <> query GROUP BY query, term)"


def surfaces(spark, sf):
    """The words of all documents, and stems by the orders' keys, with Japanese endings."""
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), i.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ordered = read(spark, sf, "orders").select(F.concat(pick(STEMS, 1 + k % len(STEMS)), pick(ENDS, 1 + (F.floor(k / 12) + c) % len(ENDS))).alias("query"))
    return tokens(spark, sf).select(F.concat("surface", pick(ENDS, 1 + F.length("surface") % len(ENDS))).alias("query")).unionByName(ordered).distinct()


@query(f"WITH {SURFACES}, {BENT} SELECT query, term, reason, CASE WHEN low THEN 20 ELSE 10 END AS rank FROM bent2")
def deinflect(spark, sf):
    rows = surfaces(spark, sf).select("query", F.explode(X.deinflect(F.col("query"))).alias("c"))
    return rows.select("query", F.col("c.text").alias("term"), F.col("c.reasons")[0].alias("reason"), X.deinflection_rank(F.col("c.reasons")).alias("rank"))


KANA = ["食べる", "書く", "読む", "見る", "話す", "高い", "行う", "飲む", "泳ぐ", "知る", "買う", "待つ", "行く", "話した", "見た"]
FORMS = f"forms AS (SELECT p_partkey AS entry_id, [{', '.join(repr(s) for s in KANA)}][1 + p_partkey % {len(KANA)}] AS text, CASE WHEN p_size % 4 = 0 THEN 'kanji' ELSE 'kana' END AS kind, p_size % 3 = 0 AS common, p_size FROM part), ja_entries AS (SELECT p_partkey AS entry_id, CASE WHEN p_size % 6 = 0 THEN 6 ELSE 5 - (p_size % 6) END AS lv, p_partkey % 4 AS l FROM part)"
RANKED = "ranked AS (SELECT text AS term, entry_id, row_number() OVER (PARTITION BY text ORDER BY common DESC, lv, entry_id) AS place FROM forms JOIN ja_entries USING (entry_id))"


def forms(spark, sf):
    pick = F.element_at(F.array(*map(F.lit, KANA)), (1 + F.col("p_partkey") % len(KANA)).cast("int"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), pick.alias("text"), F.lit(None).cast("string").alias("reading"), F.when(F.col("p_size") % 4 == 0, "kanji").otherwise("kana").alias("kind"), (F.col("p_size") % 3 == 0).alias("common"))


def ja_entries(spark, sf):
    level = F.when(F.col("p_size") % 6 != 0, F.concat(F.lit("N"), (F.col("p_size") % 6).cast("string")))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), level.alias("level"), (F.col("p_partkey") % 4).alias("l"))


@query(f"WITH {FORMS}, {RANKED} SELECT term, entry_id, term AS headword, place::BIGINT AS place FROM ranked")
def rank_entries(spark, sf):
    return L.rank_entries(forms(spark, sf), ja_entries(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SURFACES}, {BENT}, {FORMS}, {RANKED}, tries AS (SELECT query, query AS term, 0 AS rank, -1 AS ord, NULL AS reason FROM surfaces UNION ALL SELECT query, term, CASE WHEN low THEN 20 ELSE 10 END, ord, reason FROM bent2), hits AS (SELECT query, term, rank, ord, reason, entry_id, place FROM tries JOIN ranked USING (term) JOIN ja_entries USING (entry_id) WHERE l <> 0), best AS (SELECT *, min(rank) OVER (PARTITION BY query) AS tier FROM hits), once AS (SELECT *, row_number() OVER (PARTITION BY query, entry_id ORDER BY ord, place) AS n FROM best WHERE rank = tier) SELECT query, entry_id, (row_number() OVER (PARTITION BY query ORDER BY ord, place))::BIGINT AS place, term, reason FROM once WHERE n = 1")
def lookup_japanese(spark, sf):
    e = ja_entries(spark, sf)
    senses = e.select("entry_id", F.when(F.col("l") != 0, "en").otherwise("ko").alias("lang"))
    return L.lookup_japanese(surfaces(spark, sf), forms(spark, sf), e, senses, "en").withColumn("place", F.col("place").cast("long"))


# --- senses from orders -------------------------------------------------------------------------

SENSES = "senses AS (SELECT o_orderkey AS sense_id, o_custkey AS entry_id, ['en', 'ja', 'zh-tw'][1 + o_orderkey % 3] AS lang, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 5 = 0 THEN 'generated' ELSE 'source' END AS provenance, CASE WHEN o_orderkey % 5 = 0 THEN 'g' || (o_orderkey % 7) END AS generation_id FROM orders), glosses AS (SELECT o_orderkey AS sense_id, 1 AS position, o_orderpriority AS text FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 2, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0), examples AS (SELECT o_orderkey AS sense_id, 1 AS position, 'x' || o_orderkey AS text FROM orders WHERE o_orderkey % 4 = 0)"


def senses(spark, sf):
    o = read(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("sense_id"), F.col("o_custkey").alias("entry_id"), F.element_at(F.array(F.lit("en"), F.lit("ja"), F.lit("zh-tw")), (1 + F.col("o_orderkey") % 3).cast("int")).alias("lang"),
        F.when(F.col("o_orderkey") % 5 == 0, "generated").otherwise("source").alias("provenance"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("g"), (F.col("o_orderkey") % 7).cast("string"))).alias("generation_id"),
    )
    return O.positions(rows, ["entry_id", "lang"], "sense_id")


def glosses(spark, sf):
    o = read(spark, sf, "orders").where("o_orderkey % 11 <> 0")
    return o.select(F.col("o_orderkey").alias("sense_id"), F.lit(1).alias("position"), F.col("o_orderpriority").alias("text")).unionByName(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("sense_id"), F.lit(2).alias("position"), F.col("o_orderstatus").alias("text")))


def examples(spark, sf):
    o = read(spark, sf, "orders").where("o_orderkey % 4 = 0")
    return o.select(F.col("o_orderkey").alias("sense_id"), F.lit(1).alias("position"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("text"), F.lit("generated").alias("source"), F.when(F.col("o_orderkey") % 8 == 0, "g1").alias("generation_id"))


@query(f"WITH {SENSES} SELECT sense_id, entry_id, lang, position::BIGINT AS position FROM senses")
def sense_positions(spark, sf):
    return senses(spark, sf).select("sense_id", "entry_id", "lang", F.col("position").cast("long").alias("position"))


@query(f"WITH {SENSES}, g AS (SELECT lang, count(*) AS n FROM glosses JOIN senses USING (sense_id) GROUP BY lang), x AS (SELECT lang, count(*) AS n FROM examples JOIN senses USING (sense_id) GROUP BY lang) SELECT s.lang, count(DISTINCT entry_id) AS entries, count(*) AS senses, any_value(g.n) AS glosses, any_value(x.n) AS examples FROM senses s LEFT JOIN g USING (lang) LEFT JOIN x USING (lang) GROUP BY s.lang")
def language_coverage(spark, sf):
    return S.language_coverage(senses(spark, sf), glosses(spark, sf), examples(spark, sf))


@query(f"WITH {SENSES} SELECT DISTINCT lang FROM senses")
def languages_present(spark, sf):
    return S.languages_present(senses(spark, sf))


@query(f"WITH {SENSES}, f AS (SELECT c_custkey AS entry_id, c_name AS form FROM customer), g AS (SELECT sense_id, string_agg(text, '/' ORDER BY position) AS g FROM glosses GROUP BY sense_id), x AS (SELECT sense_id, string_agg(text, '/' ORDER BY position) AS x FROM examples GROUP BY sense_id) SELECT f.entry_id, form AS forms, string_agg(lang || ':' || s.position || ':' || coalesce(g, '') || ':' || coalesce(x, ''), ',' ORDER BY lang, s.position) AS senses FROM f LEFT JOIN senses s USING (entry_id) LEFT JOIN g USING (sense_id) LEFT JOIN x USING (sense_id) GROUP BY f.entry_id, form")
def nest_entries(spark, sf):
    s = senses(spark, sf)
    own = lambda t: t.join(s.select("sense_id", "entry_id"), "sense_id")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("text"), F.lit(True).alias("common"), F.lit("kana").alias("kind"))
    n = P.nest_entries(c, c, s, own(glosses(spark, sf)), own(examples(spark, sf)))
    flat = F.transform("senses", lambda x: F.concat_ws(":", x["lang"], x["position"].cast("string"), F.coalesce(F.array_join(x["glosses"], "/"), F.lit("")), F.coalesce(F.array_join(x["examples"], "/"), F.lit(""))))
    return n.select("entry_id", F.array_join("forms", ",").alias("forms"), F.array_join(flat, ",").alias("senses"))


@query(f"WITH {SENSES}, per AS (SELECT entry_id, count(*) AS n FROM senses GROUP BY entry_id), numbered AS (SELECT entry_id, row_number() OVER (ORDER BY entry_id) AS sequence, 1 + (sum(n) OVER (ORDER BY entry_id) - n) // 1000 AS bank FROM per) SELECT sense_id, entry_id, sequence::BIGINT AS sequence, bank::BIGINT AS bank FROM senses JOIN numbered USING (entry_id)")
def term_banks(spark, sf):
    return P.export_term_banks(senses(spark, sf).select("sense_id", "entry_id"), "entry_id", 1000)


@query(f"WITH {SENSES}, per AS (SELECT entry_id, count(*) AS n FROM senses GROUP BY entry_id), run AS (SELECT entry_id, n, sum(n) OVER (ORDER BY entry_id) - n AS before FROM per) SELECT entry_id, n::BIGINT AS n_rows, greatest(0, least(n, (5000 - before)::BIGINT))::BIGINT AS kept_rows FROM run")
def global_cap(spark, sf):
    per = senses(spark, sf).groupBy("entry_id").agg(F.count("*").alias("n_rows"))
    return O.global_cap(per, ["entry_id"], 5000).withColumn("kept_rows", F.col("kept_rows").cast("long"))


@query(f"WITH {SENSES} SELECT sense_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY sense_id) AS n FROM senses) WHERE n <= 2")
def cap_per_entry(spark, sf):
    return O.cap_per_key(senses(spark, sf), ["entry_id"], 2, "sense_id").select("sense_id", "entry_id")


@query(f"WITH {SENSES} SELECT arg_min(sense_id, sense_id) AS sense_id, entry_id, lang FROM senses GROUP BY entry_id, lang")
def first_wins(spark, sf):
    return O.first_wins(senses(spark, sf), ["entry_id", "lang"], "sense_id").select("sense_id", "entry_id", "lang")


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS occurrence, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN o_custkey || ':' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) ELSE o_custkey::VARCHAR END AS record_id FROM orders")
def record_occurrence(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("k"))
    return O.record_occurrence(o, "k", "o_orderkey").select("o_orderkey", "o_custkey", F.col("occurrence").cast("long").alias("occurrence"), "record_id")


@query("SELECT o_custkey, min(o_orderkey) AS primary, array_to_string(list(o_orderkey ORDER BY o_orderkey)[2:], ',') AS alternatives FROM orders GROUP BY o_custkey".replace("AS primary", 'AS "primary"'))
def primary_and_rest(spark, sf):
    return O.primary_and_rest(read(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderkey").withColumn("alternatives", F.array_join(F.transform("alternatives", lambda x: x.cast("string")), ","))


@query(f"WITH {SENSES}, last AS (SELECT sense_id, max(position) AS p FROM glosses GROUP BY sense_id) SELECT e.sense_id, (coalesce(p, 0) + row_number() OVER (PARTITION BY e.sense_id ORDER BY e.text))::BIGINT AS position FROM examples e LEFT JOIN last ON e.sense_id = last.sense_id")
def append_position(spark, sf):
    out = O.append_position(examples(spark, sf).drop("position"), glosses(spark, sf), "sense_id", "text")
    return out.select("sense_id", F.col("position").cast("long").alias("position"))


# --- retention, graft, removal ------------------------------------------------------------------

ENTRIES = "prod AS (SELECT c_custkey AS entry_id, CASE WHEN c_custkey % 6 = 0 THEN 'generated' ELSE 'jmdict' END AS source, c_mktsegment || (c_custkey // 2) AS term FROM customer), rel AS (SELECT c_custkey AS entry_id, 'jmdict' AS source, c_mktsegment || (c_custkey // 2) AS term FROM customer WHERE c_custkey % 6 <> 0)"


def prod(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.when(F.col("c_custkey") % 6 == 0, "generated").otherwise("jmdict").alias("source"), F.concat("c_mktsegment", F.floor(F.col("c_custkey") / 2).cast("string")).alias("term"))


def rel(spark, sf):
    return prod(spark, sf).where("source <> 'generated'")


@query(f"WITH {SENSES}, {ENTRIES}, g AS (SELECT DISTINCT entry_id, lang FROM senses WHERE generation_id IS NOT NULL AND entry_id NOT IN (SELECT entry_id FROM prod WHERE source = 'generated')) SELECT 'entry' AS kind, entry_id::VARCHAR AS key FROM prod WHERE source = 'generated' UNION ALL SELECT 'group', entry_id || '/' || lang FROM g UNION ALL SELECT 'example', x.sense_id::VARCHAR FROM examples x WHERE x.sense_id % 8 = 0 AND x.sense_id NOT IN (SELECT sense_id FROM senses JOIN g USING (entry_id, lang)) AND x.sense_id NOT IN (SELECT sense_id FROM senses WHERE entry_id IN (SELECT entry_id FROM prod WHERE source = 'generated'))")
def retain_accepted(spark, sf):
    a, b, c = T.retain_accepted(prod(spark, sf), senses(spark, sf), examples(spark, sf))
    one = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"))
    return one(a, "entry", F.col("entry_id").cast("string")).unionByName(one(b, "group", F.concat_ws("/", F.col("entry_id").cast("string"), "lang"))).unionByName(one(c, "example", F.col("sense_id").cast("string")))


@query(f"WITH {ENTRIES}, shared AS (SELECT term, min(entry_id) AS m FROM rel GROUP BY term) SELECT p.entry_id, p.term, CASE WHEN coalesce(r.entry_id, m) IS NULL AND p.entry_id % 4 = 0 THEN NULL ELSE coalesce(r.entry_id, m, p.entry_id) END AS target, CASE WHEN coalesce(r.entry_id, m) IS NOT NULL THEN 'reattach' WHEN p.entry_id % 4 = 0 THEN 'drop' ELSE 'insert' END AS action FROM prod p LEFT JOIN rel r ON p.entry_id = r.entry_id LEFT JOIN shared s ON p.term = s.term WHERE p.source = 'generated'")
def restore_entries(spark, sf):
    p = prod(spark, sf)
    told = p.where("source = 'generated' and entry_id % 4 = 0").select("term")
    return T.restore_entries(p.where("source = 'generated'").select("entry_id", "term"), rel(spark, sf), told)


@query(f"WITH {ENTRIES} SELECT p.entry_id, min(r.entry_id) AS replacement FROM prod p JOIN rel r USING (term) WHERE p.source = 'generated' GROUP BY p.entry_id")
def promoted_entries(spark, sf):
    return T.promoted_entries(prod(spark, sf), rel(spark, sf))


@query(f"WITH {SENSES}, {ENTRIES}, rs AS (SELECT * FROM senses WHERE sense_id % 2 = 0 AND entry_id IN (SELECT entry_id FROM rel)), moved AS (SELECT p.entry_id, min(r.entry_id) AS replacement FROM prod p JOIN rel r USING (term) WHERE p.source = 'generated' GROUP BY p.entry_id), ours AS (SELECT s.sense_id, coalesce(m.replacement, s.entry_id) AS entry_id, s.lang, s.entry_id AS origin FROM senses s JOIN (SELECT DISTINCT entry_id, lang FROM senses WHERE generation_id IS NOT NULL) g USING (entry_id, lang) LEFT JOIN moved m USING (entry_id)), stand AS (SELECT entry_id FROM rel UNION SELECT entry_id FROM prod WHERE source = 'generated' AND entry_id NOT IN (SELECT entry_id FROM moved)) SELECT sense_id, entry_id, lang, 'release' AS origin FROM rs UNION ALL SELECT sense_id, entry_id, lang, 'production' FROM (SELECT o.*, min(o.origin) OVER (PARTITION BY o.entry_id, o.lang) AS m FROM ours o JOIN stand USING (entry_id) LEFT JOIN (SELECT DISTINCT entry_id, lang FROM rs) r ON r.entry_id = o.entry_id AND r.lang = o.lang WHERE r.entry_id IS NULL) WHERE origin = m")
def graft_release(spark, sf):
    s = senses(spark, sf)
    rs = s.where("sense_id % 2 = 0").join(rel(spark, sf).select("entry_id"), "entry_id", "left_semi").select(s.columns)
    return T.graft_release(prod(spark, sf), rel(spark, sf), rs, s).select("sense_id", "entry_id", "lang", "origin")


@query(f"WITH {SENSES} SELECT sense_id, entry_id, lang FROM senses s WHERE NOT EXISTS (SELECT 1 FROM senses n WHERE n.sense_id % 13 = 0 AND n.entry_id = s.entry_id AND n.lang = s.lang) UNION ALL SELECT sense_id + 1000000, entry_id, lang FROM senses WHERE sense_id % 13 = 0")
def upsert_group(spark, sf):
    s = senses(spark, sf)
    return T.upsert_group(s, s.where("sense_id % 13 = 0").withColumn("sense_id", F.col("sense_id") + 1_000_000)).select("sense_id", "entry_id", "lang")


@query(f"WITH {SENSES}, gone AS (SELECT sense_id FROM senses WHERE lang = 'zh-tw' AND provenance = 'source') SELECT 'sense' AS kind, sense_id, 0 AS position FROM senses ANTI JOIN gone USING (sense_id) UNION ALL SELECT 'gloss', sense_id, position FROM glosses ANTI JOIN gone USING (sense_id) UNION ALL SELECT 'example', sense_id, position FROM examples ANTI JOIN gone USING (sense_id) UNION ALL SELECT 'gone', sense_id, 0 FROM gone")
def drop_component(spark, sf):
    """What is left of senses, glosses and examples, and what went."""
    s = senses(spark, sf).withColumn("source_name", F.lit("jmdict"))
    left, g, x, gone = T.drop_component(s, glosses(spark, sf), examples(spark, sf), "zh-tw", "jmdict")
    one = lambda df, kind, position: df.select(F.lit(kind).alias("kind"), "sense_id", position.cast("int").alias("position"))
    return one(left, "sense", F.lit(0)).unionByName(one(g, "gloss", F.col("position"))).unionByName(one(x, "example", F.col("position"))).unionByName(one(gone, "gone", F.lit(0)))


@query(f"WITH {SENSES} SELECT DISTINCT generation_id FROM senses WHERE generation_id IS NOT NULL UNION SELECT 'g1'")
def generations_used(spark, sf):
    return T.generations_used(senses(spark, sf), examples(spark, sf))


@query(f"WITH {SENSES} SELECT DISTINCT entry_id FROM senses WHERE lang = 'en' AND generation_id IS NOT NULL")
def accepted_entries(spark, sf):
    return S.accepted_entries(senses(spark, sf), "en")


@query(f"WITH {SENSES}, ans AS (SELECT c_custkey AS q, c_custkey AS entry_id FROM customer WHERE c_custkey % 9 <> 0), st AS (SELECT entry_id, min(CASE WHEN sense_id % 4 = 0 THEN 1 ELSE 0 END) AS ok FROM senses WHERE lang = 'en' GROUP BY entry_id) SELECT * FROM (SELECT 'q' || c_custkey AS query, a.entry_id, CASE WHEN a.entry_id IS NULL THEN 'unknown-word' WHEN ok IS NULL THEN 'missing-language' WHEN ok = 0 THEN 'incomplete-examples' END AS gap FROM customer LEFT JOIN ans a ON q = c_custkey LEFT JOIN st ON st.entry_id = a.entry_id) WHERE gap IS NOT NULL")
def enrichment_gaps(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("query"), F.col("c_custkey").alias("entry_id"))
    s = senses(spark, sf).withColumn("complete", F.col("sense_id") % 4 == 0)
    return L.enrichment_gaps(c, c.where("entry_id % 9 <> 0"), s, "en")


# --- merges -------------------------------------------------------------------------------------

NAMES = "recs AS (SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment || '  ' || c_nationkey END AS headword FROM customer)"


def recs(spark, sf):
    seg = F.col("c_mktsegment")
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 3 == 0, F.upper(seg)).when(F.col("c_custkey") % 3 == 1, F.lower(seg)).otherwise(F.concat(seg, F.lit("  "), F.col("c_nationkey").cast("string"))).alias("headword"), F.array(F.lower(seg)).alias("forms"))


@query(f"WITH {NAMES}, n AS (SELECT *, lower(regexp_replace(headword, '\\s+', ' ', 'g')) AS term FROM recs) SELECT term, CASE WHEN bool_or(headword = term) THEN term ELSE arg_min(headword, ordinal) END AS headword, min(ordinal) AS ordinal, count(*) AS n_records FROM n GROUP BY term")
def merge_headwords(spark, sf):
    return M.merge_headwords(recs(spark, sf)).drop("forms")


@query("SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey % 29 = 0) AS canonical FROM supplier")
def merge_fallback(spark, sf):
    a = read(spark, sf, "customer").where("c_custkey % 29 = 0").select(F.col("c_nationkey").alias("term"))
    return M.merge_fallback(a, read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("term"))).select("s_suppkey", "canonical")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'record-is-not-japanese' WHEN s_suppkey IS NULL THEN 'no-princeton-wordnet-ili-mapping' WHEN s_suppkey % 3 = 0 THEN 'princeton-wordnet-ili-mapping-is-not-validated' END AS reason FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def import_concepts(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("synset"), F.when(F.col("o_orderkey") % 4 == 0, "eng").otherwise("jpn").alias("lang"))
    m = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").cast("string").alias("synset"), F.concat(F.lit("oewn-"), F.col("s_suppkey").cast("string")).alias("pwn_synset"), (F.col("s_suppkey") % 3 != 0).alias("validated"))
    return M.import_concepts(o, m).select("o_orderkey", "reason")


@query("SELECT o_orderkey AS ordinal, p_name AS term, (row_number() OVER (PARTITION BY p_name ORDER BY o_orderkey))::BIGINT AS position FROM orders JOIN (SELECT DISTINCT p_partkey % 50 AS k, p_name FROM part) h ON o_custkey % 50 = k")
def publish_concepts(spark, sf):
    acc = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.lit("x").alias("lemma"), F.concat(F.lit("pwn-"), (F.col("o_custkey") % 50).cast("string")).alias("pwn_synset"))
    s = read(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("oewn-"), (F.col("p_partkey") % 50).cast("string")).alias("synset"), F.col("p_name").alias("term"), F.lit("noun").alias("pos"))
    return M.publish_concepts(acc, s).select("ordinal", "term", F.col("position").cast("long").alias("position"))


@query("SELECT c_custkey, CASE WHEN blank <> '' THEN 'incomplete-provenance:' || blank END AS reason FROM (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'agency' END, CASE WHEN c_custkey % 7 = 0 THEN 'version' END], lambda x: x IS NOT NULL), '+') AS blank FROM customer)")
def import_terminology(spark, sf):
    c = read(spark, sf, "customer")
    keep = lambda n: F.when(F.col("c_custkey") % n == 0, " ").otherwise("x")
    rows = c.select("c_custkey", keep(5).alias("agency"), keep(7).alias("version"), *(F.lit("x").alias(f) for f in R.TERMINOLOGY_FIELDS if f not in ("agency", "version")))
    return M.import_terminology(rows).select("c_custkey", "reason")


@query("SELECT p_partkey AS entry_id, CASE WHEN max(1 + o_orderkey % 5) IS NOT NULL THEN 'N' || max(1 + o_orderkey % 5) END AS level FROM part LEFT JOIN orders ON o_custkey = p_partkey GROUP BY p_partkey")
def assign_levels(spark, sf):
    lists = read(spark, sf, "orders").select(F.col("o_custkey").alias("entry_id"), (1 + F.col("o_orderkey") % 5).alias("n"))
    return M.assign_levels(read(spark, sf, "part").select(F.col("p_partkey").alias("entry_id")), lists)


@query("WITH a AS (SELECT p_size % 20 AS w, p_type AS i, count(*) AS n, min(p_partkey) AS s FROM part GROUP BY 1, 2), b AS (SELECT s_suppkey, s_suppkey % 20 AS w, ['ECONOMY', 'STANDARD', 'PROMO'][1 + s_suppkey % 3] AS i FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY w, i) AS m FROM b) SELECT s_suppkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 OR m > 1 THEN 'ambiguous' ELSE 'imported' END AS outcome, CASE WHEN n = 1 AND m = 1 THEN s END AS sense_id FROM c LEFT JOIN a USING (w, i)")
def match_examples(spark, sf):
    s = read(spark, sf, "part").select((F.col("p_size") % 20).cast("long").alias("word_id"), F.col("p_partkey").alias("sense_id"), X.sense_identity(F.array("p_type")).alias("identity"))
    kinds = F.element_at(F.array(F.lit("ECONOMY"), F.lit("STANDARD"), F.lit("PROMO")), (1 + F.col("s_suppkey") % 3).cast("int"))
    x = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20).alias("word_id"), X.sense_identity(F.array(kinds)).alias("identity"))
    return M.match_examples(s, x).select("s_suppkey", "outcome", "sense_id")


@query("SELECT c_custkey AS entry_id, n_name AS ipa FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0 AND n_nationkey % 3 <> 0")
def fill_pronunciations(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_nationkey").alias("term"))
    ref = read(spark, sf, "nation").select(F.col("n_nationkey").alias("term"), F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_nationkey") % 3 != 0, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("ipa"))
    return M.fill_pronunciations(c, c.where("entry_id % 2 = 1"), ref).select("entry_id", "ipa")


@query("SELECT c_custkey AS example_id, CASE WHEN o.k IS NOT NULL THEN c_custkey::VARCHAR WHEN t.k IS NOT NULL THEN c_custkey || ':en' END AS target FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0) o ON o.k = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1) t ON t.k = c_custkey")
def legacy_example_targets(spark, sf):
    o = read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(":en"))).alias("sense_id"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("example_id"), F.col("c_custkey").cast("string").alias("sense_id"), F.lit("en").alias("lang"))
    return M.legacy_example_targets(c, o).select("example_id", "target")


# --- evidence -----------------------------------------------------------------------------------

LANGS = ["ja", "zh", "cmn", "zh-tw", "fr", "yue", "ja-hira"]
TERMS = ["銀行", "ぎんこう", "bank", "", "—", "岸, 堤", "please add"]
EVIDENCE = f"""tr AS (SELECT c_custkey AS ordinal, c_mktsegment AS word, c_custkey % 3 AS hint, [{', '.join(repr(x) for x in LANGS)}][1 + c_custkey % {len(LANGS)}] AS code, [{', '.join(repr(x) for x in TERMS)}][1 + (c_custkey // 7) % {len(TERMS)}] AS term, CASE WHEN c_custkey % 2 = 0 THEN 'sense-local' ELSE 'entry-level' END AS scope FROM customer), ev AS (SELECT *, CASE WHEN code IN ('ja', 'ja-hira') THEN 'ja' WHEN code <> 'fr' THEN 'zh' END AS lang FROM tr), rej AS (SELECT *, CASE WHEN term = '' THEN 'missing-term' WHEN term IN ('—', 'please add') THEN 'malformed-term' WHEN lang = 'ja' AND NOT regexp_matches(term, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]') THEN 'wrong-script' WHEN lang = 'zh' AND NOT regexp_matches(term, '\\p{{Han}}') THEN 'wrong-script' END AS rejection, (CASE WHEN term LIKE '%,%' THEN 1 ELSE 0 END) + (CASE WHEN scope = 'entry-level' AND hint = 2 THEN 1 ELSE 0 END) AS ambiguity, CASE WHEN lang = 'ja' THEN 'ja' WHEN code = 'zh-tw' THEN 'zh-hant' WHEN code IN ('zh', 'cmn') THEN 'zh' ELSE code END AS locale FROM ev WHERE lang IS NOT NULL)"""


#: Entries that a task works on where the work on each is dear; as rows of a table they are so short that one split of a file would hold very many.
TASK_ENTRIES = 20_000


def evidence_entries(spark, sf, dealt=False):
    """One dump entry per customer: two senses, and one translation, under the first sense or at entry level with a hint. dealt: to tasks by number."""
    customers = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    if dealt:
        customers = customers.repartition(max(1, -(-customers.count() // TASK_ENTRIES)), "c_custkey")
    k = F.col("c_custkey")
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), i.cast("int"))
    null = F.lit(None).cast("string")
    t = F.struct(pick(LANGS, 1 + k % len(LANGS)).alias("code"), null.alias("lang_code"), null.alias("lang"), pick(TERMS, 1 + F.floor(k / 7) % len(TERMS)).alias("word"), null.alias("roman"), F.when(k % 3 == 0, "A bank.").when(k % 3 == 1, "a shore").otherwise("other").alias("sense"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("topics"), null.alias("note"))
    none = F.array().cast(f"array<{E.TRANSLATION}>")
    inside, outside = F.when(k % 2 == 0, F.array(t)).otherwise(none), F.when(k % 2 == 1, F.array(t)).otherwise(none)
    empty, words_ = F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<text:string>>")
    sense = lambda i, g, tr: F.struct(F.lit(f"s{i}").alias("id"), F.array(F.lit(g)).alias("glosses"), empty.alias("tags"), empty.alias("raw_tags"), empty.alias("topics"), empty.alias("categories"), words_.alias("examples"), tr.alias("translations"))
    return customers.select(k.alias("ordinal"), F.col("c_mktsegment").alias("word"), F.lit("noun").alias("pos"), null.alias("lang"), F.lit("en").alias("lang_code"), k.alias("pageid"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("int").alias("etymology_number"), F.array(sense(1, "a bank", inside), sense(2, "a shore", none)).alias("senses"), F.lit(None).cast("array<struct<ipa:string,tags:array<string>>>").alias("sounds"), outside.alias("translations"))


@query(f"WITH {EVIDENCE} SELECT ordinal, word, lang, locale, term, scope, ambiguity::INT AS ambiguity, CASE WHEN scope = 'sense-local' OR hint = 0 THEN 0 WHEN hint = 1 THEN 1 END AS sense_index FROM rej WHERE rejection IS NULL")
def filter_evidence(spark, sf):
    kept, _ = E.filter_evidence(evidence_entries(spark, sf), "wiktionary", "en", "v1")
    return kept.select("ordinal", "word", "lang", "locale", "term", "scope", F.size("ambiguity").alias("ambiguity"), "sense_index")


@query(f"WITH {EVIDENCE}, a AS (SELECT lang, count(*) FILTER (WHERE scope = 'sense-local') AS sense_local, count(*) FILTER (WHERE scope = 'entry-level') AS entry_level, count(*) FILTER (WHERE ambiguity > 0) AS ambiguous, count(*) FILTER (WHERE lang = 'ja' AND term = '銀行') AS corroborated, count(*) FILTER (WHERE NOT (lang = 'ja' AND term = '銀行')) AS unmatched FROM rej WHERE rejection IS NULL GROUP BY lang), r AS (SELECT lang, sum(n)::BIGINT AS rejected, string_agg(rejection || ':' || n, ',' ORDER BY rejection) AS by_reason FROM (SELECT lang, rejection, count(*) AS n FROM rej WHERE rejection IS NOT NULL GROUP BY ALL) GROUP BY lang) SELECT lang, coalesce(sense_local, 0) AS sense_local, coalesce(entry_level, 0) AS entry_level, coalesce(ambiguous, 0) AS ambiguous, coalesce(corroborated, 0) AS corroborated, coalesce(unmatched, 0) AS unmatched, coalesce(rejected, 0)::BIGINT AS rejected, coalesce(by_reason, '') AS by_reason FROM a FULL JOIN r USING (lang)")
def evidence_coverage(spark, sf):
    """All that the coverage has; parts with an odd key support one Japanese term."""
    japanese = read(spark, sf, "part").where("p_partkey % 2 = 1").select(F.lit("銀行").alias("term"), F.col("p_name").alias("support"), F.col("p_partkey").alias("ordinal"))
    kept, rows = E.filter_evidence(evidence_entries(spark, sf), "wiktionary", "en", "v1", japanese)
    reasons = F.array_sort(F.transform(F.map_entries("by_reason"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))))
    return E.evidence_coverage(kept, rows).withColumn("by_reason", F.coalesce(F.array_join(reasons, ","), F.lit("")))


# --- predicates over running text ---------------------------------------------------------------


@query("SELECT conv_id, turn, role, length(text) <= 80 AND text NOT LIKE '%' || chr(10) || '%' AND text NOT LIKE '%www.%' AND text NOT LIKE '%http://%' AND text NOT LIKE '%https://%' AND NOT regexp_matches(text, '[\\p{Cc}]|<[^>]+>') AND regexp_matches(text, '\\p{L}') AND NOT regexp_matches(text, '^\\p{N}+[\\p{N}\\p{P}\\s]*$') AS lexical FROM conversations")
def lexical_headwords(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", X.is_lexical_headword(F.col("text")).alias("lexical"))


@query("SELECT doc_id, coalesce(trim(text) = '', true) OR regexp_matches(text, '[\\p{Hiragana}\\p{Katakana}\\p{Han}\\p{Hangul}]') AS invalid FROM documents")
def invalid_explanations(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.invalid_explanation_text(F.lit("en"), F.col("text")).alias("invalid"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS identity FROM documents")
def text_identity(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(X.text_identity(F.col("text")), 256).alias("identity"))


@query("SELECT item_id, substr(sha256(concat_ws('|', 'x', text)), 1, 20) AS h FROM benchmark")
def hashed_ids(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.substring(X.hashed_id("e_", F.lit("x"), F.col("text")), 3, 20).alias("h"))


@query("SELECT doc_id, list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), 'that') OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), 'thats') OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), 'thates') OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), 'thated') OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), 'thating') AS used FROM documents")
def sentence_contains(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.english_sentence_contains(F.col("text"), F.lit("That")).alias("used"))


# --- gates, tallies, analytics ------------------------------------------------------------------


@query("WITH s AS (SELECT s_suppkey, ['ntu-chinese-wordnet', 'cc-cedict', 'jmdict', 'oewn'][1 + s_suppkey % 4] AS source FROM supplier) SELECT s_suppkey, CASE WHEN source = 'ntu-chinese-wordnet' THEN 'restricted' WHEN source <> 'cc-cedict' AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN 'direct-import' ELSE 'authoring-evidence' END AS role, CASE WHEN source = 'ntu-chinese-wordnet' THEN 'restricted-source-requires-a-documented-permission-grant' ELSE array_to_string(list_filter([CASE WHEN source = 'cc-cedict' THEN 'source-is-supporting-evidence-only' END, CASE WHEN s_suppkey % 3 = 0 THEN 'match-is-not-an-exact-source-identifier-or-explicit-mapping' END, CASE WHEN s_suppkey % 5 = 0 THEN 'no-recorded-redistribution-license' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM s")
def classify_sources(spark, sf):
    s = read(spark, sf, "supplier").withColumn("source", F.element_at(F.array(F.lit("ntu-chinese-wordnet"), F.lit("cc-cedict"), F.lit("jmdict"), F.lit("oewn")), (1 + F.col("s_suppkey") % 4).cast("int")))
    yes, no = F.lit(True), F.lit(False)
    r = X.source_reasons(F.col("source"), no, F.col("s_suppkey") % 3 != 0, yes, yes, F.when(F.col("s_suppkey") % 5 != 0, "CC"), F.lit("someone"), yes)
    return s.select("s_suppkey", X.source_role(F.col("source"), no, r).alias("role"), F.array_join(r, ",").alias("reasons"))


@query("SELECT user_id, count(*) AS attempts, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, round(sum(value), 4) AS cost, (SELECT string_agg(e || '=' || n, ',' ORDER BY e) FROM (SELECT event_type AS e, count(*) AS n FROM events y WHERE y.user_id = x.user_id GROUP BY 1)) AS outcomes FROM events x GROUP BY user_id")
def attempt_summary(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("event_type").alias("outcome"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.col("value").alias("cost"))
    out = S.attempt_summary(e, ["user_id"])
    return out.withColumn("cost", F.round("cost", 4)).withColumn("outcomes", F.array_join(F.array_sort(F.transform(F.map_entries("outcomes"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))), ","))


@query("SELECT doc_id % 10 AS reviewer, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS false_accepts, count(*) FILTER (WHERE quality = 0) AS should_reject, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS false_rejects, count(*) FILTER (WHERE quality = 1) AS should_accept, round(CASE WHEN count(*) FILTER (WHERE quality = 0) = 0 THEN 0 ELSE count(*) FILTER (WHERE quality = 0 AND toxic = 0) / count(*) FILTER (WHERE quality = 0) END, 9)::DOUBLE AS false_accept_rate, round(CASE WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 0 ELSE count(*) FILTER (WHERE quality = 1 AND toxic = 1) / count(*) FILTER (WHERE quality = 1) END, 9)::DOUBLE AS false_reject_rate, count(*) FILTER (WHERE quality = 0 AND toxic = 0) > 0 AS blocked FROM labels GROUP BY 1")
def reviewer_evaluation(spark, sf):
    j = read(spark, sf, "labels").select((F.col("doc_id") % 10).alias("reviewer"), F.when(F.col("quality") == 0, "reject").otherwise("accept").alias("expected"), F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("actual"))
    out = S.reviewer_evaluation(j, ["reviewer"])
    return out.withColumn("false_accept_rate", F.round("false_accept_rate", 9)).withColumn("false_reject_rate", F.round("false_reject_rate", 9))


@query("WITH v AS (SELECT o_custkey AS k, o_orderkey AS p, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'reject' ELSE 'malformed' END AS verdict FROM orders) SELECT k, bool_and(verdict = 'accept') AS accepted, coalesce(arg_min(verdict, p) FILTER (WHERE verdict <> 'accept'), 'accept') AS outcome, count(*) AS passes FROM v GROUP BY k")
def unanimous_review(spark, sf):
    say = F.when(F.col("o_orderstatus") == "F", " ACCEPT ").when(F.col("o_orderstatus") == "O", "REJECT").otherwise("?")
    v = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pass"), X.review_verdict(say).alias("verdict"))
    return S.unanimous_review(v, "k")


@query("SELECT 'p_type' AS kind, p_type AS code FROM part UNION SELECT 'p_brand', p_brand FROM part")
def label_vocabulary(spark, sf):
    return S.label_vocabulary(read(spark, sf, "part").select(F.array("p_type").alias("p_type"), F.array("p_brand").alias("p_brand")), ["p_type", "p_brand"])


@query("SELECT c_mktsegment AS name, arg_min(c_name, c_custkey) AS license, arg_min('u' || c_nationkey, c_custkey) AS url FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def source_credits(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("license"), F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("url"))
    return S.source_credits(c)


@query("SELECT string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS c_mktsegment, string_agg(DISTINCT 'n' || c_nationkey, '; ' ORDER BY 'n' || c_nationkey) AS nation FROM customer")
def mapped_source_meta(spark, sf):
    return S.joined_sets(read(spark, sf, "customer").select("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation")), ["c_mktsegment", "nation"])


@query("SELECT o_orderpriority AS stage, o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1, 2")
def import_stats(spark, sf):
    return S.import_stats(read(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("outcome")))


# --- validation ---------------------------------------------------------------------------------


@query(f"WITH {SENSES} SELECT c_custkey::VARCHAR AS key, 'no-language' AS problem FROM customer WHERE c_custkey NOT IN (SELECT entry_id FROM senses) UNION ALL SELECT sense_id::VARCHAR, 'no-glosses' FROM senses WHERE sense_id % 11 = 0 UNION ALL SELECT sense_id::VARCHAR, 'source-sense-without-evidence' FROM senses WHERE provenance = 'source' AND sense_id % 3 <> 0 UNION ALL SELECT sense_id::VARCHAR, 'generated-sense-with-evidence' FROM senses WHERE provenance = 'generated' AND sense_id % 3 = 0 UNION ALL SELECT sense_id::VARCHAR, 'empty-part-of-speech' FROM senses WHERE sense_id % 97 = 0")
def validate_english(spark, sf):
    s = senses(spark, sf).withColumn("part_of_speech", F.when(F.col("sense_id") % 97 == 0, "").otherwise("noun"))
    e = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("headword"))
    return V.validate_english(e, s, glosses(spark, sf), s.where("sense_id % 3 = 0"), "")


@query("SELECT o_orderstatus AS key, 'check:o_orderstatus' AS problem FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'unique:o_custkey' FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT o_custkey::VARCHAR, 'foreign-key:o_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def validate_constraints(spark, sf):
    o = read(spark, sf, "orders")
    return V.validate_constraints(o, [["o_custkey"]], {"o_orderstatus": ["F", "O"]}, {"o_custkey": (read(spark, sf, "customer").where("c_custkey % 50 <> 0"), "c_custkey")})


@query(f"WITH {SENSES} SELECT x.sense_id, s.lang FROM examples x JOIN senses s USING (sense_id) WHERE NOT (s.lang = 'en')")
def check_language_isolation(spark, sf):
    return V.check_language_isolation(senses(spark, sf), examples(spark, sf).select("sense_id", F.array(F.lit("en")).alias("translation_langs"))).select("sense_id", "lang")


@query(f"WITH {FORMS}, {RANKED} SELECT q.text AS query, q.entry_id AS expected, r.entry_id FROM forms q LEFT JOIN ranked r ON r.term = q.text AND r.place = 1 WHERE q.entry_id IS DISTINCT FROM r.entry_id")
def check_lookups(spark, sf):
    answers = L.rank_entries(forms(spark, sf), ja_entries(spark, sf)).select(F.col("term").alias("query"), "place", "entry_id")
    return V.check_lookups(forms(spark, sf).select(F.col("text").alias("query"), F.col("entry_id").alias("expected")), answers)


@query("SELECT q AS query, CASE WHEN count(DISTINCT h) = 1 THEN min(h) END AS headword, count(DISTINCT h) AS n_headwords, count(*) AS n_records FROM (SELECT DISTINCT c_mktsegment AS q FROM customer) JOIN (SELECT c_custkey AS e, c_name AS h, c_mktsegment AS r FROM customer) ON r = q GROUP BY q")
def find_source_evidence(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("evidence_id"), F.col("c_name").alias("headword"), F.col("c_mktsegment").alias("reading"))
    return L.find_source_evidence(c.select(F.col("reading").alias("query")), c)


@query("WITH s AS (SELECT o_custkey AS e FROM orders GROUP BY 1 HAVING count(*) = 1), h AS (SELECT c_nationkey AS w, c_custkey AS entry_id, (SELECT 1 FROM s WHERE e = c_custkey) AS ok FROM customer) SELECT w AS word, CASE WHEN count(ok) = 1 THEN min(entry_id) FILTER (WHERE ok = 1) END AS entry_id, CASE WHEN count(ok) = 1 THEN 'match' WHEN count(ok) = 0 THEN 'no-match' ELSE 'ambiguous' END AS status FROM h GROUP BY w")
def match_single_sense(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("term"), F.col("c_custkey").alias("entry_id"))
    s = read(spark, sf, "orders").select(F.col("o_custkey").alias("entry_id"), F.lit("en").alias("lang"))
    return L.match_single_sense(c.select(F.col("term").alias("word")), c, s)
