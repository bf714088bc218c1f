"""Further registered queries: imports, attachments, restoration, exports and authored content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import evidence as E
from ..operators import lookup as L
from ..operators import merge as M
from ..operators import release as P
from ..operators import retain as T
from ..operators import stats as S
from ..operators import validate as V
from . import registry as Q
from .registry import EVIDENCE, SENSES, query, read


def pick(items, i):
    return F.element_at(F.array(*map(F.lit, items)), i.cast("int"))


@query("SELECT p_partkey AS sense_id, n_name AS definition, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE '' END AS domains FROM part JOIN nation ON n_nationkey = p_size % 25 JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 7 <> 0")
def import_wordnet(spark, sf):
    """Parts are senses, nations synsets, regions the topics of every second one."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("headword"), F.lit("n-1").alias("pos_key"), F.lit(1).alias("sense_no"), F.col("p_partkey").alias("sense_id"), F.concat(F.lit("n"), (F.col("p_size") % 25).cast("string")).alias("synset"))
    empty = F.array().cast("array<string>")
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("synset"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("definition"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).otherwise(empty).alias("domain_topic"), empty.alias("examples"), empty.alias("members"))
    r = read(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("synset"), F.lit(None).cast("string").alias("definition"), empty.alias("domain_topic"), empty.alias("examples"), F.array("r_name").alias("members"))
    return M.import_wordnet(p, n.unionByName(r)).select("sense_id", "definition", F.array_join("domains", ",").alias("domains"))


@query("WITH m AS (SELECT o_orderkey AS ordinal, c_custkey AS entry_id, c_nationkey AS src FROM orders JOIN customer ON c_custkey = o_custkey), f AS (SELECT * FROM m WHERE entry_id % 5 <> 0) SELECT entry_id, min(ordinal) AS ordinal FROM f GROUP BY entry_id")
def admit_secondary(spark, sf):
    """Orders are mappings, customers the records they name; every fifth entry has its record already."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("evidence_id"), F.col("o_custkey").alias("_c"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("_c"), F.col("c_custkey").alias("entry_id"), F.lit("w").alias("source"), F.col("c_nationkey").cast("string").alias("source_entry_id"))
    reference = o.select("evidence_id", "_c").join(c, "_c").drop("_c")
    return M.admit_secondary(o.drop("_c"), reference, c.where("entry_id % 5 = 0"))[0].select("entry_id", "ordinal")


@query("SELECT c_custkey AS entry_id, s_name AS chinese, (row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey))::BIGINT AS position, CASE WHEN c_custkey % 2 = 0 THEN 'verb' ELSE 'noun' END AS pos FROM supplier JOIN customer ON 't' || (s_suppkey % 40) = 't' || c_custkey")
def publish_domain_terms(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.concat(F.lit(" T"), (F.col("s_suppkey") % 40).cast("string"), F.lit("  ")).alias("english"), F.col("s_name").alias("chinese"), F.lit("d").alias("domain"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("term"))
    pos = c.where("entry_id % 2 = 0").select("entry_id", F.lit("verb").alias("pos"))
    return M.publish_domain_terms(s, c, pos)[0].select("entry_id", "chinese", F.col("position").cast("long").alias("position"), "pos")


@query("SELECT DISTINCT lower(p_name) AS term, p_partkey AS entry_id FROM part UNION SELECT lower(p_type), p_partkey FROM part")
def lookup_terms(spark, sf):
    e = read(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.lower("p_name").alias("term"), F.array("p_type", F.lit(" ")).alias("forms"))
    return M.lookup_terms(e)


@query("SELECT c_custkey AS sense_id, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey))::BIGINT AS position, 'x' || o_orderkey AS translation FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 AND c_custkey % 2 = 0")
def attach_bilingual(spark, sf):
    say = lambda lang, text: F.struct(F.lit(lang).alias("lang"), text.alias("text"))
    text = F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))
    both = F.array(say("jpn", text), say("eng", text), say("fre", text))
    x = read(spark, sf, "orders").select(F.col("o_orderkey").alias("example_id"), F.col("o_custkey").alias("entry_id"), F.lit(0).alias("sense_no"), F.when(F.col("o_orderkey") % 3 != 0, both).otherwise(F.array(say("eng", text))).alias("sentences"))
    s = read(spark, sf, "customer").select(F.col("c_custkey").alias("sense_id"), F.col("c_custkey").alias("entry_id"), F.lit(0).alias("sense_no"), F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("de").alias("lang"))
    return M.attach_bilingual(x, s).select("sense_id", F.col("position").cast("long").alias("position"), "translation")


@query(f"WITH {SENSES}, r AS (SELECT s_suppkey AS ordinal, s_suppkey * 3 AS sense_id, ['ko', 'en', 'fr'][1 + s_suppkey % 3] AS lang, s_suppkey % 7 = 0 AS blank FROM supplier), j AS (SELECT r.*, s.entry_id, EXISTS (SELECT 1 FROM senses h WHERE h.entry_id = s.entry_id AND h.lang = r.lang) AS held FROM r LEFT JOIN senses s USING (sense_id)) SELECT ordinal, CASE WHEN entry_id IS NULL THEN 'unknown-sense' WHEN lang = 'fr' THEN 'bad-language' WHEN blank THEN 'empty' WHEN held THEN 'conflict' END AS problem FROM j WHERE entry_id IS NULL OR lang = 'fr' OR blank OR held")
def legacy_gloss_problems(spark, sf):
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(k.alias("ordinal"), (k * 3).alias("sense_id"), pick(["ko", "en", "fr"], 1 + k % 3).alias("lang"), F.array(F.when(k % 7 == 0, " ").otherwise("g")).alias("glosses"))
    return M.attach_legacy_glosses(rows, Q.senses(spark, sf), ["en", "ko", "ja"])[1].select("ordinal", "problem")


@query("SELECT o_orderkey AS ordinal, o_custkey AS target_id, o_custkey % 4 <> 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS slot FROM orders WHERE o_orderkey % 2 = 0")
def attach_legacy_examples(spark, sf):
    tr = F.array(F.struct(F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("xx").alias("lang"), F.lit("t").alias("text")))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("sense_id"), F.lit("j").alias("text"), tr.alias("translations"))
    s = read(spark, sf, "orders").select(F.col("o_custkey").alias("sense_id")).distinct().select("sense_id", F.col("sense_id").alias("target_id"), F.lit("en").alias("lang"))
    return M.attach_legacy_examples(rows, s, s.where("target_id % 4 = 0")).select("ordinal", "target_id", "slot")


@query("WITH a AS (SELECT c_mktsegment AS query, c_custkey AS entry_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS place FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_mktsegment AS query, c_custkey AS entry_id, c_custkey AS place FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM r WHERE (query, entry_id) NOT IN (SELECT query, entry_id FROM a)) SELECT query, entry_id, (row_number() OVER (PARTITION BY query ORDER BY s, place))::BIGINT AS place FROM u")
def merge_enriched(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("query"), F.col("c_custkey").alias("entry_id"), F.col("c_custkey").alias("place"))
    return L.merge_enriched(c.where("entry_id % 2 = 0"), c.where("entry_id % 3 = 0")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SENSES} SELECT 'q' || entry_id AS query, arg_min(sense_id, CASE lang WHEN 'ja' THEN 0 WHEN 'en' THEN 1 ELSE 2 END * 1000000000 + sense_id) AS entry_id FROM senses GROUP BY 1")
def canonical_entry(spark, sf):
    a = Q.senses(spark, sf).select(F.concat(F.lit("q"), F.col("entry_id").cast("string")).alias("query"), "lang", F.col("sense_id").alias("place"), F.col("sense_id").alias("entry_id"))
    return L.canonical_entry(a, ["ja", "en", "zh-tw"])


@query(f"WITH {SENSES} SELECT entry_id, provenance AS source, count(*)::INT AS n FROM senses GROUP BY 1, 2")
def canonical_evidence(spark, sf):
    s = Q.senses(spark, sf).withColumn("source", F.col("provenance"))
    src = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.explode(F.array(F.lit("source"), F.lit("generated"), F.lit("other"))).alias("source"))
    return M.canonical_evidence(src, s, Q.glosses(spark, sf)).select("entry_id", "source", F.size("senses").alias("n"))


@query(f"WITH {SENSES}, g AS (SELECT c_custkey AS entry_id, ['en', 'ja', 'zh-tw'][1 + c_custkey % 3] AS lang, c_nationkey AS from_entry FROM customer) SELECT entry_id, lang, from_entry FROM g WHERE entry_id IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM senses s WHERE s.entry_id = g.entry_id AND s.lang = g.lang)")
def restore_groups(spark, sf):
    g = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), pick(["en", "ja", "zh-tw"], 1 + F.col("c_custkey") % 3).alias("lang"), F.col("c_nationkey").alias("from_entry"))
    return T.restore_groups(g, read(spark, sf, "orders").select(F.col("o_custkey").alias("entry_id")), Q.senses(spark, sf))


@query(f"WITH {SENSES}, last AS (SELECT sense_id, max(position) AS p FROM glosses GROUP BY 1) SELECT e.sense_id, (1 + coalesce(p, 0))::BIGINT AS position FROM examples e LEFT JOIN last USING (sense_id) WHERE e.sense_id % 3 = 0")
def restore_examples(spark, sf):
    s = Q.senses(spark, sf).where("sense_id % 3 = 0")
    return T.restore_examples(Q.examples(spark, sf), s, Q.glosses(spark, sf)).select("sense_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {SENSES} SELECT sense_id, text FROM examples WHERE sense_id % 12 <> 0 UNION ALL SELECT sense_id, 'new' FROM examples WHERE sense_id % 12 = 0")
def upsert_example(spark, sf):
    x = Q.examples(spark, sf)
    return T.upsert_example(x, x.where("sense_id % 12 = 0").withColumn("text", F.lit("new"))).select("sense_id", "text")


@query("WITH r AS (SELECT o_custkey AS entry_id, o_orderkey AS sense_no, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'de' END AS lang FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderkey % 2 = 0)) SELECT entry_id, lang, sense_no, (row_number() OVER (PARTITION BY entry_id, lang ORDER BY sense_no))::BIGINT AS sense_position FROM r")
def split_legacy_groups(spark, sf):
    lang = F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("de")
    r = read(spark, sf, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("sense_no"), F.lit(1).alias("gloss_no"), lang.alias("lang"), F.col("o_orderkey").cast("string").alias("text"))
    out = T.split_legacy_groups(r, r.where("entry_id % 3 = 0 and lang = 'en'"))
    return out.select("entry_id", "lang", F.col("text").cast("long").alias("sense_no"), F.col("sense_position").cast("long").alias("sense_position"))


@query("SELECT item_id AS entry_id, trim(text) AS text FROM benchmark WHERE item_id % 3 <> 0 AND trim(text) <> ''")
def convert_flat(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.col("text")).alias("definition"))
    return T.convert_flat(b).select("entry_id", "text")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
def not_imported(spark, sf):
    marker = read(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return T.not_imported(read(spark, sf, "customer").select("c_custkey"), marker, "c_custkey")


@query("SELECT lang AS dictionary, CASE lang WHEN 'en' THEN 'en,ja,zh-tw' ELSE 'de,en,ja,ko,zh-cn,zh-tw' END AS accepted, string_agg(DISTINCT source, ',' ORDER BY source) AS observed FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def dictionary_meta(spark, sf):
    d = read(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("dictionary"), F.col("source").alias("lang"))
    langs = [r[0] for r in d.select("dictionary").distinct().collect()]  # a few languages
    return S.dictionary_meta(d, {x: R.EXPLAINED_IN["en" if x == "en" else "ja"] for x in langs})


@query("SELECT string_agg(DISTINCT n, '; ' ORDER BY n) AS attribution FROM (SELECT c_mktsegment || ' ' || c_nationkey AS n FROM customer WHERE c_custkey % 3 = 2)")
def pack_attribution(spark, sf):
    name = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return P.pack_attribution(read(spark, sf, "customer").select(name.alias("name"), (F.col("c_custkey") % 3).cast("string").alias("lang"), name.alias("attribution")), "2")


@query(f"WITH {EVIDENCE} SELECT word AS headword, count(*)::BIGINT AS records, count(*) FILTER (WHERE ordinal % 2 = 0)::BIGINT AS with_second FROM (SELECT DISTINCT ordinal, word FROM tr) GROUP BY 1")
def wiktionary_records(spark, sf):
    """Entries of the evidence shape; the second sense of every odd one only states an inflection."""
    e = Q.evidence_entries(spark, sf, dealt=True)
    odd = F.transform("senses", lambda s, i: F.when((i == 1) & (F.col("ordinal") % 2 == 1), s.withField("glosses", F.array(F.lit("The plural form of bank; more than one bank.")))).otherwise(s))
    out = E.wiktionary_records(e.withColumn("senses", odd), "v1")
    return out.groupBy("headword").agg(F.count("*").alias("records"), F.sum((F.size("senses") == 2).cast("long")).alias("with_second"))


@query("WITH k AS (SELECT s_suppkey AS ordinal, CASE WHEN s_suppkey % 11 = 0 THEN 'x' ELSE 'word' || s_suppkey END AS word, CASE WHEN s_suppkey % 5 = 0 THEN 'name' ELSE 'noun' END AS pos, s_suppkey % 3 AS m, s_suppkey % 4 AS t FROM supplier) SELECT CASE WHEN pos = 'name' THEN 'part-of-speech' WHEN word = 'x' THEN 'short-ambiguous-word' WHEN t = 0 THEN 'no-clean-gloss' WHEN m = 1 THEN 'ambiguous' WHEN m = 2 THEN 'no-match' ELSE 'proposed' END AS reason, count(*) AS n FROM k GROUP BY 1")
def target_gloss_probe(spark, sf):
    k = F.col("s_suppkey")
    tr = F.array(F.struct(F.when(k % 4 == 0, "bank").otherwise("은행").alias("word"), F.lit("s").alias("sense")))
    rows = read(spark, sf, "supplier").select(k.alias("ordinal"), F.when(k % 11 == 0, "x").otherwise(F.concat(F.lit("word"), k.cast("string"))).alias("word"), F.when(k % 5 == 0, "name").otherwise("noun").alias("pos"), tr.alias("translations"))
    m = rows.where("word <> 'x'").select("word", F.when(F.col("ordinal") % 3 == 0, F.col("ordinal")).alias("entry_id"), F.when(F.col("ordinal") % 3 == 0, "match").when(F.col("ordinal") % 3 == 1, "ambiguous").otherwise("no-match").alias("status"))
    return S.skip_stats(E.propose_target_glosses(rows, m, m.where("false").select("entry_id"), ["noun"]))


@query("SELECT c_custkey AS key, problem FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'evidence' END, CASE WHEN c_custkey % 4 = 0 THEN 'provenance' END, CASE WHEN c_custkey % 5 = 0 THEN 'language' END, CASE WHEN c_custkey % 5 <> 0 AND c_mktsegment = 'BUILDING' THEN 'repeats-english' END], lambda x: x IS NOT NULL)) AS problem FROM customer)")
def validate_language_group(spark, sf):
    k = F.col("c_custkey")
    g = read(spark, sf, "customer").select(k.alias("sense_id"), F.lit("en").alias("lang"), F.when(k % 4 == 0, "source").otherwise("generated").alias("provenance"), F.when(k % 3 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), F.array().cast("array<string>").alias("ipa"), F.when(k % 5 == 0, "銀行").otherwise(F.col("c_mktsegment")).alias("text"))
    return V.validate_language_group(g, g.where("text = 'BUILDING'").select(F.lit(" building ").alias("text"))).select(F.col("key").cast("long").alias("key"), "problem")


@query("SELECT s_suppkey || '/1' AS key, problem FROM (SELECT s_suppkey, unnest(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'part-of-speech-not-in-vocabulary' END, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown-evidence' END, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0 THEN 'circular-gloss' END, CASE WHEN s_suppkey % 7 = 0 THEN 'reading' END, CASE WHEN s_suppkey % 11 = 0 THEN 'headword' END], lambda x: x IS NOT NULL)) AS problem FROM supplier) UNION ALL SELECT s_suppkey || '/e' || s_suppkey, 'omitted-evidence' FROM supplier WHERE s_suppkey % 3 = 0")
def validate_authored(spark, sf):
    k = F.col("s_suppkey")
    mine = F.concat(F.lit("e"), k.cast("string"))
    c = read(spark, sf, "supplier").select(
        k.alias("candidate_id"), F.lit(1).alias("sense_no"), F.when(k % 11 == 0, "bank").otherwise("銀行").alias("headword"), F.when(k % 7 == 0, "ginkou").otherwise("ぎんこう").alias("reading"), F.lit("ja").alias("lang"),
        F.array().cast("array<string>").alias("labels"), F.array(F.when(k % 5 == 0, "ぎんこうのこと").otherwise("おかねをあずけるところ")).alias("glosses"), F.array(F.when(k % 3 == 0, "e?").otherwise(mine)).alias("evidence_ids"), F.array(F.when(k % 2 == 0, "zz").otherwise("n")).alias("pos"),
    )
    e = c.select("candidate_id", F.concat(F.lit("e"), F.col("candidate_id").cast("string")).alias("evidence_id"), "pos", "labels")
    vocabulary = read(spark, sf, "region").where("r_regionkey = 0").select(F.lit("pos").alias("kind"), F.lit("n").alias("code"))
    return V.validate_authored(c, e, vocabulary)


@query(f"WITH {SENSES}, g AS (SELECT sense_id, string_agg(text, '/' ORDER BY position) AS g FROM glosses GROUP BY sense_id), x AS (SELECT sense_id, string_agg(text, '/' ORDER BY position) AS x FROM examples GROUP BY sense_id) SELECT s.entry_id, c_name AS headword, string_agg(s.position || ':' || s.sense_id || ':' || coalesce(g, '') || ':' || coalesce(x, ''), ',' ORDER BY s.position) AS senses FROM senses s JOIN customer ON c_custkey = s.entry_id LEFT JOIN g USING (sense_id) LEFT JOIN x USING (sense_id) WHERE lang = 'ja' GROUP BY s.entry_id, c_name")
def project_lookup(spark, sf):
    """The whole shape: headword, and the senses of one language with their glosses and examples."""
    s = Q.senses(spark, sf)
    own = lambda t: t.join(s.select("sense_id", "entry_id"), "sense_id")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("text"), F.lit(True).alias("common"), F.lit("kana").alias("kind"))
    rows = P.project_lookup(P.nest_entries(c, c, s, own(Q.glosses(spark, sf)), own(Q.examples(spark, sf))), "ja")
    flat = F.transform("senses", lambda x: F.concat_ws(":", x["position"].cast("string"), x["sense_id"].cast("string"), F.coalesce(F.array_join(x["glosses"], "/"), F.lit("")), F.coalesce(F.array_join(x["examples"], "/"), F.lit(""))))
    return rows.select("entry_id", "headword", F.array_join(flat, ",").alias("senses"))


@query("SELECT p_partkey AS entry_id, p_name AS text, CASE WHEN p_size % 2 = 0 THEN 'v5' ELSE 'adj-i' END AS rules, (CASE WHEN p_size % 3 = 0 THEN 1000000 ELSE 0 END - 10000 * (p_size % 4))::BIGINT AS score, p_type AS glossary FROM part WHERE p_size % 5 <> 0")
def japanese_term_rows(spark, sf):
    """One form and one sense per part; the sense of every fifth excludes the form."""
    p = read(spark, sf, "part")
    f = p.select(F.col("p_partkey").alias("entry_id"), (F.col("p_size") % 4).cast("long").alias("form_no"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("reading"), F.lit("kana").alias("kind"), (F.col("p_size") % 3 == 0).alias("common"))
    star = F.array(F.lit("*"))
    s = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_partkey").alias("sense_id"), F.lit("en").alias("lang"), F.lit(1).alias("position"), F.array(F.when(F.col("p_size") % 2 == 0, "v5k").otherwise("adj-i")).alias("part_of_speech"), star.alias("applies_to_kanji"), F.when(F.col("p_size") % 5 == 0, F.array(F.lit("other"))).otherwise(star).alias("applies_to_kana"))
    g = p.select(F.col("p_partkey").alias("sense_id"), F.lit(1).alias("position"), F.col("p_type").alias("text"))
    return P.term_rows_ja(f, s, g, "en").select("entry_id", "text", "rules", "score", F.array_join("glossary", ",").alias("glossary"))


@query("SELECT s_suppkey, CASE WHEN b THEN CASE WHEN s_suppkey % 2 = 0 THEN 'US' ELSE 'UK' END ELSE '' END AS regions, CASE WHEN s_suppkey % 3 = 0 THEN 'figurative' ELSE 'slang' END AS registers, s_suppkey % 5 = 0 AS dated FROM (SELECT s_suppkey, s_suppkey % 7 <> 0 AS b FROM supplier)")
def sense_labels(spark, sf):
    k = F.col("s_suppkey")
    tags = F.array_compact(F.array(F.when(k % 7 != 0, F.when(k % 2 == 0, "American").otherwise("British")), F.when(k % 3 == 0, "figuratively"), F.when(k % 5 == 0, "obsolete"), F.lit("noun")))
    labels = X.sense_labels(tags, F.when(k % 3 != 0, F.array(F.lit("Slang"))), F.array(F.lit("law")))
    return read(spark, sf, "supplier").withColumn("l", labels).select("s_suppkey", F.array_join("l.regions", ",").alias("regions"), F.array_join("l.registers", ",").alias("registers"), F.col("l.dated").alias("dated"))
