import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glossmill.functions import segment as G
from glossmill.functions import text as X
from glossmill.operators import evidence as E
from glossmill.operators import lookup as L
from glossmill.operators import merge as M
from glossmill.operators import order as O
from glossmill.operators import release as P
from glossmill.operators import retain as T
from glossmill.plans import registry
from glossmill.sources import files as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("surface", "lexicon", "lemma"),
    [("died", ["die", "dy"], "die"), ("skied", ["ski", "sky"], "ski"), ("crappier", ["crappy", "crappie"], "crappy"), ("cashier", ["cash"], None), ("saves", ["save", "safe"], "save"), ("spelled", ["spell"], "spell"), ("picnicked", ["picnic"], None), ("bases", ["base", "bas"], "base"), ("children", ["child"], None), ("running", ["run"], "run"), ("bus", ["bus", "bu"], "bus"), ("robots", ["robot"], "robot"), ("studied", ["study"], "study")],
)
def test_lemma_cases(spark, surface, lexicon, lemma):
    got = L.resolve_lemma(spark.createDataFrame([(surface,)], "surface string"), spark.createDataFrame([(x,) for x in lexicon], "term string"))
    assert [tuple(r) for r in got.collect()] == [(surface, lemma)]


def test_bare_suffixes_have_no_candidates(spark):
    d = spark.createDataFrame([("s",), ("ing",), ("est",), ("men",), (None,)], "w string")
    assert all(not r.c for r in d.select(X.english_lemma_candidates(F.col("w")).alias("c")).collect())


def test_deinflection(spark):
    got = one(spark, F.transform(X.deinflect(F.col("w")), lambda c: c["text"]), w="食べました")
    assert "食べる" in got and "食べました" not in got
    reasons = {r["text"]: r["reasons"] for r in one(spark, X.deinflect(F.col("w")), w="食べられた")}
    assert reasons["食べる"][0] == "ichidan passive past"


def test_tiers_do_not_mix(spark):
    forms = spark.createDataFrame([(1, "舌", "した", "kanji", False), (1, "した", None, "kana", False), (2, "下", "した", "kanji", True), (2, "した", None, "kana", True), (3, "する", None, "kana", True), (4, "知る", "しる", "kanji", True), (4, "しる", None, "kana", True)], "entry_id long, text string, reading string, kind string, common boolean")
    entries = spark.createDataFrame([(k, "N5") for k in range(1, 5)], "entry_id long, level string")
    senses = spark.createDataFrame([(1, "en"), (2, "en"), (3, "en"), (4, "en"), (3, "ko")], "entry_id long, lang string")
    q = spark.createDataFrame([("した",), ("しった",)], "query string")
    got = {(r.query, r.entry_id, r.place) for r in L.lookup_japanese(q, forms, entries, senses, "en").collect()}
    assert {x for x in got if x[0] == "した"} == {("した", 2, 1), ("した", 1, 2)} and ("しった", 4, 1) in got
    other = {(r.query, r.entry_id) for r in L.lookup_japanese(q, forms, entries, senses, "ko").collect()}
    assert ("した", 1) not in other


def test_batch_keeps_order_and_repeats(spark):
    req = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "a", None), (4, "b", "b")], "request_no long, query string, lemma string")
    ans = spark.createDataFrame([("a", 7, 2), ("a", 5, 1)], "query string, entry_id long, place int")
    got = {r.request_no: (r.entry_id, r.alternatives) for r in L.lookup_batch(req, ans).collect()}
    assert got == {1: (5, "7"), 2: (5, "7"), 3: (5, "7"), 4: (None, "")}


def test_form_senses(spark):
    drop = ["plural of canvas", "More than one pentagon; plural of pentagon", "Chihuahuas is the plural of chihuahua.", "The plural or third-person singular of shoe.", "the past tense and past participle of rebuild"]
    keep = ["most important.", "More than needed.", "Alternative form of intrigue.", "(usually plural) a statement that is made"]
    rows = spark.createDataFrame([(x,) for x in drop + keep], "g string").select(X.states_only_inflection(F.col("g")).alias("x")).collect()
    assert [r.x for r in rows] == [True] * len(drop) + [False] * len(keep)


def test_form_senses_as_one_pattern_and_cheap(spark):
    name = "(?:plural|past tense|past participle|present participle|third[- ]person singular|comparative|superlative)"
    form = rf"(?:alternative\s+|present\s+)?{name}(?:\s+(?:and|or)\s+(?:the\s+)?{name})*(?:\s+form)?\s+of\s+\S"
    stated = re.compile(rf"^(?:(?:the\s+)?{form}|more than one\s+\S|\S+\s+is\s+(?:an?\s+|the\s+)?{form})", re.I)
    rng = random.Random(3)
    words = ["plural", "Plural", "past tense", "present participle", "third-person singular", "third person singular", "present", "alternative", "form", "of", "of", "the", "an", "is", "and", "or", "bank", "more than one", ";", "; ", ".", " ", "¤", "plurals"]
    likely = ["the plural form of x", "X is an alternative comparative or the past tense of y", "more than one bank", "¤ of bank", "plural of", "past tense and of x"]
    long = [" and plural" * 3000, "plural of x; " * 3000, "plural of x; " * 3000 + "y", "plural" + " and plural" * 3000 + " of x"]
    glosses = likely + long + ["", ";", "...", "plural of x;;", "plural of bank;  .", "plural of ."] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["; ".join(rng.choice(likely) for _ in range(3)) for _ in range(200)]

    def wanted(gloss):
        clauses = [c for c in (x.strip() for x in re.sub(r"\.+$", "", gloss).split(";")) if c]
        return bool(clauses) and all(stated.search(c) for c in clauses)

    states = X.states_only_inflection(F.col("gloss_text"))
    rows = spark.createDataFrame([(g,) for g in glosses], "gloss_text string").select("gloss_text", states.alias("x")).collect()
    assert [(r.gloss_text, r.x) for r in rows] == [(g, wanted(g)) for g in glosses] and sum(r.x for r in rows) > 50
    assert str(states).count("gloss_text") == 2  # each further one multiplies with those of what the result is used in


def test_records_of_forms_at_little_cost(spark):
    none = F.lit(None)
    sense = lambda g: F.struct(F.lit("s").alias("id"), g.alias("glosses"), *(none.cast("array<string>").alias(c) for c in ("tags", "raw_tags", "topics", "categories")), none.cast("array<struct<text:string>>").alias("examples"))
    rows = spark.createDataFrame([("bank", ["a shore"], ["plural of x; more than one x", "plural of x"]), ("banks", ["plural of bank"], [" "]), ("shore", ["a bank"], ["plural of x", "a shop"])], "word string, g array<string>, h array<string>")
    entries = rows.select("word", F.lit("noun").alias("pos"), F.lit("en").alias("lang_code"), F.lit(1).alias("etymology_number"), F.array(sense(F.col("g")), sense(F.col("h"))).alias("senses"), none.cast("array<struct<ipa:string,tags:array<string>>>").alias("sounds"))
    out = E.wiktionary_records(entries, "v1")
    assert {r.headword: [s.gloss for s in r.senses] for r in out.collect()} == {"bank": ["a shore"], "shore": ["a bank", "plural of x"]}
    assert len(str(X.is_inflected_form_sense(F.col("glosses"), F.col("tags"), F.col("categories")))) < 5000


def test_senses_of_records_are_made_once_in_many_tasks(spark, monkeypatch):
    none = F.lit(None)
    words = [("bank", "noun", "en"), (" bank ", "noun", "en"), ("\ufeff\u3000", "noun", "en"), (None, "noun", "en"), ("12", "noun", "en"), ("x", "name", "en"), ("x", None, "en"), ("x", "adj", "de"), ("y", "Adj", "en")]
    senses = "array(named_struct('id', 's', 'glosses', array(' ', null, 'a shore '), 'tags', array('US', ' ', 'slang'), 'raw_tags', array('US', 'Dated'), 'topics', array('law', ''), 'categories', cast(null as array<string>), 'examples', array(named_struct('text', '\u3000 by \n'), named_struct('text', '')), 'translations', cast(null as array<int>)))"
    rows = spark.createDataFrame(words, "word string, pos string, lang_code string").select("*", F.expr(f"if(pos = 'Adj', array(), {senses})").alias("senses"), F.lit(2).alias("etymology_number"), F.expr("array(named_struct('ipa', ' i ', 'tags', array('UK')), named_struct('ipa', '\t', 'tags', array('UK')))").alias("sounds"))
    out = E.wiktionary_records(rows.withColumn("senses", F.when(F.col("word") != "none", F.col("senses"))), "v1")
    assert out.columns == ["headword", "pos", "record", "source_version", "senses", "pronunciations"]
    got = [r.asDict(True) for r in out.collect()]
    labels = {"registers": ["slang"], "regions": ["US"], "domains": ["law"], "dated": True, "usage": []}
    sense = {"evidence_id": "wiktionary:en:bank:noun:2:1", "gloss": "a shore ", "labels": labels, "examples": ["by"]}
    assert got == [{"headword": "bank", "pos": "noun", "record": "en:bank:noun:2", "source_version": "v1", "senses": [sense], "pronunciations": [{"no": 1, "ipa": "i", "region": "UK"}]}] * 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("wiktionary:") == 1  # twice, before
    monkeypatch.setattr(registry, "TASK_ENTRIES", 40)
    assert registry.evidence_entries(spark, "/root/testdata/sf0.001", dealt=True).select(F.spark_partition_id()).distinct().count() > 2


def test_blank_and_trimmed_texts(spark):
    texts = [None, "", " ", "\n", "\u3000\ufeff\u00a0\t", "a", " a\n", "\ufeffa b\u3000", "\u200b", "𝒳 ", "\u0085", "\x1f", "¤"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("t", X.trim(F.col("t")).alias("trimmed"), X.nonempty(F.col("t")).alias("some"), X.string_list(F.array("t")).alias("listed")).orderBy("k").collect()
    assert [(r.some, r.listed) for r in rows] == [(r.trimmed or None, [r.t] if r.trimmed else []) for r in rows]


def test_concepts_of_terms_are_numbered_in_many_tasks(spark, monkeypatch):
    rng = random.Random(4)
    acc = [(rng.randrange(10**6) * 1000 + k, f"l{k}", f"pwn-{rng.randrange(6)}") for k in range(400)]
    senses = [(k, f"oewn-{c}", t, f"p{k}") for k, (c, t) in enumerate((c, t) for t, cs in {"a": [0, 1, 2], "b": [2, 1, 0, 1], "c": [3], "d": [0, 1, 2, 3, 9], "e": [5]}.items() for c in cs)]
    first: dict = {}
    for _, synset, term, pos in senses:
        first.setdefault((synset[5:], term), pos)
    want, seen = [], {}
    for o, lemma, synset in sorted(acc):
        for (key, term), pos in first.items():
            if key == synset[4:]:
                seen[term] = seen.get(term, 0) + 1
                want.append((o, lemma, term, pos, seen[term]))
    for few in (1000, 0):
        monkeypatch.setattr(M, "FEW_HOLDERS", few, raising=False)
        out = M.publish_concepts(spark.createDataFrame(acc, "ordinal long, lemma string, pwn_synset string"), spark.createDataFrame(senses, "ordinal int, synset string, term string, pos string"), range_rows=20)
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)
        if few:
            assert out.where("term = 'a'").select(F.spark_partition_id()).distinct().count() > 3  # one task for a term, before


def test_batch_lookup_deals_frequent_words_and_rows_without_a_lemma(spark, monkeypatch):
    monkeypatch.setattr(L, "KEY_ROWS", 20, raising=False)
    rows = [(k, "the" if k % 2 else f"w{k % 7}", [None, "the", "w1", "zz"][k % 4] if k % 3 else None) for k in range(400)] + [(1000, None, "the"), (1001, None, None)]
    answers = [("the", 5, 1), ("the", 6, 2), ("w1", 7, 1), ("w2", 8, 1)]
    known: dict = {}
    for q, e, _ in answers:
        known.setdefault(q, []).append(e)
    want = {}
    for n, q, lemma in rows:
        hits = known.get(q) or (known.get(lemma) if q is not None and lemma is not None and lemma != q else None) or [None]
        want[n] = (hits[0], ",".join(map(str, hits[1:])))
    given = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        out = L.lookup_batch(spark.createDataFrame(rows, "request_no long, query string, lemma string"), spark.createDataFrame(answers, "query string, entry_id long, place int"))
        got = out.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and {r.request_no: (r.entry_id, r.alternatives) for r in got} == want
    assert len({r.task for r in got if r["query"] == "the"}) > 1  # all of a word in one task, before, and all that lack a lemma


def test_scripts_and_gates(spark):
    rows = [("en", "a bank", False), ("en", "銀行", True), ("ja", "おかね", False), ("ja", "银行", True), ("ko", "은행", False), ("ko", "bank", True), ("zh-tw", "銀行", False), ("zh-cn", "bank", True), ("en", " ", True), ("en", None, True)]
    got = spark.createDataFrame(rows, "lang string, t string, bad boolean").select("bad", X.invalid_explanation_text(F.col("lang"), F.col("t")).alias("x")).collect()
    assert all(r.bad == r.x for r in got)
    assert one(spark, X.normalize_english_term(F.col("w")), w="　Ｆｕｌｌ  Width ") == "full width"
    assert one(spark, X.is_circular_gloss(F.col("g"), F.array("t")), g="「ぎんこうのこと」。", t="ぎんこう")
    assert one(spark, X.english_sentence_contains(F.col("s"), F.col("h")), s="He runs, and robots walk.", h="Robot")
    assert one(spark, X.clean_target_gloss(F.col("g")), g=" 은행 (銀行) ") == "은행"


def test_sense_restrictions(spark):
    star = ["*"]
    rows = [("kana", "なまもの", None, star, ["なまもの"], True), ("kanji", "生物", "なまもの", star, ["なまもの"], True), ("kanji", "生物", "せいぶつ", star, ["なまもの"], False), ("kana", "せいぶつ", None, ["生物"], star, True), ("kanji", "生物", None, star, ["なまもの"], True)]
    df = spark.createDataFrame(rows, "kind string, t string, r string, a array<string>, b array<string>, want boolean")
    assert all(r.want == r.x for r in df.select("want", X.sense_applies_to(F.col("kind"), F.col("t"), F.col("r"), F.col("a"), F.col("b")).alias("x")).collect())


def test_regional_terms_and_japanese_sentences(spark):
    policy = [{"term": "軟件", "replacement": "軟體", "context": ["電腦"]}, {"term": "質量", "replacement": "品質", "allowed": ["質量守恆"]}]
    d = spark.createDataFrame([("電腦軟件，軟件",), ("質量守恆",), ("質量好",), ("plain",), (None,)], "t string")
    got = [[(m.term, m["index"]) for m in r.regional] for r in G.find_regional_terms(d, "t", policy).collect()]
    assert got == [[("軟件", 2)], [], [("質量", 0)], [], []]
    s = spark.createDataFrame([("昨日パンを食べました。", "食べる", True), ("見る。", "見る", True), ("何もない", "食べる", False), (None, "x", None)], "s string, h string, want boolean")
    assert all(bool(r.want) == bool(r.x) for r in s.select("want", G.japanese_sentence_contains(F.col("s"), F.col("h")).alias("x")).collect())


def dump(word, translations, senses=1, local=()):
    t = lambda code, term, hint=None: {"code": code, "word": term, "sense": hint}
    return {"word": word, "pos": "noun", "lang_code": "en", "senses": [{"id": f"s{k}", "glosses": [f"gloss {k}."], "translations": [t(*x) for x in local] if k == 0 else []} for k in range(senses)], "translations": [t(*x) for x in translations]}


LINES = [
    dump("bank", [("zh", "銀行", "gloss 1"), ("ja", "", None), ("fr", "banque", None)], 2, [("ja", "銀行"), ("cmn", "bank"), ("ja", "please add this")]),
    dump("bank", [("ja", "岸, 堤", None)], 2),
    {"word": "Bank", "lang_code": "de", "translations": [{"code": "ja", "word": "銀行"}]},
    dump("shore", [("zh-tw", "岸", None)], 1),
]


@pytest.fixture
def entries(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text("\n".join(map(json.dumps, LINES[:2])) + "\n\n" + "\n".join(map(json.dumps, LINES[2:])))
    return S.read_jsonl(spark, str(tmp_path / "dump.jsonl"), E.ENTRY_SCHEMA)


def test_evidence(spark, entries):
    tw = spark.createDataFrame([("Shore ", "岸", "gov"), ("shore", "岸", "gov")], "english string, chinese string, support string")
    kept, rows = E.filter_evidence(entries, "wiktionary", "en", "v1", taiwan=tw)
    got = {(r.word, r.term): r for r in kept.collect()}
    assert set(got) == {("bank", "銀行"), ("bank", "岸, 堤"), ("shore", "岸")}
    assert got["shore", "岸"].locale == "zh-tw" and got["shore", "岸"].sense_index is None and not got["shore", "岸"].ambiguity
    assert len(got["bank", "岸, 堤"].ambiguity) == 2 and ":1#translations[0]" in got["bank", "岸, 堤"].evidence_id
    both = [r for r in kept.collect() if r.term == "銀行"]
    assert {(r.scope, r.sense_index) for r in both} == {("sense-local", 0), ("entry-level", 1)}
    cover = {r.lang: r for r in E.evidence_coverage(kept, rows).collect()}
    assert (cover["ja"].sense_local, cover["ja"].entry_level, cover["ja"].ambiguous, cover["ja"].rejected) == (1, 1, 1, 2)
    assert (cover["zh"].entry_level, cover["zh"].corroborated, cover["zh"].by_reason) == (2, 1, {"wrong-script": 1})
    few, _ = E.filter_evidence(entries, "wiktionary", "en", "v1", per_entry=1, total=2)
    assert few.count() == 2


def test_stream_gives_the_batch_rows(spark, entries, tmp_path):
    from glossmill.streaming import evidence as V

    folder = tmp_path / "in"
    folder.mkdir()
    for k, line in enumerate(LINES):
        (folder / f"{k}.json").write_text(json.dumps(line))
    q = V.stream_evidence(V.read_stream(spark, str(folder)), "wiktionary", "en", "v1").writeStream.format("memory").queryName("stream_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["word", "term", "lang", "scope", "sense_index"]
    batch = sorted(map(repr, E.evidence_rows(entries, "wiktionary", "en", "v1").select(cols).collect()))
    assert sorted(map(repr, spark.table("stream_rows").select(cols).collect())) == batch


def test_numbers_over_all_rows(spark):
    d = spark.range(0, 500, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), "id")
    got = O.global_number(d, ["k", "id"]).orderBy("k", "id").select("number").collect()
    assert [r.number for r in got] == list(range(500))
    s = d.select(F.col("k").cast("string").alias("s"), F.lit(2).alias("w"))
    assert [r.n for r in O.global_number(s, ["s"], "n", "w").orderBy("s").collect()] == list(range(0, 1000, 2))


def test_graft(spark):
    prod = spark.createDataFrame([(1, "generated", "学校"), (2, "jmdict", "犬")], "entry_id long, source string, term string")
    rel = spark.createDataFrame([(2, "jmdict", "犬"), (9, "jmdict", "学校")], "entry_id long, source string, term string")
    cols = "sense_id long, entry_id long, lang string, position int, generation_id string"
    ours = spark.createDataFrame([(10, 1, "zh-tw", 1, "g"), (11, 1, "en", 1, "g"), (12, 2, "en", 1, None)], cols)
    theirs = spark.createDataFrame([(90, 9, "en", 1, None), (91, 2, "en", 1, None)], cols)
    got = {(r.sense_id, r.entry_id, r.lang) for r in T.graft_release(prod, rel, theirs, ours).collect()}
    assert got == {(90, 9, "en"), (91, 2, "en"), (10, 9, "zh-tw")}


def test_lexicon_files_round_trip(spark, tmp_path):
    words = [{"id": "1", "kanji": [{"text": "生物", "common": True, "tags": []}], "kana": [{"text": "なまもの", "common": True, "tags": [], "appliesToKanji": ["*"]}], "sense": [{"partOfSpeech": ["n"], "appliesToKanji": ["*"], "appliesToKana": ["なまもの"], "gloss": [{"lang": "eng", "text": "raw food"}, {"lang": "ger", "text": "Rohkost"}]}]}]
    (tmp_path / "j.json").write_text(json.dumps({"version": "1", "words": words}))
    w, head = S.read_lexicon_json(spark, str(tmp_path / "j.json"))
    forms, senses, glosses = M.explode_words(w)
    assert head.first()["version"] == "1"
    assert {(r.text, r.reading) for r in forms.collect()} == {("生物", "なまもの"), ("なまもの", None)}
    assert [(r.lang, r.position) for r in senses.collect()] == [("en", 1)] and [r.text for r in glosses.collect()] == ["raw food"]
    own = lambda t: t.join(senses.select("sense_id", "entry_id"), "sense_id")
    nested = P.nest_entries(forms.select("entry_id").distinct(), forms, senses, own(glosses), own(glosses).where("false"))
    P.export_jsonl(nested, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert line["languages"]["en"][0]["glosses"] == ["raw food"]
    for n in range(1, 6):
        (tmp_path / f"n{n}.csv").write_text("jmdict_seq,kana,kanji,waller_definition\n1,a,b,c\nx,a,b,c\n" if n in (2, 4) else "jmdict_seq,kana,kanji,waller_definition\n5,a,b,c\n")
    got = {r.entry_id: r.level for r in M.assign_levels(forms.select("entry_id").distinct(), S.read_level_lists(spark, str(tmp_path))).collect()}
    assert got == {"1": "N4"}
    sums = S.file_checksums(spark, str(tmp_path / "j.json"))
    assert S.verify_checksums(sums, sums).count() == 0 and S.verify_checksums(sums.limit(0), sums).count() == 1


def test_staged_output_survives_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    S.publish_staged(spark, lambda p: spark.range(3).write.parquet(p), lambda p: None, path)

    def fail(p):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        S.publish_staged(spark, lambda p: spark.range(9).write.parquet(p), fail, path)
    assert spark.read.parquet(path).count() == 3
    S.publish_staged(spark, lambda p: spark.range(4).write.parquet(p), lambda p: None, path)
    assert spark.read.parquet(path).count() == 4


def test_every_query_with_sql_is_registered():
    from glossmill.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 80


def test_related_headwords(spark):
    from glossmill.operators import lookup as L

    rows = [("食べる", "食べました", None), ("学校", "校舎", None), ("猫", "いぬ", " "), ("ねこ", "x", "ねこ"), ("ねこ", None, None)]
    df = spark.createDataFrame(rows, "headword string, query string, lemma string")
    got = df.select(L.related_headword(F.col("headword"), [F.col("query"), F.col("lemma")], "ja")).collect()
    assert [r[0] for r in got] == [True, True, False, True, False]


def test_first_support_wins_by_ordinal(spark):
    from glossmill.operators import evidence as E

    rows = spark.createDataFrame([("bank", "銀行", "ja", "ja", []), ("bank", "岸", "zh", "zh", [])], "word string, term string, lang string, code string, qualifiers array<string>")
    ja = spark.createDataFrame([("銀行", "late", 7), ("銀行", "zz first", 2)], "term string, support string, ordinal int").repartition(2)
    tw = spark.createDataFrame([(" Bank", "岸", "b", 5), ("bank", "岸 ", "c", 1)], "english string, chinese string, support string, ordinal int").repartition(2)
    got = {r.term: (r.support, r.taiwan_support, r.locale) for r in E.corroborate(rows, ja, tw).collect()}
    assert got == {"銀行": ("zz first", False, "ja"), "岸": ("c", True, "zh-tw")}


def test_checksums_in_blocks_and_manifest(spark, tmp_path, monkeypatch):
    import hashlib
    import json

    from glossmill.operators import release as P
    from glossmill.operators import stats as S
    from glossmill.sources import files as I

    for k in range(3):
        (tmp_path / f"f{k}").write_bytes(bytes([k]) * (1000 * k + 1))
    want = {f"f{k}": hashlib.sha256(bytes([k]) * (1000 * k + 1)).hexdigest() for k in range(3)}
    for most in (1 << 30, 1500):  # beyond, files go block by block
        monkeypatch.setattr(I, "WHOLE_BYTES", most)
        assert {r.file: r.sha256 for r in I.file_checksums(spark, f"{tmp_path}/f*").collect()} == want
    assert I.sha256_in_blocks(f"file:{tmp_path}/f2", 100) == want["f2"]
    senses = spark.createDataFrame([(1, 1, "en"), (2, 1, "ja")], "sense_id int, entry_id int, lang string")
    empty = spark.createDataFrame([], "sense_id int")
    P.write_manifest(f"{tmp_path}/m", S.language_coverage(senses, empty, empty), {"senses": senses}, spark.createDataFrame([("b",), ("a",)], "name string"), I.file_checksums(spark, f"{tmp_path}/f*"), {"schema": "2"})
    got = json.loads(spark.read.text(f"{tmp_path}/m").collect()[0][0])
    assert got["schema"] == "2" and got["rows"] == {"senses": 2} and set(got["coverage"]) == {"en", "ja"} and [a["file"] for a in got["artifacts"]] == ["f0", "f1", "f2"] and [x["name"] for x in got["sources"]] == ["a", "b"]
    counts = S.import_stats(spark.createDataFrame([("secondary", "imported")], "stage string, outcome string"), {"secondary": S.STAGES["secondary"]})
    assert {(r.outcome, r.n) for r in counts.collect()} == {("imported", 1), ("dropped", 0)}


def test_graft_keeps_one_group_and_does_nothing_for_equal_versions(spark):
    from glossmill.operators import retain as T

    entries = spark.createDataFrame([("g1", "generated", "a"), ("g2", "generated", "b"), ("g3", "generated", "c")], "entry_id string, source string, term string")
    sense = "sense_id string, entry_id string, lang string, position int, generation_id string"
    senses = spark.createDataFrame([("s1", "g1", "en", 1, "x"), ("s2", "g2", "en", 1, "x"), ("s3", "g3", "en", 1, "x"), ("s4", "g2", "ja", 1, "x")], sense)
    text = "sense_id string, position int, text string"
    glosses = spark.createDataFrame([(f"s{k}", 1, f"own {k}") for k in range(1, 5)], text)
    examples = spark.createDataFrame([("s2", 1, "gone", "generated", "x"), ("s4", 1, "stays", "generated", "x")], text + ", source string, generation_id string")
    release = {"entries": spark.createDataFrame([("r", "jmdict", "a"), ("r", "jmdict", "b")], "entry_id string, source string, term string"), "senses": spark.createDataFrame([("r1", "r", "de", 1, None)], sense), "glosses": spark.createDataFrame([("r1", 1, "theirs")], text), "examples": examples.where("false")}
    production = {"entries": entries, "senses": senses, "glosses": glosses, "examples": examples}
    out = T.graft_tables(production, release, ("1", "2"))
    ids = lambda name: sorted(r[0] for r in out[name].select("entry_id" if name == "entries" else "sense_id").collect())
    assert ids("entries") == ["g3", "r", "r"] and ids("senses") == ["r1", "s1", "s3", "s4"] and ids("glosses") == ["r1", "s1", "s3", "s4"] and ids("examples") == ["s4"]
    assert {r.sense_id: r.entry_id for r in out["senses"].collect()} == {"r1": "r", "s1": "r", "s3": "g3", "s4": "r"}
    assert T.graft_tables(production, release, ("2", "2")) is production


def test_evidence_totals_stop_with_the_cap(spark):
    from glossmill.operators import evidence as E

    entries = spark.createDataFrame([(k, "w", "en" if k != 1 else "de") for k in range(6)], "ordinal int, word string, lang_code string")
    rows = spark.createDataFrame([(0, None), (0, None), (0, "bad"), (2, None), (3, None), (3, None), (5, None)], "ordinal int, rejection string")
    one = lambda **caps: tuple(E.evidence_totals(entries, rows, **caps).first())
    assert one() == (6, 5, 4, 6, False)
    assert one(total=3) == (6, 3, 2, 3, True)
    assert one(per_entry=1) == (6, 5, 4, 4, False)
