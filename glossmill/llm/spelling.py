"""Groups of spelling variants: words one letter apart, the rarer ones led to the form that is far more frequent.

Words of all texts are counted. Two words that differ by one replaced, deleted or inserted letter agree in one half of
the shorter one: in its first half, or in as many last letters as its second half has. So a word of n letters is
dealt by both halves to where it meets words of n letters and those of n + 1, and as the longer one to where it
meets those of n - 1. A task takes words that were dealt to it and searches them in a bidirectional FM-index of these words:
one half exactly, from its end mark on, the other letter by letter with at most one error, by intervals of suffix ranks.
A pair is counted where it is found by its first half, and by its last half only if the first differs. Tasks pass on
a number and the best neighbour for each word, no pairs.

A half that more than HALF_WORDS words have is divided: its words are dealt again, by the half together with the first or with the
last part of the other half, of which one must be exact too. Ways to deal are told apart by the common prefixes that their pairs can have.

Defined cases: a null text has no words; a null id counts as the empty text where it chooses letters to delete; rows may repeat
and count each; words of any length are searched whole; of several neighbours with most occurrences the first in
code-point order is taken; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import Index
from .frames import checkpoint, small

#: Words that a task gets on average, and of which more in one half make it divided.
SHARD_WORDS, HALF_WORDS = 50_000, 25_000
RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least: int = 2, damage: int | None = None) -> DataFrame:
    """word, n of the maximal runs of letters of whole texts, A-Z lower-cased; JVM functions alone, counted before they are shuffled.

    damage: of runs whose crc32 with the id it divides, the letter that the crc32 points at is deleted first."""
    text = F.col(text_col).cast("string")
    # shorter runs can't reach the least length, as letters are only deleted
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"([{RUN}]{{{least_letters},}})"), F.lit(1))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    runs = runs.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        runs = runs.withColumn("run", F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")))
    return runs.where(F.length("run") >= least_letters).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ways(words: DataFrame) -> DataFrame:
    """word, n, class (letters of the shorter word of a pair), ask (whether it is one), and for both halves: key, exact (letters), rightwards."""
    letters = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("class")).where("class > 0").withColumn("ask", F.length("word") == F.col("class"))
    return rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("rightwards")).withColumn("exact", F.when(F.col("rightwards"), F.floor(F.col("class") / 2)).otherwise(F.col("class") - F.floor(F.col("class") / 2)).cast("int"))


def deal(words: DataFrame, half_words: int = HALF_WORDS) -> DataFrame:
    """Rows of ways() with `key` (of words that must meet) and from_, to (the common prefixes, from and below, of the pairs to be counted there)."""
    w, c, e = F.col("word"), F.col("class"), F.col("exact")
    first, last = lambda n: w.substr(F.lit(1), n), lambda n: w.substr(F.length("word") - n + 1, n)
    half = F.when(F.col("rightwards"), first(e)).otherwise(last(e))
    rows = ways(words).withColumn("half", F.xxhash64("class", "rightwards", half))
    often = rows.groupBy("half").agg(F.count("*").alias("many")).where(F.col("many") > half_words).select("half", F.lit(True).alias("often"))
    rows = rows.join(small(often), "half", "left")
    k = F.floor(c / 2).cast("int")  # letters of the first half
    no_end = F.lit(2**31 - 1)
    way = lambda a, b, start, end: F.struct(F.xxhash64("class", "rightwards", F.lit("|"), a, F.lit("|"), b).alias("key"), start.cast("int").alias("from_"), end.cast("int").alias("to"))
    none, zero = F.lit(""), F.lit(0)
    more, part = k + F.floor((c - k) / 2).cast("int"), F.floor(k / 2).cast("int")
    whole = F.array(F.when(F.col("rightwards"), way(first(k), none, zero, no_end)).otherwise(way(none, last(c - k), zero, k)))
    divided = F.when(F.col("rightwards"), F.array(way(first(more), none, more, no_end), way(first(k), last(c - more), zero, more)))
    divided = divided.otherwise(F.array(way(first(part), last(c - k), part, k), way(none, last(c - part), zero, part)))
    return rows.select("word", "n", "ask", "rightwards", "exact", F.explode(F.when(F.col("often"), divided).otherwise(whole)).alias("w")).select("word", "n", "ask", "rightwards", "exact", "w.*")


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS, half_words: int = HALF_WORDS) -> DataFrame:
    """words(word, n), distinct -> word, n_near, best_n, best: summed and best over tasks are the neighbours of a word; words without any are left out."""
    rows = checkpoint(deal(words, half_words))
    shards = max(1, -(-rows.count() // shard_words))
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).drop("key").repartition(shards, "shard")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        text = t.column("word").combine_chunks().dictionary_encode()
        names = text.dictionary.to_pylist()
        by_name = sorted(range(len(names)), key=names.__getitem__)
        number = np.empty(len(names), np.int64)
        number[by_name] = np.arange(len(names))
        word = number[text.indices.to_numpy()]
        names = [names[i] for i in by_name]
        n = np.zeros(len(names), np.int64)
        n[word] = t.column("n").to_numpy()
        ask, right, exact, from_, to = (t.column(c).to_numpy(zero_copy_only=False) for c in ("ask", "rightwards", "exact", "from_", "to"))
        index, pairs = Index(names), []
        for side in (True, False):
            # a word that is dealt here in several ways asks once for each
            rows = np.flatnonzero(ask & (right == side))
            q, other, same = index.near(word[rows], exact[rows], side)
            q = rows[q]
            keep = (same >= from_[q]) & (same < to[q])
            pairs.append((word[q[keep]], other[keep]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        longer = index.length[b] > index.length[a]
        one, two = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
        order = np.lexsort((two, -n[two], one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        count = np.diff(np.append(first, len(one)))
        best = two[first]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in one[first]], pa.string()), pa.array(count), pa.array(n[best]), pa.array([names[i] for i in best], pa.string())], names=["word", "n_near", "best_n", "best"])

    return dealt.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches(run(t.to_batches())), "word string, n_near long, best_n long, best string")


def follow(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the last form that a word is led to. Steps double, so that their number is the logarithm of the longest chain."""
    led = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        step = led.join(led.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        led = checkpoint(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not led.where("moved").limit(1).count():
            return led.drop("moved")
        led = led.drop("moved")


def group_spellings(words: DataFrame, ratio: int = 10, shard_words: int = SHARD_WORDS, half_words: int = HALF_WORDS) -> DataFrame:
    """words(word, n), distinct -> word, form (its neighbour with most occurrences if these are `ratio` times its own, else null), root, n, n_near, form_n."""
    words = checkpoint(words.select("word", F.col("n").cast("long").alias("n")))
    near = neighbours(words, shard_words, half_words)
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    both = words.select("word", "n", *none).unionByName(near.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))))
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    leads = -F.col("b.minus") >= F.lit(ratio) * F.col("n")
    found = checkpoint(found.select("word", F.when(leads, F.col("b.best")).alias("form"), "n", "n_near", F.when(leads, -F.col("b.minus")).alias("form_n")))
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc32_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        out.append(n)
    return out


#: The registered query in DuckDB, over the table `documents`: pairs by equal words after a deletion.
SQL = f"""WITH RECURSIVE crc AS (SELECT {_crc32_table()}::BIGINT[] AS tab),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
    hexed AS (SELECT run, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7),
    hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM hexed, crc),
    damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
    v AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    gaps AS (SELECT word, k, left(word, k) || substr(word, k + 2) AS d FROM (SELECT word, unnest(range(0, length(word))) AS k FROM v)),
    pairs AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.k = b.k AND a.d = b.d AND a.word <> b.word UNION SELECT g.word, w.word FROM gaps g JOIN v w ON g.d = w.word UNION SELECT w.word, g.word FROM gaps g JOIN v w ON g.d = w.word),
    best AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, struct_pack(a := -o.n, b := p.other)) AS best, max(o.n) AS best_n FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word),
    led AS (SELECT v.word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root, 0 AS step FROM led UNION ALL SELECT c.word, l.form, step + 1 FROM chain c JOIN led l ON l.word = c.root WHERE l.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
    SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM led JOIN roots USING (word)"""
