"""Quality rules held at the level of hosts.

Each text is measured once, whole: words, their code points, symbols, repeated lines, words in repeated
windows of three. Rules that mark a single text as bad whatever its host (the base) drop it. The softer
rules are weighed by host: failures are added up for each host, the rates are shrunk towards the rate of
all documents by a beta prior whose strength is estimated from how much hosts differ, and a host whose
shrunk rate for a rule is high is held to that rule: its documents that fail it go. A document that
fails no rule stays on any host.

Only counts are shuffled: hosts by partial sums, the verdicts back by a join on the host, broadcast when
they were counted and found few, else with AQE splitting a frequent host.

Defined cases: a null text has no words and fails the base, as does an empty one; a null host is the host
without a name; rows that share an id are judged each by its own text; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, small

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no code point.
REST = bytes(range(0x80, 0xC0))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that is found twice or more. Windows are compared by their words' numbers, exactly."""
    if len(words) < 4:
        return 0
    column = pa.array(words, pa.binary()).dictionary_encode()
    ids, kinds = column.indices.to_numpy().astype(np.int64), len(column.dictionary)
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:  # three numbers would not fit in 63 bits
        found, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * kinds + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes split at ASCII white space alone
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, SPACE + REST)), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host and the measures of its whole text; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure((x.as_py() or "").encode()) for x in batch.column(2)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], names=["id", "host", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("id", id_col)


#: The rules of the base, of which any drops a text.
BASE = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
#: The rules that count on hosts that often fail them.
SOFT = {"symbols": "10 * n_symbols > n_words", "lines": "100 * n_dup_lines > 30 * n_lines", "lengths": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)"}


def host_rates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """host, host_docs and for each rule the shrunk rate `rate_<rule>`, from 0 to 1.

    The prior is a beta distribution around the rate of all documents. Its strength is that of the beta-binomial by moments:
    with N documents on H hosts, mean m and S the sum of n (p - m)^2 over hosts, the share of variance between hosts is
    r = (S - (H - 1) m (1 - m)) / ((N - sum n^2 / N) m (1 - m)), and a prior of 1 / r - 1 documents is added to each host. Where hosts
    differ no more than chance (r <= 0), and for a single host, the prior weighs as much as all documents. One row reaches the driver."""
    sums = [F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in rules.items()]
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), *sums)
    n = F.col("host_docs")
    totals = [F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n.cast("double") * n).alias("squares")]
    totals += [x for name in rules for x in (F.sum(f"f_{name}").alias(f"all_{name}"), F.sum(F.col(f"f_{name}").cast("double") * F.col(f"f_{name}") / n).alias(f"sq_{name}"))]
    total = hosts.agg(*totals).first()

    def shrunk(name: str) -> Column:
        docs = total["docs"] or 1
        mean = (total[f"all_{name}"] or 0) / docs
        spread, between = mean * (1 - mean), docs - (total["squares"] or 0) / docs
        share = ((total[f"sq_{name}"] or 0) - docs * mean * mean - (total["hosts"] - 1) * spread) / (between * spread) if spread > 0 and between > 0 else 0
        strength = min(1 / share - 1, docs) if share > 1e-9 else docs
        strength = max(strength, 0.0)
        return F.round((F.col(f"f_{name}") + F.lit(strength * mean)) / (n + F.lit(float(strength))), 6)

    return hosts.select("host", "host_docs", *(shrunk(name).alias(f"rate_{name}") for name in rules))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", held_rate: float = 0.05) -> DataFrame:
    """Per row: id, the measures, base_failed, kept, the host, its number of documents and shrunk rates, and `held_to`, the soft rules that its host is held to.

    A host is held to a soft rule if its shrunk rate of failures is at least `held_rate`."""
    measured = checkpoint(measure_documents(docs, id_col, text_col, host_col))
    rates = host_rates(measured, BASE | SOFT)
    held = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"rate_{r}") >= held_rate, r) for r in sorted(SOFT)))), ",")
    out = measured.join(small(rates.withColumn("held_to", held)), "host")
    failed = F.lit(False)
    for name, rule in SOFT.items():
        failed = failed | ((F.col(f"rate_{name}") >= held_rate) & F.expr(rule))
    base = F.expr(" or ".join(f"({r})" for r in BASE.values()))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~failed).select(id_col, *MEASURES, "base_failed", "kept", "host", "host_docs", *(f"rate_{r}" for r in BASE | SOFT), "held_to")


def _sql() -> str:
    words = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    rules = BASE | SOFT
    counts = ", ".join(f"count(*) FILTER (WHERE {rule})::BIGINT AS f_{name}" for name, rule in rules.items())
    totals = ", ".join(f"sum(f_{name})::DOUBLE / sum(host_docs) AS m_{name}, sum(f_{name}::DOUBLE * f_{name} / host_docs) AS s_{name}" for name in rules)
    share = ", ".join(f"CASE WHEN m_{name} * (1 - m_{name}) > 0 AND docs - squares / docs > 0 THEN (s_{name} - docs * m_{name} * m_{name} - (hosts - 1) * m_{name} * (1 - m_{name})) / ((docs - squares / docs) * m_{name} * (1 - m_{name})) ELSE 0 END AS r_{name}" for name in rules)
    strength = lambda n: f"greatest(CASE WHEN r_{n} > 1e-9 THEN least(1 / r_{n} - 1, docs) ELSE docs END, 0)"
    rates = ", ".join(f"round((f_{n} + {strength(n)} * m_{n}) / (host_docs + {strength(n)}), 6) AS rate_{n}" for n in rules)
    held = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN rate_{n} >= 0.05 THEN '{n}' END" for n in sorted(SOFT)) + "], lambda x: x IS NOT NULL), ',')"
    soft = " OR ".join(f"(rate_{n} >= 0.05 AND ({rule}))" for n, rule in SOFT.items())
    return f"""WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {words} AS w FROM documents),
        pos AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM rows_), win AS (SELECT r, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY r ORDER BY p)),
        twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM twice) GROUP BY r),
        ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM rows_) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
        m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM rows_ LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
        h AS (SELECT host, count(*) AS host_docs, {counts} FROM m GROUP BY host), t AS (SELECT count(*) AS hosts, sum(host_docs)::DOUBLE AS docs, sum(host_docs::DOUBLE * host_docs) AS squares, {totals} FROM h), q AS (SELECT *, {share} FROM t),
        v AS (SELECT host, host_docs, {rates} FROM h, q)
        SELECT doc_id, {", ".join(MEASURES)}, {" OR ".join(f"({x})" for x in BASE.values())} AS base_failed, NOT ({" OR ".join(f"({x})" for x in BASE.values())}) AND NOT ({soft}) AS kept, host, host_docs, {", ".join(f"rate_{n}" for n in rules)}, {held} AS held_to FROM m JOIN v USING (host)"""


#: The same in DuckDB, over the table `documents`.
SQL = _sql()
