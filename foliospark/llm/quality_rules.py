"""Quality rules [native]: a ledger of rule bits, policies over it, and ablations.

Every rule is evaluated once per document. ``ledger`` stores the measurements
and one ``long`` whose bit i says that rule i failed; a policy is a bit mask
(with a version), so a policy is applied, changed or ablated by bit operations on the
ledger, without looking at a text again. DataFrame functions only.

Null text: no words, so the word rules see 0. Empty tables give empty results.
Repeated rows are judged row by row. Extra columns are kept by ``ledger``
unless they carry a ledger column's name, which the ledger then replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WHITE, blank_words, fresh_name, let, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is an SQL condition over the measurements."""

    name: str
    fails: str


#: Bit i of a mask belongs to rule i; new rules are appended, never reordered.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("capitals", "10 * n_upper > 4 * word_chars"),
    Rule("exclamations", "10 * n_exclaim > 4 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: documents with any of these bits go. In v2 many_words is only measured, as length alone is no fault.
POLICIES = {"base": BASE, "v1": sum(BIT.values()), "v2": sum(BIT.values()) & ~BIT["many_words"]}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim")


def _without(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` a text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column, n: int = 3) -> Column:
    """Words inside n-word windows that occur twice or more in the array."""

    def covered(ws):
        windows = F.transform(
            F.sequence(F.lit(0), F.size(ws) - n),
            lambda i: F.struct(F.xxhash64(*[F.get(ws, i + j) for j in range(n)]).alias("h"), i.alias("i")),
        )

        def twice(s):
            same = F.filter(
                s,
                lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]),
            )
            spread = F.flatten(F.transform(same, lambda x: F.array(*[x["i"] + j for j in range(n)])))
            return F.size(F.array_distinct(spread)).cast("long")

        return let(F.sort_array(windows), twice)

    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(covered(words))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits`` of every rule."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, rows = fresh_name(docs, "_words"), fresh_name(docs, "_lines")
    ws = F.col(words)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " " + WHITE, "")) > 0)
    out = (
        docs.drop(*[c for c in (*MEASURES, "fail_bits") if c != text and c in docs.columns])
        .withColumn(words, blank_words(F.col(text)))
        .withColumn(rows, lines)
        .withColumns({
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.length(F.translate(t, " " + WHITE, "")).cast("long"),
            "n_symbols": _without(t, SYMBOLS),
            "n_lines": F.size(rows).cast("long"),
            "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(F.col(rows)))).cast("long"),
            "n_repeat_words": let(ws, _repeat_words),
            "n_upper": _without(t, UPPER),
            "n_exclaim": _without(t, "!"),
        })
        .drop(words, rows)
    )
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def verdict(policy: int | str = "v1") -> Column:
    """Whether a ledger row passes a policy, given by version or as a mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def sole_fault(policy: int | str = "v1") -> Column:
    """The rule without which a policy would keep a row that it rejects; null for kept rows and for several faults."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    return F.when(F.bit_count(hit) == 1, F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(BIT[r.name]).cast("long"), F.lit(r.name))]), hit))


def ablate(rows: DataFrame, policy: int | str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay without it.

    The ledger is first summed up by mask (at most 2^rules rows, added up
    before the shuffle), so the rules never meet the documents again.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    by_mask = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & mask]
    m, bit = F.col("m"), F.col("r.bit")
    return (
        by_mask.select("m", "n", F.explode(F.array(*each)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(m.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(m == bit, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when((m == 0) | (m == bit), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, policy: int | str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns."""
    clash = [c for c in (*MEASURES, "fail_bits") if c in docs.columns and c != text]
    own = fresh_name(docs, "_own")
    held = docs.withColumn(own, F.struct(*[F.col(c) for c in clash])) if clash else docs
    kept = ledger(held, text).where(verdict(policy))
    if clash:
        kept = kept.withColumns({c: F.col(f"{own}.{c}") for c in clash})
    return kept.select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, the base verdict, the verdicts of both policies, and what each document alone fails by."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict("base")).alias("base_failed"), verdict("v1").alias("kept"), "fail_bits",
        verdict("v2").alias("kept_v2"), sole_fault("v1").alias("kept_without"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ 	

]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	

]')) AS lines
  FROM documents),
win AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
tri AS (
  SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM win),
rep AS (
  SELECT rid, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM rep GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
         length(t) - length(translate(t, '!', '')) AS n_exclaim
  FROM d LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_upper > 4 * word_chars THEN 128 ELSE 0 END
    + CASE WHEN 10 * n_exclaim > 4 * n_words THEN 256 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, fail_bits IN (0, 4) AS kept_v2,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'many_words' WHEN 8 THEN 'short_words' WHEN 16 THEN 'long_words'
                      WHEN 32 THEN 'symbols' WHEN 64 THEN 'repeated_lines' WHEN 128 THEN 'capitals' WHEN 256 THEN 'exclamations' END AS kept_without
FROM b
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": SQL}
