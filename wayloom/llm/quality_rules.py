"""Rule bitmask ledger: every quality rule is evaluated once a document.

``ledger`` stores measurements and one integer whose bit *i* says that rule *i*
fails.  Policies are named, versioned masks over those bits, so a verdict, a
comparison of policies or an ablation reads the ledger and never the text.
Everything is built-in SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over MEASURES


#: A rule keeps its position for ever; new ones are appended.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("shouting", "n_upper > n_lower"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Version to mask.  A version never changes once it is published.
POLICIES = {
    "base": mask("too_few_words", "repeated_windows"),
    "v1": mask("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines"),
    "v2": sum(BIT.values()),
}
CURRENT = "v2"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the window hashes in order."""
    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("p")))

    def covered(s: Column) -> Column:
        m = F.size(s) - 1
        twins = F.filter(F.arrays_zip(F.slice(s, 1, m).alias("l"), F.slice(s, 2, m).alias("r")), lambda x: x["l"]["h"] == x["r"]["h"])
        spots = F.array_union(F.transform(twins, lambda x: x["l"]["p"]), F.transform(twins, lambda x: x["r"]["p"]))
        return F.size(F.array_distinct(F.concat(spots, F.transform(spots, lambda p: p + 1), F.transform(spots, lambda p: p + 2))))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and MEASURES (long); see ``ledger`` for the defined cases."""
    return _measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ("doc_id",)).select("doc_id", *MEASURES)


def _measured(docs: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """MEASURES of the column ``text`` beside the ``carried`` columns."""
    only = lambda keep: F.length(F.regexp_replace("_text", f"[^{keep}]+", ""))
    keep = [F.col(f"`{c}`") for c in carried]
    base = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text")).select(*keep, "_text", F.array_remove(F.split("_text", SPACE + "+"), "").alias("_words"))
    n = F.size("_words")
    window = lambda at: F.slice("_words", at, n - 2)
    grams = F.transform(F.arrays_zip(window(1).alias("x"), window(2).alias("y"), window(3).alias("z")), lambda g: F.xxhash64(g["x"], g["y"], g["z"]))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    wide = base.select(
        *keep, n.alias("n_words"), (F.length("_text") - F.length(F.regexp_replace("_text", NOT_SPACE + "+", ""))).alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"), lines.alias("_lines"), F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>")).alias("_grams"),
        only("A-Z").alias("n_upper"), only("a-z").alias("n_lower"),
    )
    return wide.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), _repeat_words(F.col("_grams")).alias("n_repeat_words"), "n_upper", "n_lower",
    ).select(*keep, *(F.col(m).cast("long") for m in MEASURES))


def _bits(rules: tuple[Rule, ...]) -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, MEASURES and fail_bits (long), one row a document, without a shuffle.

    Defined cases: null or empty text has all measures 0, so it fails
    ``too_few_words``; lines without a word do not count; ids may be null or
    repeat, each row is measured alone; an empty table gives an empty ledger;
    no other column of ``docs`` is read.
    """
    return measure(docs, id_col, text_col).withColumn("fail_bits", _bits(rules))


def verdict(table: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy version."""
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return table.withColumns({"base_failed": fails(POLICIES["base"]), "kept": ~fails(POLICIES[version] | POLICIES["base"]), "policy": F.lit(version)})


def ablation(table: DataFrame, version: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): one pass, bitwise, a fixed number of rows.

    ``failed`` counts documents with the rule's bit; ``failed_alone`` those that
    the policy rejects for this bit only; ``kept_without`` those kept if the
    policy lost the rule.
    """
    active = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long"))
    names = [r.name for i, r in enumerate(rules) if POLICIES[version] >> i & 1]
    aggs = [F.count(F.when(active == 0, 1)).alias("_kept")]
    for name in names:
        aggs += [F.count(F.when(active.bitwiseAND(F.lit(BIT[name]).cast("long")) != 0, 1)).alias(f"f_{name}"), F.count(F.when(active == BIT[name], 1)).alias(f"a_{name}")]
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.col(f"f_{x}").alias("failed"), F.col(f"a_{x}").alias("failed_alone"), (F.col("_kept") + F.col(f"a_{x}")).alias("kept_without")) for x in names)))
    return table.agg(*aggs).select(rows.alias("r")).select("r.*")


def accepted(docs: DataFrame, version: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged, ``text`` among them) that the policy keeps, decided row by row.

    The row number beside the bits keeps the filter above the ledger: pushed
    below, it would compute each measure once for every rule that uses it.
    Columns of ``docs`` may have any names.  Other defined cases are those of
    ``ledger``.
    """
    names = [f"_doc{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    judged = _measured(own, tuple(names)).select(*names, _bits(rules).alias("_bits"), F.monotonically_increasing_id().alias("_row"))
    kept = judged.where((F.col("_bits").bitwiseAND(F.lit(POLICIES[version] | POLICIES["base"]).cast("long")) == 0) & (F.col("_row") >= 0))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM m WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
a AS (
  SELECT m.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]+', '', 'g'))::BIGINT AS n_lower
  FROM m LEFT JOIN r ON m.doc_id = r.doc_id),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT
    + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT
    + 32 * (n_upper > n_lower)::BIGINT) AS fail_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'v2' AS policy FROM b
"""
