"""Mixing sources to target weights along a time-varying curriculum.

A source's weight may change over training time t in [0, 1] (piecewise linear).
Its integral, scaled to the source's target, is the cumulative token demand;
inverting that demand at a document's cumulative words gives the document's
position, and a range sort by position gives the training order.  Everything is
built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayloom.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]"
MAX_REPEATS = 3
FAN = 256

#: Piecewise linear schedules by weight class (1, 2, 3), as weights at the knots
#: of t; each is scaled so that its integral is 1.  Constant: spread evenly.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to those with weight and target.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  Every
    source wants weight * level; those whose cap (max_repeats times their size)
    is below that stop at the cap, and the one level that spends all words
    serves the rest.  Sorted by cap over weight, the capped ones are a prefix,
    so the level is a closed form of prefix sums.  One row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(3)).cast("long") + 1)
    up = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(1))
    capped = F.col("source_size") * max_repeats
    sums = ranked.withColumns({
        "before_size": F.sum("source_size").over(up) - F.col("source_size"), "before_weight": F.sum("weight").over(up) - F.col("weight"),
        "all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every),
    })
    # the level if exactly the sources before this one were capped
    level = (F.col("all_size") - max_repeats * F.col("before_size")).cast("double") / (F.col("all_weight") - F.col("before_weight")).cast("double")
    fits = level * F.col("weight") <= capped
    found = sums.withColumn("level", F.min_by(F.when(fits, level), F.when(fits, F.col("before_weight"))).over(every))
    target = F.when(F.col("all_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("level") * F.col("weight"), capped.cast("double")))
    return found.select("source", "source_size", "weight", F.coalesce(target, capped.cast("double")).alias("target"))


def position(share: Column, weight_class: Column, schedules: dict = SCHEDULES, knots: tuple = KNOTS) -> Column:
    """The time at which a source's integrated schedule reaches ``share`` (0 to 1) of its demand."""
    out = share
    for key, values in schedules.items():
        area = [(b - a) * (u + v) / 2 for a, b, u, v in zip(knots, knots[1:], values, values[1:])]
        total, done, pieces = sum(area), 0.0, []
        for a, b, u, v, piece in zip(knots, knots[1:], values, values[1:], area):
            need = F.greatest(share * total - done, F.lit(0.0))
            slope = (v - u) / (b - a)
            # u x + slope x^2 / 2 = need, the smaller root in a form that allows slope 0
            x = F.when(need <= 0, 0.0).otherwise(2 * need / (u + F.sqrt(F.greatest(u * u + 2 * slope * need, F.lit(0.0)))))
            pieces.append((done + piece, F.lit(a) + x))
            done += piece
        at = F.lit(knots[-1])
        for end, value in reversed(pieces):
            at = F.when(share * total <= end, F.least(value, F.lit(knots[-1]))).otherwise(at)
        out = F.when(weight_class == key, at).otherwise(out)
    return out


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, extra: tuple[str, ...], fan: int) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, weight, done (words before it in its source), whole, full, last, extra.

    The narrow rows are written once where nothing else is carried, so a text is
    split into words once; with extra columns it is split twice.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))  # rows without an id, or with the same, are told apart by their text
    key = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *(F.col(c) for c in extra))
    rows = rows if extra else scratch.save(rows, "sizes")
    rows = rows.withColumns({"hi": F.pmod(F.shiftright("key", 32), F.lit(fan)).cast("int"), "lo": F.pmod(F.shiftright("key", 20), F.lit(fan)).cast("int"), "group": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    leaf = scratch.save(rows.groupBy("group", "hi", "lo").agg(F.sum("size").alias("words")), "buckets")
    inner = W.partitionBy("group", "hi").orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    leaf = leaf.withColumn("in_hi", F.sum("words").over(inner) - F.col("words"))
    top = leaf.groupBy("group", "hi").agg(F.sum("words").alias("hi_words"))
    outer = W.partitionBy("group").orderBy("hi").rowsBetween(W.unboundedPreceding, W.currentRow)
    top = top.withColumn("before_hi", F.sum("hi_words").over(outer) - F.col("hi_words"))
    sizes = top.groupBy("group").agg(F.sum("hi_words").alias("source_size")).withColumn("source", F.when(F.substring("group", 1, 1) == "s", F.expr("substring(`group`, 2)")))
    target = source_targets(sizes.select("source", "source_size")).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("group"), "source_size", "weight", "target")
    start = leaf.join(top.select("group", "hi", "before_hi"), ["group", "hi"]).join(target, "group").select(
        "group", "hi", "lo", (F.col("before_hi") + F.col("in_hi")).alias("start"), "source_size", "weight", "target")
    local = W.partitionBy("group", "hi", "lo").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(local)).join(start, ["group", "hi", "lo"])
    done = F.col("start") + F.col("upto") - F.col("size")
    whole = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = whole - full * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(rest - done, F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "weight", done.alias("done"), whole.alias("whole"), full.alias("full"), last.alias("last"), *extra)


def _times() -> Column:
    """Array of (repeat, taken, position), one for each time the mix takes a document of ``_placed``."""
    out = []
    for i in range(MAX_REPEATS):
        taken = F.when(F.col("full") > i, F.col("size")).when(F.col("full") == i, F.col("last")).otherwise(F.lit(0).cast("long"))
        share = (i * F.col("source_size") + F.col("done") + taken / 2) / F.col("whole")
        out.append(F.struct(F.lit(i).alias("repeat"), taken.alias("taken"), F.when(taken > 0, position(share, F.col("weight"))).alias("position")))
    return F.filter(F.array(*out), lambda t: t["taken"] > 0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken, repeats, positions, position, in training order.

    Within a source, documents stand in the order of a hash of their id and
    text.  The mix takes every one of them floor(target / source_size) times, and
    once more from the start of that order until the target is spent; the last
    repeat of one document ends where the target does, so taken words meet the
    target up to rounding.  ``repeats`` is taken / size.

    ``positions`` has a place in training (0 to 1) for each time the document is
    taken: where the source's integrated schedule reaches the share of the target
    that is spent at the middle of the words taken then.  So the words that any
    stretch of training gets of a source follow its schedule.  ``position`` is
    the first of them, null if the mix leaves the document out.

    Cumulative words come from two levels of hash buckets, ``fan`` wide each:
    sums by bucket, prefix sums over those, and a window inside one bucket, so
    no task holds a source.

    Defined cases: null text has size 0; a null source is a source of its own,
    last in order; a source of size 0 has target 0; null or repeated ids are
    rows like others (rows equal in id and text stand in any order, which has no
    effect on the words); an empty table gives an empty result.
    """
    rows = _placed(docs, id_col, text_col, source_col, extra, fan).withColumn("times", _times())
    taken = F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + t["taken"])
    positions = F.transform("times", lambda t: t["position"])
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, taken / F.col("size")).otherwise(F.lit(0.0)).alias("repeats"),
        positions.alias("positions"), F.get(positions, F.lit(0)).alias("position"), *extra,
    )


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """One row for each time the mix takes a document, with its own repeat (0 for the first time), taken, repeats and position.

    Documents that the mix leaves out have one row with taken 0 and no repeat
    and no position.  Other defined cases are those of ``mix``.
    """
    rows = _placed(docs, id_col, text_col, source_col, extra, fan).withColumn("time", F.explode_outer(_times()))
    taken = F.coalesce("time.taken", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", F.col("time.repeat").alias("repeat"), taken.alias("taken"),
        F.when(F.col("size") > 0, taken / F.col("size")).otherwise(F.lit(0.0)).alias("repeats"), F.col("time.position").alias("position"), *extra,
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position, then id; rows without a position are last."""
    by = (F.col("position").asc_nulls_last(), F.col("doc_id").asc())
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)


#: Positions are derived another way than above: repeats as rows, cumulative words by one window a source,
#: and the inverses of 1.5 t - t^2 / 2, t and t / 2 + t^2 / 2 in closed form.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
u AS (
  SELECT *, sum(source_size) OVER o - source_size AS before_size, sum(weight) OVER o - weight AS before_weight,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (all_size - 3 * before_size)::DOUBLE / (all_weight - before_weight)::DOUBLE AS level FROM u),
f AS (SELECT *, (SELECT arg_min(level, before_weight) FROM l WHERE level * weight <= 3 * source_size) AS chosen FROM l),
t AS (SELECT source, source_size, weight, CASE WHEN all_size = 0 THEN 0::DOUBLE ELSE coalesce(least(chosen * weight, (3 * source_size)::DOUBLE), (3 * source_size)::DOUBLE) END AS target FROM f),
c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.weight, t.target, round(t.target)::BIGINT AS whole, unnest([0, 1, 2]) AS repeat, (key >> 32) % 256 AS hi, (key >> 20) % 256 AS lo, key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY repeat, hi, lo, key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM c),
y AS (SELECT *, greatest(0, least(whole - before, size))::BIGINT AS used FROM x),
z AS (SELECT *, CASE WHEN used > 0 THEN (before + used / 2::DOUBLE) / whole END AS share FROM y),
p AS (SELECT *, CASE weight WHEN 1 THEN 1.5 - sqrt(2.25 - 2 * share) WHEN 2 THEN share ELSE sqrt(0.25 + 2 * share) - 0.5 END AS place FROM z)
SELECT doc_id, any_value(size) AS size, any_value(source) AS source, any_value(source_size) AS source_size, any_value(target) AS target, sum(used)::BIGINT AS taken,
  round(max(place) FILTER (repeat = 0), 6) AS position, round(max(place) FILTER (repeat = 1), 6) AS position_2, round(max(place) FILTER (repeat = 2), 6) AS position_3
FROM p GROUP BY doc_id
"""
