"""How filters act on each other, from relations of failing ids.

Every filter has one stored table of the rows that fail it. What a filter removes after any others is
its table left-anti the tables of those others; what it would have removed but came too late for is
its table left-semi theirs; what survives is all rows left-anti the tables used so far. A result
depends on the set of filters used before, not on their order, so 2**k sets serve all k! orders; only
the last step, on a table of counts, knows orders.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import col, stored

MOST = 7  # filters: there are MOST! orders
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: few words (A), repeated words (B), capitals (C), symbols (D)."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPACE, -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(whole).cast("long"),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def failing_rows(docs: DataFrame, filters: dict[str, Column], copies: str | None, id_col: str, text_col: str, part: Column) -> tuple[DataFrame, DataFrame]:
    """All rows, and the tables of failing rows, one folder per filter: ``ident, part, id, rows`` and ``filter``.

    ``ident`` is a 128-bit hash of id and text: equal rows are one row with their number in ``rows``,
    rows that repeat an id with another text stay apart. ``copies`` names the filter that a text
    fails if any smaller id has the same text.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    mask = F.lit(0)
    for i, bad in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(bad, 1 << i).otherwise(0))
    name = F.coalesce(F.concat(F.lit("i"), col(id_col).cast("string")), F.lit("n"))
    facts = docs.select(col(id_col).alias("id"), part.alias("part"), F.md5(text).alias("digest"), mask.alias("mask"), name.alias("name"))
    facts = facts.select(F.unhex(F.md5(F.concat_ws(":", "name", "digest"))).alias("ident"), "part", "id", F.unhex("digest").alias("digest"), "mask")
    facts = stored(facts.groupBy(*facts.columns).agg(F.count("*").alias("rows")), "audit-rows")
    failed = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(name)) for i, name in enumerate(filters)]
    bad = facts.where("mask <> 0").select("ident", "part", "id", "rows", F.explode(F.array_compact(F.array(*failed))).alias("filter"))
    if copies:
        first = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        # A hot text's rows stand on the left, where its partition can be split; its one row on the right is copied.
        again = facts.join(stored(first, "audit-first"), "digest").where(F.col("id") > F.col("first"))
        bad = bad.unionByName(again.select("ident", "part", "id", "rows", F.lit(copies).alias("filter")))
    return facts.select("ident", "part", "rows"), stored(bad, "audit-failing", "filter")


def _bit(bits: dict[str, int]) -> Column:
    """The bit of the column ``filter``."""
    return F.element_at(F.create_map(*[x for f, b in bits.items() for x in (F.lit(f), F.lit(b))]), F.col("filter"))


def audit_filters(
    docs: DataFrame,
    filters: dict[str, Column],
    losses: dict[str, DataFrame],
    copies: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part: Column | None = None,
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``filters`` maps one-letter names to conditions of failure on ``docs``; ``copies`` names one more
    filter, identical texts. ``losses`` maps names to tables of one column of ids. Columns: ``part,
    filter_order, step, kept, removed, redundant, unique_fails, shapley`` and one per loss, counts of
    rows: ``kept`` after the step, ``removed`` by it, ``redundant`` failing its filter but removed
    before, ``unique_fails`` failing no other, ``shapley`` its filter's removals summed over all
    orders, a loss the removed rows whose id its table holds.

    A null text is empty, a null part the empty string. A null id is no smaller or larger than any
    other and stands in no table of losses. Rows that repeat an id are judged each by its own text, and counted each. An
    empty table gives no rows. Columns other than those that ``filters`` and ``part`` name are not read.
    """
    spark = docs.sparkSession
    names = sorted([*filters, *([copies] if copies else [])])
    if any(len(n) != 1 for n in names) or not 0 < len(names) <= MOST:
        raise ValueError(f"one to {MOST} filters with single letters as names")
    bits = {n: 1 << i for i, n in enumerate(names)}
    part = F.coalesce((part if part is not None else F.lit("")).cast("string"), F.lit(""))
    rows, failing = failing_rows(docs, filters, copies, id_col, text_col, part)
    used = failing.select(F.col("ident").alias("_ident"), _bit(bits).alias("_bit")).repartition("_ident")
    subsets = F.array(*[F.lit(s) for s in range(1 << len(names))])
    before = (F.col("prefix").bitwiseAND(F.col("_bit")) != 0) & (F.col("ident") == F.col("_ident"))

    # Rows are dealt by ident first and multiplied inside the tasks: no prefix is shuffled by itself.
    left = rows.repartition("ident").withColumn("prefix", F.explode(subsets)).join(used, before, "left_anti")
    kept = left.groupBy("part", "prefix").agg(F.sum("rows").alias("kept"))

    what = [failing.withColumn("kind", F.lit("removed"))]
    for loss, ids in losses.items():
        known = ids.select(F.col(ids.columns[0]).alias("_id")).where("_id is not null").distinct()
        what.append(failing.join(known, F.col("id") == F.col("_id"), "left_semi").withColumn("kind", F.lit(loss)))
    marked = what[0]
    for more in what[1:]:
        marked = marked.unionByName(more)
    marked = marked.select("ident", "part", "rows", "filter", "kind")
    others = F.filter(subsets, lambda s: s.bitwiseAND(_bit(bits)) == 0)
    asked = marked.repartition("ident").withColumn("prefix", F.explode(others))
    by = ["part", "filter", "prefix"]
    hits = asked.join(used, before, "left_anti").groupBy(*by, "kind").agg(F.sum("rows").alias("n"))
    late = asked.where("kind = 'removed'").join(used, before, "left_semi").groupBy(*by).agg(F.lit("redundant").alias("kind"), F.sum("rows").alias("n"))
    kinds = ["removed", "redundant", *losses]
    counts = hits.unionByName(late).groupBy(*by).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds])
    kept, counts = stored(kept, "audit-kept"), stored(counts, "audit-counts")

    # From here on: a few hundred counts per part.
    every, size = (1 << len(names)) - 1, len(names)
    share = [math.factorial(s) * math.factorial(size - 1 - s) if s < size else 0 for s in range(size + 1)]
    weight = F.element_at(F.array(*map(F.lit, share)), F.bit_count("prefix") + 1)
    alone = F.sum(F.when(F.col("prefix") + _bit(bits) == every, F.col("removed")))
    sums = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), alone.alias("unique_fails"))
    cells = [F.struct(F.lit(f).alias("filter"), F.lit(s).alias("prefix"), F.lit(s | b).alias("after")) for f, b in bits.items() for s in range(every + 1) if not s & b]
    out = rows.select("part").distinct().select("part", F.inline(F.array(*cells)))
    out = out.join(counts, by, "left").join(sums, ["part", "filter"], "left").join(kept.withColumnRenamed("prefix", "after"), ["part", "after"], "left")
    steps = []
    for order in itertools.permutations(names):
        for i, name in enumerate(order):
            steps.append(("".join(order), i + 1, name, sum(bits[n] for n in order[:i])))
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter string, prefix int")
    out = out.join(F.broadcast(plan), ["filter", "prefix"])  # k * k! rows, k at most MOST
    columns = ["kept", "removed", "redundant", "unique_fails", *losses, "shapley"]
    return out.select("part", "filter_order", "step", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in columns])
