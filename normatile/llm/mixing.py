"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is wanted ``target / source size`` times. The whole part of that number
is taken outright; the fraction is an inclusion probability. The flight moves probabilities along the
null space of (documents, tokens), so both totals stay exact while each move settles at least one
document. Blocks fly on their own, their at most two open documents meet in larger blocks, and only
the last two of a source land without full balance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import col, schema_after, stored
from normatile.operators.ordering import with_position

BLOCK, MERGE, EPS = 1024, 512, 1e-9
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; nobody gets over ``most`` times its size, the excess is shared again."""
    targets, left = [0.0] * len(sizes), float(total)
    open_ = set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ -= over
    return targets


def _null_vector(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A direction that moves the first unit by 1 and spreads the opposite over the rest, by their room.

    It keeps the number of documents and the tokens; if the rest are too alike for both, the tokens.
    """
    room, size = np.minimum(p[1:], 1 - p[1:]), s[1:]
    n, t, q = room.sum(), (room * size).sum(), (room * size * size).sum()
    det = n * q - t * t
    if det > 1e-9 * n * q:
        spread = room * ((q - t * s[0]) / det + (n * s[0] - t) / det * size)
    elif t > 0:
        spread = room * (s[0] / t)
    else:
        spread = room / n
    return np.concatenate([[1.0], -spread])


def flight(pi: np.ndarray, size: np.ndarray, rng, land: bool) -> np.ndarray:
    """Settle all but two units at most (``land``: all of them), keeping sum(pi) and sum(pi * size).

    The largest open unit always moves against all others, so the large ones settle while many small
    ones can still make up for them, and what is left to land is small.
    """
    out = pi.astype(float).copy()
    which = np.argsort(-size, kind="stable")
    which = which[(out[which] > EPS) & (out[which] < 1 - EPS)]
    out[np.setdiff1d(np.arange(len(out)), which)] = np.round(out[np.setdiff1d(np.arange(len(out)), which)])
    p, s = out[which], size[which].astype(float)
    while len(p) > (0 if land else 2):
        u = _null_vector(p, s) if len(p) > 1 else np.ones(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
            down = np.min(np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)))
        p = p + (up if rng.random() * (up + down) < down else -down) * u
        settled = (p < EPS) | (p > 1 - EPS)
        out[which[settled]] = np.round(p[settled])
        which, p, s = which[~settled], p[~settled], s[~settled]
    out[which] = p
    return out


def _flyer(seed: int, level: int, land: bool):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "size"], kind="stable")
        rng = np.random.default_rng([seed, int(pdf.sid.iloc[0]), int(pdf.block.iloc[0]), level])
        return pdf.assign(pi=flight(pdf.pi.to_numpy(), pdf["size"].to_numpy(), rng, land))

    return fly


def rated_sources(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target, sid, whole, pi, blocks`` of every source, stored.

    ``sid`` numbers sources by code point, null last; weights go round in that order. A source is capped
    if its part by weight would pass ``most`` times its size. What caps leave over raises the parts of
    the others, so more may be capped: each round is one aggregate over the sources, and a round that caps
    no more is the last (``share_out`` says the same of a list).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    numbered = with_position(totals, [F.col("source").isNull(), F.col("source")], (), "sid")
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))).cast("int"))
    numbered = stored(numbered.withColumns({"weight": turn, "cap": F.lit(float(most)) * F.col("source_size")}), "mix-sources")
    everything, weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    total, count = share * float(everything or 0), 0
    left, open_ = total, float(weight or 1.0)
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(open_) > F.col("cap")
        capped, used, gone = numbered.where(over).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if capped <= count:
            break
        count, left, open_ = capped, total - used, float(weight) - gone
        if open_ <= 0:
            break
    if open_ <= 0:
        target = F.col("cap")
    else:
        part = F.lit(left) * F.col("weight") / F.lit(open_)
        target = F.when(part > F.col("cap"), F.col("cap")).otherwise(part)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + EPS)
    out = numbered.withColumn("target", target).withColumn("rate", rate)
    return stored(
        out.select(
            "source", "source_size", "target", "sid", whole.cast("int").alias("whole"),
            F.greatest(F.lit(0.0), F.col("rate") - whole).alias("pi"), F.ceil(F.col("rows") / BLOCK).alias("blocks"),
        ),
        "mix-rates",
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` is the number of words of the whole text (null: 0). Sources, by code point with null
    last, weigh ``weights`` in turn and share ``share`` of all words; none gets over ``most`` times
    its own, the excess is shared again. ``copies`` is how often the mix takes the document and
    ``taken`` = copies * size. A source's taken words miss its target by a document or two.

    Sources are numbered and targets shared out in Spark, however many there are. Choices depend on ids,
    sources and sizes alone, so reruns agree. Rows with the same id and source are one
    unit and get the same copies. Null ids form one unit per source. Sources without words get
    target 0 and no copies. An empty table gives an empty result; other columns are not read.
    """
    sized = docs.select(
        col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size")
    )
    sized = stored(sized, "mix-sizes")
    sources = rated_sources(sized, weights, share, most)
    # Stored, so Spark knows whether the sources are few enough to broadcast; else a hot source is split on the left.
    rated = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    units = rated.where((F.col("pi") > EPS) & (F.col("source_size") > 0)).groupBy("doc_id", "sid", "pi", "blocks").agg(F.sum("size").alias("size"))
    units = units.withColumn("ord", F.xxhash64(F.lit(seed), "doc_id", "sid"))
    units = units.withColumn("block", F.pmod(F.col("ord"), F.col("blocks")).cast("long")).drop("blocks")
    schema = schema_after(units, ["doc_id"], "sid long, pi double, size long, ord long, block long")
    settled, blocks, level = None, sources.agg(F.max("blocks")).first()[0] or 1, 0
    while True:
        land = blocks <= 1
        flown = units.select(*schema.names).groupBy("sid", "block").applyInPandas(_flyer(seed, level, land), schema)
        flown = stored(flown, "mix-flight")
        done = flown.where((F.col("pi") <= 0) | (F.col("pi") >= 1))
        settled = done if settled is None else settled.unionByName(done)
        if land:
            break
        units = flown.where((F.col("pi") > 0) & (F.col("pi") < 1)).withColumn("block", F.floor(F.col("block") / MERGE))
        blocks, level = math.ceil(blocks / MERGE), level + 1
    drawn = settled.where(F.col("pi") >= 1).select(F.col("doc_id").alias("_id"), F.col("sid").alias("_sid"), F.lit(1).alias("_one"))
    out = rated.join(drawn, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sid") == F.col("_sid")), "left")
    copies = F.col("whole") + F.coalesce(F.col("_one"), F.lit(0))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes: all their columns, then ``mix_copies`` and ``mix_taken``.

    Columns of ``docs`` with these names give way. See ``mix`` for the choices.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.max("copies").alias("copies"))
    kept = [c for c in docs.columns if c.lower() not in ("mix_copies", "mix_taken")]
    packed = docs.select(F.struct(*[col(c) for c in kept]).alias("_row"), col(id_col).alias("_key"), col(source_col).cast("string").alias("_src"))
    joined = packed.join(plan, F.col("_key").eqNullSafe(F.col("_id")) & F.col("_src").eqNullSafe(F.col("_source")))
    taken = F.col("copies") * word_count(F.col("_row").getField(text_col))
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("copies").alias("mix_copies"), taken.alias("mix_taken"))
