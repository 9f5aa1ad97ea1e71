"""Quality rules: a learned decision list, in DataFrame expressions only.

Sequential covering: a rule is grown condition by condition on two thirds of the labelled rows,
pruned on the last third, and the rows it covers leave before the next rule. Statistics are counts
per feature bin from Spark aggregates. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import col, stored, unpacked, whole_row

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
#: Feature and the thresholds at which a condition may cut it.
FEATURES: dict[str, tuple[float, ...]] = {
    "n_words": (5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000),
    "mean_length": (2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),
    "symbol_share": SHARES,
    "repeat_share": SHARES,
    "dup_line_share": SHARES,
    "upper_share": SHARES,
    "mark_share": SHARES,
}


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def counts(df: DataFrame, text: str) -> DataFrame:
    """Adds the word and line counts of the text column ``text`` (null: no words).

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, then ``_n_lines, _n_upper, _n_marks``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_words": F.filter(F.split(t, SPACE, -1), lambda x: x != ""), "_lines": lines})
    df = df.withColumns({"_n": F.size("_words"), "_n_lines": F.size("_lines").cast("long")})
    # A window is known by 128 bits of its words, so sorting moves numbers and no text.
    places = F.sequence(F.lit(0), F.col("_n") - 3)

    def marked(i: Column) -> Column:
        words = [F.get("_words", i + k) for k in range(3)]
        return F.struct(F.xxhash64(*words).alias("g"), F.xxhash64(F.lit(1), *words).alias("h"), i.alias("i"))

    windows = F.when(F.col("_n") >= 3, F.sort_array(F.transform(places, marked)))
    df = df.withColumn("_windows", windows)
    # Sorted windows next to each other: equal neighbours are repeats.
    same = lambda x, y: x["i"].isNotNull() & (x["g"] == y["g"]) & (x["h"] == y["h"])
    pairs = F.zip_with("_windows", F.slice("_windows", 2, F.col("_n")), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
    df = df.withColumn("_again", F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform("_again", lambda i: F.array(i, i + 1, i + 2))))
    return df.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _count_of(t, SYMBOLS),
            "n_dup_lines": (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
            "_n_upper": _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_n_marks": _count_of(t, "!?"),
        }
    ).drop("_words", "_lines", "_n", "_windows", "_again")


def features() -> dict[str, Column]:
    """The learner's features from the counts; a text without words or lines has shares of 0."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "_n_lines"),
        "upper_share": share("_n_upper", "word_chars"),
        "mark_share": share("_n_marks", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def on(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def on_bins(self) -> Column:
        k = FEATURES[self.feature].index(self.threshold) + 1
        return F.col(f"b_{self.feature}") >= k if self.at_least else F.col(f"b_{self.feature}") < k

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def labelled_bins(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """Counts of bad and good labelled rows per combination of feature bins and fold, stored."""
    marks = labels.select(col(id_col).alias("_id"), col(label_col).alias("_label")).where("_id is not null and _label in (0, 1)")
    marks = marks.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_max")).where("_label = _max").drop("_max")
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"))
    # At most max_labelled rows of an id and a mark: small enough to broadcast.
    rows = counts(texts.join(F.broadcast(marks), "_id"), "_text")
    bins = {
        f"b_{name}": sum((((value >= t).cast("int")) for t in FEATURES[name]), F.lit(0)) for name, value in features().items()
    }
    fold = F.when(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(3)) == 0, "prune").otherwise("grow")
    cells = rows.select(*[v.alias(k) for k, v in bins.items()], fold.alias("fold"), "_label")
    cells = cells.groupBy(*bins, "fold").agg(F.sum((F.col("_label") == 0).cast("long")).alias("bad"), F.sum((F.col("_label") == 1).cast("long")).alias("good"))
    return stored(cells, "quality-bins")


def _grow(cells: DataFrame, max_conditions: int) -> Rule:
    rule: list[Condition] = []
    names = list(FEATURES)
    while len(rule) < max_conditions:
        here = cells.where(_all([c.on_bins() for c in rule]))
        each = F.posexplode(F.array(*[F.col(f"b_{n}") for n in names])).alias("f", "b")
        table = here.select(each, "bad", "good").groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
        p0 = sum(r.bad for r in table if r.f == 0)
        n0 = sum(r.good for r in table if r.f == 0)
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for f, name in enumerate(names):
            for k, t in enumerate(FEATURES[name]):
                for at_least in (True, False):
                    inside = [r for r in table if r.f == f and (r.b >= k + 1) == at_least]
                    p, n = sum(r.bad for r in inside), sum(r.good for r in inside)
                    if p:
                        worth = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        # Of equally good thresholds the one that catches least beyond the seen rows.
                        if worth > gain + 1e-9 or (at_least and best and best.feature == name and best.at_least and worth > gain - 1e-9):
                            best, gain = Condition(name, at_least, float(t)), worth
        if best is None:
            break
        rule.append(best)
    return tuple(rule)


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 20_000,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_support: int = 3,
) -> list[Rule]:
    """Rules that find bad documents (label 0), in the order in which they apply.

    Fitted on at most ``max_labelled`` labelled documents, those with the lowest id hashes. A rule is
    accepted if on the pruning third it covers ``min_support`` bad rows at ``min_precision``; the first
    rule that fails ends the list. Unlabelled rows, null labels, ids with both labels and labels of
    unknown ids are not used. Without usable labels the list is empty.
    """
    cells = labelled_bins(docs, labels, id_col, text_col, label_col, max_labelled)
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule = _grow(cells.where(left & (F.col("fold") == "grow")), max_conditions)
        if not rule:
            break
        prefixes = [_all([c.on_bins() for c in rule[: k + 1]]) for k in range(len(rule))]
        sums = [F.sum(F.when(p, F.col(side))).alias(f"{side}{k}") for k, p in enumerate(prefixes) for side in ("bad", "good")]
        seen = cells.where(left & (F.col("fold") == "prune")).agg(*sums).first()
        tried = [(seen[f"bad{k}"] or 0, seen[f"good{k}"] or 0) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: ((tried[i][0] + 1) / (sum(tried[i]) + 2), -i))
        bad, good = tried[k]
        if bad < min_support or bad < min_precision * (bad + good):
            break
        rules.append(rule[: k + 1])
        left = left & ~_all([c.on_bins() for c in rules[-1]])
    return rules


def verdict(rules: list[Rule], values: dict[str, Column] | None = None) -> Column:
    """The decision list as one conditional expression: false from the first rule that holds, else true."""
    values = values or features()
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(_all([c.on(values) for c in rule]), F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` (false if ``base_failed``, else the list's verdict) of every row.

    A null text has no words, so it fails. Repeated rows get the same verdict each; a null id is passed on.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = counts(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("_text")), "_text")
    rows = rows.withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )


def accepted(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns; nothing is shuffled."""
    packed = docs.select(whole_row(docs).alias("_row"), col(text_col).alias("_text"))
    # A filter moves below the projections and would have every count computed again for each place that
    # names it; it cannot move below a row number that it uses.
    judged = judge(packed, rules, "_row", "_text").withColumn("_at", F.monotonically_increasing_id())
    return unpacked(judged.where("kept and _at >= 0"), "doc_id", docs)
