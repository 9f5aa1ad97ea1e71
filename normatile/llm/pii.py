"""Personal data: patterns that always count, and candidates that boosted trees select.

High-recall generators propose spans, overlapping ones too. Small trees over format and context
features are boosted on gradient sums per feature bin, which Spark aggregates; a threshold calibrated
on held-out candidates selects the spans. Everything runs in DataFrame functions: the trees become one
arithmetic expression.

There are no labelled spans to learn from. A candidate counts as personal if it overlaps a checked
base span or has an explicit cue of its kind, as not personal otherwise: an assignment to a secret's
name, "tel", "phone", "ssn" and the like before a number, "mail" before a spelled-out address or a
domain inside it. The features see neither the base spans nor the cues, only the candidate's own form and
what characters stand around it, so the trees carry over to candidates that no cue announces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import col, stored, whole_row

KINDS = ("email", "ip", "card", "phone", "secret", "number", "contact")
#: Matches are put between these two; they and DOT stand in for characters that no pattern accepts.
OPEN, CLOSE, DOT = "\x01", "\x02", "\x03"
SPANS = "array<struct<s:int,e:int,kind:int,m:string>>"

#: The four base patterns, written without repeated groups (which would recurse per repetition in a
#: very long text). The texts they run on have separators that cannot belong to a match replaced by DOT.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x03-]))[A-Za-z0-9._%+\x03-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9][0-9\x20-]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators of further candidates.
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+"
NUMBER = r"(?<![0-9])[0-9][0-9\x20().-]{5,}[0-9]"
CONTACT = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]{1,253}"
ASSIGNED = r"(?i)(?:token|secret|password|passwd|api.?key|access.?key|credential)s?[\x20]{0,3}[=:][\x20]{0,3}[\"']?$"
NUMBERED = r"(?i)(?<![a-z])(?:tel|telephone|phone|mobile|cell|fax|call|dial|ssn|social\x20security)(?:\x20?(?:no|number))?\.?[\x20]{0,3}[:=#]?[\x20]{0,3}[(]?$"
MAILED = r"(?i)(?<![a-z])(?:e-?)?(?:mail|contact)(?:\x20(?:to|at|me|us))?[\x20]{0,3}[:=]?[\x20]{0,3}[\"'<(]?$"
DOMAIN = r"[\])]\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,24}\.?$"
DOTTED = r"(?i)^\x20?[\[(]dot[\])]"
#: What stands around a candidate says path, call or part of a longer string; never any of the words above.
PATH = r"[/.\\#@&?%]$"
GOES_ON = r"^[/.(\\:@]\S"
BEFORE = 32  # characters of context

#: Feature and bin thresholds.
FEATURES: dict[str, tuple[int, ...]] = {
    "length": (8, 12, 16, 20, 24, 32, 40, 64),
    "digits": (7, 9, 10, 12, 14, 16, 20),
    "digit_share": (1, 10, 20, 35, 50, 75, 100),
    "upper_share": (1, 20, 50),
    "separators": (1, 2, 3, 4, 6),
    "letters": (1, 4, 8, 16),
    "changes": (1, 2, 4, 8, 16),
    "hex": (1,),
    "luhn": (1,),
    "plus": (1,),
    "distinct": (4, 6, 8, 10, 12, 16, 20),
    "vowel_share": (5, 10, 15, 20, 25, 30, 35),
    "case_changes": (1, 2, 4, 6, 9),
    "path": (1,),
    "goes_on": (1,),
    "line_start": (1,),
    "kind": (5, 6),
}


def _between(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost first, as (start, end, kind, match) in code points."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = (acc["at"] + F.length(part)).cast("int")
        span = F.struct(acc["at"].alias("s"), end.alias("e"), F.lit(kind).alias("kind"), part.alias("m"))
        out = F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), out.alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def _found(ask: Column, text: Column, pattern: str, kind: int, valid=None) -> Column:
    spans = _between(text, pattern, kind)
    if valid is not None:
        spans = F.filter(spans, valid)
    return F.when(ask, spans).otherwise(F.array().cast(SPANS))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, base, more``: checked base spans and candidates with their features, for every row."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumns({"_digit": F.col("_t").rlike("[0-9]"), "_at": F.contains("_t", F.lit("@")), "_said": F.col("_t").rlike(r"[\[(]at[\])]"), "_long": F.col("_t").rlike(SECRET)})
    clean = F.translate("_t", OPEN + CLOSE + DOT, "\x04\x04\x04")
    rows = rows.withColumn("_t", F.when(F.col("_digit") | F.col("_at") | F.col("_said") | F.col("_long"), clean).otherwise(F.lit("")))
    t, digit = F.col("_t"), F.col("_digit")
    dotted = F.regexp_replace(t, r"\.(?![A-Za-z0-9-])", DOT)
    grouped = F.regexp_replace(t, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", DOT)
    base = F.concat(
        _found(F.col("_at"), dotted, EMAIL, 0),
        _found(digit & t.rlike(IP), t, IP, 1, lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        _found(digit, grouped, CARD, 2, lambda x: _luhn(_only_digits(x["m"]))),
        _found(digit & F.contains("_t", F.lit("+")), t, PHONE, 3, lambda x: F.length(_only_digits(x["m"])).between(10, 15)),
    )
    more = F.concat(
        _found(F.col("_long"), t, SECRET, 4), _found(digit, t, NUMBER, 5), _found(F.col("_said"), t, CONTACT, 6)
    )
    rows = rows.select("id", "_t", base.alias("_base"), more.alias("_more"))

    def described(x: Column) -> Column:
        m, n = x["m"], F.length(x["m"])
        digits = F.length(_only_digits(m))
        letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
        upper = F.length(F.regexp_replace(m, "[^A-Z]", ""))
        before = F.col("_t").substr(F.greatest(x["s"] - BEFORE + 1, F.lit(1)), F.least(x["s"], F.lit(BEFORE)))
        values = {
            "length": n,
            "digits": digits,
            "digit_share": F.floor(100 * digits / n),
            "upper_share": F.floor(100 * upper / n),
            "separators": n - digits - letters,
            "letters": letters,
            "changes": F.regexp_count(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")),
            "hex": m.rlike("^[0-9a-fA-F]+$"),
            "luhn": _luhn(_only_digits(m)),
            "plus": before.endswith("+"),
            "distinct": F.size(F.array_distinct(F.split(m, ""))),
            "vowel_share": F.floor(100 * F.length(F.regexp_replace(m, "[^AEIOUaeiou]", "")) / F.greatest(letters, F.lit(1))),
            "case_changes": F.regexp_count(m, F.lit("[a-z][A-Z]|[A-Z][a-z]")),
            "path": before.rlike(PATH),
            "goes_on": F.col("_t").substr(x["e"] + 1, F.lit(2)).rlike(GOES_ON),
            "line_start": (x["s"] == 0) | before.endswith("\n"),
            "kind": x["kind"],
        }
        bins = [sum(((v.cast("int") >= t).cast("int") for t in FEATURES[f]), F.lit(0)).alias(f) for f, v in values.items()]
        known = F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        mail = before.rlike(MAILED) | m.rlike(DOMAIN) | F.col("_t").substr(x["e"] + 1, F.lit(6)).rlike(DOTTED)
        cued = before.rlike(ASSIGNED) | ((x["kind"] == 5) & before.rlike(NUMBERED)) | ((x["kind"] == 6) & mail)
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), known.alias("known"), cued.alias("cued"), F.struct(*bins).alias("f")
        )

    plain = F.transform("_base", lambda b: F.struct(b["s"].alias("s"), b["kind"].alias("kind"), b["e"].alias("e")))
    return rows.select("id", F.sort_array(plain).alias("base"), F.transform("_more", described).alias("more"))


@dataclass(frozen=True)
class Split:
    feature: str
    bin: int  # bins from here on go right


@dataclass(frozen=True)
class Tree:
    """Depth two: a root, a split for each side (or none), four leaf values."""

    root: Split
    left: Split | None
    right: Split | None
    leaves: tuple[float, float, float, float]

    def value(self, field) -> Column:
        def side(split: Split | None, low: float, high: float) -> Column:
            return F.when(field(split.feature) < split.bin, low).otherwise(F.lit(high)) if split else F.lit(low)

        return F.when(field(self.root.feature) < self.root.bin, side(self.left, *self.leaves[:2])).otherwise(side(self.right, *self.leaves[2:]))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]  # of the margin, for each generator; infinite: nothing of it is selected

    def chosen(self, field) -> Column:
        """Whether a candidate passes its generator's threshold."""
        margin, out = self.margin(field), F.lit(False)
        for k, least in enumerate(self.thresholds):
            if not math.isinf(least):
                out = out | ((field("kind") == k) & (margin >= least))
        return out

    def margin(self, field) -> Column:
        return sum((t.value(field) for t in self.trees), F.lit(self.start))


def _best(table: list, rate_l2: float = 1.0) -> tuple[Split | None, float, float]:
    """The best split of one node's histogram and both leaf values (the node's own if there is none)."""
    total_g = sum(r.g for r in table if r.f == 0)
    total_h = sum(r.h for r in table if r.f == 0)
    best, gain = None, 1e-6
    value = total_g / (total_h + rate_l2)
    leaves = (value, value)
    for f, name in enumerate(FEATURES):
        for b in range(1, len(FEATURES[name]) + 1):
            g = sum(r.g for r in table if r.f == f and r.b < b)
            h = sum(r.h for r in table if r.f == f and r.b < b)
            worth = g * g / (h + rate_l2) + (total_g - g) ** 2 / (total_h - h + rate_l2) - total_g**2 / (total_h + rate_l2)
            if worth > gain:
                best, gain = Split(name, b), worth
                leaves = (g / (h + rate_l2), (total_g - g) / (total_h - h + rate_l2))
    return best, *leaves


NOTHING = (math.inf,) * 3
LEAST = 0.5


def learn(scanned: DataFrame, trees: int = 8, rate: float = 0.5, precision: float = 0.98) -> Model:
    """Boost ``trees`` small trees on all candidates, and calibrate the margin's threshold of each generator.

    Positive are candidates with a cue (the words of ASSIGNED, NUMBERED or MAILED before them) or on a base
    span. No feature sees a cue, so the trees know a secret by its form and place, and select those that
    no cue announces. Two thirds of the candidates (by document) train; the rest calibrate. Those without a
    cue that look like cued ones are no mistakes, so the share of cued ones that selection must reach is
    ``precision`` times their share among look-alikes (as in learning from positive and unlabelled
    cases), and never under LEAST; the lowest such threshold is taken. A generator without one adds nothing.
    """
    each = scanned.select("id", F.explode("more").alias("c"))
    label = (F.col("c.known") | F.col("c.cued")).cast("int").alias("y")
    held = (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held")
    cells = each.select(*[F.col(f"c.f.{f}").alias(f) for f in FEATURES], label, held).groupBy(*FEATURES, "y", "held").agg(F.count("*").alias("w"))
    cells = stored(cells, "pii-cells")
    train = cells.where("not held")
    sums = {r.y: r.w for r in train.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    if len(sums) < 2:
        return Model(0.0, (), NOTHING)
    start = math.log(sums[1] / sums[0])
    grown: list[Tree] = []
    listed = F.posexplode(F.array(*FEATURES)).alias("f", "b")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-Model(start, tuple(grown), NOTHING).margin(F.col)))
        rows = train.select(*FEATURES, (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        table = rows.select(listed, "g", "h").groupBy("f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        root, low, high = _best(table)
        if root is None:
            break
        side = (F.col(root.feature) >= root.bin).alias("side")
        table = rows.select(listed, side, "g", "h").groupBy("side", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        left, ll, lh = _best([r for r in table if not r.side])
        right, rl, rh = _best([r for r in table if r.side])
        grown.append(Tree(root, left, right, tuple(round(rate * x, 6) for x in (ll, lh, rl, rh))))
    model = Model(round(start, 6), tuple(grown), NOTHING)
    margins = cells.where("held").groupBy("kind", F.round(model.margin(F.col), 3).alias("m"))
    held_out = margins.agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("w")).collect()
    thresholds = list(NOTHING)
    for k in range(len(thresholds)):
        right = total = 0
        rows = sorted((r for r in held_out if r.kind == k), key=lambda r: -r.m)  # margins of few trees: a bounded number of values
        said = sum(r.p for r in rows)
        # The share of cued ones among candidates that look like cued ones: what a personal one has, not less.
        cued = sum(r.p * r.p / r.w for r in rows) / said if said else 1.0
        for r, lower in zip(rows, [*(r.m for r in rows[1:]), None]):
            right, total = right + r.p, total + r.w
            if right >= max(precision * cued, LEAST) * total:
                # Half way to the next margin: candidates between the two were not held out.
                thresholds[k] = r.m - 0.0005 if lower is None else (r.m + lower) / 2
    return Model(model.start, model.trees, tuple(thresholds))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, base, spans`` of every row: arrays of (start, end, kind) in code points, by start and kind.

    ``base`` has all checked emails, IPv4 addresses, card numbers (Luhn) and phone numbers; ``spans`` adds the
    selected candidates that overlap none of them: secrets, other numbers, spelled-out addresses.
    ``model`` is learned from ``docs`` unless given.

    A null text is empty. Repeated rows get a result each; a null id is passed on. An empty table gives
    an empty result. Other columns are not read. Each text is read once; what it gave is stored.
    """
    scanned = stored(scan(docs, id_col, text_col), "pii-scan")
    model = model or learn(scanned)
    chosen = F.lit(False)
    added = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    if any(not math.isinf(t) for t in model.thresholds):
        chosen = F.filter("more", lambda c: ~c["known"] & model.chosen(lambda f: c["f"][f]))
        added = F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), F.get(names, x["kind"]).alias("kind")))

    return scanned.select(F.col("id").alias("doc_id"), named(F.col("base")).alias("base"), named(F.sort_array(F.concat("base", added))).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span of the text column replaced by its kind in brackets; overlapping spans become one.

    All columns and rows stay; a null text stays null. The whole row is carried through one stored table.
    """
    packed = docs.select(whole_row(docs).alias("_row"), col(text_col).alias("_text"))
    found = find_personal(packed, "_row", "_text", model).select(F.col("doc_id").alias("_row"), "spans")
    text = F.coalesce(F.col("_row").getField(text_col), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.concat(text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        new = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    value = F.when(F.size("spans") > 0, done).otherwise(F.col("_row").getField(text_col))
    done_rows = found.select("_row", value.alias("_text_out"))
    return done_rows.select(*[(F.col("_text_out") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
