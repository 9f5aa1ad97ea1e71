"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and exact verification.

A register is the truncated logarithm, base b, of the least of the exponential hash values of a set:
registers of a union are the element-wise maxima, and close sets share registers. Four registers in a
row are a band; sets that share a band are candidates. The similarity of two candidates is estimated
by maximum likelihood from how many registers are greater, equal and less, and what may reach the
threshold is verified on the full shingle sets.

Equal sets are one node, named by the digest of the set. Inside a bucket nobody is compared with
everybody: in a few star rounds each node meets one pivot and groups grow together. At last, where a
bucket still holds several groups, the nodes outside its largest group are compared with the others,
block against block inside the tasks; the largest group's nodes are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import arrow_map, binary, col, schema_after, stored, unpacked, whole_row

ROWS, BANDS = 4, 48
REGISTERS = ROWS * BANDS
BASE, TOP, RATE = 1.001, 65534, 20.0  # b, the largest register, the rate of the exponential values
#: Five standard errors of the estimate at a similarity of 0.8: what lies below is not verified.
MARGIN = 5 * (0.8 * 0.2 / REGISTERS) ** 0.5
STARS, BLOCK = 3, 256
BLOCK_SHINGLES = 200_000
CHUNK = 1 << 16  # words hashed at a time

_random = np.random.default_rng(20240229)
LETTERS = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
FACTORS = _random.integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, REGISTERS, np.uint32)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers of STEP and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if _powers.shape[1] < n:
        table = np.empty((2, 2 * n), np.uint64)
        for row, base in enumerate((STEP, BACK)):
            table[row, 0] = 1
            table[row, 1:] = np.uint64(base)
            np.multiply.accumulate(table[row], out=table[row])
        _powers = table
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; all words as one run if there are fewer."""
    words = text.translate(LOWER).split()  # bytes split at space and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    found = []
    for first in range(0, max(1, len(words) - width + 1), CHUNK):
        form = b" ".join(words[first : first + CHUNK + width - 1])
        data = np.frombuffer(form, np.uint8)
        spaces = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
        k = min(width, len(starts))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        powers = _power_table(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * powers[0, : len(data)], out=sums[1:])
        found.append(_mixed((sums[ends] - sums[starts]) * powers[1, starts]))
    return np.unique(np.concatenate(found) if len(found) > 1 else found[0])


def registers(hashes: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        values = short[i : i + 1024, None] * FACTORS + SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities of greatest likelihood, given set sizes and register comparisons (a against b)."""

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    rest = np.maximum(1 - up - down, tiny)
    likely = more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(rest)
    return j[np.arange(len(j)), likely.argmax(axis=1)]


def _compare(ra: np.ndarray, rb: np.ndarray, na, nb) -> np.ndarray:
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    return estimate(more, less, REGISTERS - more - less, np.asarray(na, float), np.asarray(nb, float))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, batch_bytes: int) -> DataFrame:
    """``id, version, n, digest, regs``: hash of the text, set size, 128-bit digest of the set and registers of every text."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("version"))
    schema = schema_after(rows, ["id", "version"], "n long, digest binary, regs binary")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width) for t in binary(batch.column(1)).to_pylist()]
        arrays = [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([registers(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=schema.names)

    return arrow_map(rows, run, schema, batch_bytes)


def _band_rows(reps: DataFrame) -> DataFrame:
    """``key, band, id``: one row per band of a node; the key hashes the band's number and registers."""
    rows = reps.select("id", "regs")
    schema = schema_after(rows, ["id"], "bands array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], names=schema.names)

    listed = rows.mapInArrow(run, schema)
    return listed.select("id", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "band", "id")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity may reach the threshold."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb")
    schema = schema_after(rows, ["a", "b"], "na long, nb long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = _compare(ra, rb, na, nb) >= least - MARGIN
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingle sets reach ``percent``."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    rows = both.select("a", "b", "na", "nb", common.alias("common"))
    return rows.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, comp, ...) with components joined along ``links`` (a, b); ``comp`` stays the smallest id.

    Every step hooks each component to its least neighbour, follows the chains to their roots by
    doubling, and goes on with the edges between roots. All tables stay distributed.
    """

    def relabelled(edges: DataFrame, names: DataFrame, old: str, new: str) -> DataFrame:
        a = names.select(F.col(old).alias("a"), F.col(new).alias("ca"))
        b = names.select(F.col(old).alias("b"), F.col(new).alias("cb"))
        joined = edges.join(a, "a", "left").join(b, "b", "left")
        out = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = stored(relabelled(links, labels, "id", "comp"), "near-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        parent = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "near-parent")
        while True:
            up = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            jumped = parent.join(up, F.col("p") == F.col("_u")).select("u", "p", "_p")
            if jumped.where("p <> _p").isEmpty():
                break
            parent = stored(jumped.select("u", F.col("_p").alias("p")), "near-parent")
        if roots is None:
            roots = parent
        else:
            moved = roots.join(parent.toDF("_u", "_p"), F.col("p") == F.col("_u"), "left").select("u", F.coalesce("_p", "p").alias("p"))
            roots = stored(moved.unionByName(parent.join(roots, "u", "left_anti")), "near-roots")
        edges = stored(relabelled(edges, parent, "u", "p"), "near-edges")
    if roots is None:
        return labels
    others = [c for c in labels.columns if c != "comp"]
    out = labels.join(roots, F.col("comp") == F.col("u"), "left").select(*others, F.coalesce("p", "comp").alias("comp"))
    return stored(out, "near-labels")


def _block_links(
    n: np.ndarray, comp: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], rank: np.ndarray, left: np.ndarray, minor: np.ndarray, band: int, percent: int
) -> list[tuple[int, int]]:
    """Verified links that connect something new between the ``left`` nodes of a unit and its others.

    All left nodes are minor (outside the bucket's largest component); two minor nodes meet in two
    units and are looked at in the one where the left has the smaller ``rank``. A pair is looked at in the
    first bucket that it shares. Pairs that links have already connected are passed over, so a unit
    gives fewer links than it has nodes.
    """
    _, first = np.unique(comp, return_index=True)
    parent = first[np.searchsorted(comp[first], comp)] if len(n) else comp

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    links = []
    bands = regs.reshape(len(n), BANDS, ROWS)
    right = np.flatnonzero(~left)
    for x in np.flatnonzero(left).tolist():
        y = right[(comp[right] != comp[x]) & (~minor[right] | (rank[right] > rank[x]))]
        y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
        if not len(y):
            continue
        shared = (bands[y] == bands[x]).all(axis=2)
        y = y[shared.argmax(axis=1) == band]
        if len(y):
            y = y[_compare(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), n[x]), n[y]) >= percent / 100 - MARGIN]
        for z in y.tolist():
            if root(x) != root(z):
                common = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                if 100 * common >= percent * (int(n[x]) + int(n[z]) - common):
                    parent[root(z)] = root(x)
                    links.append((x, z))
    return links


def _cross_links(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components inside buckets.

    ``rows``: key, band, id, comp, n of every node in every bucket. A task holds a block of minor nodes and
    a block of the bucket's nodes at a time, BLOCK nodes or BLOCK_SHINGLES shingles each, however large
    the bucket. Of buckets with the same members only the one of the lowest band is opened: no pair
    could share another one first.
    """
    members = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    groups = rows.groupBy("key", "band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"), *members)
    whole = groups.groupBy("key", "band").agg(
        F.max(F.struct("c", "s", "comp")).alias("major"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("comps"),
        *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2)],
    ).where("comps > 1")
    once = whole.groupBy("x1", "x2", "c", "s", "major").agg(F.min(F.struct("band", "key")).alias("b"))

    def blocks(count, size):
        return F.ceil(F.greatest(count / BLOCK, size / BLOCK_SHINGLES))

    mixed = once.select(
        "b.key", F.col("major.comp").alias("major"), blocks(F.col("c"), F.col("s")).alias("blocks"),
        blocks(F.col("c") - F.col("major.c"), F.col("s") - F.col("major.s")).alias("minors"),
    )
    mixed = stored(mixed, "near-mixed")
    open_ = rows.select("key", "band", "id", "comp").join(mixed, "key").withColumn("minor", F.col("comp") != F.col("major"))
    open_ = open_.join(reps.select("id", "n", "regs").join(sets, "id"), "id")
    number = F.xxhash64("id", F.lit(3))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    node = F.struct("id", "comp", "n", "regs", "s", "minor", "left")
    right = open_.select("*", F.lit(False).alias("left"), F.pmod(number, F.col("blocks")).alias("j"), every("minors").alias("i"))
    left = open_.where("minor").select("*", F.lit(True).alias("left"), every("blocks").alias("j"), F.pmod(number, F.col("minors")).alias("i"))
    units = right.unionByName(left).groupBy("key", "band", "i", "j").agg(F.collect_list(node).alias("nodes"), F.max("left").alias("any"))
    units = units.where("any").select("band", "nodes")
    schema = schema_after(reps.select(F.col("id").alias("a"), F.col("id").alias("b")), ["a", "b"], "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes = batch.column(1)[k].values
                ids, n = nodes.field("id"), nodes.field("n").to_numpy(zero_copy_only=False)
                comp = nodes.field("comp").dictionary_encode().indices.to_numpy()
                rank = np.argsort(np.argsort(np.array(ids.to_pylist(), object), kind="stable"), kind="stable")
                regs = np.frombuffer(b"".join(nodes.field("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                full = [x.values.to_numpy() for x in nodes.field("s")]
                left, minor = (nodes.field(f).to_numpy(zero_copy_only=False) for f in ("left", "minor"))
                links = _block_links(n, comp, regs, full, rank, left, minor, batch.column(0)[k].as_py(), percent)
                if links:
                    a, b = (pa.array(x, pa.int64()) for x in zip(*links))
                    yield pa.RecordBatch.from_arrays([ids.take(a), ids.take(b)], names=schema.names)

    return units.mapInArrow(run, schema)


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, batch_bytes: int) -> DataFrame:
    """``near_duplicates`` with ``version``, the hash of each row's text."""
    least = percent / 100
    made = stored(sketches(docs, id_col, text_col, width, batch_bytes), "near-sketches")
    # A node is a set of shingles, whatever rows have it: one id may name several texts.
    nodes = made.where("n > 0 and id is not null").groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("id", "n", "regs")).alias("r"))
    nodes = stored(nodes.select(F.col("node").alias("id"), F.col("r.id").alias("rep"), "r.n", "r.regs"), "near-nodes")

    bands = _band_rows(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = bands.join(shared, "key")
    # A node that shares large buckets stands in the middle of a group: a good pivot.
    listed = buckets.groupBy("id").agg(F.sum("size").alias("weight"), F.collect_list(F.struct("key", "band")).alias("keys"))
    reps = stored(nodes.join(listed, "id"), "near-reps")
    labels = reps.select("id", F.col("id").alias("comp"))

    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    schema = schema_after(made.select(F.col("digest").alias("id")), ["id"], "s array<bigint>")

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width) for t in binary(batch.column(1)).to_pylist()]
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    sets = stored(arrow_map(texts, full, schema, batch_bytes).dropDuplicates(["id"]), "near-sets")

    def placed(labels: DataFrame) -> DataFrame:
        """A row for every bucket of every node; a node travels once, and its buckets are written out behind the join."""
        return reps.select("id", "n", "weight", "keys").join(labels, "id").select("id", "n", "weight", "comp", F.inline("keys"))

    for turn in range(STARS):
        rows = placed(labels)
        worth = F.xxhash64("id", F.lit(turn)) if turn else F.col("weight")
        pivot = F.max(F.struct(worth.alias("w"), "id", "comp"))
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot.alias("pivot")).where("lo <> hi")
        meets = rows.join(mixed, "key").where(F.col("comp") != F.col("pivot.comp"))
        pairs = meets.groupBy("id").agg(F.max("pivot").alias("p")).select(F.col("p.id").alias("a"), F.col("id").alias("b"))
        labels = components(labels, _verified(stored(_likely(pairs, reps, least), "near-likely"), sets, percent))
    rows = placed(labels).select("key", "band", "id", "comp", "n")
    labels = components(labels, stored(_cross_links(rows, reps, sets, percent), "near-links"))

    named = labels.join(reps.select("id", "rep"), "id")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("least"))
    named = named.join(smallest, "comp").select(F.col("id").alias("_node"), "least")
    place = nodes.join(named, F.col("id") == F.col("_node"), "left").select(F.col("id").alias("_node"), F.coalesce("least", "rep").alias("least"))
    out = made.join(stored(place, "near-places"), F.col("digest") == F.col("_node"), "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), "version")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    batch_bytes: int = 2 << 20,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    A text's set holds its distinct runs of ``width`` words (A-Z in lower case, split at space and
    0x09-0x0D); with fewer words all of them are one run. Texts are linked if their sets share at least
    ``percent`` percent of their union. ``component_id`` is the smallest id that links reach; ``kept`` marks
    that one document of each component.

    A pair at 80 % shares no band with probability below 1e-10; any pair that shares one is verified
    unless it is already connected or its estimate lies five standard errors below.
    Null texts and texts without words have no shingles, are linked with nothing and kept. A null id is
    kept and never linked. Rows that repeat an id and text get the same result each; an id with several
    texts has a result for each of them. An empty table gives an empty result; other columns are not read.
    """
    return _groups(docs, id_col, text_col, width, percent, batch_bytes).drop("version")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the smallest id; all columns, rows without an id kept.

    Of an id with several texts only the texts go that are near duplicates of a smaller id's.
    """
    options = {"width": 5, "percent": 80, "batch_bytes": 2 << 20} | options
    gone = _groups(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("version").alias("_of")).distinct()
    packed = docs.select(whole_row(docs).alias("_row"), col(id_col).alias("_id"), F.xxhash64(col(text_col)).alias("_version"))
    left = packed.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_version") == F.col("_of")), "left_anti")
    return unpacked(left, "_row", docs)
