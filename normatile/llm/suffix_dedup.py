"""Exact removal of repeated byte strings with suffix arrays over bounded buckets.

Every string of ``window`` bytes names one anchor in itself: its least k-gram hash. Neighbouring strings
with the same anchor are a run, and the run's bytes are its context. Equal strings have equal anchors,
so only contexts of one anchor can share a string: the anchors deal the corpus into small buckets.

Contexts that are equal as a whole are one node with all its occurrences. In each bucket an enhanced
suffix array over the remaining contexts is scanned with a stack: every interval of suffixes with a
common prefix of ``window`` bytes or more that can be extended to the left in more than one way is a
maximal repeat, reported with all its occurrences. All but the first occurrence are removed. A hash of
the first ``window`` bytes leaves out suffixes that share them with no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import arrow_map, binary, col, schema_after, stored

GRAM = 32
PLACE = 24  # low bits of a k-gram's rank hold its place
SEGMENT = 4 << 20  # bytes looked at in one go; below 2 ** PLACE
BOUND = 4096  # contexts of a bucket at most; larger buckets are dealt anew by single strings

LETTERS = np.array([int.from_bytes(hashlib.md5(b"suffix%d" % b).digest()[:8], "little") | 1 for b in range(256)], np.uint64)
STEP = 0xD6E8FEB86659FD93
BACK = pow(STEP, -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        table = np.full((2, 2 * n), 1, np.uint64)
        for row, base in enumerate((STEP, BACK)):
            table[row, 1:] = np.uint64(base)
            np.multiply.accumulate(table[row], out=table[row])
        _powers = table
    return _powers


def _gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every ``size`` bytes."""
    powers = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers[0, : len(data)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * powers[1, : len(data) - size + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def runs(text: bytes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of window starts with one anchor: first start, last start, anchor hash."""
    for at in range(0, max(0, len(text) - window + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8)[at : at + SEGMENT + window - 1]
        h = _gram_hashes(data)
        width = window - GRAM + 1
        low = ((h >> np.uint64(PLACE)) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        yield first + at, last + at, h[place[first]].view(np.int64)


def contexts(docs: DataFrame, window: int, batch_bytes: int) -> DataFrame:
    """``id, s, e, anchor, ctx`` of every run; a context seen earlier in its own text has a null ``anchor``."""
    schema = schema_after(docs, ["id"], "s int, e int, anchor long, ctx long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, first, last, anchors, digests = [], [], [], [], []
        for i, text in enumerate(binary(batch.column(1)).to_pylist()):
            seen: set[tuple[int, int]] = set()
            view = memoryview(text)
            open_end = -1  # of the last row, if it is a repeat inside this text
            for starts, ends, keys in runs(text, window):
                for s, e, key in zip(starts.tolist(), ends.tolist(), keys.tolist()):
                    ctx = xxhash.xxh3_64_intdigest(view[s : e + window]) - (1 << 63)
                    if (key, ctx) in seen:
                        if open_end == s - 1:
                            last[-1] = e
                        else:
                            which.append(i)
                            first.append(s)
                            last.append(e)
                            anchors.append(None)
                            digests.append(None)
                        open_end = e
                        continue
                    seen.add((key, ctx))
                    which.append(i)
                    first.append(s)
                    last.append(e)
                    anchors.append(key)
                    digests.append(ctx)
                    open_end = -1
        arrays = [pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchors, pa.int64()), pa.array(digests, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *arrays], names=schema.names)

    return arrow_map(docs, run, schema, batch_bytes)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def maximal_repeats(suffixes: list[bytes], left: list[int | None], least: int) -> list[tuple[int, list[int]]]:
    """Maximal repeats of at least ``least`` bytes as (length, all members), from the interval tree of the suffixes.

    ``left`` is the byte before each suffix, None where nothing is known, which differs from everything.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    common = [_common(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]
    found, stack = [], [(0, 0)]
    for i, depth in enumerate([*common, 0]):
        start = i
        while depth < stack[-1][0]:
            length, start = stack.pop()
            if length < least:
                continue
            members = order[start : i + 1]
            before = {left[m] for m in members}
            if len(before) > 1 or None in before:
                found.append((length, members))
        if depth > stack[-1][0]:
            stack.append((depth, start))
    return found


def bucket_repeats(texts: list[bytes], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats among contexts: (length, [(context, place), ...]).

    Suffixes are dealt by a hash of their first ``window`` bytes. Only those whose left bytes differ, or
    that begin a context, go on to the suffix array and its scan, which compares bytes: hashes that meet
    by chance change nothing.
    """
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    buffer = b"".join(texts)
    data = np.frombuffer(buffer, np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes - window + 1)
    places = np.arange(len(owner)) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(sizes - window + 1)[:-1]]), sizes - window + 1)
    key = _gram_hashes(data, window)[places]
    order = np.argsort(key)
    key, places, owner = key[order], places[order], owner[order]
    begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    count = np.diff(np.concatenate([begin, [len(key)]]))
    edge = places == offsets[owner]
    before = np.where(edge, -1, data[places - 1].astype(np.int64))
    diverse = (np.minimum.reduceat(before, begin) != np.maximum.reduceat(before, begin)) | np.logical_or.reduceat(edge, begin)
    out = []
    for g in np.flatnonzero((count > 1) & diverse):
        rows = range(begin[g], begin[g] + count[g])
        suffixes = [buffer[places[r] : offsets[owner[r] + 1]] for r in rows]
        left = [None if edge[r] else int(before[r]) for r in rows]
        for length, members in maximal_repeats(suffixes, left, window):
            out.append((length, [(int(owner[begin[g] + m]), int(places[begin[g] + m] - offsets[owner[begin[g] + m]])) for m in members]))
    return out


def removed_runs(docs: DataFrame, window: int, batch_bytes: int) -> DataFrame:
    """``id, s, e``: byte ranges covered by a string of ``window`` bytes that also starts earlier."""
    # Stored: three steps read it, and each would look through all texts anew.
    found = stored(contexts(docs, window, batch_bytes), "suffix-runs")
    within = found.where("anchor is null").select("id", "s", (F.col("e") + window).alias("e"))
    runs_ = found.where("anchor is not null")
    # Anchors that occur twice or more, counted per task first.
    twice = stored(runs_.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    # Occurrences on the left: those of a hot anchor are split over tasks.
    shared = stored(runs_.join(twice, "anchor"), "suffix-shared")
    first = shared.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("id", "s", "e")).alias("f"))
    first = stored(first, "suffix-first")
    copies = shared.join(first.where("n > 1").select("anchor", "ctx", "f"), ["anchor", "ctx"])
    copies = copies.where(F.struct("id", "s") != F.struct("f.id", "f.s")).select("id", "s", (F.col("e") + window).alias("e"))

    # One context each of anchors with different contexts, with its bytes.
    several = first.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    asked = first.join(several, "anchor").select("f.id", "f.s", "f.e", "anchor", (F.col("contexts") > BOUND).alias("hot"))
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("s", "e", "anchor", "hot")).alias("asked"))
    texts = docs.join(asked, "id").select("id", "text", "asked")
    schema = schema_after(docs, ["id"], "s int, e int, anchor long, hot boolean, t binary")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        flat = lists.flatten()
        which = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())))
        whole = binary(batch.column(1)).to_pylist()
        s, e = flat.field("s").to_pylist(), flat.field("e").to_pylist()
        pieces = [whole[i][a : b + window] for i, a, b in zip(which.to_pylist(), s, e)]
        arrays = [flat.field(f) for f in ("s", "e", "anchor", "hot")]
        return pa.RecordBatch.from_arrays([batch.column(0).take(which), *arrays, pa.array(pieces, pa.binary())], names=schema.names)

    bytes_ = stored(arrow_map(texts, cut, schema, batch_bytes), "suffix-contexts")

    # Ordinary buckets: suffix arrays over many of them at a time.
    buckets = bytes_.where("not hot").groupBy("anchor").agg(F.collect_list(F.struct("id", "s", "t")).alias("c")).select("c")
    spans = schema_after(docs, ["id"], "s int, e int")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            step = max(1, int(20_000 // max(1.0, sizes.mean()))) if len(sizes) else 1
            for at in range(0, batch.num_rows, step):
                nodes = batch.column(0).slice(at, step).flatten()
                ids, starts = nodes.field("id"), nodes.field("s").to_numpy()
                rank = pc.rank(ids, tiebreaker="dense").to_numpy()
                again: dict[int, list[tuple[int, int]]] = {}
                for length, members in bucket_repeats(nodes.field("t").to_pylist(), window):
                    earliest = min((rank[c], starts[c] + place) for c, place in members)
                    for c, place in members:
                        if (rank[c], starts[c] + place) != earliest:
                            again.setdefault(c, []).append((place, place + length))
                # Repeats lie inside each other: only what they cover in a context goes on.
                which, s, e = [], [], []
                for c, found in again.items():
                    end = -1
                    for a, b in sorted(found):
                        if a > end:
                            which.append(c)
                            s.append(int(starts[c]) + a)
                            e.append(int(starts[c]) + b)
                        elif b > end:
                            e[-1] = int(starts[c]) + b
                        end = max(end, b)
                arrays = [pa.array(s, pa.int32()), pa.array(e, pa.int32())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *arrays], names=spans.names)

    partial = buckets.mapInArrow(scan, spans)

    # Buckets beyond the bound: each of their strings is a bucket of its own, combined before the shuffle.
    strings = schema_after(docs, ["id"], "s int, h binary")

    def single(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, s, h = [], [], []
        for i, (start, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            for p in range(len(text) - window + 1):
                which.append(i)
                s.append(start + p)
                h.append(xxhash.xxh3_128_digest(text[p : p + window]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(which, pa.int64())), pa.array(s, pa.int32()), pa.array(h, pa.binary())], names=strings.names
        )

    hot = arrow_map(bytes_.where("hot").select("id", "s", "t"), single, strings, batch_bytes // 8, text=2)
    earliest = hot.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "s")).alias("f")).where("n > 1").drop("n")
    hot = hot.join(earliest, "h").where(F.struct("id", "s") != F.col("f")).select("id", "s", (F.col("s") + window).alias("e"))
    return within.unionByName(copies).unionByName(partial).unionByName(hot)


def dedup_suffixes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, batch_bytes: int = 2 << 20
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row; ``spans`` are the maximal removed byte runs, ``kept`` the bytes left.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a smaller id, or
    further left in the same text; overlapping occurrences count, and strings are judged on the input.
    ``window`` must be at least 64.

    A null text is empty. Rows with a null id stay whole. Rows that repeat an id count as one document: they get the same
    runs removed, and none because of each other. An empty table gives an empty result; other columns are not read.
    Memory: a batch of ``batch_bytes``, or one text with two numbers for each of its contexts (one for about 35 bytes
    of text); the bytes of about 20,000 contexts in a task that scans buckets.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM}")
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    gone = stored(removed_runs(rows.where("id is not null"), window, batch_bytes), "suffix-removed")
    gone = gone.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    joined = rows.join(gone, F.col("id") == F.col("_id"), "left").select(F.col("id").alias("doc_id"), "text", "gone")
    schema = schema_after(joined, ["doc_id"], "n_bytes long, n_removed long, spans array<struct<s:int,e:int>>, kept binary")
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, runs_, left = [], [], [], []
        lists = batch.column(2)
        for i, text in enumerate(binary(batch.column(1)).to_pylist()):
            merged: list[list[int]] = []
            if lists[i].is_valid:
                s, e = (lists[i].values.field(f).to_numpy() for f in ("s", "e"))
                for k in np.argsort(s, kind="stable").tolist():
                    a, b = int(s[k]), int(e[k])
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
            cuts = [0, *[x for run in merged for x in run], len(text)]
            sizes.append(len(text))
            removed.append(sum(b - a for a, b in merged))
            runs_.append([{"s": a, "e": b} for a, b in merged])
            left.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
        arrays = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, span), pa.array(left, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return arrow_map(joined, keep, schema, batch_bytes)
