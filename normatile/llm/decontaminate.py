"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and test items are brought to one form, " word word ... word ", in bytes. A pattern is a window
of 13 item words in that form, spaces at both ends included, so a pattern occurs where its words do.
A shift table over blocks of bytes says how far the search may jump, the block at the end of a
pattern's head selects a bucket of patterns, and each is then compared byte by byte. A batch of texts
is one buffer; many cursors walk it side by side, so every step is a few array operations.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import arrow_map, binary, col, schema_after, stored, unpacked, whole_row

WINDOW = 13
#: Word bytes are a-z, 0-9 and all of non-ASCII; A-Z count as a-z; the rest separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LANE = 512
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: bytes) -> bytes:
    """Words between single spaces, a space at both ends; empty without words."""
    words = text.translate(TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


@dataclass
class Patterns:
    """Windows of one class (full windows, or whole short items), as places in ``buffer``."""

    buffer: bytes
    start: np.ndarray
    length: np.ndarray
    words: np.ndarray
    item: np.ndarray
    head: int  # bytes of every pattern that the tables look at
    block: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray  # hash of the head's last block, ascending; other arrays in the same order
    prefix: np.ndarray


def _blocks(buffer: bytes) -> np.ndarray:
    """The eight bytes that begin at each place, as one number."""
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    return np.ndarray((len(buffer),), np.dtype("<u8"), padded.data, strides=(1,))


def _hash(values: np.ndarray, block: int, bits: int) -> np.ndarray:
    keep = np.uint64((1 << (8 * block)) - 1)
    return ((values & keep) * MULTIPLIER) >> np.uint64(64 - bits)


def compile_patterns(buffer: bytes, start, length, words, item) -> Patterns:
    start, length, words, item = (np.asarray(x, np.int64) for x in (start, length, words, item))
    head = int(length.min())
    block = min(8, head)
    bits = max(12, min(24, int(np.ceil(np.log2(16 * len(buffer))))))
    at, most = _blocks(buffer), head - block + 1
    shift = np.full(1 << bits, most, np.uint16 if most < 65536 else np.int64)
    for j in range(head - block + 1):  # block that begins at j ends head - block - j before the head's end
        np.minimum.at(shift, _hash(at[start + j], block, bits), head - block - j)
    suffix = _hash(at[start + head - block], block, bits)
    order = np.argsort(suffix, kind="stable")
    prefix = _hash(at[start], block, 64)
    return Patterns(buffer, start[order], length[order], words[order], item[order], head, block, bits, shift, suffix[order], prefix[order])


def compile_items(items: list[tuple[int, bytes]], window: int = WINDOW) -> list[Patterns]:
    """Tables for (number, text) items: one set for full windows, one for each length class of short items."""
    buffer, classes = [], {}
    place = 0
    for number, text in items:
        form = canonical(text)
        if not form:
            continue
        spaces = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
        n = len(spaces) - 1
        width = min(n, window)
        first, last = spaces[: n - width + 1], spaces[width:] + 1
        # A short item would shorten everyone's jumps: classes by powers of two of the length.
        key = 0 if n >= window else int(np.log2(len(form))) + 1
        classes.setdefault(key, []).append((place + first, last - first, np.full(len(first), width), np.full(len(first), number)))
        buffer.append(form)
        place += len(form)
    whole = b"".join(buffer)
    return [compile_patterns(whole, *(np.concatenate(x) for x in zip(*parts))) for _, parts in sorted(classes.items())]


def search(text: bytes, p: Patterns) -> list[tuple[int, int]]:
    """All (place in text, pattern number) where a pattern occurs."""
    n = len(text)
    if n < p.head:
        return []
    at = _blocks(text)
    # A cursor stands on the end of a head; each walks its own lane.
    here = np.arange(p.head - 1, n, LANE, dtype=np.int64)
    stop = np.minimum(here + LANE, n)
    found = []
    while len(here):
        jump = p.shift[_hash(at[here - (p.block - 1)], p.block, p.bits)].astype(np.int64)
        zero = jump == 0
        if zero.any():
            found.append(here[zero])
        here = here + np.maximum(jump, 1)
        alive = here < stop
        if not alive.all():
            here, stop = here[alive], stop[alive]
    if not found:
        return []
    ends = np.sort(np.concatenate(found))
    hits = []
    code = _hash(at[ends - (p.block - 1)], p.block, p.bits)
    low, high = np.searchsorted(p.suffix, code, "left"), np.searchsorted(p.suffix, code, "right")
    begin = ends - (p.head - 1)
    prefix = _hash(at[begin], p.block, 64)
    buckets = high - low
    step = max(1, (1 << 20) // max(1, int(buckets.max(initial=1))))
    for s in range(0, len(ends), step):  # buckets side by side, a bounded number at a time
        size = buckets[s : s + step]
        which = np.repeat(np.arange(s, s + len(size)), size)
        number = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        same = p.prefix[number] == prefix[which]
        for i, k in zip(begin[which[same]].tolist(), number[same].tolist()):
            o, length = int(p.start[k]), int(p.length[k])
            if text[i : i + length] == p.buffer[o : o + length]:
                hits.append((i, k))
    return hits


def find_in(texts: list[bytes], tables: list[Patterns]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: number of words, hit runs of words (first, end) in order, item numbers."""
    forms = [canonical(t) for t in texts]
    joined = b"\n".join(forms)
    starts = np.cumsum([0] + [len(f) + 1 for f in forms])
    spans: dict[int, set[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for p in tables:
        hits = search(joined, p)
        if not hits:
            continue
        places = np.array([h[0] for h in hits], np.int64)
        docs = np.searchsorted(starts, places, "right") - 1
        words_before: dict[int, np.ndarray] = {}
        for (place, k), d in zip(hits, docs.tolist()):
            if d not in words_before:
                words_before[d] = np.flatnonzero(np.frombuffer(forms[d], np.uint8) == 32)
            w = int(np.searchsorted(words_before[d], place - starts[d]))
            spans.setdefault(d, set()).add((w, w + int(p.words[k])))
            items.setdefault(d, set()).add(int(p.item[k]))
    out = []
    for d, form in enumerate(forms):
        runs: list[tuple[int, int]] = []
        for a, b in sorted(spans.get(d, ())):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        out.append((max(0, form.count(b" ") - 1), runs, sorted(items.get(d, ()))))
    return out


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``block_bytes`` (or one item), read as they are asked for; one empty block if there are none."""
    rows = items.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("i"), F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8").alias("t"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    yield block


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = 8 << 20,
    max_item_bytes: int | None = None,
    batch_bytes: int = 2 << 20,
) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row of ``docs``.

    A word inside an occurrence of a window (``window`` consecutive words of an item; a shorter item is
    one window) is hit; ``spans`` lists the runs of hit words as (first, end), ``items`` the ids, as
    sorted strings, of items with an occurring window. Words are compared with A-Z in lower case.

    The items are the stated query set. They pass through the driver one by one and are searched in
    blocks of ``block_bytes`` against all rows, one pass over ``docs`` per block; any number of blocks is
    searched unless ``max_item_bytes`` is given (more item text then raises an error). A block is all
    that is broadcast; its hits are stored and its broadcast destroyed before the next one is searched. With
    several blocks the results of a row are merged by id and text hash; with one there is no shuffle.

    Null texts have no words. A null item id reads as ''. Items without words never occur. Equal item
    ids count once. Repeated rows get a result each. Empty tables give empty results or no hits.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    if max_item_bytes is not None:
        size = items.select(F.sum(F.octet_length(col(item_text_col))).alias("n")).first().n or 0
        if size > max_item_bytes:
            raise ValueError(f"{size} bytes of items; at most {max_item_bytes} are searched at a time")
    rest = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"

    def searched(rows: DataFrame, block: list[tuple[str, bytes]]) -> tuple[DataFrame, Broadcast]:
        names = [i for i, _ in block]
        shared = spark.sparkContext.broadcast((names, compile_items([(n, t) for n, (_, t) in enumerate(block)], window)))

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, tables = shared.value
            hits = find_in(binary(batch.column(1)).to_pylist(), tables)
            spans = pa.array([[{"first": a, "end": b} for a, b in runs] for _, runs, _ in hits], SPANS)
            ids = pa.array([sorted({names[i] for i in its}) for _, _, its in hits], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in hits], pa.int64()), spans, ids], names=["doc_id", "n_words", "spans", "items"]
            )

        return arrow_map(rows, scan, schema_after(rows, ["doc_id"], rest), batch_bytes), shared

    blocks = _item_blocks(items, item_id_col, item_text_col, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return searched(rows, block)[0]
    # Several passes: number the rows by content, so that repeated rows stay apart from others.
    keyed = stored(rows.withColumn("_h", F.xxhash64("text")).groupBy("doc_id", "_h", "text").agg(F.count("*").alias("_n")), "items-keyed")
    keyed = keyed.select(F.struct("doc_id", "_h", "_n").alias("doc_id"), "text")
    levels: list[list[DataFrame]] = [[]]  # a table of one level is the union of UNION tables of the level before
    for n, block in enumerate(itertools.chain([block, following], blocks)):
        hits, shared = searched(keyed, block)
        # Every row comes with the first block; of the others only rows with hits are kept.
        levels[0].append(stored(hits if n == 0 else hits.where(F.size("spans") > 0), "items-hits"))
        shared.destroy()
        for k, level in enumerate(levels):
            if len(level) < UNION:
                break
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(stored(_union(level), "items-hits"))
            level.clear()
    every = _union([part for level in levels for part in level])
    merged = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    run = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<first:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    merged = merged.withColumn("spans", run)
    copies = F.explode(F.sequence(F.lit(1), F.col("doc_id._n").cast("int")))
    return merged.select("doc_id", "n_words", "spans", "items", copies.alias("_copy")).select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "items")


UNION = 32  # tables of hits in one union at most
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: at least one word in ``share`` is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    out = found.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept; the row travels beside its text, so nothing is shuffled."""
    packed = docs.select(whole_row(docs).alias("_row"), col(text_col).alias("_text"))
    found = verdict(find_contamination(packed, items, "_row", "_text", **options))
    return unpacked(found.where(~F.col("contaminated")), "doc_id", docs)
