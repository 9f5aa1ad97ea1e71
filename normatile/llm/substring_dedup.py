"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; where its top bits are zero a chunk ends, so an insertion
changes only the chunks around it. A chunk whose digest occurs earlier, by (id, place), is repeated;
runs of neighbouring repeated chunks are removed once they are long enough to be a passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.llm.common import arrow_map, binary, col, schema_after, stored

#: 256 random numbers, from a rule that every executor can follow.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] in 32 bits: the last 32 bytes count. Five doublings instead of a loop."""
    h = GEAR[data]
    for back in (1, 2, 4, 8, 16):
        if len(h) > back:
            h[back:] = h[back:] + (h[:-back] << np.uint32(back))
    return h


def chunk_ends(text: bytes, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks: where the top ``bits`` of the gear hash are zero, ``least`` to ``most`` bytes apart."""
    if not text:
        return []
    marks = np.flatnonzero(gear_hash(np.frombuffer(text, np.uint8)) >> np.uint32(32 - bits) == 0) + 1
    ends, start = [], 0
    for end in [*marks.tolist(), len(text)]:
        while end - start > most:
            start += most
            ends.append(start)
        if end - start >= least or (end == len(text) and end > start):
            ends.append(end)
            start = end
    return ends


def pieces(text: bytes, bits: int, least: int, most: int, rests: bool) -> list[tuple[int, int]]:
    """(start, end) of the pieces that get a digest: chunks of ``least`` bytes or more; with ``rests`` every byte is in one.

    A shorter rest makes a piece with the chunk before it, which stays a piece of its own: it may occur
    inside longer texts. A text that is all rest is one piece.
    """
    ends = chunk_ends(text, bits, least, most)
    starts = [0, *ends]
    out = [(a, b) for a, b in zip(starts, ends) if b - a >= least]
    if rests and len(out) < len(ends):
        out.append((starts[max(0, len(ends) - 2)], ends[-1]))
    return out


def runs_of(chunks: list[dict], size: int, min_run: int) -> list[tuple[int, int]]:
    """Runs of repeated chunks (sorted, touching or overlapping) of ``min_run`` bytes or more, or over the whole text."""
    out: list[list[int]] = []
    for c in chunks:
        if out and c["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c["e"])
        else:
            out.append([c["s"], c["e"]])
    return [(a, b) for a, b in out if b - a >= min(min_run, size)]


def repeated_chunks(
    docs: DataFrame, id_col: str, text_col: str, bits: int, least: int, most: int, batch_bytes: int, rests: bool = False
) -> DataFrame:
    """``id, version, chunks``: (start, end) in bytes of every piece that occurs earlier, per document with any.

    ``version`` hashes the text: rows that repeat an id with another text are documents of their own.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("version")).where(F.col("id").isNotNull())

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, starts, stops, digests = [], [], [], []
        for i, text in enumerate(binary(batch.column(1)).to_pylist()):
            for a, b in pieces(text, bits, least, most, rests):
                which.append(i)
                starts.append(a)
                stops.append(b)
                digests.append(xxhash.xxh3_128_digest(text[a:b]))
        at = pa.array(which, pa.int64())
        columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], names=["id", "version", "s", "e", "d"])

    # Stored: the chunks are read twice and cut once.
    chunks = stored(arrow_map(rows, cut, schema_after(rows, ["id", "version"], "s long, e long, d binary"), batch_bytes), "cdc-chunks")
    # Combined per task before the shuffle, so a hot chunk is a row per task. Unique chunks end here.
    first = chunks.groupBy("d").agg(F.count("*").alias("n"), F.min(F.struct("id", "version", "s")).alias("f")).where("n > 1").drop("n")
    first = stored(first, "cdc-first")
    # Occurrences on the left: a hot chunk is split over tasks, its one row on the right is copied.
    again = chunks.join(first, "d").where(F.struct("id", "version", "s") != F.col("f"))
    listed = again.groupBy("id", "version").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("chunks"))
    return stored(listed, "cdc-again")


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = 5,
    least: int = 24,
    most: int = 512,
    batch_bytes: int = 4 << 20,
    rests: bool = True,
    min_run: int = 128,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` are the bytes left.

    Chunks end where ``bits`` bits of the gear hash are zero, at least ``least`` and at most ``most``
    bytes long; with ``rests`` a shorter rest at the end of a text counts together with the chunk before
    it, or as a whole text, else it stays. A chunk is repeated if an equal one (128-bit digest of its
    bytes) has a smaller id, or stands earlier in the same text. Neighbouring repeated chunks make a run;
    a run goes if it has ``min_run`` bytes or is the whole text: one chunk alone is a few words and no
    passage. ``n_spans`` counts the removed runs. Chunks end at the same places in equal passages after
    the first chunk, so of a repeated passage a chunk's length or so may stay at either end.

    A null text is empty. Rows with a null id stay whole. Rows that repeat an id and text count as one
    document: they get the same runs removed, and none because of each other; with another text they are
    documents of their own, in order of its hash. An empty table gives an empty result; other columns are
    not read. Memory: a batch of ``batch_bytes``, or one text with a few numbers for each of its chunks.
    """
    again = repeated_chunks(docs, id_col, text_col, bits, least, most, batch_bytes, rests)
    again = again.select(F.col("id").alias("_id"), F.col("version").alias("_of"), "chunks")
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("_version"))
    joined = rows.join(again, (F.col("doc_id") == F.col("_id")) & (F.col("_version") == F.col("_of")), "left").select("doc_id", "text", "chunks")
    schema: T.StructType = schema_after(joined, ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept binary")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, spans, left = [], [], [], []
        for text, chunks in zip(binary(batch.column(1)).to_pylist(), batch.column(2).to_pylist()):
            runs = runs_of(chunks or [], len(text), min_run)
            edges = [0, *[x for run in runs for x in run], len(text)]
            sizes.append(len(text))
            gone.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        arrays = [pa.array(x, pa.int64()) for x in (sizes, gone, spans)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(left, pa.binary())], names=schema.names)

    return arrow_map(joined, keep, schema, batch_bytes)
