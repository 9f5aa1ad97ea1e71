"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of neighbouring lines chooses chunk boundaries, so an inserted line
moves only the boundaries next to it. Boundaries have two levels. At the coarse one, one line in
EVERY ends a chunk, and chunks follow one another. At the fine one, every line is a boundary and a
chunk reaches back over the WINDOW lines that the rolling hash sees there: no passage of that many
lines is too short to hold one, wherever it begins and ends. Chunks of several lines that occur
elsewhere before, by (id, first line), are removed once their text has been compared with the first
occurrence; a repeated passage goes as the union of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normatile.llm.common import col, stored, whole_row

EVERY = 3  # one line in so many ends a chunk, on average
MOST = 32  # lines of a chunk at most
WINDOW = 2  # lines that the rolling hash sees


def _line_hash(line: Column) -> Column:
    """56 bits of MD5: room for the shifts of the rolling hash, and every SQL engine has it."""
    return F.conv(F.substring(F.md5(F.encode(line, "UTF-8")), 1, 14), 16, 10).cast("long")


def _plus(bits: int):
    return lambda a, b: a.bitwiseXOR(F.shiftleft(b, bits))


def _text_of(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start + 1), "\n")


def with_chunks(docs: DataFrame, text: str, every: int = EVERY, most: int = MOST) -> DataFrame:
    """Adds ``_lines`` and ``_chunks``: first and last line (from 0) of each chunk of the coarse level."""
    df = docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", _line_hash))
    rolled = F.col("_hashes")
    for back in range(1, WINDOW):  # cyclic sum: the hash of k lines before, shifted k bits
        earlier = F.concat(F.array_repeat(F.lit(0).cast("long"), back), "_hashes")
        rolled = F.zip_with(rolled, F.slice(earlier, 1, F.size("_hashes")), _plus(back))
    ends = F.transform(rolled, lambda r: r % every == 0)
    df = df.withColumn("_ends", ends).withColumn("_last", F.size("_lines") - 1)
    # Of neighbouring candidates only the first ends a chunk, so chunks have two lines or more.
    before = F.concat(F.array(F.lit(False)), "_ends")
    here = F.zip_with("_ends", F.slice(before, 1, F.size("_ends")), lambda a, b: a & ~b)
    numbered = F.zip_with(here, F.sequence(F.lit(0), F.col("_last")), lambda cut, i: F.when(cut, i))
    cuts = F.filter(numbered, lambda i: i.isNotNull() & (i < F.col("_last")))
    df = df.withColumn("_cuts", F.concat(cuts, F.array("_last")))
    starts = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c + 1))
    pieces = F.zip_with(F.slice(starts, 1, F.size("_cuts")), "_cuts", lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    short = F.transform(
        pieces,
        lambda p: F.transform(
            F.sequence(F.lit(0), F.floor((p["e"] - p["s"]) / most).cast("int")),
            lambda k: F.struct((p["s"] + k * most).alias("s"), F.least(p["e"], p["s"] + k * most + (most - 1)).alias("e")),
        ),
    )
    return df.withColumn("_chunks", F.flatten(short)).drop("_hashes", "_ends", "_last", "_cuts")


def _fine(lines: Column) -> Column:
    """The chunks of the fine level: every line with the WINDOW - 1 lines before it."""
    ends = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(WINDOW - 1), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda e: F.struct((e - (WINDOW - 1)).alias("s"), e.alias("e")))


def _with_text(chunks: Column, lines: Column, *more: str) -> Column:
    """The chunks with their texts, made before rows are multiplied: no row carries its whole document along."""
    return F.transform(chunks, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), *[c[m].alias(m) for m in more], _text_of(lines, c["s"], c["e"]).alias("t")))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_chars: int) -> DataFrame:
    """``id, version, gone``: for each document the lines (from 0) in chunks that occur earlier, texts compared.

    ``version`` hashes the text: rows that repeat an id with another text are documents of their own.
    """
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("_text"), F.xxhash64(col(text_col)).alias("version")).where("id is not null")
    coarse = F.filter("_chunks", lambda c: c["e"] - c["s"] >= WINDOW)  # shorter ones are chunks of the fine level
    chunked = with_chunks(texts, "_text").withColumn("_all", F.concat(_fine(F.col("_lines")), coarse))
    hashed = F.transform(
        _with_text(F.col("_all"), F.col("_lines")),
        lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.xxhash64(c["t"]).alias("h"), F.length(c["t"]).alias("n")),
    )
    long = F.filter(hashed, lambda c: (c["n"] >= min_chars) & (c["e"] - c["s"] + 1 >= min_lines))
    # explode_outer: explode would have the chunks computed a second time as a filter.
    rows = chunked.select("id", "version", F.explode_outer(long).alias("c")).where("c is not null")
    narrow = stored(rows.select("id", "version", "c.s", "c.e", "c.h"), "line-chunks")
    first = narrow.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "version", "s")).alias("f")).where("n > 1").drop("n")
    # Both sides are stored tables, occurrences on the left: a hot chunk is split over tasks, its one row on the right is copied.
    first = stored(first, "line-first")
    marked = narrow.join(first, "h").select("id", "version", "s", "e", "h", (F.struct("id", "version", "s") == F.col("f")).alias("first"))
    lists = marked.groupBy("id", "version").agg(F.collect_set(F.struct("s", "e", "h", "first")).alias("c"))
    one = texts.join(lists, ["id", "version"]).dropDuplicates(["id", "version"])
    found = one.select("id", "version", F.explode(_with_text(F.col("c"), _lines_of(F.col("_text")), "h", "first")).alias("c"))
    found = stored(found.select("id", "version", "c.*"), "line-texts")
    kept = stored(found.where("first").select(F.col("h").alias("_h"), F.col("t").alias("_first")), "line-originals")
    same = found.where("not first").join(kept, (F.col("h") == F.col("_h")) & (F.col("t") == F.col("_first")))
    chunks = same.groupBy("id", "version").agg(F.collect_set(F.struct("s", "e")).alias("c"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda c: F.sequence(c["s"], c["e"])))))
    return stored(chunks.select("id", "version", gone.alias("gone")), "line-removed")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_chars: int = 32
) -> DataFrame:
    """``row, n_lines, n_removed_lines, n_removed_runs, text`` of every row: ``row`` holds all its columns, ``text`` what is left.

    A line is removed if it lies in a chunk of at least ``min_lines`` lines and ``min_chars`` characters whose
    text is a chunk of a smaller id too, or stands earlier in the same document; so every run of two lines
    (with that many characters) that stands earlier goes, and a single repeated line stays. Lines left are
    joined by newlines again; nothing left gives the empty text.

    A null text is one empty line and stays null. Rows with a null id stay as they are. Rows that repeat an
    id and text count as one document: they get the same lines removed, and none because of each other;
    with another text they are documents of their own. An empty table gives an empty result. Memory: the
    longest document in a task, its chunks, and their texts.
    """
    removed = repeated_lines(docs, id_col, text_col, min_lines, min_chars)
    packed = docs.select(whole_row(docs).alias("row"), col(id_col).alias("_id"), F.xxhash64(col(text_col)).alias("_version"))
    # Merged at every size: the table of lines is as large as the corpus has repeats.
    removed = removed.select(F.col("id").alias("_key"), F.col("version").alias("_of"), "gone").hint("merge")
    joined = packed.join(removed, (F.col("_id") == F.col("_key")) & (F.col("_version") == F.col("_of")), "left")
    joined = joined.withColumn("_text", F.col("row").getField(text_col))
    joined = joined.select("row", "_text", _lines_of(F.col("_text")).alias("_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("_gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    runs = F.size("_gone") - F.size(F.array_intersect("_gone", F.transform("_gone", lambda i: i + 1)))
    return joined.select(
        "row",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed_lines"),
        runs.cast("long").alias("n_removed_runs"),
        F.when(F.col("_text").isNull(), F.lit(None)).when(F.size("_gone") == 0, F.col("_text")).otherwise(kept).alias("text"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """``docs`` with the text column cut, all columns and rows kept; ``chars_col`` is counted anew where it changes."""
    done = dedup_lines(docs, id_col, text_col, **options)
    out = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.col("text")
        elif c == chars_col:
            value = F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return done.select(*out)
