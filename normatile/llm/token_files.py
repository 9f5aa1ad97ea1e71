"""Token ids as files: one wavelet matrix per shard, in ascending document order.

Texts are encoded once and stored, dealt by ranges of ids, and each task cuts its range into shards of
bounded size. A shard is one Parquet file of one row: its documents, their lengths, and the wavelet
matrix of their ids, so any store that Spark reaches will do, and a lost executor's files are never
half there. Footers hold the smallest and largest id, so a reader opens only the shards it needs.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.llm.common import binary, by_bytes, col, schema_after, stored
from normatile.llm.wavelet import WaveletMatrix, build
from normatile.session import new_folder

# Fixed value: a pre-tokenizer pattern whose matches hold no white space, so that words can be encoded one by one.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# ASCII marks but the apostrophe: before or behind letters, a run of them is a pre-token of its own under WORDS_ONLY.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that are in normal form, as their lower case is: words of these alone are prepared as a column.
LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(192, 256)) if c not in (215, 247))
ONLY_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


_shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
#: Byte-level models write a byte as a printable letter: itself if it is one, else the next after 255.
BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _shown)}
LINES = {b: c for b, c in BYTES.items() if b != 10}


def _listed(strings: pa.Array) -> list[str]:
    """Strings that hold no newline as a list, by one join and one cut."""
    if not len(strings):
        return []
    ends = pa.array([0, len(strings)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, strings), "\n")[0].as_py().split("\n")


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` named by ``slots``, one after another, and where each stops."""
    sizes = size[slots]
    stops = np.cumsum(sizes)
    return flat[np.repeat(start[slots] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)], stops


class Encoder:
    """Token ids of texts. Words seen before, up to ``keep`` characters, are looked up, not encoded again."""

    def __init__(self, path: str, end_id: int | None, keep: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = [*self.model.get_vocab(with_added_tokens=True).values(), end_id or 0]
        self.dtype = np.dtype("<u2" if max(ids) < 1 << 16 else "<u4")
        self.end, self.keep = end_id, keep
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = spec.get("normalizer") or {}
        plain = all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": r"\s+"} for n in normal.get("normalizers", [normal] if normal else []))
        self.lower = any(n["type"] == "Lowercase" for n in normal.get("normalizers", []))
        self.by_word = (
            plain
            and before[0].get("type") == "Split"
            and before[0].get("pattern") == {"Regex": WORDS_ONLY}
            and before[0].get("behavior") == "Removed"
            and bool(before[0].get("invert"))
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.split_id = spec["added_tokens"][-1]["id"] if self.added else -1
        self.special = re.compile("|".join(map(re.escape, self.added))).search if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.start, self.size = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)
        self._add([""], [[]])
        self._add(["\n"], [[] if self.end is None else [self.end]])  # no word holds a newline: the end's place

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(sizes.sum()))])
        self.held += sum(map(len, words))

    def _stored(self, word: str) -> list[int]:
        k = self.known[word]
        return self.flat[self.start[k] : self.start[k] + self.size[k]].tolist()

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Letters in normal form are one pre-token, so the model alone is asked.

        Of the others many go in one call, with a special token between two to keep them apart.
        """
        tokenize, special, out = self.model.model.tokenize, self.special, {}
        rest, alone = [], []
        for w in words:
            if w.isalpha() and w.isascii() and (not self.lower or w.islower()):
                out[w] = [t.id for t in tokenize(w)]
            elif w.isalpha() and not w.isascii() and unicodedata.is_normalized("NFC", w) and (not self.lower or "".join(map(str.lower, w)) == w):
                out[w] = [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTES))]
            elif special is None or special(w):
                alone.append(w)
            else:
                rest.append(w)
        out.update(zip(alone, [x.ids for x in self.model.encode_batch(alone, add_special_tokens=False)]))
        groups = [rest[i : i + 5000] for i in range(0, len(rest), 5000)]
        for group, x in zip(groups, self.model.encode_batch([self.added[-1].join(g) for g in groups], add_special_tokens=False)):
            ids = x.ids
            cuts = [-1, *np.flatnonzero(np.array(ids) == self.split_id).tolist(), len(ids)]
            if len(cuts) != len(group) + 1:
                raise ValueError("the tokenizer lost a special token")
            out.update((w, ids[i + 1 : k]) for w, i, k in zip(group, cuts, cuts[1:]))
        return [out[w] for w in words]

    def _letters(self, words: list[str]) -> None:
        """Add new words of plain letters. Each is one pre-token, so the model alone is asked."""
        tokenize = self.model.model.tokenize
        coded = "\n".join(words).encode().decode("latin-1").translate(LINES).split("\n")
        self._add(words, [[t.id for t in tokenize(w)] for w in coded])

    def _learn(self, words: list[str]) -> None:
        """Add new words; marks around a word are encoded by themselves, and words in their normal form."""
        known, normal, hint = self.known, self._normal, os.path.commonprefix(self.added)
        split = []
        for w in words:
            low = w.lower()  # a special token in capitals is none, and must not become one
            if self.special is not None and (hint in w or hint in low) and (self.special(w) or self.special(low)):
                split.append(("", w, ""))
                continue
            core = w.strip(MARKS)
            if core == w:
                split.append(("", normal(w), ""))
            elif core and core[0].lower().isalpha() and core[-1].lower().isalpha():
                start = w.index(core[0])
                split.append((w[:start], normal(core), w[start + len(core) :]))
            else:
                split.append(("", w, ""))
        fresh = [p for p in dict.fromkeys(itertools.chain.from_iterable(split)) if p not in known]
        ids = dict(zip(fresh, self._ids(fresh)))
        more = [(w, parts) for w, parts in zip(words, split) if w not in ids and w not in known]
        for part in {p for _, parts in more for p in parts if p not in ids}:
            ids[part] = self._stored(part)
        self._add(fresh + [w for w, _ in more], [ids[f] for f in fresh] + [ids[a] + ids[b] + ids[c] for _, (a, b, c) in more])

    def _normal(self, word: str) -> str:
        """The word as the normalizer leaves it if that is sure to be the same for the model; else the word itself."""
        if not self.lower or word.islower() and word.isascii():
            return word
        if word.isascii():
            return word.lower()
        low = "".join(map(str.lower, word))  # letter by letter, as the normalizer does
        return low if low.isalpha() and unicodedata.is_normalized("NFC", word) else word

    def _slots(self, words: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        """The place of each word among the known ones; ``learn`` adds those that are new."""
        coded = words.dictionary_encode()
        distinct = _listed(coded.dictionary)
        found = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [distinct[k] for k in new.tolist()]
            gc.disable()  # many small lists and no cycles: the collector would walk all known words again and again
            try:
                learn(fresh)
            finally:
                gc.enable()
            found[new] = [self.known[w] for w in fresh]
        return found[coded.indices.to_numpy()]

    def _parts(self, words: pa.Array) -> np.ndarray:
        """Three known words for each word, empty ones among them: words of plain letters lose their capitals and the marks around them."""
        cores = pc.ascii_trim(words, MARKS)
        plain = pc.match_substring_regex(cores, ONLY_LETTERS)
        if self.added:
            plain = pc.and_not(plain, pc.match_substring(words, os.path.commonprefix(self.added)))
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(cores), pc.binary_length(words)))
        letters, around, others = cores.filter(plain), words.filter(marked), pc.invert(plain)
        out = np.zeros((len(words), 3), np.int64)  # 0: the empty word
        for where, part, strings, learn in (
            (plain, 1, pc.utf8_lower(letters) if self.lower else letters, self._letters),
            (marked, 0, pc.utf8_rtrim(pc.ascii_rtrim(around, MARKS), LETTERS), self._learn),
            (marked, 2, pc.utf8_ltrim(pc.ascii_ltrim(around, MARKS), LETTERS), self._learn),
            (others, 1, words.filter(others), self._learn),
        ):
            out[where.to_numpy(zero_copy_only=False), part] = self._slots(strings, learn)
        return out.ravel()

    def of(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as little-endian bytes, the end id behind them."""
        if not self.by_word:
            end = [] if self.end is None else [self.end]
            found = self.model.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return pa.array([np.array([*x.ids, *end], self.dtype).tobytes() for x in found], pa.binary())
        if self.held > self.keep:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        parts = np.append(self._parts(words.dictionary), self.known["\n"])
        flat, stops = _taken(self.flat, self.start, self.size, parts)
        stops = np.append(stops[2:-1:3], len(flat))  # of each distinct word, and of the end
        start = np.concatenate([[0], stops[:-1]])
        ends = np.cumsum(lists.value_lengths().to_numpy())
        slots = np.insert(words.indices.to_numpy(), ends, len(words.dictionary))
        ids, stops = _taken(flat, start, stops - start, slots)
        bounds = np.concatenate([[0], stops[ends + np.arange(len(ends))]]) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.array(bounds.astype(np.int32)).buffers()[1], pa.py_buffer(ids)])


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int | None, batch_bytes: int) -> DataFrame:
    """``id, n, width, ids, turn``: number of ids, bytes of one, the ids as bytes, and a number that parts equal rows."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = _encoder(tokenizer, end_id), 0
        width = encoder.dtype.itemsize
        for piece in by_bytes(batches, 1, batch_bytes):
            ids = encoder.of(binary(piece.column(1)).cast(pa.string()))
            rows_ = len(ids)
            arrays = [
                pc.divide(pc.binary_length(ids).cast(pa.int64()), width),
                pa.array(np.full(rows_, width, np.int32)),
                ids,
                pa.array(np.arange(turn, turn + rows_, dtype=np.int64)),
            ]
            turn += rows_
            yield pa.RecordBatch.from_arrays([piece.column(0), *arrays], names=["id", "n", "width", "ids", "turn"])

    return rows.mapInArrow(run, schema_after(rows, ["id"], "n long, width int, ids binary, turn long"))


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
    shard_tokens: int = 8 << 20,
    parts: int | None = None,
    batch_bytes: int = 4 << 20,
) -> str:
    """Write the token ids of all documents, ascending by id, as shard files below ``path`` (a new shared folder); gives the path.

    Every text is encoded whole by the ``tokenizers`` file (which every executor has), without added
    special tokens, and ``end_id`` follows it unless None. A null text is empty. A null id is a
    document before all others. Rows that repeat an id are documents of their own, one after another
    by length, ids and place. An empty table gives an empty folder of files. Other columns are not
    read. A shard holds ``shard_tokens`` ids or up to one document more; ``parts`` range partitions
    are written side by side (by default the session's shuffle partitions). Memory of a task: one shard
    and one Arrow batch; a single document must stay under 2 GB of ids.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "token-files")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stored: the sampling of the ranges would encode everything a second time.
    encoded = stored(encode_texts(docs, tokenizer, id_col, text_col, end_id, batch_bytes), "token-ids")
    order = ["id", "n", "hash", "turn"]
    rows = encoded.withColumn("hash", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("id", "width", "ids")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType.fromDDL("part int, before long, n_tokens long")
    schema = schema.add("first_id", id_type).add("last_id", id_type).add("ids", T.ArrayType(id_type))
    schema = schema.add("lengths", T.ArrayType(T.LongType())).add("matrix", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        pieces: list[bytes] = []
        lengths: list[int] = []
        total = 0

        def shard(kind: np.dtype) -> pa.RecordBatch:
            listed = pa.concat_arrays(names)
            ends = pa.array([0, len(listed)], pa.int32())
            arrays = [
                pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()),
                listed.slice(0, 1), listed.slice(len(listed) - 1, 1),
                pa.ListArray.from_arrays(ends, listed), pa.ListArray.from_arrays(ends, pa.array(lengths, pa.int64())),
                pa.array([build(np.frombuffer(b"".join(pieces), kind))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind = np.dtype("<u2")
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = np.dtype(f"<u{batch.column(1)[0].as_py()}")
            start = 0
            for k in range(batch.num_rows):
                ids = batch.column(2)[k].as_py()
                pieces.append(ids)
                lengths.append(len(ids) // kind.itemsize)
                total += lengths[-1]
                if total >= shard_tokens:
                    names.append(batch.column(0).slice(start, k + 1 - start))
                    yield shard(kind)
                    before += total
                    start, total = k + 1, 0
                    names.clear()
                    pieces.clear()
                    lengths.clear()
            if start < batch.num_rows:
                names.append(batch.column(0).slice(start))
        if lengths:
            yield shard(kind)

    rows.mapInArrow(run, schema).write.option("maxRecordsPerFile", 1).parquet(path)
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard files as rows: ``part, before, n_tokens, first_id, last_id, ids, lengths, matrix``."""
    return spark.read.parquet(path)


def _bases(files: DataFrame) -> dict[int, int]:
    """Ids before each range partition; at most one row per write task comes to the driver."""
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    out, total = {}, 0
    for part in sorted(sums):
        out[part] = total
        total += sums[part]
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files: ``start`` counts all ids before it,
    ``ids`` are its ids as little-endian unsigned 32-bit integers."""
    files = shards(spark, path)
    bases = _bases(files)
    rows = files.select("part", "before", "ids", "lengths", "matrix")
    schema = T.StructType([T.StructField("doc_id", files.schema["first_id"].dataType)])
    schema = T.StructType(schema.fields + T.StructType.fromDDL("start long, n_tokens long, ids binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = batch.column(3)[k].values.to_numpy()
                tokens = WaveletMatrix(batch.column(4)[k].as_py()).tokens().astype("<u4")
                ends = np.cumsum(lengths)
                start = bases[batch.column(0)[k].as_py()] + batch.column(1)[k].as_py()
                offsets = pa.array(np.concatenate([[0], ends * 4]), pa.int64()).cast(pa.int32())
                ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets.buffers()[1], pa.py_buffer(tokens)])
                arrays = [batch.column(2)[k].values, pa.array(start + ends - lengths), pa.array(lengths), ids]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def find_token(files: DataFrame, token: int) -> DataFrame:
    """``doc_id, place`` of every occurrence of ``token`` in the shards ``files``, by select on the planes; place counts from 0."""
    schema = T.StructType([T.StructField("doc_id", files.schema["first_id"].dataType), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = WaveletMatrix(batch.column(2)[k].as_py()).places(token)
                ends = np.cumsum(batch.column(1)[k].values.to_numpy())
                which = np.searchsorted(ends, at, side="right")
                place = at - np.where(which > 0, ends[which - 1], 0) if len(at) else at
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values.take(pa.array(which)), pa.array(place, pa.int64())], names=schema.names)

    return files.select("ids", "lengths", "matrix").mapInArrow(run, schema)


def count_token(files: DataFrame, token: int) -> DataFrame:
    """``doc_id, n`` for every document that holds ``token``, by rank at the document's ends."""
    schema = T.StructType([T.StructField("doc_id", files.schema["first_id"].dataType), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column(2)[k].as_py())
                if not matrix.count(token):
                    continue
                ends = np.cumsum(batch.column(1)[k].values.to_numpy()).tolist()
                counts = np.array([matrix.count(token, a, b) for a, b in zip([0, *ends], ends)])
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values.take(pa.array(some)), pa.array(counts[some], pa.int64())], names=schema.names)

    return files.select("ids", "lengths", "matrix").mapInArrow(run, schema)
