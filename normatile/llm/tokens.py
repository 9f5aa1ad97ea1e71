"""Token counts by batch encoding.

Texts are cut at safe boundaries, the pieces of a batch are encoded together once each, and only
lengths leave the Arrow function.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from normatile.llm.common import binary, by_bytes, col, schema_after

#: A byte-level pre-tokenizer always starts a new word at a single space between two non-spaces, and
#: keeps that space with the word after it. No special token holds a space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Lengths:
    """Token counts of texts. ``known`` keeps lengths of pieces seen before, up to ``keep`` characters."""

    def __init__(self, path: str, keep: int = 16_000_000):
        self.known: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.keep, self.held = keep, 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.safe = False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.encode = lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.safe = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )

    def _learn(self, table: dict[str, int], pieces: set[str], space: str) -> None:
        new = [p for p in pieces if p not in table]
        if new:
            table.update(zip(new, self.encode([space + p for p in new])))
            self.held += sum(map(len, new))

    def of(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.encode(texts)
        if self.held > self.keep:
            self.known.clear()
            self.first.clear()
            self.held = 0
        cut = [SAFE.split(t) for t in texts]
        self._learn(self.first, {c[0] for c in cut}, "")
        later: set[str] = set()
        for c in cut:
            later.update(c[1:])
        self._learn(self.known, later, " ")
        first, known = self.first.__getitem__, self.known.__getitem__
        return [first(c[0]) + sum(map(known, c[1:])) for c in cut]


@functools.lru_cache(maxsize=2)
def _lengths(path: str) -> Lengths:
    return Lengths(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the library of ``tokenizer`` (a file that every executor has) counts them.

    No begin, end or other added token, no truncation, no padding; special strings inside a text are
    handled as the library does by default. A batch holds at most ``batch_bytes`` of text, or one
    row. Byte-level files (.json) are cut at spaces where a new word must start, so a long text is
    never one large encoding unless it has no such space; other files encode whole texts.

    A null text counts as empty: 0 bytes and the tokens of the empty text. Rows with equal ids are
    counted each for itself. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer)
        for piece in by_bytes(batches, 1, batch_bytes):
            raw = binary(piece.column(1))
            counts = lengths.of(raw.cast(pa.string()).to_pylist())
            sizes = pc.binary_length(raw).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, schema_after(rows, ["doc_id"], "n_bytes long, n_tokens long"))
