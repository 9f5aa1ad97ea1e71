"""Chat formatting: records of different layouts become canonical turns, then one marked text with a loss mask.

The nested field paths of a record, hashed, are its fingerprint; the fingerprint selects a
declarative mapping. A record with an unknown fingerprint is kept and reported, never guessed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normatile.llm.common import col, schema_after

TURNS = "array<struct<role:string,text:string>>"
#: Control strings of the template below and of other common ones: none may survive inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]")
START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL) + r"|\\")
_ESCAPES = {"\\": "\\b", "<": "\\l", "[": "\\s", "\n": "\\n"}
_BACK = re.compile(r"\\([blsn])")
_CODES = {code[1]: char for char, code in _ESCAPES.items()}


@dataclass(frozen=True)
class Layout:
    """Field paths of a record and how they become turns.

    ``parts``: (role, path) in order, absent or null fields left out; or ``each``: path of a list whose
    elements hold the role under ``role`` and the text under ``text``. ``roles`` renames roles.
    """

    name: str
    shape: str
    parts: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("prompt", "OBJECT<completion, prompt>", parts=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("response", "OBJECT<prompt, response>", parts=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("instruction", "OBJECT<instruction, output>", parts=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout(
        "system_instruction",
        "OBJECT<instruction, output, system>",
        parts=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output")),
    ),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", each="$.messages", role="role", text="content"),
    Layout("shared", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", each="$.conversations", role="from", text="value", roles=NAMES),
)


def field_paths(record: Column) -> Column:
    """The nested field names of a variant, without the types of single values."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.parts:
        every = [F.struct(F.lit(role).alias("role"), F.variant_get(record, path, "string").alias("text")) for role, path in layout.parts]
        return F.filter(F.array(*every), lambda t: t["text"].isNotNull())
    listed = F.variant_get(record, layout.each, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")

    def turn(m: Column) -> Column:
        role = F.coalesce(m[layout.role], F.lit(""))
        for old, new in layout.roles:
            role = F.when(m[layout.role] == old, new).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text"))

    return F.transform(listed, turn)


class _Number(str):
    """A number of a record as it is written."""


def _object(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a field comes twice")
    return dict(pairs)


def _no_number(text: str):
    raise ValueError(f"{text} is no JSON")


def _parsed(record: str):
    """The value of a JSON text of any size; ValueError where it is none (Spark refuses the same ones)."""
    return json.loads(record, parse_int=_Number, parse_float=_Number, parse_constant=_no_number, object_pairs_hook=_object)


def _sketch(value) -> str:
    """JSON of the same nested types, but small: strings are empty, a list has each kind of element once."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_sketch(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(dict.fromkeys(map(_sketch, value))) + "]"
    return value if isinstance(value, _Number) else json.dumps("" if isinstance(value, str) else value)


def _at(value, path: str):
    for name, quoted, place in re.findall(r"""\.([^.\[]+)|\[['"]([^'"]*)['"]\]|\[(\d+)\]""", path):
        if place:
            value = value[int(place)] if isinstance(value, list) and int(place) < len(value) else None
        else:
            value = value.get(name or quoted) if isinstance(value, dict) else None
    return value


def _said(value) -> str | None:
    if value is None or isinstance(value, str) and (not isinstance(value, _Number) or value.lstrip("-").isdigit()):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    raise ValueError("a record beyond the limits of variants has a value that is no text, truth value or whole number as a role or text")


def _plain_turns(value, layout: Layout) -> list[dict] | None:
    """What ``_turns`` gives, from a parsed record."""
    if layout.parts:
        every = [{"role": role, "text": _said(_at(value, path))} for role, path in layout.parts]
        return [t for t in every if t["text"] is not None]
    listed = _at(value, layout.each)
    if listed is None:
        return None
    pairs = [(_said(m.get(layout.role)), _said(m.get(layout.text))) for m in (m or {} for m in listed)]
    return [{"role": dict(layout.roles).get(role, role) or "", "text": text or ""} for role, text in pairs]


@F.arrow_udf(T.StringType())
def _sketched(records: pa.Array) -> pa.Array:
    def one(record: str | None) -> str | None:
        try:
            return None if record is None else _sketch(_parsed(record))
        except (ValueError, RecursionError):
            return None

    return pa.array([one(r.as_py()) for r in records], pa.string())


def _large_turns(layouts: tuple[Layout, ...]):
    by_name = {layout.name: layout for layout in layouts}
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    @F.arrow_udf(T.ArrayType(T.StructType().add("role", "string").add("text", "string")))
    def read(records: pa.Array, names: pa.Array) -> pa.Array:
        every = ((r.as_py(), n.as_py()) for r, n in zip(records, names))
        return pa.array([None if r is None or n is None else _plain_turns(_parsed(r), by_name[n]) for r, n in every], kind)

    return read


def canonical_turns(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``id, fingerprint, layout, turns`` of every JSON record (a string column).

    A record that is null, no JSON or of an unknown layout has null ``layout`` and ``turns``. A record
    beyond the limits of variants (strings of 20 million characters, 128 MiB in all) is read in Python:
    a sketch of it, with the same types but without its texts, gives the fingerprint.
    """
    rows = records.select(col(id_col).alias("id"), col(record_col).alias("_record"), F.try_parse_json(col(record_col)).alias("_v"))
    rows = rows.withColumn("_rest", F.when(F.col("_v").isNull(), F.col("_record"))).drop("_record")
    # Records that Spark has read are null in _rest: nothing of them goes to Python.
    rows = rows.withColumn("fingerprint", fingerprint(F.coalesce("_v", F.try_parse_json(_sketched("_rest")))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        same = F.col("fingerprint") == F.xxhash64(F.lit(layout.shape))
        name = F.when(same, layout.name).otherwise(name)
        turns = F.when(same, _turns(F.col("_v"), layout)).otherwise(turns)
    rows = rows.select("id", "fingerprint", name.alias("layout"), turns.alias("turns"), "_rest")
    large = _large_turns(layouts)(F.col("_rest"), F.when(F.col("_rest").isNotNull(), F.col("layout")))
    return rows.select("id", "fingerprint", "layout", F.when(F.col("_rest").isNull(), F.col("turns")).otherwise(large).alias("turns"))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _CODES[m.group(1)], text)


def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code point spans under the loss mask: the assistants' texts."""
    pieces, spans, at = [], [], 0
    for turn in turns:
        role, text = turn["role"] or "", escape(turn["text"] or "")
        head = START + escape(role).replace("\n", _ESCAPES["\n"]) + "\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(text)))
        pieces += [head, text, END]
        at += len(head) + len(text) + len(END)
    return "".join(pieces), spans


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns and all text under the loss mask, from the formatted text."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(START) :].partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


def format_chats(records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``id, fingerprint, layout, formatted, loss`` of every record; ``loss`` lists (start, end) code points.

    Control strings inside roles and texts are escaped reversibly. Null roles and texts count as empty.
    A record without a known layout keeps its row with null ``formatted`` and ``loss``; a list of no
    turns gives the empty text. Repeated rows are formatted each for itself; an empty table gives an
    empty result; other columns are not read.
    """
    rows = canonical_turns(records, id_col, record_col, layouts)
    schema = schema_after(rows, ["id", "fingerprint", "layout"], "formatted string, loss array<struct<start:long,end:long>>")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None) if t is None else render(t) for t in batch.column(3).to_pylist()]
            loss = pa.array([None if s is None else [{"start": a, "end": b} for a, b in s] for _, s in done], spans_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in done], pa.string()), loss], names=schema.names)

    return rows.mapInArrow(run, schema)


def records_of_turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One JSON record per conversation from rows of turns, in the plainest layout that holds it.

    Rows go by turn, equal turns by role and text; a null turn comes first, null roles and texts are empty. Ids that are null
    are one conversation.
    """
    turn = F.struct(
        col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text")
    )
    talks = rows.groupBy(col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    talks = talks.select("id", "_t", F.transform("_t", lambda t: t["role"]).alias("_roles"))

    def text(k: int, name: str) -> Column:
        return F.get(F.col("_t"), F.lit(k))["text"].alias(name)

    def roles(*names: str) -> Column:
        return F.col("_roles") == F.array(*[F.lit(n) for n in names])

    plain = F.forall("_roles", lambda r: r.isin("user", "assistant"))
    shared = F.transform("_t", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    listed = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = (
        F.when(roles("user", "assistant"), F.to_json(F.struct(text(0, "prompt"), text(1, "response"))))
        .when(roles("system", "user", "assistant"), F.to_json(F.struct(text(0, "system"), text(1, "instruction"), text(2, "output"))))
        .when(plain, F.to_json(F.struct(shared.alias("conversations"))))
        .otherwise(F.to_json(F.struct(listed.alias("messages"))))
    )
    return talks.select("id", record.alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests read back from formatted texts (null ones count as no turns)."""
    rows = formatted.select("id", "formatted", "loss")
    schema = schema_after(
        rows.withColumnRenamed("id", "conv_id"),
        ["conv_id"],
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, masked = read_back(text or "", [(s["start"], s["end"]) for s in loss or ()])
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                row = (len(turns), _sha256(said), len(masked), _sha256(masked), len(text or ""))
                for values, value in zip(out, row):
                    values.append(value)
            arrays = [pa.array(v, f.type) for v, f in zip(out, _DIGEST_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


_DIGEST_TYPES = [pa.field(n, t) for n, t in zip("ntlsf", (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
