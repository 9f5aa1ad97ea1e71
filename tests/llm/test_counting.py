"""Token counts, mixing, chat formatting and quality rules against plain Python."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, by_id, docs, prose

from normatile.llm import chat, mixing, quality, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_whole_encodings(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = awkward(rng) + [(50, "a <|endoftext|> b<|endoftext|>"), (51, "x  y \n z  w 's it's  12 345, --- \t"), (52, "\x1c \x1d a \u0085 b ​ c")]
    texts += [(100 + i, "".join(rng.choice(" ab1.'\n\t é_s") for _ in range(200))) for i in range(60)]
    model = Tokenizer.from_file(FILE)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False))) for i, t in texts), key=repr)
    got = tokens.count_tokens(docs(spark, texts), FILE, batch_bytes=3000)
    assert by_id(got, "doc_id", "n_bytes", "n_tokens") == want
    assert tokens.count_tokens(docs(spark, []), FILE).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    lengths = tokens.Lengths(public_tokenizers.path(name))
    assert not lengths.safe and lengths.of(["", "a b  c"])[1] > 0


def test_shares_stop_at_the_cap_and_go_round():
    assert mixing.share_out([10, 10, 10], [1, 2, 3], 30, 3) == [5, 10, 15]
    got = mixing.share_out([1, 100, 100], [3, 1, 1], 201, 3)
    assert got == [3.0, 99.0, 99.0]
    assert mixing.share_out([0, 10], [5, 1], 10, 3) == [0.0, 10.0]


def test_sources_are_shared_out_in_spark_as_in_a_list(spark):
    """Three thousand sources, many capped in several rounds."""
    rng = random.Random(12)
    words = {f"s{k:05d}": rng.choice([0, 1, 3, 40, 400]) for k in range(3000)} | {None: 50}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = {r.source: r for r in mixing.rated_sources(sized, (1, 2, 3), 1.0, 1.2).collect()}
    names = sorted(words, key=lambda s: (s is None, s or ""))
    want = mixing.share_out([words[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], sum(words.values()), 1.2)
    assert [got[s].sid for s in names] == list(range(len(names)))
    assert [got[s].target for s in names] == pytest.approx(want)
    taken = mixing.mix(df, most=1.2).agg(F.sum("taken")).first()[0]
    assert abs(taken - sum(want)) < 0.2 * sum(want)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    pi, size = np.full(500, 0.3), rng.integers(0, 2000, 500)
    out = mixing.flight(pi, size, rng, False)
    assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1 and abs((out * size).sum() - (pi * size).sum()) < 1e-3
    landed = mixing.flight(pi, size, rng, True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (pi * size).sum()) < 400


def test_inclusion_chances_are_kept():
    rng, hits = np.random.default_rng(5), np.zeros(6)
    pi, size = np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.6]), np.array([5, 9, 1, 4, 4, 7])
    for _ in range(3000):
        hits += mixing.flight(pi, size, rng, True)
    assert np.abs(hits / 3000 - pi).max() < 0.05


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    texts = [(i, prose(rng, rng.randint(0, 80))) for i in range(3000)] + [(9000, None), (9001, ""), (7, prose(rng, 50)), (None, "a b c")]
    df = docs(spark, texts, sources=("b", "a", None, "a"))
    first = mixing.mix(df)
    rows = first.collect()
    assert len(rows) == len(texts)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in rows) == sorted(size(t) for _, t in texts)
    totals = {s: sum(r["size"] for r in rows if r.source == s) for s in ("a", "b", None)}
    target = {r.source: r.target for r in rows}
    want = mixing.share_out([totals["a"], totals["b"], totals[None]], [1, 2, 3], sum(totals.values()), 3)
    assert [target["a"], target["b"], target[None]] == pytest.approx(want)
    for s in totals:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 100
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rows)
    again = mixing.mix(df.repartition(7))
    assert by_id(first, "doc_id", "source", "taken") == by_id(again, "doc_id", "source", "taken")
    taken = mixing.mixed(df)
    assert taken.columns == df.columns + ["mix_copies", "mix_taken"]
    assert taken.agg({"mix_taken": "sum"}).first()[0] == sum(r.taken for r in rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_escapes_round_trip():
    rng = random.Random(4)
    parts = [*chat.CONTROL, "\\", "<", "[", "l", "s", "b", "n", "\n", "text", "|im_start|>", "/s>", "é"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
        turns = [{"role": rng.choice(["user", "assistant", "a\nb" + text]), "text": text} for _ in range(3)]
        out, spans = chat.render(turns)
        said, masked = chat.read_back(out, spans)
        assert said == [(t["role"], t["text"]) for t in turns]
        assert masked == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_layouts_are_found_by_their_fields(spark):
    records = [
        (1, '{"prompt": "p", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")]),
        (2, '{"output": "o", "instruction": "i"}', "instruction", [("user", "i"), ("assistant", "o")]),
        (3, '{"messages": [{"role": "user", "content": "x"}, {"content": null, "role": "assistant"}]}', "messages", [("user", "x"), ("assistant", "")]),
        (4, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', "shared", [("user", "h"), ("assistant", "g")]),
        (5, '{"something": 1}', None, None), (6, "not json", None, None), (7, None, None, None),
        (8, '{"system": null, "instruction": "i", "output": "o"}', "system_instruction", [("user", "i"), ("assistant", "o")]),
    ]
    df = spark.createDataFrame([(i, r, "extra") for i, r, _, _ in records], "id int, record string, turns string")
    rows = {r.id: r for r in chat.canonical_turns(df, "id", "record").collect()}
    for i, _, layout, turns in records:
        assert rows[i].layout == layout
        assert (rows[i].turns and [(t.role, t.text) for t in rows[i].turns]) == turns
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert out[1].n_turns == 2 and out[1].loss_chars == 1 and out[5].n_turns == 0 and len(out) == 8


def test_turns_beyond_the_limits_of_variants_stay(spark):
    from pyspark.sql import functions as F

    kinds = spark.createDataFrame([(1, ["user", "assistant"]), (2, ["user"]), (3, ["x", "assistant"]), (4, ["system", "user", "assistant"])], "id long, roles array<string>")
    turns = kinds.select("id", F.posexplode("roles").alias("turn", "role"))
    long = F.when((F.col("turn") == 0) & (F.col("id") < 4), F.repeat(F.lit("é"), 20_000_001)).otherwise(F.lit('short "</s>"'))
    records = chat.records_of_turns(turns.select("id", "turn", "role", long.alias("text")), "id", "turn", "role", "text")
    read = chat.canonical_turns(records, "id", "record").select("id", "layout", F.transform("turns", lambda t: F.struct(t["role"], F.length(t["text"]))).alias("t"))
    assert {r.id: (r.layout, [tuple(t) for t in r.t]) for r in read.collect()} == {
        1: ("response", [("user", 20_000_001), ("assistant", 12)]),
        2: ("shared", [("user", 20_000_001)]),
        3: ("messages", [("x", 20_000_001), ("assistant", 12)]),
        4: ("system_instruction", [("system", 12), ("user", 12), ("assistant", 12)]),
    }
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(records)).collect()}
    assert [out[i].n_turns for i in (1, 2, 3, 4)] == [2, 1, 2, 3] and out[1].loss_chars == 12


def test_sketches_have_the_same_fingerprint_and_turns(spark):
    from pyspark.sql import functions as F

    records = [
        '{"prompt": "p", "response": "c"}', '{"messages": [{"role": "user", "content": "x"}, null, {"content": null, "role": "assistant"}, {"role": true, "content": 12}]}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": null}]}', '{"system": null, "output": "o", "instruction": "i"}',
        '{"a b": [1, 2.50, "x", {"c": [1e3]}], "e": [], "f": [[1], [2, 3]], "g": [{"x": 1}, {"y": "z"}]}', '"text"', "[1, 100000000000000000000]", "not json", '{"a": 1, "a": 2}', "NaN", None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    rows = df.select("id", chat.field_paths(F.try_parse_json("record")).alias("a"), chat.field_paths(F.try_parse_json(chat._sketched("record"))).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a is None for r in rows) == 4
    by_name = {layout.name: layout for layout in chat.LAYOUTS}
    for r in chat.canonical_turns(df, "id", "record").where("layout is not null").collect():
        assert chat._plain_turns(chat._parsed(records[r.id]), by_name[r.layout]) == [t.asDict() for t in r.turns]


def test_turn_rows_with_nulls_and_ties(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "q"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.canonical_turns(chat.records_of_turns(df, "conv_id", "turn", "role", "text"), "id", "record")
    got = {r.id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: [("user", "a"), ("user", "a"), ("user", "b")], None: [("", "x")]}
    assert chat.records_of_turns(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def plain_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            again |= {i + k for i in places for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_symbols = sum(t.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), len(again), failed


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = awkward(rng) + [(100 + i, "".join(rng.choice("ab \n\t#|\x0b\u0085é") for _ in range(300))) for i in range(40)]
    got = quality.judge(docs(spark, texts), [])
    want = sorted(((i, *plain_counts(t)) for i, t in texts), key=repr)
    assert by_id(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(r.kept != r.base_failed for r in got.collect())


def test_rules_learn_what_is_bad_and_spare_the_rest(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(400):
        text = prose(rng, 80)
        bad = i % 5 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split()) if i % 2 else text.upper()
        texts.append((i, text))
        labels.append((i, int(not bad), 0))
    labels += [(3, 0, 0), (None, 0, 0), (7777, 0, 1), (5, None, 0)]
    df = docs(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.learn_rules(df, marks)
    assert rules and all(str(c) for r in rules for c in r)
    kept = {r.doc_id: r.kept for r in quality.judge(df, rules).collect()}
    wrong = [i for i, _ in texts if kept[i] == (i % 5 == 0)]
    assert len(wrong) <= 2
    out = quality.accepted(df, rules)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i in kept if kept[i]}
    assert quality.learn_rules(df, marks.limit(0)) == []
    assert quality.judge(df.limit(0), rules).count() == 0
    assert math.isclose(len(texts), len(kept))
