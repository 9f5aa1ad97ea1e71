"""Token files, centroid clustering and the filter audit against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, by_id, docs, prose

from normatile.llm import centroids, filter_audit, token_files
from normatile.llm.wavelet import WaveletMatrix, build

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 2), (66000, 49408), (140000, 70000)])
def test_wavelet_matrix_access_count_and_places(n, top):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), top - 1).astype(np.uint32)
    matrix = WaveletMatrix(build(ids))
    assert (matrix.tokens() == ids).all()
    for i in rng.integers(0, max(n, 1), min(n, 30)).tolist():
        assert matrix.access(i) == ids[i]
    for token in (0, 1, 2, top - 1, 1 << 20):
        assert matrix.count(token) == (ids == token).sum()
        assert (matrix.places(token) == np.flatnonzero(ids == token)).all()
        a, b = n // 3, n - n // 5
        assert matrix.count(token, a, b) == (ids[a:b] == token).sum()
        assert (matrix.places(token, a, b) == np.flatnonzero(ids[a:b] == token) + a).all()
    with pytest.raises(IndexError):
        matrix.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix(b"x" * 40)


def _encoded(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(FILE)
    return [(i, [*model.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]


def test_token_files_round_trip(spark):
    rng = random.Random(4)
    texts = awkward(rng) + [(50, "a <|endoftext|> B<|endoftext|>x<|startoftext|>"), (51, "x  y \n z\t 12 345,\r\n--- É é İ ſ it's"), (52, "\x1c \x85 a b é ́c")]
    texts += [(100 + i, "".join(rng.choice(" ab1.'\n\t é_ś") for _ in range(200))) for i in range(40)]
    want = sorted(_encoded(texts), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    path = token_files.write_tokens(docs(spark, texts), FILE, shard_tokens=500, parts=5, batch_bytes=3000)
    files = token_files.shards(spark, path)
    assert files.count() > 8 and files.groupBy(F.input_file_name()).count().where("count > 1").count() == 0
    got = {}
    for r in token_files.read_tokens(spark, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, np.frombuffer(r["ids"], "<u4").tolist()))
    start = 0
    for i, ids in want:
        assert (start, len(ids), ids) in got[i]
        got[i].remove((start, len(ids), ids))
        start += len(ids)
    assert not any(got.values())
    token = want[5][1][3]
    found = sorted(map(tuple, token_files.find_token(files, token).collect()), key=repr)
    assert found == sorted(((i, k) for i, ids in want for k, x in enumerate(ids) if x == token), key=repr)
    counts = sorted(map(tuple, token_files.count_token(files, token).collect()), key=repr)
    assert counts == sorted(((i, ids.count(token)) for i, ids in want if token in ids), key=repr)


def test_words_are_known_once_whatever_their_case_and_marks():
    from tokenizers import Tokenizer

    rng, model, encoder = random.Random(4), Tokenizer.from_file(FILE), token_files.Encoder(FILE, 1)
    encoder.of(pa.array(["Hello, hello (HELLO) hello.\nÉté été; ÉTÉ"]))
    assert set(encoder.known) == {"", "\n", "hello", "été", ",", "(", ")", ".", ";"}
    assert pc.utf8_lower(pa.array([*token_files.LETTERS])).to_pylist() == [c.lower() for c in token_files.LETTERS]
    assert pc.all(pc.match_substring_regex(pa.array([*token_files.LETTERS]), token_files.ONLY_LETTERS)).as_py()
    signs = ["the", "ÉTÉ", "Straße", "ÿ", "×", "µ", "ª", "İ", "e\u0301", "H\u0331", "Жук", "日本", "'", "'S", "--", "(", "_", "7", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"]
    texts = ["", " ", "\n", "endoftext <|endoftext|>", *("".join(rng.choice([*signs, " ", " ", "\t", "\r\n", "\n"]) for _ in range(60)) for _ in range(150))]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.of(pa.array(texts)).to_pylist()]
    assert got == [[*x.ids, 1] for x in model.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_an_empty_table_and_without_an_end(spark):
    path = token_files.write_tokens(docs(spark, []), FILE)
    assert token_files.read_tokens(spark, path).count() == 0
    path = token_files.write_tokens(docs(spark, [(1, None), (2, "one two")]), FILE, end_id=None)
    rows = by_id(token_files.read_tokens(spark, path), "doc_id", "start", "n_tokens")
    assert rows == [(1, 0, 0), (2, 0, 2)]


def test_token_files_on_real_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in table.collect())
    path = token_files.write_tokens(table, FILE)
    got = by_id(token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")), "doc_id", "start", "n_tokens", "crc")
    want, start = [], 0
    for i, ids in _encoded(texts):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want, key=repr)


def lloyd(rows, k, rounds, dims, scale=1024.0, seed=3):
    """Plain rounds in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = [[] for _ in centers]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centers)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted(out, key=repr), centers


@pytest.mark.parametrize("n,k,dims", [(0, 3, 2), (2, 4, 2), (300, 5, 3), (120, 6, 1)])
def test_clusters_equal_plain_rounds(spark, n, k, dims):
    rng = random.Random(n + dims)
    rows = [(i, [rng.choice([0.0, 0.5, -1.25, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(n)]
    if n > 100:
        rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (1000, None), (1001, []), (1002, [1.0] * (dims + 1))]
        rows += [(1003, [None] * dims), (1004, [math.nan] * dims), (1005, [math.inf] * dims)] + [(2000 + i, [0.0] * dims) for i in range(90)]
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int, bounds string").repartition(4)
    got, history, inertia = centroids.cluster(table, k=k, rounds=6, dims=dims)
    want, centers = lloyd(rows, k, 6, dims)
    assert by_id(got, "vec_id", "cluster", "distance") == want
    assert [c.tolist() for c in history[-1]] == centers if history else not centers
    assert inertia == [sum(d for _, c, d in want if c == j) for j in range(len(centers))]
    full = centroids.described(got, history, inertia)
    assert full.count() == len(want)
    for r in full.limit(3).collect():
        assert r.inertia == sum(inertia) and r.cluster_inertia == inertia[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def test_bounds_spare_distances_and_lose_none():
    """The bounds skip most distances once centroids settle, and the clusters stay those of all distances."""
    rng = np.random.default_rng(2)
    true = rng.integers(-4000, 4000, (8, 16))
    x = (true[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 16))).astype(np.int32)
    history = [x[:8].astype(np.int64)]
    d = np.stack([centroids.squared(x, c) for c in history[0]], axis=1)
    own, bounds, asked, computed = d.argmin(axis=1), np.sqrt(d), np.zeros(d.shape, np.uint16), []
    for _ in range(12):
        history.append(np.array([x[own == j].sum(axis=0, dtype=np.int64) // (own == j).sum() if (own == j).any() else c for j, c in enumerate(history[-1])]))
        own, best, n = centroids.evaluate(x, own, bounds, asked, history)
        d = np.stack([centroids.squared(x, c) for c in history[-1]], axis=1)
        assert (own == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        computed.append(n)
    assert computed[-1] < 0.3 * d.size


def test_a_component_beyond_64_bit_distances_is_an_error(spark):
    table = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="squared distances"):
        centroids.cluster(table, k=1, dims=1)


def audit(rows, good, toxic):
    """All orders, one after another."""
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        bad["E"] = i is not None and i > first[t]
        fails.append((i, lang or "", {k for k, v in bad.items() if v}))
    out, shapley = {}, {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            for step, name in enumerate(order):
                used = set(order[:step])
                gone = [i for i, f in mine if name in f and not f & used]
                out[part, "".join(order), step + 1] = (
                    sum(not f & (used | {name}) for _, f in mine), len(gone), sum(name in f and bool(f & used) for _, f in mine),
                    sum(f == {name} for _, f in mine), sum(i in good for i in gone), sum(i in toxic for i in gone),
                )
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_equals_all_orders(spark):
    rng = random.Random(8)
    texts = awkward(rng) + [(200 + i, rng.choice([prose(rng, 260), "A B " + prose(rng, 240), prose(rng, 210) + " #", "word " * 230, "same text"])) for i in range(40)]
    texts += [(300, "same text"), (300, "#"), (300, "#"), (300, prose(rng, 300))]
    table = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").when(F.col("doc_id") % 3 == 1, "de"))
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    good, toxic = {1, 5, 200, 201, 202, 300, 999}, {3, 203, 204, 300}
    ids = lambda s: spark.createDataFrame([(i,) for i in s] * 2 + [(None,)], "doc_id long")
    lost = {"good_lost": ids(good), "toxic_lost": ids(toxic)}
    run = lambda df: filter_audit.audit_filters(df, filter_audit.text_filters(F.col("text")), lost, copies="E", part=F.col("lang"))
    got = sorted(map(tuple, run(table).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))
    assert got == audit(rows, good, toxic)
    assert run(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit_filters(table, {"AB": F.lit(True)}, {})
