"""Removal of repeats and near-duplicate groups against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from tests.llm.helpers import awkward, by_id, docs, prose

from normatile.llm import line_dedup, near_dedup, substring_dedup, suffix_dedup


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(substring_dedup.GEAR[b])) % (1 << 32)
        want.append(h)
    assert substring_dedup.gear_hash(data).tolist() == want


def test_chunks_cover_the_text_and_resist_shifts():
    text = random.Random(2).randbytes(5000)
    ends = substring_dedup.chunk_ends(text, 5, 24, 512)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= 512 and sizes[:-1].min() >= 24
    shifted = substring_dedup.chunk_ends(b"inserted" + text, 5, 24, 512)
    assert len({e - 8 for e in shifted} & set(ends)) > 0.8 * len(ends)
    assert substring_dedup.chunk_ends(b"", 5, 24, 512) == []


def plain_substrings(texts, rests, min_run, bits=5, least=24, most=512):
    """Chunk by chunk, byte by byte: what is left of every text."""
    def cut(raw):
        ends, start, h = [], 0, 0
        for k, byte in enumerate(raw):
            h = ((h << 1) + int(substring_dedup.GEAR[byte])) % (1 << 32)
            size = k + 1 - start
            if (h >> (32 - bits) == 0 and size >= least) or size == most or k + 1 == len(raw):
                ends.append(k + 1)
                start = k + 1
        parts = list(zip([0, *ends], ends))
        out = [(a, b) for a, b in parts if b - a >= least]
        if rests and len(out) < len(parts):
            out.append((parts[max(0, len(parts) - 2)][0], len(raw)))
        return out

    first, parts = {}, {}
    for i, t in {(i, t) for i, t in texts if i is not None}:
        raw = (t or "").encode()
        parts[i, t] = [(a, b, raw[a:b]) for a, b in cut(raw)]
        for a, _, piece in parts[i, t]:
            first[piece] = min(first.get(piece, (i, a)), (i, a))
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for a, b, piece in parts.get((i, t), []) if i is not None else []:
            if first[piece] != (i, a):
                gone[a + 1 : b + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).reshape(-1, 2).tolist()
        runs = [(a, b) for a, b in edges if b - a >= min_run or b - a == len(raw)]
        keep = np.ones(len(raw), bool)
        for a, b in runs:
            keep[a:b] = False
        left = bytes(np.frombuffer(raw, np.uint8)[keep])
        want.append((i, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
    return sorted(want, key=repr)


@pytest.mark.parametrize("rests,min_run", [(True, 128), (True, 1), (False, 60)])
def test_substrings_against_brute_force(spark, rests, min_run):
    rng = random.Random(3)
    texts = awkward(rng)
    passages = [prose(rng, n) for n in (10, 25, 60, 120)]
    texts += [(100 + i, prose(rng, rng.randint(0, 40)) + rng.choice(passages) + prose(rng, rng.randint(0, 40))) for i in range(40)]
    out = substring_dedup.dedup_substrings(docs(spark, texts), rests=rests, min_run=min_run).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out]
    assert sorted(got, key=repr) == plain_substrings(texts, rests, min_run)
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


def test_a_passage_inside_other_text_is_found_and_short_repeats_stay(spark):
    rng = random.Random(4)
    passage, phrase = prose(rng, 60), " a turn of phrase that many a writer uses now and again "
    texts = [(i, prose(rng, 50) + " " + passage + " " + prose(rng, 50)) for i in range(2)] + [(9, prose(rng, 150))]
    texts += [(20 + i, prose(rng, 40) + phrase + prose(rng, 40)) for i in range(20)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs(spark, texts)).collect()}
    assert got[0] == 0 and got[1] > 0.5 * len(passage) and got[9] == 0
    assert all(got[20 + i] == 0 for i in range(20))


def test_an_id_with_two_texts_is_two_documents(spark):
    rng = random.Random(15)
    a, b = prose(rng, 80), prose(rng, 90)
    texts = [(1, a), (1, b), (1, b), (2, b), (3, a)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.dedup_substrings(docs(spark, texts)).collect())
    assert got == sorted([(1, len(a), 0), (1, len(b), 0), (1, len(b), 0), (2, len(b), len(b)), (3, len(a), len(a))])
    cut = sorted((r.row.doc_id, r.text) for r in line_dedup.dedup_lines(docs(spark, texts)).collect())
    assert cut == sorted([(1, a), (1, b), (1, b), (2, ""), (3, "")])


def test_exact_copies_leave_nothing(spark):
    rng = random.Random(14)
    whole = [prose(rng, n) for n in range(2, 60)] + ["one", "two words", "é"]
    texts = [(k * 1000 + i, t) for k in range(3) for i, t in enumerate(whole)]
    start = whole[50][:-5]  # the start of an earlier text ends in a rest that is no end there
    texts += [(5000, start), (5001, start), (5002, "one more"), (5003, ""), (None, "one")]
    done = substring_dedup.dedup_substrings(docs(spark, texts)).collect()
    got = {r.doc_id: bytes(r.kept).decode() for r in done}
    assert all(got[i] == (t if i < 1000 else "") for i, t in texts if i is not None and i < 5000)
    plain = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs(spark, texts), rests=False).collect()}
    assert all(r.n_removed >= plain[r.doc_id].n_removed and r.n_removed == r.n_bytes - len(r.kept) for r in done)
    assert 0 < len(got[5000]) < len(start) and got[5001] == "" and got[5002] == "one more" and got[None] == "one"
    assert all(r.n_spans == 1 for r in done if r.doc_id is not None and r.n_bytes and 1000 <= r.doc_id < 5000)


def covered(texts: dict, window: int) -> dict:
    first = {}
    for i in sorted(texts):
        raw = texts[i]
        for p in range(len(raw) - window + 1):
            first.setdefault(raw[p : p + window], (i, p))
    out = {}
    for i, raw in texts.items():
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - window + 1):
            if first[raw[p : p + window]] != (i, p):
                gone[p : p + window] = True
        out[i] = gone
    return out


def suffix_texts(rng):
    letters = "ab"
    texts = [(i, t) for i, t in awkward(rng)]
    passages = [prose(rng, 40) for _ in range(3)]
    for i in range(100, 125):
        inner = rng.choice(passages)
        a, b = sorted(rng.sample(range(len(inner)), 2))
        texts.append((i, prose(rng, rng.randint(0, 20)) + inner[a:b] + prose(rng, rng.randint(0, 20)) + inner))
    texts += [(200 + i, "".join(rng.choice(letters) for _ in range(300))) for i in range(4)]
    texts += [(300 + i, ("x" * (70 + i) + "y") * 4) for i in range(4)]
    return texts


@pytest.mark.parametrize("bound", [256, 3])
def test_suffixes_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(suffix_dedup, "BOUND", bound)
    texts = suffix_texts(random.Random(5))
    gone = covered({i: (t or "").encode() for i, t in texts if i is not None}, 100)
    want = []
    for i, t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        mask = gone.get(i, np.zeros(len(raw), bool))
        edges = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want.append((i, len(raw), int(mask.sum()), edges, raw[~mask].tobytes()))
    rows = suffix_dedup.dedup_suffixes(docs(spark, texts)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows], key=repr) == sorted(want, key=repr)


def test_suffixes_of_long_texts_meet_across_segments(spark, monkeypatch):
    rng = random.Random(6)
    text = prose(rng, 400)
    first, last, keys = (np.concatenate(x) for x in zip(*suffix_dedup.runs(text.encode(), 100)))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    f2, l2, k2 = (np.concatenate(x) for x in zip(*suffix_dedup.runs(text.encode(), 100)))
    anchor = lambda f, l, k: {p: key for a, b, key in zip(f.tolist(), l.tolist(), k.tolist()) for p in range(a, b + 1)}
    assert anchor(first, last, keys) == anchor(f2, l2, k2)
    assert suffix_dedup.dedup_suffixes(docs(spark, [])).count() == 0


def test_texts_are_cut_into_contexts_once(spark):
    looked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    texts = [(i, t) for i, t in suffix_texts(random.Random(8)) if i is not None]
    rows = docs(spark, texts).select("doc_id", "text")
    suffix_dedup.removed_runs(rows.mapInArrow(seen, rows.schema).toDF("id", "text"), 100, 3000).collect()
    assert 0 < looked.value <= 2 * len(texts)  # the runs, and the bytes of those that meet


def test_buckets_are_right_whatever_the_hash(monkeypatch):
    rng = random.Random(9)
    shared = [rng.randbytes(120) for _ in range(4)]
    parts = [rng.randbytes(rng.randint(0, 9)) + rng.choice(shared) + rng.randbytes(rng.randint(0, 9)) for _ in range(20)]
    order = lambda found: sorted((n, sorted(m)) for n, m in found)
    want = order(suffix_dedup.bucket_repeats(parts, 100))
    for n, members in want:
        assert len({parts[c][p : p + n] for c, p in members}) == 1
    covered_ = {(c, p + k) for n, members in want for c, p in members for k in range(n)}
    strings = {}
    for c, t in enumerate(parts):
        for p in range(len(t) - 99):
            strings.setdefault(t[p : p + 100], []).append((c, p))
    assert covered_ == {(c, p + k) for at in strings.values() if len(at) > 1 for c, p in at for k in range(100)}
    monkeypatch.setattr(suffix_dedup, "_gram_hashes", lambda data, size=32: np.zeros(len(data) - size + 1, np.uint64))
    assert order(suffix_dedup.bucket_repeats(parts, 100)) == want


def test_interval_tree_gives_all_maximal_repeats():
    rng = random.Random(7)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(40))
        places = list(range(len(text)))
        got = {(n, tuple(sorted(m))) for n, m in suffix_dedup.maximal_repeats([text[p:] for p in places], [text[p - 1] if p else None for p in places], 3)}
        want = set()
        for n in range(3, 40):
            for s in {text[p : p + n] for p in range(len(text) - n + 1)}:
                occ = [p for p in range(len(text) - n + 1) if text[p : p + n] == s]
                right = {text[p + n] if p + n < len(text) else ("end", p) for p in occ}
                left = {text[p - 1] if p else ("start", p) for p in occ}
                if len(occ) > 1 and len(right) > 1 and len(left) > 1:
                    want.add((n, tuple(occ)))
        assert got == want


def plain_lines(texts):
    """Lines in runs of two lines, or in coarse chunks, that stand earlier; rows of one id and text are one document."""
    chunks, first = {}, {}
    for i, t in {(i, t) for i, t in texts if i is not None}:
        lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:14], 16) for x in lines]
        ends = [(h[k] ^ ((h[k - 1] if k else 0) << 1)) % 3 == 0 for k in range(len(h))]
        out, start = [(k, k + 1) for k in range(len(lines) - 1)], 0
        for k in range(len(lines)):
            if k == len(lines) - 1 or (ends[k] and not (k and ends[k - 1])):
                out += [(a, min(k, a + 31)) for a in range(start, k + 1, 32)]
                start = k + 1
        chunks[i, t] = [(a, b, "\n".join(lines[a : b + 1])) for a, b in out if b > a]
        for a, _, text in chunks[i, t]:
            if len(text) >= 32:
                first.setdefault(text, []).append((i, a, t))
    want = []
    for i, t in texts:
        if i is None:
            want.append((i, t, 0))
            continue
        gone = {k for a, b, x in chunks[i, t] if len(x) >= 32 and min(f[:2] for f in first[x]) < (i, a) for k in range(a, b + 1)}
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in gone]
        want.append((i, None if t is None else "\n".join(kept), len(gone)))
    return sorted(want, key=repr)


def repeated_passage_lines(texts):
    """Places (id, line) in runs of two lines or more, 32 characters or more, that stand in an earlier text."""
    seen, out = {}, set()
    for i, t in sorted(texts):
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            pair = "\n".join(lines[k : k + 2])
            if len(pair) >= 32 and seen.setdefault(pair, (i, k)) != (i, k):
                out |= {(i, k), (i, k + 1)}
    return out


def test_short_passages_are_found(spark):
    """Passages of 2 to 8 lines anywhere in a text, and real documents without exact copies: all repeated lines go, no single line does."""
    rng = random.Random(21)
    passages = [prose(rng, 9 * rng.randint(2, 8)) for _ in range(40)]
    texts = [(i, "\n".join([prose(rng, 9 * rng.randint(1, 5)), passages[i % 40], prose(rng, 9 * rng.randint(1, 5)), "a single line that stands in every one of the texts"])) for i in range(160)]
    real = {r.text: r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for rows in (texts, [(i, t) for t, i in real.items()]):
        want = repeated_passage_lines(rows)
        out = {r.row.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
        removed = sum(r.n_removed_lines for r in out.values())
        assert removed >= len(want) and removed >= 0.9 * len(want) and len(want) > 100
        assert all(r.n_removed_lines >= 2 * r.n_removed_runs for r in out.values())
        if rows is texts:
            assert all("a single line that stands" in r.text for r in out.values())


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    block = [prose(rng, 9) for _ in range(30)]
    texts = awkward(rng)
    for i in range(100, 120):
        a = rng.randint(0, 20)
        texts.append((i, "\n".join([prose(rng, 9) for _ in range(rng.randint(0, 4))] + block[a : a + 10] + [prose(rng, 9)] * rng.randint(0, 3))))
    df = docs(spark, texts)
    out = line_dedup.dedup_lines(df)
    assert sorted(((r.row.doc_id, r.text, r.n_removed_lines) for r in out.collect()), key=repr) == plain_lines(texts)
    cut = line_dedup.without_repeated_lines(df, chars_col="n_chars")
    assert cut.columns == df.columns and cut.count() == len(texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def plain_groups(texts, width, percent):
    sets = []
    for i, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    ids = [i for i, _ in texts]
    comp = {i: i for i in ids if i is not None}
    changed = True
    while changed:
        changed = False
        for x in range(len(ids)):
            for y in range(x):
                if ids[x] is None or ids[y] is None or not sets[x] or not sets[y]:
                    continue
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and comp[ids[x]] != comp[ids[y]]:
                    comp[ids[x]] = comp[ids[y]] = min(comp[ids[x]], comp[ids[y]])
                    changed = True
    return sorted(((i, len(s), comp.get(i)) for i, s in zip(ids, sets)), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(9)
    texts = awkward(rng)
    for g in range(6):
        words = prose(rng, 100).split()
        for k in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz") * 3
            texts.append((1000 - 20 * g - k, " ".join(copy)))
    df = docs(spark, texts)
    got = near_dedup.near_duplicates(df, width=width)
    assert by_id(got, "doc_id", "n_shingles", "component_id") == plain_groups(texts, width, 80)
    kept = near_dedup.without_near_duplicates(df, width=width)
    want = [i for i, _, c in plain_groups(texts, width, 80) if i == c]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_close_and_registers_merge():
    rng = np.random.default_rng(11)
    for j in (0.5, 0.8, 0.9):
        n = 2000
        a = rng.integers(0, 1 << 63, n, np.uint64)
        common = int(2 * n * j / (1 + j))
        b = np.concatenate([a[:common], rng.integers(0, 1 << 63, n - common, np.uint64)])
        ra, rb = near_dedup.registers(a), near_dedup.registers(b)
        got = near_dedup._compare(ra[None], rb[None], [n], [n])[0]
        assert abs(got - j) < 4 * (j * (1 - j) / near_dedup.REGISTERS) ** 0.5
        assert (near_dedup.merged(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()


def test_components_follow_long_chains(spark):
    n = 60
    labels = spark.createDataFrame([(i, i) for i in range(n)], "id long, comp long")
    order = list(range(n - 10))
    random.Random(12).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(55, 56), (56, 55)], "a long, b long")
    got = {r.id: r.comp for r in near_dedup.components(labels, links).collect()}
    assert all(got[i] == 0 for i in range(n - 10)) and got[56] == 55 and got[57] == 57


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    text = prose(random.Random(13), 700).encode()
    whole = near_dedup.shingles(text, 4)
    monkeypatch.setattr(near_dedup, "CHUNK", 64)
    assert (near_dedup.shingles(text, 4) == whole).all()


def test_an_id_with_two_texts_loses_no_link(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 150) for _ in range(3))
    near = b.replace(b.split()[70], "changed", 1)
    texts = [(1, a), (1, b), (9, near), (12, c), (12, near), (20, c)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, texts)).collect())
    size = lambda t: len({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    assert got == sorted([(1, size(a), 1, True), (1, size(b), 1, True), (9, size(near), 1, False), (12, size(c), 12, True), (12, size(near), 1, False), (20, size(c), 12, False)])
    left = near_dedup.without_near_duplicates(docs(spark, texts))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, a), (1, b), (12, c)])


def test_similar_documents_below_the_threshold_stay_apart(spark):
    """Hundreds of texts that share most of their words, none of them 80 percent, beside a group that does."""
    rng = random.Random(32)
    words = prose(rng, 200).split()
    texts = []
    for i in range(400):
        copy = list(words)
        for k in rng.sample(range(10, 190), 8):
            copy[k] = f"own{i}x{k}"
        texts.append((i, " ".join(copy)))
    for i in range(300):
        copy = list(words)
        copy[rng.randrange(100)] = f"near{i}"
        texts.append((1000 + i, " ".join(copy)))
    got = by_id(near_dedup.near_duplicates(docs(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert got == plain_groups_fast(texts, 5, 80)


def plain_groups_fast(texts, width, percent):
    """``plain_groups`` for distinct ids, with counts of shared shingles."""
    vocabulary, rows = {}, []
    for _, t in texts:
        w = t.lower().split()
        rows.append({vocabulary.setdefault(tuple(w[k : k + width]), len(vocabulary)) for k in range(len(w) - width + 1)})
    table = np.zeros((len(rows), len(vocabulary)), np.float32)
    for k, s in enumerate(rows):
        table[k, list(s)] = 1
    both, size = table @ table.T, table.sum(axis=1)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    ids = np.array([i for i, _ in texts])
    comp = ids.copy()
    while True:
        least = np.where(linked, comp[None, :], comp.max()).min(axis=1)
        if (least >= comp).all():
            return sorted(((int(i), int(n), int(c)) for i, n, c in zip(ids, size, comp)), key=repr)
        comp = np.minimum(comp, least)
