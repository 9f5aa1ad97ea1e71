"""Decontamination and personal data against plain Python."""

import random
import re

from tests.llm.helpers import WORDS, awkward, by_id, docs, prose

from normatile.llm import decontaminate, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_hits(texts, items):
    windows = []
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(13, len(w))
        windows += [(tuple(w[p : p + k]), str(i) if i is not None else "") for p in range(len(w) - k + 1) if k]
    out = []
    for d, t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for win, item in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(item)
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_windows_are_found(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randint(14, 40))) for i in range(12)] + [(20, "Zeta, mu"), (21, "é"), (22, ""), (23, None), (20, "tau tau"), (None, "omega x9")]
    texts = awkward(rng)[:-6]
    for i in range(100, 130):
        item = rng.choice(items)[1] or ""
        words = item.split()
        cut = words[rng.randint(0, 3) :]
        texts.append((i, prose(rng, 30) + " " + rng.choice([" ", "-", "\n"]).join(cut).upper() + "! " + prose(rng, rng.randint(5, 400))))
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(texts, items)
    for block in (8 << 20, 300):
        got = decontaminate.verdict(decontaminate.find_contamination(df, bench, block_bytes=block, batch_bytes=5000))
        assert by_id(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == want
    out = decontaminate.decontaminated(df, bench)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=repr) == sorted((w[0] for w in want if not w[4]), key=repr)
    assert decontaminate.find_contamination(df, bench.limit(0)).where("n_words > 0").count() > 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_any_number_of_item_blocks(spark, monkeypatch):
    from pyspark import Broadcast

    rng = random.Random(5)
    items = [(i, prose(rng, 20)) for i in range(14)]
    texts = [(i, prose(rng, 30) + " " + items[i % 14][1] + " " + items[(i + 5) % 14][1]) for i in range(28)] + [(50, "none"), (51, None), (3, "again"), (3, "again")]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert next(decontaminate._item_blocks(bench, "item_id", "text", 10))  # read one by one
    gone = []
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a))[1])
    monkeypatch.setattr(decontaminate, "UNION", 2)
    got = decontaminate.verdict(decontaminate.find_contamination(df, bench, block_bytes=10, max_item_bytes=None))
    assert by_id(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == plain_hits(texts, items)
    assert len(gone) == len(items)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def plain_base(text):
    t, out = text or "", []
    only = lambda m: re.sub("[^0-9]", "", m)
    checks = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (CARD, lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (PHONE, lambda m: 10 <= len(only(m)) <= 15),
    }
    for k, (kind, (pattern, valid)) in enumerate(checks.items()):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(t) if valid(m.group())]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "x@y.com", "..", ".", "-", "_", "%", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "  ",
             "+1 (212) 555-0199", "+44 20 7946 0958", "+", "(", ")", "9", "12", "\x01", "\x02", "\x03", "é", "😀", "\n", "5.6", "79927398713" * 2]
    texts = awkward(rng)[:-5] + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    texts += [(900, "a@" + "b." * 3000 + "c"), (901, "1" * 5000), (902, "1 " * 4000), (903, "+" + "1-" * 4000 + "1"), (904, "x" * 50000 + "@y.z")]
    out = pii.find_personal(docs(spark, texts))
    got = sorted(((r.doc_id, r.b) for r in out.select("doc_id", pii.joined(out.base).alias("b")).collect()), key=repr)
    assert got == sorted(((i, plain_base(t)) for i, t in texts), key=repr)
    for r in out.collect():
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def test_trees_find_secrets_and_leave_plain_numbers(spark):
    rng = random.Random(3)
    texts, bare, clean = [], [], []
    for i in range(300):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        kind = i % 3
        if kind == 0:
            texts.append((i, f'{prose(rng, 20)} token = "{key}" {prose(rng, 20)}'))
        elif kind == 1:
            texts.append((i, f"{prose(rng, 20)} on 2021-05-12 version-2-of-the-long-name 10.5 {rng.randint(1, 99)} {prose(rng, 10)}"))
            clean.append(i)
        else:
            texts.append((i, f"{prose(rng, 9)} mail a{i}@b.org call +1 (212) 555-{1000 + i} {prose(rng, 9)}"))
    for i in range(1000, 1010):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        texts.append((i, f'{prose(rng, 8)} secret: "{key}" {prose(rng, 8)}'))
        bare.append(i)
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in pii.find_personal(df).collect()}
    assert all(any(x.kind == "secret" and x.end - x.start == 40 for x in rows[i].spans) for i in bare)
    assert sum(bool(rows[i].spans) for i in clean) <= 2
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert "[SECRET]" in out[0] and "[EMAIL]" in out[2] and "[PHONE]" in out[2] and "@" not in out[2]
    assert pii.redacted(df).columns == df.columns


def test_every_kind_of_candidate_can_be_chosen(spark):
    rng = random.Random(4)
    texts, want = [], {}
    for i in range(400):
        key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
        said = [
            ("contact", f"name.x [at] {rng.choice(WORDS)}.org"), ("number", f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
            ("number", f"(212) 555-{rng.randint(1000, 9999)}"), ("secret", key), ("none", "2021-05-12 and 1999-12-31"),
        ][i % 5]
        lead = ["write to ", "ssn: ", "phone ", 'token = "', "on "][i % 5]
        head = prose(rng, 9).replace(".", " ") + lead
        texts.append((i, f'{head}{said[1]}" {prose(rng, 9)}'))
        want[i] = (len(head), len(head) + len(said[1]), said[0])
    assert not any(c.isdigit() for i, t in texts if i % 5 == 3 for c in t)
    rows = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_personal(docs(spark, texts)).collect()}
    for i, (start, end, kind) in want.items():
        assert rows[i] == [] if kind == "none" else any(s <= start + 1 and e == end and k == kind for s, e, k in rows[i]), (texts[i], rows[i])


def test_secrets_without_a_cue_are_found(spark):
    """Trees learned from announced secrets select at least 0.9 of those that nothing announces, and few other long words."""
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(24, 44)))
    plain = ["version-2-of-the-long-name", "internationalisation", "src/operators/ordering/helpers", "well-known-phrases-in-a-row", "docs/getting_started/index", "incomprehensibilities"]
    texts, bare, other = [], {}, 0
    for i in range(900):
        head, tail = prose(rng, 12).replace(".", " "), prose(rng, 6)
        if i % 3 == 0:
            texts.append((i, f'{head}api_key = "{key()}" {tail}'))
        elif i % 3 == 1:
            texts.append((i, f"{head}{rng.choice(plain)} {rng.choice(plain)} {tail}"))
        elif i % 45 == 2:
            secret = key()
            texts.append((i, f"{head}{secret} {tail}"))
            bare[i] = (len(head), len(head) + len(secret), "secret")
        else:
            texts.append((i, f"{head}{rng.choice(plain)} {tail}"))
    rows = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_personal(docs(spark, texts)).collect()}
    assert len(bare) == 20 and sum(span in rows[i] for i, span in bare.items()) >= 0.9 * len(bare)
    other = sum(len(rows[i]) for i, _ in texts if i % 3 and i not in bare)
    assert other <= 0.02 * len(texts)
    assert all(f in pii.FEATURES for f in ("path", "goes_on")) and not {"hint", "quoted"} & set(pii.FEATURES)


def test_nothing_to_learn_from(spark):
    df = docs(spark, [(1, "no data here"), (2, None)])
    assert [r.spans for r in pii.find_personal(df).collect()] == [[], []]
    assert pii.find_personal(docs(spark, [])).count() == 0
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == ["no data here", None]
