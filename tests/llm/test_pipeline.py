"""The corpus pipeline on small tables, each stage against brute force on what the stage before kept."""

import random

import corpus_pipeline
from normatile.llm import mixing
from normatile.session import new_folder
from tests.llm.helpers import docs, prose
from tests.llm.test_counting import plain_counts
from tests.llm.test_duplicates import plain_groups, plain_lines
from tests.llm.test_finding import plain_hits


def test_stages_against_brute_force(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(3)]
    block = "\n".join(prose(rng, 9) for _ in range(12))
    texts = [(i, prose(rng, 80)) for i in range(40)]
    texts += [(100 + i, prose(rng, 30) + "\n" + block + "\n" + prose(rng, 30)) for i in range(6)]
    base = prose(rng, 200).split()
    for i in range(6):
        copy = list(base)
        copy[20 * i] = "changed"
        texts.append((200 + i, " ".join(copy)))
    texts += [(300 + i, prose(rng, 60) + " " + items[i][1]) for i in range(3)]
    texts += [(400 + i, " ".join(w + "###" for w in prose(rng, 70).split())) for i in range(20)]
    texts += [(500, None), (501, ""), (502, "too short")]
    labels = [(i, int(not 400 <= i < 500)) for i, _ in texts]
    folder = new_folder(spark, "pipeline-test")
    docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, folder)
        rows = out.collect()
        ids = sorted(r.doc_id for r in rows)
        if name == "quality_rules":
            failed = {i for i, t in before if plain_counts(t)[-1]}
            assert not failed & set(ids) and {i for i, _ in before if i < 400} - failed <= set(ids)
            assert not any(400 <= i < 420 for i in ids)
        if name == "line_dedup":
            assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == [x[:2] for x in plain_lines(before)]
        if name == "near_dedup":
            assert ids == sorted(i for i, _, c in plain_groups(before, 5, 80) if i == c)
        if name == "decontamination":
            assert ids == sorted(h[0] for h in plain_hits(before, items) if not h[4])
        if name == "source_mix":
            sizes = {i: len(t.split()) for i, t in before}
            assert all(r.mix_taken == r.mix_copies * sizes[r.doc_id] and 1 <= r.mix_copies <= 3 for r in rows)
            taken = sum(r.mix_taken for r in rows)
            assert abs(taken - sum(sizes.values())) < 3 * max(sizes.values())
            assert {r.source for r in rows} <= {"a", "b", None} and mixing.WORDS
        else:
            assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    assert corpus_pipeline.run(spark, folder).count() == now.count()
