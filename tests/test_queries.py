"""Registered queries against DuckDB on the smallest tables (all of them: ``python -m tests.oracle``)."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from normatile.session import shared_folder
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Pixel-sized results and streams have their own tests; here they would only be slow.
CHECKED = """
image_score_top3 mean_cov_moments attention_mass fused_patch_score pruning_schedule prune_patches ema_profile
last_n_buffer group_auroc average_precision pr_curve best_f1 percentile_bounds label_audit pixel_auroc
evaluation_report mask_join image_ordinals dataset_audit key_split_half assign_batches method_lookup score_report
running_loss run_summary lr_schedule early_stopping checkpoint_gate focal_loss region_match
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), name, queries()[name], oracle_sql()[name], SF) == ""


def test_flagship(spark):
    out = entry(spark)
    assert out.columns == ["image_id", "label", "image_score"] and out.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def fake_session(configured, on_context, master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: on_context, master=master),
    )


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(fake_session("/shared/a/", None, "yarn")) == "/shared/a"
    assert shared_folder(fake_session(None, "/shared/b", "yarn")) == "/shared/b"
    assert os.path.isdir(shared_folder(fake_session(None, None, "local[2]")))
    with pytest.raises(RuntimeError):
        shared_folder(fake_session(None, None, "yarn"))


def test_entry_works_without_the_text_operators():
    code = (
        "import sys; sys.modules['normatile.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); assert 'image_score_top3' in names\n"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
