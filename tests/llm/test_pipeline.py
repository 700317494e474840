"""The pipeline's stages against plain versions, and that the rest works without the subpackage."""

import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from reelframe.llm import pieces
from reelframe.session import written_table
from tests.llm.test_operators import ODD, documents, plain_components, plain_features, plain_targets, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(written_table(stage(spark, out[-1], SF), f"test-stage-{k}"))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality_stage_drops_what_fails_and_keeps_plain_texts(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        n, _, symbols, _, repeated = plain_features(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in kept
        elif symbols == 0 and repeated <= 0.2 * n:
            assert r.doc_id in kept


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = sorted({c for _, _, c in plain_components(rows, 5, 80)})
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_mixing_stage_repeats_towards_the_targets(stages):
    size, taken = defaultdict(int), defaultdict(int)
    longest = 0
    for r in stages[3].collect():
        size[r.source] += len(words(r.text))
        longest = max(longest, len(words(r.text)))
    for r in stages[4].collect():
        taken[r.source] += len(words(r.text))
    order = sorted(size)
    for s, target in zip(order, plain_targets([size[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3)):
        assert abs(taken[s] - target) <= longest


def test_encoding_stage_restores_the_texts(spark, stages):
    assert stages[5].where("NOT restored").count() == 0
    back = pieces.decode(stages[5], public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(r.text for r in back.collect()) == Counter(r.text for r in stages[4].collect())


def test_stages_take_odd_and_empty_inputs(spark):
    for docs in (documents(spark, ODD), documents(spark, ODD).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
            out.count()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((root / name).read_text())
    subprocess.run(["cp", "-r", str(root / "reelframe"), str(tmp_path)], check=True)
    (tmp_path / "reelframe" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'quality_gate' in q and not any(x.startswith('op') and x[2:3].isdigit() for x in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
