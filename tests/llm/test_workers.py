"""Workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from skein.llm.language import LanguageModel, LanguageSettings

REPO = str(Path(__file__).resolve().parent.parent.parent)

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from skein.session import local_session
from skein.llm import queries
spark = local_session("elsewhere", "2", spark__checkpoint__dir=sys.argv[1])
def absent(_):
    try:
        import skein
    except ModuleNotFoundError:
        return [1]
    return [0]
assert sum(spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect()) == 1
for name in ("op2_url_filter", "op5_language", "op10_toxicity", "op11_phrases", "op13_alignment"):
    assert queries.REGISTRY[name](spark, "/root/testdata/sf0.001").count() >= 0
"""


def test_models_travel_by_value(tmp_path):
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_paths_over_more_than_256_languages():
    names = [f"l{k:03}" for k in range(300)]
    scores = np.full((2, 300), -5.0, np.float32)
    scores[0, 299], scores[1, 256] = 0.0, 0.0
    model = LanguageModel(names, None, None, LanguageSettings())
    got = model.paths(scores, np.array([0, 0, 0, 1, 1, 1]), np.array([3, 3]))
    assert got.tolist() == [299] * 3 + [256] * 3
    assert isinstance(pa.array(got), pa.Array)
