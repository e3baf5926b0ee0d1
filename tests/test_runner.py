"""Configurations and refused baselines."""

import json

import pytest

from mnemolith.operators import temporal
from mnemolith.plans import runner


def test_fingerprint_and_config(spark, tmp_path):
    assert runner.fingerprint({"a": 1, "b": [1, 2], "_config_path": "x"}) == runner.fingerprint({"b": [1, 2], "a": 1})
    assert runner.fingerprint({"a": 1}) != runner.fingerprint({"a": 2})
    (tmp_path / "c.json").write_text(json.dumps({"run_id": "r", "seed": 3, "paths": {}}, indent=1))
    assert runner.load_config(spark, str(tmp_path / "c.json"), {"run_id": str, "seed": int, "paths": dict})["seed"] == 3
    with pytest.raises(ValueError, match="seed must be str; split is missing"):
        runner.load_config(spark, str(tmp_path / "c.json"), {"seed": str, "split": str})


def test_weak_baseline_is_an_error(spark):
    m = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.3, 0.0)], "method string, recall_at_k double, top1_accuracy double")
    assert temporal.effective_baseline(m, 0.3, 0.0).first().method == "b"
    with pytest.raises(Exception, match="too weak a baseline: b"):
        temporal.effective_baseline(m, 0.5, 0.0).collect()
