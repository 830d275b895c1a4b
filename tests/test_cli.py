import pytest

from arborlane import cli


def test_parse():
    assert cli.parse('# c\ntask="regression"\nmaxIter=3\nevaluateFunc=["rmse"]\n') == {"task": "regression", "maxIter": 3, "evaluateFunc": ["rmse"]}
    with pytest.raises(ValueError):
        cli.parse("nothing")


def test_run(spark, tmp_path):
    lines = "\n".join(f"{i % 2} 1:{i} 2:{i * i % 7}" for i in range(40))
    (tmp_path / "d.txt").write_text(lines)
    config = {"task": "classification", "inputType": "libsvm@2", "trainPath": str(tmp_path / "d.txt"), "modelSavePath": str(tmp_path / "m"), "maxIter": 2}
    assert cli.run(spark, config).numTrees == 2
    with pytest.raises(ValueError):
        cli.run(spark, {"task": "other"})
