"""Reports of validation count and find all problems, however many there are."""

import glob
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framelake import cli
from framelake.functions.features import FeatureSpec
from framelake.plans import build as B
from framelake.plans import validate as V


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    rows = [(e, i, "pick", float(i)) for e in range(3) for i in range(4)]
    steps = spark.createDataFrame(rows, "episode int, step int, task string, action float")
    root = str(tmp_path_factory.mktemp("whole") / "d")
    B.save(B.build(steps, {"action": FeatureSpec("float32", (1,))}, 10, episode="episode", order=["step"], task="task"), root)
    return root


def _changed(root, to, change):
    shutil.copytree(root, to)
    file = glob.glob(f"{to}/data/*/*.parquet")[0]
    t = pq.read_table(file)
    pq.write_table(change(t), file)
    return to


def _times(t):
    at = t.schema.get_field_index("timestamp")
    return t.set_column(at, t.schema.field(at), pa.array([3.0 * i for i in range(len(t))], t.schema.field(at).type))


def test_warnings_hide_no_errors(spark, whole, tmp_path, monkeypatch, capsys):
    root = _changed(whole, str(tmp_path / "d"), _times)
    file = f"{root}/meta/tasks.parquet"
    t = pq.read_table(file)
    pq.write_table(t.set_column(t.schema.get_field_index("task_index"), "task_index", pa.array([5], pa.int64())), file)
    monkeypatch.setattr(V, "SHOWN", 3)
    report = V.validate(spark, root)
    assert not report.ok and report.counts == {("warning", "timestamp_step"): 3, ("error", "task_gap"): 1}
    assert len(report.problems) == 3 and report.problems[0][1] == "task_gap"
    assert (report.count(V.ERROR), report.count(V.WARNING)) == (1, 3)
    assert cli.main(["validate", root]) == 1 and "1 more: 1 errors, 3 warnings in all" in capsys.readouterr().out


def test_counts_are_of_all(spark, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHOWN", 2)
    report = V.validate(spark, _changed(whole, str(tmp_path / "gaps"), lambda t: t.filter([i % 4 != 1 for i in range(len(t))])))
    assert report.counts["error", "index_gap"] == 3 and report.counts["error", "length"] == 3
    assert report.counts["error", "file_range"] == 3
    assert len([p for p in report.problems if p[1] in ("file_range", "index_gap", "length")]) == 2
    report = V.validate(spark, _changed(whole, str(tmp_path / "columns"), lambda t: t.drop(["action", "timestamp", "index"])))
    assert report.counts == {("error", "missing_column"): 3} and len(report.errors) == 2
    assert report.errors[0] == "data/chunk-000/file-000.parquet: no column action"
