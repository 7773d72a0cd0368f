"""Videos of the v3.0 layout that validation must miss."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
from test_pipelines import _mp4

from framelake.functions.features import FeatureSpec
from framelake.plans import build as B
from framelake.plans import validate as V


def test_videos_of_all_episodes_are_checked(spark, tmp_path):
    features = {"action": FeatureSpec("float32", (1,)), "top": FeatureSpec("video", (48, 64, 3))}
    for e in range(3):
        (tmp_path / f"{e}.mp4").write_bytes(_mp4(3, 10 * 512, 512) + bytes(700_000))
    videos = spark.createDataFrame([(e, "top", str(tmp_path / f"{e}.mp4"), None, None) for e in range(3)], "episode_index bigint, camera string, path string, start double, stop double")
    steps = spark.createDataFrame([(e, i, "pick", float(i)) for e in range(3) for i in range(3)], "episode int, step int, task string, action float")
    root = str(tmp_path / "d")
    B.save(B.build(steps, features, 10, episode="episode", order=["step"], task="task", videos=videos, video_files_size_in_mb=1), root)
    files = sorted(glob.glob(f"{root}/videos/top/*/*.mp4"))
    assert len(files) == 3
    os.remove(files[1])
    open(files[2], "w").close()
    report = V.validate(spark, root)
    assert report.counts["error", "video"] == 2 and not report.counts["warning", "video_meta"]
    meta = glob.glob(f"{root}/meta/episodes/*/*.parquet")[0]
    t = pq.read_table(meta)
    at = t.schema.get_field_index("videos/top/file_index")
    pq.write_table(t.set_column(at, t.schema.field(at), pa.array([0, None, None], t.schema.field(at).type)), meta)
    report = V.validate(spark, root)
    assert not report.counts["error", "video"] and report.counts["warning", "video_meta"] == 2
    pq.write_table(t.drop([c for c in t.column_names if c.startswith("videos/")]), meta)
    assert V.validate(spark, root).counts["warning", "video_meta"] == 3
