"""Datasets with images are written with the statistics of the pixels."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from framelake.functions.features import FeatureSpec
from framelake.plans import build as B
from framelake.plans import validate as V


def _png(color, side=4):
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress((b"\0" + bytes(color) * side) * side)) + part(b"IEND", b"")


def test_image_statistics_are_written(spark, tmp_path):
    rows = [(e, i, "pick", float(i), bytearray(_png((255, 51 * i, 0)))) for e in range(2) for i in range(3)]
    steps = spark.createDataFrame(rows, "episode int, step int, task string, action float, png binary")
    steps = steps.withColumn("cam", F.struct(F.col("png").alias("bytes"), F.lit(None).cast("string").alias("path"))).drop("png")
    features = {"action": FeatureSpec("float32", (1,)), "cam": FeatureSpec("image", (4, 4, 3))}
    made = B.build(steps, features, 10, episode="episode", order=["step"], task="task")
    d = B.save(made, str(tmp_path / "d"))
    got = {r["dim"]: r for r in d.stats.where("feature = 'cam' and episode_index = 1").collect()}
    assert [(round(got[c]["mean"], 6), got[c]["max"], got[c]["count"]) for c in range(3)] == [(1.0, 1.0, 3), (0.2, 0.4, 3), (0.0, 0.0, 3)]
    assert json.load(open(tmp_path / "d/meta/stats.json"))["cam"]["count"] == [6]
    assert V.validate(spark, str(tmp_path / "d")).ok
    assert B.convert(made, "v2.1").images == ("cam",)
