"""Videos: probing MP4 files, and planning and running work on them.

Probing reads the boxes of the file and needs no program.  Muxing needs ffmpeg,
which is looked for at a given place and on the path; without it the functions
that need it say so, and all planning still works.
"""

from __future__ import annotations

import os
import re
import shutil
import struct
import subprocess
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import decode_png
from .files import local

#: Tolerances of time stamps, rate and duration.
PTS_TOLERANCE, FPS_TOLERANCE, DURATION_TOLERANCE = 1e-4, 0.01, 0.2
#: Settings of the encoder.
ENCODE = ["-c:v", "libx264", "-crf", "25", "-pix_fmt", "yuv420p", "-movflags", "+faststart"]


class MediaError(RuntimeError):
    """A video that cannot be read or made."""


_program: list[str] = []


def use_program(path: str) -> None:
    """The ffmpeg that is used where no other is given."""
    _program[:] = [path]


def find_program(name: str = "ffmpeg", explicit: str | None = None) -> str:
    for place in (explicit, *_program, shutil.which(name)):
        if place and os.path.exists(place):
            return place
    raise MediaError(f"{name} is not installed; give its place or put it on the path")


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    at = start
    while at + 8 <= end:
        size, kind, head = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8], 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            break
        yield kind, at + head, min(end, at + size)
        at += size


def _child(data: bytes, start: int, end: int, path: str) -> tuple[int, int] | None:
    for want in path.split("/"):
        found = next(((s, e) for k, s, e in _boxes(data, start, end) if k == want.encode()), None)
        if found is None:
            return None
        start, end = found
    return start, end


def read_moov(path: str) -> bytes:
    """The index of an MP4 file as a whole box; what it indexes is not read."""
    with open(path, "rb") as f:
        end = os.fstat(f.fileno()).st_size
        at = 0
        while at + 8 <= end:
            f.seek(at)
            head = f.read(16)
            size, kind, skip = struct.unpack(">I", head[:4])[0], head[4:8], 8
            if size == 1:
                size, skip = struct.unpack(">Q", head[8:16])[0], 16
            elif size == 0:
                size = end - at
            if size < skip:
                break
            if kind == b"moov":
                f.seek(at)
                return f.read(min(size, end - at))
            at += size
    raise MediaError("no moov box")


def _full(data: bytes, at: tuple[int, int] | None, fmt: str) -> np.ndarray:
    """The entries of a table with a count, as rows of numbers."""
    if at is None:
        return np.zeros((0, len(fmt)), np.int64)
    n = struct.unpack(">I", data[at[0] + 4 : at[0] + 8])[0]
    kind = np.dtype([(f"c{i}", f">{c}") for i, c in enumerate(fmt)])
    rows = np.frombuffer(data, kind, min(n, (at[1] - at[0] - 8) // kind.itemsize), at[0] + 8)
    return np.stack([rows[c].astype(np.int64) for c in kind.names], axis=1)


def _edit(data: bytes, track: tuple[int, int], scale: int, movie_scale: int) -> tuple[float, float]:
    """Seconds that the track's edit list puts before it, and media time, in
    seconds, at which it begins."""
    box = _child(data, *track, "edts/elst")
    if box is None:
        return 0.0, 0.0
    rows = _full(data, box, "QqI" if data[box[0]] == 1 else "IiI")
    delay = 0.0
    for duration, media_time, _ in rows:
        if media_time >= 0:
            return delay, media_time / scale
        delay += duration / movie_scale
    return delay, 0.0


def _audio(data: bytes, moov: tuple[int, int]) -> bool:
    return any(k == b"trak" and (h := _child(data, s, e, "mdia/hdlr")) and data[h[0] + 8 : h[0] + 12] == b"soun" for k, s, e in _boxes(data, *moov))


def probe_mp4(data: bytes) -> dict:
    """width, height, codec, channels, depth, has_audio, timescale, frames,
    duration and pts (in the order of showing) of the first video track.

    Time stamps are those that a player shows: decoding times, moved by the
    composition offsets of frames that are stored in another order and by the
    edit list.
    """
    moov = _child(data, 0, len(data), "moov")
    if moov is None:
        raise MediaError("no moov box")
    header = _child(data, *moov, "mvhd")
    movie_scale = struct.unpack(">I", data[header[0] + (20 if data[header[0]] == 1 else 12) :][:4])[0] if header else 1
    for kind, s, e in _boxes(data, *moov):
        if kind != b"trak":
            continue
        handler = _child(data, s, e, "mdia/hdlr")
        if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        h = _child(data, s, e, "mdia/mdhd")[0]
        long = data[h] == 1
        scale = struct.unpack(">I", data[h + (20 if long else 12) : h + (24 if long else 16)])[0]
        table = _child(data, s, e, "mdia/minf/stbl")
        entry = _child(data, *table, "stsd")[0] + 8
        codec = data[entry + 4 : entry + 8].decode("latin-1")
        width, height = struct.unpack(">HH", data[entry + 32 : entry + 36])
        depth = struct.unpack(">H", data[entry + 82 : entry + 84])[0] if len(data) >= entry + 84 else 24
        times = _full(data, _child(data, *table, "stts"), "II")
        deltas = np.repeat(times[:, 1], times[:, 0])
        shown = np.concatenate([[0], np.cumsum(deltas)])
        length, shown = shown[-1] / scale, shown[:-1]
        offsets = _child(data, *table, "ctts")
        if offsets is not None:
            rows = _full(data, offsets, "Ii" if data[offsets[0]] == 1 else "II")
            moved = np.repeat(rows[:, 1], rows[:, 0])[: len(shown)]
            shown = shown + np.pad(moved, (0, len(shown) - len(moved)))
        delay, begins = _edit(data, (s, e), scale, movie_scale)
        pts = np.sort(shown) / scale - begins + delay
        return {
            "width": width, "height": height, "codec": codec, "channels": 1 if depth in (33, 34, 36, 40) else 4 if depth == 32 else 3, "depth": depth, "has_audio": _audio(data, moov),
            "timescale": scale, "frames": len(shown), "duration": length, "pts": pts.tolist(),
        }
    raise MediaError("no video track")


def feature_info(path: str, fps: int) -> dict:
    """What a video feature's ``info`` says of its videos, from one of them."""
    m = probe_mp4(read_moov(local(path)))
    codec = {"avc1": "h264", "hev1": "hevc", "hvc1": "hevc", "av01": "av1", "mp4v": "mpeg4"}.get(m["codec"], m["codec"])
    return {"video.height": m["height"], "video.width": m["width"], "video.codec": codec, "video.channels": m["channels"], "video.fps": fps, "video.is_depth_map": False, "has_audio": m["has_audio"]}


def probe(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per video: path, width, height, codec, frames, duration, fps,
    pts_error (largest distance from a frame's due time) or error."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    schema = "path string, width int, height int, codec string, frames bigint, duration double, fps double, pts_error double, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "width", "height", "codec", "frames", "duration", "fps", "pts_error", "error"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                try:
                    m = probe_mp4(read_moov(local(p)))
                    fps = m["frames"] / m["duration"] if m["duration"] else 0.0
                    late = max((abs(t - i / fps) for i, t in enumerate(m["pts"])), default=0.0) if fps else 0.0
                    rows.append((p, m["width"], m["height"], m["codec"], m["frames"], m["duration"], fps, late, None))
                except (OSError, MediaError, struct.error, IndexError) as e:
                    rows.append((p, None, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return listed.mapInArrow(read, schema)


def video_errors(probed: DataFrame, expected: DataFrame, fps: float) -> DataFrame:
    """Videos (path, frames) that are unreadable, of another length or uneven."""
    e = expected.select("path", F.col("frames").alias("wanted"))
    joined = e.join(probed, "path", "left")
    slack = max(DURATION_TOLERANCE, 5.0 / fps)
    reason = (
        F.when(F.col("error").isNotNull() | F.col("frames").isNull(), F.coalesce("error", F.lit("missing")))
        .when(F.col("frames") != F.col("wanted"), "frame count")
        .when(F.abs(F.col("fps") - fps) > FPS_TOLERANCE, "frame rate")
        .when(F.abs(F.col("duration") - F.col("wanted") / fps) > slack, "duration")
        .when(F.col("pts_error") > PTS_TOLERANCE, "time stamps")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("path", "reason")


def _run(args: list[str]) -> None:
    done = subprocess.run(args, capture_output=True, text=True)  # noqa: S603
    if done.returncode:
        raise MediaError(done.stderr[-500:])


#: Messages of the decoder that say nothing about the video.
BENIGN = ("deprecated pixel format used", "Application provided invalid, non monotonically increasing dts to muxer")


def decode_warnings(text: str) -> list[str]:
    """The lines of the decoder's messages that may mean a fault."""
    return [line for line in map(str.strip, text.splitlines()) if line and not any(b in line for b in BENIGN)]


_majors: dict[str, int] = {}


def major_version(program: str) -> int:
    """The first number of the program's version; 0 if it says none."""
    if program not in _majors:
        said = subprocess.run([program, "-version"], capture_output=True, text=True).stdout  # noqa: S603
        found = re.match(r"\w+ version n?(\d+)", said)
        _majors[program] = int(found.group(1)) if found else 0
    return _majors[program]


def passthrough_rate(program: str) -> list[str]:
    """Options that keep every frame; their name changed with version 5."""
    return ["-fps_mode", "passthrough"] if major_version(program) >= 5 else ["-vsync", "passthrough"]


def remux_h264(stream: str, out: str, fps: int, frames: int, program: str | None = None) -> None:
    """A raw H.264 stream as a video without encoding it again; it must hold as
    many frames as the episode."""
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    _run([find_program(explicit=program), "-y", "-r", str(fps), "-f", "h264", "-i", stream, "-c", "copy", "-movflags", "+faststart", out])
    held = probe_mp4(read_moov(out))["frames"]
    if held != frames:
        os.remove(out)
        raise MediaError(f"{held} frames in the stream, {frames} in the episode")


def encode_images(folder: str, out: str, fps: int, program: str | None = None) -> int:
    """The frames ``frame-*.png`` of a folder, by name, as a video; their number."""
    names = sorted(n for n in os.listdir(folder) if n.startswith("frame-") and n.endswith(".png"))
    if not names:
        raise MediaError(f"no frames in {folder}")

    def pixels() -> Iterator[bytes]:
        for n in names:
            with open(os.path.join(folder, n), "rb") as f:
                yield decode_png(f.read())[:, :, :3].tobytes()

    with open(os.path.join(folder, names[0]), "rb") as f:
        height, width = decode_png(f.read()).shape[:2]
    return encode_rgb(pixels(), width, height, fps, out, program)


def encode_rgb(frames: Iterator[bytes], width: int, height: int, fps: int, out: str, program: str | None = None) -> int:
    """RGB24 frames to a video; gives the number of frames."""
    size, n = width * height * 3, 0
    args = [find_program(explicit=program), "-y", "-f", "rawvideo", "-pix_fmt", "rgb24", "-s", f"{width}x{height}", "-r", str(fps), "-i", "-", *ENCODE, out]
    with subprocess.Popen(args, stdin=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:  # noqa: S603
        for f in frames:
            if len(f) != size:
                raise MediaError(f"a frame has {len(f)} bytes instead of {size}")
            p.stdin.write(f)
            n += 1
        p.stdin.close()
        if p.wait():
            raise MediaError("encoding failed")
    return n


def concatenate(inputs: Sequence[str], out: str, fps: int, program: str | None = None) -> None:
    """One video of several: copied if that keeps the frames evenly spaced,
    otherwise encoded at a constant rate.  One input is a plain copy."""
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    if len(inputs) == 1:
        shutil.copyfile(inputs[0], out)
        return
    tool, names = find_program(explicit=program), f"{out}.txt"
    with open(names, "w") as f:
        f.writelines("file '" + os.path.abspath(i).replace("'", "'\\''") + "'\n" for i in inputs)
    try:
        base = [tool, "-y", "-f", "concat", "-safe", "0", "-i", names]
        _run([*base, "-c", "copy", out])
        made = probe_mp4(read_moov(out))
        if any(abs(t - i / fps) > PTS_TOLERANCE for i, t in enumerate(made["pts"])):
            # no frames out of order, evenly spaced on a scale that frames divide
            even = ["-bf", "0", "-vf", f"setpts=N/({fps}*TB)", "-video_track_timescale", str(fps * 512)]
            _run([*base, *passthrough_rate(tool), *ENCODE, *even, out])
    finally:
        os.remove(names)


def extract(source: str, out: str, start: float, stop: float, program: str | None = None) -> None:
    """A part of a video by stream copy, aligned to key frames."""
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    _run([find_program(explicit=program), "-y", "-ss", f"{start:.6f}", "-to", f"{stop:.6f}", "-i", source, "-c", "copy", out])


def make_videos(plan: DataFrame, fps: int, program: str | None = None) -> DataFrame:
    """Makes the videos of a plan, one task each; gives output and n_inputs.

    ``plan`` has output, ordinal, input, start and stop (null for the whole
    file).  A video of one whole file is a copy and needs no program.
    """

    def make(key: tuple, table: pa.Table) -> pa.Table:
        out = local(key[0].as_py())
        rows = sorted(zip(*(table[c].to_pylist() for c in ("ordinal", "input", "start", "stop"))), key=lambda r: r[0])
        parts, cut = [], []
        try:
            for ordinal, path, start, stop in rows:
                if stop is None:
                    parts.append(local(path))
                    continue
                piece = f"{out}.{ordinal}.mp4"
                extract(local(path), piece, start, stop, program)
                parts.append(piece)
                cut.append(piece)
            concatenate(parts, out, fps, program)
        finally:
            for piece in cut:
                if os.path.exists(piece):
                    os.remove(piece)
        return pa.table({"output": [key[0].as_py()], "n_inputs": pa.array([len(rows)], pa.int64())})

    return plan.select("output", "ordinal", "input", "start", "stop").groupBy("output").applyInArrow(make, "output string, n_inputs bigint")
