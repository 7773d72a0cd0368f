"""Command line: validate, convert, create, merge, version."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import uuid

from pyspark.sql import SparkSession

from . import __version__
from .functions.features import parse_features, parse_stats_mode
from .functions.layout import parse_version
from .plans import build, validate, writer
from .sources import media
from .sources.dataset import Dataset, load_info, read_dataset
from .sources.files import listing

OK, FAILED, USAGE = 0, 1, 2


def clean_path(path: str) -> str:
    if not path.strip():
        raise ValueError("empty path")
    return os.path.normpath(os.path.expanduser(path.strip()))


def distinct_paths(paths: list[str]) -> list[str]:
    return list(dict.fromkeys(clean_path(p) for p in paths))


def check_output(path: str, force: bool, inputs: list[str]) -> None:
    """An output must be apart from every input, and empty unless forced."""
    out = os.path.realpath(path)
    for i in inputs:
        at = os.path.realpath(i)
        if out == at or os.path.commonpath([out, at]) in (out, at):
            raise ValueError(f"output {path} and input {i} are in each other")
    if os.path.isdir(path) and os.listdir(path) and not force:
        raise FileExistsError(f"{path} is not empty; use --force")


def write_beside(made: Dataset, path: str) -> None:
    """Writes to a folder beside the output and swaps it in when complete, so
    that what was there survives a failed run."""
    out = os.path.abspath(path)
    fresh, old = f"{out}.new-{uuid.uuid4().hex}", f"{out}.old-{uuid.uuid4().hex}"
    try:
        build.save(made, fresh)
        if os.path.lexists(out):
            os.replace(out, old)
        os.replace(fresh, out)
    except BaseException:
        if os.path.lexists(old) and not os.path.lexists(out):
            os.replace(old, out)
        shutil.rmtree(fresh, ignore_errors=True)
        raise
    shutil.rmtree(old, ignore_errors=True)


def _session() -> SparkSession:
    return SparkSession.builder.appName("framelake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _show(report: validate.Report, as_json: bool) -> int:
    if as_json:
        print(json.dumps({"ok": report.ok, "version": report.version, "summary": report.summary, "n_errors": report.count(validate.ERROR), "n_warnings": report.count(validate.WARNING), "errors": report.errors, "warnings": report.warnings}, indent=2))
    else:
        for severity, _, _, message in report.problems:
            print(f"{severity}: {message}")
        hidden = sum(report.counts.values()) - len(report.problems)
        if hidden:
            print(f"{hidden} more: {report.count(validate.ERROR)} errors, {report.count(validate.WARNING)} warnings in all")
        print(report.summary or "not valid")
    return OK if report.ok else FAILED


def _preflight(spark: SparkSession, root: str) -> None:
    report = validate.validate(spark, root, strict=True)
    if not report.ok:
        raise ValueError(f"{root}: {report.errors[0]}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framelake")
    p.add_argument("--json", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true", help="show Spark's messages")
    p.add_argument("--ffmpeg-path", help="the program for videos")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("root")
    v.add_argument("--strict", action=argparse.BooleanOptionalAction, default=True)
    v.add_argument("--tree", action="store_true")
    sub.add_parser("version")
    sub.add_parser("completion", help="a completion script for bash")

    def limits(x: argparse.ArgumentParser) -> None:
        x.add_argument("-o", "--output", required=True)
        x.add_argument("--force", action="store_true")
        x.add_argument("--data-file-size-mb", type=int, default=100)
        x.add_argument("--video-file-size-mb", type=int, default=200)
        x.add_argument("--chunks-size", type=int, default=1000)

    c = sub.add_parser("convert")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("--to", required=True)
    c.add_argument("--from", dest="source")
    limits(c)
    m = sub.add_parser("merge")
    m.add_argument("-i", "--input", action="append", default=[])
    m.add_argument("--to", required=True)
    m.add_argument("inputs", nargs="*")
    limits(m)
    n = sub.add_parser("create")
    source = n.add_mutually_exclusive_group(required=True)
    source.add_argument("--steps", help="parquet of raw steps")
    source.add_argument("--staging", help="folder of staged episodes")
    n.add_argument("--stats-mode", default="sampled", help="sampled, full or none")
    n.add_argument("--episodes-per-file", type=int, default=0)
    n.add_argument("--version", required=True)
    n.add_argument("--features", required=True)
    n.add_argument("--fps", type=int, required=True)
    n.add_argument("--robot-type")
    n.add_argument("--episode", default="episode")
    n.add_argument("--order", default="step")
    n.add_argument("--task", default="task")
    limits(n)
    return p


def completion() -> str:
    """A bash function that completes commands, options and paths."""
    actions = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    words = {name: " ".join(o for a in sub._actions for o in a.option_strings) for name, sub in actions.items()}
    cases = "\n".join(f'    {name}) words="{w}" ;;' for name, w in words.items())
    return f"""_framelake() {{
  local words="{' '.join(actions)}"
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}") $(compgen -f -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _framelake framelake"""


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return OK
    if args.command == "completion":
        print(completion())
        return OK
    try:
        return _run(args)
    except (ValueError, OSError) as e:
        print(f"framelake: {e}", file=sys.stderr)
        return FAILED


def _run(args: argparse.Namespace) -> int:
    spark = _session()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    if args.ffmpeg_path:
        media.use_program(args.ffmpeg_path)
    if args.command == "validate":
        root = clean_path(args.root)
        code = _show(validate.validate(spark, root, strict=args.strict), args.json)
        if args.tree:
            for r in listing(spark, root).orderBy("path").toLocalIterator():
                print(f"{r['length']:>12} {r['path']}")
        return code
    out = clean_path(args.output)
    limits = {"data_files_size_in_mb": args.data_file_size_mb, "video_files_size_in_mb": args.video_file_size_mb, "chunks_size": args.chunks_size}
    if args.command == "convert":
        root = clean_path(args.input)
        check_output(out, args.force, [root])
        if args.source and parse_version(args.source) != parse_version(load_info(root).codebase_version):
            raise ValueError(f"{root} is not {args.source}")
        _preflight(spark, root)
        made = build.convert(read_dataset(spark, root), args.to, **limits)
    elif args.command == "merge":
        roots = distinct_paths([*args.input, *args.inputs])
        if len(roots) < 2:
            raise ValueError("at least two inputs are needed")
        check_output(out, args.force, roots)
        for r in roots:
            _preflight(spark, r)
        made = build.union([read_dataset(spark, r) for r in roots], args.to, **limits)
    else:
        check_output(out, args.force, [clean_path(args.steps or args.staging)])
        with open(args.features) as f:
            features = parse_features(f.read())
        options = {"version": args.version, "robot_type": args.robot_type, "stats_mode": parse_stats_mode(args.stats_mode), "episodes_per_file": args.episodes_per_file, **limits}
        if args.staging:
            made = writer.from_staging(spark, clean_path(args.staging), features, args.fps, **options)
        else:
            made = build.build(spark.read.parquet(args.steps), features, args.fps, episode=args.episode, order=args.order.split(","), task=args.task, **options)
    write_beside(made, out)
    return _show(validate.validate(spark, out, strict=True), args.json)


if __name__ == "__main__":
    sys.exit(main())
