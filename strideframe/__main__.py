"""Command line: run the clip pipeline over stored tables, show clips, devices and backends.

    python -m strideframe run CLIPS DETECTIONS [-o OUT] [-c SETTINGS.yaml] [--profile P] [--start S] [--end S] [--goal-posts "x,y" "x,y"] [--gk-track N]
    python -m strideframe probe CLIPS
    python -m strideframe devices | backends
"""

from __future__ import annotations

import argparse
import os
import time

from strideframe.operators import clips
from strideframe.plans.config import Config
from strideframe.sources import backends


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strideframe")
    sub = out.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("clips")
    run.add_argument("detections")
    run.add_argument("-o", "--output", help="instead of the directory that the settings name")
    run.add_argument("-c", "--config")
    run.add_argument("--format", action="append", help="instead of the formats that the settings name")
    run.add_argument("--profile", choices=[p[0] for p in clips.PROFILES])
    run.add_argument("--start", type=float)
    run.add_argument("--end", type=float)
    run.add_argument("--goal-posts", nargs=2, metavar="X,Y")
    run.add_argument("--gk-track", type=int)
    sub.add_parser("probe").add_argument("clips")
    sub.add_parser("devices")
    sub.add_parser("backends")
    return out


def settings(args: argparse.Namespace) -> Config:
    """The settings file with what the command line says on top; posts or a track ask for the keeper."""
    config = Config.load(args.config) if args.config else Config()
    config.video.profile = args.profile or config.video.profile
    config.video.start_s = args.start if args.start is not None else config.video.start_s
    config.video.end_s = args.end if args.end is not None else config.video.end_s
    if args.goal_posts:
        config.goalkeeper.goal_posts = [[float(v) for v in p.split(",")] for p in args.goal_posts]
    if args.gk_track is not None:
        config.goalkeeper.track_id, config.goalkeeper.identification = args.gk_track, "manual"
    config.output.directory = args.output or config.output.directory
    config.goalkeeper.enabled |= bool(args.goal_posts) or args.gk_track is not None
    return config


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "devices":
        for key, system, _, fov, shutter, profile in clips.DEVICES:
            print(f"{key}: {system}, field of view {fov:g}, rolling shutter {shutter}, profile {profile}")
        return
    if args.command == "backends":
        for name, there in backends.listing():
            print(f"{name}: {'available' if there else 'not part of the engine'}")
        return
    from pyspark.sql import SparkSession

    from strideframe.plans import pipeline
    from strideframe.sources import readers, sinks, store
    from strideframe.streaming import progress

    spark = SparkSession.builder.appName("strideframe").getOrCreate()
    known = readers.read(spark, "clips", args.clips)
    if args.command == "probe":
        clips.with_advice(clips.with_profile(known)).select("clip_id", "display_width", "display_height", "fps", "device", "profile", "frame_stride", "warnings", "tips").show(truncate=False)
        return
    config = settings(args)
    out = pipeline.run(known, readers.read(spark, "detections", args.detections), config)
    out.tracked = store.stored(out.tracked, "tracked")  # what is written, summed up and measured is tracked once
    target = f"{config.output.directory}/{sinks.run_name(os.path.basename(args.clips.rstrip('/')) or 'run')}"
    took = {}
    for name in ("tracked", "pitch", "kicks", "contacts", "keepers", "uncertain", "dives", "report"):
        table = getattr(out, name)
        if table is not None:
            began = time.perf_counter()
            write = lambda: sinks.write_all({name: table}, target, args.format or config.output.formats)  # noqa: B023, E731
            for problem in progress.reported(spark, write, lambda share, text: print(f"{share:4.0%} {text}"), name, 2.0):
                print(problem)
            took[name] = time.perf_counter() - began
            print(f"{name} written")
    if config.output.report:
        sinks.write(out.summary().select("text"), f"{target}/summary", "text")
    out.release()
    print(f"{sum(took.values()):.1f}s total ({', '.join(f'{k} {v:.1f}s' for k, v in took.items())})")


if __name__ == "__main__":
    main()
