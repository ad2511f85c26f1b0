"""Command line: ``python -m standscan.plans.cli COMMAND``. Every command is one entry of ``COMMANDS``."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from typing import NamedTuple

from standscan.plans import config as configs

log = logging.getLogger("standscan")
SPLITS = ("train", "val", "test")


class Command(NamedTuple):
    """What a command does, with a session and its arguments, and its arguments by flag."""

    work: Callable
    flags: dict[str, dict]
    help: str


def _report(value) -> None:
    log.info(value if isinstance(value, str) else json.dumps(value))


def _log_to(folder: str) -> None:
    """Messages go to the screen and to ``log.txt`` in ``folder``."""
    os.makedirs(folder, exist_ok=True)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", handlers=[logging.StreamHandler(), logging.FileHandler(os.path.join(folder, "log.txt"))], force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def _stages(*names: str) -> Callable:
    """Run the named stages of the pipeline on one configuration; a training's run is what is evaluated."""

    def work(spark, args) -> None:
        from standscan.plans import pipeline

        config, run = configs.load(args.config, args.set), getattr(args, "checkpoint", None)
        _log_to(config["work_dir"])
        for name in names:
            stage = getattr(pipeline, name)
            done = stage(spark, run, getattr(args, "split", "test"), config["infer"]) if name == "evaluate" else stage(spark, config)
            run = done if name == "train" else run
            if isinstance(done, (dict, str)):
                _report(done)

    return work


def _predict(spark, args) -> None:
    from standscan.plans import pipeline

    _log_to(os.path.dirname(os.path.abspath(args.output)))
    _report(pipeline.predict(spark, args.checkpoint, args.input, args.output, args.full_resolution, args.set))


def _render(spark, args) -> None:
    from standscan.operators.render import render
    from standscan.sources.clouds import read_cloud

    instances = spark.read.csv(args.instances, header=True, inferSchema=True) if args.instances else None
    render(read_cloud(spark, args.input), args.field, args.output, classes=args.classes, instances=instances)


def _register(spark, args) -> None:
    from standscan.plans import demo

    _report(demo.register_files(spark, args.annotations, args.target, args.output, args.voxel))


def _demo(spark, args) -> None:
    from standscan.plans import demo

    _log_to(args.output_dir)
    _report(demo.run_demo(spark, args.output_dir, texts=args.set))


MUST = {"required": True}
SET = {"--set": {"nargs": "*", "default": [], "metavar": "a.b=value"}}
CONFIG = {"--config": MUST} | SET
EVALUATE = {"--checkpoint": MUST, "--split": {"default": "test", "choices": SPLITS}}
COMMANDS = {
    "run": Command(_stages("extract", "pseudolabel", "split_scenes", "train", "evaluate"), CONFIG, "all stages"),
    "extract": Command(_stages("extract"), CONFIG, "features of unlabelled clouds"),
    "pseudolabel": Command(_stages("pseudolabel"), CONFIG, "labels by rules"),
    "split": Command(_stages("split_scenes"), CONFIG, "train, validation and test scenes"),
    "train": Command(_stages("train"), CONFIG, "fit the model"),
    "evaluate": Command(_stages("evaluate"), CONFIG | EVALUATE, "scores against labels and reference"),
    "predict": Command(_predict, {"--checkpoint": MUST, "--input": MUST | {"nargs": "+"}, "--output": MUST, "--full-resolution": {"action": "store_true"}} | SET, "label new clouds"),
    "render": Command(_render, {"--input": MUST, "--field": {"default": "pred"}, "--output": MUST, "--classes": {"nargs": "*"}, "--instances": {}}, "an image of a cloud"),
    "register": Command(_register, {"--annotations": MUST | {"nargs": "+"}, "--target": MUST, "--output": MUST, "--voxel": {"type": float, "default": 0.03}}, "align annotations to a cloud"),
    "demo": Command(_demo, {"--output-dir": {"default": "work/demo"}} | SET, "all of it on synthetic plots"),
}
SHORT = {"--config": "-c"}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="standscan", description="Label-free segmentation of forest point clouds on Spark.")
    choices = parser.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        own = choices.add_parser(name, help=command.help)
        for flag, options in command.flags.items():
            own.add_argument(*([SHORT[flag]] if flag in SHORT else []), flag, **options)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from standscan.session import build_session

    COMMANDS[args.command].work(build_session(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
