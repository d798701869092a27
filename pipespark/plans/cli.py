"""Command line: run, validate and explain a YAML pipeline."""

from __future__ import annotations

import argparse
import dataclasses
import sys
import time
from pathlib import Path

from ..errors import PipelineError
from .compiler import compile_plan, replays, run_plan
from .config import EngineConfig
from .estimate import estimate_work
from .manifest import RunManifest, plan_hash
from .yaml_dsl import parse_yaml


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pipespark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("run", "execute a pipeline"), ("validate", "check a pipeline without running it"), ("explain", "show the plan of a pipeline")):
        c = commands.add_parser(name, help=what)
        c.add_argument("-p", "--pipeline", type=Path, required=True)
        c.add_argument("--compat", action="store_true", help="comparisons never give null")
        if name == "validate":
            continue
        c.add_argument("--memory-cap", dest="mem_cap_bytes", type=int)
        if name == "run":
            c.add_argument("--max-parallel", dest="max_parallel_tasks", type=int)
            c.add_argument("--manifest", type=Path, help="where to write the run's manifest")
            c.add_argument("--replay", type=Path, help="a manifest; instead of running, say whether plan, inputs and output are as it recorded them")
            for f in dataclasses.fields(EngineConfig):
                if f.name.startswith("spill_"):
                    c.add_argument("--" + f.name.replace("_", "-"), dest=f.name)
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        parsed = parse_yaml(args.pipeline.read_text())
        if args.command == "validate":
            print(f"Pipeline is valid: {len(parsed.plan.steps)} steps")
            return 0
        names = {f.name for f in dataclasses.fields(EngineConfig)}
        config = EngineConfig.layered(parsed.config, {k: v for k, v in vars(args).items() if k in names})
        spark = config.session()
        if args.command == "run" and args.replay:
            same = replays(spark, RunManifest.from_json(args.replay.read_text()), parsed.plan)
            print(" ".join(f"{k}: {'same' if v else 'changed'}" for k, v in same.items()))
            return 0 if all(same.values()) else 1
        if args.command == "run":
            begun = time.time()
            manifest, _ = run_plan(spark, parsed.plan, args.compat)
            if args.manifest:
                args.manifest.write_text(manifest.to_json())
            print(f"Pipeline finished in {time.time() - begun:.2f} s")
            print(f"Plan hash: {manifest.plan_hash}")
            return 0
        work = estimate_work(parsed.plan)
        print(f"Memory cap: {config.mem_cap_bytes} bytes")
        print(f"Work estimate: {work.total_rows} rows, {work.total_bytes} bytes, fan-in {work.max_fan_in}")
        print(f"Plan hash: {plan_hash(parsed.plan)}")
        for i, s in enumerate(parsed.plan.steps, 1):
            print(f"  {i}. {type(s).__name__}")
        compile_plan(spark, parsed.plan, args.compat).explain("formatted")
        return 0
    except (PipelineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
