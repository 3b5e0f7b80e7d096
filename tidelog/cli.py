"""Command line: validate releases and bundles, and score a bundle anew.

Errors of the input go to standard error in one line, with exit status 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from tidelog import __version__


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidelog").getOrCreate()


def _release(args):
    from tidelog.sources.release import Release

    return Release(args.release).validate(_session())


def _bundle(args):
    from tidelog.sources.bundle import RunBundle

    return RunBundle(args.bundle).validate(_session())


def _score(args):
    from tidelog.plans.score import score_bundle

    return score_bundle(_session(), args.bundle, profile=args.scoring_profile, judge_mode=args.judge)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelog")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--debug", action="store_true", help="show a traceback")
    parts = top.add_subparsers(required=True)
    data = parts.add_parser("data").add_subparsers(required=True).add_parser("validate")
    data.add_argument("--release", required=True)
    data.set_defaults(run=_release)
    bundle = parts.add_parser("bundle").add_subparsers(required=True).add_parser("validate")
    bundle.add_argument("bundle")
    bundle.set_defaults(run=_bundle)
    score = parts.add_parser("score")
    score.add_argument("bundle")
    score.add_argument("--scoring-profile", choices=("legacy", "paper-v1"), help="instead of the profile that the bundle was frozen with")
    score.add_argument("--judge", choices=("exact", "auto"), default="exact")
    score.set_defaults(run=_score)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(json.dumps(args.run(args), indent=2, sort_keys=True, default=str))
    except (OSError, ValueError) as e:
        if args.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
