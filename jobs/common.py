"""What the command lines of the jobs share: a configuration file, overrides, logging, a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

LOG = "%(asctime)s %(name)s %(message)s"


def settings(defaults: dict, about: str, args: list[str] | None = None) -> dict:
    """``defaults``, then the JSON file of ``--config``, then ``--name value`` of any setting."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file with any of the settings")
    for name, value in defaults.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value) if value is not None else str, default=None)
    given = vars(parser.parse_args(args))
    out = dict(defaults)
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        if unknown := own.keys() - defaults.keys():
            parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= own
    out |= {k: v for k, v in given.items() if v is not None}
    if empty := [k for k, v in out.items() if v == ""]:
        parser.error(f"no value for: {', '.join(empty)}")
    return out


def main(name: str, job: Callable, defaults: dict, about: str) -> None:
    """Run ``job(session, **settings)`` in a session of its own."""
    from pyspark.sql import SparkSession

    from quarry.plans.ship import ship

    logging.basicConfig(level=logging.INFO, format=LOG)
    own = settings(defaults, about)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        ship(spark)
        job(spark, **own)
    finally:
        spark.stop()
