"""init, build and serve from a terminal."""

from __future__ import annotations

import os
import sys

from tokenloom import detect
from tokenloom.config import load_config
from tokenloom.plans import contract as contracts
from tokenloom.server import Server
from tokenloom.session import get_spark
from tokenloom.streaming.watch import Watcher, publish, versions_of

USAGE = """usage:
  tokenloom init  [dir]     look at the project and write a configuration
  tokenloom build [config]  scan the sources, reconcile them and write the contract
  tokenloom serve [config]  answer requests over the contract"""


def build(config_path: str | None = None) -> dict:
    config = load_config(config_path)
    path = os.path.abspath(config_path or "tokenloom.config.json")
    spark = get_spark("tokenloom-build")
    sources, failed = contracts.scan(spark, config)
    parts = contracts.build(sources, config.sourceOfTruth)
    contracts.write(parts, [n for n, _, _ in sources], os.path.dirname(path), path, config.outputPath)
    publish(config.outputPath, versions_of(config.outputPath))
    document = contracts.load(config.outputPath)
    print(contracts.report(document, failed, contracts.source_counts(sources)))
    return document


def serve(config_path: str | None = None) -> None:
    """Answer the tool protocol over standard input and output until the input ends; each build's contract takes the last one's place."""
    config = load_config(config_path)
    server = Server(config.outputPath, watched=True)
    folder = versions_of(config.outputPath)
    watcher = Watcher(get_spark("tokenloom-serve"), folder, f"{folder}/.followed", server.take, "100 milliseconds")
    try:
        watcher.start()
        server.run(sys.stdin, sys.stdout)
    finally:
        watcher.stop()


def main(args: list[str]) -> int:
    try:
        match args:
            case ["init", *rest]:
                print(detect.init(rest[0] if rest else os.getcwd()))
            case ["build", *rest]:
                build(*rest[:1])
            case ["serve", *rest]:
                serve(*rest[:1])
            case _:
                print(USAGE)
    except Exception as e:  # noqa: BLE001  the terminal gets the message and the status
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
