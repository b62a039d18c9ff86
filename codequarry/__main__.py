"""The indexer as a command: ``python -m codequarry --root DIR --home DIR [--full] [--since REVISION] [--config FILE]``.

Prints the outcome of the run. Ends with 1 if files could not be parsed, with 2 if the run failed.
"""

from __future__ import annotations

import argparse
import datetime
import sys
from functools import partial

from codequarry.api import Engine
from codequarry.config import Settings, load_settings
from codequarry.session import get_spark
from codequarry.sources.tree import revision_diff


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codequarry", description="Brings an index up to a source tree.")
    parser.add_argument("--root", required=True, help="the source tree")
    parser.add_argument("--home", required=True, help="the folder of the index")
    parser.add_argument("--full", action="store_true", help="parse every file again")
    parser.add_argument("--since", help="look only at what changed since this revision")
    parser.add_argument("--config", help="a JSON file of settings")
    given = parser.parse_args(argv)
    try:
        settings = load_settings(given.config) if given.config else Settings()
        spark = get_spark("codequarry-index")
        diff = partial(revision_diff, spark, given.root, given.since) if given.since else None
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
        outcome = Engine(spark, given.home, settings).index(given.root, now, given.full, diff, progress=lambda m: print(m, file=sys.stderr))
        counts = {r["change"]: r["n"] for r in outcome.collect()}
    except Exception as e:  # noqa: BLE001 - the exit code tells
        print(f"failed: {e}", file=sys.stderr)
        return 2
    print(" ".join(f"{k}={counts[k]}" for k in sorted(counts)) or "nothing to do")
    return 1 if counts.get("error") else 0


if __name__ == "__main__":
    sys.exit(main())
