"""Command line of experiment grids: run pending jobs, adapt approaches, show progress, list shell lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.grid import Grid


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="veldra")
    p.add_argument("command", choices=["run", "adapt", "progress", "commands"])
    p.add_argument("--grid", required=True, help="the grid's root")
    p.add_argument("--dataset")
    p.add_argument("--approach")
    p.add_argument("--seed", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    grid = Grid.open(spark, a.grid)
    if a.command == "run":
        print(grid.run(spark, -1, a.dataset, a.approach, a.seed), "jobs done")
    elif a.command == "adapt":
        print(grid.adapt(spark), "states made")
    elif a.command == "progress":
        grid.progress(spark).show(truncate=False)
    else:
        print("\n".join(grid.commands(spark)))


if __name__ == "__main__":
    main()
