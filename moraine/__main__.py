"""python -m moraine VERB: the lake's verbs on the command line.  Exit 2 if anything was lost or is damaged."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import functions as L
from .plans.lake import Lake, ordered
from .sources.archives import create_zips, extract, extract_folders, read_archives, scan

#: What of a report is shown; the rest is counted.
UNITS_SHOWN, FILES_SHOWN, LISTED = 10, 20, 10_000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="moraine", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, alias: str, *names: str, **flags: dict) -> None:
        sub = verbs.add_parser(name, aliases=[alias] if alias else [])
        sub.set_defaults(verb=name)
        for x in names:
            sub.add_argument(x.rstrip("*+"), **({"nargs": x[-1]} if x[-1] in "*+" else {}))
        for flag, options in flags.items():
            sub.add_argument(f"--{flag.replace('_', '-')}", **options)

    top.add_argument("-j", "--jobs", type=int, help="shuffle partitions, so tasks, of one step")
    top.add_argument("--full", action="store_true", help="use the cluster's own degree of parallelism (as without -j)")
    level = {"choices": ["fast", "normal", "max"], "default": "normal"}
    verb("create", "c", "root", "inputs+", level=level)
    verb("add", "a", "root", "inputs+")
    verb("extract", "x", "root", "target", "selectors*", force={"action": "store_true"}, skip_existing={"action": "store_true"})
    verb("list", "l", "root", sort={"choices": ["path", "size", "stored", "solid", "dir"], "default": "path"}, descending={"action": "store_true"})
    verb("remove", "rm", "root", "selectors+")
    verb("rename", "mv", "root", "source", "target")
    verb("test", "t", "root")
    verb("compact", "", "root")
    verb("info", "", "root", units={"action": "store_true"})
    return top


def _show(rows, limit: int) -> None:
    """The first rows, and how many more there are."""
    rows.show(limit, truncate=False)
    more = rows.count() - limit
    if more > 0:
        print(f"\u2026 and {more} more")


def _entries(spark: SparkSession, inputs: list[str]):
    out = None
    for x in inputs:
        part = scan(spark, x)
        out = part if out is None else out.unionByName(part)
    return out


def run(spark: SparkSession, given: list[str]) -> int:
    a = parser().parse_args(given)
    if a.jobs and not a.full:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.jobs))
    if a.verb == "create" and a.root.endswith(".zip"):
        folder, name = a.root.rsplit("/", 1)
        entries = _entries(spark, a.inputs).where("not dir").withColumn("archive", F.lit(name))
        create_zips(entries, folder, a.level).show(truncate=False)
        return 0
    foreign = a.verb in ("list", "extract", "add") and a.root.rsplit(".", 1)[-1].lower() in ("zip", "7z", "rar")
    if foreign:
        members = read_archives(spark, a.root)
        if a.verb == "add":
            raise SystemExit("foreign archives are read and created, not changed")
        if a.verb == "list":
            _show(members.select("path", "size", "why"), LISTED)
            return 2 if members.where("path = ''").count() else 0
        outcomes = extract(members.select("path", "content", "why"), a.target, "force" if a.force else "skip" if a.skip_existing else "fail")
        return _report(outcomes)
    lake = Lake.create(spark, a.root, a.level) if a.verb == "create" else Lake(spark, a.root)
    if lake.damage:
        print(f"damaged: generation {lake.damage['lost']} can't be read; showing {lake.damage['opened']}", file=sys.stderr)
    if a.verb in ("create", "add"):
        print(lake.add(_entries(spark, a.inputs)))
    elif a.verb == "list":
        rows = lake.listing()
        _show(ordered(rows, a.sort, a.descending).select(L.human(F.col("size")).alias("size"), L.human(F.col("stored")).alias("stored"), "path"), LISTED)
        rows.where("not dir").agg(F.sum("size").alias("size"), F.sum("stored").alias("stored"), F.count(F.lit(1)).alias("files")).show()
    elif a.verb == "remove":
        print(lake.remove(a.selectors))
    elif a.verb == "rename":
        print(lake.rename(a.source, a.target))
    elif a.verb == "compact":
        print(*map(str, lake.compact()))
    elif a.verb == "info":
        lake.info().show(truncate=False)
        if a.units:
            _show(lake.unit_report().orderBy("unit"), LISTED)
    elif a.verb == "test":
        totals, lost = lake.test()
        totals.show()
        lost = lost.orderBy("file_pos")
        _show(lost, FILES_SHOWN)
        _show(lake.bad_units(), UNITS_SHOWN)
        return 2 if not lost.isEmpty() or lake.damage else 0
    elif a.verb == "extract":
        outcomes = extract(lake.contents(a.selectors or None).drop("size", "pos"), a.target, "force" if a.force else "skip" if a.skip_existing else "fail")
        lost = _report(outcomes)
        extract_folders(lake.folders(a.selectors or None), a.target)
        return max(lost, 2 if lake.damage else 0)
    return 2 if lake.damage else 0


def _report(outcomes) -> int:
    counts = {r.outcome if r.outcome in ("written", "skipped") else "lost": r.n for r in outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    print(counts)
    return 2 if "lost" in counts else 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("moraine").getOrCreate(), sys.argv[1:]))
