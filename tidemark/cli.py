"""Commands.

list PATH: the videos with a telemetry file, numbered. analyze PATH [--select a|0,2] [--dry-run] [--metadata]: the sidecar metadata of the
chosen inspections and what it lacks; --dry-run only checks, otherwise the inspections are printed as they would be stored; --metadata shows all
fields. clear TABLES OUT (IDS... | --all) [--similarities]: tables without inspections, or without their similarities and clusters.
similarities FEATURES OUT: enrichment.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.operators.contextualise import contextualise
from tidemark.runtime import table
from tidemark.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list").add_argument("path")
    an = sub.add_parser("analyze")
    an.add_argument("path")
    an.add_argument("--select", default="a", help="a for all, or places in the list, with commas")
    an.add_argument("--dry-run", action="store_true")
    an.add_argument("--metadata", action="store_true")
    c = sub.add_parser("clear")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("inspections", type=int, nargs="*")
    c.add_argument("--all", action="store_true")
    c.add_argument("--similarities", action="store_true")
    s = sub.add_parser("similarities")
    s.add_argument("path")
    s.add_argument("out")
    return p


def chosen(selection: str, place: int) -> bool:
    """Whether a place in a list is among the selected: a for all, or places with commas between."""
    return selection.strip() == "a" or str(place) in selection.replace(" ", "").split(",")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "list":
        for i, r in enumerate(store.video_files(spark, a.path).toLocalIterator()):
            print(f"{i:<3}{r.path}\t{r.size / 1e6:.2f} MB")
    elif a.command == "analyze":
        bad = 0
        for i, r in enumerate(store.metadata(spark, a.path).orderBy("inspection_id", "ship_name").toLocalIterator()):
            if chosen(a.select, i):
                bad += bool(r.missing)
                print(f"{i:<3}{r.ship_name}\t{r.inspection_date}\t{r.inspection_id}\tmissing: {', '.join(r.missing) or 'nothing'}")
                if a.metadata or not a.dry_run:
                    print("\t".join(f"{k}={v}" for k, v in r.asDict().items()))
        return int(bad > 0)
    elif a.command == "clear":
        if not a.all and not a.inspections:
            raise SystemExit("clear needs inspections or --all")
        names = {"inspections": "inspections", "frames": "frames", "clusters": "clusters", "in_cluster": "in_cluster", "similar": "similar_frames"}
        t = {k: table(spark, a.path, n) for k, n in names.items()}
        if a.similarities:
            left = store.delete_context(t, None if a.all else a.inspections)
        elif a.all:
            left = {k: store.truncate(d) for k, d in t.items()}
        else:
            left = store.delete_inspections(t, spark.createDataFrame([(i,) for i in a.inspections], "inspection_id int"))
        store.save_all({names[k]: d for k, d in left.items()}, a.out)
    else:
        for k, d in contextualise(spark.read.parquet(a.path)).items():
            store.save(d, f"{a.out}/{k}.parquet", mode="overwrite")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
