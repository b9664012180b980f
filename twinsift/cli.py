"""``python -m twinsift scan|hidden|cache``: 0 on success, 2 on wrong use, 130 when interrupted."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import human_size
from .job import Job
from .operators import exact, hidden, similar, view
from .scan import exact_scan, hidden_scan, similar_scan
from .sources import perceptual, report, settings, snapshot, tree

VERSION = "0.2"


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinsift")
    top.add_argument("--version", action="version", version=f"twinsift {VERSION}")
    commands = top.add_subparsers(dest="command")
    scan = commands.add_parser("scan", help="exact duplicates, and similar images on demand")
    scan.add_argument("path")
    for flag, text in (
        ("--json", "print one JSON document"), ("--paranoid", "compare the bytes of equal digests"),
        ("--no-cache", "neither read nor write the hash snapshot"), ("--no-hidden", "leave hidden names out"),
        ("--follow-symlinks", "walk through links"), ("--cross-filesystems", "walk into other file systems"),
        ("--similar", "search for similar images too"),
    ):
        scan.add_argument(flag, action="store_true", help=text)
    scan.add_argument("--threshold", help="strict, normal, loose or 0 to 16 bits")
    scan.add_argument("--min-size", type=int)
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--protect", action="append", default=[])
    hide = commands.add_parser("hidden", help="hidden and temporary items")
    hide.add_argument("path")
    hide.add_argument("--json", action="store_true")
    hide.add_argument("--no-temp-patterns", action="store_true", help="only names that begin with a dot or a tilde")
    cache = commands.add_parser("cache", help="count or clear the hash snapshot")
    cache.add_argument("action", choices=("count", "clear"))
    cache.add_argument("folder", nargs="?")
    return top


def _cache_folder(spark: SparkSession) -> str:
    """In the user's cache; on a cluster in the folder that driver and executors share."""
    if not spark.sparkContext.master.startswith("local"):
        return f"{similar.ensure_checkpoints(spark).rsplit('/', 1)[0]}/twinsift-hashes"
    return os.path.join(settings.home_of("XDG_CACHE_HOME"), "hashes")


def _folder(path: str) -> str:
    if not os.path.isdir(path):
        raise ValueError(f"not a directory: {path}")
    return os.path.abspath(path)


def _say(text: str) -> None:
    print(f"twinsift: {text}", file=sys.stderr)


def _scan(spark: SparkSession, args: argparse.Namespace) -> None:
    """What the settings say, and what the command line adds to it."""
    root = _folder(args.path)
    own, warnings = settings.load(os.path.join(settings.home_of("XDG_CONFIG_HOME"), "settings.toml"))
    for warning in warnings:
        _say(f"warning: {warning}")
    threshold = own.similarity_threshold if args.threshold is None else similar.parse_threshold(args.threshold)
    options = tree.TreeOptions(
        own.min_size if args.min_size is None else args.min_size, own.include_hidden and not args.no_hidden,
        own.follow_symlinks or args.follow_symlinks, own.cross_filesystems or args.cross_filesystems, (*own.exclude, *args.exclude),
    )
    protected = (*own.protected_folders, *map(os.path.abspath, args.protect))
    cache = _cache_folder(spark) if own.use_cache and not args.no_cache else None
    job = Job(spark)
    # on a thread of its own, so that an interrupt can stop its Spark jobs and still get what is known
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(exact_scan, spark, root, options, protected, cache, own.paranoid or args.paranoid, job)
        try:
            found = running.result()
        except KeyboardInterrupt:
            job.cancel()
            found = running.result()
    if found.cancelled:
        if args.json:
            head = {"root": root, "files_scanned": found.n_files, "reclaimable": 0, "cancelled": True}
            report.write_document(sys.stdout.write, head, {"groups": report.as_json(found.skipped, "path")})
        raise KeyboardInterrupt
    pictures = similar_scan(spark, found, threshold, protected, cache).checkpoint() if own.similar_images or args.similar else None
    for warning in found.warnings:
        _say(f"warning: {warning}")
    totals = exact.totals(found.files, found.members).first()
    if args.json:
        lists = {
            "groups": report.exact_groups(found.members),
            "empty_files": report.as_json(found.empty_files, "path"),
            "hardlink_sets": report.as_json(found.hardlink_sets, "paths"),
            "skipped": report.as_json(found.skipped, "path", "reason"),
        }
        if pictures is not None:
            order = view.similar_groups(pictures).select("group_id", "place")
            lists["similar_groups"] = report.similar_groups(pictures, order)
        head = {"root": root, "files_scanned": totals["files_scanned"], "reclaimable": totals["reclaimable"], "cancelled": found.cancelled}
        report.write_document(sys.stdout.write, head, lists)
        return
    freed = spark.range(1).select(human_size(F.lit(totals["reclaimable"]))).first()[0]
    print(f"{totals['files_scanned']} files scanned, {totals['n_groups']} duplicate groups, {freed} reclaimable")
    _print(report.table(found.members))
    _print(found.members.select(F.explode("links").alias("hard link"), "path").orderBy("path", "hard link"))
    if pictures is not None:
        _print(pictures.select("group_id", "rank", "path", "similarity", "verdict", "reason").orderBy("group_id", "rank"))
    _print(found.empty_files.select(F.col("path").alias("empty file")).orderBy("path"))
    _print(found.hardlink_sets.select(F.array_join("paths", "  ").alias("already hard-linked")).orderBy("already hard-linked"))
    _print(found.skipped.select(F.col("path").alias("skipped"), "reason").orderBy("path"))


def _print(rows: DataFrame) -> None:
    """All rows, tabs between columns; they pass through the driver one partition at a time."""
    for number, row in enumerate(rows.toLocalIterator()):
        if not number:
            print("\n" + "\t".join(rows.columns))
        print("\t".join("" if x is None else str(x) for x in row))


def _hidden(spark: SparkSession, args: argparse.Namespace) -> None:
    root = _folder(args.path)
    items, skipped = hidden_scan(spark, root, os.path.expanduser("~"), not args.no_temp_patterns)
    items = similar.checkpointed(items).orderBy("path")
    if args.json:
        freed = hidden.reclaimable_preselected(items).first()["reclaimable_preselected"]
        lists = {"items": report.hidden_json(items).orderBy("path"), "skipped": report.as_json(skipped, "path", "reason")}
        report.write_document(sys.stdout.write, {"root": root, "reclaimable_preselected": freed}, lists)
    else:
        _print(items.select("path", "is_dir", human_size(F.col("size")).alias("size"), "category", "protected", "preselect"))
        print(f"{items.count()} items, {skipped.count()} skipped")


def _cache(spark: SparkSession, args: argparse.Namespace) -> None:
    folder = args.folder or _cache_folder(spark)
    rows, warning = snapshot.load(spark, folder)
    n = rows.count()
    print(warning or f"{n} entries")
    if args.action == "clear" and warning is None:
        snapshot.save(spark.createDataFrame([], snapshot.SCHEMA), folder)
        perceptual.save(spark.createDataFrame([], perceptual.SCHEMA), perceptual.folder_of(folder))
        print(f"cleared {n} cached hashes")


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    spark = SparkSession.builder.appName("twinsift").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tag = f"twinsift-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        {"scan": _scan, "hidden": _hidden, "cache": _cache}[args.command](spark, args)
    except ValueError as problem:
        _say(f"error: {problem}")
        return 2
    except KeyboardInterrupt:
        spark.sparkContext.cancelJobsWithTag(tag)  # stops the jobs, not the session
        _say("cancelled")
        return 130
    except BrokenPipeError:  # the reader of our output has seen enough
        sys.stderr.close()
    finally:
        spark.sparkContext.removeJobTag(tag)
    return 0
