"""Whole scans of a file tree: exact duplicates, similar images, hidden items.

A tree is walked once and its listing written to the checkpoint folder, so that all results
of a scan describe the same moment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .job import Job
from .operators import exact, hidden, keep, similar
from .operators.stages import GroupingStage
from .sources import images, perceptual, snapshot, tree


@dataclass
class ScanResult:
    """``members`` and ``similar`` have verdicts; ``skipped`` what couldn't be read."""

    root: str
    files: DataFrame
    members: DataFrame
    groups: DataFrame
    empty_files: DataFrame
    hardlink_sets: DataFrame
    skipped: DataFrame
    similar: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    cancelled: bool = False
    n_files: int | None = None


def _stopped(spark: SparkSession, root: str, job: Job) -> ScanResult:
    """What a cancelled scan leaves: the files counted so far, and no groups."""
    none = lambda columns: spark.createDataFrame([], columns)
    file = "path string, size long, mtime_ns long, inode long, device long"
    listed = job.seen.get("listed")
    return ScanResult(
        root, none(file), none(f"group_id string, {file}, links array<string>, verdict string, reason string"),
        none("group_id string, size long, n_files long, reclaimable long"), none(file), none("paths array<string>"),
        none("path string, reason string"), cancelled=True, n_files=listed.rows if listed else 0,
    )


def exact_scan(
    spark: SparkSession, root: str, options: tree.TreeOptions = tree.TreeOptions(), protected: Sequence[str] = (),
    cache: str | None = None, paranoid: bool = False, job: Job | None = None, more: Sequence[GroupingStage] = (),
) -> ScanResult:
    """Exact duplicates of a tree; ``cache`` is the folder of a hash snapshot that is read and renewed.

    ``job`` lets other threads watch and cancel; ``more`` are stages after those of the digests, whose keys
    members of a group share too.
    """
    own = job or Job(spark)
    return own.run(lambda: _exact(spark, root, options, protected, cache, paranoid, own, more), lambda: _stopped(spark, root, own))


def _exact(spark, root, options, protected, cache, paranoid, job, more) -> ScanResult:
    similar.ensure_checkpoints(spark)
    listed, skipped = tree.scan(spark, root, options)
    files = job.stage(listed, "listed")
    warnings, known = [], None
    if cache is not None:
        known, warning = snapshot.load(spark, cache)
        warnings += [warning] if warning not in (None, snapshot.NONE_YET) else []
    single = exact.collapse_links(files.where("size > 0"))
    digested, failed, read = tree.with_digests(single, known=known, more=more, keep=job.stage)
    keys = [x.key for x in more]
    if paranoid:
        digested, unread = tree.told_apart(exact.shared(digested, "size", "partial", "full").drop("sharing"))
        failed, keys = failed.unionByName(unread), [*keys, "twin"]
    members = job.stage(keep.recommend(exact.grouped(job.stage(digested, "hashed"), *keys), protected, root), "members")
    if known is not None:
        fresh = read.withColumns({x: F.lit(None).cast("string") for x in ("perceptual", "perceptual_algo")})
        warnings += _kept(lambda: snapshot.save(snapshot.upsert(known, fresh), cache))
    return ScanResult(
        root, files, members, exact.groups(members), exact.empty_files(files), exact.hardlink_sets(files),
        skipped.unionByName(failed), warnings=warnings, n_files=job.seen["listed"].rows,
    )


def _kept(write: Callable[[], None]) -> list[str]:
    """A scan whose snapshot can't be written is whole all the same: warnings."""
    try:
        write()
    except (OSError, PySparkException, Py4JError) as problem:
        return [f"hash snapshot not written: {type(problem).__name__}"]
    return []


def _hashed(spark: SparkSession, found: ScanResult, standing: DataFrame, cache: str | None) -> DataFrame:
    """Hashes of all standing images; those that a snapshot knows of this version aren't decoded."""
    if cache is None:
        return images.hashed(standing).checkpoint()
    folder = perceptual.folder_of(cache)
    known, warning = perceptual.load(spark, folder)
    found.warnings += [warning] if warning is not None else []
    hits = perceptual.hits(standing, known).checkpoint()
    fresh = images.hashed(standing.join(hits.select("path"), "path", "left_anti")).checkpoint()
    if not fresh.where("error is null").isEmpty():
        versioned = fresh.where("error is null").join(standing.select("path", *snapshot.VERSION), "path")
        found.warnings += _kept(lambda: perceptual.save(perceptual.renewed(known, versioned), folder))
    return hits.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)


def similar_scan(
    spark: SparkSession, found: ScanResult, threshold: int = 8, protected: Sequence[str] = (), cache: str | None = None
) -> DataFrame:
    """(group_id, rank, path, distance, similarity, verdict, reason, aliases) of similar images.

    Every image that stands for itself (no excluded file, no further hard link, no exact copy) is
    read; ``found.skipped`` gets those that can't be.  Groups are a leader (the best by quality) and
    those that follow it.  ``cache`` is the exact scan's; hashes of images are kept beside it.
    """
    single = exact.collapse_links(found.files.where("size > 0"))
    standing = similar.collapse_exact(similar.image_files(single), found.members)
    standing = standing.join(single.select("path", *snapshot.VERSION), "path")
    hashed = _hashed(spark, found, standing, cache)
    found.skipped = found.skipped.unionByName(hashed.where("error is not null").select("path", F.col("error").alias("reason")))
    rows = hashed.where("size(variants) > 0").drop("error").join(standing, "path")
    rows = similar.checkpointed(keep.numbered(rows, [paths.components(F.col("path"))], "idx").withColumn("pixels_n", F.col("width") * F.col("height")))
    timed = rows.where("taken is not null and sketch is not null")
    candidates = similar.merge_candidates(
        similar.hamming_candidates(rows, similar.candidate_bound(threshold)), similar.scene_candidates(timed)
    ).checkpoint()
    accepted = images.verified(candidates, rows, threshold).checkpoint()
    meta = rows.select("idx", "path", "size", "mtime_ns", F.col("pixels_n").alias("pixels"), "width", "height", "aliases")
    led = similar.leader_clusters(keep.quality_rank(meta, root=found.root).select("idx", "rank"), accepted.select("i", "j"))
    both = accepted.select("i", "j", "distance", "similarity")
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance", "similarity"))
    members = meta.join(led, "idx").join(
        both, (F.col("idx") == F.col("i")) & (F.col("leader") == F.col("j")), "left"
    ).drop("i", "j").fillna({"distance": 0, "similarity": 1.0})
    ids = members.groupBy("leader").agg(F.array_sort(F.collect_list("path")).alias("p")).where("size(p) > 1").select(
        "leader", keep.similar_group_id("p").alias("group_id")
    )
    return keep.recommend_similar(members.join(ids, "leader").drop("leader"), protected, found.root)


def hidden_scan(
    spark: SparkSession, root: str, home: str, temp_patterns: bool = True, cross_filesystems: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(items, skipped); nothing is excluded, links are items and aren't followed."""
    options = tree.TreeOptions(min_size=0, exclude=(), cross_filesystems=cross_filesystems)
    rows = tree.entries(spark, root, options, every=True)
    held = spark.createDataFrame([(x,) for x in tree.open_files()], "path string")
    found = hidden.items(rows.where("error is null").select("path", "size", "is_dir"), root, home, held, temp_patterns)
    failed = rows.where("error is not null").select("path", F.col("error").alias("reason"))
    return found, hidden.outside(failed, root, temp_patterns)
