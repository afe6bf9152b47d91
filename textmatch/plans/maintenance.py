"""Keep a stored index good while it grows: merge batches, split cells that outgrew the rest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.neighbours import assign_cells, train_centroids
from ..options import DEFAULTS
from ..session import written
from ..sources.readers import Index, newest_manifest, read_index
from ..sources.writers import ROWS_PER_FILE, store_vectors

OVERFULL = 4.0  # times the average cell
LARGE = 0.5  # share of all vectors from which on a batch stays as it is
_STORED = ("file_id", "vec_id", "token", "embedding", "cell", "cell_score")


def split_cells(index: Index, first_id: int, overfull: float = OVERFULL, seed: int = DEFAULTS.seed) -> tuple[list[int], DataFrame | None]:
    """Cells with more than ``overfull`` times the average, and the two centres of each (parent, cell, centroid).

    Centres come from a 2-means over all vectors of the cell. A cell whose vectors have one
    direction cannot be split and stays.
    """
    average = index.statistics.agg(F.avg("n_vectors")).scalar()
    crowded = [r["cell"] for r in index.statistics.filter(F.col("n_vectors") > overfull * average).collect()]
    rows: list[tuple[int, int, list[float]]] = []
    for cell in sorted(crowded):  # fewer than one in ``overfull`` of all cells
        centres = train_centroids(index.vectors.filter(F.col("cell") == cell), 2, seed).orderBy("cell").collect()
        if len({tuple(r["centroid"]) for r in centres}) == 2:
            rows += [(cell, first_id + len(rows) + i, r["centroid"]) for i, r in enumerate(centres)]
    if not rows:
        return [], None
    spark = index.vectors.sparkSession
    return sorted({r[0] for r in rows}), spark.createDataFrame(rows, "parent int, cell int, centroid array<double>")


def compact_index(
    spark: SparkSession, path: str, overfull: float = OVERFULL, seed: int = DEFAULTS.seed, block_rows: int = ROWS_PER_FILE,
) -> Index:
    """Merge the small batches of an index to one and split its overfull cells; the same vectors stay.

    Only the small batches and the cells that are split are read and written again. What is
    new is published by renaming a manifest into place: a reader sees the index before or
    after, a run that fails leaves it as it was, and two runs at once cannot both publish.
    Batches that streams add meanwhile are part of either. Replaced folders stay for readers
    that opened the index before; :func:`drop_replaced` removes them.
    """
    version, manifest = newest_manifest(spark, path)
    index = read_index(spark, path)
    sizes = {r["batch"]: r["n"] for r in index.blocks.groupBy("batch").agg(F.sum("n_vectors").alias("n")).collect()}
    total = sum(sizes.values())
    small = sorted(b for b, n in sizes.items() if n <= LARGE * total)
    every = spark.read.parquet(f"{path}/{manifest['centroids']}")
    if "retired" not in every.columns:
        every = every.withColumn("retired", F.lit(False))
    split, halves = split_cells(index, (every.agg(F.max("cell")).first()[0] or 0) + 1, overfull, seed)
    if len(small) < 2 and not split:
        return index
    merged = index.vectors.filter(F.col("batch").isin(small) & ~F.col("cell").isin(split)).select(*_STORED)
    for cell in split:
        own = halves.filter(F.col("parent") == cell).select("cell", "centroid")
        rows = index.vectors.filter(F.col("cell") == cell).select(*_STORED[:4])
        merged = merged.unionByName(assign_cells(rows, own).select(*_STORED))
    centroids = every.withColumn("retired", F.col("retired") | F.col("cell").isin(split))
    if split:
        centroids = centroids.unionByName(halves.select("cell", "centroid", F.lit(False).alias("retired")))
    name = f"centroids-{version + 1}"
    centroids.write.mode("overwrite").parquet(f"{path}/{name}")
    stored = spark.read.parquet(f"{path}/{name}").select("cell", "centroid")
    store_vectors(written(merged, "merged"), stored, path, f"compact-{version + 1}", block_rows)
    publish(spark, path, version + 1, {
        "centroids": name,
        "replaced": sorted({*manifest["replaced"], *small}),
        "split": manifest["split"] + ([{"cells": split, "batches": sorted(sizes)}] if split else []),
    })
    return read_index(spark, path)


def publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Write a manifest aside and rename it into place; fails if the version is there already."""
    aside, place = f"{path}/manifest/.writing-{version}", f"{path}/manifest/version-{version}"
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(place)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target) or not system.rename(hadoop.Path(aside), target):
        raise RuntimeError(f"{place} was published by another run")


def drop_replaced(spark: SparkSession, path: str) -> None:
    """Remove the folders of replaced batches, once no reader has an older manifest open."""
    _, manifest = newest_manifest(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for kind in ("vectors", "statistics", "blocks"):
        for batch in manifest["replaced"]:
            folder = hadoop.Path(f"{path}/{kind}/batch={batch}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
