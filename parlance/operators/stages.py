"""A graph of cached stages: each is a table with the signature of all it was made from, so a changed input rebuilds only what hangs on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.writers import cached_stage, reusable, stable_id


@dataclass(frozen=True)
class Stage:
    """build(tables, config) makes the stage's table of its inputs (names of sources and stages); config is part of its signature, as is version."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame], dict], DataFrame]
    config: dict = field(default_factory=dict)
    version: int = 1


def folder_signature(spark: SparkSession, path: str) -> str:
    """What is in a folder: number, bytes and a sum of hashes of path, size and time of its files, taken from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    n, size, sums = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first()
    return stable_id([n, size, sums])


def ordered(stages: list[Stage], sources: set[str]) -> list[Stage]:
    """The stages so that each follows its inputs; a name that is missing, twice there or waits for itself is an error."""
    names = [s.name for s in stages]
    if len(set(names)) < len(names) or set(names) & sources:
        raise ValueError("stages and sources need names of their own")
    done, out, left = set(sources), [], list(stages)
    while left:
        ready = [s for s in left if set(s.inputs) <= done]
        if not ready:
            raise ValueError(f"inputs are missing or go in a circle: {', '.join(s.name for s in left)}")
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return out


def run_stages(spark: SparkSession, folder: str, stages: list[Stage], sources: dict[str, tuple[DataFrame, str]], progress=None, force: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], list[str]]:
    """(table of every source and stage, names of the stages that were built). sources: table and signature; force: stages to build in any case, with all that hangs on them.

    progress: a streaming.progress.Progress, told of each stage and whether it was there already.
    """
    tables = {name: df for name, (df, _) in sources.items()}
    signed = {name: signature for name, (_, signature) in sources.items()}
    built: list[str] = []
    for s in ordered(stages, set(sources)):
        again = [x for x in (s.name, *s.inputs) if x in force or x in built]
        signature = {"stage": s.name, "version": s.version, "config": s.config, "inputs": {x: signed[x] for x in s.inputs}}
        there = not again and reusable(spark, f"{folder}/{s.name}/manifest", signature)
        make = lambda s=s: s.build({x: tables[x] for x in s.inputs}, s.config)
        work = lambda s=s, signature=signature, make=make, there=there: cached_stage(spark, folder, s.name, signature, make, fresh=not there)
        tables[s.name] = work() if progress is None or there else progress.run(s.name, work)
        if there and progress is not None:
            progress.say(s.name, "reused")
        if not there:
            built.append(s.name)
        signed[s.name] = stable_id(signature)
    return tables, built
