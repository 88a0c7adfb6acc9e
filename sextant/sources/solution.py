"""Reads a C# solution into fact tables."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.facts import SCHEMAS, Facts
from sextant.functions.text import nonblank_lines
from sextant.plans.store import cut
from sextant.sources import binder

#: outline rows that one broadcast may hold; beyond it each file gets those that it can look up
OUTLINE = 200_000


def discover(start: str) -> Path:
    """The solution file at or above a folder; .slnx goes before .sln, several are an error."""
    here = Path(start).resolve()
    if here.is_file():
        return here
    for folder in (here, *here.parents):
        for suffix in ("*.slnx", "*.sln"):
            found = sorted(folder.glob(suffix))
            if len(found) > 1:
                raise ValueError(f"several solutions in {folder}: {', '.join(p.name for p in found)}")
            if found:
                return found[0]
    raise FileNotFoundError(f"no solution at or above {start}")


def projects(solution: Path) -> list[tuple[str, str]]:
    """(name, folder below the solution) in the solution's order."""
    text = solution.read_text(encoding="utf-8-sig")
    paths = re.findall(r'Path="([^"]+\.csproj)"', text) or re.findall(r'=\s*"[^"]*",\s*"([^"]+\.csproj)"', text)
    return [(Path(p.replace("\\", "/")).stem, str(Path(p.replace("\\", "/")).parent)) for p in paths]


def source_files(spark: SparkSession, start: str) -> DataFrame:
    """The files table: one row per source file and project."""
    solution = discover(start)
    root = solution.parent
    listed = projects(solution)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cs").load(str(root))
    path = F.substring(F.regexp_replace("path", "^[a-z]+:/+", "/"), len(str(root)) + 2, 1 << 20)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    project = spark.createDataFrame([(n, f, k) for k, (n, f) in enumerate(listed)], "project string, folder string, project_ord int")
    rows = raw.select(path.alias("path"), text.alias("text")).join(F.broadcast(project), F.expr("folder = '.' or startswith(path, concat(folder, '/'))"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("path"))
    return rows.withColumn("file_ord", rank).select("project", "project_ord", "file_ord", "path", "text", nonblank_lines(F.col("text")).alias("loc"))


def extract(files: DataFrame, bound: int = OUTLINE) -> Facts:
    """All facts of a files table. The outline of all declarations is counted first; of a large
    one, each file gets the declarations that its names lead to, from whichever project."""

    def outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            rows = [(o["name"], json.dumps(o)) for t in b["text"] for o in binder.outline(t or "")]
            yield pd.DataFrame(rows, columns=["name", "outline"])

    found = cut(files.select("text").mapInPandas(outlines, "name string, outline string"))
    if found.limit(bound + 1).count() <= bound:
        shared = [r.outline for r in found.select("outline").distinct().orderBy("outline").collect()]
        raw = files.mapInPandas(_bind(shared), "name string, row string")
    else:
        found = found.distinct()
        side = _looked_up(files, found).join(found, "name").groupBy("path").agg(F.collect_set("outline").alias("outlines"))
        raw = files.join(side, "path", "left").mapInPandas(_bind(None), "name string, row string")
    raw = cut(raw)
    spark = files.sparkSession
    tables = {n: raw.filter(F.col("name") == n).select(F.from_json("row", s).alias("r")).select("r.*") for n, s in SCHEMAS.items() if n != "files"}
    return Facts.empty(spark, files=files, **tables)


def _looked_up(files: DataFrame, outlines: DataFrame) -> DataFrame:
    """(path, name) of every type name that binding a file may look up: its own words, and in
    rounds the names that a declaration found leads to by its bases, by its outer types, and by
    members whose name is a word of the file."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, w) for p, t in zip(b["path"], b["text"], strict=True) for w in binder.words(t or "")]
            yield pd.DataFrame(rows, columns=["path", "name"])

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            rows = [(n, *x) for n, o in zip(b["name"], b["outline"], strict=True) for x in binder.leads(json.loads(o))]
            yield pd.DataFrame(rows, columns=["name", "via", "to"])

    own = cut(files.select("path", "text").mapInPandas(words, "path string, name string").distinct())
    declared = outlines.select("name").distinct()
    known = declared.withColumnRenamed("name", "to")
    on = cut(outlines.mapInPandas(leads, "name string, via string, to string").distinct().join(known, "to", "left_semi"))
    via = own.withColumnRenamed("name", "via")
    front = seen = cut(own.join(declared, "name", "left_semi").select("path", "name"))
    while not front.isEmpty():
        step = front.join(on, "name")
        step = step.filter("via is null").select("path", "to").union(step.join(via, ["path", "via"], "left_semi").select("path", "to"))
        front = cut(step.withColumnRenamed("to", "name").distinct().join(seen, ["path", "name"], "left_anti").select("path", "name"))
        seen = seen.union(front)
    return seen


def _bind(shared: list[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        world = binder.World([json.loads(o) for o in shared]) if shared is not None else None
        for b in batches:
            rows = []
            for r in b.itertuples():
                w = world or binder.World([json.loads(o) for o in sorted(r.outlines if r.outlines is not None else [])])
                rows += binder.file_rows(w, r.text or "", r.path, r.project, int(r.project_ord), int(r.file_ord))
            yield pd.DataFrame(rows, columns=["name", "row"])

    return run


def read_solution(spark: SparkSession, start: str) -> Facts:
    return extract(cut(source_files(spark, start)))


def git_head(folder: str, seconds: float = 2.0) -> tuple[str, str]:
    """Short commit and commit date of HEAD; empty where git fails or takes longer."""

    def ask(*args: str) -> str:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=seconds)
            return done.stdout.strip() if done.returncode == 0 else ""
        except (OSError, subprocess.TimeoutExpired):
            return ""

    return ask("rev-parse", "--short", "HEAD"), ask("show", "-s", "--format=%cI", "HEAD")


def request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
