"""Writing exports and extractions (SNK-01 to SNK-03)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import text
from assetlake.operators import assets
from assetlake.operators.naming import claim_all
from assetlake.sources.catalog import Catalog

#: Media that an export makes: from which objects, and the files' extension.
MEDIA = {"png": ".png", "bmp": ".bmp", "tga": ".tga", "qoi": ".qoi", "wav": ".wav", "obj": ".obj"}
REPORT = "path string, bytes long, outcome string, message string"
MAXIMUM_NAME = 240


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """SNK-01, SNK-02: rows (path, content) as files below a folder that all executors share.

    A file is written beside its place under a name of the task's attempt, and then linked or moved
    there, so that a task may run twice. Without `overwrite` a file that is there stays, and is
    `kept` if it is the same, else `failed`. The report is only made when it is read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                target = os.path.normpath(os.path.join(folder, path))
                if not target.startswith(os.path.normpath(folder) + os.sep) or any(len(p.encode()) > MAXIMUM_NAME for p in path.split("/")):
                    out.append((path, 0, "failed", "unsafe or too long"))
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                beside, data = f"{target}.{attempt}.tmp", bytes(content)
                try:
                    with open(beside, "wb") as f:
                        f.write(data)
                    if overwrite:
                        os.replace(beside, target)
                        out.append((path, len(data), "exported", None))
                        continue
                    try:
                        os.link(beside, target)
                        out.append((path, len(data), "exported", None))
                    except FileExistsError:
                        with open(target, "rb") as f:
                            same = f.read() == data
                        out.append((path, len(data), "kept" if same else "failed", None if same else "another file is there"))
                except OSError as e:
                    out.append((path, 0, "failed", str(e)))
                finally:
                    if os.path.exists(beside):
                        os.unlink(beside)
            yield pd.DataFrame(out, columns=["path", "bytes", "outcome", "message"])

    return rows.select("path", "content").mapInPandas(run, REPORT)


def media(catalog: Catalog, mode: str) -> DataFrame:
    """Textures as images, sounds as WAV, or meshes as OBJ, each with its error's family if it has one."""
    return assets.sounds(catalog) if mode == "wav" else assets.meshes(catalog) if mode == "obj" else assets.textures(catalog, mode)


def export_rows(catalog: Catalog, mode: str = "json", class_ids: list[int] | None = None) -> DataFrame:
    """(path, content): each object as its raw bytes or as JSON, text assets as their text, or media, named by
    class and by object, with a suffix for later claimants of a name in a folder."""
    names = catalog.names() if class_ids is None else catalog.names().filter(F.col("class_id").isin(class_ids))
    if mode == "raw":
        content, extension = catalog.raw().select("file", "path_id", F.col("bytes").alias("content")), ".dat"
    elif mode == "json":
        content, extension = catalog.values(class_ids).filter("value is not null").select("file", "path_id", F.col("value").cast("binary").alias("content")), ".json"
    elif mode == "text":
        script = F.from_json("value", "m_Script array<int>")["m_Script"]
        data = F.unhex(F.array_join(F.transform(script, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
        content, extension = catalog.values([49]).filter("value is not null").select("file", "path_id", data.alias("content")), ".txt"
    elif mode in MEDIA:
        content, extension = media(catalog, mode).filter("content is not null").select("file", "path_id", "content"), MEDIA[mode]
    else:
        raise ValueError(f"mode {mode}")
    joined = names.join(content, ["file", "path_id"])
    folder = F.concat(F.lit("class_"), F.col("class_id"))
    clean = text.sanitize(F.col("name"))
    file_name = text.with_extension(clean, extension) if mode == "text" else F.concat(clean, F.lit(extension))
    named = joined.select(folder.alias("folder"), file_name.alias("file_name"), F.struct("root", "seq", "object_index").alias("at"), "content")
    order = named.select("folder", "file_name", F.concat_ws("\0", "at.root", F.lpad(F.col("at.seq").cast("string"), 10, "0"), F.lpad(F.col("at.object_index").cast("string"), 10, "0")).alias("order"))
    claimed = claim_all(order, "file_name", "order", "folder")  # names alone meet in a folder's group, not contents
    keyed = named.withColumn("order", F.concat_ws("\0", "at.root", F.lpad(F.col("at.seq").cast("string"), 10, "0"), F.lpad(F.col("at.object_index").cast("string"), 10, "0")))
    return keyed.join(claimed.select("order", "claimed"), "order").select(F.concat_ws("/", "folder", "claimed").alias("path"), "content")


def export(catalog: Catalog, folder: str, mode: str = "json", class_ids: list[int] | None = None, overwrite: bool = False) -> DataFrame:
    """SNK-01: write objects; what can't be decoded is `failed` or `unsupported` in the report."""
    done = write_files(export_rows(catalog, mode, class_ids), folder, overwrite)
    if mode == "raw":
        return done
    failed = media(catalog, mode) if mode in MEDIA else catalog.values(class_ids if mode == "json" else [49])
    failed = failed.filter("message is not null")
    return done.unionByName(failed.select(F.concat_ws("#", "file", "path_id").alias("path"), F.lit(0).cast("long").alias("bytes"), F.when(F.col("family") == "unsupported", "unsupported").otherwise("failed").alias("outcome"), "message"))


def extract(catalog: Catalog, folder: str, overwrite: bool = False) -> DataFrame:
    """SNK-03: the files inside containers, as a tree of folders named by their labels."""
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace("file", r"^[a-z]+:/+", ""), "::", "/"), "/"), lambda p: text.sanitize(p))
    rows = catalog.items.filter("content is not null").select(F.array_join(parts, "/").alias("path"), "content")
    return write_files(rows, folder, overwrite)


def report(done: DataFrame) -> DataFrame:
    """AGG-04: outcomes, counted."""
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
