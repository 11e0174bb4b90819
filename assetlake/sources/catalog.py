"""The catalog: files, types, objects, externals and resources as tables (SRC-01, SRC-02, PRJ-01).

A root (a file, or the parts of a split file) is expanded and parsed in one task, so that its
breadth-first order is its rows' `seq`; roots are independent of each other. Contents stay where
they are read: objects are decoded next to their file, and only what they give is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlake.functions import formats, text
from assetlake.sources import readers
from assetlake.sources.binary import AssetError
from assetlake.sources.containers import Limits, expand
from assetlake.sources.serialized import decode, decode_fields, jsonable, parse

ITEMS = "root string, seq int, file string, kind string, depth int, revision string, content binary, family string, message string"
PARSED = """struct<format: int, unity_version: string, platform: int, big: boolean,
  types: array<struct<class_id: int, stripped: boolean, hash: binary, root_type: string, nodes: int>>,
  objects: array<struct<path_id: long, byte_start: long, byte_size: long, type_id: int, class_id: int, type_index: int>>,
  externals: array<struct<prefix: string, guid: binary, kind: int, path: string>>, family: string, message: string>"""
VALUES = "root string, seq int, file string, object_index int, path_id long, class_id int, name string, value string, family string, message string"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: (root, content) of a file or of every file below a folder, split files put together.

    `name.split0` to `name.splitN` become `name`, unless there is such a file.
    """
    spark.catalog.refreshByPath(path)  # what was kept of an earlier listing
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("root"), "content")
    return join_splits(files)


def join_splits(files: DataFrame) -> DataFrame:
    """SRC-05: parts need the numbers 0 to n-1, written without leading zeros."""
    base, number = F.regexp_extract("root", r"(?s)^(.*)\.split(0|[1-9]\d*)$", 1), F.regexp_extract("root", r"\.split(0|[1-9]\d*)$", 1)
    marked = files.select("root", "content", base.alias("_base"), number.alias("_number"))
    whole = marked.filter("_number = ''").select("root", "content")
    parts = marked.filter("_number <> ''").select(F.col("_base").alias("root"), F.col("_number").cast("int").alias("idx"), "content")
    parts = parts.join(whole.select("root"), "root", "left_anti")
    return whole.unionByName(formats.reassemble(parts, "root", "idx", "content").select("root", "content"))


def in_memory(spark: SparkSession, inputs: list[tuple[str, bytes]]) -> DataFrame:
    """SRC-02: labels and bytes."""
    return spark.createDataFrame([(label, bytearray(data)) for label, data in inputs], "root string, content binary")


def expand_roots(roots: DataFrame, limits: Limits = Limits(), skip: bool = True, oodle: Callable | None = None) -> DataFrame:
    """SRC-15, ERR-02: the serialized files and resources in each root. A root that fails leaves one
    diagnostic row and nothing else; without `skip` it ends the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, content in zip(frame["root"], frame["content"]):
                try:
                    rows = [(root, i, x.label, x.kind, x.depth, x.revision, x.content, None, None) for i, x in enumerate(expand(root, bytes(content), limits, oodle))]
                except AssetError as e:
                    if not skip:
                        raise
                    rows = [(root, 0, root, "diagnostic", 0, None, None, e.family, str(e))]
                yield pd.DataFrame(rows, columns=["root", "seq", "file", "kind", "depth", "revision", "content", "family", "message"])

    return roots.select("root", "content").mapInPandas(run, ITEMS)


def _parse(content, revision, override: str | None):
    try:
        f = parse(bytes(content), revision, override)
    except AssetError as e:
        return (None, None, None, None, [], [], [], e.family, str(e))
    types = [(t.class_id, t.stripped, t.hash, t.nodes[0].type if t.nodes else None, len(t.nodes)) for t in f.types]
    objects = [(o.path_id, o.start, o.size, o.type_id, o.class_id, o.type_index) for o in f.objects]
    return (f.version, f.unity_version, f.platform, f.big, types, objects, f.externals, None, None)


@dataclass
class Catalog:
    """The tables of a collection. Order is (root, seq), and object_index within a file."""

    items: DataFrame
    parsed: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Catalog:
        return cls.of(list_files(spark, path), **options)

    @classmethod
    def of(cls, roots: DataFrame, unity_version: str | None = None, **options) -> Catalog:
        items = expand_roots(roots, **options).persist()
        # a row's own file is parsed beside it: Python values, one file at a time
        udf = F.udf(lambda content, revision: _parse(content, revision, unity_version), PARSED, useArrow=True)
        parsed = items.filter("kind = 'serialized'").select("root", "seq", "file", "revision", udf("content", "revision").alias("p"))
        return cls(items, parsed.persist())

    @property
    def files(self) -> DataFrame:
        return self.parsed.filter("p.message is null").select("root", "seq", "file", "p.format", "p.unity_version", "p.platform", "p.big", F.size("p.objects").alias("object_count"), F.size("p.types").alias("type_count"))

    @property
    def types(self) -> DataFrame:
        return self.parsed.select("file", F.posexplode("p.types").alias("type_index", "t")).select("file", "type_index", "t.*")

    @property
    def objects(self) -> DataFrame:
        rows = self.parsed.select("root", "seq", "file", F.posexplode("p.objects").alias("object_index", "o"))
        return rows.select("root", "seq", "file", "object_index", "o.path_id", "o.class_id", "o.byte_start", "o.byte_size", "o.type_index")

    @property
    def externals(self) -> DataFrame:
        rows = self.parsed.select("file", F.posexplode("p.externals").alias("pos", "e"))
        return rows.select("file", (F.col("pos") + 1).alias("file_id"), "e.*")

    @property
    def resources(self) -> DataFrame:
        return self.items.filter("kind = 'resource'").select("root", "seq", "file", F.octet_length("content").cast("long").alias("size"))

    @property
    def diagnostics(self) -> DataFrame:
        roots = self.items.filter("kind = 'diagnostic'").select("root", "file", "family", "message")
        return roots.unionByName(self.parsed.filter("p.message is not null").select("root", "file", "p.family", "p.message"))

    # ------------------------------------------------------------ values
    def raw(self, limit: int = 1 << 30) -> DataFrame:
        """PRJ-02: the bytes of each object, an error above the limit."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for label, revision, content in zip(frame["file"], frame["revision"], frame["content"]):
                    try:
                        data = bytes(content)
                        objects = parse(data, revision).objects
                    except AssetError:
                        continue  # it is among the diagnostics
                    for o in objects:
                        if o.size > limit:
                            raise ValueError(f"object above the limit: {o.path_id}")
                    for at in range(0, len(objects), 1000):
                        yield pd.DataFrame([(label, at + i, o.path_id, o.class_id, data[o.start : o.start + o.size]) for i, o in enumerate(objects[at : at + 1000])], columns=["file", "object_index", "path_id", "class_id", "bytes"])

        return self.items.filter("kind = 'serialized'").select("file", "revision", "content").mapInPandas(run, "file string, object_index int, path_id long, class_id int, bytes binary")

    def values(self, class_ids: list[int] | None = None, fields: list[str] | None = None, schemas: Callable | None = None) -> DataFrame:
        """PRJ-03 to PRJ-07: objects as JSON, decoded by their type tree, by a caller's (schemas takes a
        class number and gives nodes), or by their class's fixed layout; `fields` keeps root fields alone.
        An object that fails is a row with its error's family."""
        wanted, kept = set(class_ids) if class_ids is not None else None, set(fields) if fields is not None else None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for root, seq, label, revision, content in zip(frame["root"], frame["seq"], frame["file"], frame["revision"], frame["content"]):
                    rows = []
                    try:
                        data = bytes(content)
                        f = parse(data, revision)
                    except AssetError:
                        continue  # it is among the diagnostics
                    for i, o in enumerate(f.objects):
                        if wanted is not None and o.class_id not in wanted:
                            continue
                        part = data[o.start : o.start + o.size]
                        try:
                            nodes = f.types[o.type_index].nodes if o.type_index is not None else []
                            nodes = nodes or (schemas(o.class_id) if schemas else None)
                            if nodes and kept is not None:  # the name is read for its own column
                                value = decode_fields(part, f.big, nodes, kept | {"m_Name"})
                            else:
                                value = decode(part, f.big, nodes) if nodes else readers.read(o.class_id, part, f.big, f.version)
                            name = readers.name_of(o.class_id, value)
                            if kept is not None:
                                value = [(k, v) for k, v in value if k in kept]
                            rows.append((root, seq, label, i, o.path_id, o.class_id, name, json.dumps(jsonable(value), ensure_ascii=False), None, None))
                        except AssetError as e:
                            rows.append((root, seq, label, i, o.path_id, o.class_id, None, None, e.family, str(e)))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in VALUES.split(", ")])

        return self.items.filter("kind = 'serialized'").select("root", "seq", "file", "revision", "content").mapInPandas(run, VALUES)

    # ------------------------------------------------------------ relations
    def resolve(self, references: DataFrame, class_ids: list[int] | None = None) -> DataFrame:
        """JOIN-01, JOIN-02: references (file, file_id, path_id, ...) with target_file and target_class, or
        nulls. File 0 is the own file; others go by the portable name, without regard to ASCII case, of
        the file's externals, and of files of one name the first wins."""
        named = self.files.select("file", "root", "seq", text.ascii_lower(text.portable_name(F.col("file"))).alias("_name"))
        first = named.groupBy("_name").agg(F.min_by("file", F.struct("root", "seq")).alias("_found"))
        outer = self.externals.select(F.col("file").alias("_file"), F.col("file_id").alias("_id"), text.ascii_lower(text.portable_name(F.col("path"))).alias("_name")).join(first, "_name")
        null = (F.col("path_id") == 0) | (F.col("file_id") < 0)
        linked = references.join(outer, (F.col("file") == F.col("_file")) & (F.col("file_id") == F.col("_id")), "left")
        linked = linked.withColumn("_target", F.when(~null, F.when(F.col("file_id") == 0, F.col("file")).otherwise(F.col("_found"))))
        objects = self.objects if class_ids is None else self.objects.filter(F.col("class_id").isin(class_ids))
        targets = objects.select(F.col("file").alias("target_file"), F.col("path_id").alias("_path"), F.col("class_id").alias("target_class"))
        return linked.join(targets, (F.col("_target") == F.col("target_file")) & (F.col("path_id") == F.col("_path")), "left").drop("_file", "_id", "_name", "_found", "_target", "_path")

    def names(self) -> DataFrame:
        """PRJ-07, PRJ-18, JOIN-06: every object's name: its own, else its type's, else its class number."""
        own = self.values(fields=["m_Name"]).select("file", "path_id", "name")
        trees = self.types.select("file", "type_index", "root_type")
        rows = self.objects.join(own, ["file", "path_id"], "left").join(trees, ["file", "type_index"], "left")
        name = F.coalesce(F.nullif("name", F.lit("")), "root_type", F.concat(F.lit("class_"), F.col("class_id")))
        return rows.select("root", "seq", "file", "object_index", "path_id", "class_id", "byte_size", name.alias("name"))

    def containers(self) -> DataFrame:
        """JOIN-04, PRJ-08: the container of each object; of several the last assigned."""
        shape = "m_PreloadTable array<struct<m_FileID: int, m_PathID: long>>, m_Container array<struct<first: string, second: struct<preloadIndex: int, preloadSize: int, asset: struct<m_FileID: int, m_PathID: long>>>>"
        bundles = self.values([readers.ASSET_BUNDLE]).filter("value is not null").select("file", "path_id", F.from_json("value", shape).alias("v"))
        entries = bundles.select("file", "v.m_PreloadTable", F.posexplode("v.m_Container").alias("pos", "e"))
        wrong = F.col("e.second.preloadIndex") + F.col("e.second.preloadSize") > F.size("m_PreloadTable")
        part = F.when(wrong, F.raise_error(F.concat(F.lit("a container reaches beyond the preload table: "), F.col("e.first")))).otherwise(F.slice("m_PreloadTable", F.col("e.second.preloadIndex") + 1, F.col("e.second.preloadSize")))
        refs = entries.select("file", "pos", F.col("e.first").alias("container"), F.explode(part).alias("r")).select("file", "pos", "container", F.col("r.m_FileID").alias("file_id"), F.col("r.m_PathID").alias("path_id"))
        found = self.resolve(refs).filter("target_file is not null")
        return found.groupBy(F.col("target_file").alias("file"), "path_id").agg(F.max_by("container", F.struct("file", "pos")).alias("container"))

    def scene(self) -> DataFrame:
        """HIER-01, JOIN-07, JOIN-08: nodes (file, path_id, name, parent_file, parent_id) of game objects.

        A parent is the owner of the transform's father.
        """
        ref = "struct<m_FileID: int, m_PathID: long>"
        game_objects = self.values([readers.GAME_OBJECT]).filter("value is not null").select("file", "path_id", "object_index", "name")
        moves = self.values([readers.TRANSFORM, readers.RECT_TRANSFORM]).filter("value is not null").select("file", F.col("path_id").alias("transform"), F.from_json("value", f"m_GameObject {ref}, m_Father {ref}").alias("v"))
        owners = moves.select("file", "transform", F.col("v.m_GameObject.m_FileID").alias("file_id"), F.col("v.m_GameObject.m_PathID").alias("path_id"))
        owners = self.resolve(owners, [readers.GAME_OBJECT]).filter("target_file is not null").select("file", "transform", F.col("target_file").alias("owner_file"), F.col("path_id").alias("owner"))
        fathers = moves.select("file", "transform", F.col("v.m_Father.m_FileID").alias("file_id"), F.col("v.m_Father.m_PathID").alias("path_id"))
        fathers = self.resolve(fathers, [readers.TRANSFORM, readers.RECT_TRANSFORM]).filter("target_file is not null").select("file", "transform", F.col("target_file").alias("father_file"), F.col("path_id").alias("father"))
        above = owners.select(F.col("file").alias("father_file"), F.col("transform").alias("father"), F.col("owner_file").alias("parent_file"), F.col("owner").alias("parent_id"))
        parents = owners.join(fathers, ["file", "transform"]).join(above, ["father_file", "father"])
        last = parents.groupBy(F.col("owner_file").alias("file"), F.col("owner").alias("path_id")).agg(F.max_by(F.struct("parent_file", "parent_id"), "transform").alias("p"))
        return game_objects.join(last, ["file", "path_id"], "left").select("file", "path_id", "object_index", "name", F.col("p.parent_file").alias("parent_file"), F.col("p.parent_id").alias("parent_id"))

    def scripts(self) -> DataFrame:
        """PRJ-11, JOIN-06: behaviours with the class, namespace and assembly of their script, where it is there."""
        ref = "struct<m_FileID: int, m_PathID: long>"
        own = self.values([readers.MONO_BEHAVIOUR], ["m_Name", "m_Script"]).filter("value is not null").select("file", F.col("path_id").alias("behaviour"), "name", F.from_json("value", f"m_Script {ref}").alias("v"))
        refs = own.select("file", "behaviour", "name", F.col("v.m_Script.m_FileID").alias("file_id"), F.col("v.m_Script.m_PathID").alias("path_id"))
        found = self.resolve(refs, [readers.MONO_SCRIPT])
        shape = "m_ClassName string, m_Namespace string, m_AssemblyName string"
        classes = self.values([readers.MONO_SCRIPT]).filter("value is not null").select(F.col("file").alias("target_file"), "path_id", F.from_json("value", shape).alias("s"))
        joined = found.join(classes, ["target_file", "path_id"], "left")
        return joined.select("file", F.col("behaviour").alias("path_id"), F.coalesce(F.nullif("name", F.lit("")), "s.m_ClassName").alias("name"), F.col("s.m_ClassName").alias("class_name"), F.col("s.m_Namespace").alias("namespace"), F.col("s.m_AssemblyName").alias("assembly"))

    def material_textures(self) -> DataFrame:
        """PRJ-10, JOIN-12: (file, path_id, property, texture_file, texture_id) of materials with a type tree.
        Null and dangling references, and targets that aren't textures, are left out."""
        ref = "struct<m_FileID: int, m_PathID: long>"
        shape = f"m_SavedProperties struct<m_TexEnvs: array<struct<first: string, second: struct<m_Texture: {ref}>>>>"
        envs = self.values([readers.MATERIAL]).filter("value is not null").select("file", F.col("path_id").alias("material"), F.explode(F.from_json("value", shape)["m_SavedProperties"]["m_TexEnvs"]).alias("e"))
        refs = envs.select("file", "material", F.col("e.first").alias("property"), F.col("e.second.m_Texture.m_FileID").alias("file_id"), F.col("e.second.m_Texture.m_PathID").alias("path_id"))
        found = self.resolve(refs, [28]).filter("target_file is not null")
        return found.select("file", F.col("material").alias("path_id"), "property", F.col("target_file").alias("texture_file"), F.col("path_id").alias("texture_id"))

    def global_matrices(self) -> DataFrame:
        """HIER-06: the global matrix of each transform."""
        from assetlake.operators import hierarchy

        ref, xyz = "struct<m_FileID: int, m_PathID: long>", "struct<x: double, y: double, z: double>"
        shape = f"m_Father {ref}, m_LocalRotation struct<x: double, y: double, z: double, w: double>, m_LocalPosition {xyz}, m_LocalScale {xyz}"
        moves = self.values([readers.TRANSFORM, readers.RECT_TRANSFORM]).filter("value is not null").select("file", F.col("path_id").alias("transform"), F.from_json("value", shape).alias("v"))
        parts = lambda c, names: F.array(*[F.col(f"v.{c}.{n}") for n in names])
        local = hierarchy.matrix(parts("m_LocalPosition", "xyz"), parts("m_LocalRotation", "xyzw"), parts("m_LocalScale", "xyz"))
        refs = moves.select("file", "transform", local.alias("local"), F.col("v.m_Father.m_FileID").alias("file_id"), F.col("v.m_Father.m_PathID").alias("path_id"))
        found = self.resolve(refs, [readers.TRANSFORM, readers.RECT_TRANSFORM])
        key = lambda a, b: F.concat_ws("\0", F.col(a), F.col(b).cast("string"))
        nodes = found.select(key("file", "transform").alias("key"), F.when(F.col("target_file").isNotNull(), key("target_file", "path_id")).alias("parent"), "local", "file", "transform").persist()
        return hierarchy.global_matrices(nodes, "key", "parent", "local").join(nodes.select("key", "file", "transform"), "key").select("file", F.col("transform").alias("path_id"), "matrix")

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        """SRT-01, SRT-02: a page of the enumeration."""
        if limit > 1_000_000:
            raise ValueError("a page has a million rows at most")
        return self.objects.orderBy("root", "seq", "object_index").offset(offset).limit(limit)

    def histogram(self) -> DataFrame:
        """AGG-01: objects and bytes of each class."""
        names = F.create_map(*[F.lit(x) for pair in readers.CLASS_NAMES.items() for x in pair])
        return self.objects.groupBy("class_id").agg(F.count(F.lit(1)).alias("objects"), F.sum("byte_size").alias("bytes")).withColumn("class_name", F.element_at(names, F.col("class_id"))).orderBy("class_id")


def running_budget(df: DataFrame, by: list[str], order: list[str], size: str, limit: int, name: str = "total") -> DataFrame:
    """AGG-05: rows before the running total is above the limit, with that total."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(size).over(w)).filter(F.col(name) <= limit)
