"""Round trips over asset bytes: rows of the test tables are written as files, and the readers give the rows back."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.media import audio, images
from assetlake.plans.registry import query, table
from assetlake.sources import catalog, writers
from assetlake.sources.catalog import Catalog

TEXT, GAME_OBJECT, TRANSFORM, BUNDLE, CUSTOM = 49, 1, 4, 142, 123456


def _files(rows: DataFrame, by: str, make: Callable[[pd.DataFrame], bytes], label: str = "") -> DataFrame:
    """(root, content): a file made of each group's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"root": [f"{label}{pdf[by].iloc[0]}"], "content": [make(pdf)]})

    return rows.groupBy(by).applyInPandas(run, "root string, content binary")


def _texts(pdf: pd.DataFrame) -> bytes:
    """A serialized file with a text object for each nation."""
    pdf = pdf.sort_values("n_nationkey")
    return writers.serialized([(k + 1, TEXT, writers.text_asset(n, f"nation {k}".encode())) for k, n in zip(pdf["n_nationkey"].tolist(), pdf["n_name"])])


#: What is around the file, and the label that it then has below its root.
AROUND = {
    "serialized": (lambda f: f, ""), "bundle": (lambda f: writers.bundle([("a.assets", f), ("a.resS", b"123")]), "::a.assets"),
    "bundle_stored": (lambda f: writers.bundle([("a.assets", f)], 6, 0, 64), "::a.assets"), "bundle_lzma": (lambda f: writers.bundle([("x.resource", b"x" * 99), ("a.assets", f)], 8, 1, 100), "::a.assets"),
    "old_bundle": (lambda f: writers.old_bundle([("a.assets", f)]), "::a.assets"), "old_bundle_stored": (lambda f: writers.old_bundle([("a.assets", f)], False), "::a.assets"),
    "web": (lambda f: writers.web([("data/a.assets", f)]), "::data/a.assets"), "gzip": (writers.gzipped, ""), "zip": (lambda f: writers.zipped([("in/a.assets", f)]), "::in/a.assets"),
    "zip_stored": (lambda f: writers.zipped([("a.assets", f)], 0), "::a.assets"), "embedded_bundle": (lambda f: b"junk" * 9 + writers.bundle([("a.assets", f)]), "::a.assets"),
    "nested": (lambda f: writers.zipped([("one.gz", writers.gzipped(writers.web([("b", writers.bundle([("a.assets", f)]))])))]), "::one.gz::b::a.assets"),
}


def _scan(kind: str, ids: str) -> None:
    around, label = AROUND[kind]

    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(table(spark, sf_dir, "nation"), "n_regionkey", lambda pdf: around(_texts(pdf)), "r")
        values = Catalog.of(files).values([TEXT])
        return values.select("file", "path_id", "name", F.from_json("value", "m_Script array<int>")["m_Script"].alias("script")).select("file", "path_id", "name", F.size("script").cast("long").alias("bytes"))

    scan.__name__, scan.__doc__ = f"scan_{kind}", f"{ids}: objects of files within each other, by their labels."
    query(f"SELECT 'r' || n_regionkey || '{label}' AS file, CAST(n_nationkey + 1 AS BIGINT) AS path_id, n_name AS name, CAST(length('nation ' || n_nationkey) AS BIGINT) AS bytes FROM nation")(scan)


for _kind, _ids in (
    ("serialized", "SRC-02, SRC-07, SRC-16, SRC-19, SRC-20, PRJ-09"), ("bundle", "SRC-08, SRC-09"), ("bundle_stored", "SRC-08"), ("bundle_lzma", "SRC-08, SRC-09"), ("old_bundle", "SRC-10"), ("old_bundle_stored", "SRC-10"),
    ("web", "SRC-11"), ("gzip", "SRC-12"), ("zip", "SRC-14"), ("zip_stored", "SRC-14"), ("embedded_bundle", "SRC-07"), ("nested", "SRC-15"),
):
    _scan(_kind, _ids)


@query("SELECT 'f' || n_regionkey AS file, count(*) AS objects, CAST(min(n_nationkey + 1) AS BIGINT) AS first_id, '2022.3.62f2' AS unity_version FROM nation GROUP BY 1")
def catalog_files(spark, sf_dir):
    """PRJ-01, SRC-16, AGG-02: files with their versions and objects."""
    found = Catalog.of(_files(table(spark, sf_dir, "nation"), "n_regionkey", _texts, "f"))
    objects = found.objects.groupBy("file").agg(F.count(F.lit(1)).alias("objects"), F.min("path_id").alias("first_id"))
    return objects.join(found.files.select("file", "unity_version"), "file").select("file", "objects", "first_id", "unity_version")


@query("""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS path_id, CAST(4 + length(n_name) + (4 - length(n_name) % 4) % 4 + 4 + length('nation ' || n_nationkey) AS BIGINT) AS size, n_nationkey || '' AS tail FROM nation""")
def raw_objects(spark, sf_dir):
    """PRJ-02: the bytes of each object."""
    raw = Catalog.of(_files(table(spark, sf_dir, "nation"), "n_regionkey", _texts)).raw()
    tail = F.regexp_extract(F.decode(F.expr("substring(bytes, octet_length(bytes) - 8, 9)"), "ISO-8859-1"), r"nation (\d+)$", 1)
    return raw.select("path_id", F.octet_length("bytes").cast("long").alias("size"), tail.alias("tail"))


#: A made-up class: a name, a number, a balance, a flag, and lists.
NODES = [
    (0, "Custom", "Base", -1, 0, 0), (1, "string", "m_Name", -1, 0, 0x4000), (2, "Array", "Array", -1, 1, 0x4000), (3, "int", "size", 4, 0, 0), (3, "char", "data", 1, 0, 0),
    (1, "vector", "keys", -1, 0, 0), (2, "Array", "Array", -1, 1, 0), (3, "int", "size", 4, 0, 0), (3, "SInt64", "data", 8, 0, 0), (1, "bool", "negative", 1, 0, 0x4000),
    (1, "Pair", "pair", -1, 0, 0), (2, "int", "first", 4, 0, 0), (2, "double", "second", 8, 0, 0),
]


def _suppliers(pdf: pd.DataFrame) -> bytes:
    objects = []
    for key, name, nation, balance in zip(*(pdf[c].tolist() for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))):
        body = writers.text(name) + struct.pack("<iqq", 2, key, nation) + struct.pack("<b3x", balance < 0) + struct.pack("<id", nation, balance)
        objects.append((key, CUSTOM, body))
    return writers.serialized(objects, trees={CUSTOM: NODES})


_SUPPLIERS = "SELECT CAST(s_suppkey AS BIGINT) AS path_id, s_name AS name, s_acctbal AS second, s_acctbal < 0 AS negative, CAST(s_suppkey + s_nationkey AS BIGINT) AS total FROM supplier"


@query(_SUPPLIERS)
def type_tree_values(spark, sf_dir):
    """PRJ-03, ARR-01 to ARR-03: objects decoded by the type trees that their files carry."""
    values = Catalog.of(_files(table(spark, sf_dir, "supplier"), "s_nationkey", _suppliers)).values([CUSTOM])
    v = F.from_json("value", "keys array<long>, negative boolean, pair struct<first: int, second: double>")
    return values.select("path_id", "name", v.alias("v")).select("path_id", "name", "v.pair.second", "v.negative", (F.get("v.keys", F.lit(0)) + F.get("v.keys", F.lit(1))).alias("total"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS path_id, s_name AS name, '{\"negative\": ' || (s_acctbal < 0) || '}' AS value FROM supplier")
def type_tree_fields(spark, sf_dir):
    """PRJ-04: one root field; the others are passed over."""
    return Catalog.of(_files(table(spark, sf_dir, "supplier"), "s_nationkey", _suppliers)).values([CUSTOM], ["negative"]).select("path_id", "name", "value")


@query("SELECT CAST(s_suppkey AS BIGINT) AS path_id, s_name AS name FROM supplier UNION ALL SELECT n_nationkey + 1, n_name FROM nation")
def object_names(spark, sf_dir):
    """PRJ-07, PRJ-18: names by type tree and by fixed layout, without decoding the rest."""
    files = _files(table(spark, sf_dir, "supplier"), "s_nationkey", _suppliers, "s").unionByName(_files(table(spark, sf_dir, "nation"), "n_regionkey", _texts, "n"))
    return Catalog.of(files).names().select("path_id", "name")


def _references(files: DataFrame) -> Catalog:
    return Catalog.of(files)


@query("""
SELECT n.n_nationkey AS path_id, 'region' || '' AS target_file, CAST(r.r_regionkey + 1 AS BIGINT) AS target FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE n.n_regionkey < 4""")
def references_between_files(spark, sf_dir):
    """JOIN-01, JOIN-02: references through a file's externals, by portable names; what dangles finds nothing."""
    regions, nations = table(spark, sf_dir, "region").filter("r_regionkey < 4").withColumn("one", F.lit(0)), table(spark, sf_dir, "nation").withColumn("one", F.lit(0))
    target = _files(regions, "one", lambda pdf: writers.serialized([(int(k) + 1, TEXT, writers.text_asset(n, b"")) for k, n in zip(pdf["r_regionkey"], pdf["r_name"])])).withColumn("root", F.lit("region"))
    source = _files(nations, "one", lambda pdf: writers.serialized([(int(k) + 1, TEXT, writers.text_asset(n, b"")) for k, n in zip(pdf["n_nationkey"], pdf["n_name"])], externals=["lib/REGION"])).withColumn("root", F.lit("nation"))
    found = Catalog.of(target.unionByName(source))
    asked = nations.select(F.lit("nation").alias("file"), F.lit(1).alias("file_id"), (F.col("n_regionkey") + 1).cast("long").alias("path_id"), "n_nationkey")
    return found.resolve(asked, [TEXT]).filter("target_file is not null").select(F.col("n_nationkey").alias("path_id"), "target_file", F.col("path_id").alias("target"))


@query("SELECT 'r' || n_regionkey AS file, CAST(n_nationkey + 1 AS BIGINT) AS path_id, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 2 THEN 'first' ELSE 'rest' END AS container FROM nation")
def containers_of_objects(spark, sf_dir):
    """JOIN-04, PRJ-08: containers by the slices of a bundle's preload table, of overlapping ones the later."""

    def make(pdf: pd.DataFrame) -> bytes:
        keys = sorted(k + 1 for k in pdf["n_nationkey"].tolist())
        objects = [(k, TEXT, writers.text_asset("t", b"")) for k in keys]
        return writers.serialized([*objects, (1000, BUNDLE, writers.asset_bundle("ab", [(0, k) for k in keys], [("rest", 0, len(keys)), ("first", 0, 2)]))])

    return Catalog.of(_files(table(spark, sf_dir, "nation"), "n_regionkey", make, "r")).containers().select("file", "path_id", "container")


def _scene(spark, sf_dir) -> Catalog:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))

    def make(pdf: pd.DataFrame) -> bytes:
        pdf = pdf.sort_values("n_nationkey")
        keys = pdf["n_nationkey"].tolist()
        objects = [(1, GAME_OBJECT, writers.game_object([2], pdf["r_name"].iloc[0])), (2, TRANSFORM, writers.transform(1, 0, [2 * k + 11 for k in keys]))]
        for k, n in zip(keys, pdf["n_name"]):
            objects += [(2 * k + 10, GAME_OBJECT, writers.game_object([2 * k + 11], n)), (2 * k + 11, TRANSFORM, writers.transform(2 * k + 10, 2))]
        return writers.serialized(objects)

    return Catalog.of(_files(rows, "r_regionkey", make, "s"))


@query("""
SELECT 's' || r_regionkey AS file, CAST(1 AS BIGINT) AS path_id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 's' || n_regionkey, 2 * n_nationkey + 10, n_name, 1 FROM nation""")
def scene_nodes(spark, sf_dir):
    """HIER-01, JOIN-07, JOIN-08, PRJ-12: nodes and their parents, through transforms and their owners."""
    return _scene(spark, sf_dir).scene().select("file", "path_id", "name", "parent_id")


@query("SELECT 's' || n_regionkey AS file, count(*) + 1 AS transforms, CAST(16 AS INTEGER) AS numbers FROM nation GROUP BY 1")
def scene_matrices(spark, sf_dir):
    """HIER-06, NUM-12: a global matrix for each transform."""
    return _scene(spark, sf_dir).global_matrices().groupBy("file").agg(F.count(F.lit(1)).alias("transforms"), F.max(F.size("matrix")).alias("numbers"))


def _mapped(df: DataFrame, schema: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield make(frame)

    return df.mapInPandas(run, schema)


_PIXELS = "CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1.0) / 2.0 * 255 + 0.5))) AS INTEGER)"


@query(f"SELECT vec_id, CAST(sum({_PIXELS}) AS BIGINT) AS total, CAST(max({_PIXELS}) AS INTEGER) AS top FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def pixel_round_trip(spark, sf_dir):
    """MED-01, MED-09: 4 x 4 pixels of four bytes, written and read as images."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, values in zip(frame["vec_id"], frame["embedding"]):
            raw = np.clip(np.floor((np.asarray(values, np.float32).astype(np.float64) + 1.0) / 2.0 * 255 + 0.5), 0, 255).astype(np.uint8)
            pixels = images.decode(4, raw.tobytes(), 4, 4)
            out.append((key, int(pixels.astype(np.int64).sum()), int(pixels.max())))
        return pd.DataFrame(out, columns=["vec_id", "total", "top"])

    return _mapped(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id long, total long, top int", make)


@query("""
SELECT vec_id, CAST(sum(s) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS frames FROM (SELECT vec_id, CAST(greatest(-32768, least(32767, floor(CAST(v AS DOUBLE) * 1000))) AS BIGINT) AS s FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings)) GROUP BY 1""")
def sound_round_trip(spark, sf_dir):
    """MED-11, MED-12, MED-15: samples as a sound bank, read back through a WAV."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, values in zip(frame["vec_id"], frame["embedding"]):
            samples = np.clip(np.floor(np.asarray(values, np.float32).astype(np.float64) * 1000), -32768, 32767).astype("<i2")
            wav = audio.to_wav(audio.to_wav(writers.sound_bank([(8, 1, samples.tobytes())])))
            back = np.frombuffer(wav[44:], "<i2")
            out.append((key, int(back.astype(np.int64).sum()), len(back)))
        return pd.DataFrame(out, columns=["vec_id", "total", "frames"])

    return _mapped(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id long, total long, frames long", make)


@query("SELECT 'r' || n_regionkey || '.assets' AS file, count(*) AS objects FROM nation GROUP BY 1")
def scan_split_files(spark, sf_dir):
    """SRC-04, SRC-05: files in parts of 100 bytes, put together and read."""
    files = _files(table(spark, sf_dir, "nation"), "n_regionkey", _texts, "r")
    count = F.ceil(F.octet_length("content") / 100).cast("int")
    parts = files.select("root", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    parts = parts.select(F.concat("root", F.lit(".assets.split"), F.col("i")).alias("root"), F.expr("substring(content, i * 100 + 1, 100)").alias("content"))
    return Catalog.of(catalog.join_splits(parts)).objects.groupBy("file").agg(F.count(F.lit(1)).alias("objects"))
