"""SimHash near-duplicates: fingerprints of shingles, linked by exact tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.llm.common import NOT_SPACE, blocks, grams, join_small, materialize, mix, pack, pick, text_of, unpack
from assetlake.llm.components import components

SHINGLE, RADIUS, SEED, TILE = 3, 3, 42, 64
#: Shingle hashes whose bits are counted at once, and tile pairs that are compared at once.
CHUNK, SLAB = 1 << 16, 128
#: Rows of a bucket that one task compares; a larger bucket is dealt as pairs of parts.
PER_TASK = 1 << 14
#: Near copies of whole texts: words in a shingle, and the least similarity.
LONG_SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which the fingerprints of 128 bits of sets of that similarity may differ: 20 are to be expected at 0.8, 64
#: of unlike sets.
LOOSE = 40
#: Minima of hashed shingles of a set: so many bands of so many. Sets with a similarity of 0.8 have no band in common
#: once in 20 million pairs ((1 - 0.8 ** 4) ** 32), those of 0.85 once in 10 billion.
BANDS, MINIMA = 32, 4
#: Fixed pseudo-random numbers of the minima's hash functions: what is added, and odd factors.
_ADD, _FACTOR = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * MINIMA, 1), np.uint32) | np.array([0, 1], np.uint32).reshape(2, 1, 1)
#: Rows of two numbers that are broadcast at most.
MANY = 200_000
#: Sets that one task compares whole: so many that may lack a link with so many others.
LACKING, OTHERS = 256, 2048


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 for null or a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for a in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + CHUNK], ends[shingle - 1 + a : shingle - 1 + a + CHUNK])], "<u8")
        ones += ones_of(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits, ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), np.zeros(64, np.int64)
    for b in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
        ones += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return ones


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long of the same bits."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return run(text)


# ---------------------------------------------------------------- tiles
def _forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of each pair: the least label of what is reachable."""
    while True:
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def tiled(bucket: np.ndarray, value: np.ndarray, radius: int = RADIUS, size: np.ndarray | None = None, ratio: float = 0.0, tile: int = TILE, verify=None, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) that span the same components as all pairs of a bucket within the radius.

    Rows are sorted by bucket and population count and cut into tiles. A pair of tiles that have no
    bucket in common, or whose counts differ beyond the radius, is skipped; any other is compared whole
    by exclusive-or and bit counts. size: of any pair, the smaller must be `ratio` of the larger at
    least. verify: tells for two rows whether a pair that fits is a link indeed. more: further bits of the values.
    """
    n = len(value)
    ones = np.bitwise_count(value).astype(np.int64) + (0 if more is None else np.bitwise_count(more).astype(np.int64))
    order = np.lexsort((value, ones, bucket))
    tiles = -(-n // tile)
    spare = tiles * tile - n
    b = np.r_[bucket[order], np.arange(-spare, 0) + (bucket.min(initial=0) - 1)].reshape(tiles, tile) if n else np.zeros((0, tile), np.int64)
    v = np.r_[value[order], np.zeros(spare, value.dtype)].reshape(tiles, tile)
    o = np.r_[ones[order], np.zeros(spare, np.int64)].reshape(tiles, tile)
    m = None if more is None else np.r_[more[order], np.zeros(spare, more.dtype)].reshape(tiles, tile)
    s = None if size is None else np.r_[size[order], np.zeros(spare, size.dtype)].reshape(tiles, tile).astype(np.float64)
    label, apart = np.arange(n), 0
    left = np.arange(tiles)
    while len(left):
        for at in range(0, len(left), SLAB):
            x = left[at : at + SLAB]
            y = x + apart
            apart_by = np.bitwise_count(v[x][:, :, None] ^ v[y][:, None, :])
            if m is not None:
                apart_by = apart_by + np.bitwise_count(m[x][:, :, None] ^ m[y][:, None, :])
            near = (apart_by <= radius) & (b[x][:, :, None] == b[y][:, None, :])
            if s is not None:
                p, q = s[x][:, :, None], s[y][:, None, :]
                near &= np.minimum(p, q) >= ratio * np.maximum(p, q)
            t, i, j = np.nonzero(near)
            i, j = x[t] * tile + i, y[t] * tile + j
            real = (i < j) & (j < n)
            i, j = i[real], j[real]
            if verify is not None:
                for k, l_ in zip(i.tolist(), j.tolist()):  # only what joins two classes is verified
                    if label[k] != label[l_] and verify(order[k], order[l_]):
                        label = _forest(np.array([k]), np.array([l_]), label)
                continue
            differ = label[i] != label[j]
            if differ.any():
                label = _forest(i[differ], j[differ], label)
        apart += 1
        left = left[left + apart < tiles]
        left = left[(b[left, -1] == b[left + apart, 0]) & (o[left + apart, 0] - o[left, -1] <= radius)]
    own = np.flatnonzero(label != np.arange(n))
    return order[own], order[label[own]]


def _to_least(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that form stars as pairs (node, least node of its star)."""
    least = node.copy()
    np.minimum.at(least, j, node[i])
    centre = least[j]
    a, b = np.r_[node[i], node[j]], np.r_[centre, least[j]]
    differ = a != b
    return a[differ], b[differ]


def _edges(batches: Iterator[pa.RecordBatch], radius: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """Compare the rows (bucket, node, fp, size and perhaps more bits) of each bucket; rows come sorted by bucket."""
    kept: list[np.ndarray] | None = None

    def compare(bucket, node, fp, size, more=None) -> pa.RecordBatch:
        i, j = tiled(bucket, fp.view(np.uint64), radius, size, ratio, more=None if more is None else more.view(np.uint64))
        a, b = _to_least(i, j, node)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if kept is not None:
            rows = [np.r_[x, y] for x, y in zip(kept, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.flatnonzero(rows[0] == rows[0][-1])[0])  # the last bucket may go on in the next batch
        kept = [x[cut:] for x in rows]
        if cut:
            yield compare(*[x[:cut] for x in rows])
    if kept is not None:
        yield compare(*kept)


def compared(rows: DataFrame, radius: int, ratio: float = 0.0, per_task: int = PER_TASK) -> DataFrame:
    """Edges (a, b) that span the components of the rows (bucket, node, fp, size, and perhaps more) that share a bucket and fit.

    A bucket of more than per_task rows is cut into parts by a hash of the node, and each pair of
    parts is a bucket of its own, so no task holds more than twice as many."""
    columns = [c for c in rows.columns if c != "bucket"]
    large = materialize(rows.groupBy("bucket").count().filter(F.col("count") > per_task))
    n = large.count()
    if n:
        parts = F.ceil(F.col("count") / per_task).cast("int")
        part = F.pmod(F.xxhash64("node"), parts).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.xxhash64(F.col("bucket"), F.least(k, part), F.greatest(k, part)))
        split = F.when(F.col("count").isNull(), F.array("bucket")).otherwise(pairs)
        rows = join_small(rows, large, "bucket", "left", n).select(F.explode(split).alias("bucket"), *columns)
    dealt = rows.select("bucket", *columns).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: _edges(it, radius, ratio), "a long, b long").distinct()


def links(values: DataFrame, radius: int = RADIUS, per_task: int = PER_TASK) -> DataFrame:
    """Edges (a, b) that span the components of distinct long values (column fp) within 3 differing bits.

    Which tiles can hold a pair: of four 16-bit parts one is equal in any pair within radius 3,
    and of the other 48 bits' four 12-bit parts another; so each value goes to 16 buckets of 28
    bits, and no pair is lost. Within a bucket the comparison is tiled (see tiled()).
    """
    if radius > 3:
        raise ValueError("four parts find pairs of up to three differing bits")
    bits = lambda x, low, n: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    fp, keys = F.col("fp"), []
    for p in range(4):
        key = bits(fp, 16 * p, 16)
        # the other 48 bits, joined to one number
        low = fp.bitwiseAND(F.lit((1 << (16 * p)) - 1).cast("long")) if p else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, 16 * p + 16) if p < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * p).bitwiseOR(low)
        keys += [(F.lit((p * 4 + s) << 28) + F.shiftleft(key, 12) + bits(rest, 12 * s, 12)).cast("long") for s in range(4)]
    dealt = values.select(F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("node"), "fp", F.lit(1).alias("size"))
    return compared(dealt, radius, per_task=per_task)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    A text without words (null, empty) has fingerprint zero and is linked like any other.
    Repeated rows share a component; a null id never names one unless all ids of the component
    are null. Other columns are not read; an empty table gives an empty result.
    """
    slim = pick(docs, doc_id=id_col, text=text_col)
    printed = materialize(slim.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")))
    # a fingerprint stands for all its documents: copies are linked by it, not in pairs
    classes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = materialize(components(links(classes.select("fp"), radius)))
    labelled = classes.join(grouped.withColumnRenamed("node", "fp"), "fp", "inner").select("fp", "least", "component")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(least, "component").select(F.col("node").alias("fp"), "component_id"))
    final = classes.join(named, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    final = materialize(final)  # so that the join can split a fingerprint that very many documents share
    return printed.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies of whole texts
def shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts (first text, hashes, bounds): the distinct hashes of each text's shingles of k words,
    ascending. A text of fewer words is one shingle; one without words has none."""
    for at, to, block in blocks(texts, NOT_SPACE):
        h, bounds, owner = block.hashes(), block.bounds, block.owners()
        g, whole = grams(h, bounds, k)
        counts = np.diff(bounds)
        few = np.flatnonzero((counts > 0) & (counts < k))
        lone = []
        for i in few.tolist():
            x = h[bounds[i] : bounds[i + 1]]
            lone.append(int(mix(np.array([np.bitwise_xor.reduce(mix(x + np.arange(1, len(x) + 1, dtype=np.uint64)))]))[0]))
        owner, g = np.r_[owner[whole], few], np.r_[g[whole], np.array(lone, np.uint64)]
        order = np.lexsort((g, owner))
        owner, g = owner[order], g[order]
        once = np.ones(len(g), bool)
        once[1:] = (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])
        owner, g = owner[once], g[once]
        yield at, g, np.searchsorted(owner, np.arange(to - at + 1))


def bands(own: np.ndarray) -> np.ndarray:
    """The buckets of a set of hashes: one for each band of minima under hash functions of their own."""
    x, least = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * MINIMA, (1 << 32) - 1, np.uint32)
    for a in range(0, len(x), 1024):
        hashed = x[None, a : a + 1024] + _ADD
        hashed *= _FACTOR
        np.minimum(least, hashed.min(axis=1), out=least)
    pairs = least.view("<u8").reshape(BANDS, MINIMA // 2)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(MINIMA // 2):
        out = mix(out + pairs[:, i])
    return out


SET = "struct<class: long, n: int, fp: long, more: long, tokens: binary>"


def sets(texts: pa.Array, k: int, banded: bool) -> pa.Array:
    """For each text: a hash of its set of shingles, its size, its fingerprint and the buckets of its bands; unless
    `banded`, 32 bits of all its shingles in place of the latter two."""
    out: list[tuple] = []
    for _, g, bounds in shingles(texts, k):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own, n = g[a:b], b - a
            whole = int(mix(np.array([(mix(own.copy()).sum(dtype=np.uint64) if n else np.uint64(0)) + np.uint64(n)], np.uint64)).view(np.int64)[0])
            if not banded:
                out.append((whole, n, 0, 0, (own >> np.uint64(32)).astype("<u4").tobytes()))
                continue
            prints = []
            for h in (own, mix(own + np.uint64(1))):
                ones = sum((ones_of(h[c : c + CHUNK]) for c in range(0, n, CHUNK)), np.zeros(64, np.int64))
                prints.append(int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0]))
            out.append((whole, n, *prints, bands(own).tobytes() if n else b"\0" * 8))
    names = ("class", "n", "fp", "more", "tokens")
    return pa.StructArray.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (bucket, node, fp, size, more) for each band of each class."""
    for batch in batches:
        whole, n, fp, more = (batch.column(i).to_numpy() for i in range(4))
        blobs = batch.column(4)
        counts = np.array([len(x.as_buffer()) // 8 for x in blobs], np.int64)
        for a in range(0, len(counts), 256):
            c = counts[a : a + 256]
            bucket = np.frombuffer(b"".join(x.as_py() for x in blobs.slice(a, 256)), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *[pa.array(np.repeat(x[a : a + 256], c)) for x in (whole, fp, n, more)]], ["bucket", "node", "fp", "size", "more"])


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets (sorted arrays) is reached; two empty ones are alike."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    common = len(np.intersect1d(a, b, assume_unique=False))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _closed(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of the rows (bucket, node, lacking, set) of each bucket, every pair with one that lacks a link that could
    join two classes compared whole; rows come sorted by bucket."""
    now, nodes, lacking, own = None, [], [], []

    def linked() -> pa.RecordBatch:
        node, size = np.array(nodes, np.int64), np.array([len(x) for x in own])
        same = np.zeros(len(node), np.int64)
        i, j = tiled(same, same.view(np.uint64), 64, size, similarity, verify=lambda x, y: (lacking[x] or lacking[y]) and similar(own[x], own[y], similarity))
        a, b = _to_least(i, j, node)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for bucket, node, lacks, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and nodes:
                yield linked()
                for kept in (nodes, lacking, own):
                    kept.clear()
            now = bucket
            nodes.append(node)
            lacking.append(lacks)
            own.append(np.unique(np.frombuffer(blob, "<u4")))
    if nodes:
        yield linked()


def similar_classes(docs: DataFrame, k: int = LONG_SHINGLE, similarity: float = SIMILARITY, loose: int = LOOSE, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """docs (id, key, text) as (id, key, class): texts with equal sets of shingles share a class; and
    (class, component) of the classes that are linked to others by a similarity that is reached.

    Sets that share a band of minima (of those as similar next to all do) are compared in tiles of
    fingerprints, within a radius that hardly any similar pair exceeds, and what fits is verified by the real
    similarity: each set with the centre of its star, and where a component thereby falls apart, what isn't
    of its largest class with all of it. A text has as many bands whatever its length, and a passage that
    very many texts share brings together only those that it makes alike.
    """

    def column(banded: bool) -> Column:
        @arrow_udf(SET)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield sets(texts, k, banded)

        return run(F.col("text"))

    made = materialize(docs.select("id", "key", column(True).alias("s")).select("id", "key", "s.class", "s.n", "s.fp", "s.more", "s.tokens"))
    rows, tokens = made.select("id", "key", "class"), made.select("class", "n", "fp", "more", "tokens")
    tokens = materialize(tokens.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "fp", "more", "tokens")]))
    dealt = tokens.mapInArrow(_tokens, "bucket long, node long, fp long, size int, more long")
    stars = materialize(compared(dealt, loose, similarity, per_task))
    candidates = materialize(components(stars))
    n = candidates.count()
    if not n:
        return rows, candidates.select(F.col("node").alias("class"), "component")

    # the whole sets of the classes that may be linked, of one text each; of very many, all texts are read in place
    if n <= MANY:
        one = rows.join(F.broadcast(candidates), F.col("class") == F.col("node")).groupBy("class").agg(F.min("key").alias("key"))
        docs = docs.join(F.broadcast(materialize(one.select("key").distinct())), "key", "left_semi")
    whole = docs.select(column(False).alias("s")).select(F.col("s.class").alias("node"), F.col("s.tokens").alias("set"))
    whole = materialize(join_small(whole, candidates, "node", "inner", n).groupBy("node", "component").agg(F.first("set").alias("set")))

    @arrow_udf("boolean")
    def reached(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([similar(np.unique(np.frombuffer(x.as_py(), "<u4")), np.unique(np.frombuffer(y.as_py(), "<u4")), similarity) for x, y in zip(left, right)], pa.bool_())

    both = stars.join(whole.select(F.col("node").alias("a"), F.col("set").alias("left")), "a").join(whole.select(F.col("node").alias("b"), F.col("set").alias("right")), "b")
    sure = materialize(both.filter(reached("left", "right")).select("a", "b"))
    settled = materialize(components(sure).withColumnRenamed("component", "own"))
    # components that fall apart: what isn't of their largest class is compared with all of them
    parts = candidates.join(settled, "node", "left").select("node", "component", F.coalesce("own", "node").alias("own"))
    sizes = parts.groupBy("component", "own").count()
    sizes = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("members"), F.max("count").alias("most"), F.max_by("own", F.struct("count", "own")).alias("main"))
    open_ = materialize(sizes.filter("kinds > 1").select("component", "main", F.ceil((F.col("members") - F.col("most")) / LACKING).cast("int").alias("p"), F.ceil(F.col("members") / OTHERS).cast("int").alias("q")))
    m = open_.count()
    if m:
        members = join_small(parts, open_, "component", "inner", m)
        members = materialize(members.select("node", "p", "q", "component", (F.col("own") != F.col("main")).alias("lacking")))
        held = whole.drop("component").join(members, "node")
        place = lambda by, seed: F.pmod(F.xxhash64("node", F.lit(seed)), by).cast("int")
        every = lambda by: F.explode(F.sequence(F.lit(0), by - 1))
        mine = held.filter("lacking").select("component", place(F.col("p"), 1).alias("i"), every(F.col("q")).alias("j"), "node", F.lit(True).alias("lacking"), "set")
        others = held.select("component", every(F.col("p")).alias("i"), place(F.col("q"), 2).alias("j"), "node", F.lit(False).alias("lacking"), "set")
        groups = mine.unionByName(others).select(F.xxhash64("component", "i", "j").alias("bucket"), "node", "lacking", "set")
        more = groups.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _closed(it, similarity), "a long, b long")
        settled = materialize(components(sure.unionByName(more.distinct())).withColumnRenamed("component", "own"))
    return rows, settled.select(F.col("node").alias("class"), F.col("own").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, one of each group of near copies: that of the smallest id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
    (words cut at white space, lower-cased in A-Z; a shorter text is one shingle), and groups are what
    such links connect. Texts without words, null ones too, are copies of each other. A null id is above
    every other; of rows that share id and text exactly one stays, whatever their other columns.
    An empty table gives an empty result.
    """
    key = F.xxhash64(F.col("_id").cast("string"), F.col("_text"))
    packed = pack(docs, _id=id_col, _text=text_col).select("_row", "_id", text_of("_text").alias("_text")).withColumn("_key", key)
    rows, grouped = similar_classes(packed.select(F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("_text").alias("text")), **options)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    n = grouped.count()
    rows = rows.join(grouped, "class", "left") if n > MANY else join_small(rows, grouped, "class", "left", n)
    rows = materialize(rows.select("id", "key", F.coalesce("component", "class").alias("component")))
    groups = rows.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    groups = materialize(groups.select("component", "first"))
    members = join_small(rows, groups, "component", "inner", groups.count())
    firsts = members.filter(order == F.col("first"))
    gone = materialize(members.filter(order != F.col("first")).select(F.col("id").alias("_gone_id"), F.col("key").alias("_key")).distinct())
    again = materialize(firsts.groupBy("id", "key").count().filter("count > 1").select(F.col("id").alias("_gone_id"), F.col("key").alias("_key")))
    few, many = again.count(), gone.count()
    small = lambda frame, rows_: F.broadcast(frame) if rows_ <= MANY else frame.hint("shuffle_hash")
    gone, again = gone.withColumnRenamed("_key", "_gone_key"), again.withColumnRenamed("_key", "_again_key").withColumnRenamed("_gone_id", "_again_id")
    same_gone = (F.col("_key") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone_id"))
    left = packed.join(small(gone, many), same_gone, "left_anti")
    if few:
        same_again = (F.col("_key") == F.col("_again_key")) & F.col("_id").eqNullSafe(F.col("_again_id"))
        one = left.join(small(again, few), same_again, "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
        left = left.join(small(again, few), same_again, "left_anti").select("_row").unionByName(one.select("_row"))
    return unpack(left, docs)
