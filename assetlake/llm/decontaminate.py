"""Benchmark decontamination with suffix arrays over the training words.

The training texts are cut into shards. Each shard sorts its suffixes (of words), and every test
suffix is found in that array by binary search: the range of suffixes that begin with the test
window gives all its verbatim occurrences, and chained occurrences give the longest matches with
their places. Words inside an occurrence are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.llm.common import ALNUM, BLOCK_BYTES, Block, blocks, materialize, pack, pick, raw, unpack

WINDOW = 10
#: Bytes of benchmark text that one broadcast holds; more text is searched in several passes.
TEST_BYTES = 4 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = BLOCK_BYTES
MATCH = pa.struct([("item_id", pa.string()), ("doc_pos", pa.int64()), ("item_pos", pa.int64()), ("length", pa.int64())])
RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(MATCH))])
SCHEMA = "struct<n_words: long, n_hit: long, items: array<string>, matches: array<struct<item_id: string, doc_pos: long, item_pos: long, length: long>>>"


class Tests:
    """A block of benchmark items: its vocabulary, and a row of word ids for each test window."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        data, offsets = raw(pa.array(texts, pa.string()))
        block = Block(data, offsets, ALNUM)
        found, where = np.unique(block.hashes(), return_inverse=True)
        at = np.zeros(len(found), np.int64)
        at[where] = np.arange(len(where))
        self.hashes, self.words = found, [block.word(i) for i in at]
        self.ids = ids
        self.items, self.at, rows, self.sizes = [], [], [], []
        for k in range(len(texts)):
            words = where[block.bounds[k] : block.bounds[k + 1]] + 1
            size = min(window, len(words))
            for p in range(len(words) - size + 1 if size else 0):
                rows.append(np.pad(words[p : p + size], (0, window - size)))
                self.items.append(k)
                self.at.append(p)
                self.sizes.append(size)
        self.rows = np.array(rows, np.int64).reshape(-1, window)
        self.items, self.at, self.sizes = np.array(self.items, np.int64), np.array(self.at, np.int64), np.array(self.sizes, np.int64)
        self.shortest = int(self.sizes.min()) if len(rows) else 0
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(found >> np.uint64(48)).astype(np.int64)] = True


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of words, sorted by their first `depth` words at least, by prefix doubling."""
    rank, reach = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - reach] = rank[reach:] + 1
        key = rank * (len(rank) + 2) + later
        order = np.argsort(key, kind="stable")
        fresh = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(len(rank), np.int64)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == len(rank) - 1:
            break
    return np.argsort(rank, kind="stable")


def _search(array: np.ndarray, words: np.ndarray, rows: np.ndarray, sizes: np.ndarray, right: bool) -> np.ndarray:
    """For each row, the first place in the suffix array that isn't before it (right: after all that begin with it)."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
    padded = np.r_[words, np.zeros(rows.shape[1], np.int64)]
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        before, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for j in range(rows.shape[1]):
            use = equal & (j < sizes[open_])
            here, wanted = padded[array[mid] + j], rows[open_, j]
            before |= use & (here < wanted)
            equal &= ~use | (here == wanted)
        before |= equal & right
        low[open_[before]] = mid[before] + 1
        high[open_[~before]] = mid[~before]
    return low


def _occurrences(block: Block, hashes: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(word of the block, test window) of every occurrence of a window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(tests.rows):
        return none
    ids = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(tests.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(tests.hashes, hashes[maybe]), len(tests.hashes) - 1)
    ids[maybe] = np.where(tests.hashes[at] == hashes[maybe], at + 1, 0)

    def long_runs() -> np.ndarray:
        """Words in a run of test words that can hold the shortest window: no other suffix can match."""
        known = ids > 0
        starts = known & ~np.r_[False, known[:-1]]
        starts[block.bounds[:-1][block.bounds[:-1] < len(ids)]] &= True
        edge = np.zeros(len(ids), bool)
        edge[block.bounds[:-1][block.bounds[:-1] < len(ids)]] = True
        starts |= known & edge
        run = np.cumsum(starts)
        sizes = np.bincount(run[known], minlength=run[-1] + 1 if len(run) else 1)
        return np.flatnonzero(known & (sizes[run] >= tests.shortest)) if len(ids) else none[0]

    kept = long_runs()
    wrong = [i for i in kept.tolist() if block.word(i) != tests.words[ids[i] - 1]] if len(kept) else []
    if wrong:  # equal hashes of different words
        ids[wrong] = 0
        kept = long_runs()
    if not len(kept):
        return none
    # the runs one after the other, each followed by a 0 that no window holds
    owner = np.searchsorted(block.bounds, kept, "right")
    breaks = np.r_[False, (np.diff(kept) != 1) | (np.diff(owner) != 0)]
    place = np.arange(len(kept)) + np.cumsum(breaks)
    words, origin = np.zeros(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
    words[place], origin[place] = ids[kept], kept
    array = suffix_array(words, tests.rows.shape[1])
    low, high = (_search(array, words, tests.rows, tests.sizes, right) for right in (False, True))
    counts = high - low
    which = np.repeat(np.arange(len(low)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return origin[array[low[which] + inner]], which


def search(texts: pa.Array, tests: Tests) -> pa.Array:
    """For each text: its words, the words hit, the items found and the longest matches."""
    out = []
    for at, to, block in blocks(texts, ALNUM, SHARD_BYTES):
        hashes, owner = block.hashes(), block.owners()
        n, cover = np.diff(block.bounds), np.zeros(len(block.first) + 1, np.int64)
        found: list[set] = [set() for _ in range(at, to)]
        matches: list[list] = [[] for _ in range(at, to)]
        word, window = _occurrences(block, hashes, tests)
        if len(word):
            np.add.at(cover, word, 1)
            np.add.at(cover, word + tests.sizes[window], -1)
            doc, item = owner[word], tests.items[window]
            order = np.lexsort((word, word - tests.at[window], item, doc))
            doc, item, word, window = doc[order], item[order], word[order], window[order]
            place, size = tests.at[window], tests.sizes[window]
            chained = (np.diff(doc) == 0) & (np.diff(item) == 0) & (np.diff(word - place) == 0) & (np.diff(word) == 1)
            starts = np.flatnonzero(np.r_[True, ~chained])
            ends = np.r_[starts[1:], len(doc)] - 1
            for s, e in zip(starts.tolist(), ends.tolist()):
                name = tests.ids[item[s]]
                found[doc[s]].add(name)
                matches[doc[s]].append({"item_id": name, "doc_pos": int(word[s] - block.bounds[doc[s]]), "item_pos": int(place[s]), "length": int(word[e] - word[s] + size[e])})
        hit = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=to - at)
        for k in range(to - at):
            out.append({"n_words": int(n[k]), "n_hit": int(hit[k]), "items": sorted(x for x in found[k] if x is not None), "matches": matches[k]})
    return pa.array(out, RESULT)


def blocks_of_tests(benchmark: DataFrame, id_col: str, text_col: str, test_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark's ids and texts in blocks of about test_bytes (and one longer item at most); the driver holds one
    partition of the benchmark at a time."""
    ids, texts, size = [], [], 0
    wanted = pick(benchmark, i=id_col, t=text_col)
    for row in wanted.select(F.col("i").cast("string").alias("i"), "t").toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        size += len((row["t"] or "").encode())
        if size >= test_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def covered(matches: Column) -> Column:
    """The words that matches of several blocks cover."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = []
            for own in lists.to_pylist():
                total, end = 0, 0
                for a, b in sorted((m["doc_pos"], m["doc_pos"] + m["length"]) for m in own or ()):
                    total += max(0, b - max(a, end))
                    end = max(end, b)
                out.append(total)
            yield pa.array(out, pa.int64())

    return run(matches)


def searcher(tests):
    """A function from a text column to its struct of results against a broadcast block of tests."""

    @arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield search(texts, tests.value)

    return run


def searched(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, test_bytes: int = TEST_BYTES) -> DataFrame:
    """docs, which has a column _text, with the struct _found of its results.

    The benchmark is read in blocks of a bounded size. Each block is broadcast, searched for in all
    texts and let go before the next one comes; what is found is written between them. So memory doesn't
    grow with the benchmark; the time does, by a pass over the texts for each block."""
    spark = docs.sparkSession
    blocks_ = blocks_of_tests(benchmark, id_col, text_col, test_bytes)
    one = next(blocks_, ([], []))
    out, passes = docs, 0
    while one is not None:
        shared = spark.sparkContext.broadcast(Tests(*one, window))
        one = next(blocks_, None)
        passes += 1
        out = out.withColumn(f"_found{passes}", searcher(shared)("_text"))
        if one is not None or passes > 1:
            if passes > 1:
                new, old = F.col(f"_found{passes}"), F.col(f"_found{passes - 1}")
                both = F.struct(new["n_words"].alias("n_words"), new["n_hit"].alias("n_hit"), F.array_sort(F.array_union(old["items"], new["items"])).alias("items"), F.concat(old["matches"], new["matches"]).alias("matches"))
                out = out.withColumn(f"_found{passes}", both).drop(f"_found{passes - 1}")
            out = materialize(out)
            shared.unpersist()
    found = F.col(f"_found{passes}")
    if passes > 1:
        found = F.struct(found["n_words"].alias("n_words"), covered(found["matches"]).alias("n_hit"), found["items"].alias("items"), found["matches"].alias("matches"))
    return out.select(*docs.columns, found.alias("_found"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items (ids as sorted strings), matches.

    matches has the longest verbatim matches: item_id, doc_pos, item_pos and length, in words.
    An item of fewer words than the window is one window; null or empty texts have no words and
    match nothing. A benchmark item with a null id hits words but is in no list of items. Items
    that share an id count once. Empty tables and repeated rows need no care; other columns of
    docs are not read.
    """
    found = searched(pick(docs, _id=id_col, _text=text_col), benchmark, **options)
    return found.select(F.col("_id").alias("doc_id"), "_found.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs."""
    found = searched(pack(docs, _text=text_col), benchmark, **options)
    return unpack(found.filter("_found.n_hit = 0").select("_row"), docs)
