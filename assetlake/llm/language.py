"""Language identification by a convolutional network over bytes.

A text is cut into windows of a fixed length. Filters of several widths run over a window's
bytes, each is pooled by its maximum, and a softmax gives the window's language. Training is in
numpy. For prediction the embedding and the filters are folded into tables by byte or byte pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.llm.common import LOWER, bounded_sample, pick, raw, remainder

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: Labelled rows that training reads at most, dealt evenly over the languages, and windows of each.
SAMPLE, PER_ROW = 4000, 3
#: Places at which a filter is evaluated in every window.
PLACES = WINDOW - max(WIDTHS) + 1
#: Windows predicted at once.
BATCH = 256
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes, lower-cased in A-Z and padded with 0; the text of each; its bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    used = np.minimum(WINDOW, sizes[owner] - index * WINDOW)
    out = np.zeros((len(owner), WINDOW), np.uint8)
    start = offsets[:-1][owner] + index * WINDOW
    full = used == WINDOW
    if full.any():
        out[full] = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[start[full]]
    for k in np.flatnonzero(~full):
        out[k, : used[k]] = data[start[k] : start[k] + used[k]]
    return LOWER[out], owner, used


class Network:
    """embedding: 256 x EMBEDDING; filters by width; a dense layer over the pooled filters."""

    def __init__(self, names: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.names = names
        self.params = {"e": r.normal(0, 0.5, (256, EMBEDDING)), "v": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))), "c": np.zeros(len(names))}
        for w in WIDTHS:
            self.params[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
            self.params[f"b{w}"] = np.zeros(FILTERS)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross-entropy over a batch of windows."""
        p, n = self.params, len(x)
        e = p["e"][x]
        pooled, places = [], []
        for w in WIDTHS:
            columns = np.concatenate([e[:, j : j + PLACES] for j in range(w)], axis=2)
            values = columns @ p[f"w{w}"]
            at = values.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(values, at[:, None], 1)[:, 0] + p[f"b{w}"])
        z = np.concatenate(pooled, axis=1)
        h = np.maximum(z, 0)
        logits = h @ p["v"] + p["c"]
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        out = {"v": h.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = (q @ p["v"].T) * (z > 0)
        for k, w in enumerate(WIDTHS):
            g, at = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
            seen = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # n, filters, width
            vectors = p["e"][seen].reshape(n, FILTERS, w * EMBEDDING)
            out[f"w{w}"] = np.einsum("nf,nfd->df", g, vectors)
            out[f"b{w}"] = g.sum(axis=0)
            down = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, EMBEDDING)
            np.add.at(out["e"], seen.reshape(-1), down)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 9) -> None:
        """Adam over random batches that hold each language alike."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.names))]
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        for t in range(1, steps + 1):
            pick = np.array([r.choice(by[k]) for k in r.integers(0, len(by), batch)])
            for k, g in self.step(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                pace = rate * (1 - 0.9 * t / steps)
                self.params[k] -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def fold(self) -> None:
        """Tables that give a filter's sum by pairs of bytes, or by single bytes."""
        p, self.pairs, self.single = self.params, {}, {}
        for w in WIDTHS:
            t = [(p["e"] @ p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING]).astype(np.float32) for j in range(w)]
            self.pairs[w] = [(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            self.single[w] = t[-1] if w % 2 else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language for each window."""
        if not hasattr(self, "pairs"):
            self.fold()
        p, out = self.params, np.empty((len(x), len(self.names)), np.float32)
        for a in range(0, len(x), BATCH):
            part = x[a : a + BATCH]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w in WIDTHS:
                values = self.pairs[w][0].take(pair[:, :PLACES], axis=0)
                for k, table in enumerate(self.pairs[w][1:], 1):
                    values += table.take(pair[:, 2 * k : 2 * k + PLACES], axis=0)
                if self.single[w] is not None:
                    values += self.single[w].take(part[:, w - 1 : w - 1 + PLACES], axis=0)
                while (n := values.shape[1]) > 1:  # halves, so that the innermost loops are long
                    values = np.maximum(values[:, : (n + 1) // 2], values[:, n // 2 :])
                pooled.append(values[:, 0] + p[f"b{w}"])
            logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ p["v"] + p["c"]
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[a : a + BATCH] = q / q.sum(axis=1, keepdims=True)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE) -> Network | None:
    """Learn from rows with a text and a language whose crc32 of the id, modulo 3, is not 1: about
    `bound` of them at most, PER_ROW windows of each, from places all over the text. Of several texts of an
    id in a language the last in code point order counts."""
    slim = pick(docs, _id=id_col, _text=text_col, _lang=lang_col).withColumn("_lang", F.col("_lang").cast("string"))
    usable = slim.filter(F.col("_lang").isNotNull() & (F.length("_text") > 0) & (remainder(F.col("_id"), 3) != 1))
    drawn = bounded_sample(usable, "_lang", "_id", bound).groupBy("_lang", "_id").agg(F.max("_text").alias("_text"))
    cuts = [F.substring("_text", F.lit(1) + F.pmod(F.xxhash64("_id", F.lit(k)), F.greatest(F.lit(1), F.length("_text") - WINDOW)).cast("int"), F.lit(WINDOW)) for k in range(PER_ROW)]
    rows = sorted((r["_lang"], i, c) for r in drawn.select("_lang", F.col("_id").cast("string").alias("i"), F.array(*cuts).alias("c")).collect() for i, c in [(r["i"] or "", r["c"])])
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    encoded = [(names.index(lang), c.encode()[:WINDOW]) for lang, _, cuts_ in rows for c in cuts_]
    x = LOWER[np.array([np.frombuffer(b.ljust(WINDOW, b"\0"), np.uint8) for _, b in encoded])]
    network = Network(names)
    if len(names) > 1:
        network.train(x, np.array([y for y, _ in encoded]))
    return network


def identify(texts: pa.Array, network: Network | None) -> tuple[list[str], list[float]]:
    """Language and score of each whole text: the windows' probabilities, weighed by their bytes."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if network is None or not len(texts):
        return names, scores
    data, offsets = raw(texts)
    k = len(network.names)
    totals, n = np.zeros((len(texts), k)), len(texts)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (8 << 20), "right")) - 1))
        x, owner, used = windows(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        if len(x):
            np.add.at(totals, owner + at, network.predict(x) * used[:, None])
        at = to
    best = totals.argmax(axis=1)
    share = totals[np.arange(n), best] / np.maximum(1, np.diff(offsets))
    for i, text in enumerate(texts.to_pylist()):
        if text and any(c.isalpha() for c in text):
            names[i], scores[i] = network.names[best[i]], float(min(1.0, share[i]))
    return names, scores


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, and so is every text if there is
    nothing to learn from. Repeated rows are predicted alike; ties go to the first language in
    code point order; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, bound))

    @arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = identify(texts, shared.value)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = pick(docs, doc_id=id_col, text=text_col).select("doc_id", run("text").alias("r"))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "r.lang_pred", "r.score")
