"""Toxicity through a noisy channel.

A disguised word is a lattice: each character may stand for several letters (leetspeak), for
nothing (a separator, a mark at either end) or for one or two of a longer run (repetition); between
letters that stand apart a space may be nothing or a word's end. Viterbi decoding under a character
trigram model of all texts restores the likeliest words. The restored text is scored by the
evidence its words and word beginnings carry for the label.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assetlake.llm.common import bounded_sample, pack, pick, remainder, summed_cells, unpack

#: Labelled rows that training reads at most, half of each label.
SAMPLE = 6000
#: Restored units that a worker remembers, and the longest that it does.
MEMORY, LONGEST = 120_000, 64
#: Word beginnings that carry evidence, besides the whole word: their lengths.
BEGINNINGS = range(4, 9)
#: Pseudo-documents of the evidence ratio, and toxic documents that a feature needs.
PRIOR, LEAST = 2.0, 2
#: Characters that stand apart one after the other, at least, to be read as one run.
APART = 3

#: Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "#": "h", "€": "e", "£": "l", "¡": "i",
}
#: Log costs of the channel: a substituted letter, a character kept as it is, a deleted one, a shortened run, a
#: letter that was doubled, and a space between letters that is nothing or a word's end.
SWAP, KEEP, DROP, SHORTEN, DOUBLED, JOIN, BREAK = (math.log(p) for p in (0.3, 0.05, 0.1, 0.45, 0.1, 0.7, 0.3))

MARKS = "".join(c for c in LEET if not c.isalnum())
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in MARKS) + "…“”‘’«»¿"
PARTS = re.compile(r"[^\W_]+")
RUN, TWIN = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
RUNS = re.compile(r"(.)\1*", re.S)
NUMBER = re.compile(r"[$€£#+(]?[\d.,:;%/+()!-]+[€£$]?")
SHORT = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2}(?!\S)")

#: Cells of the counts: three characters, the first two and the last two of them, the middle one and the last one.
SIZES = {"three": 1 << 18, "before": 1 << 15, "two": 1 << 15, "middle": 1 << 12, "one": 1 << 12}
CELLS = sum(SIZES.values())
#: Characters counted at once.
BLOCK = 1 << 18
START, END = ord("^"), ord("$")
_memory: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """For each character: 0 if it may stand beside a word (space, punctuation), 1 if it is a letter, 2 otherwise."""
    if "kinds" not in _memory:
        beside = set(PUNCTUATION + "!")
        kinds = (1 if c.isalpha() else 0 if c in beside or c.isspace() else 2 for c in map(chr, range(0x110000)))
        _memory["kinds"] = np.fromiter(kinds, np.uint8, 0x110000)
    return _memory["kinds"]


def _cells(a, b, c) -> dict:
    """The cells of character triples, given as arrays or as numbers."""
    spread = lambda x, size: ((x * 0x9E3779B1) & 0xFFFFFFFF) >> (33 - size.bit_length())
    return {
        "three": spread((a * 8191 + b) * 8191 + c, SIZES["three"]), "before": spread(a * 8191 + b, SIZES["before"]), "two": spread(b * 8191 + c, SIZES["two"]),
        "middle": spread(b, SIZES["middle"]), "one": spread(c, SIZES["one"]),
    }


def count_letters(texts: list[str | None]) -> np.ndarray:
    """Counts of the characters of all plain words, each with the two before it, one table after the other.

    A plain word has letters alone and stands between spaces or punctuation; one of a single letter
    counts if its neighbours are longer."""
    total, at = np.zeros(CELLS, np.int64), 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and size < BLOCK:
            part.append((texts[at] or "").lower())
            size += len(part[-1])
            at += 1
        codes = np.frombuffer(("\n\n" + "\n\n".join(part) + "\n\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kind = _kinds()[codes]
        letter = kind == 1
        first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        after = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        wide = np.r_[0, after - first, 0] > 1
        good = (kind[first - 1] == 0) & (kind[after] == 0) & (wide[1:-1] | (wide[:-2] & wide[2:]))
        first, after = first[good], after[good]
        lengths = after - first + 1  # the end counts too
        start = np.repeat(first, lengths)
        place = start + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        c = np.where(place == np.repeat(after, lengths), END, codes[place])
        b = np.where(place - 1 >= start, codes[place - 1], START)
        a = np.where(place - 2 >= start, codes[place - 2], START)
        offset = 0
        for name, cell in _cells(a, b, c).items():
            total[offset : offset + SIZES[name]] += np.bincount(cell, minlength=SIZES[name])
            offset += SIZES[name]
    return total


class Letters:
    """A character trigram model, interpolated with bigrams and single letters, from hashed counts."""

    def __init__(self, counts: np.ndarray):
        self.tables, offset = {}, 0
        for name, size in SIZES.items():
            self.tables[name] = counts[offset : offset + size].astype(np.float64)
            offset += size
        self.total, self.memory = float(self.tables["one"].sum()), {}

    @classmethod
    def of(cls, texts: list[str | None]) -> Letters:
        return cls(count_letters(texts))

    def log(self, before: str, char: str) -> float:
        """The log probability of a character after two others."""
        key = before + char
        if (found := self.memory.get(key)) is None:
            n = {name: self.tables[name][cell] for name, cell in _cells(*map(ord, key)).items()}
            p = (n["one"] + 0.01) / (self.total + 10)
            p = (n["two"] + 5 * p) / (n["middle"] + 5)
            p = (n["three"] + 5 * p) / (n["before"] + 5)
            if len(self.memory) > MEMORY:
                self.memory.clear()
            found = self.memory[key] = math.log(p)
        return found


def lattice(unit: str) -> list[list[tuple[str, float]]]:
    """For each run of a character: what it may stand for, with the log cost; a space may be a word's end."""
    out = []
    for match in RUNS.finditer(unit):
        c, n = match[1], len(match[0])
        if c == " ":
            out.append([("", JOIN), (" ", BREAK)])
        elif c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, DOUBLED)] if n == 2 else [(c, SHORTEN), (c * 2, SHORTEN)])
        else:
            options = [(x * k, SWAP * min(n, 2)) for x in LEET.get(c, "") for k in range(1, min(n, 2) + 1)]
            options.append((match[0], KEEP * min(n, 4)) if c.isalnum() else ("", DROP))
            out.append(options)
    return out


def step(state: str, text: str, letters: Letters) -> tuple[float, str]:
    """The log probability of a text after the state's two characters, and the state then."""
    total = 0.0
    for c in text:
        if c == " ":
            total, state = total + letters.log(state, "$"), "^^"
        else:
            total, state = total + letters.log(state, c), state[1] + c
    return total, state


def decode(unit: str, letters: Letters) -> str:
    """The likeliest words of the unit's lattice, by Viterbi over states of two characters."""
    best, back = {"^^": 0.0}, []
    for options in lattice(unit):
        fresh: dict[str, tuple[float, str, str]] = {}
        for state, score in best.items():
            for text, cost in options:
                gain, now = step(state, text, letters)
                s = score + cost + gain
                if now not in fresh or s > fresh[now][0]:
                    fresh[now] = (s, state, text)
        back.append(fresh)
        best = {state: x[0] for state, x in fresh.items()}
    state = max(best, key=lambda x: (best[x] + letters.log(x, "$"), x))
    words = []
    for fresh in back[::-1]:
        _, state, text = fresh[state]
        words.append(text)
    return " ".join("".join(words[::-1]).split())


def alone(token: str) -> bool:
    """Whether a token is one character that may be a letter, with one mark beside it at most."""
    if len(token) == 1:
        return token.isalnum() or token in LEET
    return len(token) == 2 and len(core := token.strip(PUNCTUATION)) == 1 and core.isalnum()


def units(text: str | None) -> Iterator[str]:
    """The tokens of a text in lower case; characters that stand apart one after the other are one."""
    lowered = (text or "").lower()
    if not SHORT.search(lowered):
        yield from lowered.split()
        return
    run: list[str] = []
    for t in [*lowered.split(), ""]:
        if t and alone(t):
            run.append(t)
            continue
        if len(run) >= APART:
            yield " ".join(run)
        else:
            yield from run
        run = []
        if t:
            yield t


def restore(unit: str, letters: Letters, known: set[str] | frozenset[str] = frozenset()) -> str:
    """The words of a unit without outer punctuation, decoded where it shows a disguise: anything but letters, or
    letters that are repeated in no known word."""
    core = unit.strip(PUNCTUATION)
    if core.isalpha() and (core in known or not TWIN.search(core)):
        return core
    inner = core.strip(MARKS)
    if inner in known or NUMBER.fullmatch(core):
        return inner or core
    if any(c.isalpha() for c in core) or sum(c in LEET for c in core) >= APART:
        return decode(core, letters)
    return core


def deobfuscate(text: str | None, letters: Letters, known: set[str] | frozenset[str] = frozenset()) -> str:
    """The whole text restored, in lower case."""
    return " ".join(restore(u, letters, known) for u in units(text))


def features(word: str) -> list[str]:
    return [f"={word}", *[word[:k] for k in BEGINNINGS if len(word) > k]] if word else []


def read(unit: str, letters: Letters, known: set[str]) -> tuple[str, ...]:
    """The words that a unit may hold: the restored ones, and its parts as they are."""
    found = restore(unit, letters, known)
    words = found.split()
    if found != unit and " " not in unit and len(parts := PARTS.findall(unit)) > 1:
        words += parts
    return tuple(words)


class Model:
    """letters; known: plain words; evidence: log odds of each feature; weights of the document's summary."""

    def __init__(self, letters: Letters, known: set[str], evidence: dict[str, float], weights: np.ndarray | None, base: float):
        self.letters, self.known, self.evidence, self.weights, self.base, self.memory = letters, known, evidence, weights, base, {}
        self.heads = {f.removeprefix("=")[:4] for f in evidence}

    def weigh(self, unit: str) -> float:
        """The largest evidence that the unit carries."""
        get = self.evidence.get
        return max((get(f, 0.0) for w in read(unit, self.letters, self.known) if w[:4] in self.heads for f in features(w)), default=0.0)

    def score(self, text: str | None) -> float:
        own, memory, found = set(units(text)), self.memory, []
        for u in own:
            e = memory.get(u)
            if e is None:
                e = self.weigh(u)
                if len(u) <= LONGEST:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[u] = e
            if e:
                found.append(e)
        if self.weights is None:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(summary(found, len(own)) @ self.weights, -30, 30))))


def summary(found: list[float], n: int) -> np.ndarray:
    """What the logistic regression sees of a document: its strongest evidence and how much there is."""
    top = heapq.nlargest(3, found)
    return np.array([1.0, top[0] if top else 0.0, sum(top) / 3, math.log1p(sum(e > 2 for e in found)), math.log1p(n) / 5])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step_ = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += step_ * min(1.0, 5 / max(1e-9, np.abs(step_).max()))
        if np.abs(step_).max() < 1e-8:
            break
    return beta


def train(rows: list[tuple[str | None, int]], share: float, letters: Letters | None = None) -> Model:
    """rows: (text, label) of the sample; share: the share of label 1 among all labelled rows; letters: the
    model of spelling, else that of the rows."""
    letters = letters or Letters.of([text for text, _ in rows])
    plain: Counter[str] = Counter()
    for text, _ in rows:
        plain.update({w for u in set(units(text)) if " " not in u and (w := u.strip(PUNCTUATION + MARKS)).isalpha() and not RUN.search(w)})
    known = {w for w, n in plain.items() if n > 1}
    del plain
    memory: dict[str, tuple[str, ...]] = {}

    def words_of(text: str | None) -> list[tuple[str, ...]]:
        out = []
        for u in set(units(text)):
            if (words := memory.get(u)) is None:
                words = memory[u] = read(u, letters, known)
            out.append(words)
        return out

    sets = [words_of(text) for text, _ in rows]
    memory.clear()
    labels = np.array([y for _, y in rows])
    n = [int((labels == k).sum()) for k in (0, 1)]
    if not all(n):
        return Model(letters, known, {}, None, (n[1] + 0.5) / (sum(n) + 2))
    every = lambda own: {f for words in own for w in words for f in features(w)}
    toxic = {f: a for f, a in Counter(f for own, y in zip(sets, labels) if y for f in every(own)).items() if a >= LEAST}
    clean = Counter(f for own, y in zip(sets, labels) if not y for f in every(own) if f in toxic)
    total = sum(n)

    def odds(a: int, b: int, n1: int, n0: int) -> float:
        return max(0.0, math.log((a + PRIOR * n1 / total) / n1) - math.log((b + PRIOR * n0 / total) / n0)) if a >= LEAST else 0.0

    # each document is weighed by what the others say
    others = [{f: e for f, a in toxic.items() if (e := odds(a - y, max(0, clean[f] - (1 - y)), n[1] - y, n[0] - (1 - y)))} for y in (0, 1)]
    weighed: list[dict[tuple[str, ...], float]] = [{}, {}]
    rows_x = []
    for own, y in zip(sets, labels):
        remembered, get, found = weighed[y], others[y].get, []
        for words in own:
            if (e := remembered.get(words)) is None:
                e = remembered[words] = max((get(f, 0.0) for w in words for f in features(w)), default=0.0)
            if e:
                found.append(e)
        rows_x.append(summary(found, len(own)))
    w = np.where(labels == 1, share / n[1], (1 - share) / n[0]) * total
    beta = _logistic(np.array(rows_x), labels, w)
    evidence = {f: e for f, a in toxic.items() if (e := odds(a, clean[f], *n[::-1])) > 0}
    return Model(letters, known, evidence, beta, share)


def _counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            total += count_letters(batch.column(0).slice(at, 500).to_pylist())
    return total


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """Learn from labelled rows whose crc32 of the id, modulo 5, is not 0: at most about `bound` of them.

    The sample is drawn from the labels, so that the documents needn't be shuffled. Of several
    labels of one id the largest counts, of several texts the last in code point order; null labels don't
    count. The model of spelling has no labels and reads all texts.
    """
    usable = pick(labels, _id=id_col, toxic="toxic").filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & (remainder(F.col("_id"), 5) != 0))
    usable = usable.groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = bounded_sample(usable, "toxic", "_id", bound)
    slim = pick(docs, _id=id_col, _text=text_col)
    rows = slim.join(F.broadcast(drawn), "_id").groupBy("_id", "toxic").agg(F.max("_text").alias("_text")).collect()
    rows.sort(key=lambda r: (str(r["_id"]), r["_text"] or ""))
    letters = Letters(summed_cells(slim.select("_text"), _counted, CELLS))
    return train([(r["_text"], r["toxic"]) for r in rows], counts.get(1, 0) / max(1, sum(counts.values())), letters)


def scorer(docs: DataFrame, model: Model):
    """A function from a text column to its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            yield pa.array([own.score(t) for t in texts.to_pylist()], pa.float64())

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without evidence. Where the labels lack one of
    the two values every score is their smoothed share. Repeated rows score alike; other columns
    are not read; an empty table gives an empty result.
    """
    score = scorer(docs, fit(docs, labels, id_col, text_col, bound))
    scored = pick(docs, doc_id=id_col, text=text_col).select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that aren't predicted to be toxic."""
    score = scorer(docs, fit(docs, labels, id_col, text_col, bound))
    scored = pack(docs, _text=text_col).select("_row", score("_text").alias("_score"))
    return unpack(scored.filter("_score < 0.5").select("_row"), docs)
