"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Features, training and scoring are DataFrame expressions alone. A tree's split is found from
histograms: one aggregate for each level sums gradients by node, feature and bin. Scoring is a
CASE expression, so that it is compiled with the scan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import bounded_sample, materialize, pick, text_of

#: Labelled URLs that training reads at most, dealt evenly over the two labels.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 6, 3, 16, 0.4, 1.0
#: Labelled URLs that the statistics of an unknown suffix stand for.
PSEUDO = 4.0

#: The rules where a caller gives none, (verdict, host, path). op4_urls gives its contract's, which differ in both
#: words for net.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def lower(column: Column) -> Column:
    """Lower case in A-Z alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all
    subdomains if the path starts with the rule's. Equally long rules: the first in the list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features of a URL; an empty URL has zeros."""
    url = text_of(url)
    length = F.length(url).cast("double")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    times = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.greatest(length, F.lit(1.0)))
    entropy = F.aggregate(times, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "labels": F.when(host == "", 0.0).otherwise(count(host, r"\.") + 1),
        "digit_ratio": count(url, "[0-9]") / F.greatest(length, F.lit(1.0)),
        "path_digits": count(path, "[0-9]"),
        "hyphens": count(host, "-"),
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "secure": url.startswith("https:").cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Suffix keys whose label statistics are features: the top domain, its first path segment, the file type."""
    top = F.element_at(F.split(host, r"\."), -1)
    return {"top": top, "section": F.concat(top, F.regexp_extract(path, r"(?s)^(/[^/]*/?)", 1)), "kind": F.regexp_extract(path, r"(?s)(\.[A-Za-z0-9]+|/)$", 1)}


class Trees:
    """base: the log odds without features; tables: by suffix kind (key, log odds), a row for each suffix of the
    labelled URLs; trees: nested (feature, threshold, left, right) or leaf values."""

    def __init__(self, base: float, tables: dict[str, DataFrame], trees: list):
        self.base, self.tables, self.trees = base, tables, trees

    def featured(self, pages: DataFrame) -> DataFrame:
        """pages (url, host, path and others) with a column f_<name> for each feature.

        The statistics of suffixes are joined: they have no more rows than the labelled URLs that are
        read, which are bounded, so they may be broadcast."""
        url, host, path = F.col("url"), F.col("host"), F.col("path")
        out = pages.select("*", *[c.alias(f"f_{name}") for name, c in lexical(url, host, path).items()])
        for name, key in suffixes(host, path).items():
            if name in self.tables:
                out = out.join(F.broadcast(self.tables[name]), key == F.col("_key"), "left").withColumn(f"f_{name}", F.coalesce("_odds", F.lit(0.0))).drop("_key", "_odds")
            else:
                out = out.withColumn(f"f_{name}", F.lit(0.0))
        return out

    def score(self) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(F.col(f"f_{name}") <= F.lit(float(threshold)), value(left)).otherwise(value(right))

        return reduce(lambda total, t: total + value(t), self.trees, F.lit(float(self.base)))


def features() -> list[str]:
    none = F.lit("")
    return [*lexical(none, none, none), *suffixes(none, none)]


def train(labelled: DataFrame) -> Trees:
    """Boosted trees from (url, y); every sum is a DataFrame aggregate whose size the bins bound."""
    labelled = labelled.select("url", "y", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    n, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        rate = (ones + 0.5) / (n + 1)
        return Trees(math.log(rate / (1 - rate)), {}, [])
    # both labels weigh alike: how many URLs the rules happen to block says nothing of the others
    weight, base = F.when(F.col("y") == 1, F.lit(0.5 * n / ones)).otherwise(F.lit(0.5 * n / (n - ones))), 0.0
    labelled = labelled.withColumn("w", weight)
    keys = suffixes(F.col("host"), F.col("path"))
    pairs = labelled.select("y", "w", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("key")) for k, c in keys.items()])).alias("s"))
    stats = pairs.groupBy("s.name", "s.key").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("ones"))
    share = (F.col("ones") + PSEUDO / 2) / (F.col("n") + PSEUDO)
    stats = materialize(stats.filter("key is not null").select("name", F.col("key").alias("_key"), F.log(share / (1 - share)).alias("_odds")))
    model = Trees(base, {k: stats.filter(F.col("name") == k).drop("name") for k in keys}, [])
    names = features()
    table = model.featured(labelled).select("y", "w", *[F.col(f"f_{k}").cast("double").alias(k) for k in names])
    edges_ = table.agg(*[F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 1000).alias(k) for k in names]).first()
    edges = {k: sorted(set(edges_[k])) for k in names}
    # bin i holds values above edge i-1, up to edge i
    bins = [reduce(lambda b, e, k=k: b + (F.col(k) > e).cast("int"), edges[k], F.lit(0)) for k in names]
    table = materialize(table.select("y", "w", F.array(*bins).alias("bins"), *[F.col(k).alias(f"f_{k}") for k in names]))
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-model.score()))
        graded = table.select("bins", (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        splits: dict[int, tuple] = {}
        node = F.lit(1)
        values: dict[int, float] = {}
        for depth in range(DEPTH):
            wanted = [k for k in range(1 << depth, 2 << depth) if depth == 0 or k // 2 in splits]
            if not wanted:
                break
            rows = graded.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin")).filter(F.col("node").isin(wanted)).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for k in wanted:
                best = (1e-6, 0, 0, 0.0, 0.0)
                for f, name in enumerate(names):
                    own = sorted((r["bin"], r["g"], r["h"]) for r in rows if r["node"] == k and r["f"] == f)
                    total_g, total_h = sum(r[1] for r in own), sum(r[2] for r in own)
                    g = h = 0.0
                    for b, dg, dh in own[:-1]:
                        g, h = g + dg, h + dh
                        gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, b, g / (h + RIDGE), (total_g - g) / (total_h - h + RIDGE))
                if best[0] > 1e-6:
                    splits[k] = best[1:3]
                    values[2 * k], values[2 * k + 1] = best[3:]
            node = reduce(lambda n_, k: F.when(node == k, 2 * k + (F.col("bins")[splits[k][0]] > splits[k][1]).cast("int")).otherwise(n_), [k for k in wanted if k in splits], node)
        if not splits:
            break

        def build(k: int):
            if k not in splits:
                return RATE * values[k]
            f, b = splits[k]
            return names[f], edges[names[f]][b], build(2 * k), build(2 * k + 1)

        model.trees.append(build(1))
    return model


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, bound: int = SAMPLE) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score.

    The URLs that a rule fits are labelled by it (block 1, allow 0); the trees are trained on about
    `bound` of them at most and decide the URLs that no rule fits: block at a score of 0.5 or more.
    A null URL or one without `://` has an empty host and path. If all labels are alike, their
    smoothed share is the score. A URL counts once in training; repeated rows are judged alike; other
    columns are not read.
    """
    slim = pick(pages, page_id=id_col, url=url_col)
    slim = slim.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = slim.select("*", name.alias("rule"), verdict.alias("given"))
    labelled = ruled.filter("given is not null").select("url", (F.col("given") == "block").cast("int").alias("y"))
    model = train(materialize(bounded_sample(labelled, "y", "url", bound).distinct()))
    p = 1 / (1 + F.exp(-model.score()))
    judged = model.featured(ruled).select("page_id", "host", "path", "rule", "given", p.alias("score"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
