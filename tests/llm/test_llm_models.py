"""The learned operators and the mix, on small fixtures and by held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm import decontaminate, language, likelihood, mixing, quality, toxicity, urls

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(i, by):
    return zlib.crc32(("" if i is None else str(i)).encode()) % by


# ---------------------------------------------------------------- decontamination
def words_of(text):
    return [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()) if w]


def brute_hits(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(10, len(own))
        for p in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[p : p + size]:
                    hit |= set(range(i, i + size))
                    found.add(name)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("test_bytes", [1 << 20, 40])
def test_decontamination(spark, test_bytes):
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(12)] + ["Über", "naïve", "B2B"]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [("10", some(25)), ("9", "short one"), ("x", ""), ("n", None), ("10", some(12)), (None, some(11)), ("rep", "go " * 14)]
    texts = ["", None, " . ", "a short, ONE!", some(400), "go " * 40, items[0][1].upper(), "x " + items[0][1][20:] + " y", items[5][1]]
    texts += ["; ".join((some(r.randrange(30)), " ".join((r.choice(items)[1] or "").split()[r.randrange(4) :]), some(9))) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), test_bytes=test_bytes)
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["items"])) for x in found.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for x in found.filter("n_hit > 0").collect():
        own = words_of(texts[x["doc_id"]])
        for m in x["matches"]:
            match = own[m["doc_pos"] : m["doc_pos"] + m["length"]]
            assert any(words_of(t)[m["item_pos"] : m["item_pos"] + m["length"]] == match for n, t in items if n == m["item_id"])


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(docs, none).collect()] == [0, 0]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == 2


def test_suffix_array():
    r = np.random.default_rng(0)
    words = r.integers(1, 4, 200)
    got = decontaminate.suffix_array(words, 10)
    cut = [tuple(words[i : i + 10]) for i in got]
    assert cut == sorted(cut)


# ---------------------------------------------------------------- language
def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", None, "s", 1), (3, "12 34!", "en", "s", 1), (7, "words here", "en", "s", 1), (None, "x" * 200_000, None, None, None)], DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 7: "en", None: "en"}
    assert language.languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs.filter("lang is null")).collect()} == {"und"}


def test_folded_tables_equal_the_network():
    network = language.Network(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    p, e = network.params, network.params["e"][x]
    pooled = []
    for w in language.WIDTHS:
        values = np.concatenate([e[:, j : j + language.PLACES] for j in range(w)], axis=2) @ p[f"w{w}"] + p[f"b{w}"]
        pooled.append(np.maximum(values, 0).max(axis=1))
    logits = np.concatenate(pooled, axis=1) @ p["v"] + p["c"]
    q = np.exp(logits)
    assert np.allclose(network.predict(x), q / q.sum(axis=1, keepdims=True), atol=1e-4)


# ---------------------------------------------------------------- toxicity
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert not [r for r in held if r["predicted"] and not r["toxic"]]


def test_disguises_are_restored():
    plain = [(f"the {w} of and {w} then there is that on in for to with by from be this", y) for w, y in [("idiot", 1), ("moron", 1), ("loser", 1), ("house", 0), ("garden", 0), ("river", 0)] for _ in range(20)]
    model = toxicity.train(plain, 0.5)
    text = "the 1d10t and m0r0n!! a l.o.s.e.r i d i o t idiooooot @nd 2021"
    assert toxicity.deobfuscate(text, model.letters).split()[:6] == ["the", "idiot", "and", "moron", "a", "loser"]
    assert "idiot idiot" in toxicity.deobfuscate(text, model.letters)
    for word in ("1d10t", "idi0t", "i d i o t", "IDIOT!!", "m0r0n", "l-o-s-e-r", "mooooron"):
        assert model.score(f"the {word} of and then there is") > 0.5 > model.score("the house of and then there is")
    assert 0 <= model.score(None) == model.score("") < 0.5


def every_path(unit):
    """All readings of a unit's lattice with their channel costs."""
    paths = [("", 0.0)]
    for options in toxicity.lattice(unit):
        paths = [(word + text, cost + more) for word, cost in paths for text, more in options]
    return paths


def test_decoding_equals_brute_force():
    r = random.Random(21)
    letters = toxicity.Letters.of(["the idiot in the house lies still all loose tooth class is as at it a list toil " * 3])

    def value(word, cost):
        gain, state = toxicity.step("^^", word, letters)
        return cost + gain + letters.log(state, "$")

    for _ in range(150):
        unit = "".join(r.choice("aio5st1!l0@$ .7") for _ in range(r.randrange(1, 9))).strip() or "a"
        top = max(value(*p) for p in every_path(unit))
        got = toxicity.decode(unit, letters)
        assert got in {" ".join(w.split()) for w, c in every_path(unit) if value(w, c) >= top - 1e-9}


@pytest.mark.parametrize("word", ["1d10t", "!diot", "idi0t!", "i  d  i  o  t", "i\td\ti\to\tt", "1 d ! o t", "i. d. i. o. t.", "i-d-i-o-t", "iddiot", "idiooooot", "!D!0T", "*idiot*", "a i d i o t"])
def test_disguises_of_every_kind(word):
    plain = [(f"there is a {w} of and a {w} then that on in for to with by from be this", y) for w, y in [("idiot", 1), ("moron", 1), ("loser", 1), ("house", 0), ("garden", 0), ("river", 0)] for _ in range(20)]
    model = toxicity.train(plain, 0.5)
    assert "idiot" in toxicity.deobfuscate(f"and {word} then", model.letters, model.known).split()
    assert model.score(f"there is {word} of and then") > 0.5 > model.score("there is house of and then")


def test_toxicity_of_a_very_long_run():
    model = toxicity.train([("an idiot here", 1), ("a house here", 0)] * 30, 0.5)
    assert model.score("h e l l o " * 40_000 + "i d i o t") >= 0 and model.score("x " * 50_000 + "and idiot") > model.score("x " * 50_000 + "and house")


def test_toxicity_of_odd_rows(spark):
    schema = "doc_id long, TEXT string, text string, `a.b` string"
    docs = spark.createDataFrame([(i % 30, "x", ("an idiot here" if i % 2 else "a house here"), "y") for i in range(90)] + [(None, None, None, None)], schema)
    labels = spark.createDataFrame([(i, 0, i % 2, "x") for i in range(30)], "doc_id long, quality int, toxic int, TOXIC string")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 91 and all(x["predicted"] == x["doc_id"] % 2 for x in found if x["doc_id"] is not None)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 46


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, None, "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.25}
    odd = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, odd).count() == 2 and toxicity.toxicity(docs.limit(0), odd).count() == 0


# ---------------------------------------------------------------- likelihood
def brute_word(pieces, word):
    s = "▁" + word

    def total(i):
        if i == len(s):
            return 1.0
        out = sum(math.exp(pieces.log[s[i:j]]) * total(j) for j in range(i + 1, len(s) + 1) if s[i:j] in pieces.log)
        return out if s[i] in pieces.log else out + math.exp(pieces.byte * len(s[i].encode())) * total(i + 1)

    return total(0)


def test_lattice_sums_over_all_segmentations():
    pieces = likelihood.Pieces({"▁": -2.0, "▁a": -3.0, "a": -2.0, "b": -2.5, "ab": -1.0, "bab": -4.0, "ba": -3.0})
    for word in ("a", "ab", "abab", "babab", "aé", "ééb"):
        assert pieces.word(word) == pytest.approx(math.log(brute_word(pieces, word)))
    assert pieces.text("A b") == pytest.approx((pieces.word("a") + pieces.word("b") + pieces.end) / math.log(10))


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 200])
def test_likelihoods(spark, chunk_bytes):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab A bc ééé x1 zz".split()) for _ in range(r.randrange(1, 40))) for _ in range(40)] + ["", None, "new words\tonly", "a" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a zz")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in likelihood.likelihoods(docs, chunk_bytes=chunk_bytes).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in [*enumerate(texts), (None, "a zz")]}
    c = Counter(w for i, ws in tokens.items() if crc(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    pieces = likelihood.Pieces.load()
    assert set(got) == set(tokens)
    for i, ws in tokens.items():
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (crc(i, 10) == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert x["score"] == pytest.approx(pieces.text("a zz" if i is None else texts[i]))
    assert likelihood.likelihoods(docs.limit(0)).count() == 0


def test_fitted_pieces_weigh_words(spark):
    plain = likelihood.Pieces({"▁": -2.0, "▁a": -3.0, "a": -2.0, "b": -2.5, "ab": -1.0, "bab": -4.0, "ba": -3.0})
    words = ["ab", "abab", "aab", "b", "abé"] * 20
    fitted = plain.fitted(words)
    assert sum(map(fitted.word, words)) > sum(map(plain.word, words)) and plain.fitted([]) is plain
    every = ["".join(w) for n in range(1, 9) for w in itertools.product("ab", repeat=n)]
    assert sum(math.exp(fitted.word(w)) for w in every) < 1
    weigh = lambda logs: sum(map(math.exp, logs))
    assert weigh(fitted.first.values()) == pytest.approx(1) and weigh([*fitted.log.values(), fitted.stop]) + 256 * math.exp(fitted.byte) == pytest.approx(1)
    x = np.r_[np.linspace(1, 50, 99), 1e3, 1e7]
    assert likelihood._log_gamma(x) == pytest.approx(np.array([math.lgamma(y) for y in x]), abs=1e-9)


def test_op8_learns_from_its_training_rows(spark):
    from assetlake.llm import queries

    rows = queries.op8_likelihood(spark, SF).collect()
    assert len(rows) == 1000 and all(math.isfinite(x["score"]) and x["score"] < 0 for x in rows)
    held = [x for x in rows if x["held_out"]]
    assert sum(x["score"] for x in held) > 1.1 * sum(x["base_score"] for x in held)


def test_learned_likelihoods(spark):
    texts = ["a a b", "a c", "b b b b", "", None, "new words\tonly", "x" * 5000, "a b c d ééé"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = ({x["doc_id"]: x["score"] for x in likelihood.likelihoods(docs, chunk_bytes=n, learn=True).collect()} for n in (1 << 24, 20))
    assert one == pytest.approx(many) and len(one) == len(texts) and all(-math.inf < x < 0 for x in one.values())
    assert one[8] == one[16] > one[13]  # words that are known
    untaught = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    assert all(-math.inf < x["score"] < 0 and x["train_tokens"] == 0 for x in likelihood.likelihoods(untaught, learn=True).collect())
    assert likelihood.likelihoods(docs.limit(0), learn=True).count() == 0


# ---------------------------------------------------------------- quality
def test_quality_keeps_the_good(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.resample(docs, labels)
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["selected"] == bool(r["quality"]) for r in held) / len(held) > 0.9
    few = quality.resample(docs, labels, share=0.1).filter("selected")
    keys = sorted((r["gumbel_key"] for r in rows), reverse=True)
    assert few.count() == 100 and min(r["gumbel_key"] for r in few.collect()) == keys[99]


def test_threshold(spark):
    r = random.Random(4)
    values = [r.gauss(0, 1) for _ in range(3000)] + [0.5] * 500 + [1e6]
    keys = spark.createDataFrame([(x,) for x in values], "key double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 1000, 1300, 3500):
        assert quality.threshold(keys, k, fine=8, few=5) == order[k - 1]
    assert quality.threshold(keys, 3501) == -math.inf and quality.threshold(keys, 0) == math.inf


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 1), (2, "", "en", "s", 1), (None, "a b", "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["log_weight"] for r in quality.resample(docs, none).collect()] == [0.0] * 4
    assert quality.resample(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- URLs
def test_urls(spark):
    cases_ = [
        ("http://Shop.COM/en/1?x=/de/", "shop.com", "/en/1", "com/en/", "block"), ("https://a.example.com/en/77#f", "a.example.com", "/en/77", "example.com/en/7", "allow"),
        ("x://net/de/", "net", "/de/", "net/de/", "block"), ("x://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "allow"), ("http://b.org/es/", "b.org", "/es/", "org/es/", "block"),
        ("http://telecom/en/", "telecom", "/en/", None, None), ("http://a.com?q=/en/", "a.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None), ("http://xexample.com/en/7", "xexample.com", "/en/7", "com/en/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases_)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases_):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ({verdict} if verdict else {"allow", "block"}) and 0 <= got[i]["score"] <= 1
    assert urls.judge(pages.limit(0)).count() == 0
    assert urls.judge(pages.filter("page_id >= 5 and page_id < 11")).count() == 6


def test_op4_gives_the_words_of_its_contract(spark, tmp_path):
    from assetlake.llm import queries

    wanted = {
        "http://a.com/en/1": ("com/en/", "block"), "http://b.example.com/en/70": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"),
        "http://c.net/de/1": ("net/de/", "allow"), "http://example.net/de/80": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://d.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op4_urls(spark, str(tmp_path)).collect()
    assert [(x["rule"], x["verdict"]) for x in sorted(got, key=lambda x: x["page_id"])] == list(wanted.values())


def test_statistics_of_rare_suffixes(spark):
    rows = [(f"http://h{i}.t{i % 900}/s/{i}", int(i % 900 % 2)) for i in range(1800)]
    labelled = spark.createDataFrame(rows, "url string, y int")
    model = urls.train(labelled)
    assert model.tables["top"].count() == 900


def test_urls_that_a_held_out_rule_decides(spark):
    """Rules for two thirds of some sites label them; the trees must tell the rest, whose rule they don't know."""
    r = random.Random(8)
    rows, rest = [], {}
    for i in range(1500):
        bad = r.random() < 0.5
        page = f"/{'x' * r.randrange(1, 4)}{r.randrange(10**8)}?{'&'.join(f'p{k}={r.randrange(10**6)}' for k in range(6))}" if bad else f"/{r.choice(['about', 'news', 'help'])}/story"
        site = ("ads" if bad else "good") + str(i % 3)
        rows.append((i, f"http://w{r.randrange(50)}.{site}{page}"))
        rest[i] = ("block" if bad else "allow") if i % 3 == 2 else None
    rules = tuple((v, f"{n}{k}", "/") for v, n in (("block", "ads"), ("allow", "good")) for k in (0, 1))
    got = {x["page_id"]: x for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all((got[i]["rule"] is None) == (v is not None) for i, v in rest.items())
    told = [got[i]["verdict"] == v for i, v in rest.items() if v]
    assert sum(told) / len(told) > 0.9


def test_urls_of_odd_rows(spark):
    schema = "page_id long, URL string, url string, `a.b` string"
    docs = spark.createDataFrame([(1, "x", "http://a.com/en/1", "y")] * 3 + [(None, None, None, None), (2, "x", "http://a.com/" + "p" * 200_000, "z")], schema)
    got = urls.judge(docs).collect()
    assert len(got) == 5 and {x["verdict"] for x in got if x["page_id"] == 1} == {"block"}


def test_trees_learn_their_labels(spark):
    r = random.Random(5)
    rows = [(f"http://{'x' * r.randrange(3, 9)}.{t}/{s}/{r.randrange(10**6)}?a=1", int(t == "biz" or s == "buy")) for t in ("biz", "com", "org") for s in ("buy", "read") for _ in range(60)]
    labelled = spark.createDataFrame(rows, "url string, y int")
    model = urls.train(labelled)
    from pyspark.sql import functions as F

    hosted = labelled.select("y", "url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    scored = model.featured(hosted).select("y", model.score().alias("s")).collect()
    assert all((r["s"] > 0) == bool(r["y"]) for r in scored)


# ---------------------------------------------------------------- mixing
def brute_targets(sizes, weights=(3.0, 1.0, 2.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * level > 2 * sizes[s]]
        if not over:
            return {**capped, **{s: w[s] * level for s in open_}}
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


def test_mix(spark):
    r = random.Random(6)
    docs = [(i, "w " * int(r.expovariate(1 / 60)), "en", r.choice(["a", "a", "a", "B", "é", "zz", None, "\U0001f600", "\uffff"]), 1) for i in range(1500)]
    docs += [(2000, None, "en", "empty", 1), (2001, "big " * 9000, "en", "one", 1), (None, "x y", None, "zz", None), (1, docs[1][1], "en", docs[1][3], 1)]
    df = spark.createDataFrame(docs, DOCS)
    found = mixing.mixture(df).collect()
    assert len(found) == len(docs)
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += size(d[1])
    targets = brute_targets(sizes)
    by_size = {(d[0], size(d[1])): d[3] for d in docs}
    taken = Counter()
    for x in found:
        source = by_size[x["doc_id"], x["size"]]
        assert x["target"] == pytest.approx(targets[source]) and x["source_size"] == sizes[source]
        assert x["taken"] == x["copies"] * x["size"] <= 2 * x["size"]
        taken[source] += x["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 5) or s == "one" and abs(taken[s] - t) <= 4500
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, TEXT string, text string, `so.urce` string, source string"
    rows = [(7, "x", "a b c", "y", "s")] * 40 + [(8, "x", None, "y", "t"), (None, None, "d e", None, None)]
    df = spark.createDataFrame(rows, schema)
    found = mixing.mixture(df).collect()
    assert len(found) == 42 and len({(x["doc_id"], x["copies"]) for x in found}) == 3
    assert mixing.unpack(mixing.mix(df).select("_row"), df).columns == df.columns


def test_tilts_that_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.mixture(spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string"))


def test_mix_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, "r", 0.5)], "doc_id long, text string, source string, size long, row string, rate double")
    x = mixing.mix(df)
    assert [r["size"] for r in x.collect()] == [2]
    assert mixing.unpack(x.select("_row"), df).collect() == df.collect()


# ---------------------------------------------------------------- queries and pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    extra = spark.createDataFrame([(5000, "idiot moron scum trash pathetic loser " * 3, "en", "src0", 1), (5001, f"before {item} after", "en", "src0", 1), (5002, None, None, None, None), (5003, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held, before = docs, {r["doc_id"] for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
        rows = held.collect()
        held = spark.createDataFrame(rows, held.schema)
        seen[name] = {r["doc_id"] for r in rows}
        assert seen[name] <= before and len(rows) == len(seen[name])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert held.columns == docs.columns
        before = seen[name]
    assert 5000 not in seen["toxicity"] and 5001 not in seen["benchmark decontamination"]
    texts = [r["text"] or "" for r in held.collect()]
    assert len(texts) == len(set(texts))
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == before


def test_last_stage_keeps_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 9, "z")], DOCS + ", size long, copies string")
    out = corpus_pipeline.mixed(spark, docs, "")
    assert out.columns == docs.columns + ["_size", "_copies"]
    assert [(r["size"], r["copies"], r["_size"], r["_copies"]) for r in out.collect()] == [(9, "z", 3, 2)]


def test_registered_queries():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names


def test_queries_equal_their_sql(spark):
    from oracle import compare, connect

    from assetlake.llm import queries

    tables = connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert compare(spark, tables, queries.queries()[name], sql, SF) == "", name
