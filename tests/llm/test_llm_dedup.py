"""Exact dedup, SimHash and passages against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from assetlake.llm import components, exact, passages, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fp string, size long"


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in texts]


WORDS = [f"w{i}" for i in range(300)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def some_texts(seed=1):
    r = random.Random(seed)
    base = [prose(r, n) for n in (1, 2, 3, 30, 60, 200, 5000)]
    texts = base + base[2:5] * 3 + ["", None, " ", "\t\n", "Ab c", "ab c", "ab  c"]
    for t in base[4:]:
        for _ in range(4):
            words = t.split(" ")
            words[r.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    return list(enumerate(texts))


def test_quotient_filter_keeps_every_count():
    r = np.random.default_rng(0)
    keys = r.integers(0, 1 << 40, 5000, dtype=np.uint64)
    keys = np.r_[keys, keys[:700], keys[:50], np.array([0, 0, (1 << 59) - 1], np.uint64)]
    parts = [np.unique(p, return_counts=True) for p in np.array_split(keys, 7)]
    filters = [exact.QuotientFilter.load(exact.QuotientFilter.of(k, c.astype(np.uint64), 59).dump()) for k, c in parts]
    merged = exact.QuotientFilter.merge(filters)
    wanted = np.unique(keys, return_counts=True)
    assert (merged.keys() == wanted[0]).all() and (merged.counts == wanted[1]).all()
    empty = exact.QuotientFilter.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64), 59)
    assert len(exact.QuotientFilter.merge([empty, exact.QuotientFilter.load(empty.dump())]).keys()) == 0


def test_exact_duplicates(spark):
    texts = some_texts()
    found = {r["doc_id"]: r for r in exact.exact_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(found) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame(rows([(None, "a"), (None, "a"), (3, "a"), (None, "b"), (5, "c"), (5, "c")]), SCHEMA)
    found = exact.exact_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in found) == [(-1, -1, 1, True), (-1, 3, 3, False), (-1, 3, 3, False), (3, 3, 3, True), (5, 5, 2, True), (5, 5, 2, True)]
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "b"), (3, "a"), (5, "c")]
    assert exact.exact_duplicates(docs.limit(0)).count() == 0 and exact.deduplicate(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, pairs):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash(spark):
    texts = some_texts(2)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    label = brute_components(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == label


def near(r, base, n, most):
    out = {base}
    while len(out) < n:
        x = r.choice(sorted(out))
        for _ in range(r.randrange(1, most)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return out


def test_links_find_every_component(spark):
    r = random.Random(3)
    values = set()
    for n, most in ((400, 3), (30, 5), (2, 3), (9, 4)):
        values |= near(r, r.getrandbits(64), n, most)
    values |= {r.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    wanted = brute_components(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert {x: got.get(x, x) for x in signed} == wanted


def test_tiles_skip_no_pair():
    r = random.Random(4)
    values = np.array(sorted(near(r, r.getrandbits(64), 300, 4)), np.uint64)
    buckets = np.array([r.randrange(5) for _ in values])
    for tile in (3, 7, 64):
        a, b = simhash.tiled(buckets, values, 3, tile=tile)
        label = brute_components(range(300), list(zip(a.tolist(), b.tolist())))
        assert label == brute_components(range(300), [(x, y) for x, y in combinations(range(300), 2) if buckets[x] == buckets[y] and (int(values[x]) ^ int(values[y])).bit_count() <= 3])
    assert len(simhash.tiled(buckets[:0], values[:0])[0]) == 0


def test_large_buckets_are_compared_in_parts(spark):
    r = random.Random(13)
    values = near(r, r.getrandbits(64), 400, 3) | {r.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), per_task=30)
    got = {x["node"]: x["component"] for x in components.components(edges).collect()}
    wanted = brute_components(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert {x: got.get(x, x) for x in signed} == wanted


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-40, 60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: -40 for i in range(-40, 61)}, 200: 200, 201: 200}
    assert components.components(edges.limit(0)).count() == 0


def test_simhash_of_odd_rows(spark):
    docs = spark.createDataFrame(rows([(None, "x y z"), (7, "x y z"), (8, None), (9, ""), (9, "q r s t"), (None, "u v w")]), SCHEMA)
    found = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(None, 7), (7, 7), (8, 8), (9, 8), (9, 9), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in kept.collect()) == [(-1, "u v w"), (7, "x y z"), (8, ""), (9, "q r s t")]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def five_word_sets(texts):
    def one(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    return {i: one(t) for i, t in texts}


def jaccard_pairs(sets):
    return [(a, b) for a, b in combinations(sets, 2) if (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] | sets[b] else True)]


@pytest.mark.parametrize("options", [{}, {"per_task": 6}])
def test_near_copies_leave_one_of_each_group(spark, options):
    r = random.Random(14)
    texts = []
    for n in (3, 6, 12, 60, 200, 900):
        base = [r.choice(WORDS) for _ in range(n)]
        for _ in range(9):
            words = list(base)
            for _ in range(r.randrange(1 + n // 40)):
                words[r.randrange(n)] = r.choice(WORDS)
            base = words if r.random() < 0.4 else base  # some are near copies of near copies alone
            texts.append(" ".join(words))
    texts = list(enumerate([*texts, "", None, " \t", texts[20].upper(), prose(r, 4), prose(r, 500)]))
    sets = five_word_sets(texts)
    label = brute_components(sets, jaccard_pairs(sets))
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    kept = simhash.drop_near_duplicates(docs, **options).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(label.values()))


def test_near_copies_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(x["doc_id"], x["text"]) for x in docs.collect()]
    sets = five_word_sets(texts)
    holders = {}
    for i, s in sets.items():
        for x in s or {b""}:
            holders.setdefault(x, []).append(i)
    near_ = {p for v in holders.values() if len(v) < 200 for p in combinations(v, 2)} | {(v[0], x) for v in holders.values() for x in v[1:]}
    pairs = [(a, b) for a, b in near_ if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = brute_components(sets, pairs)
    assert sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()) == sorted(set(label.values()))


def test_near_copies_of_rows_that_share_an_id(spark):
    x, y = prose(random.Random(1), 80), prose(random.Random(2), 80)
    docs = spark.createDataFrame(rows([(3, x), (5, x), (5, y), (7, prose(random.Random(3), 80)), (8, y), (8, y), (8, y)]), SCHEMA)
    assert sorted((r["doc_id"], r["text"] == x, r["text"] == y) for r in simhash.drop_near_duplicates(docs).collect()) == [(3, True, False), (5, False, True), (7, False, False)]
    twice = spark.createDataFrame(rows([(1, x), (1, x), (None, y), (None, y)]), SCHEMA)
    assert sorted(str(r["doc_id"]) for r in simhash.drop_near_duplicates(twice).collect()) == ["1", "None"]


ODD = "doc_id long, DOC_ID string, text string, Text string, `a.b` string, lang string, source string, n_chars long"


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "p", "some words here", "q", "r", "en", "s", 1), (2, "p", "some words here", "q", "r", "en", "s", 1), (3, None, None, None, None, None, None, None)], ODD)
    assert {r["keep_id"] for r in exact.exact_duplicates(docs).collect()} == {2, 3}
    for kept in (exact.deduplicate(docs), simhash.drop_near_duplicates(docs)):
        assert kept.columns == docs.columns and len(kept.collect()) == 2
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1, 3}


def test_simhash_of_a_very_long_text(spark):
    long = prose(random.Random(5), 150_000)
    docs = spark.createDataFrame([(1, long, "en", "s", 1, "x", 1), (2, "short", "en", "s", 1, "x", 1), (3, long + " end", "en", "s", 1, "x", 1)], SCHEMA)
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == f"{brute_fingerprint(long):016x}"
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [1, 2]


def test_chains_follow_both_orders():
    segments = np.array([(0, 100, 20, 120), (20, 125, 40, 145), (45, 10, 60, 25), (60, 150, 90, 180)])
    best, score = passages.chain(segments)[0]
    assert best == [0, 1, 3] and score == pytest.approx(70 - 0.1 * (5 + 25))
    assert [links for links, _ in passages.chain(segments)] == [[0, 1, 3], [2]]


def test_common_words():
    r = random.Random(5)
    for _ in range(30):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(np.array(a), np.array(b)) == table[-1][-1]


def test_winnowing_meets_in_every_window():
    r = np.random.default_rng(6)
    g, bounds = r.integers(1, 1 << 60, 300, dtype=np.uint64), np.array([0, 100, 110, 300])
    got = set(passages.winnow(g, bounds, 8, 16).tolist())
    wanted = set()
    for a, b in zip(bounds, bounds[1:]):
        for s in range(a, b - 23 + 1):
            wanted |= {s + int(i) for i in np.flatnonzero(g[s : s + 16] == g[s : s + 16].min())}
    assert got == wanted


def test_passages_are_found_with_their_bounds(spark):
    r = random.Random(7)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    shared, other = new(51), new(120)
    fuzzy = list(other)
    for i in (17, 50, 83):
        fuzzy[i] = "edit"
    del fuzzy[100]
    texts = [
        (1, new(40) + shared + new(30)), (2, new(7) + shared), (3, shared + new(90)), (4, new(300)), (5, new(10) + other + new(5)), (6, fuzzy + new(80)),
        (7, shared[:30] + new(60)), (8, ["Shti"] * 70), (9, ["shti"] * 90), (10, []),
    ]
    data = [(i, " ".join(t)) for i, t in texts] + [(11, None), (None, " ".join(shared))]
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string"))
    rows_ = {frozenset((r["doc_id"], r["rep_id"])): r for r in got.collect()}
    holders = {i for pair in rows_ for i in pair}
    assert holders == {1, 2, 3, 5, 6, 8, 9}
    words = dict(texts)
    for r in rows_.values():
        a, b = words[r["doc_id"]][r["start"] : r["end"]], words[r["rep_id"]][r["rep_start"] : r["rep_end"]]
        if {r["doc_id"], r["rep_id"]} <= {1, 2, 3}:
            assert a == b == shared and r["identity"] == 1.0
        if {r["doc_id"], r["rep_id"]} == {5, 6}:
            assert len(a) >= 110 and 0.9 < r["identity"] < 1
    spans = {r["doc_id"]: r["spans"] for r in passages.covered(got).collect()}
    assert all(s["start"] < s["end"] for v in spans.values() for s in v)
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unlike_chains_are_cut():
    r = random.Random(8)
    a = np.array([r.randrange(1 << 15) for _ in range(300)], "<u2")
    b = a.copy()
    b[120:180] = [(1 << 15) + i for i in range(60)]  # 60 words differ on one diagonal
    b[200:290] = [(1 << 15) + 100 + i for i in range(90)]
    got = passages.align(a, b, (0, 0), (300, 300), 0.8)
    assert (0, 120, 0, 120, 120) in got and all(2 * n >= 0.8 * (e - s + f - t) for s, e, t, f, n in got)
    assert passages.align(a, b, (0, 0), (120, 120), 0.8) == [(0, 120, 0, 120, 120)]


def test_a_passage_beside_partial_holders_is_found(spark):
    r = random.Random(9)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    p = new(60)
    texts = [(1, new(30) + p[:35] + new(40)), (2, new(25) + p + new(25)), (3, new(50) + p + new(10)), (4, p[:20] + new(30) + p[40:] + new(5))]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").coalesce(1))
    assert {frozenset((x["doc_id"], x["rep_id"])) for x in got.collect()} == {frozenset((2, 3))}


def edited(words, new, every):
    """One word replaced in each run of `every`: the last one, so that no longer runs are left."""
    return [new(1)[0] if i % every == every - 1 else w for i, w in enumerate(words)]


@pytest.mark.parametrize("every", [5, 6, 8, 10, 12])
def test_passages_with_edits_are_found(spark, every):
    r = random.Random(every)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    texts = []
    for i in range(40):
        p = new(60)
        texts += [(2 * i, new(r.randrange(30)) + p + new(20)), (2 * i + 1, new(r.randrange(30)) + edited(p, new, every) + new(20))]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string"))
    assert {frozenset((x["doc_id"], x["rep_id"])) for x in got.collect()} == {frozenset((2 * i, 2 * i + 1)) for i in range(40)}


@pytest.mark.parametrize("holders", [1, 12])
def test_copies_after_partial_holders_are_found(spark, holders):
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    p = new(65)
    parts = [new(5) + p[:45] + new(5) for _ in range(holders)] + [new(5) + p[20:] + new(5) for _ in range(holders)]
    texts = list(enumerate([*parts, new(9) + p + new(9), new(3) + p + new(7)]))
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").coalesce(1))
    assert frozenset((2 * holders, 2 * holders + 1)) in {frozenset((x["doc_id"], x["rep_id"])) for x in got.collect()}


def fresh_words():
    fresh = iter(range(10**7))
    return lambda n: [f"u{next(fresh)}" for _ in range(n)]


def test_long_texts_that_share_many_runs(spark):
    new, a, b = fresh_words(), [], []
    for _ in range(1300):
        run = new(30)
        a += run + new(34)
        b += run + new(34)
    p = new(80)
    a[40_000:40_000], b[50_000:50_000] = p, p
    got = passages.repeated_passages(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[:40_000]))], "doc_id long, text string")).collect()
    spans = {frozenset((x["doc_id"], x["rep_id"])) for x in got}
    assert spans == {frozenset((1, 2)), frozenset((1, 3))}
    whole = next(x for x in got if {x["doc_id"], x["rep_id"]} == {1, 3})
    assert whole["matched"] == 40_000 and whole["identity"] == 1.0


def test_heavy_seeds_still_connect_all_holders(spark):
    new = fresh_words()
    line, p = new(12), new(70)
    texts = [(i, new(20) + line + new(20) + (p if i % 2 else new(10)) + new(5)) for i in range(80)]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3), heavy=20).collect()
    found = {x["doc_id"] for x in got} | {x["rep_id"] for x in got}
    assert found == set(range(1, 80, 2))
    label = brute_components(found, [(x["doc_id"], x["rep_id"]) for x in got])
    assert len(set(label.values())) == 1 and len(got) < 40 * 6


def texts_of_frequent_seeds():
    """Passages that share a seed, a line or a run of 16 words with many texts, or that are frequent as a whole."""
    r, new = random.Random(5), fresh_words()
    line, start, edge, p = new(12), new(5), new(24), new(70)
    texts = []
    for i in range(60):
        # 60 words of which two texts share runs of 12 alone, each after a start that all texts have
        if i % 2 == 0:
            shared = [start + new(7) for _ in range(5)]
        edited = [w for run in shared for w in run + new(1)]
        texts.append(new(7) + edited + new(3) + line + new(r.randrange(9)) + (p if i % 3 else p[: r.randrange(40, 70)]) + new(2))
    texts += [new(3) + (edge + [f"v{r.randrange(3)}" for _ in range(r.randrange(1, 30))]) * 3 for _ in range(60)]
    texts += [["the"] * r.randrange(40, 90) for _ in range(20)] + [["a", "b", "c"] * r.randrange(20, 40) for _ in range(20)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("unit", [1 << 18, 50])
def test_passages_are_the_same_however_many_places_are_heavy(spark, monkeypatch, unit):
    monkeypatch.setattr(passages, "UNIT", unit, raising=False)  # the driver's alone: more ranges
    docs = spark.createDataFrame(texts_of_frequent_seeds(), "doc_id long, text string").repartition(3).localCheckpoint()
    rows = lambda heavy: sorted(tuple(x) for x in passages.repeated_passages(docs, heavy=heavy).collect())
    wanted = rows(10**9)
    pairs = {frozenset((x[0], x[3])) for x in wanted}
    assert {frozenset((i, i + 1)) for i in range(0, 60, 2)} <= pairs
    for heavy in (9, 30, 100):
        assert rows(heavy) == wanted


def test_links_of_sorted_units_are_those_of_one_unit():
    """However the places of one run of 16 words are cut, the links are those that meet() makes of them all."""
    r = np.random.default_rng(2)
    for n in (10, 40, 300):
        after = r.choice([5, 6, 7], n).astype(np.uint32)
        doc = r.choice(n // 3, n).astype(np.int64) + 1
        place = r.permutation(n).astype(np.int32)
        before = r.choice([0, 1, 3], n).astype(np.uint16)
        wanted = set(zip(*[x.tolist() for x in passages.meet(np.full(n, 9, np.uint32), after, doc, place, before)]))
        nth = passages._ordinals(after, doc, place)
        order = np.lexsort((doc, nth, after))
        columns = [x[order] for x in (np.full(n, 9), after, nth, doc, place, before)]
        for size in (1, 2, 3, 7, n):
            units, tails = [], []
            for at in range(0, n, size):
                own = [x[at : at + size] for x in columns]
                first = int(np.flatnonzero(passages._run_starts(own[1]))[-1])
                keep = sorted({first, min(first + 1, len(own[0]) - 1), len(own[0]) - 1})
                tails.append([tuple(int(x[i]) for x in own) for i in keep])
                units.append([0, len(units), *[x.astype(t).tobytes() for x, (_, _, t) in zip(own, passages.HEAVY_FIELDS)]])
            carry = {(0, i): x for i, x in enumerate(passages.carried(tails))}
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * len(passages.HEAVY_FIELDS)]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*units), kinds)], names=[str(i) for i in range(len(kinds))])
            got = [link for b in passages._heavy_links([batch], passages.LEAST_WORDS, carry) for link in zip(*[c.to_pylist() for c in b.columns])]
            assert len(got) == len(set(got)) and set(got) == wanted


def longest_common(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, table[j + 1] = table[j + 1], last + 1 if x == y else max(table[j + 1], table[j])
    return table[-1]


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15])
def test_recall_of_passages_with_random_edits(spark, rate):
    r, new = random.Random(int(rate * 100)), fresh_words()
    texts, wanted = [], set()
    for i in range(120):
        p, q = new(60), []
        for w in p:
            kind = r.random()
            q += [] if kind < rate / 3 else new(1) if kind < 2 * rate / 3 else [w, *new(1)] if kind < rate else [w]
        if 2 * longest_common(p, q) >= 0.8 * (len(p) + len(q)) and len(q) >= 54:
            wanted.add(frozenset((2 * i, 2 * i + 1)))
        texts += [(2 * i, new(30) + p + new(20)), (2 * i + 1, new(10) + q + new(25))]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string"))
    found = {frozenset((x["doc_id"], x["rep_id"])) for x in got.collect()}
    assert all(min(x) // 2 == max(x) // 2 for x in found)
    assert len(found & wanted) >= 0.95 * len(wanted) and len(wanted) > 60


def test_passages_cover_every_repeated_window(spark):
    """Against brute force: each document with 50 words in a row that another has is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    windows = {}
    for x in docs.collect():
        words = (x["text"] or "").encode().lower().split()
        for i in range(len(words) - 49):
            windows.setdefault(b" ".join(words[i : i + 50]), set()).add(x["doc_id"])
    wanted = {i for v in windows.values() if len(v) > 1 for i in v}
    got = passages.repeated_passages(docs).collect()
    assert wanted <= {x["doc_id"] for x in got} | {x["rep_id"] for x in got}
    words = {x["doc_id"]: (x["text"] or "").encode().lower().split() for x in docs.collect()}
    for x in got:
        a, b = words[x["doc_id"]][x["start"] : x["end"]], words[x["rep_id"]][x["rep_start"] : x["rep_end"]]
        assert len(a) >= 50 and x["identity"] >= 0.8 and 2 * longest_common(a, b) >= 2 * x["matched"] > 0


def test_passages_of_odd_rows(spark):
    p = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, TEXT string, text string, `a.b` string"
    docs = spark.createDataFrame([(1, "x", p, "y"), (1, "x", p, "y"), (2, None, None, None), (3, "x", p.upper(), "z"), (4, "", "", "")], schema)
    got = {(x["doc_id"], x["rep_id"]) for x in passages.repeated_passages(docs).collect()}
    assert got and {frozenset(x) for x in got} == {frozenset((1, 3))}


def test_maximal_stretches():
    def brute(scores, lo, hi):
        spans = [(sum(scores[i:j]), -i, -j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        total, i, j = max(spans, default=(0, 0, 0))
        return [*brute(scores, lo, -i), (-i, -j), *brute(scores, -j, hi)] if total > 0 else []

    r = random.Random(11)
    for _ in range(200):
        scores = [r.choice((-3, -2, -1, 1, 2, 4)) + r.random() for _ in range(r.randrange(12))]
        assert passages.maximal(scores) == brute(scores, 0, len(scores))
