"""Operators 11 to 13 on odd rows, against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from arcwright.llm.collocations import collocations, multikey_counts, pack_windows_of, phrase_counts, suffixes, unpack_windows
from arcwright.llm.progressive_centroids import LENGTH, cluster_vectors, hadamard, nearest
from arcwright.llm.queries import URL_LIST
from arcwright.llm.url_rules import ListRule, judge_urls, label_urls, train_url_rules, url_parts, url_tokens
from pyspark.sql import functions as F

CLASHES = "row string, v string, cluster string, distance string, j string, n string, verdict string, host string, tokens string, rank string, phrase string, words string"
N = len(CLASHES.split(","))


# ---- 11


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(np.float64(x) * 64)) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    place = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centers = [list(v) for _, v in sorted(kept, key=place)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, o) in zip(kept, of, strict=True) if o == j]
            if own:
                centers[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = assign()
    most = 2**63 - 1
    inertia = [sum(min(most, d) for d, o in of if o == j) for j in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, o, min(most, d), min(most, inertia[o]), min(most, sum(inertia)), digest[o]) for (i, _), (d, o) in zip(kept, of, strict=True)), key=repr)


@pytest.mark.parametrize("large", [False, True])
def test_clusters_match_a_plain_loop(spark, large):
    rng = np.random.RandomState(1)
    vectors = [(i, [float(x) for x in rng.randn(64)]) for i in range(150)]
    vectors += [(3, vectors[3][1]), (3, vectors[4][1]), (None, vectors[5][1]), (900, [0.0] * 64), (901, [0.0] * 64), (902, [-1e-9] * 64)]
    vectors += [(910, None), (911, [1.0] * 63), (912, [1.0] * 63 + [None]), (913, [1.0] * 63 + [float("nan")]), (914, [float("inf")] * 64), (915, [])]
    if large:
        vectors += [(920, [3e38] + [0.0] * 63), (921, [-1e5] * 64), (922, [1.7e308] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, *["x"] * N) for i, v in vectors], f"vec_id long, embedding array<double>, {CLASHES}").repartition(3)
    got = sorted((tuple(r) for r in cluster_vectors(df).collect()), key=repr)
    assert got == plain_clusters(vectors)
    assert sorted((tuple(r) for r in cluster_vectors(df.repartition(5)).collect()), key=repr) == got


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64)]
    got = sorted((tuple(r) for r in cluster_vectors(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == plain_clusters(rows)


def test_progressive_search_is_exact_and_skips():
    rng = np.random.RandomState(2)
    centers = rng.randint(-300, 300, (16, LENGTH))
    x = np.concatenate([centers[rng.randint(0, 16, 500)] + rng.randint(-9, 9, (500, LENGTH)), centers, (centers[:1] + centers[1:2]) // 2])
    of, away, taken = nearest(x, np.concatenate([centers, centers[:2]]))  # repeated centroids: the smaller number
    every = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (of == every.argmin(axis=1)).all() and (away == every.min(axis=1)).all()
    assert taken < 0.4 * len(x) * 18 * LENGTH
    assert (hadamard(hadamard(np.eye(LENGTH, dtype=np.int64))).sum() != 0) and (hadamard(x)[:, 0] == x.sum(axis=1)).all()


# ---- 12


def test_parts_and_list_rules(spark):
    urls = [
        ("http://A.Example.org/es/1?x=/en/1#f", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/"), ("http://org", "org", "", None), ("http://b.com?/fr/", "b.com", "", None), ("http://b.com/fr/", "b.com", "/fr/", "com/fr/"),
        ("b.com/fr/", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c.org/x", "b:", "//c.org/x", None), ("http://x.com#/fr/", "x.com", "", None), ("http://co.m\n.com/de/\n?", "co.m\n.com", "/de/\n", "com/de/"),
    ]
    df = spark.createDataFrame([(u, *["x"] * N) for u, *_ in urls], f"url string, {CLASHES}")
    mined = train_url_rules(label_urls(df, URL_LIST))
    got = judge_urls(df, URL_LIST, mined)
    assert set(got.columns) == set(df.columns) | {"rule", "path"}
    by = {r["url"]: r for r in got.collect()}
    for url, host, path, rule in urls:
        assert (by[url]["host"], by[url]["path"], by[url]["rule"]) == (host, path, rule), url
        assert by[url]["verdict"] in ("allow", "block")
    assert by["b.com/fr/"]["row"] == "x"


def test_rules_are_mined_and_matched(spark):
    rows = [(f"http://{'spam' if i % 2 else 'good'}.x{i % 7}.com/a{i % 3}/{i}", "block" if i % 2 else "allow") for i in range(200)]
    rows += [(f"http://mixed.com/casino/{i}", "block" if i % 5 else "allow") for i in range(50)]
    labelled = spark.createDataFrame(rows * 2 + [("http://spam.com", None), (None, None)], "url string, verdict string")
    mined = train_url_rules(labelled, min_support=0.02, min_confidence=0.8)
    tokens = {tuple(sorted(t)): (v, a, b) for t, _, v, a, b in mined.rules}
    assert tokens["h:spam",] == ("block", 200, 200) and tokens["h:good",] == ("allow", 200, 200) and tokens["p:casino",] == ("block", 80, 100)
    counts = Counter()
    each = [(set(re.findall(r"\w+", u.split("://")[1])), v) for u, v in rows * 2]
    for t, (v, a, b) in tokens.items():
        names = {x[2:] for x in t}
        counts["n"] += 1
        assert (sum(names <= own and said == v for own, said in each), sum(names <= own for own, _ in each)) == (a, b)
    assert counts["n"] > 10 and all(a >= 10 and a / b >= 0.8 for _, _, _, a, b in mined.rules)
    tests = ["http://spam.org/", "https://good.net/casino", "http://other.net/casino/5", "http://nothing.net/"]
    got = {r["url"]: r["verdict"] for r in judge_urls(spark.createDataFrame([(u,) for u in tests], "url string"), [], mined).collect()}
    assert got == dict(zip(tests, ["block", "allow", "block", mined.otherwise], strict=True))


def test_rules_without_labels_and_long_urls(spark):
    none = spark.createDataFrame([], "url string, verdict string")
    mined = train_url_rules(none)
    assert mined.rules == [] and mined.otherwise == "allow"
    assert judge_urls(none.select("url"), URL_LIST, mined).count() == 0
    long = "http://a.org/" + "/".join(f"s{i}" for i in range(100_000))
    out = judge_urls(spark.createDataFrame([(long,), (long,)], "url string"), [ListRule("block", "a.org", "/s0")], mined).collect()
    assert [r["verdict"] for r in out] == ["block"] * 2
    assert spark.range(1).select(F.size(url_tokens(F.lit(long))).alias("n"), url_parts(F.lit(long))["path"].alias("p")).first()["n"] == 100_002


# ---- 13


def plain_phrases(rows, least, top=2000, depth=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(depth, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = set()
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and f[lang, p[i:j]] <= a:
                    inside.add((lang, p[i:j]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in inside:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:top], 1))


def phrase_rows():
    rng = np.random.RandomState(5)
    words = ["the", "The", "hot", "pair", "été", "日本", "a\u00a0b", "x'y", "-", "to be", "\tor", "not.", "so,", "\nend", "z" * 300]
    text = lambda m: " ".join(words[min(len(words) - 1, int(rng.exponential(3)))] for _ in range(m))
    rows = [(lang, text(int(rng.randint(1, 60)))) for lang in ("en", "fr", None, "und", "x\ny") for _ in range(25)]
    rows += [("en", "the hot pair of the hot pair")] * 40 + [("en", None), ("fr", ""), (None, None), ("zz", " .,; \n"), ("en", "the hot pair " * 20_000)]
    return rows


@pytest.mark.parametrize("how", [{}, {"share": 1 / 3, "group_suffixes": 50}, {"share": 1 / 50, "sample_texts": 30, "group_suffixes": 20}])
def test_phrases_match_a_plain_count(spark, how):
    rows = phrase_rows()
    df = spark.createDataFrame([(lang, t, *["x"] * N) for lang, t in rows], f"lang string, text string, {CLASHES}").repartition(3)
    got = sorted(tuple(r) for r in collocations(df, least=7, **how).collect())
    assert got == plain_phrases(rows, 7)
    assert len(got) > 100
    few = sorted(tuple(r) for r in collocations(df, least=7, top=5, **how).collect())
    assert few == plain_phrases(rows, 7, 5)


def test_phrases_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    one = phrase_counts(spark.createDataFrame([("en", "a b"), ("fr", None)], "lang string, text string"), 5)
    assert [tuple(r) for r in one.collect()] == [("en", "", 0, 2)]


def test_windows_survive_the_way():
    coded, windows, counts = suffixes(["a b c a b c", "b. a", None, "x" * 40_000])
    words = coded.to_pylist()
    assert int(counts.sum()) == 9 and len(windows) == len(counts)
    depth = np.arange(len(windows)) % 5 + 1
    lang, back, w, n, d = unpack_windows(pack_windows_of("l\nx", words, windows, counts, depth))
    assert lang == b"l\nx" and (n == counts).all() and (d == depth).all()
    assert [[back[i] if i >= 0 else None for i in row] for row in w] == [[words[i] if i >= 0 else None for i in row] for row in windows]


def test_multikey_quicksort_counts_prefixes():
    rng = np.random.RandomState(6)
    columns = np.minimum(6, rng.geometric(0.3, (3000, 4))) - 1
    columns[rng.rand(3000) < 0.2, 2:] = -1
    weights = rng.randint(1, 4, 3000)
    want = Counter()
    for row, w in zip(columns.tolist(), weights.tolist(), strict=True):
        for d in range(4):
            if row[d] < 0:
                break
            want[tuple(row[: d + 1])] += w
    got = {tuple(columns[p, :m].tolist()): n for p, m, n in multikey_counts(columns, weights, 50)}
    assert got == {k: v for k, v in want.items() if v >= 50}
