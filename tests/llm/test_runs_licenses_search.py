"""Periodic runs, license scans and lexical search against brute force, on odd cases and on sf0.001."""
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from llm_fixtures import no_documents, odd_documents  # noqa: F401

from foldspark.llm import lexical_search as S
from foldspark.llm import license_scan as C
from foldspark.llm import periodic_runs as R
from foldspark.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ---------------------------------------------------------------- operator 11
def brute_runs(words, min_words=12):
    """All maximal runs by every period: (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(min_words, 2 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of(lists, min_words=12):
    numbers = np.array([x for words in lists for x in words], np.int64)
    found = R.find_runs(numbers, np.array([len(w) for w in lists]), min_words)
    out = [[] for _ in lists]
    for d, *run in zip(*(c.tolist() for c in found), strict=True):
        out[d].append(tuple(run))
    return out


def test_runs_against_brute_force():
    rng = np.random.default_rng(3)
    for case in range(300):
        lists = []
        for _ in range(int(rng.integers(1, 4))):
            n = int(rng.integers(0, 140))
            words = rng.integers(0, int(rng.choice([1, 2, 3, 30])), n)
            for _ in range(int(rng.integers(0, 4))):
                if n > 3:
                    a = int(rng.integers(0, n))
                    p, end = int(rng.integers(1, max(2, (n - a) // 2))), int(rng.integers(a, n + 1))
                    for i in range(a + p, end):
                        words[i] = words[i - p]
            lists.append(words.tolist())
        min_words = int(rng.choice([12, 12, 4, 7]))
        assert runs_of(lists, min_words) == [brute_runs(w, min_words) for w in lists]


def test_runs_of_hard_texts():
    half = [i % 2 for i in range(150)]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    hard = [half + [1 - w for w in half], fibonacci[-1], [0] * 300, [bin(i).count("1") % 2 for i in range(256)], [0, 1] * 5, [0] * 12,
            [0] * 11, list(range(40)) * 2, list(range(40)) * 2 + [40]]
    assert runs_of(hard) == [brute_runs(w) for w in hard]
    long = runs_of([[0] * 200_000, [i % 7919 for i in range(60_000)]])     # one run each, no pair of all words
    assert long == [[(0, 200_000, 1)], [(0, 60_000, 7919)]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("name", ["odd_documents", "small"])
def test_run_digests(request, name):
    docs = request.getfixturevalue(name)
    if name == "odd_documents":
        docs = docs.filter("doc_id is null or doc_id <> 10")        # 20000 words: too slow by brute force
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = planted(r.doc_id, r.text)
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    found = R.run_digests(R.plant_periods(docs))
    assert [d for d in found.dtypes][:6] == [(c, "bigint") for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    if name == "small":
        assert sum(w[1] > 0 for w in want) > 10


def test_runs_and_texts_of_the_operator(spark, no_documents):
    assert R.periodic_runs(no_documents).count() == 0 and R.run_digests(no_documents).count() == 0
    text = "start " + "a b c " * 5 + "end"
    row = R.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), task_words=3).first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "start a b c end" and row.n_words == 17


# ---------------------------------------------------------------- operator 12
def brute_scan(rules, words):
    """All rules on the whole text, no prefilter; suppression by comparing with every kept match."""
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    number = lambda pos: sum(s <= pos for s in starts) - 1
    found = []
    for rule in rules:
        place = rule.pattern.groupindex.get("name", 0)
        found += [(rule, number(m.start(place)), number(m.end(place) - 1)) for m in rule.pattern.finditer(joined)]
    kept = []
    for match in sorted(found, key=lambda m: (m[0].priority, m[1] - m[2], m[1])):
        if not any(k[1] <= match[1] and match[2] <= k[2] for k in kept):
            kept.append(match)
    return kept


def spelled(pattern, rng):
    """A text that a rule matches: options and repeats are drawn."""
    out, i = "", 0
    parts = re.compile(r"\[([^\]]*)\]|\.\{0,\d+\}|(\(\?:|\(\?P<\w+>|\()|\)|\||.")

    def group(i):
        options, text = [], ""
        while i < len(pattern):
            m = parts.match(pattern, i)
            token, i = m[0], m.end()
            if m[2]:
                piece, i = group(i)
            elif token == ")":
                return str(rng.choice(options + [text])) if options else text, i
            elif token == "|":
                options.append(text)
                text = ""
                continue
            elif token.startswith("["):
                piece = {"^ ": "word", "1-4": "3", "0-9 ": "3 "}.get(m[1], m[1][:1])
            elif token.startswith("."):
                piece = "some words " if len(token) > 1 else "w"
            else:
                piece = token
            q = re.match(r"\{(\d),\d\}|[?*+]", pattern[i:])
            if q:
                i += q.end()
                piece = piece if q[0][0] in "+{" or rng.random() < 0.5 else ""
            text += piece
        return text, i

    return group(0)[0]


def test_rules_and_prefilter():
    rules = C.parse_rules()
    assert len(rules) >= 300 and all(r.words for r in rules) and len({r.label for r in rules}) > 80
    scanner, rng = C.Scanner(rules), np.random.default_rng(4)
    raw = [r.pattern.pattern.decode().removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])") for r in rules]
    hit = set()
    for pattern, rule in zip(raw, rules, strict=True):
        for _ in range(6):
            if rule.pattern.search(b" ".join(C.lower_words(spelled(pattern, rng).encode()))):
                hit.add(rule.priority)
    assert len(hit) >= 0.97 * len(rules)                      # nearly every rule can be spelled and matches
    for _ in range(300):
        pieces = [spelled(raw[int(rng.integers(0, len(raw)))], rng) if rng.random() < 0.8 else "plain words here"
                  for _ in range(int(rng.integers(1, 6)))]
        words = C.lower_words(" ".join(pieces).encode())
        assert [tuple(m) for m in scanner.scan(words)[1]] == brute_scan(rules, words)


def test_words_and_priorities():
    text = "ÀB-c_9 \x7f{x}\tLicensed under the Apache License, Version 2.0; also GPL-3.0-or-later."
    assert C.lower_words(text.encode())[:5] == ["Àb".encode(), b"c", b"9", b"x", b"licensed"]
    base, found = C.Scanner(C.parse_rules()).scan(C.lower_words(text.encode()))
    assert [b for _, b in base] == ["apache-2"]
    assert {m.rule.label for m in found} == {"apache-2", "gpl-3-or-later"}     # "apache license" lies inside: suppressed


@pytest.mark.parametrize("name", ["odd_documents", "small"])
def test_license_labels(spark, request, name):
    docs = request.getfixturevalue(name).select("doc_id", "text")
    extra = [(901, "cc by nc cc by nc! Under the MIT license\nunder the  mit LICENSE"), (902, "CC BY-NC-ND 4.0, all rights reserved"),
             (903, "under the mit licenses"), (904, "\x00\x2f:@"), (905, None), (906, "x" * 200_000 + " apache license version 2")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rules = C.parse_rules()
    got = {}
    for r in C.license_labels(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    for row in docs.collect():
        r = got[row.doc_id][0]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                           "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row.text or ""))
        base = [(i, label) for phrase, label in C.BASE_PHRASES.items() for n in [len(phrase.split())]
                for i in range(len(words) - n + 1) if words[i:i + n] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(base)) and 0 <= r.score <= 1
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        own = {m[0].label for m in brute_scan(rules, [w.encode() for w in words])} if len(words) < 5000 else set()
        assert r.labels == ",".join(sorted(own | {label for _, label in base}))
        assert (r.score > 0) == bool(r.labels)
    assert got[901][0].n_base == 4 and got[905][0].n_words == 0 and got[904][0].labels == ""


def test_license_empty(no_documents):
    assert C.license_labels(no_documents).count() == 0


# ---------------------------------------------------------------- operator 13
def brute_search(docs, items, k=50):
    """(item position, rank, doc_id, score) by scoring every document for every item."""
    worded = [(d, C.lower_words(t.encode())) for d, t in docs if d is not None and t is not None]
    worded = [(d, w) for d, w in worded if w]
    n_docs, n_terms = len(worded), sum(len(w) for _, w in worded)
    frequency = {}
    for _, words in worded:
        for w in set(words):
            frequency[w] = frequency.get(w, 0) + 1
    out = []
    for i, text in enumerate(items):
        found = []
        for d, words in worded:
            m, score = 50 + 50 * len(words) * n_docs // n_terms, 0
            for term in set(C.lower_words((text or "").encode())):
                if term in frequency and (tf := words.count(term)):
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[term] + 1)))
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("k,postings,block", [(50, 1 << 20, 1 << 20), (3, 40, 60)])
def test_search_against_brute_force(spark, odd_documents, k, postings, block):
    """Whole and tiny shards, one block of items and many; ties, repeated ids, rows and items, nulls."""
    rng = np.random.default_rng(6)
    words = [f"t{i}" for i in range(60)]
    rows = [(100 + d, " ".join(rng.choice(words, int(rng.integers(1, 40)), p=np.arange(60, 0, -1) / 1830))) for d in range(250)]
    rows += [(400, "T5 t5, t7"), (401, "t5 T5 t7"), (401, "t5 t5 t7"), (402, None), (None, "t5 t7"), (403, " ,.- ")]
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()] + rows
    items = [" ".join(rng.choice(words, int(rng.integers(1, 12)))) for _ in range(25)] + ["t5 T7", "t5 T7", None, "", "nowhere", "the fox"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, score int")
    got = [tuple(r) for r in S.ranked_search(frame, bench, k, postings, block).collect()]
    assert sorted(got) == sorted(brute_search(docs, items, k))


def test_search_skips_postings(small, spark):
    """The bounds leave out postings, and pair bounds leave out more than single terms' maxima."""
    items = next(S.item_blocks(spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    terms = sorted({t for i in items for t in i.terms})
    index = S.build_shards(small.coalesce(1), terms)
    row = index.first()
    frequency = np.zeros(len(terms), np.int64)
    frequency[row.terms] = row.counts
    plan = S.make_plan(items, terms, frequency, row.n_docs, row.n_terms)
    shard_row = S.impact_shards(index, plan, 5).first()
    everything = paired = single = 0
    for units in plan.units:
        shard = S.Shard(*(np.array(shard_row[c]) for c in ("doc_ids", "terms", "counts", "docs", "impacts")))
        joint = dict.fromkeys(range(len(plan.pairs)), 0) | dict(zip(shard_row.pairs, shard_row.joint_max, strict=True))
        loose = {p: shard.tops.get(a, 0) + shard.tops.get(b, 0) for p, (a, b) in enumerate(plan.pairs)}
        ids, scores = S.search_shard(shard, units, joint, 0, 5)
        everything += shard.read
        for bounds, name in ((joint, "joint"), (loose, "loose")):
            again = S.Shard(*(np.array(shard_row[c]) for c in ("doc_ids", "terms", "counts", "docs", "impacts")))
            other = S.search_shard(again, units, bounds, int(scores[-1]), 5)
            assert (other[0] == ids).all() and (other[1] == scores).all()
            paired, single = (paired + again.read, single) if name == "joint" else (paired, single + again.read)
    assert paired < single <= everything


def test_search_of_empty_tables(spark, no_documents):
    bench = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert S.ranked_search(no_documents, bench).count() == 0
    assert S.ranked_search(bench.selectExpr("item_id as doc_id", "text"), bench.filter("1 = 0")).count() == 0


def test_registered(spark):
    assert {"op11_periodic_runs", "op12_license_scan", "op13_lexical_search"} <= set(registry.QUERIES)
    assert registry.QUERIES["op13_lexical_search"](spark, SMALL).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"),
                                                                           ("score", "bigint")]
