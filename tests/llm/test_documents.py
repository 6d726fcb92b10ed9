"""Operators on documents against brute force, on a small table of odd cases and on sf0.001."""
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_fixtures import no_documents, odd_documents  # noqa: F401

from foldspark.llm import language_id as L
from foldspark.llm import line_dedup, merge_dropout, packing, sentence_spans, setjoin, token_files, tokens

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def whole_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sorted_rows(df, *columns):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("text", ["don't stop,now...", "a.b.c", "'s 've", "<|startoftext|> x <|ENDOFTEXT|>", "ÀÉ Σς İ",
                                  "tab\tand\x0bvt\x85nel\xa0nbsp\x1csep", "word. word, word!", "", " ", "é x", "1,000.50"])
def test_words_encode_as_the_whole_text(library, text):
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == whole_ids(library, text)


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
def test_bits_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack_bits(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (token_files.unpack_bits(raw, bits, 0, 1001) == ids).all()
    assert (token_files.unpack_bits(raw, bits, 333, 17) == ids[333:350]).all()


@pytest.mark.parametrize("name", ["odd_documents", "small"])
def test_token_files(request, library, name):
    docs = request.getfixturevalue(name)
    want, before = [], 0
    for doc_id, text in sorted_rows(docs):
        ids = [*whole_ids(library, text), 1]
        want.append((doc_id, before, len(ids), crc(ids)))
        before += len(ids)
    got = [tuple(r) for r in token_files.token_files(docs, block_ids=500).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_empty_tables(spark, no_documents):
    assert token_files.token_files(no_documents).count() == 0
    assert packing.pack_documents(no_documents).count() == 0
    assert L.identify(no_documents).count() == 0
    assert L.keep_identified(no_documents).columns == no_documents.columns
    assert setjoin.jaccard_components(no_documents).count() == 0
    assert line_dedup.removed_lines(no_documents).count() == 0
    assert line_dedup.dedup_lines(no_documents).columns == no_documents.columns
    assert sentence_spans.repeated_spans(no_documents).count() == 0
    assert sentence_spans.remove_repeats(no_documents).columns == no_documents.columns
    assert merge_dropout.round_trip(no_documents).count() == 0


def test_language_of_odd_documents(odd_documents):
    found = {r.doc_id: r for r in L.identify(odd_documents).collect()}
    assert len(found) == 14 and all(0 <= r.score <= 1 for r in found.values())
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {4, 5, 6, 11}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in found if d is not None}
    assert held == {d: r.held_out for d, r in found.items() if d is not None}
    kept = L.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {4, 5, 6, 11}.isdisjoint({r.doc_id for r in kept.select("doc_id").collect()})


def test_texts_without_letters_are_undetermined(spark, small):
    odd = spark.createDataFrame([(9001, "\u00bd \u00b2 12 \u0664"), (9002, "\u4e2d"), (9003, "-- 7 --")], "doc_id long, text string") \
        .selectExpr("doc_id", "text", "cast(null as string) as lang")
    found = {r.doc_id: r.lang_pred for r in L.identify(small.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert found[9001] == found[9003] == "und" != found[9002]


def test_language_held_out_accuracy(small):
    found = L.identify(small).join(small.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def ppm_bits(history, text, order=3):
    """Plain PPM, escape C, full exclusion, as a loop."""
    counts = [{} for _ in range(order + 1)]
    seen = {0}
    for raw in history:
        padded = bytes(order) + raw
        seen |= set(padded)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                own = counts[k].setdefault(padded[i - k:i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1
    total, padded = 0.0, bytes(order) + text
    for i in range(order, len(padded)):
        chance, gone, done = 1.0, set(), False
        for k in range(order, -1, -1):
            own = {s: n for s, n in counts[k].get(padded[i - k:i], {}).items() if s not in gone}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if padded[i] in own:
                chance, done = chance * own[padded[i]] / whole, True
                break
            chance *= len(own) / whole
            gone |= set(own)
        if not done:
            chance /= 256 - len(gone)
        total -= np.log2(chance)
    return total


def test_code_lengths_equal_plain_ppm(spark):
    texts = [("x", "abracadabra abba"), ("y", "the cat sat on the mat"), ("x", "barbara")]
    df = spark.createDataFrame(texts, "lang string, text string")
    rows = {}
    for lang in "xy":
        own = [(r.gram, r.n) for r in L.context_counts(df).filter(f"lang = '{lang}'").collect()]
        rows[lang] = (np.array([g for g, _ in own]), np.array([n for _, n in own]))
    model = L.Model.fit(rows)
    tests = [b"abra", b"the bat", b"zzz\xff", b"a", b"cadabra on the mat"]
    want = [[ppm_bits([t.encode() for x, t in texts if x == lang], t) for lang in "xy"] for t in tests]
    assert np.allclose(model.bits(tests, window=4), want, rtol=1e-5)


def test_packing(library, odd_documents):
    rows = packing.pack_documents(odd_documents).collect()
    want = []
    for doc_id, text in sorted_rows(odd_documents):
        ids = [*whole_ids(library, text), 0]
        want += [(doc_id, k, at, len(ids[at:at + 2048]), crc(ids[at:at + 2048]))
                 for k, at in enumerate(range(0, len(ids), 2048))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048


def test_packing_in_many_groups_and_bounds(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 3000)
    df = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "row_id long, piece int, length long")
    out = packing.pack(df, 100, group_pieces=1000).collect()
    assert len(out) == 3000
    sums = {}
    for r in out:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert max(sums.values()) <= 100
    whole = packing.best_fit_decreasing(lengths, 100).max() + 1
    assert packing.lower_bound(lengths, 100) <= len(sums) <= 1.02 * whole
    for _ in range(200):   # the bound never exceeds what best fit needs, and sees big items
        few = rng.integers(1, 21, 9)
        assert packing.lower_bound(few, 20) <= packing.best_fit_decreasing(few, 20).max() + 1
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def brute_components(docs):
    sets = {}
    for doc_id, text in docs:
        if doc_id is not None:
            w = (text or "").encode().lower().split()
            sets.setdefault(doc_id, []).append(
                frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("name", ["odd_documents", "small"])
def test_jaccard_components(request, name):
    docs = request.getfixturevalue(name)
    got = setjoin.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_components(sorted_rows(docs))
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_around_the_threshold(spark):
    """Random small and middle sets whose similarities lie on both sides of the threshold, in small blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(int(rng.integers(5, 60)))]
        for c in range(5):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"n{len(rows)}"
            rows.append((len(rows), " ".join(own + [f"tail{c}"] * int(rng.integers(0, 2)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cost in (0.0, 3.0, 1e9):   # all lists, the default boundary, subsets up to 256 members
        got = {r.doc_id: r.component_id
               for r in setjoin.jaccard_components(docs, block_rows=3, list_cost=cost).collect()}
        assert got == brute_components(rows)


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs, min_words=1, near_words=8):
    lines = [(d, i, line, [w for w in line.replace("\t", " ").split(" ") if w]) for d, t in dict.fromkeys(docs)
             if d is not None and t is not None for i, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if len(x[3]) >= min_words)
    out, firsts = set(), []
    for d, i, line, words in lines:
        equal = next((f for f in firsts if f[2] == line), None)
        if equal:
            out.add((d, i, 0, equal[0], equal[1]))
            continue
        near = next((f for f in firsts if len(words) >= near_words and len(f[3]) >= near_words
                     and abs(len(words) - len(f[3])) < 2 and word_edits(words, f[3]) <= 1), None)
        if near:
            out.add((d, i, 1, near[0], near[1]))
        firsts.append((d, i, line, words))
    return out


def test_line_dedup(spark, odd_documents):
    base = [f"w{i}" for i in range(16)]
    edited = [base[:k] + ["new"] + base[k + 1:] for k in (0, 7, 15)] + [base[:-1], base[1:], base[:8] + ["in"] + base[8:],
                                                                       base + ["in"], base[::-1], ["new"] * 2 + base[2:]]
    rows = [(100 + i, " ".join(w) + "\nshort line\n\nthree words here") for i, w in enumerate([base, *edited])]
    rows += [(200, "a a b c d e f g h"), (201, "a b b c d e f g h"), (202, "a  a\tb c d e f g h")]
    docs = odd_documents.select("doc_id", "text").filter("doc_id is null or doc_id <> 10") \
        .unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r) for r in line_dedup.removed_lines(docs).drop("text_id", "kept_text_id").collect()}
    assert got == brute_lines(sorted_rows(docs))
    assert any(e == 0 and len(line.split()) < 3 for d, i, e, *_ in got for line in [dict(rows).get(d, "").split("\n")[i:i + 1] or [""]][0])
    clean = line_dedup.dedup_lines(odd_documents)
    assert clean.columns == odd_documents.columns and clean.count() == odd_documents.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[2] == "" and texts[4] is None and texts[1] == texts[None]


def test_rows_of_one_id_with_several_texts(spark):
    """Nothing that occurs once is lost when a doc_id comes back with another text; rows are told apart by their text."""
    def words(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n)) + "."

    first = "only in the first text\n" + words("a") + "\nshared line of the two rows\n" + words("same")
    second = "only in the second text\nshared line of the two rows\n" + words("b") + "\n" + words("same")
    rows = [(1, first), (1, second), (1, second), (2, first), (3, words("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.dedup_lines(docs)
    assert lines.count() == 5
    left = sorted(r.text for r in lines.filter("doc_id = 1").collect())
    held = [line for t in set(left) for line in t.split("\n") if line]
    assert sorted(held) == sorted(set(first.split("\n")) | set(second.split("\n")))     # every line in one of the two texts
    assert [r.text for r in lines.filter("doc_id >= 2").orderBy("doc_id").collect()] == ["", words("c")]
    spans = sentence_spans.remove_repeats(docs)
    assert spans.count() == 5
    one = [set(r.text.split()) for r in spans.filter("doc_id = 1").collect()]
    assert set().union(*one) >= set(words("a").split()) | set(words("b").split()) | set(words("same").split())
    assert sum("same5" in t for t in {frozenset(t) for t in one}) == 1
    gone = sentence_spans.repeated_spans(docs).collect()
    assert len({(r.doc_id, r.text_id) for r in gone if r.doc_id == 1}) == 1


def brute_removed(texts, span_words=20, window=8):
    """Ranges that go from each of (doc_id, text) by the rules, with loops and words instead of keys."""
    mask, step = (1 << 64) - 1, int(sentence_spans._STEP)

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    places = {}
    for d, text in texts:
        words = [m.span() for m in re.finditer(r"\S+", text)]
        if not words:
            continue
        own = [text[a:b].lower() for a, b in words]
        hashes = [mix((sum((ord(c) + 1) * pow(step, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & mask) for w in own]
        stops = [text[b - 1] in ".!?" or i + 1 == len(words) or "\n" in text[b:words[i + 1][0]] for i, (a, b) in enumerate(words)]
        cuts, begin = {i for i, s in enumerate(stops) if s}, 0
        for i, s in enumerate(stops):
            if s:
                for j in range(begin, i - window + 2):
                    cuts.add(max(range(j, j + window), key=lambda q: (-hashes[q], q)))
                begin = i + 1
        last = sorted(cuts)
        first = [0, *(c + 1 for c in last[:-1])]
        ends = [words[c + 1][0] if stops[c] and c + 1 < len(words) else words[c][1] for c in last]
        ends[-1] = len(text)
        begins = [0, *ends[:-1]]
        for i in range(len(last)):
            after = next((j for j in range(i + 1, len(last)) if last[j] - first[i] + 1 >= span_words), None)
            before = next((j for j in range(i - 1, -1, -1) if last[i] - first[j] + 1 >= span_words), None)
            for a, b in {(i, after), (before, i)}:
                if a is not None and b is not None:
                    places.setdefault(tuple(own[first[a]:last[b] + 1]), set()).add((d, begins[a], ends[b]))
    gone = {}
    for spans in places.values():
        kept = min(spans)
        for d, a, b in spans:
            if (d, a) != kept[:2]:
                gone.setdefault(d, set()).update(range(a, b))
    return gone


def test_sentence_spans_against_loops(spark):
    """At the registered settings: repeated passages of many lengths, inside and across sentences, also in one text."""
    rng = np.random.default_rng(8)

    def words(n):
        return [f"{rng.choice(list('abcdefgh'))}{rng.integers(0, 300)}" + (rng.choice([".", "!", ",", ""], p=[.1, .02, .1, .78]))
                for _ in range(n)]

    shared = [words(int(n)) for n in rng.integers(15, 90, 12)]
    rows = []
    for d in range(40):
        own = words(int(rng.integers(10, 120)))
        for k in rng.integers(0, 12, int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(own) + 1))
            a = int(rng.integers(0, 10))
            own[at:at] = [w.upper() if rng.random() < 0.1 else w for w in shared[k][a:]]
        rows.append((d, "".join(w + rng.choice([" ", "  ", "\n"], p=[.9, .05, .05]) for w in own)))
    want = brute_removed(rows)
    got = {}
    for r in sentence_spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.char_start, r.char_end))
    assert got == want and len(want) > 5


def test_sentence_spans(spark, odd_documents):
    alone = " ".join(f"alpha{i}" for i in range(70)) + "."             # one passage without marks inside
    marked = " ".join(f"beta{i}" + ("." if i % 11 == 10 else "") for i in range(66)) + "."
    unique = [" ".join(f"u{d}x{i}" + ("." if i % 8 == 7 else "") for i in range(80)) + "." for d in range(6)]
    rows = [(1, unique[0]), (2, unique[1][:200] + " " + marked + " " + unique[1][200:]), (3, unique[2] + " " + marked.upper()),
            (4, unique[3] + " " + alone), (5, alone + "  " + unique[4]), (6, unique[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sentence_spans.repeated_spans(docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in spans} == {(3, 2), (5, 4)}
    clean = {r.doc_id: r.text for r in sentence_spans.remove_repeats(docs).collect()}
    assert all(clean[d] == t for d, t in rows if d not in (3, 5))
    assert clean[3].startswith(unique[2]) and len(clean[3].split()) < 100
    assert clean[5].endswith(unique[4]) and len(clean[5].split()) < 105
    odd = sentence_spans.remove_repeats(odd_documents)
    assert odd.columns == odd_documents.columns and odd.count() == odd_documents.count()
    assert {r.doc_id: r.text for r in odd.collect()}[2] == ""


def test_spans_of_hot_and_of_rare_keys(spark):
    """A passage of 50 documents (hot: over a thousandth of all spans) and one of two documents, among many spans."""
    def passage(name):
        return " ".join(f"{name}{i}" + ("." if i % 11 == 10 else "") for i in range(44))

    own = ["".join(f"w{d}x{s}x{i}" + (". " if i == 7 else " ") for s in range(120) for i in range(8)) for d in range(40)]
    rows = [(d, t) for d, t in enumerate(own)] + [(100 + d, passage("hot") + f" Own{d} end.") for d in range(50)]
    rows += [(200, passage("rare")), (201, f"Other{1} start. " + passage("rare"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = sentence_spans.document_spans(docs.selectExpr("doc_id", "0L as text_id", "text")).count()
    assert 2 * 1000 < n < 50 * 1000
    found = {(r.doc_id, r.first_doc_id) for r in sentence_spans.repeated_spans(docs).collect()}
    assert found == {(100 + d, 100) for d in range(1, 50)} | {(201, 200)}


def test_merge_dropout(odd_documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.model_path())
    plain = merge_dropout.Encoder(merge_dropout.model_path(), 0.0, 1, 1)
    varied = merge_dropout.Encoder(merge_dropout.model_path(), 0.3, 1, 4)
    back = merge_dropout.Decoder(plain.model)
    texts = [t for _, t in sorted_rows(odd_documents) if t] + ["  a  b ", "x" * 400, "\0a", "😀 tea"]
    for t in texts:
        assert back.text(plain.ids(t, 0)) == t and back.text(varied.ids(t, 2)) == t
        if "▁" not in t:
            assert np.frombuffer(plain.ids(t, 0), "<u4").tolist() == sp.encode(t)
    long = texts[0]
    assert len({varied.ids(long, v) for v in range(4)}) == 4          # variants differ, one variant repeats itself
    assert varied.ids(long, 1) == merge_dropout.Encoder(merge_dropout.model_path(), 0.3, 1, 4).ids(long, 1)
    part = list("▁unbelievable")
    model = plain.model
    assert [s for s in model._merge_long(part[:], 99, 0.3) if s] == model._merge_short(part[:], 99, 0.3)
    rows = {r.doc_id: r for r in merge_dropout.round_trip(odd_documents).collect()}
    for d, t in sorted_rows(odd_documents):
        assert rows[d].text_sha256 == (None if t is None else hashlib.sha256(t.encode()).hexdigest())
    assert rows[5].n_tokens == 0 and rows[4].n_tokens is None


@pytest.mark.parametrize("marks", [True, False])
def test_spans_of_excerpts_at_random_places(marks):
    """An excerpt of 51 words, cut out and put in at random word places, always shares a span with its source."""
    rng = np.random.default_rng(11)

    def words(n, name):
        return [f"{name}{rng.integers(0, 400)}" + ("." if marks and rng.random() < 0.1 else "") for _ in range(n)]

    for k in range(400):
        source = words(200, "s")
        at, a, b = int(rng.integers(0, 150)), int(rng.integers(0, 60)), int(rng.integers(0, 60))
        excerpt = source[at:at + 51]
        hosts = [words(60, f"h{k}x"), words(60, f"i{k}x")]
        texts = [" ".join(h[:p] + excerpt + h[p:]) for h, p in zip(hosts, (a, b), strict=True)]
        keys, text, begin, end = sentence_spans.text_spans(texts)
        assert set(keys[text == 0].tolist()) & set(keys[text == 1].tolist())
        alone = sentence_spans.text_spans(texts[1:])   # the same spans whatever texts come before
        assert all((x[text == 1] == y).all() for x, y in zip((keys, begin, end), (alone[0], *alone[2:]), strict=True))


def test_repeated_sentences_go_to_their_last_word(spark):
    """Nothing of a passage of whole sentences stays in later copies, also not a tail of under 20 words."""
    rng = np.random.default_rng(12)
    rows, own = [], {}
    for k in range(60):
        sizes = [20, 20, 6, 5] if k == 0 else rng.integers(1, 25, int(rng.integers(4, 9))).tolist()
        passage = " ".join(" ".join(f"p{k}x{i}x{rng.integers(0, 99)}" for i in range(n)) + "." for i, n in enumerate(sizes))
        if sum(sizes) < 20:
            continue
        for d in range(3):
            before, after = (" ".join(f"{x}{d}x{k}x{i}" for i in range(30)) + "." for x in "ba")
            rows.append((10 * k + d, f"{before} {passage} {after}"))
            own[10 * k + d] = rows[-1][1] if d == 0 else f"{before} {after}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in sentence_spans.remove_repeats(docs).collect()} == own


def test_short_equal_lines_go(spark):
    """Lines of one or two words, and lines without spaces, stay only where they stand first."""
    rows = [(1, "Les.\nAnd so.\n我们在这里写了很长的一行文字\n\nmine"), (2, "And so.\n我们在这里写了很长的一行文字\n\n \nLes. \nyours"),
            (3, "Les.\nLes.\nown line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert clean == {1: rows[0][1], 2: "\n \nLes. \nyours", 3: "own line"}
