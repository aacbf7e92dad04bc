"""Operators that run Python in tasks, against brute force, round trips and held-out rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from appcensus.llm import ngram_join, quality_model, secret_scan, token_planes, toxicity, tree_bpe, words
from appcensus.llm.bpe import Encoder, default_vocabulary
from appcensus.llm.components import components
from appcensus.llm.tables import new_path
from tests.llm import cases

pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = contract.FLAGSHIP_DATA


@pytest.fixture(scope="module")
def encoder():
    return Encoder.of(default_vocabulary())


# N-gram join


def shingle_set(text, width):
    found = WORD.findall((text or "").translate(FOLD))
    if len(found) < width:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[k : k + width]) for k in range(len(found) - width + 1))


def joined(rows, width, percent):
    """Row number to (size, component's smallest id, links)."""
    sets = [shingle_set(text, width) for _, text in rows]
    root, links = list(range(len(rows))), Counter()

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        t = top(k)
        known = [x for x in (least.get(t), doc_id) if x is not None]
        least[t] = min(known) if known else None
    return Counter(
        (rows[k][0], len(sets[k]), least[top(k)] if sets[k] else rows[k][0], links[k])
        for k in range(len(rows))
    )


def families(seed):
    """Families of near copies, some of them on the edge of the threshold."""
    rng = random.Random(seed)
    out = []
    for size in (3, 9, 10, 12, 25, 60, 130, 300, 600):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for copy in range(14):
            mine = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 60), max(1, size // 25)])):
                mine[rng.randrange(len(mine))] = f"v{rng.randrange(30)}"
            if rng.random() < 0.3:
                mine = mine[: rng.randrange(len(mine) * 9 // 10, len(mine) + 1)]
            out.append((len(out) + 100, " ".join(mine)))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)  # groups of several blocks
    rows = families(width) + [(r[0], r[1]) for r in cases.rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.ngram_join(df, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == joined(rows, width, percent)


def test_ngram_join_light_sets(spark, monkeypatch):
    # A list scan that costs a lot makes sets light, so that subsets find the candidates.
    monkeypatch.setattr(ngram_join, "SCAN_COST", 100.0)
    rows = families(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(df, 3, 90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == joined(rows, 3, 90)
    assert ngram_join.light_limit([(10, 5, 2, 1000), (100, 50, 20, 10)], 90) >= 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not here")
def test_boundary_lies_inside_the_sizes(spark, monkeypatch):
    """With the shipped cost, documents have light sets, whose 2-subsets are enumerated."""
    seen, real = [], ngram_join.light_limit
    monkeypatch.setattr(ngram_join, "light_limit", lambda h, p: seen.append((real(h, p), h)) or seen[-1][0])
    first = ngram_join._first_shared(
        ngram_join._shingled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 3, 90, "doc_id", "text"), 90
    )
    first = ngram_join.written(first, "first-tokens")
    lists = ngram_join._lists(first, 90)
    limit, histogram = seen[0]
    assert min(row[0] for row in histogram) < limit < max(row[0] for row in histogram)
    tokens = first.select(F.col("token").alias("key")).distinct()
    assert lists.join(tokens, "key", "left_anti").count() > 0 < lists.join(tokens, "key", "left_semi").count()


def test_ngram_join_keeps_one(spark):
    df = cases.frame(spark, clashes=True)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 3, 4, 9} & set(ids) and {5, 6, 7, 8, 10, 13, 14} <= set(ids)
    assert ngram_join.ngram_join(cases.empty(spark)).count() == 0


def test_ngram_join_keeps_one_row_of_equal_ids(spark):
    base = " ".join(f"w{k}" for k in range(80))
    near = base + " more"
    other, free = (" ".join(f"{letter}{k}" for k in range(40)) for letter in "uz")
    rows = [(3, base)] * 5 + [(3, near), (4, base), (None, base), (3, other)]
    rows += [(None, free)] * 3 + [(None, free + " x"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()]
    assert sum(t in (base, near) for _, t in got) == 1 and (4, base) not in got
    assert (3, other) in got and {(5, ""), (6, None)} <= set(got)
    # All ids of this component are null.
    assert sum(t in (free, free + " x") for _, t in got) == 1 and len(got) == 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)]
    root = {k: k for e in edges for k in e}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {k for a, b in edges if a != b for k in (a, b)}
    assert got == {k: top(k) for k in linked}


def test_word_hashes_of_long_texts(monkeypatch):
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    texts = ["", "a", "one two  three\tfour" * 30, "y" * 500 + " z", " lead", "trail "]
    data, offsets = words.text_bytes(pa.array(texts))
    hashes, counts = words.word_hashes(data, offsets)
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert len({(h, w) for h, w in zip(hashes.tolist(), flat)}) == len(set(flat))


# BPE


ALPHABET = ["a", "b", "e", "th", "in", " ", "  ", "\n", " \n", "\t", "'s", "'", "!", "..", "é", "ß", "漢", "字",
            "🙂", "1", "23", "<|endoftext|>", "<|endo", " ", " ", "\x1c", "᠎", "the", "\r\n"]


def test_tree_encoding_equals_the_library(encoder):
    rng = random.Random(5)
    for _ in range(500):
        part = rng.sample(ALPHABET, rng.choice([1, 2, 3, 6, len(ALPHABET)]))
        text = "".join(rng.choice(part) for _ in range(rng.choice([0, 1, 3, 10, 40, 200, 600])))
        expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(pa.array([text, None]))[0].tolist() == expected
        assert next(tree_bpe.encode_texts(encoder, [text], rng.choice([1, 2, 5, 16, 64]))).tolist() == expected


def test_memo_is_bounded(monkeypatch):
    small = Encoder(default_vocabulary())
    monkeypatch.setattr("appcensus.llm.bpe.MEMO_PIECES", 50)
    rng = random.Random(2)
    for _ in range(20):
        text = cases.prose(rng, 60)
        assert small.encode(pa.array([text]))[0].tolist() == small.whole(text).tolist()
    assert len(small.seen) < 300


def library(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("spread,leaf", [(1 << 16, 4096), (700, 90)])
def test_round_trip(spark, encoder, spread, leaf):
    df = cases.frame(spark, clashes=True)
    got = tree_bpe.round_trip(df, default_vocabulary(), spread_chars=spread, leaf_chars=leaf)
    expected = Counter((r[0], *library(r[1], encoder.tokenizer)) for r in cases.rows())
    assert Counter(map(tuple, got.collect())) == expected
    assert tree_bpe.round_trip(cases.empty(spark), default_vocabulary()).count() == 0


@pytest.mark.parametrize("kind", [token_planes.BYTES, token_planes.BITS])
def test_token_files(spark, encoder, kind):
    df = cases.frame(spark, clashes=True)
    files = token_planes.TokenFiles(spark, new_path(spark, "tokens"))
    files.write(df, default_vocabulary(), kind=kind, chunk_ids=500)
    start, expected = 0, Counter()
    nulls_first = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = files.read().collect()
    assert sum(r.n_tokens for r in got) == files.index().agg(F.sum("n_ids")).first()[0]
    for doc_id, text, *_ in nulls_first:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        if doc_id is not None:
            expected[doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == expected
    assert sum(r.doc_id is None for r in got) == 2
    bare = token_planes.TokenFiles(spark, new_path(spark, "tokens"))
    bare.write(cases.empty(spark), default_vocabulary())
    assert bare.read().count() == 0


@pytest.mark.parametrize("kind", [token_planes.BYTES, token_planes.BITS])
@pytest.mark.parametrize("count", [0, 1, 7, 16_384, 40_000])
def test_planes_round_trip(kind, count):
    ids = np.random.default_rng(count).integers(0, 2**32, count, dtype=np.uint32)
    chunk = token_planes.pack(ids, kind=kind)
    assert (token_planes.unpack(chunk) == ids).all()
    if count > 16_384:
        assert (token_planes.unpack(chunk, range(1, 2)) == ids[16_384:32_768]).all()
    with pytest.raises(ValueError):
        token_planes.unpack(b"NOPE" + chunk[4:])


# Secrets


def test_trigram_queries():
    queries = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert queries["hex"] is None and queries["access"] == {frozenset([b"aki", b"kia"])}
    assert secret_scan.trigram_query("a?b*c") is None
    assert secret_scan.trigram_query("(abc|x)yz") == {frozenset([b"abc", b"bcy", b"cyz"]), frozenset([b"xyz"])}
    assert secret_scan.trigram_query("(abcd)+[0-9]xyz") == {frozenset([b"abc", b"bcd", b"xyz"])}


def random_expression(rng, depth=3):
    kind = rng.randrange(8 if depth else 3)
    if kind < 2:
        return "".join(rng.choice("abcX") for _ in range(rng.randrange(1, 5)))
    if kind == 2:
        return rng.choice(["[^x]", ".", "[ab]", "[a-c]", "[A-Z0-9]", "\\d", "(?i:aB)", "^", "$", "\\b", "(?=a)", "(?!b)"])
    if kind < 5:
        return "".join(random_expression(rng, depth - 1) for _ in range(rng.randrange(2, 4)))
    if kind < 7:
        return "(?:" + "|".join(random_expression(rng, depth - 1) for _ in range(rng.randrange(2, 4))) + ")"
    inner = random_expression(rng, depth - 1)
    inner = f"(?:{inner})" if not inner.startswith("(?=") and not inner.startswith("(?!") else "(?:a|b)"
    return inner + rng.choice(["?", "*", "+", "{2}", "{2,3}", "{0,2}", "{9}", "+?", "{1,}", "{0}"])


def test_trigram_queries_miss_nothing():
    rng = random.Random(6)
    texts = ["foo-barend", "-abc-abc", "", "abcabc", "quxend fooquxend"]
    texts += ["".join(rng.choice("abcABCXx1-") for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(["abc", "ab", "bc", "aB", "X", "ca", "x"]) for _ in range(12)) for _ in range(500)]
    column = pa.array(texts)
    data, offsets = words.text_bytes(column)
    patterns = [r"foo(?:[^x]bar|qux)end", r"(?:[^x]abc){2}", r"(?:a|bcab)+c", "(?:abc){9}", "(?:abc|)X(?:ab|)c"]
    patterns += [random_expression(rng) for _ in range(600)]
    narrowed = 0
    for pattern in patterns:
        rule = secret_scan.Rule("r", pattern)
        query = secret_scan.trigram_query(pattern)
        segment = secret_scan.Segment(data, offsets, secret_scan.wanted_trigrams([query]))
        found = set(segment.candidates(query).tolist())
        narrowed += query is not None
        assert {k for k, text in enumerate(texts) if rule.spans(text)} <= found, pattern
    assert narrowed > 100


def test_secret_scan(spark):
    secrets = [
        "api_key: 'abcdefgh1'", "API-KEY=abcdefgh", "Token = short", 'secret":"0123456789abcdef"',
        "password=password=12345678", "AKIA1234", "AKIAABCDEFGHIJKL", "é" * 5 + "passwd: aaaaaaaa",
        "f" * 32, "F" * 40, "0123456789abcdef" * 2 + "g", "ghp_" + "a1" * 18, "xoxb-1234567890-abc",
        "-----BEGIN RSA PRIVATE KEY-----", "paſſwd=aaaaaaaaaa", "to\nken=aaaaaaaaaa", "tok en",
    ]
    texts = [r[1] for r in cases.rows()] + secrets + ["\n".join(secrets), "x".join(secrets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    for k, text in enumerate(texts):
        spans = [(a, n, b) for n, rule in enumerate(secret_scan.RULES) for a, b in rule.spans(text or "")]
        shown = lambda some: ",".join(f"{secret_scan.RULES[n].kind}:{a}:{b}" for a, n, b in sorted(some))
        base = [s for s in spans if s[1] < 3]
        assert got[k].spans == shown(spans)
        assert got[k].base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(
            sum(s[1] == n for s in base) for n in range(3)
        )
    assert secret_scan.scan(cases.frame(spark, clashes=True)).count() == len(cases.rows())
    assert secret_scan.scan(cases.empty(spark)).count() == 0
    assert any("forge" in r.spans for r in got.values()) and any("private_key" in r.spans for r in got.values())


# Models


def test_boosted_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    forest = quality_model.fit(x[:2_000], y[:2_000])
    assert ((forest.score(x[2_000:]) > 0.5) == y[2_000:]).mean() > 0.93
    # The arrays give what a walk node by node gives.
    for row in x[:20]:
        total = forest.base
        for feature, limit, value in zip(forest.feature, forest.limit, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > limit[node])
            total += value[node - len(feature)]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality_model.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert quality_model.fit(x[:9], np.ones(9)).score(x[:3]).min() > 0.99


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_quality_model_on_held_out_rows(spark):
    rows = quality_model.op2_quality_model(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    held = rows.filter("held_out").join(labels, "doc_id").filter("quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.8
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.collect())


def test_models_take_any_rows(spark):
    df = cases.frame(spark, clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (10, 0, 0), (13, None, None), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")
    held = F.col("doc_id") == 4
    for labels in (none, some):
        forest = quality_model.train(df, labels, ~held)
        got = quality_model.classify(df, forest, held).collect()
        assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)
        lexicon = toxicity.train(df, labels, ~held)
        got = toxicity.classify(df, lexicon, held).collect()
        assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(cases.empty(spark), forest, held).count() == 0
    assert toxicity.classify(cases.empty(spark), lexicon, held).count() == 0


def distance_to_prefix(stem, word):
    """Fewest edits from ``stem`` to any beginning of ``word``."""
    row = list(range(len(stem) + 1))
    best = [row[-1]]
    for k, letter in enumerate(word, 1):
        row = _next_row(row, stem, letter, k)
        best.append(row[-1])
    return min(best)


def _next_row(row, stem, letter, k):
    out = [k]
    for j, other in enumerate(stem, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (other != letter)))
    return out


def test_statistics_of_a_text_one_by_one():
    def share(part, whole):
        return part / max(whole, 1)

    def by_hand(text):
        raw = (text or "").encode()
        found = WORD.findall((text or "").translate(FOLD))
        size, n = len(raw), len(found)
        stops = set(quality_model.STOP_WORDS)
        among = lambda characters: share(sum(b in characters for b in raw), size)
        pairs = len(set(zip(found, found[1:]))) + 1 if found else 0
        return [
            np.log1p(size), np.log1p(n), share(size, n),
            among(b"#*$%&<>"), among(b"|"), among(b"!"), among(bytes(range(65, 91))), among(b"0123456789"),
            among(b"\n"), among(bytes(range(128, 256))), share(len(set(found)), n),
            share(max(Counter(found).values(), default=0), n),
            share(sum(a == b for a, b in zip(found, found[1:])), n),
            share(sum(w in stops for w in found), n), share(pairs, n),
        ]

    rng = random.Random(12)
    bits = ["the", "The", "für", "a|b", "#1", "!!", "x" * 40, "42", "\n", " ", "\t", "dog", "dog", "é", "\u3000"]
    texts = [None, "", " ", "one", "dog dog dog", "the The THE"]
    texts += [rng.choice(["", " "]).join(rng.choices(bits, k=rng.randrange(60))) for _ in range(200)]
    texts.append("the dog " * 30_000)
    got = quality_model.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality_model.FEATURES))
    assert np.allclose(got, [by_hand(t) for t in texts], atol=1e-12)


def test_levenshtein_automaton():
    stems = ["idiot", "moron", "worthless", "scum", "idle"]
    automaton = toxicity.Automaton(stems)
    rng = random.Random(8)
    for _ in range(3_000):
        word = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "o", "i", "xy"])
        word = "".join(word)
        near = {}
        for n, stem in enumerate(stems):
            edits = distance_to_prefix(stem, word)
            if len(stem) == 4:
                short = len(word) == 4 and word[0] == stem[0]
            else:
                short = len(word) <= len(stem) + 2
            if edits <= (2 if len(stem) > 8 else 1) and (short or edits == 0):
                near[n] = edits
        found = automaton.match(word)
        assert (found is None) == (not near), word
        if found:
            assert found[1] == min(near.values()) == near[found[0]], word


def test_context_of_matches():
    lexicon = toxicity.Lexicon(["idiot"], np.array([[5.0, 3.0]]), middle=2.5, slope=1.6)
    texts = ["you idiot", "an idiot", "an idiots", "an idoit", "an idxiot", "they said idiot to him",
             'the so called "idiot" box', "« idiot » est un mot", None, "", "clean words only"]
    total = dict(zip(texts, toxicity.totals(pa.array(texts), lexicon)))
    assert total["you idiot"] > total["an idiot"] == total["an idiots"] == 5
    assert total["an idxiot"] == 3
    assert total["they said idiot to him"] == total['the so called "idiot" box'] == 1.5
    assert total["« idiot » est un mot"] == 1.5
    assert total[None] == total[""] == total["clean words only"] == 0
    assert lexicon.score(np.array([5.0]))[0] > 0.5 > lexicon.score(np.array([1.5]))[0]


def test_lexicon_is_learned(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(200):
        text, toxic = cases.prose(rng, 40), k % 4 == 0
        if toxic:
            at = rng.randrange(len(text))
            text = text[:at] + f" grumbo{rng.choice(['ist', 'en', 'x'])} " + text[at:]
        rows.append((k, text))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 0
    lexicon = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held)
    assert lexicon.stems == ["grumbo"]
    got = {r.doc_id: r.predicted for r in toxicity.classify(df, lexicon, held).filter("held_out").collect()}
    assert got == {k: int(k % 4 == 0) for k in range(0, 200, 5)}


def test_terms_glued_to_others():
    lexicon = toxicity.Lexicon(["idiot", "scum"], np.array([[5.0, 3.0], [5.0, 3.0]]), middle=2.5, slope=1.6)
    texts = ["you/idiot", "total-idiot", "non-idiot", "*idiot*", "_idiot_", "a(scum)b", "x-idoit", "idol", "plain-words"]
    hits = [[(s, e) for s, e, _, _ in found] for found in toxicity.matches(pa.array(texts), lexicon)]
    assert hits[:6] == [[(0, 0)]] * 5 + [[(1, 0)]] and hits[7:] == [[], []]


def test_samples_have_one_row_per_id(spark):
    rows = [(1, f"idiot text {k}") for k in range(300)] + [(2, f"fine text {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)] * 4 + [(2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality_model.fit
    try:
        quality_model.fit = lambda x, y: seen.append(len(y)) or real(x, y)
        quality_model.train(df, labels, F.lit(True))
    finally:
        quality_model.fit = real
    assert seen == [2]
    totals = []
    middle = toxicity._middle
    try:
        toxicity._middle = lambda total, toxic: totals.append(len(total)) or middle(total, toxic)
        toxicity.train(df, labels, F.lit(True))
    finally:
        toxicity._middle = middle
    assert totals and totals[0] <= 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op7_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").filter("toxic is not null")
    found = rows.collect()
    assert len(found) > 20 and np.mean([r.predicted == r.toxic for r in found]) > 0.95


def test_long_texts_are_cut_once(spark, encoder):
    rng = random.Random(12)
    long = cases.prose(rng, 3_000)
    df = spark.createDataFrame([(1, long)] * 5 + [(1, long + "x"), (None, long), (2, "short")], "doc_id long, text string")
    got = tree_bpe.round_trip(df.repartition(3), default_vocabulary(), spread_chars=1_000, leaf_chars=300).collect()
    whole = encoder.tokenizer.encode(long, add_special_tokens=False).ids
    assert Counter(r.doc_id for r in got) == {1: 6, None: 1, 2: 1}
    assert Counter(r.n_tokens for r in got)[len(whole)] >= 6
    digest = hashlib.sha256(",".join(map(str, whole)).encode()).hexdigest()
    assert sum(r.ids_sha256 == digest for r in got) == 6
