"""Each operator against a brute-force version, on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontamination, language_gru, licenses, minhash, quality_gam, quality_rules, queries, sharding, suffix_dedup, url_filters
from gridloom.llm import sentencepiece_unigram as sp

WORDS = "the of and license mit apache general public permission hereby granted data stone river éclair naïve 火 x1".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) * rng.randint(0, 1) for _ in range(n))


def odd_texts():
    rng = random.Random(8)
    base, long = prose(rng, 120), prose(rng, 9000)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", " \n\t ", "one", "four words are here", base, base, " ".join(near), base.upper(), long, long + " tail", "ab " * 300, "a" * 250, "a" * 250,
        "Released under the MIT License. MIT LICENSE and the mit-license", "Licensed under the Apache License, Version 2.0.", "ünïcödé 火火火 😀 " * 40, "line\nline\nline\n\n" + base[:200],
    ]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(k, t, "en" if k % 2 else "fr", "src0", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None), rows[5], (3, "another text for id three", "en", "s", 1)]
    clash = {c: F.lit(c) for c in ("words", "h", "score", "row", "spans", "doc", "tie", "node", "key", "_text", "seg", "pos", "seed", "predicted", "kept", "v", "codes")}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def in_sql(spark, tmp_path, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def same(df, columns, rows, digits=9):
    cell = lambda v: f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == sorted(tuple(cell(v) for _, v in sorted(zip(columns, r))) for r in rows)


def test_licenses(spark, odd, none, tmp_path):
    df = licenses.scan_licenses(odd)
    same(df, *in_sql(spark, tmp_path, licenses.oracle_sql(), documents=odd.select("doc_id", "text")))
    for r in df.collect():
        if r.doc_id is not None and r.doc_id != 3:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(odd_texts()[r.doc_id]))
            places = [i for i in range(len(w)) for p in (["mit", "license"], ["apache", "license"], ["general", "public", "license"]) if w[i : i + len(p)] == p]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None)) and 0 <= r.score <= 1
    assert {r.labels for r in df.where("doc_id = 14").collect()} == {"mit,mit-notice"} and licenses.scan_licenses(none).count() == 0


def test_licenses_where_their_words_are_frequent(spark):
    hot = "distributed under the gnu general public license version 3"
    rng, texts = random.Random(31), [hot] * 40 + ["work", "this is licensed"] * 4
    for t in licenses.TEMPLATES:
        for _ in range(20):  # as many words changed as verification lets pass, or one more
            w = t.words
            for j in rng.sample(range(len(w)), min(len(w), rng.randint(0, t.spare + 1))):
                w[j] = "x"
            texts.append(" ".join(["see", *w, "end", *" ".join(t.keys).split()]))

    def best(w, words):
        return max((sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(words)), s) for s in range(-len(words), len(w)))

    def expected(text):
        w, shares = text.split(), {}
        for t in licenses.TEMPLATES:
            if not all(f" {k} " in f" {text} " for k in t.keys):
                continue
            if t.is_long:
                begins = []
                for p in t.parts(0):
                    for s in range(-len(p.words), len(w)):
                        if sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(p.words)) / len(p.words) >= p.share:
                            begins.append(s - p.offset)
                n = max((sum(x <= y <= x + licenses.DRIFT for y in begins) for x in begins), default=0)
                if n >= t.needed:
                    shares[t.label] = min(n, len(t.parts(0))) / len(t.parts(0))
            else:
                found = best(w, t.words)[0] / len(t.words)
                shares |= {t.label: found} if found >= t.share else {}
        return ",".join(sorted(shares)), max(shares.values(), default=0.0)

    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert expected(hot)[0] == "gpl,gpl-3.0"
    assert {r.doc_id: (r.labels, r.score) for r in rows} == {k: expected(t) for k, t in enumerate(texts)}


def test_whole_licenses_with_changed_words(spark):
    rng, texts, labels = random.Random(2), [], []
    long = [t for t in licenses.TEMPLATES if t.is_long]
    assert len(long) >= 12 and all(len(licenses.Part(0, 0, p.words, p.share).words) >= 8 for t in long for p in t.parts(0))
    for t in long:
        words = t.words
        plain = t.text
        added = words[:]  # words are added, left out and changed, and a line of stars stands before each line
        for _ in range(3):
            added.insert(rng.randrange(len(added)), "really")
        del added[rng.randrange(len(added))]
        texts += [f"Copyright 2020 Somebody.\n * {plain}\n\nint main() {{}}", "x " * 300 + " ".join(added) + " y" * 40, " ".join(words[: len(words) // 4])]
        labels += [True, all(f" {k} " in f" {' '.join(added)} " for k in t.keys), False]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.labels.split(",") for r in rows}
    for k, (text, wanted) in enumerate(zip(texts, labels)):
        if not (k % 3 == 1 and len(long[k // 3].words) < 60):  # three changes are too many for a short notice
            assert (long[k // 3].label in found[k]) == wanted, (long[k // 3].label, k % 3, found[k])


def test_quality_gam(spark, odd, none):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 0.8)).astype(float)
    model = quality_gam.fit_gam(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93 and (0, 1) in model.pairs
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (4, None, 0), (99, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    trained = quality_gam.train_quality(odd, labels)
    rows = quality_gam.score_quality(odd, trained).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    def figures(t):
        w = (t or "").split()
        if not w:
            return [0.0] * 15
        n, lines = len(w), [x for x in t.split("\n") if x]
        same = sum(w[i] == w[i + 1] for i in range(n - 1))
        return [
            np.log(n), sum(len(x) for x in w) / n, sum(c in quality_gam.SYMBOLS for c in t) / n, sum(x.isupper() for x in w) / n, sum(c == "!" for c in t) / n, sum(c == "|" for c in t) / n,
            sum(c == "." for c in t) / n, sum(c in "0123456789" for c in t) / len(t), len(lines) / n, len(set(w)) / n, max(w.count(x) for x in set(w)) / n, same / n,
            sum(x.istitle() for x in w) / n, 1 - len(set(lines)) / max(1, len(lines)), np.log(max(len(x) for x in w)),
        ]

    def scored(t):  # bin by bin
        x = figures(t)
        z = trained.bias + sum(table[sum(e < v for e in edges)] for table, edges, v in zip(trained.tables, trained.edges, x))
        rough = [sum(e < v for e in edges) for edges, v in zip(trained.coarse, x)]
        z += sum(table[rough[i], rough[j]] for (i, j), table in trained.pairs.items())
        return 1 / (1 + np.exp(-z))

    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            assert quality_gam.text_features(odd_texts()[r.doc_id]) == pytest.approx(figures(odd_texts()[r.doc_id])) and r.score == pytest.approx(scored(odd_texts()[r.doc_id]))
    empty = quality_gam.train_quality(none, labels)
    assert {r.score for r in quality_gam.score_quality(odd, empty).collect()} == {0.5} and quality_gam.score_quality(none, trained).count() == 0


def test_decontamination(spark, odd, none, tmp_path):
    rng = random.Random(3)
    item = prose(rng, 40).split()
    leak = item[:]
    leak[5] = leak[20] = "swapped"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, prose(rng, 30)), (3, "too short"), (4, None), (5, ""), (1, " ".join(item))], "item_id long, text string")
    extra = spark.createDataFrame([(100, "Intro. " + " ".join(leak).upper() + " end", *["x"] * 2, 1), (101, prose(rng, 60), "x", "x", 1), (102, " ".join(item[:9]), "x", "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    found = decontamination.find_contamination(docs, bench)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(100, 1)]
    shuffled = decontamination.find_contamination(docs, bench, broadcast_seeds=0)
    columns, rows = in_sql(spark, tmp_path, decontamination.oracle_sql(), documents=docs.select("doc_id", "text"), benchmark=bench.distinct())
    same(found, columns, rows)
    same(shuffled, columns, rows)
    left = decontamination.decontaminate(docs, bench)
    assert left.count() == docs.count() - 1 and left.columns == docs.columns and left.where("doc_id IS NULL").count() == 1
    mixed = spark.createDataFrame([(7, " ".join(leak)), (7, "a clean text"), (None, " ".join(item)), (None, "clean")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_id", "_row", "row", "seed", "laid", "under")})
    assert [(r.doc_id, r.text) for r in decontamination.decontaminate(mixed, bench).orderBy("text").collect()] == [(7, "a clean text"), (None, "clean")]
    assert decontamination.find_contamination(docs, bench.where("1 = 0")).count() == 0 and decontamination.find_contamination(none, bench).count() == 0


def test_decontamination_of_short_items(spark):
    rng = random.Random(21)
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in range(1, 16)}
    docs = []

    def add(words):
        docs.append([f"f{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 6))] + words + [f"g{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 6))])

    for n, item in items.items():
        add(item)
        for a in range(n):
            for b in range(a, n):
                add(["x" if j in (a, b) else w for j, w in enumerate(item)])
        add(["x" if j in (0, n // 2, n - 1) else w for j, w in enumerate(item)])

    def overlaps(doc, item):  # every diagonal, without seeds
        width = min(13, len(item))
        most = width if width < 9 else width - 2
        same = lambda d: [0 <= j + d < len(doc) and doc[j + d] == w for j, w in enumerate(item)]
        return any(sum(s[k : k + width]) >= most for s in map(same, range(-len(item), len(doc))) for k in range(len(item) - width + 1))

    want = {(d, n) for d, doc in enumerate(docs) for n, item in items.items() if overlaps(doc, item)}
    df = spark.createDataFrame([(d, " ".join(doc)) for d, doc in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    for limit in (decontamination.BROADCAST_SEEDS, 0):
        assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(df, bench, broadcast_seeds=limit).collect()} == want


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(docs):
    sets, parent = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_near_duplicates(spark, odd, none):
    rng = random.Random(12)
    docs = list(enumerate(odd_texts()))
    for family in range(6):  # chains and stars of edits around the threshold
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(14):
            copy = words[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9)}"
            docs.append((len(docs), " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == groups(docs)
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(none).count() == 0


def test_words_with_equal_polynomial_hashes_are_not_linked(spark):
    word = "a"
    for _ in range(11):  # a Thue-Morse word and its complement: every polynomial hash modulo 2**64 gives them the same value
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([w] * 5) for w in (word, other)] + [f"one two {w} three four five" for w in (word, other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == {(k, True) for k in range(4)}
    a, b, _ = minhash.shingle_sets(df.toArrow().column("text").combine_chunks())
    assert len(set(a)) == len(set(b)) == 6


def test_links_are_confirmed_on_words(spark):
    rows = [(1, 2, 3, 3, 3), (1, 3, 3, 3, 3), (2, 3, 1, 3, 3)]  # hashes say that 1, 2 and 3 are the same
    pairs = spark.createDataFrame(rows[:2], "a long, b long, shared int, na int, nb int")
    sets = spark.createDataFrame([(1, "a b c d e f g"), (2, "A  b c\td e f g"), (3, "other words with the same hashes a b")], "node long, text string")
    assert [tuple(r) for r in minhash.linked(pairs, sets).collect()] == [(1, 2)]


def test_hamming_index_guarantee():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 16, (200, 40)).astype(np.uint16)
    other = sig.copy()
    for k in range(200):  # 15 differing positions always leave a chunk with one at most
        other[k, rng.choice(40, 15, replace=False)] ^= 1
    assert (minhash.chunk_keys(sig) == minhash.chunk_keys(other)).any(1).all()


def test_quality_rules(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(18)], "doc_id long, quality int, toxic int")
    model = quality_rules.train_rules(odd, labels)
    rows = quality_rules.apply_rules(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is None or r.doc_id == 3:
            continue
        t = odd_texts()[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = list(zip(w, w[1:], w[2:]))
        repeated = {x for x in grams if grams.count(x) > 1} if len(grams) < 500 else None
        if repeated is None:
            from collections import Counter

            repeated = {x for x, n in Counter(grams).items() if n > 1}
        inside = {i + k for i, g in enumerate(grams) if g in repeated for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)), r
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and r.kept == (not r.base_failed and r.score >= 0.5)
    def grams(t):  # one text by itself, n-gram by n-gram
        x = quality_rules.Texts.of([t])
        buckets = [int(h) % quality_rules.BUCKETS for h in x.words.tolist()]
        for i in range(len(x.words) - 1):
            h = 0
            for k in range(2):
                h = (h * 0x100000001B3 % (1 << 64)) ^ mixed((int(x.words[i + k]) + k) % (1 << 64))
            buckets.append(mixed(h) % quality_rules.BUCKETS)
        chars = [mixed(ord(t[i]) | ord(t[i + 1]) << 21 | (ord(t[i + 2]) << 42) % (1 << 64)) % quality_rules.BUCKETS for i in range(len(t) - 2)]
        return buckets, chars

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % (1 << 64)
        return x ^ (x >> 31)

    fitted = quality_rules.NgramModel(np.random.default_rng(1).normal(size=quality_rules.BUCKETS), np.random.default_rng(2).normal(size=quality_rules.BUCKETS), 0.3, 1.5, -0.2)
    batch = [t for t in odd_texts() if len(t or "") < 2000]
    for t, p in zip(batch, fitted.score(quality_rules.Texts.of(batch))):
        w, c = grams(t or "")
        z = 0.3 + (np.mean(fitted.words[w]) if w else 0.0) + (np.mean(fitted.chars[c]) if c else 0.0)
        assert p == pytest.approx(1 / (1 + np.exp(-(1.5 * z - 0.2))))
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))  # polynomial hashes take the two for one
    assert quality_rules.Texts.of([f"{word} x y {other} x y", f"{word} x y {word} x y", "", "x y"]).repeated_words().tolist() == [0, 6, 0, 0]
    assert quality_rules.apply_rules(none, quality_rules.train_rules(none, labels)).count() == 0
    rng = random.Random(5)
    good, bad = [prose(rng, 80) for _ in range(60)], [" ".join(f"{w}###" for w in prose(rng, 80).split()) for _ in range(60)]
    train = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    fitted = quality_rules.train_rules(train, spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)], "doc_id long, quality int, toxic int"))
    p = fitted.score(quality_rules.Texts.of([prose(rng, 80), " ".join(f"{w}###" for w in prose(rng, 80).split())]))
    assert p[0] > 0.8 and p[1] < 0.2


def test_long_units_without_spaces():
    rng = random.Random(7)
    tok = sp.UnigramTokenizer.of(list(enumerate([*PIECES, "aa", "aaa", "aaaa", "abab", "ba"], 300)), list(range(256)))
    for k in range(40):
        alphabet = ["ab", "thenadof", "aé火", "a", "▁h", "x"][k % 6]
        unit = " " + "".join(rng.choice(alphabet) for _ in range(rng.choice([2100, 2049, 3333, 5000])))
        if k % 5 == 0:
            unit = (unit[:7] * 900)[:4000]
        assert tok._long(np.frombuffer(unit.encode(), np.uint8)) == tok._short([unit.encode()])[0]
    text = "".join(rng.choice("thenadofé火") for _ in range(1_000_000))
    assert len(text.encode()) > 1 << 20 and tok.decode(tok.encode([text])[0]) == text.encode()


PIECES = ["▁", "t", "h", "e", "o", "f", "▁the", "▁t", "he", "▁of", "▁▁", "a", "n", "d", "▁and", "and", "é", "火", "or", "▁o"]


def best_score(tok, text):
    score = {tok.piece_bytes[i]: s for i, s in zip(tok.ids.tolist(), tok.scores.tolist())}
    s, unknown = " " + text, min(score.values()) - sp.UNKNOWN_PENALTY
    best = [0.0] + [-1e18] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 8) + 1):
            v = score.get(s[i:j].encode(), unknown if j == i + 1 else None)
            if v is not None:
                best[j] = max(best[j], best[i] + v)
    return best[-1]


def test_sentencepiece(spark, odd, none):
    tok = sp.UnigramTokenizer.of(list(enumerate(PIECES, 300)), list(range(256)))
    for k, key in enumerate(p.replace("▁", " ").encode() for p in PIECES):  # the trie holds what went in
        at = 0
        for c in key:
            nxt = int(tok.base[at]) + c
            assert tok.check[nxt] == at
            at = nxt
        assert tok.value[at] == k
    rng = random.Random(9)
    score = {tok.piece_bytes[i]: s for i, s in zip(tok.ids.tolist(), tok.scores.tolist())}
    unknown = min(score.values()) - sp.UNKNOWN_PENALTY
    for _ in range(300):
        text = "".join(rng.choice(["the", " ", "and", "o", "f", "é", "火", "▁", "\n", "z", "😀", "of", "  "]) for _ in range(rng.randint(1, 12)))
        ids = tok.encode([text])[0]
        assert tok.decode(ids) == text.encode()
        total, run = 0.0, b""
        for i in ids.tolist():
            if i >= 256:
                total += score[tok.piece_bytes[i]]
                continue
            run += bytes([i])
            try:
                run.decode()
            except UnicodeDecodeError:
                continue
            total, run = total + unknown, b""
        assert total == pytest.approx(best_score(tok, text)), text
    encoded = sp.encode_documents(odd, tok)
    assert encoded.columns == ["doc_id", "ids"]
    back = {(r.doc_id, r.text) for r in sp.decode_documents(encoded, tok).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()}
    digests = sp.token_digests(odd, tok).collect()
    assert all(r.round_trip for r in digests) and {r.n_pieces for r in digests if r.doc_id in (0, 1)} == {0} and sp.token_digests(none, tok).count() == 0
    with pytest.raises(ValueError):
        sp.encode_documents(odd.withColumn("ids", F.lit(1)), tok, ["doc_id", "ids"])
    r = next(r for r in digests if r.doc_id == 4)
    assert r.ids_crc32 == zlib.crc32(tok.encode(["four words are here"])[0].tobytes())


def removed(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(200):
        x = np.array([rng.randint(1, rng.choice([1, 2, 4, 200])) for _ in range(rng.randint(0, 60))], dtype=np.int64)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize(("block", "size", "crowd"), [(suffix_dedup.BLOCK, suffix_dedup.CLASS, suffix_dedup.CROWD), (1000, 1000, 0), (suffix_dedup.BLOCK, 5, 2), (1000, 0, 8)])
def test_suffix_dedup(spark, block, size, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(21)
    passage = prose(rng, 60)
    docs = list(enumerate(odd_texts()))
    docs += [(len(docs) + k, prose(rng, rng.randint(0, 40)) + " " + passage[rng.randint(0, 60) :] + " " + prose(rng, 30)) for k in range(25)]
    docs.append((len(docs), "zy" * 400 + passage + "zy" * 300))
    docs += [(len(docs) + k, f"{k} {passage[:140]} {k * 7}") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(df, block, size).collect()}
    assert got == removed(docs)


def test_suffix_dedup_of_very_long_texts(spark):
    rng = random.Random(5)
    long = prose(rng, 200_000)  # over 1 MiB, so read in pieces
    edge = suffix_dedup.PIECE - 150
    docs = [(1, long), (2, "x" + long[edge : edge + 400] + "y"), (3, prose(rng, 30) + long[-5000:]), (4, long[:3000] + "!" + long[700_000:700_300])]
    assert len(long) > 1 << 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(df).collect()}
    assert got == removed(docs)


def test_suffix_dedup_ties(spark):
    rng = random.Random(6)
    a, b = prose(rng, 50), prose(rng, 50)
    first, second = sorted([f"{a} {b}", f"{b} {a}"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    df = spark.createDataFrame([(1, first), (1, second), (1, second), (None, b), (2, a)], "doc_id long, text string")
    rows = {(r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df).collect()}
    left = [t for i, t in rows if i == 1]
    assert (None, b) in rows and (2, "") in rows and len(left) == 2 and sum(map(len, left)) < len(a) + 40


def test_suffix_dedup_odd_rows(spark, odd, none):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and suffix_dedup.remove_repeats(none).count() == 0
    rows = out.collect()
    base = odd_texts()[5]
    assert [r.text for r in rows if r.doc_id == 5] == [base, base]  # a repeated row is the same document
    assert [r.text for r in rows if r.doc_id == 6] == [""] and [r.text for r in rows if r.doc_id == 0] == [None] and {r.doc for r in rows} == {"doc"}


def test_sharding(spark, odd, none):
    rows = sharding.shard_documents(odd, [1.0] * 16, [1.0] * 17).collect()
    assert len(rows) == odd.count() and all(r.grown_shard in (r.shard, 16) for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    texts = {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == texts
    draw = lambda d, n: max(range(n), key=lambda s: (hashlib.md5(f"{'' if d is None else d}:{s}".encode()).hexdigest()[:12], -s))
    assert all((r.shard, r.grown_shard) == (draw(r.doc_id, 16), draw(r.doc_id, 17)) for r in rows)
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weighted = many.select(sharding.rendezvous_shard(F.col("doc_id"), [1, 0, 3]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in weighted}
    assert set(share) == {0, 2} and abs(share[2] - 0.75) < 0.02
    moved = many.select(sharding.rendezvous_shard(F.col("doc_id"), [1.0] * 16).alias("a"), sharding.rendezvous_shard(F.col("doc_id"), [1.0] * 17).alias("b")).where("a != b")
    assert abs(moved.count() / 20000 - 1 / 17) < 0.01 and moved.where("b != 16").count() == 0
    numbered = sharding.number_slots(many.withColumn("s", F.col("doc_id") % 3), "s", ["doc_id"], block_rows=500)
    assert numbered.groupBy("s").agg((F.max("slot") - F.count("*")).alias("x"), F.count_distinct("slot").alias("n"), F.count("*").alias("m")).where("x != -1 OR n != m").count() == 0
    hot = spark.range(3000).select(F.when(F.col("id") < 2500, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("s"), (F.col("id") % 2).alias("t"))
    again = sharding.number_slots(hot, "s", ["doc_id", "t"], block_rows=300).collect()
    assert sorted(r.slot for r in again) == list(range(3000)) and sum(r.doc_id == 1 for r in again) == 2500
    assert sharding.shard_documents(none, [1.0] * 16).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("doc_id"), [0.0])


def test_gru_gradients():
    rng = np.random.default_rng(1)
    windows, target = rng.integers(0, 256, (6, language_gru.STEPS)).astype(np.uint8), rng.integers(0, 3, 6)
    net = language_gru.fit_language_net(windows, target, ["a", "b", "c"], updates=3, batch=4)
    d = net.forward
    d.table, d.u = d.table.astype(np.float64), d.u.astype(np.float64)
    x, weight = np.ascontiguousarray(windows.T)[:7], rng.normal(size=(7, language_gru.HIDDEN, 6))
    loss = lambda: float((d.run(x)[0].astype(np.float64) * weight).sum())
    gt, gu = d.back(x, d.run(x, keep=True)[1], weight.astype(np.float32))
    for grad, param, at in ((gu, d.u, (0, 1)), (gu, d.u, (20, 3)), (gt, d.table, (int(x[3, 2]), 17)), (gt, d.table, (int(x[5, 0]), 2))):
        old, eps = param[at], 1e-2
        param[at] = old + eps
        up = loss()
        param[at] = old - eps
        down = loss()
        param[at] = old
        assert grad[at] == pytest.approx((up - down) / (2 * eps), abs=0.03)


def test_tiling_and_pooling():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (40, language_gru.STEPS)).astype(np.uint8)
    net = language_gru.fit_language_net(windows, rng.integers(0, 3, 40), ["a", "b", "c"], updates=2, batch=8)
    sigmoid = lambda x: np.clip(x, 0, 1)

    def states(d, x):
        h, out = np.zeros(language_gru.HIDDEN), []
        for byte in x:
            a, rec = d.table[byte].astype(float), d.u.astype(float) @ h
            z, r = np.split(sigmoid(a[:16] + rec[:16]), 2)
            c = np.tanh(a[16:] + r * rec[16:])
            h = z * h + (1 - z) * c
            out.append(h)
        return np.array(out)

    texts = [b"", bytes(rng.integers(0, 256, 1).astype(np.uint8)), bytes(rng.integers(0, 256, 64).astype(np.uint8)), bytes(rng.integers(0, 256, 200).astype(np.uint8))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_gru.document_probabilities(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, p in zip(texts, got):
        each = []
        for k in range(0, len(t), language_gru.STEPS):
            x = list(t[k : k + language_gru.STEPS]) + [0] * max(0, language_gru.STEPS - len(t) + k)
            both = np.concatenate([states(net.forward, x), states(net.backward, x[::-1])[::-1]], 1)
            z = np.exp(both @ net.out.T.astype(float) + net.bias)
            each += (z / z.sum(1, keepdims=True))[: len(t) - k].tolist()
        assert p == pytest.approx(np.mean(each, 0) if each else np.zeros(3), abs=1e-5)


def test_smallest_hashes(spark):
    from gridloom.llm import common

    for n, rows in ((5, 3), (500, 40), (5000, 1000), (200, 300), (0, 5)):
        ids = spark.range(n).select(F.col("id").alias("doc_id")).repartition(9)
        hashes = sorted((r.h, r.doc_id) for r in ids.select("doc_id", F.xxhash64("doc_id").alias("h")).collect())
        assert [r.doc_id for r in common.smallest_hashes(ids, rows).collect()] == [d for _, d in hashes[:rows]]


def test_rare_languages_are_learned(spark):
    rows = [(k, "x" * (k % 7 + 1), "common") for k in range(3000)] + [(9000 + k, "yes", "rare") for k in range(9)] + [(None, "no id", "lost")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    ids = language_gru.sampled_ids(known, 200).collect()
    hashes = {r.doc_id: r.h for r in known.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    common = sorted(range(3000), key=lambda k: (hashes[k], k))[:67]  # three languages, one of them without ids
    assert {r.doc_id for r in ids if r.lang == "rare"} == set(range(9000, 9009)) and len({r.doc_id for r in ids if r.lang == "common"}) in (67, 100)
    assert set(common) <= {r.doc_id for r in ids if r.lang == "common"}


def test_language(spark, none, odd):
    rng = random.Random(7)
    stems = {"aa": ["qu", "ou", "eau", "é"], "bb": ["sch", "ung", "ü", "tz"]}
    make = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, make(lang, rng.randint(3, 60)), lang) for k in range(300) for lang in ("aa" if k % 2 else "bb",)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !!", None), (902, "", "bb")], "doc_id long, text string, lang string")
    net = language_gru.train_language(docs)
    got = {r.doc_id: r for r in language_gru.predict_language(docs, net).collect()}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]) > 0.95
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_gru.train_language(none)
    assert {r.lang_pred for r in language_gru.predict_language(odd, nothing).collect()} == {"und"} and language_gru.predict_language(none, net).count() == 0


def test_url_filters(spark, tmp_path):
    urls = [
        (1, "http://User:pw@WWW.Example.COM:8080/ads/x?y"), (2, "https://a.b.c.d.example.net/"), (3, "//x.org"), (4, "not a url"), (5, None), (6, ""),
        (1, "http://User:pw@WWW.Example.COM:8080/ads/x?y"), (None, "ftp://x.org./p"), (7, "http://" + "l." * 400 + "org/deep"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("entry", F.lit(1))
    got = pages.select("url", url_filters.url_host(F.col("url")).alias("x")).collect()
    assert {r.x for r in got} >= {"www.example.com", "a.b.c.d.example.net", "x.org", None}
    day = lambda s: F.lit(s).cast("date")
    entries = spark.createDataFrame([("example.com", "block", "2024-01-01"), ("example.com", "remove", "2024-02-01"), ("www.example.com/ads", "allow", "2024-01-10"), ("x.org", "block", "2024-01-01"), ("x.org", "allow", "2024-01-01"), (None, "block", "2024-01-01")], "entry string, action string, at string").withColumn("at", F.col("at").cast("date"))

    def at(date):
        found = url_filters.filter_captures(pages.select("page_id", "url", day(date).alias("fetched_at")), entries)
        return {(r.page_id, r.host): (r.action, r.n_rows) for r in found.collect()}

    before, active, later, removed_ = at("2023-12-31"), at("2024-01-05"), at("2024-01-10"), at("2024-02-01")
    key = (1, "www.example.com")
    assert (before[key], active[key], later[key], removed_[key]) == (("none", 2), ("block", 2), ("allow", 2), ("allow", 2))
    assert active[(3, "x.org")][0] == "block" and active[(None, "x.org")][0] == "block" and active[(5, None)] == ("none", 1) and len(active) == 8
    small = pages.where("page_id IS NOT NULL AND page_id < 7").select("page_id", "url")
    df = url_filters.filter_captures(url_filters.sample_captures(small), url_filters.sample_entries(small)).withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "valid_from", "valid_to")})
    same(df, *in_sql(spark, tmp_path, url_filters.ORACLE_SQL, pages=small))


def test_url_filters_of_deep_and_short_parents(spark):
    blocked = ["a.b.c.example.com", "b.c.d.e.f.example.org", "internal", "x.a.b.c.example.com/ok"]
    entries = spark.createDataFrame([(e, "allow" if "/" in e else "block", "2024-01-01") for e in blocked], "entry string, action string, at string").withColumn("at", F.col("at").cast("date"))
    hosts = {"x.a.b.c.example.com": blocked[0], "z.y.x.a.b.c.example.com": blocked[0], "b.c.example.com": None, "1.a.b.c.d.e.f.example.org": blocked[1], "wiki.internal": "internal", "a.wiki.internal": "internal", "internal": "internal", "internal.org": None}
    captures = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)] + [(99, "http://x.a.b.c.example.com/ok")], "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("date"))
    found = {r.page_id: r.entry for r in url_filters.filter_captures(captures, entries).collect()}
    assert found == dict(enumerate(hosts.values())) | {99: blocked[3]}


def test_texts_of_megabytes(spark):
    rng = random.Random(17)
    item = prose(rng, 30)
    long = f"{prose(rng, 420_000)} {item} Released under the MIT License"
    assert len(long.encode()) > 2 << 20  # more than a slice of rows
    texts = {1: long, 2: "short text", 3: long + " tail"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lang", F.lit("en"))
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for d, t in texts.items()}
    assert {r.doc_id: (r.n_words, "mit-notice" in r.labels) for r in licenses.scan_licenses(docs).collect()} == {d: (len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))), d != 2) for d, t in texts.items()}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    gam = quality_gam.train_quality(docs, labels)
    assert {r.doc_id: r.score for r in quality_gam.score_quality(docs, gam).collect()} == {d: pytest.approx(float(gam.score(np.array([quality_gam.text_features(t)]))[0])) for d, t in texts.items()}
    found = decontamination.find_contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 5), (3, 5)}
    groups_ = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert groups_ == {d: (len(shingles(t)), 2 if d == 2 else 1) for d, t in texts.items()}
    rules = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.apply_rules(docs, quality_rules.train_rules(docs, labels)).collect()}
    assert rules == {d: (len(w), sum(map(len, w))) for d, w in words.items()}
    tok = sp.UnigramTokenizer.of(list(enumerate(PIECES, 300)), list(range(256)))
    assert all(r.round_trip for r in sp.token_digests(docs, tok).collect())
    assert {r.doc_id: r.size for r in sharding.shard_documents(docs, [1.0] * 4).collect()} == {d: len(t.encode()) + 1 for d, t in texts.items()}
    assert {r.lang_pred for r in language_gru.predict_language(docs, language_gru.train_language(docs)).collect()} == {"en"}


def test_queries_are_registered():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    try:
        for t in ("documents", "pages", "benchmark", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    except duckdb.IOException:
        pytest.skip("needs the test tables")
    found = con.sql(queries.ORACLE_SQL[name])
    columns, rows = found.columns, found.fetchall()
    assert rows or name.startswith("op3")
    same(queries.QUERIES[name](spark, folder), columns, rows)
