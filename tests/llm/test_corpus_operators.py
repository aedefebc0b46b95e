"""Corpus operators against brute force, round trips and edge cases, on small fixtures."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import anomaly, bwt_dedup, components, exact_dedup, language, ngram_join, packing, quality, queries, relative_parse, sampling, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, spans string"


def make(spark, rows):
    """Rows of (doc_id, text, lang); the last columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, g, None, len(t or ""), 7, "x") for i, t, g in rows], SCHEMA)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["é", "naïve", "Straße"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [text(60), text(45), text(36)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 50))]
        if i % 3:
            parts += [rng.choice(shared), text(rng.randint(0, 40))]
        rows.append(" ".join(parts))
    base = text(150).split()
    for i in range(20):
        near = list(base)
        for _ in range(i % 7):
            near[rng.randrange(len(near))] = "x%d" % rng.randrange(10**6)
        rows.append("\t".join(near) if i % 2 else "  ".join(near).upper())
    rows += ["", None, " \n ", "one", "one two", "one two", "ha " * 300, "ab" * 400, shared[0] + " " + shared[0], text(3000)]
    out = [(i * 3 + 1, t, rng.choice(["en", "de", None])) for i, t in enumerate(rows)]
    out.append(out[2])  # a repeated row
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [(1, "x", "en")]).where("doc_id < 0")


def labels_for(spark, rows):
    return spark.createDataFrame([(i, j % 5 and 1, 1 if t and "x" in t else 0) for j, (i, t, _) in enumerate(rows)], "doc_id long, quality int, toxic int")


# -- near duplicates --------------------------------------------------------------------


def brute_components(rows, words, percent):
    sets, ids = [], []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
        ids.append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    least = defaultdict(lambda: 10**9)
    for a in range(len(rows)):
        least[root(a)] = min(least[root(a)], ids[a])
    return sorted((ids[a], len(sets[a]), least[root(a)], links[a]) for a in range(len(rows)))


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 60)])
def test_near_duplicates(docs, rows, words, percent):
    got = sorted(map(tuple, ngram_join.near_duplicates(docs, words, percent).collect()))
    assert got == brute_components(rows, words, percent)


def test_near_duplicates_in_small_tiles(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == brute_components(rows, 4, 85)


def test_near_dedup_keeps_one_of_each_group(docs, rows):
    kept = ngram_join.near_dedup(docs)
    assert kept.columns == docs.columns
    component = {i: c for i, _, c, _ in brute_components(rows, 5, 80)}
    assert {r.doc_id for r in kept.collect()} == set(component.values())


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("v%d" % rng.randrange(900) for _ in range(n))
    a, b, c, d = text(80), text(80), text(60), text(50)
    rows = [(7, a), (7, b), (9, a + " end"), (3, b + " end"), (None, c), (None, c + " end"), (None, d), (5, d), (None, ""), (None, None), (7, None), (7, a)]
    rows = [(i, t, None) for i, t in rows]
    far = 10**9
    want = Counter((i if i < far else None, n, c if c < far else None, k) for i, n, c, k in brute_components([(far if i is None else i, t, g) for i, t, g in rows], 4, 85))
    assert Counter(map(tuple, ngram_join.near_duplicates(make(spark, rows)).collect())) == want
    kept = Counter((r.doc_id, r.text) for r in ngram_join.near_dedup(make(spark, rows)).collect())
    least_c = c if (None, c) in kept else c + " end"
    assert kept == Counter([(7, a), (7, a), (3, b + " end"), (None, least_c), (5, d), (None, ""), (None, None), (7, None)])


def test_only_texts_of_linkable_classes_are_joined(spark):
    texts = make(spark, [(i, "text %d" % i, None) for i in range(20000)]).select(ngram_join.row_key().alias("id"), "text")
    able = texts.where("id.doc_id % 40 = 7").select(F.col("id.doc_id").alias("node"), F.lit(1).alias("weight"), F.xxhash64("id").alias("key"))
    may = ngram_join.may_hold(able)
    kept = {r[0] for r in texts.where(may(F.xxhash64("id"))).select("id.doc_id").collect()}
    wanted = set(range(7, 20000, 40))
    assert wanted <= kept and len(kept - wanted) < 0.05 * 20000
    twice = texts.unionByName(texts.where("id.doc_id < 100"))
    assert sorted((r.node, r.text, r.weight) for r in ngram_join.texts_for(twice, able).collect()) == [(i, "text %d" % i, 1) for i in sorted(wanted)]
    assert ngram_join.texts_for(texts, able.where("node < 0")).count() == 0


def test_a_full_filter_still_finds_every_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 1 << 15)
    texts = spark.range(60000).select(ngram_join.row_key("id", "id").alias("id"), F.col("id").cast("string").alias("text"))
    able = texts.where("id.doc_id % 2 = 0").select(F.col("id.doc_id").alias("node"), F.lit(1).alias("weight"), F.xxhash64("id").alias("key"))
    assert ngram_join.texts_for(texts, able).count() == 30000


@pytest.mark.parametrize("partitions", [1, 200])
def test_marks_are_dealt_to_fewer_parts_and_counted_in_shares(spark, docs, monkeypatch, partitions):
    texts = docs.select(ngram_join.row_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    count = lambda: sorted(map(tuple, ngram_join.linkable(texts, 4, 85).collect()))
    want, before = count(), spark.conf.get("spark.sql.shuffle.partitions")
    assert want
    monkeypatch.setattr(ngram_join, "MARKS", 50)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert ngram_join.mark_parts(spark) == min(partitions, 50)
        assert count() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (7, 3), (20, 21), (None, 4)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20} | {100 + i: 100 for i in range(31)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- exact duplicates -------------------------------------------------------------------


def test_exact_duplicates(docs, rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    size, keep = Counter(n for _, n in norm), {}
    for i, n in norm:
        keep[n] = min(i, keep.get(n, i))
    want = sorted((i, keep[n], size[n], i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for i, n in norm)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == want
    assert {r.doc_id for r in exact_dedup.exact_dedup(docs).collect()} == set(keep.values())


def test_equal_fingerprints_do_not_merge_different_texts(spark, monkeypatch):
    """With a fingerprint that always collides the chunks tell texts apart."""
    real = exact_dedup._fingerprint_rows

    def colliding(ids, raw, off):
        found = real(ids, raw, off)
        same = pa.array([0] * found.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([found.column(0), found.column(1), same, same, found.column(4)], found.schema.names)

    monkeypatch.setattr(exact_dedup, "_fingerprint_rows", colliding)
    long = "z" * 70000
    docs = make(spark, [(1, "aa", None), (2, "bb", None), (3, "aa", None), (4, long + "a", None), (5, long + "b", None), (6, "bb", None)])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 6: (2, 2), 4: (4, 1), 5: (5, 1)}


def test_fingerprints_compose():
    rng = np.random.default_rng(3)
    raw = rng.integers(1, 255, 200_000).astype(np.uint8)
    whole = exact_dedup.fingerprints(raw, np.array([0, len(raw)]))[:, 0]
    for k, base in enumerate(exact_dedup.BASES):
        value = 0
        for byte in raw.tolist():
            value = (value * base + byte) % exact_dedup.PRIME
        assert value == whole[k]


# -- substring duplicates ---------------------------------------------------------------


def brute_words(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 9, 2])
def test_relative_parse(docs, rows, window):
    parsed = relative_parse.factor(docs, window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in parsed) == brute_words(rows, window)
    text = {i: WORD.findall(t or "") for i, t, _ in rows}
    for r in parsed:
        covered = set()
        for f in r.factors:
            assert f.length >= window
            assert text[r.doc_id][f.start : f.start + f.length] == text[f.ref_doc][f.ref_start : f.ref_start + f.length]
            covered.update(range(f.start, f.start + f.length))
        assert len(covered) == r.n_removed


def test_factors_are_taken_from_the_left_and_not_within_one_another():
    runs = [(0, 5, 4, 100), (5, 3, 4, 105), (2, 4, 9, 50), (20, 2, 4, 120), (30, 1, 1, 0), (30, 6, 2, 7), (34, 9, 3, 40), (8, 1, 9, 56)]
    got = list(zip(*(x.tolist() for x in relative_parse.parse(tuple(np.array(c) for c in zip(*runs)), 10))))
    assert got == [(0, 17, 4, 100), (8, 10, 9, 56), (20, 11, 4, 120), (30, 15, 2, 7), (34, 18, 3, 40)]
    assert [len(x) for x in relative_parse.parse((np.zeros(0, np.int64),) * 4, 10)] == [0] * 4


def test_substring_dedup_keeps_columns(docs, rows):
    out = relative_parse.substring_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    want = {i: (k, g) for i, _, g, k in brute_words(rows, 35)}
    for r in out.collect():
        kept, gone = want[r.doc_id]
        if gone:
            assert r.text == kept and r.n_chars == len(kept)


def brute_bytes(rows, window):
    first = {}
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, b in data:
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            first[s] = min(first.get(s, (i, k)), (i, k))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < (i, k):
                gone[k : k + window] = b"\1" * window
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window", [100, 12])
def test_suffix_dedup(docs, rows, window):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bwt_dedup.suffix_dedup(docs, window).collect())
    assert got == brute_bytes(rows, window)


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, kept = "== the same line in every text ==", [noise(110) for _ in range(3)]
    texts = [noise(rng.randint(0, 90)) + rng.choice(kept)[rng.randint(0, 40) :] + line + rng.choice(kept)[: rng.randint(30, 110)] + noise(60) for _ in range(120)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    docs = make(spark, rows).repartition(3)
    monkeypatch.setattr(bwt_dedup, "_HELD", 1 << 10)
    largest, later = [], bwt_dedup.halved
    monkeypatch.setattr(bwt_dedup, "halved", lambda pieces, windows: largest.append(1) or later(pieces, windows))
    monkeypatch.setattr(bwt_dedup, "MOST", 4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bwt_dedup.suffix_dedup(docs).collect())
    assert got == brute_bytes(rows, 100) and len(largest) > 1


def test_groups_stay_together_in_small_tables(monkeypatch):
    monkeypatch.setattr(bwt_dedup, "_HELD", 100)
    keys = np.repeat(np.arange(40), [1 + 7 * (i % 5 == 0) for i in range(40)])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 6])], ["anchor"]) for i in range(0, len(keys), 6)]
    tables = [t.column(0).to_pylist() for t in bwt_dedup.by_groups(iter(batches))]
    assert sum(tables, []) == keys.tolist() and len(tables) > 2
    assert all(a[-1] < b[0] for a, b in zip(tables, tables[1:]))


# -- packing ----------------------------------------------------------------------------


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    got = packing.pack(docs).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_cut_stretches_encode_like_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    tokenizer = Tokenizer.from_file(path)
    texts = ["a  b", " a b ", "x  y z", "it's we'll  a\n b", "<|endoftext|> a <|endoftext|>b", "　 a . b !", "", "é e é", "1 2,3 . ...  4", "a \t b"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for encoder in (packing.Encoder(path), packing.Encoder(path, str(public_tokenizers.path(packing.RANKS)))):
        ids, counts = encoder.ids(raw, off)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bins_and_bounds():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, 60, rng.integers(1, 9))
        bins, offsets, fill = packing.best_fit_decreasing(lengths, 60)
        assert fill.max() <= 60 and fill.sum() == lengths.sum()
        best = len(lengths)

        def search(k, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if k == len(lengths):
                best = len(loads)
                return
            for b in range(len(loads)):
                if loads[b] + lengths[k] <= 60:
                    search(k + 1, [*loads[:b], loads[b] + lengths[k], *loads[b + 1 :]])
            search(k + 1, [*loads, lengths[k]])

        search(0, [])
        assert packing.lower_bound(lengths, 60) <= best <= len(fill)


def test_exact_duplicates_under_repeated_ids(spark):
    rows = [(1, "a b", "en"), (1, "c d", "en"), (2, "a  b", "en"), (3, "c d", "en"), (0, "e", None), (1, "e", None), (1, "c d", "de"), (None, "a b", "en")]
    docs = make(spark, rows).repartition(3)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == sorted([(1, 1, 2, True), (2, 1, 2, False), (1, 1, 3, True), (1, 1, 3, True), (3, 1, 3, False), (0, 0, 2, True), (1, 0, 2, False)])
    stays = sorted((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert stays == [(0, "e"), (1, "a b"), (1, "c d"), (1, "c d")]


def unlike_texts():
    words = " ".join(f"shared{i}" for i in range(60))
    return [(1, f"start {words} end", "en"), (1, "another text " + " ".join(f"own{i}" for i in range(80)), "en"), (1, "short", "en"), (2, f"{words} tail", "en"), (None, words, "en")]


def test_passages_under_repeated_ids(spark):
    docs = make(spark, unlike_texts()).repartition(2)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in relative_parse.factor(docs).collect())
    assert got == [(1, 1, 0), (1, 62, 60), (1, 82, 0), (2, 61, 60)]
    cut = sorted((r["doc_id"], r["text"]) for r in relative_parse.substring_dedup(docs).where("doc_id IS NOT NULL").collect())
    assert [(i, len(t.split())) for i, t in cut] == [(1, 82), (1, 1), (1, 2), (2, 1)]


def test_strings_under_repeated_ids(spark):
    rows = unlike_texts()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in bwt_dedup.suffix_dedup(make(spark, rows).repartition(2)).collect())
    shared = len(" ".join(f"shared{i}" for i in range(60)))
    assert got == sorted([(1, len(rows[0][1]), 0, 0), (1, len(rows[1][1]), 0, 0), (1, 5, 0, 0), (2, len(rows[3][1]), shared + 1, 1)])


# -- classifiers ------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["éa", "ou", "vi", "tré"]}
    text = lambda g, n: " ".join("".join(rng.choice(syllables[g]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows = [(i, text(g, rng.randint(5, 120)), g) for i, g in enumerate(rng.choices(list(syllables), k=240))]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (1003, text("bb", 4000), None), (None, text("cc", 30), "aa")]
    got = {r.doc_id: r for r in language.identify(make(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, g) for i, _, g in rows[:240] if got[i].held_out]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values() if r.doc_id is not None)
    assert 1000 not in {r.doc_id for r in language.keep_identified(make(spark, rows)).collect()}


@pytest.mark.parametrize("size", [2, 200, 20_000])
def test_a_language_with_little_text_wins_nothing_else(size):
    rng = random.Random(9)
    syllables = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["漢", "字", "語", "文"]}
    text = lambda g, n: " ".join("".join(rng.choice(syllables[g]) for _ in range(3)) for _ in range(n))
    samples = {"aa": text("aa", 3_000)[:20_000], "bb": text("bb", 3_000)[:size], "cc": text("cc", 5_000)[:20_000]}
    model = language.Automata(samples)
    for g in ("aa", "cc"):
        assert language._decide(model, [text(g, n) for n in (1, 5, 60)])[0] == [g] * 3
    if size > 2:
        assert language._decide(model, [text("bb", n) for n in (5, 60)])[0] == ["bb"] * 2


def test_one_long_text_is_not_the_sample(spark):
    rows = [(i, f"{'short words ' * 5}{i}", "aa") for i in range(40)] + [(5_000, "long " * 50_000, "aa")]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sample = language.learn(make(spark, rows))["aa"]
    assert sample.count("short") >= len(kept) - 5 and len(sample) <= 64 * 320


def test_phrases_are_longest_matches():
    model = language.Automata({"a": "banana band", "b": "can nab an"})
    for lane_text in ("bandana", "nab", "xyz ban", "a"):
        symbols = model.simplify(model.classes[language._code_points(lane_text)])
        got = model.phrases(symbols, np.array([0, len(symbols)]))[:, 0]
        for k, sample in enumerate(("banana band", "can nab an")):
            count, i = 0, 0
            while i < len(lane_text):
                j = i
                while j < len(lane_text) and lane_text[i : j + 1] in sample:
                    j += 1
                count, i = count + 1, max(j, i + 1)
            assert abs(int(got[k]) - count) <= 1


@pytest.mark.parametrize("operator,label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_linear_classifiers_learn_a_word(spark, operator, label):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(40)]
        y = i % 3 == 0
        if y:
            w[rng.randrange(40)] = "signal"
        rows.append((i, " ".join(w), None))
        marks.append((i, int(y), int(y)))
    rows += [(900, None, None), (901, "", None), (None, "signal", None)]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = operator(make(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.predicted, int(r.doc_id % 3 == 0)) for r in got if r.held_out and r.doc_id < 600]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    none = operator(make(spark, rows), labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}


def test_rule_statistics_match_brute_force(docs, rows, spark):
    got = anomaly.quality_rules(docs, labels_for(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        three = Counter(zip(w, w[1:], w[2:]))
        again = {k + d for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), failed))
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_forest_isolates_an_outlier():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 4))
    rows[7] = 30
    scores = anomaly.Forest(rows).score(rows)
    assert scores.argmax() == 7 and anomaly.Forest(rows[:0]).score(rows).shape == (500,)


def test_every_tree_draws_the_least_of_the_whole_table(spark):
    frame = pd.DataFrame({"doc_id": np.arange(3000), **{c: np.arange(3000) * (k + 3) % 97 + 1 for k, c in enumerate(anomaly._COUNTS)}})
    table = spark.createDataFrame(frame).repartition(7)
    got = anomaly.forest_of(table, 3000, trees=5)
    keys = {r.doc_id: r.key for r in table.select("doc_id", F.xxhash64("doc_id", *anomaly._COUNTS).alias("key")).collect()}
    key = np.array([keys[i] for i in range(3000)]).view(np.uint64)
    trees = []
    for tree, salt in enumerate(anomaly.numbers(5, anomaly.SEED)):
        least = np.argsort(anomaly.mix(key ^ salt))[: anomaly.PER_TREE]
        trees.append(anomaly.grow(anomaly.features(frame.iloc[least]), np.random.default_rng([anomaly.SEED, tree])))
    want = anomaly.Forest.of(trees, anomaly.PER_TREE)
    rows = anomaly.features(frame)
    assert np.array_equal(got.score(rows), want.score(rows))


def test_path_lengths_by_walking_each_tree():
    rows = np.random.default_rng(5).normal(size=(300, 4))
    forest = anomaly.Forest(rows, trees=9, per_tree=64)

    def walk(node, row):
        if forest.left[node] < 0:
            return forest.path[node]
        return walk((forest.left if row[forest.feature[node]] < forest.value[node] else forest.right)[node], row)

    mean = [np.mean([walk(root, row) for root in forest.roots]) for row in rows]
    assert np.allclose(forest.score(rows), 2.0 ** (-np.array(mean) / anomaly._mean_path(64)))


@pytest.mark.parametrize("scores", [[], [0.4], [0.5] * 40, [0.3, 0.7, 0.7, 0.9], list(np.random.default_rng(3).random(500))])
def test_cut_is_the_exact_quantile(spark, scores):
    scores = np.array(scores, float)
    good = spark.createDataFrame([(int(b),) for b in scores.view(np.int64)], "bits long")
    for keep in (0.0, 0.5, 0.98, 1.0):
        assert anomaly.calibrate(good, keep) == (np.quantile(scores, keep, method="higher") if len(scores) else 1.0)


def test_rows_without_id_and_repeated_rows_are_drawn_and_judged(spark):
    rows = [(None, "a b c", None)] * 700 + [(2**60 + 1, "word " * 80, None)] * 2 + [(2**60 + 1, "x y z " * 40, None), (5, None, None)]
    got = anomaly.quality_rules(make(spark, rows), spark.createDataFrame([(2**60 + 1, 1)], "doc_id long, quality int")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({tuple(r) for r in got if r.doc_id is None}) == 1


# -- sampled segmentations --------------------------------------------------------------


def test_sampled_segmentations(spark):
    turns = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "naïve 龘 x" * 40), (5, "the cat sat")], "k long, text string")
    drawn = sampling.encode(turns, ["k"], samples=5)
    got = drawn.withColumn("back", sampling.decode(drawn["ids"])).collect()
    text = {1: "the cat sat", 2: "", 3: "", 4: "naïve 龘 x" * 40, 5: "the cat sat"}
    assert all(r.back == text[r.k] and 0 <= r.inclusion <= 1 for r in got)
    assert Counter(r.k for r in got) == {1: 5, 2: 1, 3: 1, 4: 5, 5: 5}
    for k in text:
        own = sorted((r for r in got if r.k == k), key=lambda r: r["rank"])
        assert len({tuple(r.ids) for r in own}) == len(own)
        assert [r.perturbed for r in own] == sorted((r.perturbed for r in own), reverse=True)
    assert sorted(map(str, got)) == sorted(map(str, drawn.withColumn("back", sampling.decode(drawn["ids"])).collect()))


def test_samples_follow_the_probabilities():
    lattices = sampling._lattices(sampling._path(None), sampling.TEMPERATURE)
    first, probability = Counter(), {}
    for seed in range(4000):
        for rank, (ids, log_prob, _, _) in enumerate(lattices.sample("thable in", 3, np.random.default_rng([seed]))):
            probability[tuple(ids)] = np.exp(log_prob)
            first[tuple(ids)] += rank == 0
    assert sum(probability.values()) <= 1 + 1e-9
    for ids, p in probability.items():
        assert abs(first[ids] / 4000 - p) < 4 * np.sqrt(p / 4000) + 0.002


def _segmentations(lattices, text):
    """Probability of every path of one stretch, by full enumeration."""
    whole, paths = lattices.model.normalize(text), [((), 0, 0.0)]
    done = {}
    while paths:
        ids, at, weight = paths.pop()
        if at == len(whole):
            done[ids] = np.exp(weight)
        for end in range(at + 1, len(whole) + 1):
            piece = lattices.pieces.get(whole[at:end])
            if piece is not None:
                paths.append(((*ids, piece), end, weight + lattices.piece_weight[piece]))
    total = sum(done.values())
    return {ids: p / total for ids, p in done.items()}


def test_samples_equal_full_enumeration():
    lattices = sampling._lattices(sampling._path(None), sampling.TEMPERATURE)
    chance = _segmentations(lattices, "tha")
    every = lattices.sample("tha", len(chance) + 3, np.random.default_rng([3]))
    assert {tuple(ids) for ids, *_ in every} == set(chance) and len(every) == len(chance)
    assert all(abs(np.exp(log_p) - chance[tuple(ids)]) < 1e-9 and inclusion == 1 for ids, log_p, _, inclusion in every)
    # Pairs in order are drawn one after the other without the first; kappa makes p over inclusion unbiased.
    runs, pairs, estimates = 6000, Counter(), []
    for seed in range(runs):
        drawn = lattices.sample("tha", 2, np.random.default_rng([seed, 1]))
        pairs[tuple(tuple(ids) for ids, *_ in drawn)] += 1
        assert drawn[0][2] >= drawn[1][2]
        estimates.append(sum(chance[tuple(ids)] / inclusion for ids, _, _, inclusion in drawn))
    for one, p in chance.items():
        for two, q in chance.items():
            if one != two:
                expected = p * q / (1 - p)
                assert abs(pairs[one, two] / runs - expected) < 5 * np.sqrt(expected / runs) + 0.001
    assert abs(np.mean(estimates) - 1) < 5 * np.std(estimates) / np.sqrt(runs) + 0.005


def test_neighbours_and_memory_do_not_change_samples(monkeypatch):
    texts = ["the cat sat on the mat", "naïve 龘 x" * 30, "", "aaaaaaaaaaaaaaaaaaaa bb", "the cat sat on the mat"] * 3
    keys = np.arange(len(texts)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = sampling.Lattices(sampling._path(None), sampling.TEMPERATURE)
    together = [x.tolist() for x in one.sample_all(texts, keys, 4)]
    monkeypatch.setattr(sampling, "_REMEMBERED", 1)
    monkeypatch.setattr(sampling, "_SLICE", 5)
    two = sampling.Lattices(sampling._path(None), sampling.TEMPERATURE)
    apart = [two.sample_all([t], keys[i : i + 1], 4) for i, t in enumerate(texts)]
    assert together[2] == np.concatenate([x[2] for x in apart]).tolist()
    for column in (3, 4, 5):
        assert np.allclose(together[column], np.concatenate([x[column] for x in apart]), rtol=1e-9, atol=1e-12)


def test_decoded_by_the_same_workers(spark):
    turns = spark.createDataFrame([(1, " two  spaces ", "x"), (2, None, "y"), (3, "naïve 龘\n\ttab", "z")], "k long, text string, decoded string")
    got = sampling.encode(turns, ["k"], decoded=True)
    for r in got.withColumn("back", sampling.decode(got["ids"])).collect():
        assert r.decoded == r.back


def test_lists_of_ids_decode_together_as_one_by_one():
    lattices = sampling._lattices(sampling._path(None), sampling.TEMPERATURE)
    texts = ["", " ", "   ", "a", " a  b ", "naïve 龘\n\ttab", "\x00x", "▁x▁", "\r\n\xa0", "😀é\u200b\ufffd", "ﬁ Å x", "aaaaaaaaaaaa bb " * 30]
    _, offsets, ids, *_ = lattices.sample_all(texts, np.arange(len(texts)).astype(np.uint64), 4)
    lists = [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] + [lattices.model.encode(t) for t in texts] + [[lattices.pieces["x"]], []]
    offsets = np.cumsum([0] + [len(x) for x in lists])
    together = lattices.decode_all(np.array([i for x in lists for i in x], np.int32), offsets)
    assert together.type == pa.string() and together.to_pylist() == [lattices.model.decode(x) for x in lists]
    assert lattices._said is not None
    none = lattices.decode_all(np.zeros(0, np.int32), np.zeros(4, np.int64))
    assert none.to_pylist() == ["", "", ""]


def test_stretches_met_again_are_remembered_longer(monkeypatch):
    rng = random.Random(3)
    texts = ["the cat sat on the mat %s %s" % ("".join(rng.choices("abcdefgh", k=8)), rng.choice(["naïve", "龘 x", ""])) for _ in range(60)]
    keys = np.arange(len(texts)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    together = [x.tolist() for x in sampling.Lattices(sampling._path(None), sampling.TEMPERATURE).sample_all(texts, keys, 4)]
    monkeypatch.setattr(sampling, "_REMEMBERED", 300)
    small, met, settled = sampling.Lattices(sampling._path(None), sampling.TEMPERATURE), [], []
    known = small._settle
    monkeypatch.setattr(small, "_settle", lambda: (settled.extend(small._new), known()))
    for i, t in enumerate(texts):
        met.append(small.sample_all([t], keys[i : i + 1], 4))
    assert together[2] == np.concatenate([x[2] for x in met]).tolist()
    for column in (3, 4, 5):
        assert np.allclose(together[column], np.concatenate([x[column] for x in met]), rtol=1e-9, atol=1e-12)
    # Built once, though the others are forgotten again and again.
    assert settled.count("▁cat") == 1 and len(small.known) < 60 and "▁cat" in small.known


def test_long_stretches_are_one_lattice():
    lattices = sampling._lattices(sampling._path(None), sampling.TEMPERATURE)
    weight = lattices.piece_weight
    for text in ("theinformation" * 20, "https://example.org/" + "ab12" * 5000):
        whole = lattices.model.normalize(text)
        assert "▁" not in whole[1:]
        mass = [0.0]
        for j in range(1, len(whole) + 1):
            pieces = ((i, lattices.pieces.get(whole[i:j])) for i in range(max(0, j - lattices.longest), j))
            mass.append(np.logaddexp.reduce([mass[i] + weight[p] for i, p in pieces if p is not None]))
        for ids, log_prob, _, _ in lattices.sample(text, 4, np.random.default_rng([1])):
            assert abs(log_prob - (sum(weight[p] for p in ids) - mass[-1])) < 1e-6


def test_sampling_encodes_every_document(spark):
    folder = "/root/testdata/sf0.001"
    keys = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.QUERIES["op9_sentencepiece_sampling"](spark, folder).select("doc_id").collect()} == keys


# -- edges ------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        ngram_join.near_duplicates(empty), exact_dedup.exact_duplicates(empty), relative_parse.factor(empty), bwt_dedup.suffix_dedup(empty),
        packing.pack(empty), language.identify(empty), toxicity.toxicity(empty, labels), quality.quality(empty, labels),
        anomaly.quality_rules(empty, labels), sampling.encode(empty, ["doc_id"]), relative_parse.substring_dedup(empty),
    ):
        assert out.columns and out.count() == 0
