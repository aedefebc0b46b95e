"""The pipeline's stages against plain versions, on the smallest folder."""

import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ledgerloom.llm import language

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in texts if root(i) == i}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = language.Automata(language.learn(docs))
    kept = {i: t for i, t in texts.items() if language._decide(model, [t or ""])[0] != ["und"]}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        if name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
            kept = {i: kept[i] for i in first.values()}
        elif name == "near_dedup":
            kept = {i: kept[i] for i in near_groups(kept)}
        elif name == "substring_dedup":
            words = {i: WORD.findall(t or "") for i, t in kept.items()}
            seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
            for i, w in words.items():
                gone = {k + d for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for d in range(35)}
                if gone:
                    kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert {r.doc_id: r.text for r in docs.collect()} == kept
    filled = defaultdict(int)
    for r in docs.collect():
        filled[r.sequence_id] += r.length
    assert {r.doc_id for r in docs.collect()} == set(kept) and max(filled.values()) <= 1024
    want = sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
    got = corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset")
    assert sorted(map(tuple, got.collect())) == want
