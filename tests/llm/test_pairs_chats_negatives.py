"""Alignment, chat formatting and hard negatives against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import alignment, chat_format, hard_negatives

pytest.importorskip("public_tokenizers")

TEXTS = [
    "", None, "a", " ", "  x  y ", "▁x▁", "a▁b <|endoftext|> <s> <0x41>", "\x00", "日本語 テキスト 🙂", "\n\n x",
    "x" * 50_000, "� é́ é", " lead", "trail ", "a b c a b c " * 3_000, "one two three two one", "one two three two one",
]


def aligned(texts):
    """Figures of every text, token by token."""
    pair, docs = alignment._pair(None, None), []
    for text in texts:
        docs.append((0, 0, 0, 0, "", Counter()))
        if not text:
            continue
        whole = (" " + text).encode()
        a, b = pair.encode_a(" " + text), pair.encode_b(" " + text)
        bytes_a, bytes_b = ([v.bytes_of(np.array([i])).tobytes() for i in ids] for ids, v in ((a, pair.vocabulary_a), (b, pair.vocabulary_b)))
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links, i, j = [([], [])], Counter(), 0, 0
        opened_a = opened_b = True
        while i < len(a):
            if opened_a:
                groups[-1][0].append(str(a[i]))
            if opened_b:
                groups[-1][1].append(str(b[j]))
            links[a[i], b[j]] += 1
            end = min(ends_a[i], ends_b[j])
            opened_a, opened_b = ends_a[i] == end, ends_b[j] == end
            i, j = i + opened_a, j + opened_b
            if opened_a and opened_b and i < len(a):
                groups.append(([], []))
        said = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        docs[-1] = (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), links)
    counts = Counter(p for d in docs for p in d[5])
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (*d[:4], sum(n for p, n in d[5].items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in d[5].items()), d[4]) for d in docs
    ]


def test_alignment_equals_token_by_token(spark):
    ids = [*range(len(TEXTS) - 1), None]
    ids[3] = 2  # one id, two texts
    rows = [(i, t, 1, 2, "x") for i, t in zip(ids, TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, container long, a int, planes string").repartition(3)
    got = Counter(tuple(r) for r in alignment.align(docs).collect())
    assert got == Counter((i, *figures) for i, figures in zip(ids, aligned(TEXTS)))
    assert alignment.align(docs.limit(0)).collect() == []


def test_alignment_over_several_containers(spark, monkeypatch):
    texts = [f"word{i % 7} shared passage of some words number {i}" for i in range(300)]
    one = alignment._Container(0)
    pair = alignment._pair(None, None)
    from ledgerloom.llm.textkit import slices
    import pyarrow as pa

    for lo, hi, raw, off in slices(pa.array(texts), 2_000):
        _, owner, links, weight = alignment.align_slice(pair, raw, off)
        one.add(hi - lo, len(raw), owner, links, weight)
    pairs, popcount, planes = one.postings()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts = {(r["a"], r["b"]): r["count"] for r in alignment.pair_counts(alignment.index(docs).where("a IS NOT NULL")).collect()}
    assert counts == {(int(p) >> 16, int(p) & 0xFFFF): int(n) for p, n in zip(pairs, popcount)}
    assert all(len(np.unique(alignment.members(sets)[0])) == n for sets, n in zip(planes, popcount))


def test_sets_come_back():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(5_000, n, replace=False)) for n in (0, 1, 7, 311, 313, 2_000, 5_000)]
    kept = alignment.compress(np.concatenate(sets), np.array([len(s) for s in sets]), 5_000)
    assert [len(s) & 1 for s in kept] == [0, 0, 0, 0, 1, 1, 1]
    values, owner = alignment.members(kept)
    for i, s in enumerate(sets):
        assert np.array_equal(np.sort(values[owner == i]), s)


TURNS = [
    (1, 0, "user", "hi <|im_end|> <\\|x|> <\\\\|"), (1, 1, "user", "<|"), (1, 2, "assistant", "ä<|im_sep|>"), (1, 3, "assistant", None),
    (1, 4, "assistant", "<"), (None, 1, "user", "x"), (2, None, "assistant", ""), (2, 0, None, "a\nb\n"), (2, 0, "assistant", "%0A"),
    (3, 0, "us<er\n%0A", "|>"), (4, 0, "assistant", "<|im_end|>\n" * 3), (6, 0, "assistant", "é<|" * 200_000), (7, 1, "user", "same"), (7, 1, "user", "same"),
    *[(5, i, "assistant" if i % 3 else "user", f"m{i}<|é") for i in range(300)],
]


def test_chats_read_back(spark):
    turns = spark.createDataFrame([(*r, "clash", 1) for r in TURNS], "conv_id long, turn long, role string, text string, formatted string, rows int")
    formatted = chat_format.format_chats(turns).cache()
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    chats = defaultdict(list)
    for conv, turn, role, text in TURNS:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(chats)
    for conv, rows in chats.items():
        rows.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
        learned = "".join(text for _, _, role, text in rows if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["n_messages"] == 1 + sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))
    for r in formatted.collect():
        # No control string but the template's own.
        assert r["formatted"].count("<|") == 2 * r["n_messages"] + r["n_rows"] - r["n_messages"]
    assert chat_format.format_chats(turns.limit(0)).collect() == []


def mined(rows, n_positives=5, n_negatives=10):
    """(vec_id, label, vector) rows compared one by one."""
    kept = [(i, c, [int(np.floor(256 * float(x))) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {(i, c, tuple(v)) for i, c, v in kept if i % 100 == 0}
    out = []
    for anchor, label, vector in anchors:
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, c) for i, c, v in kept if i != anchor)
        for positive in [s for s in scored if s[2] == label][:n_positives]:
            p = -positive[0]
            negatives = [s for s in scored if s[2] != label and 30 * p <= -100 * s[0] <= 90 * p]
            out += [(anchor, positive[1], k + 1, s[1], p, -s[0]) for k, s in enumerate(negatives[:n_negatives])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [8192, 64])
def test_negatives_equal_brute_force(spark, monkeypatch, block_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 24))
    rows = [(i, int(i % 6), (base[i % 6] + base[i % 5] + rng.normal(size=24)).astype(float).tolist()) for i in range(700)]
    rows += [(1_000 + i, i % 3, rows[0][2]) for i in range(40)]  # ties
    rows += [rows[7], rows[100], (200, 5, rows[3][2]), (None, 1, rows[1][2]), (801, None, rows[1][2]), (802, 1, None)]
    rows += [(803, 1, [None] * 24), (804, 1, [float("nan")] * 24), (805, 1, [float("inf")] * 24), (806, 1, []), (900, 2, []), (807, 2, [0.5])]
    rows += [(808, 3, [9.0e4] * 24), (1_100, 3, [9.0e4, -9.0e4] * 12)]
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block_rows)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, block long, anchor string").repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.mine(spark, table).collect())
    assert got == mined(rows)
    assert hard_negatives.mine(spark, table.limit(0)).collect() == []


def test_scan_is_exact_where_doubles_are_not():
    rng = np.random.default_rng(6)
    matrix = rng.integers(-(1 << 25), 1 << 25, (40, 64)).astype(np.int32)
    block = hard_negatives.Block(40, np.arange(40).tobytes(), np.zeros(40, np.int64).tobytes(), np.ascontiguousarray(matrix.T).tobytes())
    anchor = matrix[3]
    at, scores = block.scan(anchor, np.ones(40, bool), lambda partial, least, most: np.ones(len(partial), bool))
    assert np.array_equal(scores, matrix[at].astype(object) @ anchor.astype(object))
