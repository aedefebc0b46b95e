"""Alignment of two tokenizers' tokens by byte offsets, counted with inverted pair bitmaps (operator 11).

Both tokenizers (a byte-level BPE, A, and a piece BPE with byte fallback, B) encode a text with one space
before it.  A token of A and a token of B are linked if their byte ranges overlap; offsets at which tokens of
both end cut the text into groups.

A task reads documents in *containers* (bounded by text and by 65,536 documents) and writes, for every pair of
ids that some document of the container links, bitmaps of these documents: plane k holds the documents whose
number of links of the pair has bit k set.  A set is kept as a sorted list of 16-bit numbers or, where that is
shorter, as plain bits.  The OR of the planes is the pair's set of documents; its popcount, summed over the
containers, is the pair's count.  The postings then go back to their container with the count, and each document
adds up, over its set bits, what its links score.  So a frequent pair is one posting per container, never a row
per document, and no task holds more than one container.

Stretches between spaces recur; each is encoded and aligned once per slice.  A text may be cut before a space
between two visible ASCII characters: the first tokenizer always starts a token there, and the second has no
piece with a space after another character (checked when it is loaded).

Defined results: a null or empty text, or one that a tokenizer does not give back byte for byte, has no tokens
(zeros, and an empty string instead of a digest); repeated rows and rows without doc_id are counted and returned
one by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .textkit import Rolling, ragged, slices, texts_of

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A container ends after so much text, or so many documents.
CONTAINER_BYTES, CONTAINER_DOCS = 16 << 20, 1 << 16
SLICE = 4 << 20
#: Text handed to a tokenizer at once; longer stretches go alone.
BATCH = 1 << 16

_HASH = Rolling(1101)
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_SPACE_MARK = "▁"


class Vocabulary:
    """Bytes of every token, and the written form of its id before each separator."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        # Written with the separator after a token inside a group, then with the one after its last.
        self.written = [f"{i}{mark}".encode() for mark in (inner, last) for i in range(len(tokens))]
        self.written_size = np.fromiter(map(len, self.written), np.int64, 2 * len(tokens))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[ragged(self.start[ids], self.size[ids])]


class Pair:
    """Two tokenizers; encodes stretches that begin with a space."""

    def __init__(self, path_a: str, path_b: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        tokens_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens_a[rank] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        tokens_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.vocabulary_a, self.vocabulary_b = Vocabulary(tokens_a, ",", "|"), Vocabulary(tokens_b, ",", ";")
        self.cuttable = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces)

    def encode_a(self, text: str) -> list[int]:
        return self.a.encode_ordinary(text)

    def encode_b(self, text: str) -> list[int]:
        # The tokenizer puts a space before the text itself.
        return self.b.encode(text[1:], num_threads=1) if text else []


@lru_cache(maxsize=1)
def _pair(path_a: str | None, path_b: str | None) -> Pair:
    import public_tokenizers

    return Pair(str(path_a or public_tokenizers.path(TOKENIZER_A)), str(path_b or public_tokenizers.path(TOKENIZER_B)))


class Stretches:
    """Tokens, groups and links of stretches of text; arrays run over all stretches, one after the other."""

    def __init__(self, pair: Pair, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, safe: np.ndarray):
        data, n = raw.tobytes(), len(starts)
        # Stretches that end at a cut are joined and encoded together, others alone.
        runs, alone = [], []
        size = ends - starts
        where = np.flatnonzero(safe)
        batch = np.cumsum(size[where]) // BATCH
        for part in np.split(where, np.flatnonzero(np.diff(batch)) + 1):
            if len(part):
                runs.append(part)
        alone = [np.array([i]) for i in np.flatnonzero(~safe)]
        order = np.concatenate([*runs, *alone]) if n else np.zeros(0, np.int64)
        ids_a, ids_b = [], []
        for part in (*runs, *alone):
            text = b"".join([data[starts[i] : ends[i]] for i in part.tolist()]).decode()
            ids_a.append(np.array(pair.encode_a(text), np.int64))
            ids_b.append(np.array(pair.encode_b(text), np.int64))
        # From here on stretches stand in the order in which they were encoded.
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        edge = np.concatenate([[0], np.cumsum(size[order])])
        want = raw[ragged(starts[order], size[order])]
        lost = np.zeros(n, bool)
        begin = np.concatenate([[0], np.cumsum([size[p].sum() for p in (*runs, *alone)], dtype=np.int64)])
        for ids, vocabulary in ((ids_a, pair.vocabulary_a), (ids_b, pair.vocabulary_b)):
            for i, part in enumerate(ids):
                got, lo, hi = vocabulary.bytes_of(part), begin[i], begin[i + 1]
                if len(got) != hi - lo or not np.array_equal(got, want[lo:hi]):
                    self._mark(pair, vocabulary, (runs + alone)[i], data, starts, ends, lost, order)
        if lost.any():
            # Stretches that do not come back are encoded as nothing; the others once more without them.
            kept = np.flatnonzero(~lost)
            inner = Stretches(pair, raw, starts[kept], ends[kept], safe[kept])
            self.lost = lost
            self._take(inner, kept, n)
            return
        self.lost = lost
        self._align(pair, np.concatenate([*ids_a, np.zeros(0, np.int64)]), np.concatenate([*ids_b, np.zeros(0, np.int64)]), edge)

    @staticmethod
    def _mark(pair, vocabulary, part, data, starts, ends, lost, order):
        encode = pair.encode_a if vocabulary is pair.vocabulary_a else pair.encode_b
        for i in part.tolist():
            piece = data[starts[i] : ends[i]]
            if vocabulary.bytes_of(np.array(encode(piece.decode()), np.int64)).tobytes() != piece:
                lost[i] = True

    def _take(self, inner: Stretches, kept: np.ndarray, n: int) -> None:
        self.place = np.full(n, len(kept), np.int64)
        self.place[kept] = inner.place
        for name in ("n_a", "n_b", "n_groups", "n_links", "first_link"):
            setattr(self, name, np.append(getattr(inner, name), 0))
        self.first_link[-1] = len(inner.links)
        self.links, self.written = inner.links, [*inner.written, b""]

    def _align(self, pair: Pair, a: np.ndarray, b: np.ndarray, edge: np.ndarray) -> None:
        end_a, end_b = np.cumsum(pair.vocabulary_a.size[a]), np.cumsum(pair.vocabulary_b.size[b])
        stops = np.union1d(end_a, end_b)
        # Between two neighbouring ends one token of each covers the text: every link once.
        of_a, of_b = np.searchsorted(end_a, stops), np.searchsorted(end_b, stops)
        self.links = (a[of_a].astype(np.uint64) << np.uint64(16)) | b[of_b].astype(np.uint64)
        both = stops[(end_a[of_a] == stops) & (end_b[of_b] == stops)] if len(stops) else stops
        link_edge, a_edge, b_edge, group_edge = (np.searchsorted(x, edge, "right") for x in (stops, end_a, end_b, both))
        self.first_link = link_edge[:-1].copy()
        self.n_links, self.n_a, self.n_b, self.n_groups = (np.diff(x) for x in (link_edge, a_edge, b_edge, group_edge))
        # The written groups: a group's tokens of A, then those of B.
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        per_a = np.bincount(group_a, minlength=len(both)) if len(both) else np.zeros(0, np.int64)
        per_b = np.bincount(group_b, minlength=len(both)) if len(both) else np.zeros(0, np.int64)
        before = np.cumsum(per_a + per_b) - (per_a + per_b)
        at_a = np.arange(len(a)) + (before - (np.cumsum(per_a) - per_a))[group_a] if len(a) else np.zeros(0, np.int64)
        at_b = np.arange(len(b)) + (before + per_a - (np.cumsum(per_b) - per_b))[group_b] if len(b) else np.zeros(0, np.int64)
        va, vb = pair.vocabulary_a, pair.vocabulary_b
        code_a, code_b = a + len(va.size) * last_a[: len(a)], b + len(vb.size) * last_b[: len(b)]
        written, lengths = [b""] * (len(a) + len(b)), np.zeros(len(a) + len(b), np.int64)
        for at, code, vocabulary in ((at_a, code_a, va), (at_b, code_b, vb)):
            lengths[at] = vocabulary.written_size[code]
            table = vocabulary.written
            for i, c in zip(at.tolist(), code.tolist()):
                written[i] = table[c]
        whole = b"".join(written)
        chars = np.concatenate([[0], np.cumsum(lengths)])[a_edge + b_edge]
        self.written = [whole[i:j] for i, j in zip(chars[:-1].tolist(), chars[1:].tolist())]


def align_slice(pair: Pair, raw: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Figures per text, and its linked pairs: (text, pair, number of links), sorted by pair and text."""
    rows = len(off) - 1
    filled = np.diff(off) > 0
    # One space before each text that is not empty.
    new_off = off + np.concatenate([[0], np.cumsum(filled)])
    spaced = np.full(len(raw) + int(filled.sum()), 0x20, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.cumsum(filled), np.diff(off))] = raw
    cut = np.zeros(len(spaced), bool)
    if pair.cuttable:
        cut[1:-1] = (spaced[1:-1] == 0x20) & _GRAPH[spaced[:-2]] & _GRAPH[spaced[2:]]
    heads = new_off[:-1][filled]
    cut[heads] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(spaced))[: len(starts)]
    row = np.searchsorted(new_off, starts, "right") - 1
    # Safe to join with others: a visible character follows the space, and one stands at the end.
    safe = (ends - starts >= 2) & _GRAPH[spaced[np.minimum(starts + 1, max(len(spaced) - 1, 0))]] & _GRAPH[spaced[ends - 1]] if len(starts) else np.zeros(0, bool)
    safe &= pair.cuttable
    _, at, which = np.unique(_HASH.spans(spaced, starts, ends), return_index=True, return_inverse=True) if len(starts) else (None, starts, starts)
    found = Stretches(pair, spaced, starts[at], ends[at], safe[at])
    item = found.place[which]
    bad = np.bincount(row, found.lost[which], rows).astype(bool) if len(row) else np.zeros(rows, bool)
    kept = ~bad[row]
    item, row = item[kept], row[kept]
    figures = {name: np.bincount(row, getattr(found, name)[item], rows).astype(np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    first = np.searchsorted(row, np.arange(rows + 1)).tolist()
    items, written = item.tolist(), found.written
    figures["groups_sha256"] = [
        hashlib.sha256(b"".join([written[i] for i in items[first[r] : first[r + 1]]])[:-1]).hexdigest() if first[r] < first[r + 1] else "" for r in range(rows)
    ]
    # Equal stretches of a text are counted first, then their links.
    seen, times = np.unique((row.astype(np.uint64) << np.uint64(32)) | item.astype(np.uint64), return_counts=True)
    item, row = (seen & np.uint64(0xFFFFFFFF)).astype(np.int64), (seen >> np.uint64(32)).astype(np.int64)
    links = found.links[ragged(found.first_link[item], found.n_links[item])]
    weight = np.repeat(times, found.n_links[item])
    owner = np.repeat(row, found.n_links[item])
    order = np.lexsort((owner, links))
    links, owner, weight = links[order], owner[order], weight[order]
    new = np.append(True, (links[1:] != links[:-1]) | (owner[1:] != owner[:-1]))[: len(links)]
    heads = np.flatnonzero(new)
    return figures, owner[heads], links[heads], np.add.reduceat(weight, heads) if len(heads) else weight


def compress(values: np.ndarray, counts: np.ndarray, universe: int) -> list[bytes]:
    """Sets of 16-bit numbers, ``counts`` consecutive sorted ``values`` each.

    An even number of bytes is a list of numbers, an odd number is bits.
    """
    width = -(-universe // 8) | 1
    edge = np.concatenate([[0], np.cumsum(counts)])
    data, bounds = values.astype("<u2").tobytes(), (2 * edge).tolist()
    out = [data[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    for i in np.flatnonzero(2 * counts > width).tolist():
        bits = np.zeros(8 * width, np.uint8)
        bits[values[edge[i] : edge[i + 1]]] = 1
        out[i] = np.packbits(bits, bitorder="little").tobytes()
    return out


def members(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the sets, and for each of them the set it is of."""
    listed = [i for i, s in enumerate(sets) if not len(s) & 1]
    values = [np.frombuffer(b"".join([sets[i] for i in listed]), "<u2")]
    owner = [np.repeat(np.array(listed, np.int64), [len(sets[i]) // 2 for i in listed])]
    for i, s in enumerate(sets):
        if len(s) & 1:
            values.append(np.flatnonzero(np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little")))
            owner.append(np.full(len(values[-1]), i))
    return np.concatenate(values).astype(np.int64), np.concatenate(owner)


class _Container:
    """Documents of one task, numbered from 0, until the container is closed."""

    def __init__(self, number: int):
        self.number, self.docs, self.size, self.parts = number, 0, 0, []

    def add(self, rows: int, size: int, owner: np.ndarray, links: np.ndarray, weight: np.ndarray) -> np.ndarray:
        numbers = np.arange(self.docs, self.docs + rows)
        self.parts.append((links << np.uint64(16) | (owner + self.docs).astype(np.uint64), weight))
        self.docs += rows
        self.size += size
        return numbers

    def postings(self) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Pairs, the popcount of the OR of their planes, and the planes."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        keys, weight = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
        pairs, index = np.unique(keys >> np.uint64(16), return_inverse=True)
        docs = (keys & np.uint64(0xFFFF)).astype(np.int64)
        popcount = np.bincount(index, minlength=len(pairs))
        most = np.zeros(len(pairs), np.int64)
        np.maximum.at(most, index, weight)
        planes: list[list[bytes]] = [[] for _ in range(len(pairs))]
        for k in range(int(most.max(initial=0)).bit_length()):
            bit = (weight >> k) & 1 == 1
            sets = compress(docs[bit], np.bincount(index[bit], minlength=len(pairs)), self.docs)
            for i in np.flatnonzero(most >> k).tolist():
                planes[i].append(sets[i])
        return pairs, popcount, planes


_FIGURES = "container long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTINGS = "a int, b int, n_docs long, planes array<binary>"


def index(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Rows of two kinds: figures of a document (``a`` is null), and a pair's planes in one container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, part, made = _pair(path_a, path_b), TaskContext.get().partitionId(), 0
        held = _Container(part << 24)

        def close():
            pairs, n_docs, planes = held.postings()
            for lo in range(0, len(pairs), 1 << 15):
                some = slice(lo, lo + (1 << 15))
                n = len(pairs[some])
                yield _batch(
                    container=np.full(n, held.number), a=(pairs[some] >> np.uint64(16)).astype(np.int32), b=(pairs[some] & np.uint64(0xFFFF)).astype(np.int32), n_docs=n_docs[some], planes=planes[some]
                )

        for batch in batches:
            # A slice may not hold more documents than a container.
            for first in range(0, len(batch), CONTAINER_DOCS):
                some = batch.slice(first, CONTAINER_DOCS)
                for lo, hi, raw, off in slices(some.column(1), SLICE):
                    if held.docs and (held.docs + hi - lo > CONTAINER_DOCS or held.size + len(raw) > CONTAINER_BYTES):
                        yield from close()
                        made += 1
                        held = _Container((part << 24) + made)
                    figures, owner, links, weight = align_slice(pair, raw, off)
                    numbers = held.add(hi - lo, len(raw), owner, links, weight)
                    yield _batch(container=np.full(hi - lo, held.number), doc=numbers.astype(np.int32), doc_id=some.column(0).slice(lo, hi - lo), **figures)
        yield from close()

    return texts_of(docs).mapInArrow(run, f"{_FIGURES}, {_POSTINGS}")


_ARROW = pa.schema(
    [
        *(pa.field(n, t) for n, t in (("container", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()))),
        *(pa.field(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")),
        pa.field("groups_sha256", pa.string()),
        *(pa.field(n, pa.int32()) for n in ("a", "b")),
        pa.field("n_docs", pa.int64()),
        pa.field("planes", pa.list_(pa.binary())),
    ]
)


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _score(key, postings: pa.Table, figures: pa.Table) -> pa.Table:
    """Adds up, in one container, what the links of each document score."""
    docs = figures["doc"].to_numpy()
    n = int(docs.max(initial=-1)) + 1
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for batch in postings.combine_chunks().to_batches():
        planes = batch.column("planes")
        which = np.repeat(np.arange(len(batch)), np.diff(planes.offsets.to_numpy()))
        plane = ragged(np.zeros(len(batch), np.int64), np.diff(planes.offsets.to_numpy()))
        doc, of = members(planes.flatten().to_pylist())
        links = np.int64(1) << plane[of]
        np.add.at(best, doc, links * batch.column("is_best").to_numpy(zero_copy_only=False)[which[of]])
        np.add.at(total, doc, links * batch.column("count").to_numpy()[which[of]])
    out = figures.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(best[docs])).append_column("count_sum", pa.array(total[docs])).append_column("groups_sha256", figures["groups_sha256"])


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, count (documents that link them) and whether b is among the best of a."""
    counts = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("count"))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    return counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Figures, scores and the digest of the groups of every document."""
    spark = docs.sparkSession
    indexed = materialise(spark, index(docs, path_a, path_b), "pair-bitmaps")
    postings = indexed.where("a IS NOT NULL").select("container", "a", "b", "n_docs", "planes")
    counts = materialise(spark, pair_counts(postings), "pair-counts")
    scored = postings.join(counts, ["a", "b"]).select("container", "count", "is_best", "planes")
    figures = indexed.where("a IS NULL").select(F.col("container").alias("home"), "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return (
        scored.groupBy("container")
        .cogroup(figures.groupBy("home"))
        .applyInArrow(_score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    )
