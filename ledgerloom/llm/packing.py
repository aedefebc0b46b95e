"""Best-fit packing of token sequences with certified bin counts (operator 2).

Documents become token ids (plus an end token) and are cut only if they are longer than a sequence.
The pieces are dealt to parts of about ``PIECES_PER_PART``; each part packs its own by best-fit
decreasing.  Dual feasible functions give a lower bound on the sequences that the part needs: where
the bound is met, the part is certified and done.  The other parts give the pieces of their
sequences that are not full to a common pool, which is dealt anew and packed again, ``ROUNDS``
times at most; the last packing stands.

Only ids, lengths and what else the caller keeps move between tasks.  Defined results: a null or
empty text is the end token alone; repeated rows are packed once each; rows without doc_id are packed
too; an empty table gives an empty result; extra columns of ``documents`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .textkit import Rolling, packed, ragged, slices, texts_of

CAPACITY = 1024
END_TOKEN = 2
PIECES_PER_PART = 50_000
ROUNDS = 3
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_HASH = Rolling(201)
_CACHED, _CACHED_BYTES = 300_000, 48
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True


class Encoder:
    """Token ids of many texts; stretches that recur are encoded once.

    A text may be cut before a space that stands between two visible ASCII characters: byte-level
    pre-tokenisation always starts a token there, so the ids of the parts are the ids of the whole.
    With ``ranks``, the same vocabulary as merge ranks, stretches without a special token are encoded
    by the faster of the two libraries that read it; the ids are the tokenizer's either way.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special: list[str] = []
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens={})
        self.known: dict[bytes, np.ndarray] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if any(x in t for x in self.special) else self.fast.encode_ordinary(t), np.uint32)
            for t in texts
        ]

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, row after row, and the number of ids of each row."""
        rows = len(off) - 1
        cut = np.zeros(len(raw), bool)
        cut[1:-1] = (raw[1:-1] == 0x20) & _GRAPH[raw[:-2]] & _GRAPH[raw[2:]]
        cut[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        ends = np.append(starts[1:], len(raw))
        _, at, which = np.unique(_HASH.spans(raw, starts, ends), return_index=True, return_inverse=True)
        data = raw.tobytes()
        parts = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(self.known) > _CACHED:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        found = self.known
        if new:
            fresh = dict(zip(new, self._encode([p.decode() for p in new])))
            self.known.update((p, e) for p, e in fresh.items() if len(p) <= _CACHED_BYTES)
            found = self.known | fresh if len(fresh) < len(new) or any(len(p) > _CACHED_BYTES for p in new) else self.known
        per_part = [found[p] for p in parts]
        size = np.fromiter(map(len, per_part), np.int64, len(per_part))
        begin = np.cumsum(size) - size
        ids = np.concatenate(per_part)[ragged(begin[which], size[which])]
        total = np.concatenate([[0], np.cumsum(size[which])])
        first = np.searchsorted(starts, off)
        return ids, total[first[1:]] - total[first[:-1]]


@lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None) -> Encoder:
    import os

    # A task has one core; the encoder's own threads would take others'.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, ranks)


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of every piece; only the first piece of a row may be shorter."""
    pieces = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), pieces)
    nth = ragged(np.zeros(len(counts), np.int64), pieces)
    short = counts - (pieces - 1) * capacity
    start = np.where(nth == 0, 0, short[row] + (nth - 1) * capacity)
    return row, nth, start, np.where(nth == 0, short[row], capacity)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ranks = tokenizer, None
        if path is None:
            import public_tokenizers

            path, ranks = str(public_tokenizers.path(TOKENIZER)), str(public_tokenizers.path(RANKS))
        encoder = _encoder(path, ranks)
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                ids, counts = encoder.ids(raw, off)
                whole = np.full(len(ids) + hi - lo, end_token, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), counts)] = ids
                row, nth, start, length = cut(counts + 1, capacity)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), packed(whole.astype("<u4"), length)],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by dual feasible functions over the lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(lengths.sum()) // capacity)
    # Rounding functions u(k): x stays if (k + 1) x / capacity is whole, else its floor counts capacity / k.
    for k in range(1, 33):
        scaled = np.where((k + 1) * size % capacity == 0, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((scaled * count).sum()) // (k * capacity)))
    # Threshold functions: items above capacity - t alone, those over half apart, those below t ignored.
    number, total = np.cumsum(count), np.cumsum(count * size)
    half = capacity // 2
    for t in range(1, half + 1):
        large = number[capacity] - number[capacity - t]
        middle = number[capacity - t] - number[half]
        middle_sum = total[capacity - t] - total[half]
        small_sum = total[half] - total[t - 1]
        best = max(best, int(large + middle + max(0, -(-int(small_sum - (middle * capacity - middle_sum)) // capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item (longest first, earlier items first among equals), and the fill of the bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        if left:
            open_by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.bincount(bins, lengths, minlength=n_bins).astype(np.int64)


def place(parts: DataFrame, capacity: int = CAPACITY, pieces_per_part: int = PIECES_PER_PART, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length; other columns stay as they are."""
    spark = parts.sparkSession
    columns = parts.columns
    schema = T.StructType(
        [*parts.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")), T.StructField("_settled", T.BooleanType())]
    )
    pool, settled = parts, None
    for turn in range(rounds):
        dealt = max(1, -(-pool.count() // pieces_per_part))
        last = turn == rounds - 1

        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(dealt)).alias("_part")
        packed_now = materialise(spark, pool.select("*", part).groupBy("_part").applyInArrow(_packer(turn, last, capacity, schema), schema), f"packing-{turn}")
        now = packed_now.where("_settled").drop("_settled")
        settled = now if settled is None else settled.unionByName(now)
        pool = packed_now.where("NOT _settled").select(*columns)
        if last or pool.isEmpty():
            break
    return settled


def _packer(turn: int, last: bool, capacity: int, schema: T.StructType):
    """Packs one part, and tells which of its sequences are final."""

    def run(key, table):
        from pyspark.sql.pandas.types import to_arrow_schema

        table = table.drop_columns(["_part"]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        done = np.full(len(fill), last or len(fill) == lower_bound(lengths, capacity)) | (fill == capacity)
        sequence = (turn << 58) + (key[0].as_py() << 26) + bins
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("_settled", done[bins])):
            table = table.append_column(name, pa.array(values))
        return table.cast(to_arrow_schema(schema))

    return run


def pack(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their places; ``ids_crc32`` stands for the ids, which ``pieces`` gives."""
    digest = pieces(docs, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    # Tokenised once: both the count and every round read this table.
    return place(materialise(docs.sparkSession, digest, "pieces"), options.get("capacity", CAPACITY)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
