"""Near-duplicate join on word shingles by multiple-global-order filtering (operator 1).

Two documents link when the Jaccard similarity of their sets of ``words``-word shingles reaches
``percent``.  The steps:

1. Documents with equal sets form a class; only classes go on.
2. Shared shingles are counted per class, exactly: a class of n shingles can only link if at least
   ``percent`` of them occur in another class.  Shingles travel as packed 32-bit marks, dealt by
   hash; each task sends a shingle once, however many of its documents have it.  The texts of the
   classes left are found by a join; a filter of fixed size keeps the other texts out of its shuffle.
3. The shingles of the classes left are put in a global order, rarest first; classes that share one
   of the first ``n - ceil(t n) + 1`` (the prefix) may link.  They are joined to the least class with
   that shingle only, never to each other, and the connected candidates form a group.
4. Groups are compared in tiles of at most two blocks of ``BLOCK`` classes.  Inside a tile a pair is a
   candidate if it shares a prefix shingle under *every one* of ``ORDERS`` more global orders;
   candidates are verified by counting.  A tile returns each class's links and a spanning forest.
5. The components of the forests are the result.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text with
fewer than ``words`` words is one shingle; rows that repeat a doc_id are documents of their own, copies
or not as their texts say; rows without doc_id link like others, and a component of such rows alone has
a null component_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components
from .textkit import LOWER_ASCII, ROW_KEY, Rolling, mix, numbers, owners, packed, per_slice, ragged, row_key, slices, texts_of, words

WORDS, PERCENT = 4, 85
ORDERS = 3
BLOCK = 256
#: Bits of the filter for a key and at most (8 MB), marks worked on at once; none changes a result.
KEY_BITS, FILTER_BITS, MARKS = 16, 1 << 26, 1 << 21

_WORD, _SHINGLE = Rolling(101), Rolling(111)
_ORDER = numbers(ORDERS, 121)


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row after row and sorted, and their number."""
    raw = LOWER_ASCII[raw]
    starts, ends, first = words(raw, off)
    word = _WORD.spans(raw, starts, ends)
    count = np.diff(first)
    whole = np.where((count > 0) & (count < n), 1, np.maximum(0, count - n + 1))
    begin = ragged(first[:-1], whole)
    row = np.repeat(np.arange(len(count)), whole)
    key = _SHINGLE.spans(word, begin, np.minimum(begin + n, first[1:][row]))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.bincount(row[new], minlength=len(count))


def _class_keys(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    ends = np.cumsum(count)
    out = []
    for k in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ k))])
        out.append(mix(total[ends] - total[ends - count] + count.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that must hold one of any partner's."""
    return n - -(-percent * n // 100) + 1


def digests(texts: DataFrame, n: int) -> DataFrame:
    """The row's key (``id``), n_shingles and the two class hashes."""

    def run(ids, raw, off):
        key, count = shingles(raw, off, n)
        one, two = _class_keys(key, count)
        return pa.RecordBatch.from_arrays([ids, pa.array(count.astype(np.int64)), pa.array(one), pa.array(two)], ["id", "n_shingles", "one", "two"])

    return texts.mapInArrow(per_slice(run), f"id {ROW_KEY}, n_shingles long, one long, two long")


def mark_parts(spark: SparkSession) -> int:
    """Parts the marks are dealt to: a class is named once in each part it has marks in, so fewer than other shuffles have."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, 16), most // 4)


def linkable(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``one`` (class hash) and ``lonely``: how many shingles of a class no other class has; classes without such ones are left out."""
    parts = mark_parts(texts.sparkSession)
    marks = "part int, owner binary, sizes binary, marks binary, common binary"

    def deal(ids, raw, off):
        key, count = shingles(raw, off, n)
        one, _ = _class_keys(key, count)
        # One document of each class; a shingle of several classes of this slice is common already.
        _, kept = np.unique(np.where(count > 0, one, 0), return_index=True)
        kept = kept[count[kept] > 0]
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(kept)), count[kept])
        key = key[ragged(begin[kept], count[kept])]
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        head = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        repeated = np.repeat(np.diff(np.append(np.flatnonzero(head), len(key))) > 1, np.diff(np.append(np.flatnonzero(head), len(key))))
        part, mark = (key % np.uint64(parts)).astype(np.int64), (key // np.uint64(parts)).astype(np.uint32)
        # Common shingles go once, without an owner.
        common = head & repeated
        common_part, common_mark = part[common], mark[common]
        by = np.argsort(common_part, kind="stable")
        common_count, common_mark = np.bincount(common_part, minlength=parts), common_mark[by]
        part, mark, owner = part[~repeated], mark[~repeated], owner[~repeated]
        by = np.lexsort((owner, part))
        part, mark, owner = part[by], mark[by], owner[by]
        pair = np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])) if len(part) else np.zeros(0, bool)
        heads = np.flatnonzero(pair)
        sizes = np.diff(np.append(heads, len(part)))
        owners_in = np.bincount(part[heads], minlength=parts)
        rows = [
            pa.array(np.arange(parts, dtype=np.int32)), packed(one[kept][owner[heads]], owners_in), packed(sizes.astype(np.uint32), owners_in),
            packed(mark, np.bincount(part, minlength=parts)), packed(common_mark, common_count),
        ]
        return pa.RecordBatch.from_arrays(rows, marks_names)

    marks_names = [f.split()[0] for f in marks.split(", ")]

    def meet(key, table):
        """Of one part: how many shingles each class has, and how many of them another class has."""
        column = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        owner, sizes = column("owner", np.int64), column("sizes", np.uint32).astype(np.int64)
        mark, common = column("marks", np.uint32), np.unique(column("common", np.uint32))
        classes, which = np.unique(owner, return_inverse=True)
        which = np.repeat(which.astype(np.uint32), sizes)
        lonely = np.zeros(len(classes), np.int64)
        # Equal marks come into one share.
        shares = np.uint32(-(-len(mark) // MARKS) or 1)
        share = mark % shares
        for i in range(shares):
            here = share == i
            # A class may come from several slices: count each of its marks once.
            pair = np.unique(mark[here].astype(np.uint64) << np.uint64(32) | which[here].astype(np.uint64))
            own = (pair >> np.uint64(32)).astype(np.uint32)
            same = own[1:] == own[:-1]
            alone = ~(np.append(same, False) | np.append(False, same)) & ~np.isin(own, common) if len(own) else np.zeros(0, bool)
            lonely += np.bincount((pair[alone] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(classes))
        classes, lonely = classes[lonely > 0], lonely[lonely > 0]
        home = (classes.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        here = np.bincount(home, minlength=parts)
        return pa.table({"home": pa.array(np.arange(parts, dtype=np.int32)), "classes": packed(classes[by], here), "lonely": packed(lonely[by].astype(np.uint32), here)})

    def add(key, table):
        """Of one home: shingles that no other class has, per class."""
        column = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        classes, which = np.unique(column("classes", np.int64), return_inverse=True)
        return pa.table({"one": classes, "lonely": np.bincount(which, column("lonely", np.uint32), minlength=len(classes)).astype(np.int64)})

    return (
        texts.mapInArrow(per_slice(deal), marks)
        .groupBy("part").applyInArrow(meet, "home int, classes binary, lonely binary")
        .groupBy("home").applyInArrow(add, "one long, lonely long")
    )


def may_hold(keys: DataFrame) -> Callable[[Column], Column]:
    """A test for a key of ``keys`` (key): always true for one of them, mostly false for others.

    A Bloom filter of two bits a key.  With so many keys that its fixed size is full it is true for more of the others.
    """
    spark = keys.sparkSession
    size = min(FILTER_BITS, max(1 << 15, 1 << (KEY_BITS * keys.count()).bit_length()))
    bits = F.explode(F.array(F.col("key").bitwiseAND(size - 1), F.shiftrightunsigned("key", 32).bitwiseAND(size - 1))).alias("bit")
    # Bits and their buckets are counted from 1.
    bit = F.col("bit") + 1
    buckets = keys.select(bits).groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    whole = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in buckets.toLocalIterator():
        whole[r.bucket - 1] = np.frombuffer(r.bitmap, np.uint8)
    held = spark.sparkContext.broadcast(whole.reshape(-1))

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        value = key.to_numpy().view(np.uint64)
        out = np.ones(len(value), bool)
        for at in (value, value >> np.uint64(32)):
            at = (at & np.uint64(size - 1)).astype(np.int64)
            out &= held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return pd.Series(out)

    return may


def texts_for(texts: DataFrame, able: DataFrame) -> DataFrame:
    """node, text and weight of each of ``able`` (node, weight, key); a text that is not of the class may come by an equal key."""
    keyed = texts.withColumn("key", F.xxhash64("id"))
    # The texts are dealt by their key already, so that a repeated row goes before it is dealt again.
    found = keyed.where(may_hold(able)("key")).join(able, "key").dropDuplicates(["key", "id", "node"])
    return found.select("node", "text", F.col("weight").cast("long").alias("weight"))


def sets(texts: DataFrame, n: int) -> DataFrame:
    """node (a class), weight and the sorted shingle hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                key, count = shingles(raw, off, n)
                one, two = _class_keys(key, count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), packed(key, count), pa.array(one), pa.array(two)],
                    ["node", "weight", "tokens", "one", "two"],
                )

    # A text that is not of the class came by an equal key.
    return texts.mapInArrow(run, "node long, weight long, tokens binary, one long, two long").where(F.col("node") == F.xxhash64("one", "two")).drop("one", "two")


def _ranked(key: np.ndarray, row: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Positions of all shingles, each row's in the given global order."""
    return np.lexsort((mix(key ^ _ORDER[order]), row))


def groups(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, component): classes that prefixes under the rarest-first order connect."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                node = batch.column(0).slice(lo, hi - lo).take(pa.array(owners(off // 8)))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), node], ["token", "node"])

    entries = nodes.select("node", "tokens").mapInArrow(spread, "token long, node long")
    common = entries.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    met = entries.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("met"))
    # Shingles of one class come first in the order and fill the prefix without meeting anything.
    size = nodes.select("node", (F.octet_length("tokens") / 8).cast("int").alias("n"))
    left = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1 - (F.col("n") - F.size("met"))
    prefix = met.join(size, "node").select("node", F.explode(F.slice("met", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))["token"]).alias("token"))
    prefix = materialise(nodes.sparkSession, prefix, "prefixes")
    lists = prefix.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot <> top").select("token", "pivot")
    return connected_components(prefix.join(lists, "token").select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def _shared(member: np.ndarray, row: np.ndarray, column: np.ndarray, rows: int) -> np.ndarray:
    """How many of the flagged (row, column) entries each two rows have in common."""
    out = np.zeros((rows, rows), np.float32)
    row, column = row[member], column[member]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            block = np.zeros((rows, width), np.float32)
            block[row[a:b], column[a:b] - k * width] = 1
            out += block @ block.T
    return out


def links(tokens: list[bytes], side: np.ndarray, percent: int) -> np.ndarray:
    """Which classes of a tile link; ``side`` is 0 or 1, and two sides are compared across only."""
    rows = len(tokens)
    n = np.array([len(t) // 8 for t in tokens])
    first = np.concatenate([[0], np.cumsum(n)])
    key, row = np.frombuffer(b"".join(tokens), np.uint64), owners(first)
    distinct, column, times = np.unique(key, return_inverse=True, return_counts=True)
    # Shingles of one class only cannot be shared; the others are numbered anew.
    met = times > 1
    number = np.cumsum(met) - 1
    live = met[column]
    column = number[column]
    candidate = ~np.eye(rows, dtype=bool)
    if side.any():
        candidate &= side[:, None] != side[None, :]
    for order in range(ORDERS):
        at = _ranked(key, row, first, order)
        taken = np.zeros(len(key), bool)
        taken[at] = np.arange(len(key)) - first[:-1][row] < prefix_length(n, percent)[row]
        candidate &= _shared(taken & live, row, column, rows) > 0
        if not candidate.any():
            return candidate
    both = _shared(live, row, column, rows).astype(np.int64)
    return candidate & (100 * both >= percent * (n[:, None] + n[None, :] - both))


def compare(nodes: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """(node, root, links): a spanning forest of the links of every tile, and the documents linked to."""
    size = grouped.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = grouped.join(size, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = nodes.join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "weight", "tokens"
    )

    def tile(key, table):
        node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
        side = (table["block"].to_numpy() != key[1].as_py()).astype(int)
        linked = links(table["tokens"].to_pylist(), side, percent)
        root = np.arange(len(node))
        for i in range(len(node)):
            # A breadth-first tree from every node not reached yet.
            if root[i] == i and linked[i].any():
                seen = front = np.arange(len(node)) == i
                while front.any():
                    front = linked[front].any(axis=0) & ~seen
                    seen = seen | front
                root[seen] = i
        degree = linked @ weight
        has = linked.any(axis=0)
        return pa.table({"node": node[has], "root": node[root][has], "links": degree[has].astype(np.int64)})

    return tiles.groupBy("component", "low", "high").applyInArrow(tile, "node long, root long, links long")


def _resolved(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id (the row's key), n_shingles, keeper (the id that stands for the component) and n_links of every row."""
    spark = docs.sparkSession
    texts = texts_of(docs).select(row_key().alias("id"), "text")
    marked = materialise(spark, digests(texts, words), "shingle-classes")
    # The least doc_id stands for a class; rows without one come last.
    first = F.min(F.struct(F.col("id.doc_id").isNull().alias("unnamed"), "id")).alias("first")
    classes = marked.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(first, F.count("*").alias("weight")).withColumn("node", F.xxhash64("one", "two"))
    lonely = linkable(texts, words, percent)
    able = classes.join(lonely, "one", "left").where(100 * (F.col("n_shingles") - F.coalesce("lonely", F.lit(0))) >= percent * F.col("n_shingles"))
    # One 64-bit key finds the text, and ``sets`` tells whether it is the right one.
    able = materialise(spark, able.select("node", F.col("weight").cast("int").alias("weight"), F.xxhash64("first.id").alias("key")), "linkable-classes")
    nodes = materialise(spark, sets(texts_for(texts, able), words), "shingle-sets")
    found = materialise(spark, compare(nodes, groups(nodes, percent), percent), "links")
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    keepers = joined.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("keeper"))
    keeper = joined.join(keepers, "component").select("node", "keeper")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    resolved = classes.join(keeper, "node", "left").join(degree, "node", "left").select(
        "one", "two", "n_shingles",
        F.coalesce("keeper", "first")["id"].alias("keeper"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("others"),
    )
    return marked.join(resolved, ["one", "two", "n_shingles"], "left").select(
        "id", "n_shingles", F.coalesce("keeper", "id").alias("keeper"), F.coalesce("others", F.lit(0)).alias("n_links")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents it links with) of every document."""
    return _resolved(docs, words, percent).select(F.col("id.doc_id").alias("doc_id"), "n_shingles", F.col("keeper.doc_id").alias("component_id"), "n_links")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Rows that repeat both doc_id and text of the one that stays are the same row to this stage and stay too.
    """
    gone = _resolved(docs, words, percent).where("id <> keeper").select(F.col("id").alias("_gone")).distinct()
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("mark"))
    return docs.join(gone, key == gone["_gone"], "left_anti")
