"""Language identification by cross-parsing entropy (operator 4).

For every language a bounded sample of labelled text (a stretch of each of at most ``DOCS_PER_LANGUAGE``
documents, ``SAMPLE_CHARS`` characters in all) is turned into a suffix automaton.  A text is cut greedily into
phrases, each the longest stretch that occurs in that sample; its cost in a language is
``phrases * log2(longest sample) / characters``, and the language with the least cost wins.  The price of a
phrase is the same in all languages: priced by its own sample, a language with hardly any labelled text would
buy its phrases for next to nothing and win everywhere.  All texts of a slice walk the automata side by side,
in lanes of ``LANE`` characters; in longer texts phrases end at lane ends, for every language alike.

Letters are compared in lower case and runs of other characters as one space.  The ``OWN_CLASSES`` commonest
letters of the samples stand for themselves, all others share ``SHARED_CLASSES`` by their code point; no letter
is left out.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no language was
learned; equal costs go to the alphabetically first language; null lang values are not learned from;
rows without doc_id are predicted too (held_out is null, never learned from); repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import crc_share, slices, texts_of

DOCS_PER_LANGUAGE = 64
SAMPLE_CHARS = 20_000
LANE = 4096
OWN_CLASSES, SHARED_CLASSES = 63, 32
CLASSES = 1 + OWN_CLASSES + SHARED_CLASSES
HELD_OUT_PARTS, HELD_OUT = 4, 2
_APART = "﷐"  # a code point that no text may contain; stands between rows


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automata:
    """Suffix automata of the languages' samples over one alphabet, as a single table."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        lower = {lang: samples[lang].lower() for lang in self.languages}
        counts = Counter(c for text in lower.values() for c in text if c.isalpha())
        # 0: anything but letters; then the commonest letters, then classes that the other letters share.
        alphabet = sorted(counts, key=lambda c: (-counts[c], c))[:OWN_CLASSES]
        shared = 1 + OWN_CLASSES + np.arange(0x110000) % SHARED_CLASSES
        self.classes = np.where(_letters(), shared, 0).astype(np.uint8)
        for k, c in enumerate(alphabet):
            self.classes[ord(c)] = k + 1
        tables, base, longest = [], 0, 2
        self.roots = np.zeros(max(1, len(self.languages)), np.int64)
        for k, lang in enumerate(self.languages):
            symbols = self.simplify(self.classes[_code_points(lower[lang])])
            table = _suffix_automaton(symbols)
            self.roots[k] = base
            tables.append(np.where(table >= 0, table + base, -1))
            longest = max(longest, len(symbols))
            base += len(table)
        self.bits = np.log2(longest)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        # Where a phrase starts anew: the root's own transition, or the root if it has none.
        self.restart = np.zeros((len(self.languages), CLASSES), np.int32)
        for k, root in enumerate(self.roots[: len(self.languages)]):
            own = self.table[root * CLASSES : (root + 1) * CLASSES]
            self.restart[k] = np.where(own >= 0, own, root)

    @staticmethod
    def simplify(symbols: np.ndarray) -> np.ndarray:
        """Runs of class 0 as one."""
        stays = symbols != 0
        stays[1:] |= symbols[:-1] != 0
        return symbols[stays]

    def phrases(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each row in each language (languages x rows)."""
        length = np.diff(off)
        lanes = np.maximum(1, -(-length // LANE))
        row = np.repeat(np.arange(len(length)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = off[:-1][row] + nth * LANE
        size = np.minimum(LANE, off[1:][row] - start)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        state = np.repeat(self.roots[: len(self.languages), None], len(row), axis=1).astype(np.int32)
        count = np.ones((len(self.languages), len(row)), np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            c = symbols[start[:live] + t]
            at = state[:, :live] * CLASSES
            at += c
            after = self.table[at]
            miss = after < 0
            count[:, :live] += miss
            state[:, :live] = np.where(miss, self.restart[:, c], after)
        return np.stack([np.bincount(row, count[k], minlength=len(length)) for k in range(len(self.languages))])


def _suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Transition table (states x CLASSES, -1: none) of all substrings of ``symbols``."""
    table = [[-1] * CLASSES]
    link, longest, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(table)
        table.append([-1] * CLASSES)
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and table[p][c] < 0:
            table[p][c] = new
            p = link[p]
        if p >= 0:
            q = table[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                clone = len(table)
                table.append(table[q][:])
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and table[p][c] == q:
                    table[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return np.array(table, np.int32)


@lru_cache(maxsize=2)
def _automata(samples: tuple[tuple[str, str], ...]) -> Automata:
    return Automata(dict(samples))


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A bounded sample of labelled text per language, from documents that are not held out.

    Every sampled document gives an equal stretch from a place in it that its id decides, so that no single
    text is the model of a language.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang")).where(
        F.col("_lang").isNotNull() & F.col("_id").isNotNull() & (crc_share("_id", HELD_OUT_PARTS) != HELD_OUT)
    )
    # Spark cuts each task's rows to the first of every language before it shuffles.
    by_hash = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    taken = known.withColumn("_nth", F.row_number().over(by_hash)).where(F.col("_nth") <= docs_per_language)
    share = -(-chars // docs_per_language)
    start = F.pmod(F.xxhash64("_nth", F.lit("place")), F.greatest(F.length("text") - share + 1, F.lit(1))).cast("int") + 1
    texts = (
        texts_of(docs, F.col("lang").cast("string").alias("lang"))
        # docs_per_language ids of each language.
        .join(F.broadcast(taken), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .select("_lang", "_nth", F.substring("text", start, F.lit(share)).alias("text"))
    )
    samples: dict[str, str] = {}
    # ``share`` characters of ``docs_per_language`` documents each.
    for r in sorted(texts.collect(), key=lambda r: (r["_lang"], r["_nth"], r["text"])):
        samples[r["_lang"]] = samples.get(r["_lang"], "") + " " + r["text"]
    return samples


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    samples = learn(docs) if samples is None else samples
    # SAMPLE_CHARS characters of each language.
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _automata(sent.value)
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                lang, score = _decide(model, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_share("doc_id", HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def _decide(model: Automata, texts: list[str]) -> tuple[list[str], np.ndarray]:
    joined = _APART.join(t.replace(_APART, " ") for t in texts).lower() + _APART
    points = _code_points(joined)
    symbols = model.classes[points]
    ends = np.flatnonzero(points == ord(_APART))
    # Runs of other characters become one space, but never across rows.
    stays = symbols != 0
    stays[1:] |= symbols[:-1] != 0
    stays[ends] = False
    total = np.zeros(len(stays) + 1, np.int64)
    np.cumsum(stays, out=total[1:])
    letters = np.zeros(len(stays) + 1, np.int64)
    np.cumsum(symbols != 0, out=letters[1:])
    begins = np.concatenate([[0], ends[:-1] + 1])
    has_letter = letters[ends] > letters[begins]
    off = np.concatenate([[0], total[ends]])
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    cost = model.phrases(symbols[stays], off) * model.bits / np.maximum(1, np.diff(off))
    best = np.argmin(cost, axis=0)
    least = cost.min(axis=0)
    # How far the winner is ahead: its share of the inverse costs, all languages counted.
    share = (1 / least) / (1 / cost).sum(axis=0)
    lang = [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), has_letter.tolist())]
    return lang, np.where(has_letter, share, 0.0)


def keep_identified(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` in which a language is found, with all their columns."""
    known = identify(docs, samples).where("lang_pred <> 'und'").select(F.col("doc_id").alias("_known")).distinct()
    return docs.join(known, docs["doc_id"].cast("long") == known["_known"], "left_semi")
