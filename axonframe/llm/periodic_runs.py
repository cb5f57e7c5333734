"""Periodic runs of words: blocks of words are searched across their document, and what recurs at a fitting distance is extended."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import values

#: Words of a run at least, and periods that it has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that are compared at first when a seed is extended; twice as many each time.
FIRST_STRIDE = 16

Run = tuple[int, int, int]


def numbers_of(words: Sequence) -> np.ndarray:
    """Words as numbers from 0 by first appearance."""
    table = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))


def first_block(least_words: int = LEAST_WORDS) -> int:
    """The smallest power of two from which blocks find all periods: a run of `least_words` and more holds an aligned
    block B and the same block one period on if 2 B - 1 + period is no more than its length, for all periods under B."""
    block = 1
    while 2 * (2 * block) - 1 + 2 * block - 1 <= least_words:
        block *= 2
    return block


def seeds(seq: np.ndarray, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(B, places, distances): the aligned block of B words at a place stands again so many words on, for every distance
    that fits; smaller blocks first.

    Blocks of B words serve periods from B to 2 B - 1, the smallest also all below. A run of three periods and more has
    room for an aligned block and the same block one period on, so every run has a seed whose distance is its period. All
    aligned blocks of a size are the keys of one automaton, and the document is read through it once. A size at which
    no block stands twice ends the search: of a larger block the parts would too.

    Keys are as long for all sizes: of blocks twice as large each number stands for twice as many words, and the document
    is read once for every word that such a stretch can begin at. So no key has a long end that is its own beginning,
    which would make each step of the automaton as dear as the key is long.
    """
    n, size = len(seq), first_block(least_words)
    names, wide, least = seq + 1, 1, 1  # names[i]: a number, from 1, for the `wide` words from i on
    while (block := size * wide) + least <= n and (wide == 1 or LEAST_PERIODS * block <= n):
        starts = np.arange(0, n - block + 1, block)
        known: dict[tuple, int] = {}
        which = np.fromiter((known.setdefault(tuple(key), len(known)) for key in names[starts[:, None] + wide * np.arange(size)].tolist()), dtype=np.int64, count=len(starts))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, value in known.items():
            automaton.add_word(key, value)
        automaton.make_automaton()
        # a line for every phase, ended by a zero, which is in no key
        turns = -(-len(names) // wide) + 1
        lines = np.zeros((turns, wide), dtype=np.int64)
        lines.ravel()[: len(names)] = names
        hits = np.fromiter((x for hit in automaton.iter(tuple(lines.T.ravel().tolist())) for x in hit), dtype=np.int64).reshape(-1, 2)
        if len(hits) == len(starts) == len(known):
            return  # every block only met itself
        at, found = hits[:, 0] // turns + (hits[:, 0] % turns - (size - 1)) * wide, hits[:, 1]
        # the aligned blocks that lie from `least` to 2 B - 1 words before an occurrence
        for back in (0, 1, 2) if wide == 1 else (1,):
            own = at // block - back
            distance = at - own * block
            fits = (own >= 0) & (distance >= least) & (distance < 2 * block)
            own, distance, same = own[fits], distance[fits], found[fits]
            same = (own < len(which)) & (which[np.minimum(own, len(which) - 1)] == same)
            if same.any():
                yield block, own[same] * block, distance[same]
        _, pairs = np.unique(names[:-wide] * (int(names.max()) + 1) + names[wide:], return_inverse=True)
        names, wide, least = pairs + 1, 2 * wide, 2 * block


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Words at the start that two sequences have in common."""
    n, at, stride = min(len(a), len(b)), 0, FIRST_STRIDE
    while at < n:
        differ = np.flatnonzero(a[at : at + stride][: n - at] != b[at : at + stride][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, stride = at + stride, 2 * stride
    return n


def _primes(n: int) -> list[int]:
    found, k = [], 2
    while k * k <= n:
        if n % k == 0:
            found.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return found + [n] * (n > 1)


def runs_of(seq: np.ndarray, least_words: int = LEAST_WORDS) -> list[Run]:
    """(start, length, period) of all runs, by start, then period: the maximal stretches with that smallest period, of at
    least max(least_words, three periods) words.

    A seed is extended word by word to both sides as long as words one distance apart are the same. What is long enough
    and has no smaller period is a run. (A smaller period of a stretch of three periods divides it.) A seed whose two
    blocks lie in a run of a period up to the block's size is passed over: that run and the seed's share at least the sum
    of their periods, so the seed's would have a smaller one. So a word over and over costs no more than any other text.
    """
    if len(seq) < least_words:
        return []
    found: set[Run] = set()
    inside = np.zeros(len(seq), dtype=np.int64)  # where the run ends that holds a word and goes on longest
    for block, places, distances in seeds(seq, least_words):
        if block > first_block(least_words):
            new = inside[places] < places + distances + block
            places, distances = places[new], distances[new]
        order = np.lexsort((places, distances))
        period, until = 0, -1
        for at, distance in zip(places[order].tolist(), distances[order].tolist()):
            if distance == period and at < until:
                continue  # in the stretch that was extended last
            later = seq[distance:]
            start = at - _alike(seq[:at][::-1], later[:at][::-1])
            until = at + _alike(seq[at : len(seq) - distance], later[at:])
            period, length = distance, until + distance - start
            if length < max(least_words, LEAST_PERIODS * period):
                continue
            stretch = seq[start : start + length]
            if not any(np.array_equal(stretch[period // p :], stretch[: length - period // p]) for p in _primes(period)):
                found.add((start, length, period))
                inside[start : start + length] = np.maximum(inside[start : start + length], start + length)
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    keep = np.ones(n, dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def planted(doc_id: int | None, words: list) -> list:
    """Words with a repetition planted in every tenth document, by the CRC of its id: where the CRC h is divisible by ten,
    with g = h // 10, word a = g % n and all after it become repeats of p = 1 + (n - a) // (3 + g % 8) words. Without an
    id nothing is planted."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ceil((n - a) / p))[: n - a]


RUN_TYPE = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, prepare: Callable[[object, list], list] | None = None) -> DataFrame:
    """id_col, runs (array of start, length, period, by start and period) and collapsed (the words that stay, with one
    space between them) of every row of docs. Words are runs of bytes other than space, tab, line feed, vertical tab,
    form feed and carriage return.

    prepare may replace the words of a document, by its id, before runs are searched. Every document is one row of work:
    there is no shuffle, and memory is that of one document's words and the automaton of its blocks of one size. Null text
    has no words and no runs; null ids and repeated rows are rows like any other; an empty table gives an empty result;
    other columns are ignored.
    """
    kept = docs.select(id_col, F.col(text).cast("binary").alias("_text"))
    schema = kept.select(id_col).schema.add("runs", T.ArrayType(RUN_TYPE)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, len(batch), 256):
                found, collapsed = [], []
                for doc_id, body in zip(ids.slice(at, 256).to_pylist(), values(texts.slice(at, 256))):
                    words = (body or b"").split()
                    if prepare:
                        words = prepare(doc_id, words)
                    runs = runs_of(numbers_of(words), least_words) if len(words) >= least_words else []
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(found, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def runs_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of greatest length / period (on ties the
    smallest start, then period; nulls without a run), runs_sha256 and collapsed_sha256 of every row of docs, with
    repetitions planted as in `planted`."""
    found = periodic_runs(docs, prepare=planted)
    none = F.lit(None).cast(RUN_TYPE)
    # runs are in order, so on ties the first stays; lengths and periods are compared as whole numbers
    best = F.aggregate("runs", none, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{x}").alias(x) for x in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
