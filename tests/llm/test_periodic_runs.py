import hashlib
import random
import re
import time
from fractions import Fraction
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axonframe.llm.periodic_runs import LEAST_WORDS, first_block, numbers_of, periodic_runs, planted, runs_digest, runs_of


def brute_runs(words, least=LEAST_WORDS):
    """Every period, every maximal stretch, and every smaller period of it."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if end > at and length >= max(least, 3 * q):
                stretch = words[at : at + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def row(r):
    return r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def test_first_block_leaves_room():
    for least in (24, 3, 100):
        b = first_block(least)
        assert b & (b - 1) == 0 and (b == 1 or 2 * b - 1 + b - 1 <= least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 12)), max_size=6))
def test_runs_of_repetitions(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert runs_of(numbers_of(words)) == brute_runs(words)


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for n in (0, 1, 23, 24, 25, 200, 700):
        words = [rng.randrange(letters) for _ in range(n)]
        for period in (1, 5, 8, 31, 64, 100):
            at = rng.randrange(n + 1)
            near = words[:at] + [words[at + i % period] if at + period < n else 0 for i in range(min(n, 4 * period))] + words[at:]
            assert runs_of(numbers_of(near)) == brute_runs(near)


def test_fibonacci_words_have_runs_in_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    words = [x for x in b for _ in range(2)] + b * 4
    assert runs_of(numbers_of(words)) == brute_runs(words)


def test_long_repetitions_take_linear_time():
    words = [0] * 400_000 + list(range(1, 1000)) * 5 + [1, 2] * 100_000
    began = time.time()
    assert runs_of(numbers_of(words)) == [(0, 400_000, 1), (400_000, 4_997, 999), (404_995, 200_000, 2)]  # the second goes on for a 1 and a 2
    assert time.time() - began < 60


def test_planted_words():
    ids = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0]
    for i in ids[:10]:
        words = list("abcdefghijklmnopqrstuvwxyz" * 3)
        out, g = planted(i, words), crc32(str(i).encode()) // 10
        a = g % 78
        p = 1 + (78 - a) // (3 + g % 8)
        assert out == [words[k] if k < a else words[a + (k - a) % p] for k in range(78)]
    assert planted(None, ["a"]) == ["a"] and planted(ids[0], []) == []


ROWS = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (None, "null id " * 30), (4, "a " * 24), (5, "a " * 23), (6, "a b " * 30 + "c"), (7, "x y z " * 40 + "x y"), (7, "x y z " * 40 + "x y"),
        (8, " ".join(f"w{i % 100}" for i in range(350))), (9, "z " * 50000), (10, "\U0001f600 é " * 20)]


def test_query_on_edges(spark):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in ROWS], "doc_id long, text string, runs int, _text string")
    got = sorted(map(row, runs_digest(docs).collect()), key=str)
    wanted = [brute_row(i, t) if i != 9 else None for i, t in ROWS]
    wanted = [w for w in wanted if w]
    assert [g for g in got if g[0] != 9] == sorted(wanted, key=str)
    nine = next(g for g in got if g[0] == 9)
    assert nine[1:6] == (1, 0, 50000, 1, 50000000)
    assert runs_digest(docs.limit(0)).count() == 0
    plain = periodic_runs(docs.where("doc_id = 7")).first()
    assert plain.collapsed == "x y z" and [tuple(x) for x in plain.runs] == [(0, 122, 3)]


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) <= 2500]
    got = {g[0]: g for g in map(row, runs_digest(docs.repartition(5)).collect())}
    assert len(got) == docs.count() and all(got[i] == brute_row(i, t) for i, t in short)
    assert sum(g[1] > 0 for g in got.values()) > 5
