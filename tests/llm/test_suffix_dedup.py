import hashlib
import random

import numpy as np
import pytest

from axonframe.llm.suffix_dedup import Settings, anchors_of, front_coded, decoded, merged, remove_repeats, repeats_digest, shared_with_next, _ENTRY, _strings


def brute(texts, length):
    """n_bytes, n_removed, spans and kept of each text, from the places of every string."""
    bodies = [(t or "").encode() for t in texts]
    places = {}
    for k, body in enumerate(bodies):
        for at in range(len(body) - length + 1):
            places.setdefault(body[at : at + length], []).append((k, at))
    gone = [bytearray(len(b)) for b in bodies]
    for found in places.values():
        if len(found) > 1:
            for k, at in found:
                gone[k][at : at + length] = b"\1" * length
    out = []
    for body, mask in zip(bodies, gone):
        edges = np.diff(np.frombuffer(b"\0" + bytes(mask) + b"\0", dtype=np.int8))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((len(body), sum(mask), spans, bytes(c for c, m in zip(body, mask) if not m)))
    return out


def check(spark, texts, s, parts=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in remove_repeats(docs, s=s).collect()}
    assert got == dict(enumerate(brute(texts, s.length)))
    return got


def made_up(seed, n, length):
    """Texts with copies, near copies, passages that many share before and after other words, and repeats within a text."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    common, texts = text(3 * length), []
    for _ in range(n):
        kind, size = rng.randrange(8), rng.randrange(6 * length)
        old = rng.choice(texts) if texts else ""
        cut = rng.randrange(len(old) + 1)
        at, to = sorted((rng.randrange(len(common)), rng.randrange(len(common))))
        texts.append([text(size), old, old[:cut] + rng.choice("xyz") + old[cut:], text(size) + common[at:to] + text(size // 3), text(4) + common + text(4), text(length // 3) * rng.randrange(9), rng.choice("ab") * size, old[cut:] + text(5) + old[:cut]][kind])
    return texts


@pytest.mark.parametrize("length", [8, 13, 40, 200])
def test_equals_brute_force(spark, length):
    got = check(spark, [*made_up(length, 90, length), None, "", "a" * length, "é" * length], Settings(length=length, block_bytes=40 * length, chunk=11 * length, run_bytes=200 * length * length, part_bytes=100 * length * length))
    assert sum(x[1] > 0 for x in got.values()) > 20


def test_hot_beginnings_are_dealt_out(spark):
    """A beginning that fills whole ranges is split over tasks, and windows are counted across them."""
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    common = text(90)
    texts = [text(rng.randrange(40)) + common + text(rng.randrange(40)) for _ in range(120)] + [text(3) + "q" * rng.randrange(100) + text(3) for _ in range(40)]
    check(spark, texts, Settings(length=40, block_bytes=300, run_bytes=2000, part_bytes=1000), parts=8)


def test_partitions_and_null_ids(spark):
    texts = made_up(5, 60, 30)
    rows = [(None if k % 7 == 0 else k // 2, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_bytes int, block string")
    wanted = sorted((str(r[0]), b[0], b[1], len(b[2]), hashlib.sha256(b[3]).hexdigest()) for r, b in zip(rows, brute(texts, 30)))
    for parts in (1, 4, 13):
        got = remove_repeats(docs.repartition(parts), s=Settings(length=30, block_bytes=500), outputs=("kept_sha256",))
        assert got.schema["doc_id"].dataType.simpleString() == "int"
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == wanted
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, outputs=("nothing",))
    with pytest.raises(ValueError):
        remove_repeats(docs, s=Settings(length=5))


def test_digest_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    wanted = sorted((r.doc_id, b[0], b[1], len(b[2]), hashlib.sha256(b[3]).hexdigest()) for r, b in zip(rows, brute([r.text for r in rows], 200)))
    got = repeats_digest(docs.repartition(3))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_anchors_of_equal_windows_are_at_the_same_place():
    rng, s = random.Random(1), Settings(length=50)
    text = bytes(rng.randrange(97, 100) for _ in range(3000))
    body = text[:700] + b"middle" + text[300:1000] + text[2000:]
    anchors = anchors_of(body, np.array([len(body) - 40, 40]), s)
    place = {at: a - at for a, lo, hi in anchors.tolist() for at in range(lo, hi + 1)}
    assert sorted(place) == list(range(len(body) - 40 - 50 + 1))
    seen = {}
    assert all(seen.setdefault(body[at : at + 50], back) == back for at, back in place.items())


@pytest.mark.parametrize("k", [1, 2, 3, 7, 20])
def test_loser_tree_merges_front_coded_runs(k):
    rng = np.random.default_rng(k)
    tables = []
    for _ in range(k):
        table = rng.integers(97, 99, (rng.integers(1, 60), 12)).astype(np.uint8)
        tables.append(table[np.argsort(_strings(table), kind="stable")])
    runs = [decoded(front_coded(t, np.zeros(len(t), dtype=_ENTRY)), 12)[1:] for t in tables]
    out = list(merged(runs))
    strings = [x[2] for x in out]
    assert strings == sorted(row.tobytes() for t in tables for row in t)
    assert [x[1] for x in out][1:] == shared_with_next(np.array([list(x) for x in strings])).tolist()
    assert sorted(x[0] for x in out) == sorted(i for i, t in enumerate(tables) for _ in t)
