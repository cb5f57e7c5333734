import random
from collections import Counter

from axonframe.llm.decontaminate import drop_contaminated, find_contamination

SCHEMA = "doc_id long, text string, item_id long, n int, doc_key string"


def brute(docs, items, least=0.8, k=5):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if i is None or len(v) < k:
                continue
            want = Counter(tuple(v[p : p + k]) for p in range(len(v) - k + 1))
            for s in range(len(w) - len(v) + 1):
                x = w[s : s + len(v)]
                have = Counter(tuple(x[p : p + k]) for p in range(len(v) - k + 1))
                if sum((have & want).values()) >= least * sum((have | want).values()):
                    out.add((d, i))
    return out


def test_matches_all_windows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 30, 60, 90])))) for i in range(25)]
    items += [(90, items[3][1]), (91, "too short"), (92, None), (None, "a b c d e f"), (93, "x x x x x x x x x x"), (0, items[0][1])]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 50, 300]))]
        if d % 2:
            copy = rng.choice(items[:25])[1].upper().split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                p = rng.randrange(len(copy))
                copy[p : p + 1] = rng.choice([[], ["changed"], ["put", "in"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((d, "  ".join(words)))
    docs += [(500, None), (None, items[2][1]), (501, "y " + "x " * 30), (1, docs[1][1]), (1, docs[1][1])]
    df = spark.createDataFrame([(d, t, 0, 0, "c") for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = find_contamination(df, bench).cache()
    want = brute(docs, items)
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(set(rows))
    kept = sorted(str(r.doc_id) for r in drop_contaminated(df, bench).collect())
    assert kept == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})
    assert find_contamination(df.limit(0), bench).count() == 0
    assert find_contamination(df, bench.limit(0)).count() == 0


def brute_whole(docs, items, least=0.8, k=5):
    """What documents shorter than the item repeat of it."""
    out = set()
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            v = item.lower().split()
            have, want = (Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1)) for x in (w, v))
            if k <= len(w) < len(v) and sum((have & want).values()) >= least * sum((have | want).values()):
                out.add((d, i))
    return out


def test_documents_shorter_than_the_item_are_whole_windows(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 9, 12, 30, 50])))) for i in range(40)] + [(90, "x " * 12)]
    docs = [(100, " ".join(items[4][1].split()[:-1]) + " "), (101, "x " * 11), (102, "x " * 5)]
    for d in range(90):
        words = items[d % 40][1].split()
        for _ in range(rng.choice([1, 1, 2, 4])):
            words.pop(rng.choice([0, -1, rng.randrange(len(words))]))
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame([(d, t, 0, 0, "c") for d, t in docs], SCHEMA)
    rows = find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items) | brute_whole(docs, items)
    assert len(want - brute(docs, items)) > 20
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    sizes = {d: len(t.split()) for d, t in docs}
    assert all(r.n_words == sizes[r.doc_id] for r in rows if (r.doc_id, r.item_id) in brute_whole(docs, items))
