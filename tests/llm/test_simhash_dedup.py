import random

import pyarrow.compute
import xxhash
from pyspark.sql import functions as F

from axonframe.llm import simhash_dedup
from axonframe.llm.shared import components, written
from axonframe.llm.simhash_dedup import _shingle_hashes, coverage, drop_near_duplicates, fingerprint, near_links, signature, simhash_components, tile_links, with_signature

SCHEMA = "doc_id long, text string, component_id string, fp long"


def slow_fingerprint(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows = []
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            rows.append(" \t".join(words))
    return list(enumerate(rows)) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b c"), (1003, "a b c")]


def test_fingerprint_matches_definition():
    for _, text in corpus():
        assert fingerprint((text or "").encode(), 4) % 2**64 == slow_fingerprint(text, 4)


def test_components_match_brute_force(spark):
    rows = corpus()
    prints = {i: slow_fingerprint(t, 4) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = union_find(prints, links)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = simhash_components(df).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((i, f"{prints[i]:016x}", want[i]) for i, _ in rows)


def test_exploded_rows_are_sent_to_all_tasks_only_if_they_were_counted(spark, monkeypatch):
    """Spark's own estimate takes the 35 rows of a fingerprint for one, so it would send all of them."""
    plans = []

    def told(df, name="step", rows=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, rows)

    monkeypatch.setattr(simhash_dedup, "written", told)
    monkeypatch.setattr(simhash_dedup, "SENT_ROWS", 0)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus()], SCHEMA)
    found = told(simhash_components(df))
    assert found.count() == len(corpus())
    assert any("Generate" in p and "Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e", "", 0), (5, "a b c d e", "", 0), (None, "q r s t u v", "", 0)], SCHEMA)
    assert sorted(str((r[0], r[2])) for r in simhash_components(df).collect()) == ["(5, 5)", "(None, 5)", "(None, None)"]
    assert simhash_components(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_drop_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    rows = [(3, " ".join(base)), (4, " ".join(base)), (4, " ".join(base)), (9, " ".join(near)), (2, "x y z"), (2, "x y z"), (None, None), (11, ""), (12, " ".join(rng.choice(words) for _ in range(400)))]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], SCHEMA)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 11, 12]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for size, copies, changes in ((150, 60, 12), (400, 25, 9), (30, 10, 1), (4, 3, 0), (0, 2, 0)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, changes)):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(500 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(60)]
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {root for root in union_find(sets, links).values()}
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == want


def test_signatures_of_alike_texts():
    a = [f"x{i}" for i in range(500)]
    b = ["other" if i in (100, 300) else w for i, w in enumerate(a)]  # similarity 486 / 506
    one, two, far = (signature(" ".join(t).encode(), 5)[0] for t in (a, b, a[::-1]))
    differ = lambda x, y: sum((u ^ v).bit_count() if u ^ v >= 0 else 64 - (~(u ^ v)).bit_count() for u, v in zip(x, y))
    assert differ(one, two) < 120 and differ(one, far) > 400
    assert signature(None, 5) == signature(b"", 5) == signature(b" \n", 5)
    assert signature(b"a a a a a a a a a", 5) == signature(b"a a a a a", 5)  # sets: repeats do not count


def test_short_texts_at_the_threshold_are_near_duplicates(spark):
    rng = random.Random(12)
    docs = []
    for d in range(0, 400, 2):  # 4 shingles of 5: a similarity of 0.8
        w = [f"v{rng.randrange(10**6)}" for _ in range(9)]
        docs += [(d, " ".join(w[:8])), (d + 1, " ".join(w))]
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    print("kept", len(kept))
    assert set(range(0, 400, 2)) <= kept and len(kept) <= 210


def slow_coverage(a, b, k=5):
    """Word by word: whether one of the shingles over it stands in the other text."""
    wa, wb = (a or "").lower().split(), (b or "").lower().split()
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (wa, wb)]
    parts = []
    for w, other in ((wa, sets[1]), (wb, sets[0])):
        spots = [(i, i + k) for i in range(max(1, len(w) - k + 1)) if tuple(w[i : i + k]) in other]
        hit = sum(any(lo <= i < hi for lo, hi in spots) for i in range(len(w)))
        parts.append(hit / len(w) if w else float(bool(spots)))
    return min(parts)


def test_coverage_matches_its_definition():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("pqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        b = [w if rng.random() > 0.06 else "new" for w in a][rng.randint(0, 4) :]
        hashes = [_shingle_hashes(" ".join(t).encode().split(), 5) for t in (a, b)]
        assert abs(coverage(*hashes, 5) - slow_coverage(" ".join(a), " ".join(b))) < 1e-12


def test_near_copies_of_a_table_match_brute_force(spark):
    """All of sf0.01, many of whose near copies have a Jaccard similarity of 0.5 to 0.7, and recall by band of it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in having.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.1 * min(len(sets[a]), len(sets[b])) and slow_coverage(texts[a], texts[b]) >= 0.8]
    groups = union_find(texts, [(min(p), max(p)) for p in links])
    got = {r.doc_id for r in drop_near_duplicates(docs, measure="coverage").collect()}
    bands = {}
    for a, b in links:
        if texts[a] != texts[b]:
            band = bands.setdefault(int(10 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])) / 10, [0, 0])
            band[0], band[1] = band[0] + 1, band[1] + (max(a, b) not in got)
    print("pairs and dropped ones by Jaccard similarity:", dict(sorted(bands.items())))
    assert sum(b[1] for b in bands.values()) >= 0.99 * sum(b[0] for b in bands.values())
    assert set(groups.values()) <= got and len(got) <= len(set(groups.values())) + 1


def test_drifting_families(spark):
    """Each text of a family is a changed copy of an earlier one, so most pairs of a family are no links."""
    rng, texts = random.Random(31), {}
    for family in range(25):
        chain = [[f"f{family}w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 120))]]
        for _ in range(15):
            words = list(rng.choice(chain[-3:]))
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            chain.append(words)
        texts |= {16 * family + k: " ".join(words) for k, words in enumerate(chain)}
    links = [(a, b) for a in texts for b in texts if a < b and a // 16 == b // 16 and slow_coverage(texts[a], texts[b]) >= 0.8]
    want = set(union_find(texts, links).values())
    got = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), measure="coverage").collect()}
    print("families: groups", len(want), "found", len(got), "links", len(links))
    assert want <= got and len(got) <= len(want)


def test_copies_with_every_sixth_word_changed_are_found(spark):
    """A coverage of over 0.8 and a Jaccard similarity of 0.1, where a third of all pairs has no sample in common."""
    rng, texts = random.Random(32), {}
    licence = [f"l{i}" for i in range(30)]  # and shingles that all texts have
    for d in range(0, 120, 2):
        words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        texts |= {d: words + licence, d + 1: [f"n{rng.randrange(10**6)}" if i % 6 == 5 else w for i, w in enumerate(words)] + licence}
    texts = {d: " ".join(w) for d, w in texts.items()}
    assert all(slow_coverage(texts[d], texts[d + 1]) >= 0.8 for d in range(0, 120, 2))
    got = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), measure="coverage").collect()}
    assert got == set(range(0, 120, 2))


def test_shingles_of_several_components_by_buckets():
    rng, np = random.Random(34), simhash_dedup.np
    texts = [(rng.randrange(1 << 40), np.array([rng.randrange(-(1 << 63), 1 << 63) if rng.random() < 0.7 else rng.randrange(40) for _ in range(rng.randint(1, 60))])) for _ in range(50)]
    texts = [(node, rng.choice([node, texts[0][0]]), h) for node, h in texts]
    having = {}
    for node, comp, h in texts:
        for v in h.tolist():
            having.setdefault(v, set()).add(comp)
    want = sorted((node, at << 32 | len(h)) for node, comp, h in texts for at, v in enumerate(h.tolist()) if len(having[v]) > 1)
    for buckets in (1, 7):
        rows = simhash_dedup.pa.Table.from_batches([simhash_dedup.pack(texts[:20], buckets), simhash_dedup.pack(texts[20:], buckets)])
        found = [tuple(r.values()) for b in range(buckets) for r in simhash_dedup.mixed_spots(rows.filter(simhash_dedup.pa.compute.equal(rows["bucket"], b))).to_pylist()]
        assert sorted(found) == want


def test_texts_without_a_rare_shingle_in_common_are_not_similar():
    rng, np = random.Random(33), simhash_dedup.np
    for _ in range(300):
        measure = rng.choice(["coverage", "jaccard"])
        base = [rng.randrange(8) for _ in range(rng.randint(1, 40))]
        texts = [[w if rng.random() > 0.1 else rng.randrange(8) for w in base] for _ in range(6)]
        told = [simhash_dedup._told(_shingle_hashes(" ".join(map(str, t)).encode().split(), 5).view("int64"), 5, measure) for t in texts]
        every, times = np.unique(np.concatenate([np.unique(h) for h, _ in told]), return_counts=True)
        keys = []
        for k, (hashes, span) in enumerate(told):
            others = np.unique(np.concatenate([h for i, (h, _) in enumerate(told) if i != k]))
            common = np.intersect1d(hashes, others)
            keys.append(set(simhash_dedup.rarest(hashes, common, times[np.searchsorted(every, common)], span, 0.8).tolist()) if len(common) else set())
        for a in range(6):
            for b in range(a):
                if simhash_dedup.MEASURES[measure](told[a][0], told[b][0], 5) >= 0.8:
                    assert keys[a] & keys[b]


def test_crowded_keys_are_made_longer(spark):
    rng = random.Random(21)
    licence = " ".join(f"l{i}" for i in range(60))
    rows = []
    for d in range(0, 120, 2):  # all share the licence, pairs of them are near copies
        own = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(d, f"{' '.join(own)} {licence}"), (d + 1, f"{' '.join('new' if i == 30 else w for i, w in enumerate(own))} {licence}")]
    texts = spark.createDataFrame(rows, "id long, body string").selectExpr("unhex(sha2(cast(body as binary), 256)) sha", "id", "body")
    nodes = with_signature(texts, ["sha", "id"], "body", 5).withColumnsRenamed({"id": "first_id"}).withColumn("node", F.col("first_id"))
    links = near_links(written(nodes, "nodes"), texts, 5, 0.8, 400, "coverage", crowd=3).collect()
    assert {(r.a, r.b) for r in links} == {(d, d + 1) for d in range(0, 120, 2)}


def test_columns_that_clash_stay_as_they_are(spark):
    rows = [(1, "a b c d e f", "s", 1, "n"), (2, "a b c d e f", "t", 2, "m"), (3, None, None, None, None), (3, None, None, None, None), (None, "", "u", 3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string, node long, _id string")
    got = drop_near_duplicates(df, measure="coverage")
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[2]]))


def test_links_under_keys_of_many_nodes_are_found(spark):
    """All samples are common to 40 texts of different components; the only near copies are neither first nor last."""
    rng = random.Random(44)
    own = {d: [f"v{rng.randrange(10**6)}" for _ in range(60)] for d in range(40)}
    own[6] = ["new" if i == 30 else w for i, w in enumerate(own[5])]
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in own.items()], "id long, body string").selectExpr("unhex(sha2(cast(body as binary), 256)) sha", "id", "body")
    nodes = with_signature(texts, ["sha", "id"], "body", 5).withColumnsRenamed({"id": "first_id"}).withColumn("node", F.col("first_id"))
    nodes = nodes.withColumns({c: F.lit(7).cast("long") for c in nodes.columns if c[0] in "fm" and c[1:].isdigit()})
    links = near_links(written(nodes, "nodes"), texts, 5, 0.8, 400, "coverage").collect()
    assert {(r.a, r.b) for r in links} == {(5, 6)}


def test_texts_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """400 texts, a third of each the same, and two near copies among them."""
    rng = random.Random(45)
    common = [f"c{i}" for i in range(20)]
    texts = {d: [f"v{rng.randrange(10**6)}" for _ in range(40)] + common for d in range(400)}
    texts[207] = ["new" if i == 30 else w for i, w in enumerate(texts[206])]
    listed, count = [], simhash_dedup.similar

    def counted(pairs, *rest):
        listed.append(pairs.count())
        return count(pairs, *rest)

    monkeypatch.setattr(simhash_dedup, "similar", counted)
    got = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string"), measure="coverage").collect()}
    assert got == set(texts) - {207}
    assert sum(listed) <= 10 * len(texts)


def test_links_over_the_tiles_of_a_key(spark):
    """Links within a key in one tile or many, and its nodes in one component or many; coverage and Jaccard similarity."""
    rng = random.Random(46)
    texts = {}
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(60)]
        for k in range(8):
            texts[8 * family + k] = [w if rng.random() > 0.03 else f"n{rng.randrange(10**6)}" for w in base]
    for measure in ("coverage", "jaccard"):
        alike = lambda a, b: slow_coverage(" ".join(texts[a]), " ".join(texts[b])) if measure == "coverage" else len(shingle_set(" ".join(texts[a])) & shingle_set(" ".join(texts[b]))) / len(shingle_set(" ".join(texts[a])) | shingle_set(" ".join(texts[b])))
        want = union_find(texts, [(a, b) for a in texts for b in texts if a < b and alike(a, b) >= 0.8])
        hashes = {d: _shingle_hashes(" ".join(w).encode().split(), 5).view("int64") for d, w in texts.items()}
        hashes = hashes if measure == "coverage" else {d: simhash_dedup.np.unique(h) for d, h in hashes.items()}
        for tiles in (1, 3):
            links = []
            for i in range(tiles):
                for j in range(i, tiles):
                    own = [d for d in texts if d % tiles in (i, j)]
                    table = simhash_dedup.pa.table({"at": [d % tiles for d in own], "node": own, "comp": [d - d % 8 if d % 8 < 3 and want[d] == want[d - d % 8] else d for d in own], "keys": [[7, 9] if d % 8 else [9] for d in own], "hashes": [hashes[d] for d in own]})
                    for key in (7, 9):
                        rows = table if key == 9 else table.filter([d % 8 > 0 for d in own])
                        links += [tuple(r.values()) for r in tile_links(tuple(simhash_dedup.pa.scalar(v) for v in (key, i, j)), rows, 5, 0.8, measure).to_pylist()]
            links += [(d - d % 8, d) for d in texts if d % 8 in (1, 2) and want[d] == want[d - d % 8]]
            assert union_find(texts, links) == want
