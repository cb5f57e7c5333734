"""Near duplicates by SimHash, found with pigeonhole blocks."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SENT_ROWS, TEXT_ROWS, components, fresh, lists, sent_if_small, shuffled, spread, values, written

SEED = 42  # the hash seed that the fingerprints are defined with
BITS = 64
#: Of near duplicates by similarity: 64-bit parts of a fingerprint, and those of them whose smallest hash is a sample.
WIDE = 16
KEYED = 12
#: Nodes of a key, and shingles of them, that are looked at as one; more are dealt over tiles of so many a side.
CROWD, CROWD_SHINGLES = 512, 1 << 18
#: Of the smallest and the largest nodes of its keys, those that a node is held against at first.
NEAREST = 4
#: What sets the hashes of the parts apart; the mixing constants are those of SplitMix64.
PARTS = np.array([(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(WIDE)], dtype=np.uint64)
PRINTS, SAMPLES = [f"f{i}" for i in range(WIDE)], [f"m{i}" for i in range(KEYED)]
SIZED = [*PRINTS, "size"]
SIGNED = [*SIZED, *SAMPLES]
#: Bits of WIDE x 64 that near duplicates may differ in, by the smaller number of shingles: up to FEW of them, and more.
#: Few shingles differ in more bits, since a majority of an even number is strict.
FEW, FAR, NEAR = 64, 470, 400


def _shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each word shingle in order; with fewer words than a shingle has, the whole sequence is the one shingle."""
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens)) or [1]
    k = max(1, min(words, len(tokens)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[k - 1 :])), dtype="<u8", count=len(ends) - k + 1)


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes, as a signed number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """SimHash of the word shingles of a whole text, as a signed 64-bit number.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count. With fewer words than a shingle
    has, the whole sequence is the one shingle; without words (empty or null text) the fingerprint is 0.
    """
    tokens = (text or b"").lower().split()
    return _majority(_shingle_hashes(tokens, words)) if tokens else 0


def signature(text: bytes | None, words: int) -> tuple[list[int], list[int]]:
    """SimHash of WIDE x 64 bits of the set of word shingles, and for each of the first KEYED parts of it the smallest
    of the hashes that it was made of. Every part has hashes of its own. Texts without words have the one empty shingle.
    """
    return signature_of(np.unique(_shingle_hashes((text or b"").lower().split(), words)))


def signature_of(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """The signature of a set of shingle hashes."""
    ones, samples = np.zeros(WIDE * BITS, dtype=np.int64), np.full(WIDE, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        h = hashes[at : at + (1 << 12), None] + PARTS
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        samples = np.minimum(samples, h.min(axis=0))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8").tolist(), samples[:KEYED].view("<i8").tolist()


def with_fingerprint(docs: DataFrame, keys: list[str], text: str = "text", words: int = 4) -> DataFrame:
    """keys and the fingerprint `fp` of each row; the texts go through Arrow as bytes and go no further."""
    schema = docs.select(*keys).schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t, words) for t in values(batch.column("_body"))], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), prints], names=[*keys, "fp"])

    return docs.select(*keys, F.col(text).cast("binary").alias("_body")).mapInArrow(run, schema)


def block_masks(blocks: int) -> list[int]:
    """Masks of `blocks` blocks of bits, as even as they come, as signed numbers."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def exploded(nodes: DataFrame, blocks: int, clean: int) -> DataFrame:
    """One row for each node and choice of `clean` blocks: (k, key) is what close fingerprints have in common."""
    masks = [sum(c) for c in combinations(block_masks(blocks), clean)]
    return nodes.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("k", "key"))


def _distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def link_components(nodes: DataFrame, radius: int = 4, blocks: int = 7, clean: int = 3) -> DataFrame:
    """Components of the nodes (node, fp) whose fingerprints differ in at most `radius` bits.

    Pigeonhole: fingerprints that differ in at most blocks - clean bits agree on `clean` blocks at least, so joining
    on every choice of `clean` blocks finds them; the Hamming distance is verified in the join. A dense group would
    give all its pairs, so links are found in two passes that give the same components: first each node is linked to
    the smallest and the largest node of its key, then pairs are sought only under keys that several
    components still share, and only between components. Spark takes the exploded rows to be no more than the nodes, so
    no join of them is left to its estimate: the keys are counted, and sent only if they are few.
    Returns (node, comp) for linked nodes.
    """
    keyed = exploded(spread(nodes, "node"), blocks, clean)
    ends = keyed.groupBy("k", "key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    for e in ("lo", "hi"):
        ends = ends.join(shuffled(nodes.select(F.col("node").alias(e), F.col("fp").alias(f"{e}_fp"))), e)
    ends = sent_if_small(written(ends, "ends"), SENT_ROWS // 8)
    near = [(_distance(F.col("fp"), F.col(f"{e}_fp")) <= radius) & (F.col("node") != F.col(e)) for e in ("lo", "hi")]
    n, e = keyed.alias("n"), ends.alias("e")
    stars = n.join(e, (F.col("n.k") == F.col("e.k")) & (F.col("n.key") == F.col("e.key")) & (near[0] | near[1]))
    stars = stars.select("node", F.explode(F.array(F.when(near[0], F.col("lo")), F.when(near[1], F.col("hi")))).alias("other")).where("other is not null")
    first = written(stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "stars")
    comp = written(components(first), "comp")

    labelled = nodes.join(sent_if_small(comp, SENT_ROWS // 8), "node", "left").select("node", "fp", F.coalesce("comp", "node").alias("comp"))
    keyed = exploded(spread(labelled, "node"), blocks, clean)
    mixed = keyed.groupBy("k", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k", "key")
    open_rows = keyed.join(sent_if_small(written(mixed, "mixed"), SENT_ROWS // 8), ["k", "key"], "left_semi")
    x, y = open_rows.alias("x"), shuffled(open_rows).alias("y")
    cross = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & (_distance(F.col("x.fp"), F.col("y.fp")) <= radius))
    second = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return components(first.select("a", "b").unionByName(second.select("a", "b")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links of `radius` bits.

    Equal fingerprints are one node however many rows have them, and copies are never expanded into pairs. Empty
    and null texts have fingerprint 0 and are linked like any other. A null id gets a row; it takes part in its
    component but is never its name (null if the component has no id). Repeated rows give repeated rows.
    An empty table gives an empty result. Other columns are ignored, so clashing names do no harm.
    """
    prints = written(with_fingerprint(docs.select(id_col, text), [id_col], text, words), "prints", TEXT_ROWS)
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    comp = link_components(nodes.select(F.col("fp").alias("node"), "fp"), radius)
    named = nodes.join(shuffled(comp), nodes.fp == comp.node, "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_print = named.join(shuffled(names), "comp").select("fp", "component_id")
    return prints.join(shuffled(of_print), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_signature(docs: DataFrame, keys: list[str], text: str, words: int) -> DataFrame:
    """keys and the signature of each row: fingerprint parts f0, f1, ..., the number of shingles and the samples m0, m1, ... that go with them."""
    names = [*keys, *SIGNED]
    schema = docs.select(*keys).schema
    for name in SIGNED:
        schema = schema.add(name, "long")

    def run(batches):
        for batch in batches:
            sets = (np.unique(_shingle_hashes((t or b"").lower().split(), words)) for t in values(batch.column("_body")))
            signed = [[*prints, len(h), *samples] for h, (prints, samples) in ((h, signature_of(h)) for h in sets)]
            columns = zip(*signed) if signed else [[]] * len(SIGNED)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, type=pa.int64()) for c in columns)], names=names)

    return docs.select(*keys, F.col(text).cast("binary").alias("_body")).mapInArrow(run, schema)


def _near_keys(nodes: DataFrame) -> DataFrame:
    """One row for each node and sample: key is the sample with its number."""
    return spread(nodes, "node").select("node", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col(m)) for i, m in enumerate(SAMPLES)])).alias("key"))


def _wide_distance(x: str, y: str) -> Column:
    return sum((_distance(F.col(f"{x}f{i}"), F.col(f"{y}f{i}")) for i in range(1, WIDE)), _distance(F.col(f"{x}f0"), F.col(f"{y}f0")))


def _close(x: str, y: str, radius: int) -> Column:
    """Whether two signed rows differ in at most `radius` bits, or FAR where either has few shingles."""
    return _wide_distance(x, y) <= F.when(F.least(f"{x}size", f"{y}size") <= FEW, F.lit(max(radius, FAR))).otherwise(F.lit(radius))


def jaccard(x: np.ndarray, y: np.ndarray, words: int) -> float:
    """Shingle hashes that two texts share, of all that either has; sets."""
    x, y = np.unique(x), np.unique(y)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _part(found: np.ndarray, words: int) -> float:
    """The part of a text's words that lie in shingles that are found. A text of at most `words` words is one shingle."""
    return float(found[0]) if len(found) == 1 else float((np.convolve(found, np.ones(words)) > 0.5).mean())


def coverage(x: np.ndarray, y: np.ndarray, words: int) -> float:
    """The part of a text's words that lie in shingles which the other text has too; the smaller of both texts' parts.

    x, y: hashes of the word shingles in order. A text of at most `words` words is one shingle.
    """
    return min(_part(np.isin(x, y), words), _part(np.isin(y, x), words))


MEASURES = {"jaccard": jaccard, "coverage": coverage}


def _told(hashes: np.ndarray, words: int, measure: str) -> tuple[np.ndarray, int]:
    """Hashes of a text and a number of words, such that the _part of them that another text has is at least the
    similarity of both: for the coverage all in order, for Jaccard the set, each for itself."""
    return (hashes, words) if measure == "coverage" else (np.unique(hashes), 1)


def _bodies(texts: DataFrame, asked: DataFrame, *names: str) -> DataFrame:
    """names and the texts as bytes (`_body`) of the nodes of a written table (of_sha, first_id, names)."""
    return texts.join(sent_if_small(asked, SENT_ROWS // 8), (F.col("sha") == F.col("of_sha")) & F.col("id").eqNullSafe(F.col("first_id"))).select(*names, F.col("body").cast("binary").alias("_body"))


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, measure: str) -> DataFrame:
    """Of pairs (a, b) of nodes (node, sha, first_id) those whose texts (sha, id, body) are that similar.

    Only the texts of nodes that stand in a pair are read, and what goes to the pairs is the hashes of their shingles.
    """
    measured = MEASURES[measure]
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("sha").alias("of_sha"), "first_id"), "node")
    bodies = _bodies(texts, written(asked, "asked"), "node")

    def digest(batches):
        for batch in batches:
            hashes = [_shingle_hashes((t or b"").lower().split(), words).view(np.int64) for t in values(batch.column("_body"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(hashes, type=pa.list_(pa.int64()))], names=["node", "hashes"])

    digests = written(bodies.mapInArrow(digest, "node long, hashes array<long>"), "shingles", TEXT_ROWS // 4).dropDuplicates(["node"])
    both = pairs.join(digests.withColumnsRenamed({"node": "a", "hashes": "x"}), "a").join(digests.withColumnsRenamed({"node": "b", "hashes": "y"}), "b")

    def run(batches):
        for batch in batches:
            keep = [measured(x, y, words) >= similarity for x, y in zip(lists(batch.column("x")), lists(batch.column("y")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar", TEXT_ROWS // 4)


#: What goes of a shingle: hash, node, node less component, place and number of places.
PACKED = [np.dtype(d) for d in ("<u4", "<i8", "<i8", "<u4", "<u4")]


def pack(texts: list[tuple[int, int, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Of (node, comp, hashes) one row for each bucket of hashes: the columns PACKED by bytes of equal weight, compressed."""
    texts = sorted(texts, key=lambda t: t[0])
    lengths = [len(h) for _, _, h in texts]
    node, comp, n = (np.repeat(np.array(c), lengths) for c in ([t[0] for t in texts], [t[1] for t in texts], lengths))
    h, at = np.concatenate([t[2] for t in texts]).view(np.uint64), np.concatenate([np.arange(k) for k in lengths])
    bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=buckets))
    rows, codec = [], pa.Codec("zstd", 1)
    for lo, hi in zip(ends, ends[1:]):
        own = order[lo:hi]
        columns = (h[own] // np.uint64(buckets) & np.uint64(0xFFFFFFFF), np.diff(node[own], prepend=0), node[own] - comp[own], at[own], n[own])
        body = b"".join(c.astype(d).view(np.uint8).reshape(len(own), -1).T.tobytes() for c, d in zip(columns, PACKED))
        rows.append((int(bucket[own[0]]), len(own), codec.compress(body, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "rows", "body"])


def unpack(rows: int, body: bytes) -> list[np.ndarray]:
    """hash, node, comp, place and number of places of the shingles of a row of `pack`."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(body, rows * sum(d.itemsize for d in PACKED), asbytes=True), dtype=np.uint8)
    cuts, columns = np.cumsum([0, *(d.itemsize * rows for d in PACKED)]), []
    for lo, hi, d in zip(cuts, cuts[1:], PACKED):
        columns.append(np.ascontiguousarray(raw[lo:hi].reshape(d.itemsize, rows).T).view(d).reshape(-1))
    node = np.cumsum(columns[1])
    return [columns[0], node, node - columns[2], columns[3].astype(np.int64), columns[4].astype(np.int64)]


def mixed_spots(table: pa.Table) -> pa.Table:
    """Of the shingles of a bucket those that several components have: node, and place and number of places as one number."""
    of = [unpack(*row) for row in zip(table.column("rows").to_pylist(), values(table.column("body")))]
    h, node, comp, at, n = (np.concatenate([o[k] for o in of]) for k in range(5))
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    mixed = np.minimum.reduceat(comp[order], starts) < np.maximum.reduceat(comp[order], starts)
    own = order[np.repeat(mixed, np.diff(starts, append=len(order)))]
    return pa.table([pa.array(node[own]), pa.array(at[own] << 32 | n[own])], names=["node", "spot"])


def linkable(asked: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, measure: str) -> DataFrame:
    """Of nodes (node, comp) those that can be similar to one of another component, with their hashes; no other can.

    A text is similar to another only if the shingles that both have cover the similarity of its words, so the shingles
    that nodes of other components have, whichever, cover as much. Texts that share a licence or a line and go on in
    words of their own are out, without a look at their pairs. A shingle goes to the others by its hash, with its place
    in the text and the number of places, so the texts are read again only for what is left. Each takes about 10 bytes
    (`pack`), half of what a row for each takes; hashes are cut to 32 bits and those of the bucket for it, which
    may keep a text too many and loses none.
    """
    asked = written(asked.join(shuffled(nodes.select("node", F.col("sha").alias("of_sha"), "first_id")), "node"), "asked")
    told = lambda body: _told(_shingle_hashes((body or b"").lower().split(), words).view(np.int64), words, measure)
    span = _told(np.zeros(1, dtype=np.int64), words, measure)[1]

    buckets = max(1, (nodes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] >> 18))

    def spell(batches):
        for batch in batches:
            out, held = [], 0
            for node, comp, body in zip(*(values(batch.column(c)) for c in ("node", "comp", "_body"))):
                out.append((node, comp, told(body)[0]))
                held += len(out[-1][2])
                if held > 1 << 19:
                    yield pack(out, buckets)
                    out, held = [], 0
            if out:
                yield pack(out, buckets)

    def keep(batches):
        for batch in batches:
            kept = []
            for spots in lists(batch.column("spots")):
                found = np.zeros(int(spots[0]) & 0xFFFFFFFF, dtype=bool)
                found[spots >> 32] = True
                kept.append(_part(found, span) >= similarity - 1e-9)
            yield batch.select(["node"]).filter(pa.array(kept, type=pa.bool_()))

    def digest(batches):
        for batch in batches:
            hashes = [told(t)[0] for t in values(batch.column("_body"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), pa.array(hashes, type=pa.list_(pa.int64()))], names=["node", "comp", "hashes"])

    packed = _bodies(texts, asked, "node", "comp").mapInArrow(spell, "bucket int, rows int, body binary")
    common = packed.groupBy("bucket").applyInArrow(mixed_spots, "node long, spot long").groupBy("node").agg(F.collect_list("spot").alias("spots"))
    kept = written(common.mapInArrow(keep, "node long"), "common", TEXT_ROWS // 4)
    asked = written(asked.join(sent_if_small(kept, SENT_ROWS // 8), "node", "left_semi"), "asked")
    return written(_bodies(texts, asked, "node", "comp").mapInArrow(digest, "node long, comp long, hashes array<long>"), "linkable", TEXT_ROWS // 4).dropDuplicates(["node"])


def rarest(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, span: int, similarity: float) -> np.ndarray:
    """Of the hashes of a text that others have too (common, each once, so many times), the rarest, without which all
    others cover less than the similarity; none if all of them do.

    So any similar text has one of these. In the order of times and hash, which is the same for all texts, the first hash
    that two similar texts share is one of these for both: texts without one in common are not similar.
    """
    order, by_hash = np.lexsort((common, times)), np.argsort(common)
    rank = np.empty(len(common), dtype=np.int64)
    rank[order] = np.arange(len(common))
    at = by_hash[np.minimum(np.searchsorted(common, hashes, sorter=by_hash), len(common) - 1)]
    ranks = np.where(common[at] == hashes, rank[at], -1)
    lo, hi = 0, len(common)
    while lo < hi:
        middle = (lo + hi) // 2
        lo, hi = (middle + 1, hi) if _part(ranks >= middle, span) >= similarity - 1e-9 else (lo, middle)
    return common[order[:lo]]


def shingle_keys(able: DataFrame, words: int, similarity: float, measure: str) -> DataFrame:
    """Of nodes (node, comp, hashes) those that can be similar to one of another component, and `keys`: two similar nodes
    of different components have one in common. Keys of the same nodes are one key."""
    able = written(able, "able")
    span = _told(np.zeros(1, dtype=np.int64), words, measure)[1]
    spelt = able.select("node", "comp", F.explode(F.array_distinct("hashes")).alias("hash"))
    held = spelt.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), (F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").select("hash", "n")
    common = spelt.select("node", "hash").join(shuffled(held), "hash").groupBy("node").agg(F.collect_list(F.struct("hash", "n")).alias("of"))
    both = able.join(shuffled(common), "node").select("node", "hashes", F.col("of.hash").alias("common"), F.col("of.n").alias("times"))

    def choose(batches):
        for batch in batches:
            keys = [rarest(*of, span, similarity) for of in zip(*(lists(batch.column(c)) for c in ("hashes", "common", "times")))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, type=pa.list_(pa.int64()))], names=["node", "keys"])

    keys = written(both.mapInArrow(choose, "node long, keys array<long>"), "keys", TEXT_ROWS // 4)
    rows = keys.select("node", F.explode("keys").alias("key"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64("node", F.lit(i)).bitwiseAND((1 << 32) - 1)).alias(f"s{i}") for i in range(2)]).where("n > 1")
    named = held.groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key")
    keys = rows.join(shuffled(named), "key").groupBy("node").agg(F.collect_list("key").alias("keys"))
    return written(able.join(shuffled(keys), "node"), "able")


def tile_links(of: tuple, table: pa.Table, words: int, similarity: float, measure: str) -> pa.Table:
    """Links (a, b) that join the similar nodes of one tile of a key to components; nodes of one component (comp) are joined already.

    Rows: at (i or j), node, comp, the keys that a node has and its hashes. Pairs are of one node at i and one at j, under
    the smallest key that they have in common. Nodes of the largest component come last, and are looked at from the others.
    """
    table = table.combine_chunks()
    key, i, j = (v.as_py() for v in of)
    at, node, comp = (table.column(c).to_numpy() for c in ("at", "node", "comp"))
    comp, counts = np.unique(comp, return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((node, comp, counts[comp]))
    at, node, comp = at[order], node[order], comp[order]
    keys, hashes = ([found[k] for k in order] for found in (list(lists(table.column(c).chunk(0))) for c in ("keys", "hashes")))
    smaller = [k[k < key] for k in keys]
    known, of_all = np.unique(np.concatenate(hashes), return_inverse=True)
    lengths = np.array([len(h) for h in hashes])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    listed = np.unique(of_all * len(node) + np.repeat(np.arange(len(node)), lengths))  # by hash, the nodes that have it
    ends = np.searchsorted(listed, np.arange(len(known) + 1) * len(node))
    listed %= len(node)
    having = {int(k): [] for k in np.unique(np.concatenate(smaller))}
    for n, some in enumerate(smaller):
        for k in some.tolist():
            having[k].append(n)
    having = {k: np.array(v) for k, v in having.items()}
    span, parent, found = words if measure == "coverage" else 1, np.arange(len(counts)), []
    for x in range(len(node)):
        asked = (parent[comp] != parent[comp[x]]) & (np.arange(len(node)) > x)
        if i != j:
            asked &= at != at[x]
        for k in smaller[x].tolist():
            asked[having[k]] = False
        if not asked.any():
            continue
        mine, at_hash, often = np.unique(of_all[starts[x] : starts[x + 1]], return_inverse=True, return_counts=True)
        times = ends[mine + 1] - ends[mine]
        before = np.cumsum(times) - times
        place, other = np.repeat(np.arange(len(mine)), times), listed[np.arange(times.sum()) + np.repeat(ends[mine] - before, times)]
        place, other = place[asked[other]], other[asked[other]]
        least = similarity * (lengths[x] + span - 1) - 1e-9
        enough = np.bincount(other, weights=often[place], minlength=len(node)) * span >= least
        place, other = place[enough[other]], other[enough[other]]
        them, column = np.unique(other, return_inverse=True)
        both = np.zeros((len(mine), len(them)), dtype=bool)
        both[place, column] = True
        over = np.zeros((lengths[x] + span - 1, len(them)), dtype=bool)
        for d in range(span):
            over[d : d + lengths[x]] |= both[at_hash]
        for y in them[over.sum(axis=0) >= least].tolist():
            if parent[comp[x]] != parent[comp[y]] and MEASURES[measure](hashes[x], hashes[y], words) >= similarity:
                found.append((min(node[x], node[y]), max(node[x], node[y])))
                parent[parent == parent[comp[x]]] = parent[comp[y]]
    return pa.table([pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int, measure: str, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join the similar ones of nodes (node, sha, first_id, SIGNED) to components.

    First each node with the NEAREST of the smallest and the largest nodes of its keys, by their fingerprints, so that a
    dense group is linked without its pairs. Then all pairs of what are still different components, whether they have a
    sample in common or none: nodes go that can be similar to none of another component (`linkable`), and the others have
    the rarest of their shingles as keys, one of which any two similar ones have in common (`shingle_keys`). However many
    nodes a key has, each tile of at most `crowd` x `crowd` of them is one group of rows, whose pairs are counted in it
    and make no rows. No link is lost.
    """
    keys = _near_keys(nodes)
    ends = written(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi"), "ends")
    shared = written(keys.join(shuffled(ends.select("key")), "key", "left_semi"), "shared")
    alike = written(nodes.join(shuffled(shared.select("node").distinct()), "node", "left_semi"), "alike")
    for e in ("lo", "hi"):
        ends = ends.join(alike.select(F.col("node").alias(e), *[F.col(p).alias(e + p) for p in SIZED]), e)
    near = [_close("", e, radius) & (F.col("node") != F.col(e)) for e in ("lo", "hi")]
    n, e = shared.select("node", F.col("key").alias("node_key")).join(alike.select("node", *SIZED), "node"), ends
    stars = n.join(e, (F.col("node_key") == F.col("key")) & (near[0] | near[1]))
    told = [F.when(close, F.struct(_wide_distance("", e).alias("bits"), F.col(e).alias("other"))) for e, close in zip(("lo", "hi"), near)]
    nearest = stars.select("node", F.explode(F.array_compact(F.array(*told))).alias("e")).groupBy("node").agg(F.slice(F.sort_array(F.collect_set("e")), 1, NEAREST).alias("of"))
    stars = nearest.select("node", F.explode("of").alias("e")).select("node", F.col("e.other").alias("other"))
    pairs = written(stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    links = similar(pairs, nodes, texts, words, similarity, measure)

    comp = written(components(links), "comp")
    labelled = nodes.join(sent_if_small(comp, SENT_ROWS // 8), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    able = shingle_keys(linkable(labelled, nodes, texts, words, similarity, measure), words, similarity, measure)
    rows = able.select("node", "comp", F.explode("keys").alias("key"), F.size("hashes").alias("size"))
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / crowd, F.sum("size") / CROWD_SHINGLES)).cast("int")  # a side
    held = rows.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("mixed"), tiles.alias("tiles")).where("mixed").select("key", "tiles")
    rows, able = written(rows.join(shuffled(held), "key"), "mixed"), able.select("node", "keys", "hashes")
    tiled = rows.withColumn("at", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("key", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "node", "comp").join(shuffled(able), "node").select("key", "i", "j", "at", "node", "comp", "keys", "hashes")
    last = tiled.groupBy("key", "i", "j").applyInArrow(lambda of, table: tile_links(of, table, words, similarity, measure), "a long, b long")
    return links.unionByName(written(last, "similar"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = NEAR, measure: str = "jaccard") -> DataFrame:
    """Keep one row of each group of near duplicates: the one with the smallest id. Columns stay as they are.

    Texts are near duplicates when the similarity of their word shingles is at least `similarity`. measure says which:
    `jaccard`, of the sets of shingles; or `coverage`, the part of a text's words that lie in shingles which the other
    text has too, for both texts. One changed word in twenty leaves a coverage of 0.95 and a Jaccard similarity of 0.63.

    Fingerprints of so few shingles in common differ in up to a third of their bits, too many for blocks of bits alone,
    so a block is the smallest shingle hash of one of KEYED parts of the fingerprint, which two texts share with the
    probability of their Jaccard similarity J. Pairs that share any of the KEYED samples (all but (1 - J) ** 12) and
    differ in at most `radius` bits of the fingerprint (FAR bits where either text has at most FEW shingles) are tried
    first; what they leave in different components is looked at by the shingles themselves, so that no link is lost,
    however small J. How a group is linked without all its pairs, and what crowded keys do, is told in near_links.

    Equal texts (by SHA-256) are always one group; null and empty texts are equal, and one of them stays. Of repeated
    rows with the same id one stays. Rows with a null id stay only where their group has no other. An empty table gives
    an empty result. Other columns, whatever their names, stay as they are.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    texts = docs.select(sha.alias("sha"), F.col(id_col).alias("id"), F.col(text).alias("body"))
    prints = written(with_signature(texts, ["sha", "id"], "body", words), "prints", TEXT_ROWS)
    nodes = prints.groupBy("sha").agg(*[F.min(p).alias(p) for p in SIGNED], F.min("id").alias("first_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers that stay, once written
    comp = written(components(near_links(nodes, texts, words, similarity, radius, measure)), "comp")

    named = nodes.select("sha", "node", "first_id").join(comp, "node", "left").select("sha", "node", "first_id", F.coalesce("comp", "node").alias("comp"))
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("b")).select("b.node")
    stays = named.select("sha", "node", F.col("first_id").alias("best_id")).join(best.withColumn("stays", F.lit(True)), "node", "left")
    rows = prints.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n")).join(stays, "sha")
    kept = F.coalesce("stays", F.lit(False)) & F.col("id").eqNullSafe(F.col("best_id"))
    rows = written(rows.select("sha", "id", F.when(kept, F.col("n")).otherwise(F.lit(0)).alias("n")).where("n <> 1"), "dropped")

    s, i = fresh(docs, "sha", "id")
    at = (sha == F.col(s)) & F.col(id_col).eqNullSafe(F.col(i))
    mark = rows.withColumnsRenamed({"sha": s, "id": i})
    once = docs.join(sent_if_small(mark, SENT_ROWS // 8), at, "left_anti")
    more = docs.join(sent_if_small(mark.where("n > 1"), SENT_ROWS // 8).select(s, i), at).dropDuplicates([s]).select(*docs.columns)
    return once.unionByName(more)
