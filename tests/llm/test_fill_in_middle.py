import hashlib
import re

import pytest
from pyspark.sql import functions as F

from axonframe.llm.fill_in_middle import Settings, fill_in_middle, fim_digest

ALL = ("output", "restored", "output_sha256", "restored_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, s=Settings()):
    text = text or ""
    units = re.findall(s.unit, text)
    digest = sha(f"{s.seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if not text or any(x in text for x in (s.prefix, s.suffix, s.middle)) or h[2] % 100 >= s.rate:
        return n, "plain", None, None, text, text
    spm = h[3] % 100 < s.spm_rate
    out = s.suffix + parts[2] + s.prefix + parts[0] + s.middle + parts[1] if spm else s.prefix + parts[0] + s.suffix + parts[2] + s.middle + parts[1]
    return n, "spm" if spm else "psm", len(parts[0]), len(parts[1]), out, text


ROWS = [
    (1, "one\ntwo\n\nthree"), (2, ""), (3, None), (None, "null id\nline"), (4, "\n\n\n"), (5, "no end"), (6, "a <P> mark\nb"), (7, "< P>\n<\nS>\nM>"), (8, "<S\n<M\n<P\n"),
    (9, "\U0001f600 ümläut\r\ncr\x00nul\n\u2028sep\n"), (9, "\U0001f600 ümläut\r\ncr\x00nul\n\u2028sep\n"), (10, "it's 'quoted' \"so\"\n$1 \\1\n" * 3), (11, "x\n" * 30000), (12, "<M>"), (13, "y" * 300000),
]


@pytest.mark.parametrize("s", [Settings(), Settings(seed=3, rate=40, spm_rate=10), Settings(prefix="<|fim'pre|>", suffix="<|suf|>", middle="<|mid|>", unit=r"[^ ]* |[^ ]+")])
def test_equals_plain_version(spark, s):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.output_sha256, r.restored_sha256) for r in fill_in_middle(docs, ALL, s=s).collect())
    wanted = []
    for doc_id, text in ROWS:
        n, form, prefix, middle, out, back = brute(doc_id, text, s)
        wanted.append((doc_id or 0, n, form, prefix, middle, out, back, sha(out), sha(back)))
    assert got == sorted(wanted)


def test_whole_table_at_any_partitioning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = sorted((d, n, f, p or 0, m or 0, sha(o), sha(t)) for d, (n, f, p, m, o, t) in ((r.doc_id, brute(r.doc_id, r.text)) for r in docs.collect()))
    for parts in (1, 7):
        got = sorted((r.doc_id, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output_sha256, r.restored_sha256) for r in fim_digest(docs.repartition(parts)).collect())
        assert got == wanted


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int, form string, _text string")
    assert fill_in_middle(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and fill_in_middle(docs).count() == 0
    clashing = spark.createDataFrame([("a", "x\ny\n", 5)], "doc_id string, text string, n int").withColumn("output", F.lit("z"))
    row = fill_in_middle(clashing).first()
    assert row.n == 2 and row.output != "z" and row.doc_id == "a"
    with pytest.raises(ValueError):
        fill_in_middle(docs, ("something",))
    with pytest.raises(ValueError):
        fill_in_middle(docs, s=Settings(prefix=""))
    explained = fim_digest(docs)._jdf.queryExecution().toString()
    assert "MapInArrow" in explained and "Exchange" not in explained.split("== Physical Plan ==")[1]
