"""Fill-in-the-middle examples: texts are cut at lines and put together in another order, by SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are registered at once; a longer text is registered alone.
SLICE_BYTES = 8 << 20

#: What can be asked for, beside the columns of the form.
OUTPUTS = {"output": "string", "restored": "string", "output_sha256": "string", "restored_sha256": "string"}
FORM = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


@dataclass(frozen=True)
class Settings:
    """seed: written before the id that is hashed. rate: texts of a hundred that are transformed. spm_rate: of those,
    texts of a hundred that have the suffix first. prefix, suffix, middle: the marks; a text that holds one stays plain.
    unit: the pattern of the pieces between which a text may be cut; pieces must cover the text."""

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[^\n]*\n|[^\n]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_of(s: Settings, outputs: tuple[str, ...], source: str) -> str:
    """The SELECT that makes the columns of FORM and `outputs` from (id, text) of `source`, row by row."""
    p, m, e = (_quoted(x) for x in (s.prefix, s.middle, s.suffix))
    number = ", ".join(f"CAST('0x' || substr(hash, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    joined = lambda lo, hi: f"array_to_string(list_slice(units, {lo}, {hi}), '')"
    # marks stand in no text, so the first of each is the one that was put there
    first, second = (f"split_part(output, {x}, 1)" for x in (e, p))
    after = lambda mark, k: f"split_part(output, {mark}, {k})"
    return f"""WITH hashed AS (SELECT coalesce(text, '') AS text, sha256(concat({_quoted(f"{s.seed}:")}, CAST(id AS VARCHAR))) AS hash FROM {source}),
cut AS (SELECT text, regexp_extract_all(text, {_quoted(s.unit)}) AS units, {number} FROM hashed),
placed AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {e}) OR contains(text, {m}) OR h3 % 100 >= {s.rate} THEN 'plain' WHEN h4 % 100 < {s.spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT text, n, form, CASE WHEN form <> 'plain' THEN {joined('1', 'a')} END AS prefix, CASE WHEN form <> 'plain' THEN {joined('a + 1', 'b')} END AS middle, CASE WHEN form <> 'plain' THEN {joined('b + 1', 'n')} END AS suffix FROM placed),
made AS (SELECT n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat({p}, prefix, {e}, suffix, {m}, middle) ELSE concat({e}, suffix, {p}, prefix, {m}, middle) END AS output FROM parts),
back AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN concat(substr({first}, {len(s.prefix) + 1}), {after(m, 2)}, split_part({after(e, 2)}, {m}, 1))
  ELSE concat(split_part({after(p, 2)}, {m}, 1), {after(m, 2)}, substr({second}, {len(s.suffix) + 1})) END AS restored FROM made)
SELECT {', '.join(FORM)}{''.join(f", {_output(x)}" for x in outputs)} FROM back"""


def _output(name: str) -> str:
    return f"sha256({name[:-7]}) AS {name}" if name.endswith("_sha256") else name


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most SLICE_BYTES, or of one row."""
    ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def fill_in_middle(docs: DataFrame, outputs: tuple[str, ...] = ("output",), id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars and the columns `outputs` (see OUTPUTS) of every row of docs.

    A text is cut into n pieces; the SHA-256 of seed and id says where the prefix and the middle end, whether the text is
    transformed and which form it gets: plain (the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle),
    each part behind its mark. `restored` is the text that is rebuilt from output and form alone.

    Each Arrow batch is registered in a DuckDB of the task's own, a few megabytes of text at a time, and all work on texts
    is one SELECT; no Python code sees a row. There is no shuffle. Null text is empty and so plain, and a null id counts as
    an empty one; repeated rows give the same result each; an empty table gives an empty result; other columns are ignored.
    Memory: a slice of texts, or one text, a few times over.
    """
    unknown = [x for x in outputs if x not in OUTPUTS]
    if unknown:
        raise ValueError(f"no outputs {unknown}; there are {', '.join(OUTPUTS)}")
    if "" in (s.prefix, s.suffix, s.middle) or len({s.prefix, s.suffix, s.middle}) < 3:
        raise ValueError("the marks must be three different texts that are not empty")
    sql = sql_of(s, outputs, "batch")
    kept = docs.select(F.col(id_col), F.col(text).alias("_text"))
    schema = kept.select(id_col).schema
    for name, kind in (*FORM.items(), *((x, OUTPUTS[x]) for x in outputs)):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for batch in batches:
                ids, texts = batch.columns
                for lo, hi in _slices(texts):
                    part = pa.table({"id": ids.slice(lo, hi - lo), "text": texts.slice(lo, hi - lo)})
                    db.register("batch", part)
                    made = db.sql(sql).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), *(c.combine_chunks() for c in made.columns)], names=schema.names)

    return kept.mapInArrow(run, schema)


def fim_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of docs."""
    return fill_in_middle(docs, ("output_sha256", "restored_sha256"))
