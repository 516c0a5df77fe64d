"""Fill-in-the-middle: texts become prefix, middle and suffix in another order, whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landheat.llm.common import sized_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are transformed, and of these the percent in suffix-first form.
RATE, SPM_SHARE = 50, 80
SEED = 42

COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"

#: A unit: white space and the word behind it. What is left at the end of a text is white space.
_UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"
#: Ends a unit while texts are split; no UTF-8 text holds this byte.
_STOP = b"\xff"

_BYTES = pa.large_binary()


def _scalar(value: str | bytes) -> pa.Scalar:
    return pa.scalar(value.encode() if isinstance(value, str) else value, _BYTES)


def _remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _rebuilt(units: pa.Array, sizes: pa.Array) -> pa.Array:
    """The texts of lists of that many units each."""
    ends = pc.cumulative_sum(pc.cast(sizes, pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units), _scalar(""))


def _arranged(texts: pa.Array, draws: list[pa.Array], rate: int, spm_share: int) -> list[pa.Array]:
    """COLUMNS of a batch: units in list arrays, flattened with their parents, given ordinals, parted by role, joined again."""
    texts = pc.fill_null(texts.cast(_BYTES), b"")
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\1" + _STOP)
    lists = pc.split_pattern(marked, pattern=_STOP)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(units), 0)  # behind the last mark and in an empty text is an empty string
    units, parent = units.filter(full), parent.filter(full)
    void = pc.or_(pc.ends_with(marked, pattern=_STOP), pc.equal(pc.binary_length(marked), 0))
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), pc.cast(void, pa.int64()))
    first = pc.subtract(pc.cumulative_sum(n), n)
    ordinal = pc.subtract(pa.array(range(len(units)), pa.int64()), first.take(parent))

    cuts = [_remainder(h, pc.add(n, 1)) for h in draws[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before, behind = pc.less(ordinal, low.take(parent)), pc.greater_equal(ordinal, high.take(parent))
    between = pc.invert(pc.or_(before, behind))
    prefix = _rebuilt(units.filter(before), low)
    middle = _rebuilt(units.filter(between), pc.subtract(high, low))
    suffix = _rebuilt(units.filter(behind), pc.subtract(n, high))

    hundred = pa.array([100] * len(texts), pa.int64())
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_remainder(draws[2], hundred), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, pattern=mark.encode()))
    spm = pc.less(_remainder(draws[3], hundred), spm_share)
    p, s, m, none = _scalar(PREFIX), _scalar(SUFFIX), _scalar(MIDDLE), _scalar("")
    moved = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, nothing, pc.cast(pc.utf8_length(x.cast(pa.large_string())), pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, pc.if_else(plain, texts, moved).cast(pa.string())]


def _batches(batches: Iterator[pa.RecordBatch], names: list[str], rate: int, spm_share: int) -> Iterator[pa.RecordBatch]:
    for batch in sized_slices(batches, 1):
        columns = batch.columns
        yield pa.RecordBatch.from_arrays([columns[0], *_arranged(columns[1], columns[2:6], rate, spm_share)], names=names)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each document's text, rearranged or plain.

    A text of n units has its two cuts, whether it is moved (`rate` percent are) and its form (`spm_share` percent of
    these put the suffix first) drawn by the SHA-256 of seed and doc_id, so reruns and repeated rows agree, and so do
    different texts that share an id; a null id is drawn as an empty one. Texts that hold a mark stay plain, as do
    null (taken as empty) and empty ones; there the counts of characters are null. A text is one row of a batch that
    is cut by bytes, so a very long one is by itself. An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", "text", *draws)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}"
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
    return rows.mapInArrow(partial(_batches, names=names, rate=rate, spm_share=spm_share), schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone: marks occur once each, since no moved text holds one."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    first, second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.lit(MIDDLE)
    head = F.split_part(rest, first, F.lit(1))
    tail = F.split_part(rest, first, F.lit(2))
    body, middle = F.split_part(tail, second, F.lit(1)), F.split_part(tail, second, F.lit(2))
    moved = F.when(form == "spm", F.concat(body, middle, head)).otherwise(F.concat(head, middle, body))
    return F.when(form == "plain", output).otherwise(moved)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with the digests of outputs and of the texts restored from them in place of the outputs."""
    out = F.col("output")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return fill_in_middle(docs).select(*columns, F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, F.col("form")), 256).alias("restored_sha256"))
