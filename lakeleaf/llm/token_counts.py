"""Token counts by offset-mapped attribution (operator 6).

A document is encoded once, as a whole, so that its count is the count a model sees. Each token has a character span; the spans and the sections of
the document are both sorted, so an interval join in order finds the section of every token. A token whose span crosses a
border goes by an explicit rule: `first` (the section of its first character) or `last` (of its last character) or `most` (the section that holds most of its
characters; the earlier one of equals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _kind, text_encoder
from .runtime import steps

RULES = ("first", "last", "most")


def token_spans(lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in characters, of tokens of so many bytes. A token that begins or ends inside a character covers it whole."""
    ends = np.cumsum(lengths)
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(lead) - 1  # of each byte
    if not len(ends):
        return ends, ends
    return character[ends - lengths], character[ends - 1] + 1


def line_starts(text: str) -> np.ndarray:
    """The start of every line of a text, in characters; a line has its line feed. An empty text has one empty line."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(codes) else starts


def given_starts(starts: list[int | None], length: int) -> np.ndarray:
    """The sorted starts of a text's sections, within the text; the first is 0."""
    found = np.sort(np.clip(np.array([x for x in starts if x is not None], np.int64), 0, length))
    found[:1] = 0
    return found


def section_of(starts: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """The section of each span: the sections are gapless and begin at starts, the spans are sorted."""
    if rule == "first":
        return np.searchsorted(starts, begin, "right") - 1
    final = np.searchsorted(starts, end - 1, "right") - 1
    if rule == "last":
        return final
    best = np.searchsorted(starts, begin, "right") - 1
    for i in np.flatnonzero(best != final):
        borders = np.clip(np.append(starts[best[i] : final[i] + 1], end[i]), begin[i], end[i])
        best[i] += int(np.argmax(np.diff(borders)))
    return best


def attribute(df: DataFrame, ranks_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text", starts_col: str | None = None) -> DataFrame:
    """One row per section: the id, section int (from 0), char_start, char_end, n_tokens, n_crossing, doc_tokens (bigint).

    starts_col: an array of the characters at which the sections (fields or passages) begin; without it, and where it is null or without numbers, the sections are
    the lines. Starts are sorted and held to the text's ends, nulls are left out, and what precedes the first start belongs to the first section. The counts of a document's sections sum to doc_tokens. n_crossing counts those of a section's tokens that
    reach into another. A null or empty text has one section of no tokens. Repeated rows are counted each. Without shuffle; sections of any number stay in
    their document's task, a few MB of text at a time."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    names = ["id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks_path, pattern)
        for part, texts in steps(batches, "text"):
            given = [x if x and any(v is not None for v in x) else None for x in part.column(2).to_pylist()] if starts_col else [None] * len(texts)
            out, rows = [], []
            for row, (text, ids, own) in enumerate(zip(texts, encoder.encode(texts), given, strict=True)):
                starts = given_starts(own, len(text)) if own else line_starts(text)
                begin, end = token_spans(encoder.token_length[np.frombuffer(ids, "<u4")], text.encode())
                at = section_of(starts, begin, end, rule)
                stops = np.append(starts[1:], len(text))
                crossing = (begin < starts[at]) | (end > stops[at])
                n = len(starts)
                out.append((np.arange(n), starts, stops, np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n), np.full(n, len(begin))))
                rows.append(np.full(n, row))
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names)

    schema = f"id {_kind(df, id_col)}, section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")] + ([F.col(starts_col).cast("array<bigint>").alias("starts")] if starts_col else [])
    return df.select(*columns).mapInArrow(run, schema).withColumnRenamed("id", id_col)
