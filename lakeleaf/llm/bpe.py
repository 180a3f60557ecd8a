"""Byte-level BPE by prefix dynamic programming (operators 1 and 6 encode with it).

Of all token sequences that spell a byte string, BPE yields one; every prefix of it is the BPE of the bytes
that it spells. So a byte prefix is fully described by the last token of its encoding, and that token is the only
vocabulary token that ends there and is compatible with the last token of the prefix before it. An encoder state is
therefore one token per byte: appending extends it, and an edit changes it only until it runs in step again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import held, steps

#: Pieces whose encodings one worker keeps; the store is emptied when it is full.
KEPT_PIECES = 300_000
#: Longer pieces are encoded but not kept.
KEPT_BYTES = 64
_NEVER = 1 << 60


class PrefixEncoder:
    """BPE over bytes for a vocabulary of ranks in which every byte is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        #: For each token the two that merge into it last; a byte is its own pair.
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        #: Every end of a token: its rank, or -1 if it is only the end of longer ones.
        self.ends: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                self.ends.setdefault(token[i:], -1)
            self.ends[token] = rank
            self.halves[rank] = (rank, rank)
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i], _NEVER), ranks.get(token[i:], _NEVER)
                if a < rank and b < rank and self.compatible(a, b):
                    self.halves[rank] = (a, b)
                    self.merged[a, b] = rank
                    break
        self._fits.clear()
        self.longest = max(map(len, ranks))

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one end of a token while it is merged together, each with the rank of the merge that takes it in (none for the token itself)."""
        edges = self._edges[right]
        found = edges.get(token)
        if found is None:
            half = self.halves[token][right]
            found = edges[token] = [(token, _NEVER)] + ([] if half == token else [(half, token), *self.edge(half, right)[1:]])
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE can leave these two tokens side by side: no two tokens that meet at the border are merged with each other first.

        Two of them meet until either is merged inwards; of equal ranks the merge that begins further left comes first."""
        merged = self.merged
        for a, a_until in self.edge(left, True):
            for b, b_until in self.edge(right, False):
                rank = merged.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def extend(self, piece: bytes, last: list[int], start: int) -> None:
        """Fill last[i], the last token of the encoding of piece[:i], for all i over start. last[0] is -1."""
        ends, fits = self.ends, self._fits
        del last[start + 1 :]
        for stop in range(start + 1, len(piece) + 1):
            found, at = [], stop - 1
            while at >= 0 and (rank := ends.get(piece[at:stop])) is not None:
                if rank >= 0:
                    found.append((at, rank))
                at -= 1
            for at, rank in reversed(found):
                if not at:
                    break
                pair = (last[at], rank)
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    fit = fits[pair] = self.compatible(*pair)
                if fit:
                    break
            last.append(rank)

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding of the whole of what last describes."""
        out, at, spelled = [], len(last) - 1, self.spelled
        while at:
            out.append(last[at])
            at -= len(spelled[last[at]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        last = [-1]
        self.extend(piece, last, 0)
        return self.tokens(last)

    def encode_pieces(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each piece with its tokens. In sorted order a piece keeps the state of the prefix that it shares with the one before."""
        before, last = b"", [-1]
        for piece in sorted(pieces):
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            self.extend(piece, last, same)
            yield piece, self.tokens(last)
            before = piece

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class PrefixState:
    """The encoding of one byte string (a piece) under appends and edits, always that of the whole."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, [-1]
        encoder.extend(data, self.last, 0)

    @property
    def ids(self) -> list[int]:
        return self.encoder.tokens(self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last, len(self.last) - 1)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in place of data[start:stop]; returns how many prefixes were computed again.

        The state of a prefix depends on the `longest` bytes and states before it, so once that many states behind the edit equal the old ones, the rest does too."""
        old, tail = self.last, self.data[stop:]
        self.data = self.data[:start] + new + tail
        state, shift, same = old[: start + 1], len(new) - (stop - start), 0
        for end in range(start + 1, len(self.data) + 1):
            self.encoder.extend(self.data[:end], state, end - 1)
            before = end - shift
            same = same + 1 if before > stop and state[end] == old[before] else 0
            if same >= self.encoder.longest:
                self.last = state + old[before + 1 :]
                return end - start
        self.last = state
        return len(self.data) - start


@lru_cache(maxsize=1)
def load_ranks(path: str) -> PrefixEncoder:
    """The encoder of a file of base64 tokens and ranks; one for each worker process."""
    with open(path, "rb") as lines:
        return PrefixEncoder({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


class TextEncoder:
    """Encodes whole texts, each match of a pattern separately, and keeps the encodings of frequent pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.encoder, self.find, self.kept = load_ranks(path), regex.compile(pattern).findall, {}
        size = max(self.encoder.spelled) + 1
        self.token_bytes = [self.encoder.spelled.get(i, b"") for i in range(size)]
        self.token_length = np.fromiter(map(len, self.token_bytes), np.int64, size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        found = [self.find(text) for text in texts]
        wanted = set().union(*found) - self.kept.keys()
        if wanted:
            if len(self.kept) + len(wanted) > KEPT_PIECES:
                self.kept.clear()
                wanted = set().union(*found)
            by_bytes = {piece.encode(): piece for piece in wanted}
            new = {by_bytes[piece]: np.array(ids, "<u4").tobytes() for piece, ids in self.encoder.encode_pieces(by_bytes)}
            self.kept.update(new)
        get = self.kept.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in found]
        if wanted:
            for piece in wanted:
                if len(piece) > KEPT_BYTES:
                    del self.kept[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def text_encoder(path: str, pattern: str) -> TextEncoder:
    return held(("text", path, pattern), lambda: TextEncoder(path, pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, `ids` array<bigint>.

    A null or empty text has no ids. Other columns of the input are not read. Repeated rows are encoded each. Texts may be of any length: a worker
    holds a few MB of text, or one longer text, at a time. Without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks_path, pattern)
        for part, texts in steps(batches, "text"):
            ids = encoder.encode(texts)
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["id", "ids"])

    return _named(df, id_col, text_col).mapInArrow(run, f"id {_kind(df, id_col)}, ids array<bigint>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id, `decoded` binary, the bytes that the ids spell (null ids: none). An id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = load_ranks(ranks_path).spelled
        for batch in batches:
            out = [b"".join(map(spelled.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {_kind(df, id_col)}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and then decode() of each row in one pass, returned as digests instead of ids and bytes.

    Columns: the id, n_tokens bigint, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes), both
    lower-case hex. Null and empty texts give 0 tokens and the digests of no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks_path, pattern)
        for part, texts in steps(batches, "text"):
            ids = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _named(df, id_col, text_col).mapInArrow(run, f"id {_kind(df, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), _text(text_col).alias("text"))


def _text(text_col: str) -> Column:
    return F.col(text_col).cast("string")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
