"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, materialize
from .tokens import default_pattern, default_tokenizer, pre_tokens

#: Pieces that one packer takes; the number of packers follows the number of pieces.
GROUP = 20_000
#: Bins that a packer holds open: far fewer than a group fills. Without any bound a group of documents gets no
#: fewer sequences (20,369 for two groups, as with 256; 64 bins: 20,372; the tokens alone would fill 20,196).
OPEN = 256


class BestFit:
    """At most ``space`` open bins in a bitset keyed by free space; the fullest closes first."""

    def __init__(self, size: int, space: int = OPEN):
        self.size, self.space = size, space
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item: the open bin that it leaves least free, or else a new bin."""
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            room, bin_ = self.size, self.made
            self.made += 1
            if length < self.size and self.open == self.space:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if left := room - length:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - room

    def _take(self, room: int) -> int:
        bin_ = self.free[room].pop()
        self.open -= 1
        if not self.free[room]:
            self.bits ^= 1 << room
        return bin_


def token_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, pattern: str | None = None, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each whole text's ids and ``end_id``, cut where over ``size``.

    Of a cut document the first piece is the shorter one. ids are little-endian unsigned 32-bit integers.
    """
    path, split = tokenizer or default_tokenizer(), pattern or default_pattern()
    end = int(end_id).to_bytes(4, "little")
    kind = dict(docs.dtypes)[id_column]

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pre_tokens(path, split)
        for batch in it:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, raw in enumerate(as_bytes(batch.column(1))):
                ids = encoder.packed(raw) + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, size: int = 2048, space: int = OPEN, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``size`` tokens, gapless from offset 0.

    Only lengths are dealt out, in groups of about ``group`` pieces by a hash of the row's number, each to one
    packer; a piece that fills a sequence gets one of its own. A packer takes its pieces in the order of row numbers
    and never comes back to one. A length of null or under 1 takes no place (sequence_id null).
    """
    fixed = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-fixed.count() // group))
    lengths = fixed.where("length >= 1").select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(groups)).alias("__group"))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row")
        fit = BestFit(size, space)
        got = np.array([fit.put(n) for n in pdf["length"].tolist()], np.int64).reshape(-1, 2)
        return pd.DataFrame({"__at": pdf["__row"], "sequence_id": (int(key[0]) << 32) + got[:, 0], "offset": got[:, 1]})

    placed = lengths.groupBy("__group").applyInPandas(place, "__at long, sequence_id long, offset long")
    return fixed.join(placed, fixed["__row"] == placed["__at"], "left").drop("__row", "__at")


def pack_documents(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, space: int = OPEN, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A null or empty text is ``end_id`` alone. Null ids stay null; repeated rows are each packed; an empty table
    gives an empty one; further columns are ignored.
    """
    return pack(token_pieces(docs, size, end_id, tokenizer, None, with_ids, id_column, text_column), size, space)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces that carry ids; at most ``size`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
