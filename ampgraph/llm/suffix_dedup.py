"""Exact repeated passages by sparse suffix arrays.

Of all the suffixes of a text's words, only those at minimiser positions are kept: in each window of
consecutive word runs of length ``ANCHOR``, the one of the smallest hash. Any passage of ``length`` words holds
a whole window, so its copies keep the same suffix at the same place. A suffix whose leading ``ANCHOR`` words
no other has can't be part of a repeat and goes at once. Around each suffix lies its block: all passages of
``length`` words whose minimiser it is. Suffixes with equal leading words and equal blocks are one from there
on, so copies, however many, cost one row. The blocks that share leading words but differ are fetched as words,
sorted to the right of the suffix and to its left, and neighbours compared: the longest common prefixes of
neighbours tell how far every match extends to either side, and so which passages repeat. Overlapping repeats
join to maximal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import gathered
from .common import as_bytes, discard, map_batches, materialize, mix64, shuffle_partitions

#: Words that a minimiser hashes: the leading words by which suffixes first meet.
ANCHOR = 12
#: Different blocks of one anchor that a task sorts; the passages of more are sorted one by one, over all tasks.
RUN = 4096
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CACHE = 150_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return mix64(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))


def span_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words[start:stop] for each span: a polynomial modulo 2^64, by differences of running sums."""
    down = np.cumprod(np.full(len(words), INVERSE, np.uint64))
    up = np.cumprod(np.full(len(words), BASE, np.uint64))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * down)]
    return mix64((sums[stop] - sums[start]) * up[start]) if len(start) else np.empty(0, np.uint64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    start = np.arange(max(0, len(words) - size + 1))
    return span_hashes(words, start, start + size)


def both_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for a span: a signed long, and a signed int of a second hash."""
    second = span_hashes(mix64(words + np.uint64(1)), start, stop) >> np.uint64(32)
    return span_hashes(words, start, stop).view(np.int64), second.astype(np.uint32).view(np.int32)


def minimisers(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word run, for each passage of ``length`` words the place of its minimiser: leftmost smallest)."""
    runs = run_hashes(words, ANCHOR)
    window = length - ANCHOR + 1
    if len(runs) < window:
        return runs, np.empty(0, np.int64)
    out = []
    for at in range(0, len(runs) - window + 1, 20_000):
        view = np.lib.stride_tricks.sliding_window_view(runs[at : at + 20_000 + window - 1], window)
        out.append(at + np.arange(len(view)) + view.argmin(1))
    return runs, np.concatenate(out)


def common_prefixes(rows: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``rows`` within their runs, and how many leading columns each row shares with the one before it.

    The first row of a run shares -1 columns.
    """
    order = np.lexsort((*rows.T[::-1], run))
    same = np.cumprod(rows[order[1:]] == rows[order[:-1]], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    same[run[order[1:]] != run[order[:-1]]] = -1
    return order, np.r_[-1, same][: len(order)]


def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal where rows share ``depth`` leading columns: neighbours that do are of one class."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def settle(run: np.ndarray, before: np.ndarray, words: list[list[bytes]], first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, low, high, first): which passages of blocks repeat, and the smallest place of their copies.

    Each row is a block: the words around a suffix, ``before`` of them to its left. A passage that begins ``o``
    words left of the suffix repeats if another block of the run agrees in ``o`` words to the left and in the
    rest to the right, or if its own block has several places (``first`` and ``last``, as ranks, differ). low and
    high bound a range of ``o`` with the same first place.
    """
    number: dict[bytes, int] = {}
    left, right = (np.zeros((len(words), n), np.int32) for n in (length - ANCHOR, length))
    after = np.empty(len(words), np.int64)
    for i, (w, b) in enumerate(zip(words, before.tolist(), strict=True)):
        code = [number.setdefault(x, len(number) + 1) for x in w]
        left[i, :b] = code[:b][::-1]
        right[i, : len(w) - b] = code[b:]
        after[i] = len(w) - b
    to_left, to_right = common_prefixes(left, run), common_prefixes(right, run)
    found = np.full((len(words), length - ANCHOR + 3), -1, np.int64)  # by o + 1
    for o in range(length - ANCHOR + 1):
        rows = np.flatnonzero((o <= before) & (length - o <= after))
        if not len(rows):
            continue
        key = classes(*to_left, o)[rows] * (len(words) + 1) + classes(*to_right, length - o)[rows]
        rows = rows[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least, most = np.minimum.reduceat(first[rows], begin), np.maximum.reduceat(last[rows], begin)
        found[rows, o + 1] = np.repeat(np.where(least != most, least, -1), np.diff(np.r_[begin, len(rows)]))
    changed = found[:, 1:] != found[:, :-1]
    row, low = np.nonzero(changed & (found[:, 1:] >= 0))
    _, high = np.nonzero(changed & (found[:, :-1] >= 0))
    return row, low, high - 1, found[row, low + 1]


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return texts.where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))


#: A place of a block, and the columns that bring the smallest and the largest place of equal blocks.
PLACE = ("doc_id", "text_key", "at")
_PLACES = [f"{end}_{c}" for end in ("first", "last") for c in PLACE]
_BLOCK = "anchor long, block long, block_check int, "
_ENDS = "first_doc_id long, first_text_key long, first_at int, last_doc_id long, last_text_key long, last_at int"


def repeated_spans(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, text_key, start, stop, first_doc_id, removed): maximal spans of words whose every passage of ``length``
    words stands elsewhere too, or again in the same text.

    Words are what white space of ASCII separates, as they are; start and stop count words. ``removed`` tells
    spans that have an earlier copy (by document id, then hash of the text, then place), from which all but the
    first copy can go, from spans that are the first copy of what they hold; first_doc_id is the document of that
    first copy (of the span's first passage). text_key is a hash of the row's text, which tells rows of one id apart.

    Null, empty and short texts have no spans. Rows without an id are ignored. Rows that repeat both id and text
    are one document, whose spans are given once. An empty table gives an empty one. Blocks are found equal by 160
    bits of hashes; where blocks of equal leading words differ, words themselves are compared (their passages by
    96 bits more, where an anchor has over ``run`` different blocks). Other columns play no part.
    """
    texts = _texts(docs, id_column, text_column)

    def suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "block", "block_check", "doc_id", "text_key", "at", "start", "stop"]
        for batch in it:
            row, made = [], []
            for i, text in enumerate(as_bytes(batch.column(1))):
                words = word_hashes(text.split())
                runs, at = minimisers(words, length)
                if len(at):
                    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    end = np.r_[begin[1:], len(at)] + length - 1
                    made.append((runs[at[begin]].view(np.int64), *both_hashes(words, begin, end), at[begin], begin, end))
                    row.append(np.full(len(begin), i))
            if made:
                anchor, block, check, *places = (np.concatenate(c) for c in zip(*made, strict=True))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(block), pa.array(check), batch.column(0).take(take), batch.column(2).take(take), *(pa.array(x.astype(np.int32)) for x in places)], names=names)
        _hashes.clear()

    kept = map_batches(texts.select("doc_id", "text", "text_key"), suffixes, _BLOCK + "doc_id long, text_key long, at int, start int, stop int")
    kept = materialize(kept, "suffixes")
    # suffixes whose leading words others have; where all of them agree in their whole block, one row decides
    agreed = kept.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("block").alias("b1"), F.max("block").alias("b2"), F.min("block_check").alias("c1"), F.max("block_check").alias("c2"),
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"),
    )
    agreed = materialize(agreed.where("n > 1").select("anchor", "first_doc_id", "last_doc_id", ((F.col("b1") == F.col("b2")) & (F.col("c1") == F.col("c2"))).alias("same")), "agreed")
    # tables on both sides of each join, so that a hot suffix can be split between tasks
    shared = materialize(kept.join(agreed, "anchor"), "agreeing")
    discard(kept, agreed)
    place = F.struct("text_key", "start")
    leaders = shared.where("same and doc_id = first_doc_id").groupBy("anchor").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("last_doc_id").alias("__last"), F.first("first_doc_id").alias("__first"))
    leaders = materialize(leaders.where("__first != __last or first != last").select("anchor", "first"), "leaders")
    plain = shared.where("same").join(leaders, "anchor").select(
        "doc_id", "text_key", "start", "stop", "first_doc_id", ((F.col("doc_id") != F.col("first_doc_id")) | (place != F.col("first"))).alias("removed")
    )
    contested = shared.where("not same").drop("first_doc_id", "last_doc_id")
    verdicts = materialize(_verdicts(texts, contested, length, run), "verdicts")
    mine = [F.col(c) == F.col(f"first_{c}") for c in PLACE]
    fine = contested.join(verdicts, ["anchor", "block", "block_check"]).select(
        "doc_id", "text_key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("stop"), "first_doc_id",
        (~(mine[0] & mine[1] & mine[2])).alias("removed"),
    )

    # spans of one text and kind that overlap or touch are one
    def spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        for batch in it:
            if not batch.num_rows:
                continue
            doc, key, at, stop, first_doc, gone = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (gone[1:] != gone[:-1]) | (at[1:] > stop[:-1])]
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], len(doc)] - 1
            made = [list(x) for x in zip(doc[begin], key[begin], at[begin], stop[end], first_doc[begin], gone[begin], strict=True)]
            if open_ is not None:
                head = made[0]
                if open_[:2] == head[:2] and open_[5] == head[5] and head[2] <= open_[3]:
                    made[0] = [*open_[:3], head[3], *open_[4:]]
                else:
                    made.insert(0, open_)
            open_ = made.pop()
            if made:
                yield _spans(made)
        if open_ is not None:
            yield _spans([open_])

    ordered = plain.unionByName(fine).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "removed", "start")
    return map_batches(ordered, spans, "doc_id long, text_key long, start int, stop int, first_doc_id long, removed boolean")


def _verdicts(texts: DataFrame, contested: DataFrame, length: int, run: int) -> DataFrame:
    """(anchor, block, block_check, low, high, first place): of each different block, the passages that repeat.

    low and high say how many words before the suffix such passages begin.
    """
    ends = [F.min(F.struct(*PLACE, "start", "stop")).alias("first"), F.max(F.struct(*PLACE)).alias("last")]
    blocks = materialize(contested.groupBy("anchor", "block", "block_check").agg(*ends), "blocks")
    held = F.struct("anchor", "block", "block_check", "first.at", "first.start", "first.stop", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in PLACE))
    wanted = blocks.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).agg(F.collect_list(held).alias("blocks"))

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parent, rows = pc.list_parent_indices(batch.column(1)).to_numpy(), batch.column(1).flatten()
            field = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
            start, stop = field["start"].to_numpy(), field["stop"].to_numpy()
            split = [text.split() for text in as_bytes(batch.column(0))]
            words = [b" ".join(split[k][a:b]) for k, a, b in zip(parent.tolist(), start.tolist(), stop.tolist(), strict=True)]
            before = pa.array(field["at"].to_numpy() - start)
            names = ["anchor", "block", "block_check"]
            yield pa.RecordBatch.from_arrays([*(field[c] for c in names), before, pa.array(words, pa.binary()), *(field[c] for c in _PLACES)], names=[*names, "before", "words", *_PLACES])

    rows = texts.join(wanted, ["doc_id", "text_key"]).select("text", "blocks")
    fetched = map_batches(rows, fetch, _BLOCK + "before int, words binary, " + _ENDS)
    crowded = materialize(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run).select("anchor"), "crowded")
    if crowded.take(1):
        fetched = materialize(fetched, "blocks-of-words")
        return _sorted_runs(fetched.join(crowded, "anchor", "left_anti"), length).unionByName(_passages(fetched.join(crowded, "anchor", "left_semi"), length))
    return _sorted_runs(fetched, length)


def _sorted_runs(fetched: DataFrame, length: int) -> DataFrame:
    """Verdicts on blocks whose anchors' runs are short: sorted, neighbours compared."""
    schema = _BLOCK + "low int, high int, first_doc_id long, first_text_key long, first_at int"

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for part in gathered(it):
            held = part if held is None else pa.concat_tables([held, part])
            held = held.combine_chunks()
            anchors = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield judged(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield judged(held)

    def judged(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        ends = [np.concatenate([part[f"{e}_{c}"].to_numpy() for e in ("first", "last")]) for c in PLACE]
        order = np.lexsort(ends[::-1])
        new = np.any([x[order[1:]] != x[order[:-1]] for x in ends], axis=0)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.r_[0, new])
        n = part.num_rows
        run = np.unique(part["anchor"].to_numpy(), return_inverse=True)[1]
        words = [x.split(b" ") for x in part["words"].to_pylist()]
        row, low, high, first = settle(run, part["before"].to_numpy(), words, rank[:n], rank[n:], length)
        at = order[np.searchsorted(rank[order], first)]
        take = pa.array(row)
        columns = [part[c].combine_chunks().take(take) for c in ("anchor", "block", "block_check")]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        places = [pa.array(x[at]) for x in ends]
        return pa.RecordBatch.from_arrays([*columns, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), *places], names=["anchor", "block", "block_check", "low", "high", *_PLACES[:3]])

    runs = fetched.repartition(shuffle_partitions(fetched.sparkSession), "anchor").sortWithinPartitions("anchor")
    return map_batches(runs, compare, schema)


def _passages(fetched: DataFrame, length: int) -> DataFrame:
    """Verdicts on the blocks of crowded anchors: each passage of a block is sorted and compared for itself."""

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = []
            for i, (words, before) in enumerate(zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                hashes = word_hashes(words.split(b" "))
                start = np.arange(len(hashes) - length + 1)
                made.append((np.full(len(start), i), before - start, *both_hashes(hashes, start, start + length)))
            if made:
                row, o, passage, check = (np.concatenate(c) for c in zip(*made, strict=True))
                take = pa.array(row)
                same = [batch.column(k).take(take) for k in (0, 1, 2, *range(5, 11))]
                yield pa.RecordBatch.from_arrays([pa.array(passage), pa.array(check), pa.array(o.astype(np.int32)), *same], names=["passage", "passage_check", "o", "anchor", "block", "block_check", *_PLACES])
        _hashes.clear()

    rows = materialize(map_batches(fetched, cut_up, "passage long, passage_check int, o int, " + _BLOCK + _ENDS), "passages")
    # places as those of the passage: the suffix lies o words after its beginning, in every copy
    first, last = (F.struct(*(F.col(f"{e}_{c}").alias(c) for c in PLACE)) for e in ("first", "last"))
    ends = rows.groupBy("passage", "passage_check").agg(F.min(first).alias("first"), F.max(last).alias("last")).where("first != last").drop("last")
    both = rows.drop(*_PLACES).join(materialize(ends, "repeats"), ["passage", "passage_check"])
    return both.select("anchor", "block", "block_check", F.col("o").alias("low"), F.col("o").alias("high"), *(F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE))


def remove_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without repeated passages: each text loses its removed spans, and n_chars follows where there is one.

    Of what is repeated, the first copy stays. Rows whose text has no word left go; rows that lost nothing, rows
    without an id and rows without words stay as they are. Columns are those of ``docs``.
    """
    spans = repeated_spans(docs, length, id_column, text_column).where("removed")
    cuts = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("start", "stop")).alias("__cuts"))
    key = F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    marked = docs.join(cuts, (docs[id_column].cast("long") == F.col("__doc")) & (key == F.col("__key")), "left").select(*docs.columns, "__cuts")
    place, n_chars = docs.columns.index(text_column), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            spans = batch.column(batch.num_columns - 1)
            rows = np.flatnonzero(~np.asarray(spans.is_null()))
            columns = batch.columns[:-1]
            if len(rows):
                texts = columns[place].to_pylist()
                for i in rows:
                    texts[i] = cut(texts[i], spans[int(i)].as_py())
                columns[place] = pa.array(texts, columns[place].type)
                if n_chars is not None:
                    sizes = columns[n_chars].to_pylist()
                    for i in rows:
                        sizes[i] = len(texts[i])
                    columns[n_chars] = pa.array(sizes, columns[n_chars].type)
                gone = {int(i) for i in rows if not texts[i]}
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield out.filter(pa.array([i not in gone for i in range(len(texts))])) if len(rows) and gone else out

    return map_batches(marked, apply, docs.schema)


def cut(text: str, spans) -> str:
    """The text without the words of the spans and the white space after each; untouched parts stay as they are."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        a, b = places[start][0], places[stop][0] if stop < len(places) else len(raw)
        if b > at:
            out.append(raw[at : max(at, a)])
            at = b
    return b"".join([*out, raw[at:]]).decode().strip()


def _spans(made: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
    columns = [pa.array([x.item() if hasattr(x, "item") else x for x in c], k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "stop", "first_doc_id", "removed"])


def oracle_sql(length: int = 50) -> str:
    """The spans as DuckDB SQL, for tables with one row an id: every passage by its words, then islands of passages."""
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), p AS (
  SELECT doc_id, s, array_to_string(w[s + 1 : s + {length}], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {length - 1})) AS s FROM d WHERE len(w) >= {length})
), r AS (
  SELECT doc_id, s, first_value(doc_id) OVER o AS first_doc_id, row_number() OVER o > 1 AS removed, count(*) OVER (PARTITION BY passage) AS n
  FROM p WINDOW o AS (PARTITION BY passage ORDER BY doc_id, s)
), i AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before + {length} < s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, removed ORDER BY s) AS island
  FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id, removed ORDER BY s) AS before FROM r WHERE n > 1)
)
SELECT doc_id, min(s)::INTEGER AS "start", (max(s) + {length})::INTEGER AS stop, arg_min(first_doc_id, s) AS first_doc_id, removed
FROM i GROUP BY doc_id, removed, island
"""
