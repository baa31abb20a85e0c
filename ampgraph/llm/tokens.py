"""A tokenizer's ids, and token counts by a two-tier lookup of pre-tokens."""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import as_bytes, map_batches

#: Entries of a worker's cache; a full one keeps its first quarter.
CACHE = 400_000
#: Entries that a partition, and the whole corpus, contribute to the frequent tier.
PART_TOP, TABLE_TOP = 4096, 32_768
#: Entries that a partition counts before it drops its rare ones.
COUNTED = 300_000
#: Bytes from U+0240 on: other scripts, where Unicode versions of two regex engines may differ, so the library cuts them.
_OTHER = re.compile(rb"[\xc9-\xff]")

_loaded: dict[str, PreTokens] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PreTokens:
    """The ids that the tokenizers library gives for a byte-level BPE file, and their number by cached pre-tokens.

    The merges never cross a pre-token, so a text's count is the sum of its pre-tokens'. A text is cut by the
    pattern here, or by the library's own pre-tokenizer where it has characters from U+0240 on; either way the
    pre-tokens are looked up. Only texts with special strings are encoded by the library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(pattern).findall
        ranks = merge_ranks(path)
        self.merger = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.lengths: dict[str, int] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, straight from the library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_each(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token. Those of a space and letters keep apart in one string, and are encoded at once."""
        words = [t for t in tokens if t[0] == " " and t[1:].isalpha()]
        known = {}
        if len(words) > 1:
            got = self.library.encode("".join(words), add_special_tokens=False)
            number, packed = got.word_ids, np.array(got.ids, "<u4").tobytes()
            if number[-1] == len(words) - 1:
                cuts = (4 * np.searchsorted(number, np.arange(len(words) + 1))).tolist()
                known = {w: packed[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}
        return [known[t] if t in known else self.encode(t) for t in tokens]

    def plain(self, raw: bytes, text: str) -> bool:
        return not _OTHER.search(raw) and not self.has_special(text)

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def cut(self, raw: bytes, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not _OTHER.search(raw):
            return self.split(text)
        given = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [given[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(given)]

    def packed(self, raw: bytes) -> bytes:
        """A text's ids, packed. Plain text is merged by tiktoken over the same vocabulary, where its ids are ranks."""
        text = raw.decode("utf-8", "replace")
        if self.merger is None or not self.plain(raw, text):
            return self.encode(text)
        return np.array(self.merger.encode_ordinary(text), "<u4").tobytes()

    def count(self, raw: bytes, frequent: dict[str, int]) -> int:
        text = raw.decode("utf-8", "replace")
        if self.has_special(text):
            return len(self.encode(text)) // 4
        tokens = self.cut(raw, text)
        parts = list(map(frequent.get, tokens))
        misses = [t for t, p in zip(tokens, parts, strict=True) if p is None]
        if not misses:
            return sum(parts)
        new = list(dict.fromkeys(t for t in misses if t not in self.lengths))
        found = {t: len(x) // 4 for t, x in zip(new, self.encode_each(new), strict=True)}
        self.lengths.update(found)
        total = sum(p for p in parts if p is not None) + sum(map(self.lengths.__getitem__, misses))
        self.lengths = _room(self.lengths)
        return total


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file, if its merges are in the order of their ids; else nothing."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in pairs]
    if made != sorted(set(made)) or len(made) + 256 < len(set(model["vocab"].values())) - 1:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    ids = {*made, *(model["vocab"][c] for c in of_char)}
    return {bytes(of_char[c] for c in t): i for t, i in model["vocab"].items() if i in ids}


def _room(cache: dict) -> dict:
    """The cache, or of a full one the entries that came first: frequent pre-tokens do."""
    return cache if len(cache) < CACHE else dict(itertools.islice(cache.items(), CACHE // 4))


def pre_tokens(path: str, pattern: str) -> PreTokens:
    """One per Python worker and tokenizer."""
    if path not in _loaded:
        _loaded[path] = PreTokens(path, pattern)
    return _loaded[path]


def frequent_lengths(docs: DataFrame, tokenizer: str, pattern: str, text_column: str = "text") -> tuple[bytes, bytes]:
    """The frequent tier: pre-tokens joined by NUL, and their token counts as bytes.

    Every partition counts the pre-tokens of its whole texts in bounded space and gives its ``PART_TOP`` most
    frequent ones as one packed row. Such summaries merge pairwise in a tree on the executors; at most
    ``TABLE_TOP`` entries reach the driver, whatever the corpus. What is missing costs time, never a result.
    """

    def summarise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = pre_tokens(tokenizer, pattern), Counter()
        for batch in it:
            for raw in as_bytes(batch.column(0)):
                text = raw.decode("utf-8", "replace")
                if not encoder.has_special(text):
                    seen.update(encoder.cut(raw, text))
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = heapq.nlargest(PART_TOP, seen.items(), key=lambda x: (x[1], x[0]))
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([[t for t, _ in top]]), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["token", "n"])

    def merge(x: Counter, y: Counter) -> Counter:
        both = x + y
        return both if len(both) <= 2 * TABLE_TOP else Counter(dict(both.most_common(TABLE_TOP)))

    parts = map_batches(docs.select(F.col(text_column).cast("string").alias("text")), summarise, "token array<string>, n array<long>")
    counts = parts.rdd.map(lambda r: Counter(dict(zip(r["token"], r["n"], strict=True)))).treeAggregate(Counter(), merge, merge, depth=3)
    encoder = pre_tokens(tokenizer, pattern)
    top = [t for t, _ in counts.most_common(TABLE_TOP) if "\0" not in t]
    sized = [(t, n) for t in top if (n := len(encoder.encode(t)) // 4) < 256]
    return "\0".join(t for t, _ in sized).encode(), bytes(n for _, n in sized)


def token_counts(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row per row of ``docs``.

    Map-side two-tier lookup: a broadcast table of frequent pre-tokens' lengths (at most ``TABLE_TOP`` entries,
    under 1 MB), and behind it a bounded cache in each worker that asks the library. No pre-token is shuffled.
    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are each counted; an
    empty table gives an empty one; further columns are ignored.
    """
    path, split = tokenizer or default_tokenizer(), pattern or default_pattern()
    spark = docs.sparkSession
    tier = spark.sparkContext.broadcast(frequent_lengths(docs, path, split, text_column))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pre_tokens(path, split)
        tokens, sizes = tier.value
        frequent = dict(zip(tokens.decode().split("\0"), sizes, strict=True)) if sizes else {}
        for batch in it:
            texts = as_bytes(batch.column(1))
            n = pa.array([encoder.count(x, frequent) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
