"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits (the last one padded). The binary Golay
code is perfect: each 23-bit word lies within 3 bits of one codeword. A segment's keys are the index of that
codeword and, where it is exactly 3 bits away, those of the five codewords 4 bits away; any two words that
differ in at most 2 bits then share a key. Of fingerprints that differ in at most 4 bits, either one segment is
equal and another differs in 2 bits at most: they share that segment and a codeword index of the other. Or every
segment differs, and two of them in one bit each: they share a half of either. Joining on these keys (about 44 a
fingerprint) finds every link, and each candidate is verified on the whole fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links
from .common import as_bytes, lower_words, map_batches, materialize, mix64
from .components import connected_components

#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Min-hash bands, and the remixes in each.
BANDS, BAND_ROWS = 16, 4
#: Sets of a component that are compared in one block, and the most blocks of a component.
GROUP, MOST_BLOCKS = 256, 32


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of each byte of a word; by remainder, the error patterns that lead to its codewords, and how many."""
    of_byte = np.array([[_remainder(b << (8 * i)) if b << (8 * i) < 1 << 23 else 0 for b in range(256)] for i in range(3)], np.uint32)
    errors = np.zeros((2048, 6), np.uint32)
    count = np.zeros(2048, np.int64)
    nearest = np.full(2048, 9)
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            pattern = sum(1 << i for i in places)
            s = _remainder(pattern)
            nearest[s] = min(nearest[s], weight)
            if weight < 4 or nearest[s] == 3:
                errors[s, count[s]] = pattern
                count[s] += 1
    return of_byte, errors, count


_cached: list = []


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of 23-bit words, six columns, and which of the columns count."""
    if not _cached:
        _cached.extend(_tables())
    of_byte, errors, count = _cached
    w = words.astype(np.uint32)
    s = of_byte[0][w & 255] ^ of_byte[1][w >> 8 & 255] ^ of_byte[2][w >> 16]
    return (w[:, None] ^ errors[s]) >> 11, np.arange(6) < count[s][:, None]


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of all keys of 64-bit fingerprints: two that differ in at most 4 bits share one."""
    words = [(prints >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    coded = [golay_keys(w) for w in words]
    rows, keys = [], []
    for n, (i, j) in enumerate(itertools.permutations(range(3), 2)):  # one equal, the other within 2 bits
        index, counts = coded[j]
        rows.append(np.nonzero(counts)[0])
        keys.append((words[i][:, None] << 12 | index.astype(np.int64))[counts] | n << 40)
    for n, (i, j) in enumerate(itertools.combinations(range(3), 2)):  # one bit in each: one half of both is equal
        for m, (x, y) in enumerate(itertools.product(halves(words[i], SEGMENTS[i][1]), halves(words[j], SEGMENTS[j][1]))):
            rows.append(np.arange(len(prints)))
            keys.append(x << 12 | y | (6 + 4 * n + m) << 40)
    return np.concatenate(rows), np.concatenate(keys)


def with_salt(found: tuple[np.ndarray, np.ndarray], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one of several fingerprints, kept apart from those of the others."""
    return found[0], found[1] | salt << 45


def halves(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return words & (1 << size // 2) - 1, words >> size // 2


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` lower-cased words, joined by spaces; of all words if there are fewer."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, shingle: int = 4, prints: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, prints array<long>): 64-bit fingerprints of whole texts as signed longs; without words, zeros.

    The first is over the shingles' XXH64; each further one is over a remix of the same hashes.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text in as_bytes(batch.column(1)):
                h = shingle_hashes(text, shingle)
                row = []
                for i in range(prints):
                    if i:
                        h = mix64(h + np.uint64(i))
                    row.append(majority(h))
                out.append(row)
            values = pa.array(np.array(out, np.uint64).reshape(-1, prints).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, len(values) + 1, prints, dtype=np.int32), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "prints"])

    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), scan, f"id {kind}, prints array<long>")


def _decode(prints: int):
    def decode(column: pa.Array) -> np.ndarray:
        if pa.types.is_integer(column.type):
            return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, prints)

    return decode


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, prints: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, prints, component_id) for every row: groups of documents joined by links.

    Documents link where their fingerprints, taken together, differ in ``max_bits`` bits or fewer. With one
    fingerprint and up to 4 bits every link is found. With several, or more bits, a link is found if one of
    the fingerprints differs in 4 bits at most. component_id is the smallest id that links reach.

    Equal fingerprints are one node from the start, so copies, however many, cost one row; null and empty
    texts have the fingerprint zero, and link like any other. Rows without an id get their group's smallest
    id (null if the group has none). Repeated ids give repeated rows. An empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[id_column]
    marked = materialize(simhash(docs, shingle, prints, id_column, text_column), "prints")
    classes = materialize(marked.groupBy("prints").agg(F.min("id").alias("first"), F.min(F.xxhash64("prints")).alias("node")), "classes")

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, prints)
                rows, keys = map(np.concatenate, zip(*(with_salt(fingerprint_keys(words[:, i]), i) for i in range(prints)), strict=True))
                node = part.column(0).to_numpy(zero_copy_only=False)[rows]
                if prints == 1:
                    payload = pa.array(words[rows, 0].view(np.int64))
                else:
                    payload = pa.array([x.tobytes() for x in words], pa.binary()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), payload], names=["key", "id", "payload"])

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64) <= max_bits

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= max_bits

    rows = map_batches(classes.select("node", "prints"), spread, f"key long, id long, payload {'long' if prints == 1 else 'binary'}")
    links = bucket_links(rows, near, paired, _decode(prints))
    roots = connected_components(links)
    named = classes.join(roots, classes.node == roots.node, "left").select(
        "prints", "first", F.coalesce("root", classes.node).alias("root")
    )
    # tables on both sides of each join, so that a large group can be split between tasks
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_class = materialize(named.join(smallest, "root").select("prints", F.col("component_id").cast(kind).alias("component_id")), "groups")
    return marked.join(of_class, "prints")


def distinct_shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingle_hashes(text, size))


def set_node(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes(), SEED) - (1 << 63)


def band_keys(shingles: np.ndarray) -> list[int]:
    """``BANDS`` signed keys, each over the smallest hashes of ``BAND_ROWS`` remixes; none for an empty set."""
    if not len(shingles):
        return []
    seeds = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    least = np.full(len(seeds), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), CHUNK >> 4):
        least = np.minimum(least, mix64(shingles[None, at : at + (CHUNK >> 4)] ^ seeds[:, None]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix64(keys * np.uint64(31) + column)
    return keys.view(np.int64).tolist()


def far_bits(similarity: float, bits: int) -> int:
    """A distance that fingerprints of sets of this Jaccard similarity pass once in 100,000 times."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 4.6 * np.sqrt(bits * p * (1 - p)))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; empty sets are alike."""
    few, many = sorted((len(x), len(y)))
    if few < similarity * many:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (few + many - both)


def near_groups(docs: DataFrame, shingle: int = 5, prints: int = 2, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, component_id) for every row: documents joined by links of shingle sets of at least this Jaccard similarity.

    Candidates share a Golay key of the first fingerprint or a min-hash band and have fingerprints (``prints`` of
    them, over the distinct shingles) that are not beyond ``far_bits``. At the similarity 0.8 a pair shares one of 16 bands of 4 with probability
    0.9998. The candidates' components hold all links; in each, the exact sets are compared. Components over
    ``GROUP`` sets are cut into blocks, each pair of blocks for itself. Equal sets are one node.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes, words, bands = [], [], []
            for text in as_bytes(batch.column(1)):
                h = distinct_shingles(text, shingle)
                nodes.append(set_node(h))
                bands.append(band_keys(h))
                row = []
                for i in range(prints):
                    if i:
                        h = mix64(h + np.uint64(i))
                    row.append(majority(h))
                words.append(np.array(row, "<u8").tobytes())
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(words, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "prints", "bands"])

    marked = materialize(map_batches(rows, mark, f"id {kind}, node long, prints binary, bands array<long>"), "marked")
    classes = materialize(marked.groupBy("node").agg(F.min("id").alias("first"), F.first("prints").alias("prints"), F.first("bands").alias("bands")), "classes")

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, prints)
                found = [fingerprint_keys(words[:, 0])]
                found.append((pc.list_parent_indices(part.column(2)).to_numpy(), pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False)))
                rows, keys = map(np.concatenate, zip(*found, strict=True))
                at_row = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(at_row), part.column(1).take(at_row)], names=["key", "id", "payload"])

    most = far_bits(similarity, 64 * prints)

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64) <= most

    def close_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most

    keyed = map_batches(classes.select("node", "prints", "bands"), spread, "key long, id long, payload binary")
    coarse = connected_components(bucket_links(keyed, close, close_pairs, _decode(prints)))
    members = materialize(classes.select("node", "first").join(coarse, "node"), "members")
    # a group's number of blocks goes with its members' narrow rows; tables on both sides, so that a large group can be split between tasks
    sizes = materialize(members.groupBy("root").agg(F.least(F.ceil(F.count(F.lit(1)) / GROUP), F.lit(MOST_BLOCKS)).cast("int").alias("blocks")), "sizes")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [distinct_shingles(text, shingle) for text in as_bytes(batch.column(3))]
            own = pa.array([set_node(h) for h in found], pa.int64())  # a repeated id may bring another text
            payload = pa.array([h.astype("<u8").tobytes() for h in found], pa.binary())
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], payload], names=["root", "node", "blocks", "payload"])
            yield out.filter(pc.equal(own, batch.column(1)))

    dealt_to = members.join(sizes, "root")
    texts = rows.join(dealt_to, rows["id"] == dealt_to["first"]).select("root", "node", "blocks", "text")
    dealt = materialize(map_batches(texts, sets, "root long, node long, blocks int, payload binary"), "sets")
    dealt = dealt.withColumns({"own": F.pmod(F.xxhash64("node"), F.col("blocks")), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))})
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("node").alias("id"), "payload")

    def decode(column: pa.Array) -> np.ndarray:
        out = np.empty(len(column), object)
        out[:] = [np.frombuffer(x, "<u8") for x in column.to_pylist()] or None
        return out

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([[similar(a, b, similarity) for b in y] for a in x], bool).reshape(len(x), len(y))

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([similar(a, b, similarity) for a, b in zip(x, y, strict=True)], bool)

    roots = connected_components(bucket_links(dealt, near, paired, decode, seeds=1))
    # tables on both sides of each join, so that a large group can be split between tasks
    named = materialize(classes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")
    smallest = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_class = materialize(named.join(smallest, "root").select("node", "component_id"), "groups")
    return marked.select("id", "node").join(of_class, "node").select("id", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 5, prints: int = 2, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near copies: of each group the row of the smallest id stays.

    Of rows that repeat an id, one stays (the one with the smallest hash of text). Rows without an id are
    kept as they are. Columns are those of ``docs``. Groups are those of ``near_groups``.
    """
    groups = near_groups(docs.where(F.col(id_column).isNotNull()), shingle, prints, similarity, id_column, text_column)
    keep = groups.where("id = component_id").select(F.col("id").alias("__kept_id")).distinct()
    rows = docs.join(keep, docs[id_column] == F.col("__kept_id"), "left_semi")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    twice = rows.groupBy(id_column).agg(F.count(F.lit(1)).alias("__n"), F.min(F.xxhash64(text)).alias("__h")).where("__n > 1")
    if not twice.take(1):
        return rows.unionByName(docs.where(F.col(id_column).isNull()))
    first = rows.join(twice.select(F.col(id_column).alias("__i"), "__h"), (F.col(id_column) == F.col("__i")), "left")
    first = first.where(F.col("__h").isNull() | (F.xxhash64(text) == F.col("__h"))).select(*docs.columns).dropDuplicates([id_column])
    return first.unionByName(docs.where(F.col(id_column).isNull()))
