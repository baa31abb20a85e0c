"""SentencePiece BPE ids by vectorised merge rounds, and the texts that ids stand for."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from .common import as_bytes, map_batches

SPACE = "▁"
NEVER = np.int32(2**31 - 1)
#: Characters of a cached word, entries of a worker's cache, and characters that are cut into words at once.
CACHED_CHARS, CACHE, AT_ONCE = 48, 300_000, 1 << 20
#: Rounds after which words that must merge one pair at a time (long runs of blanks) go on with a priority queue.
ROUNDS = 200
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

_loaded: dict[str, Pieces] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


class Pieces:
    """A BPE model with byte fallback, as tables: ids of characters, of pairs of symbols, and ranks.

    A symbol is a piece's id, or a number above them for characters that are no pieces; the last number stands for
    all characters that no piece holds. A lower rank merges first; pieces of equal score share a rank, and of
    equal ranks the leftmost pair merges first.
    """

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a BPE model with byte fallback and plain pieces only")
        if model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError(f"{path}: removes white space, so that decoding isn't a lookup of pieces")
        self.normalize = SentencePieceProcessor(model_file=path).normalize
        self._symbols(model)
        self._surfaces(model)
        self.words: dict[str, bytes] = {}

    def _symbols(self, model) -> None:
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        more = sorted({c for p in normal for c in p} - set(normal))
        symbol = normal | {c: len(model.pieces) + i for i, c in enumerate(more)}
        self.known = len(model.pieces)
        self.unknown = self.known + len(more)
        self.base = self.unknown + 1
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for text, i in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        scores = np.array([p.score for p in model.pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs, barriers = {}, {}
        for text, i in normal.items():
            for at in range(1, len(text)):
                left, right = symbol.get(text[:at]), symbol.get(text[at:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = i
                key = symbol[text[at - 1]] * self.base + symbol[text[at]]
                barriers[key] = min(barriers.get(key, NEVER), self.rank[i])
        self.pair_keys, self.pair_ids = _table(pairs)
        self.barrier_keys, self.barrier_ranks = _table(barriers)
        # ranks of pieces that can take part in a merge of the same or a lower rank: such must merge one at a time
        self.alone = np.zeros(int(self.rank.max()) + 2, bool)
        for part in (self.pair_keys // self.base, self.pair_keys % self.base):
            merged = part < self.known
            piece, then = part[merged], self.pair_ids[merged]
            self.alone[self.rank[piece[self.rank[then] <= self.rank[piece]]]] = True
        single = [c for c in "\n\r\t" if not any(c in p for p in normal if len(p) > 1)]
        apart = "".join(map(re.escape, single))
        ends_words = any(SPACE in p.lstrip(SPACE) for p in normal)
        cut = ".+" if ends_words else f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]+" if apart else "")
        self.split = re.compile(cut, re.DOTALL).findall
        self.border = None if ends_words else re.compile(f"[^{SPACE}]{SPACE}")

    def _surfaces(self, model) -> None:
        def surface(p):
            if p.type == BYTE:
                return bytes([int(p.piece[3:5], 16)])
            if p.type == UNKNOWN:
                return model.trainer_spec.unk_surface.encode()
            return b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode()

        self.surface = [surface(p) for p in model.pieces]
        self.decimal = [str(i) for i in range(len(model.pieces))]
        self.drops_space = model.normalizer_spec.add_dummy_prefix
        self.leading = [p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces]
        self.silent = [p.type == CONTROL for p in model.pieces]
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i

    def decode(self, ids) -> str:
        """The text of ids; a blank that the model put before the text goes, and each invalid byte becomes U+FFFD."""
        raw = b"".join([b"".join(map(self.surface.__getitem__, part)) for part in _slices(ids)])
        first = next((i for part in _slices(ids) for i in part if not self.silent[i]), None)
        if self.drops_space and first is not None and self.leading[first]:
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")

    def ids_digest(self, ids) -> str:
        """The SHA-256 of the ids in decimal, joined by commas."""
        sha, comma = hashlib.sha256(), ""
        for part in _slices(ids):
            sha.update((comma + ",".join(map(self.decimal.__getitem__, part))).encode())
            comma = ","
        return sha.hexdigest()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text. Words that many texts share are merged once; the others in flat arrays together."""
        found: list[list[bytes]] = [[] for _ in texts]
        held, chars = [], 0
        for n, text in enumerate(texts):
            for part in self._parts(self.normalize(text)):
                held.append((n, self.split(part)))
                chars += len(part)
                if chars >= AT_ONCE:
                    self._settle(held, found)
                    held, chars = [], 0
        self._settle(held, found)
        return [np.frombuffer(b"".join(x), np.int32) for x in found]

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts that end where a word does."""
        at = 0
        while at < len(text):
            border = self.border.search(text, at + AT_ONCE) if self.border else None
            yield text[at : (end := border.start() + 1 if border else len(text))]
            at = end

    def _settle(self, held: list[tuple[int, list[str]]], found: list[list[bytes]]) -> None:
        known = self.words
        new = sorted(set().union(*(words for _, words in held)).difference(known))
        known.update(zip(new, self.merge(new), strict=True))
        for n, words in held:
            found[n].append(b"".join(map(known.__getitem__, words)))
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        if len(known) > CACHE:
            self.words = dict(itertools.islice(known.items(), CACHE // 4))

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, merged in rounds over one flat array of symbols.

        No merge crosses two characters that no piece holds side by side, so words fall into segments there.
        Each round finds the least rank in every segment and merges its pairs from the left at once (one pair alone
        where a merge could open another of no higher rank). So it does with pairs whose borders on both sides no piece
        of a rank as low spans: nothing can reach them before they merge. Then the arrays are compacted.
        """
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.of_char[code]
        border = np.full(len(code), NEVER, np.int32)  # the least rank that can span the right end of a symbol
        border[:-1] = _look(self.barrier_keys, self.barrier_ranks, symbol[:-1].astype(np.int64) * self.base + symbol[1:])
        border[:-1][word[:-1] != word[1:]] = NEVER
        place = np.arange(len(code))
        done = []
        pair, rank = self._pairs(symbol, border)
        for turn in itertools.count():
            ends = border == NEVER
            starts = np.flatnonzero(np.r_[True, ends[:-1]]) if len(symbol) else np.zeros(0, np.int64)
            if not len(starts):
                break
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbol)])
            open_ = np.repeat(least != NEVER, length)
            done.append((place[~open_], symbol[~open_]))
            symbol, border, place, pair, rank = (x[open_] for x in (symbol, border, place, pair, rank))
            if not len(symbol):
                break
            least, length = least[least != NEVER], length[least != NEVER]
            starts = np.r_[0, np.cumsum(length)[:-1]]
            if turn >= ROUNDS:
                done.extend(self._queued(symbol[a : a + n], place[a : a + n]) for a, n in zip(starts.tolist(), length.tolist(), strict=True))
                break
            take = self._chosen(rank, np.repeat(least, length), starts, length)
            take |= (rank < np.r_[NEVER, border[:-1]]) & (rank < np.r_[border[1:], NEVER])
            at = np.flatnonzero(take)
            symbol[at] = pair[at]
            border[at] = border[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, border, place, pair, rank, take = (x[keep] for x in (symbol, border, place, pair, rank, take))
            fresh = np.flatnonzero(take | np.r_[take[1:], False])
            pair[fresh], rank[fresh] = self._pairs(symbol, border, fresh)
        place = np.concatenate([x for x, _ in done])
        order = np.argsort(place, kind="stable")
        place, symbol = place[order], np.concatenate([x for _, x in done])[order]
        ids, of_word = self._with_bytes(symbol, code[place], word[place])
        cuts = np.searchsorted(of_word, np.arange(len(words) + 1)) * 4
        packed = ids.astype(np.int32).tobytes()
        return [packed[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def _pairs(self, symbol: np.ndarray, border: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each symbol makes with the next one, and its rank (NEVER: none)."""
        at = np.arange(len(symbol)) if at is None else at
        piece, inner = np.zeros(len(at), np.int32), np.flatnonzero(border[at] != NEVER)
        rank = np.full(len(at), NEVER, np.int32)
        found = _look(self.pair_keys, self.pair_ids, symbol[at[inner]].astype(np.int64) * self.base + symbol[at[inner] + 1])
        hit = found != NEVER
        piece[inner[hit]] = found[hit]
        rank[inner[hit]] = self.rank[found[hit]]
        return piece, rank

    def _chosen(self, rank: np.ndarray, least: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pairs of their segment's least rank: from the left, without overlaps; the first alone where the rank says so."""
        is_least = rank == least
        at = np.arange(len(rank))
        run = at - np.maximum.accumulate(np.where(is_least, 0, at + 1))  # place within a run of overlapping pairs
        take = is_least & (run % 2 == 0)
        single = self.alone[np.where(least == NEVER, 0, least)]
        if single.any():
            first = np.minimum.reduceat(np.where(is_least, at, len(at)), starts)
            take &= ~single | (at == np.repeat(first, length))
        return take

    def _queued(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segment, pair after pair by (rank, place)."""
        symbols: list = symbol.tolist()
        after, before = [*range(1, len(symbols)), -1], list(range(-1, len(symbols) - 1))
        index = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist(), strict=True))
        ranks, queue = self.rank.tolist(), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (made := index.get(symbols[i] * self.base + symbols[after[i]])) is not None:
                heapq.heappush(queue, (ranks[made], i, made, symbols[i], symbols[after[i]]))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        kept = np.array([i for i, s in enumerate(symbols) if s is not None])
        return place[kept], np.array([symbols[i] for i in kept.tolist()], np.int32)

    def _with_bytes(self, symbol: np.ndarray, code: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their characters' UTF-8 bytes."""
        odd = symbol >= self.known
        if not odd.any():
            return symbol, word
        n = np.where(odd, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        start = np.cumsum(n) - n
        out = np.repeat(symbol, n)
        for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            rows = np.flatnonzero(odd & (n == size))
            for k in range(size):
                bits = code[rows] >> np.uint32(6 * (size - 1 - k))
                out[start[rows] + k] = self.byte_ids[bits | lead if k == 0 else bits & 0x3F | 0x80]
        return out, np.repeat(word, n)


def _slices(ids) -> Iterator[list[int]]:
    """An array or list of ids as lists of at most ``AT_ONCE``: Python numbers of a long text's ids would take much room at once."""
    for a in range(0, len(ids), AT_ONCE):
        yield np.asarray(ids[a : a + AT_ONCE], np.int32).tolist()


def _table(entries: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(entries, np.int64, len(entries))
    values = np.fromiter(entries.values(), np.int32, len(entries))
    order = np.argsort(keys)
    return keys[order], values[order]


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys; NEVER where there is none."""
    if not len(keys):
        return np.full(len(wanted), NEVER, np.int32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], NEVER)


def pieces(path: str) -> Pieces:
    """One per Python worker and model."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, model: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the SentencePiece ids of every whole text, and their text again.

    One row per row of ``docs``, by no shuffle. A null or empty text has no ids and decodes to the empty text; a null
    id stays null; repeated rows are each encoded; an empty table gives an empty one; further columns are ignored.
    Invalid UTF-8 is read as U+FFFD.
    """
    path = model or default_model()

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(path)
        for batch in it:
            ids = coder.encode([x.decode("utf-8", "replace") for x in as_bytes(batch.column(1))])
            sizes = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            decoded = pa.array([coder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, encode, f"doc_id {kind}, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_texts`` with digests in place of ids and text.

    The digests are made where the ids are, so that neither ids nor texts leave the Python worker. Cases are those of
    ``encode_texts``; a text without ids has the digest of the empty string for both.
    """
    path = model or default_model()

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(path)
        for batch in it:
            n, ids_sha, text_sha = [], [], []
            for x in coder.encode([t.decode("utf-8", "replace") for t in as_bytes(batch.column(1))]):
                n.append(len(x))
                ids_sha.append(coder.ids_digest(x))
                text_sha.append(hashlib.sha256(coder.decode(x).encode()).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
