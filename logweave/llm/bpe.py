"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut into pieces by the vocabulary's pattern.  A task encodes each
distinct piece once: pieces are bucketed by length into padded matrices, and in
each round every row finds its pairs' ranks in a hash table, merges its
leftmost pair of the smallest rank and is compacted.  Pieces above LONG bytes,
where rounds over a matrix would be quadratic, are merged exactly with a heap
over linked neighbours.  Whole texts are encoded; decoding maps ids back to
bytes.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import or_empty, read_table, small_batches

LONG = 256  # bytes of a piece from which the heap takes over
CACHE = 400_000  # distinct pieces that a task keeps; more are encoded anew
NONE = np.int64(1) << 40


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        todo, slot, self.probes = np.arange(len(keys)), self.slot(keys), 1
        mask = np.int64((1 << self.bits) - 1)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            fits = todo[free]
            _, first = np.unique(slot[fits], return_index=True)
            put = fits[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            left_over = np.ones(len(keys), bool)
            left_over[put] = False
            todo = todo[left_over[todo]]
            slot[todo] = (slot[todo] + 1) & mask
            self.probes += len(todo) > 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE for pairs that don't merge or hold padding (-1)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot, mask = self.slot(keys), np.int64((1 << self.bits) - 1)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        flat_keys, flat_out, at = keys.reshape(-1), out.reshape(-1), slot.reshape(-1)
        if out.ndim > 1:
            todo = np.flatnonzero(((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            now = self.keys[at]
            hit = now == flat_keys[todo]
            flat_out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (now != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[go], at[go]
        return flat_out.reshape(keys.shape)


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        self.pair_rank = None
        self._pair_lists = (left, right, merged)

    @classmethod
    def load(cls, content: bytes, pattern: str) -> Vocabulary:
        ranks = {}
        for line in io.BytesIO(content):
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: whole tokens at once, the rest in matrices bucketed by length."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.uint32)
            elif len(piece) > LONG:
                out[i] = self.encode_long(piece)
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        rows = np.where(np.arange(width) < lengths[:, None], self.single[grid], -1)
        ranks = self._rank(rows)
        done, live = [None] * len(pieces), np.arange(len(pieces))
        while len(live):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(live), np.int64)
            least = ranks[np.arange(len(live)), best] if ranks.shape[1] else np.full(len(live), NONE)
            ended = least >= NONE
            for k in np.flatnonzero(ended):
                done[live[k]] = rows[k, : lengths[k]].astype(np.uint32)
            go = ~ended
            live, rows, lengths, best, least = live[go], rows[go], lengths[go], best[go], least[go]
            if not len(live):
                break
            # The merged id takes the left place; what follows moves up by one.
            order = np.arange(rows.shape[1] - 1)
            take = order + (order > best[:, None])
            moved = np.take_along_axis(rows, take, 1)
            moved[np.arange(len(live)), best] = least
            lengths = lengths - 1
            rows = moved[:, : max(1, int(lengths.max()))]
            # Only the pairs at the merged place are new.
            old = np.take_along_axis(ranks[go], np.minimum(take[:, : rows.shape[1] - 1], ranks.shape[1] - 1), 1) if rows.shape[1] > 1 else np.empty((len(live), 0), np.int64)
            ranks = old
            at, r = best, np.arange(len(live))
            for shift in (0, 1):
                place = at - shift
                ok = (place >= 0) & (place < ranks.shape[1])
                i, p = r[ok], place[ok]
                a, b = rows[i, p], rows[i, p + 1]
                fresh = self.pairs.look_up(a, b)
                ranks[i, p] = np.where((b < 0) | (a < 0), NONE, fresh)
            edge = lengths - 1
            out_of = np.arange(ranks.shape[1]) >= edge[:, None]
            ranks[out_of] = NONE
        return done

    def _rank(self, rows: np.ndarray) -> np.ndarray:
        if rows.shape[1] < 2:
            return np.empty((len(rows), 0), np.int64)
        found = self.pairs.look_up(rows[:, :-1], rows[:, 1:])
        return np.where(rows[:, 1:] < 0, NONE, found)

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Exact merging of one long piece in n log n: a heap of (rank, place) over linked neighbours."""
        if self.pair_rank is None:
            left, right, merged = self._pair_lists
            self.pair_rank = dict(zip(zip(left, right), merged))
        get = self.pair_rank.get
        ids = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def encoder(self):
        """Function from texts to the bytes of their ids (little-endian u32), with a cache of pieces."""
        cache: dict[str, bytes] = {}

        def encode(texts: list[str]) -> list[bytes]:
            cut = [self.find(t) for t in texts]
            new = list({p for pieces in cut for p in pieces if p not in cache})
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list({p for pieces in cut for p in pieces})
            for piece, ids in zip(new, self.encode_pieces([p.encode("utf-8") for p in new])):
                cache[piece] = ids.astype("<u4").tobytes()
            return [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]

        return encode

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def chunks(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of texts of about so many characters, so that long texts don't pile up."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes; with_ids adds the ids themselves."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file: a fixed size of about 1 MB
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        model = Vocabulary.load(shared.value, pattern)
        encode = model.encoder()
        for batch in batches:
            ids = [x for part in chunks(batch.column("text").to_pylist()) for x in encode(part)]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), *default_vocabulary())


def default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN
