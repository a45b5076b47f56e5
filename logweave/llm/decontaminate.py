"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and characters beyond ASCII, A-Z
lower-cased.  Each fixed mask covers a span of words and ignores some of its
positions, so a seed matches although words there were replaced.  The seeds of
all documents are joined with those of the benchmark in Spark; at each hit the
two texts are aligned and the aligned words are compared: a passage counts
where each window of LEAST words (or the whole item, where that is shorter)
agrees in SHARE of its words.  The masks are chosen so that no such window is
without a hit (tests/llm tries all ways to replace words).

Items of SHORT to LEAST - 1 words must stand whole, with SHARE of their words;
items of fewer than SHORT words say too little to mark a passage, and count
only where they are all the words of a document.

Documents are read once, whatever the benchmark's size.  What is sent to the
tasks is a Bloom filter of the benchmark's seeds, 64 MB at most, that keeps
seeds without a partner out of the join; beyond the size for which that holds
them all well apart it lets more through, which costs time and loses nothing.

Defined results: null and empty texts are clean; rows with equal doc_id and
text are reported once; repeated items are reported under each id; a null
item_id is reported as null; items without words are passed over; empty tables
give an empty result; other columns are kept by ``clean_documents`` and ignored
elsewhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import finished, or_empty, read_table, small_batches, text_key, written

# 1 for positions that count. Of items of 12 words and more: weight 7; in 12 words, whichever two are replaced, some mask laid at some place counts neither.
MASKS = ("11111011", "110101111", "11101100011", "110011111")
# Of items of 6 to 11 words: weight 4; whichever fifth of the words (rounded down) is replaced, some mask laid at some place counts none of them.
SHORT_MASKS = ("1111", "11011")
SHORT, LONG, LEAST = 6, 12, 13
SHARE = 0.8
MOST_BITS = 1 << 29  # of the Bloom filter
BITS_A_SEED, PROBES = 48, 4
NO_ID = -(2**63)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counted words of the mask laid at each word."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)))
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return W.mix(out)


def whole_seed(words: np.ndarray) -> np.ndarray:
    """The one seed of a text of fewer than SHORT words."""
    return W.mix(W.span_hashes(words, np.array([0]), np.array([len(words)])) ^ np.uint64(len(words)))


def item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a benchmark item and their places."""
    if len(words) < SHORT:
        return whole_seed(words), np.zeros(1, np.int64)
    found = [seeds(words, m) for m in (MASKS if len(words) >= LONG else SHORT_MASKS)]
    return np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])


def agreeing(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs that begin and end with an agreeing word and in which every window of least words, laid over them, agrees to SHARE; joined where they overlap."""
    n = len(same)
    if n < least:
        return []
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[least:] - total[:-least] >= SHARE * least)
    out: list[list[int]] = []
    for a in good.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = a + least
        else:
            out.append([a, a + least])
    trimmed = []
    for a, b in out:
        inside = np.flatnonzero(same[a:b])
        trimmed.append((a + int(inside[0]), a + int(inside[-1]) + 1))
    return trimmed


class Bloom:
    """A Bloom filter over 64-bit hashes, of a power of two bits."""

    def __init__(self, bits: int, data: bytes | None = None) -> None:
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    @staticmethod
    def fitting(n: int) -> Bloom:
        return Bloom(min(MOST_BITS, max(1 << 16, 1 << (max(1, n) * BITS_A_SEED - 1).bit_length())))

    def _places(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return (hashes + np.uint64(probe) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        for probe in range(PROBES):
            place = self._places(hashes, probe)
            np.bitwise_or.at(self.data, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the filter; all that are in it are among them."""
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            place = self._places(hashes[left], probe)
            left = left[(self.data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return left


def distinct_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, words) of the benchmark's different items, as 64-bit word hashes, and (node, item_id)."""
    import pyarrow as pa

    def run(batches):
        for batch in W.batches_of(batches):
            words, first = W.hashed_words(batch.column("text"), W.NOT_ALNUM)
            packed = [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(np.diff(first)), pa.array(packed, pa.binary())], ["item_id", "n", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), or_empty("text").alias("text"))
    read = written(rows.mapInArrow(run, "item_id long, n long, words binary").where("n > 0"), "items")
    nodes = written(read.groupBy("words").agg(F.first("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), "item-words")
    return nodes, written(read.join(nodes.select("node", "words"), "words").select("node", "item_id").distinct(), "item-ids")


def seed_table(nodes: DataFrame) -> DataFrame:
    """(seed, node, place, n) of all items."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for node, n, words in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "words"))):
                hashes, places = item_seeds(np.frombuffer(words, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), node)), pa.array(places), pa.array(np.full(len(hashes), n))], ["seed", "node", "place", "n"])

    return written(nodes.select("node", "n", "words").mapInArrow(run, "seed long, node long, place long, n long"), "seeds")


def bloom_of(table: DataFrame) -> Bloom:
    """The filter of all seeds, from one part a task; the driver holds two parts at a time."""
    import pyarrow as pa

    out = Bloom.fitting(table.count())
    bits = out.bits

    def run(batches):
        part = Bloom(bits)
        for batch in batches:
            part.add(batch.column("seed").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([part.data.tobytes()], pa.binary())], ["part"])

    for row in table.select("seed").coalesce(16).mapInArrow(run, "part binary").toLocalIterator():
        out.data = out.data | np.frombuffer(row["part"], np.uint8)
    return out


def suspects(docs: DataFrame, bloom: Bloom) -> DataFrame:
    """(id, key, n, words, seeds, places) of the documents with a seed that the filter lets through."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((bloom.bits, bloom.data.tobytes()))
    columns = ["id", "key", "n", "words", "seeds", "places"]

    def run(batches):
        known = Bloom(*shared.value)
        for batch in W.batches_of(batches):
            words, first = W.hashed_words(batch.column("text"), W.NOT_ALNUM)
            if not len(words):
                continue
            of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            found = []
            for mask in (*MASKS, *SHORT_MASKS):
                hashes = seeds(words, mask)
                place = known.maybe(hashes)
                place = place[of[place] == of[place + len(mask) - 1]]
                found.append((place, hashes[place]))
            for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHORT)).tolist():
                one = whole_seed(words[first[t] : first[t + 1]])
                if len(known.maybe(one)):
                    found.append((np.array([first[t]]), one))
            place, hashes = (np.concatenate(x) for x in zip(*found))
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, hashes = place[order], hashes[order]
            text = np.unique(of[place])
            a, b = np.searchsorted(of[place], text), np.searchsorted(of[place], text, "right")
            begin, end = first[text], first[text + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(text)) for c in ("id", "key")),
                    pa.array(end - begin),
                    pa.array([words[x:y].tobytes() for x, y in zip(begin, end)], pa.binary()),
                    pa.array([hashes[x:y].view(np.int64) for x, y in zip(a, b)], pa.list_(pa.int64())),
                    pa.array([place[x:y] - z for x, y, z in zip(a, b, begin)], pa.list_(pa.int64())),
                ],
                columns,
            )

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key long, n long, words binary, seeds array<long>, places array<long>")


def passages(aligned: DataFrame) -> DataFrame:
    """(id, key, node, doc_word, item_word, n_words, n_same) of the verified passages of aligned texts and items.

    aligned has id, key, node, doc_n, item_n, shift (place in the text less
    place in the item) and the aligned words of both.
    """
    import pyarrow as pa

    kinds = {"id": pa.int64(), "key": pa.int64(), "node": pa.int64(), "doc_word": pa.int32(), "item_word": pa.int32(), "n_words": pa.int32(), "n_same": pa.int32()}

    def run(batches):
        for batch in batches:
            out = []
            for i, key, node, doc_n, item_n, shift, mine, theirs in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "node", "doc_n", "item_n", "shift", "doc_words", "item_words"))):
                same = np.frombuffer(mine, np.uint64) == np.frombuffer(theirs, np.uint64)
                if item_n < SHORT:
                    if doc_n == item_n and shift == 0 and same.all():
                        out.append((i, key, node, 0, 0, item_n, item_n))
                    continue
                lo = max(0, shift)
                out += [(i, key, node, lo + a, lo - shift + a, b - a, int(same[a:b].sum())) for a, b in agreeing(same, min(LEAST, item_n))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds.values())], list(kinds))

    return aligned.mapInArrow(run, "id long, key long, node long, doc_word int, item_word int, n_words int, n_same int")


def found_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, key, item_id, doc_word, item_word, n_words, n_same) of every benchmark passage in the documents (doc_id, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_key().alias("key"), or_empty("text").alias("text"))
    nodes, ids = distinct_items(items)
    table = seed_table(nodes)
    kept = written(suspects(texts, bloom_of(table)).dropDuplicates(["id", "key"]), "suspects")
    hits = kept.select("id", "key", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("id", "key", F.col("s.seeds").alias("seed"), F.col("s.places").alias("p"))
    shifts = hits.join(table.select("seed", "node", "place"), "seed").select("id", "key", "node", (F.col("p") - F.col("place")).alias("shift")).distinct()
    doc = kept.select("id", "key", F.col("n").alias("doc_n"), F.col("words").alias("d"))
    item = nodes.select("node", F.col("n").alias("item_n"), F.col("words").alias("i"))
    both = written(shifts, "shifts").join(doc, ["id", "key"]).join(item, "node")
    low, high = F.greatest(F.lit(0).cast("long"), "shift"), F.least("doc_n", F.col("shift") + F.col("item_n"))
    cut = lambda c, at: F.col(c).substr((at * 8 + 1).cast("int"), ((high - low) * 8).cast("int"))
    aligned = both.select("id", "key", "node", "doc_n", "item_n", "shift", cut("d", low).alias("doc_words"), cut("i", low - F.col("shift")).alias("item_words"))
    return passages(aligned).join(ids, "node").drop("node")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each passage of a benchmark item in a document; clean documents have none."""
    shown = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return finished(docs.sparkSession, "contaminated", lambda: found_passages(docs, items).select(shown, "item_id", "doc_word", "item_word", "n_words", "n_same"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all their columns, without those that hold a benchmark passage.

    Rows are told apart by doc_id and text, so a repeated doc_id takes no clean
    row away.
    """
    dirty = finished(docs.sparkSession, "dirty", lambda: found_passages(docs.select("doc_id", "text"), items).select("id", "key").distinct())
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": text_key()})
    return keyed.join(dirty, (keyed["_id"] == dirty["id"]) & (keyed["_key"] == dirty["key"]), "left_anti").drop("_id", "_key")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return contaminated(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


# Every shift at which a text and an item share words, without seeds or masks.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS words FROM documents), i AS (SELECT DISTINCT item_id, {_WORDS} AS words FROM benchmark),
dw AS (SELECT doc_id, len(words) AS doc_n, unnest(words) AS w, unnest(range(len(words))) AS p FROM d),
iw AS (SELECT item_id, len(words) AS item_n, least(len(words), {LEAST}) AS m, unnest(words) AS w, unnest(range(len(words))) AS q FROM i),
same AS (SELECT doc_id, item_id, doc_n, item_n, m, p - q AS shift, p FROM dw JOIN iw USING (w)),
flags AS (SELECT doc_id, item_id, shift, any_value(m) AS m, any_value(doc_n) AS doc_n, any_value(item_n) AS item_n, greatest(0, shift) AS lo, least(any_value(doc_n), shift + any_value(item_n)) AS hi, list(p) AS agreed
  FROM same GROUP BY doc_id, item_id, shift HAVING count(*) >= {SHARE} * any_value(m)),
marked AS (SELECT *, list_transform(range(lo, hi), lambda x: list_contains(agreed, x)::INT) AS f FROM flags),
starts AS (SELECT doc_id, item_id, shift, m, lo, f, unnest(list_filter(range(len(f) - m + 1), lambda k: list_sum(f[k + 1 : k + m]) >= {SHARE} * m)) AS a
  FROM marked WHERE len(f) >= m AND (item_n >= {SHORT} OR (doc_n = item_n AND shift = 0 AND list_sum(f) = item_n))),
cut AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id, item_id, shift ORDER BY a) <= m THEN 0 ELSE 1 END AS new FROM starts),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, shift ORDER BY a) AS run FROM cut),
spans AS (SELECT doc_id, item_id, shift, lo, any_value(f) AS f, min(a) AS a, max(a + m) AS b FROM runs GROUP BY doc_id, item_id, shift, lo, run),
trimmed AS (SELECT *, a + list_position(f[a + 1 : b], 1) - 1 AS x, b - list_position(list_reverse(f[a + 1 : b]), 1) + 1 AS y FROM spans)
SELECT doc_id, item_id, (lo + x)::INT AS doc_word, (lo + x - shift)::INT AS item_word, (y - x)::INT AS n_words, list_sum(f[x + 1 : y])::INT AS n_same FROM trimmed"""
