"""Repeated passages by a distributed sparse suffix array.

A passage is a run of SPAN words (parted by white space, as they stand).  A
place in a document repeats if the SPAN words there also stand at an earlier
place, by (doc_id, word).

(1) Suffixes are retained only at minimisers: in each window of SPAN words, the
    place whose BLOCK words have the smallest hash.  The choice depends on the
    window's content alone, so equal windows retain the same suffix.  A suffix
    whose first BLOCK words stand nowhere else can match nothing and goes.
(2) The suffixes that stay carry their words, to the right as far as a window
    may reach from there and to the left as far as a window may begin.  They
    are sorted by their words in range partitions, and the number of words that
    neighbours share is read off; suffixes that share BLOCK words form a run.
(3) Matches are extended to the left and to the right by words: along a run, a
    window that begins o words to the left of its suffix equals those whose
    suffixes share SPAN - o words to the right (an interval of the sorted run)
    and o words to the left (an interval of the run sorted by its left sides).
    Each repeat is matched with the first place of its words.  Of intervals
    that reach the end of what a task sees, the windows that are the first in
    sight meet those of other tasks in a grouped minimum over the 128-bit names
    of their words, and what matched them follows: packed by the place in
    sight, so the join has a row for each such place, not for each copy.

Where only the words that repeat are asked for (``without_repeats``), matches
need no first place: a window that equals one before it in sight repeats, and
only the first in sight meet those of other tasks.

Documents with equal words form one class (named by 128 bits and its length)
that is handled once: its first document stays, the others repeat it from end
to end.  A word of more than LONG_WORD bytes is compared by a 128-bit name and
its length, so that a suffix's row is bounded; all other words are compared as
they are.

Defined results: null, empty and shorter texts repeat nothing; rows with an
equal doc_id and equal words count as one document, rows with an equal doc_id
and other words as documents of their own; a null doc_id ranks before all
others; a text of one word throughout keeps a suffix at each word; an empty
table gives an empty result; other columns are kept by ``without_repeats`` and
ignored elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import finished, one_text, or_empty, read_table, shuffle_parts, small_batches, text_key, written

SPAN, BLOCK = 50, 12
CHOICE = SPAN - BLOCK + 1  # block places in a window of SPAN words
LONG_WORD = 64
PIECE = 64  # windows; more than a suffix has, so that its matches lie in two pieces at most
MOST_PACKED = 4096  # matches in a row of ``compared``; more go to further rows
MOST_PAIRS = 1 << 18  # matches and ranges that ``unpacked`` compares at once, or one row's
CHUNK, MOST_CHUNK = 8192, 65536  # suffixes that a task compares at once, and until when it waits for a run's end
NO_ID = -(2**63)
SALT = np.uint64(0xA0761D6478BD642F)


def exact_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, start, end and hash of each word as it stands, and each text's first word."""
    data, offsets = W.text_bytes(column)
    starts, ends, at = W.word_spans(data, offsets, W.SPACES)
    return data, starts, ends, W.span_hashes(W._OF_BYTE[data], starts, ends), at


def names(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the words of each text."""
    one = W.span_hashes(words, first[:-1], first[1:])
    two = W.span_hashes(W.mix(words ^ SALT), first[:-1], first[1:])
    return one.view(np.int64), two.view(np.int64)


def minimisers(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the minimisers of all windows of SPAN words that lie in one text, the first and last window of each, and all block hashes."""
    none = np.empty(0, np.int64)
    if len(words) < SPAN:
        return none, none, none, np.empty(0, np.uint64)
    blocks = W.window_hashes(words, BLOCK)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(of[: len(words) - SPAN + 1] == of[SPAN - 1 :])
    place = start + np.lib.stride_tricks.sliding_window_view(blocks, CHOICE).argmin(axis=1)[start]
    # The windows of one minimiser stand side by side.
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else none
    tail = np.r_[head[1:], len(place)] - 1 if len(place) else none
    return place[head], start[head], start[tail], blocks


def retained(docs: DataFrame) -> DataFrame:
    """Document rows (id, key, s1, s2, n_words) and suffix rows (id null; s1, s2, at, block) in one table."""
    import pyarrow as pa

    columns = ["id", "key", "s1", "s2", "n_words", "at", "block"]

    def run(batches):
        for batch in W.batches_of(batches):
            _, _, _, words, first = exact_words(batch.column("text"))
            s1, s2 = names(words, first)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(s1), pa.array(s2), pa.array(np.diff(first)), none, none], columns)
            place, _, _, blocks = minimisers(words, first)
            if len(place):
                text = np.searchsorted(first, place, "right") - 1
                none = pa.nulls(len(place), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(s1[text]), pa.array(s2[text]), none, pa.array(place - first[text]), pa.array(blocks[place].view(np.int64))], columns)

    return docs.select("id", "key", "text").mapInArrow(run, ", ".join(f"{n} long" for n in columns))


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A space and then all words with a space behind each, so that a text's first words are its first bytes, and where each begins (n + 1 numbers)."""
    sizes = ends - starts
    long = np.flatnonzero(sizes > LONG_WORD)
    if len(long):
        pieces, at = [], 0
        for k in long.tolist():
            word = data[starts[k] : ends[k]].tobytes()
            name = b"\x00%d:" % len(word) + hashlib.blake2b(word, digest_size=16).hexdigest().encode()
            pieces += [data[at : starts[k]].tobytes(), name]
            at, sizes[k] = ends[k], len(name)
        data = np.frombuffer(b"".join([*pieces, data[at:].tobytes()]), np.uint8)
        starts = starts + np.r_[0, np.cumsum(sizes - (ends - starts))[:-1]]
    begin = np.r_[0, np.cumsum(sizes + 1)] + 1
    flat = np.full(int(begin[-1]), 32, np.uint8)
    # The bytes of a word go on from one another in both.
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[place + np.repeat(begin[:-1], sizes)] = data[place + np.repeat(starts, sizes)]
    return flat.tobytes(), begin


def suffixes_with_words(texts: DataFrame) -> DataFrame:
    """(right, left, low, high, id, key, at) of the retained suffixes at the places asked for (id, key, places, text).

    right holds the words from the place on and left, spelled backwards, those
    before it; low and high are the numbers of words to the left at which
    the suffix's last and first window begin.
    """
    import pyarrow as pa

    schema = pa.schema([("right", pa.binary()), ("left", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for batch in W.batches_of(batches):
            data, starts, ends, words, first = exact_words(batch.column("text"))
            place, begin, last, _ = minimisers(words, first)
            column = batch.column("places")
            sizes = np.diff(column.offsets.to_numpy())
            asked = column.flatten().to_numpy() + np.repeat(first[:-1], sizes)
            want = np.flatnonzero(np.isin(place, asked))
            if not len(want):
                continue
            flat, byte = spelled(data, starts, ends)
            back = flat[::-1]
            text = np.searchsorted(first, place[want], "right") - 1
            for k in range(0, len(want), 4096):
                part, of = want[k : k + 4096], text[k : k + 4096]
                p, a, z = place[part], begin[part], last[part]
                right = [flat[x:y] for x, y in zip(byte[p].tolist(), byte[z + SPAN].tolist())]
                left = [back[x:y] for x, y in zip((len(flat) - byte[p] + 1).tolist(), (len(flat) - byte[a] + 1).tolist())]
                rows = [pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array((p - z).astype(np.int32)), pa.array((p - a).astype(np.int32))]
                of_text = [batch.column(c).take(pa.array(of)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*rows, *of_text, pa.array(p - first[of])], schema=schema)

    return texts.mapInArrow(run, "right binary, left binary, low int, high int, id long, key long, at long")


def shared_words(sides: list[bytes]) -> np.ndarray:
    """Words that each of the sorted sides shares with the one before it, from the first on (0 for the first)."""
    out = np.zeros(len(sides), np.int64)
    for k in range(0, len(sides), 2048):
        part = sides[max(0, k - 1) : k + 2048]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        wide = int(sizes.max(initial=0)) + 1
        flat = np.frombuffer(b"".join(s.ljust(wide, b"\xff") for s in part), np.uint8).reshape(len(part), wide)
        if len(part) < 2:
            continue
        differs = flat[1:] != flat[:-1]
        differs[:, -1] = True
        upto = np.minimum(differs.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
        spaces = np.cumsum(flat[1:] == 32, axis=1, dtype=np.int32)
        n = np.where(upto > 0, spaces[np.arange(len(upto)), np.maximum(upto, 1) - 1], 0)
        out[max(k, 1) : max(k, 1) + len(n)] = n
    return out


def matches(right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, rank: np.ndarray, near: np.ndarray, before: bool = False, after: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted suffixes and each o < CHOICE: the suffix with the first equal window o words to the left of it, or -1, and whether there may be more out of sight.

    near holds the words shared with the suffix before, rank the order of the
    suffixes' documents and places; before and after say that suffixes lie there
    unseen.  Equal windows share SPAN - o words to the right, so those of an
    interval that doesn't reach such an end are all in sight.
    """
    n = len(right)
    order = sorted(range(n), key=left.__getitem__)
    close = shared_words([left[k] for k in order])
    found, opened = np.full((n, CHOICE), -1, np.int64), np.zeros((n, CHOICE), bool)
    for o in range(CHOICE):
        interval = np.cumsum(near < SPAN - o)
        opened[:, o] = (before & (interval == interval[0])) | (after & (interval == interval[-1]))
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        side = np.empty(n, np.int64)
        side[order] = np.cumsum(close < o) if o else 0
        both = interval * (n + 1) + side
        by = live[np.lexsort((rank[live], both[live]))]
        new = np.r_[True, both[by[1:]] != both[by[:-1]]]
        found[by, o] = np.where(new, -1, by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))])
    return found, opened


CLOSED, OPEN, FIRST, AGAIN = 0, 1, 2, 3  # kinds of rows of ``compared``
PACKED = ["ids", "keys", "starts", "sizes", "froms"]


def compared(suffixes: DataFrame, parts: int, least: int = CHUNK, most: int = MOST_CHUNK, placed: bool = True) -> DataFrame:
    """What tasks find in their sorted suffixes: (kind, id, key, start, n, w1, w2 and the lists PACKED).

    CLOSED: matches with one document, whose windows are the first of their
    words anywhere; sizes windows from starts on in (ids, keys) equal those from
    froms on in (id, key).  OPEN: the same where more may lie in another task, so
    (id, key) is the first in sight; froms to the last window lie in one piece,
    that of start.  FIRST: a window (name w1, w2) that is the first in sight
    there; n is 1 if others equal it.  Where the first places are not asked for
    (not placed), a row AGAIN a document stands for CLOSED and OPEN: sizes
    windows from starts on in (id, key) equal one before them in sight.
    """
    import pyarrow as pa

    numbers = ["kind", "id", "key", "start", "n", "w1", "w2"]
    schema = pa.schema([(c, pa.int64()) for c in numbers] + [(c, pa.list_(pa.int64())) for c in PACKED])
    columns = ["right", "left", "low", "high", "id", "key", "at"]

    def spans(kind, first, ids, keys, at):
        """Rows of matches by the suffix they equal, each match windows side by side; those of OPEN rows end at a piece's end."""
        mark = np.full((len(first), CHOICE + 1), -1, np.int64)
        place = at[first] - np.arange(CHOICE)
        before = place // PIECE != at[first] // PIECE if kind == OPEN else 0
        mark[:, :CHOICE] = np.where(first >= 0, 2 * first + before, -1)
        row, o = np.nonzero((mark >= 0) & (mark != np.c_[np.full(len(mark), -1), mark[:, :-1]]))
        if not len(row):
            return
        flat = mark.ravel()
        change = np.flatnonzero(np.r_[flat[1:] != flat[:-1], True])
        stop = change[np.searchsorted(change, row * (CHOICE + 1) + o)] - row * (CHOICE + 1)  # the last o of the same match
        order = np.argsort(mark[row, o], kind="stable")
        row, o, stop, same = row[order], o[order], stop[order], mark[row, o][order]
        to, k = same >> 1, np.arange(len(same))
        new = np.r_[True, same[1:] != same[:-1]]
        new |= (k - np.maximum.accumulate(np.where(new, k, 0))) % MOST_PACKED == 0
        head = np.flatnonzero(new)
        cuts = pa.array(np.r_[head, len(same)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (ids[row], keys[row], at[row] - stop, stop - o + 1, at[to] - stop)]
        of, none = to[head], pa.nulls(len(head), pa.int64())
        rows = [np.full(len(head), kind, np.int64), ids[of], keys[of], (at[to] - stop)[head]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows), none, none, none, *lists], schema=schema)

    def again(first, ids, keys, at):
        """The windows that equal one before them: a row a document, those side by side as one range."""
        row, o = np.nonzero(first >= 0)
        if not len(row):
            return
        start = at[row] - o
        order = np.lexsort((start, keys[row], ids[row]))
        row, start = row[order], start[order]
        other = np.r_[True, (ids[row[1:]] != ids[row[:-1]]) | (keys[row[1:]] != keys[row[:-1]])]
        head = np.flatnonzero(other | np.r_[True, start[1:] != start[:-1] + 1])
        docs = np.flatnonzero(other)
        cuts = pa.array(np.searchsorted(head, np.r_[docs, len(start)]).astype(np.int32))
        lists = {"starts": start[head], "sizes": np.diff(np.r_[head, len(start)])}
        of = row[docs]
        fixed = {"kind": np.full(len(of), AGAIN, np.int64), "id": ids[of], "key": keys[of]}
        columns = [pa.ListArray.from_arrays(cuts, pa.array(lists[f.name])) if f.name in lists else pa.array(fixed[f.name]) if f.name in fixed else pa.nulls(len(of), f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def firsts(first, opened, right, left, high, ids, keys, at):
        """The open windows that equal none before them in sight, by name."""
        met = np.zeros(first.shape, bool)
        row, o = np.nonzero(first >= 0)
        met[first[row, o], o] = True
        asked = opened & (first < 0)
        rows = []
        for k in np.flatnonzero(asked.any(axis=1)).tolist():
            all_words = left[k][::-1].split(b" ")[1:] + right[k].split(b" ")[:-1]
            middle = int(high[k])
            for o in np.flatnonzero(asked[k]).tolist():
                name = hashlib.blake2b(b" ".join(all_words[middle - o : middle - o + SPAN]), digest_size=16).digest()
                rows.append((k, o, met[k, o], int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)))
            if len(rows) > 20_000:
                yield rows
                rows = []
        if rows:
            yield rows

    def chunk(rows, near, from_start, at_end):
        """Judge sorted rows; more may lie before or after them."""
        right, left, low, high, ids, keys, at = rows
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((at, keys, ids))] = np.arange(len(at))
        first, opened = matches(right, left, low, high, rank, near, from_start, at_end)
        o = np.arange(CHOICE)
        opened &= (low[:, None] <= o) & (o <= high[:, None])
        if placed:
            yield from spans(CLOSED, np.where(opened, -1, first), ids, keys, at)
            yield from spans(OPEN, np.where(opened, first, -1), ids, keys, at)
        else:
            yield from again(first, ids, keys, at)
        for part in firsts(first, opened, right, left, high, ids, keys, at):
            own, o, others, one, two = (np.array(x, np.int64) for x in zip(*part))
            rows = [np.full(len(own), FIRST, np.int64), ids[own], keys[own], at[own] - o, others, one, two]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), *[pa.nulls(len(own), pa.list_(pa.int64()))] * len(PACKED)], schema=schema)

    def run(batches):
        held, from_start = None, True  # another task may hold the first run's beginning
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_pylist() if c in ("right", "left") else batch.column(c).to_numpy().astype(np.int64) for c in columns]
            held = now if held is None else [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, now)]
            while len(held[6]) >= least:
                near = shared_words(held[0])
                heads = np.flatnonzero(near < BLOCK)
                at = int(heads[-1])  # all before the last run are whole
                if at == 0:
                    if len(held[6]) < most:
                        break
                    yield from chunk(held, near, True, True)
                    held, from_start = [x[len(held[6]) :] for x in held], True
                else:
                    yield from chunk([x[:at] for x in held], near[:at], from_start, False)
                    held, from_start = [x[at:] for x in held], False
                    break
        if held is not None and len(held[6]):
            yield from chunk(held, shared_words(held[0]), from_start, True)

    sorted_rows = suffixes.select(*columns).repartitionByRange(parts, "right", "id", "key", "at").sortWithinPartitions("right", "id", "key", "at")
    return sorted_rows.mapInArrow(run, ", ".join([f"{c} long" for c in numbers] + [f"{c} array<long>" for c in PACKED]))


RANGES = ["r_start", "r_n", "r_id", "r_key", "r_shift"]


def unpacked(rows: DataFrame) -> DataFrame:
    """(id, key, start, n, first_id, first_key, first_start) of the matches (id, key, PACKED) that follow the lists RANGES, or equal (id, key) itself where those are null."""
    import pyarrow as pa

    columns = ["id", "key", "start", "n", "first_id", "first_key", "first_start"]

    def run(batches):
        for batch in batches:
            sizes, known = (batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "r_start"))
            pairs = np.cumsum(sizes * np.maximum(known, 1))
            k = 0
            while k < batch.num_rows:
                upto = max(k + 1, int(np.searchsorted(pairs, (pairs[k - 1] if k else 0) + MOST_PAIRS, "right")))
                yield from part(batch.slice(k, upto - k), sizes[k:upto], known[k:upto])
                k = upto

    def part(batch, sizes, known):
        of = np.repeat(np.arange(len(sizes)), sizes)  # the row of each match
        times = np.maximum(known, 1)[of]
        match = np.repeat(np.arange(len(of)), times)
        of = of[match]
        ranged = known[of] > 0
        # Which of its row's ranges each pair has; a last one stands for rows without any.
        which = np.where(ranged, (np.cumsum(known) - known)[of] + np.arange(len(match)) - np.repeat(np.cumsum(times) - times, times), int(known.sum()))
        ids, keys, start, n, begin = (batch.column(c).flatten().to_numpy()[match] for c in PACKED)
        r_start, r_n, r_id, r_key, shift = (np.r_[batch.column(c).flatten().to_numpy().astype(np.int64), 0][which] for c in RANGES)
        low = np.where(ranged, np.maximum(begin, r_start), begin)
        high = np.where(ranged, np.minimum(begin + n, r_start + r_n), begin + n)
        to_id, to_key = (np.where(ranged, r, batch.column(c).to_numpy()[of]) for r, c in ((r_id, "id"), (r_key, "key")))
        out = [ids, keys, start + low - begin, high - low, to_id, to_key, low - shift]
        yield pa.RecordBatch.from_arrays([pa.array(x[low < high]) for x in out], columns)

    return rows.select("id", "key", *PACKED, *RANGES).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def settled(found: DataFrame) -> DataFrame:
    """The matches of ``compared`` with the first place anywhere: (id, key, start, n, first_id, first_key, first_start).

    The windows that are first in sight meet in a minimum by name.  Side by side
    they are ranges again, cut at multiples of PIECE, and the matches in sight
    follow their first place's ranges.  Both are packed by place and piece, so
    the join has a row for each of those, however many copies equal it.
    """
    lead = found.where(F.col("kind") == FIRST).select("id", "key", "start", "n", "w1", "w2")
    place = F.min(F.struct("id", "key", "start")).alias("e")
    earliest = lead.groupBy("w1", "w2").agg(place, F.count("*").alias("times"), F.max("n").alias("met")).where("times > 1 or met = 1")
    # Written first: joined to an aggregate in the same stage, a passage that very many tasks share could not be split.
    earliest = written(earliest.select("w1", "w2", F.col("e.id").alias("first_id"), F.col("e.key").alias("first_key"), F.col("e.start").alias("first_start")), "earliest")
    mapped = lead.select("id", "key", "start", "w1", "w2").join(earliest, ["w1", "w2"])
    mapped = mapped.withColumn("shift", F.col("start") - F.col("first_start")).withColumn("piece", F.expr(f"start div {PIECE}"))
    same = ["id", "key", "first_id", "first_key", "shift", "piece"]
    islands = mapped.withColumn("run", F.col("start") - F.row_number().over(Window.partitionBy(*same).orderBy("start")))
    ranges = written(islands.groupBy(*same, "run").agg(F.min("start").alias("start"), F.count("*").alias("n")).drop("run"), "first-ranges")
    own = ranges.where("id <> first_id or key <> first_key or shift <> 0").select("id", "key", "start", "n", "first_id", "first_key", (F.col("start") - F.col("shift")).alias("first_start"))

    of_piece = ranges.groupBy("id", "key", "piece").agg(F.collect_list(F.struct(F.col("start").alias("r_start"), F.col("n").alias("r_n"), F.col("first_id").alias("r_id"), F.col("first_key").alias("r_key"), F.col("shift").alias("r_shift"))).alias("r"))
    seen = found.where(F.col("kind") == OPEN).select("id", "key", F.expr(f"start div {PIECE}").alias("piece"), *PACKED)
    met = seen.join(of_piece, ["id", "key", "piece"]).select("id", "key", *PACKED, *[F.col("r")[c].alias(c) for c in RANGES])
    closed = found.where(F.col("kind") == CLOSED).select("id", "key", *PACKED, *[F.lit(None).cast("array<bigint>").alias(c) for c in RANGES])
    return unpacked(closed.unionByName(met)).unionByName(own)


def suffixes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies (id, key, first_id, start, first_start, n_words) of whole documents, and the suffixes of all others that may match, with their words."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_key().alias("key"), or_empty("text").alias("text"))
    table = written(retained(texts), "suffixes")
    name = ["s1", "s2", "n_words"]
    whole = table.where("id is not null").where(F.col("n_words") >= SPAN).select("id", "key", *name)
    classes = written(whole.groupBy(*name).agg(F.min(F.struct("id", "key")).alias("f")).select(*name, F.col("f.id").alias("first_id"), F.col("f.key").alias("first_key")), "text-classes")
    copies = whole.join(classes.select(*name, "first_id"), name).where("id <> first_id").distinct()
    copies = copies.select("id", "key", "first_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("first_start"), "n_words")

    ends = table.where("id is null").select("s1", "s2", "at", "block")
    # A block is kept if it begins suffixes at two places; copies of a document bring one place again.
    place = F.xxhash64("s1", "s2", "at")
    again = ends.groupBy("block").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("block")
    near = ends.join(written(again, "blocks"), "block", "left_semi")
    places = near.groupBy("s1", "s2").agg(F.collect_set("at").alias("places"))
    asked = places.join(classes.select("s1", "s2", F.col("first_id").alias("id"), F.col("first_key").alias("key")), ["s1", "s2"]).select("id", "key", "places")
    return copies, written(suffixes_with_words(one_text(texts).join(asked, ["id", "key"]).select("id", "key", "places", "text")), "suffix-words")


def repeats(docs: DataFrame, parts: int, **chunks: int) -> DataFrame:
    """(id, key, first_id, start, first_start, n_words): runs of words that also stand at an earlier place; key as in ``text_key``."""
    copies, suffixes = suffixes_of(docs)
    found = written(compared(suffixes, parts, **chunks), "matches")
    runs = settled(found).select("id", "key", "first_id", "start", "first_start", "n")

    # Runs of windows that follow each other and equal windows that follow each other are one passage.
    line = Window.partitionBy("id", "key", "first_id", "shift").orderBy("start")
    runs = runs.withColumn("shift", F.col("start") - F.col("first_start"))
    broken = F.col("start") > F.max(F.col("start") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("run", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "key", "first_id", "shift", "run").agg(F.min("start").alias("start"), F.min("first_start").alias("first_start"), (F.max(F.col("start") + F.col("n")) - F.min("start") + SPAN - 1).alias("n_words"))
    return spans.select(*copies.columns).unionByName(copies)


def repeated_words(docs: DataFrame, parts: int, **chunks: int) -> DataFrame:
    """(id, key, starts, stops): the words that ``repeats`` reports, a row a document, without their first places.

    A text of a few words over and over repeats a window at each of its words,
    each at another distance to its first place; here they are one range.
    """
    copies, suffixes = suffixes_of(docs)
    found = written(compared(suffixes, parts, placed=False, **chunks), "matches")
    lead = found.where(F.col("kind") == FIRST).select("w1", "w2", F.struct("id", "key", "start").alias("place"))
    earliest = lead.groupBy("w1", "w2").agg(F.min("place").alias("e"), F.count("*").alias("times")).where("times > 1")
    later = lead.join(written(earliest.select("w1", "w2", "e"), "earliest"), ["w1", "w2"]).where("place <> e")
    later = later.select("place.id", "place.key", F.array("place.start").alias("starts"), F.array(F.lit(1).cast("long")).alias("sizes"))
    ranges = found.where(F.col("kind") == AGAIN).select("id", "key", "starts", "sizes").unionByName(later)
    ranges = ranges.select("id", "key", "starts", F.zip_with("starts", "sizes", lambda start, n: start + n + (SPAN - 1)).alias("stops"))
    ranges = ranges.unionByName(copies.select("id", "key", F.array("start").alias("starts"), F.array("n_words").alias("stops")))
    spans = ranges.groupBy("id", "key").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("spans"))
    return spans.select("id", "key", F.col("spans.starts").alias("starts"), F.col("spans.stops").alias("stops"))


def without_repeats(docs: DataFrame, parts: int) -> DataFrame:
    """The documents, all their columns, with repeats cut out of text; those of which nothing is left go.

    A row is cut by the passages of its own doc_id and text.  A column n_chars,
    where there is one, follows the text.
    """
    spark, kind = docs.sparkSession, docs.schema

    spans = finished(spark, "spans", lambda: repeated_words(docs.select("doc_id", "text"), parts))
    small_batches(spark)
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_key().alias("key"))
    # One pass over all rows: their texts are shuffled once, and lie in row alone.
    joined = packed.join(spans, ["id", "key"], "left")
    cut = joined.select("row", "starts", "stops").mapInArrow(_cut, f"row {kind.simpleString()}, text string, cut boolean").where("not cut or text <> ''")
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    at = docs.columns.index("text")
    columns[at] = F.when(F.col("cut"), F.col("text")).otherwise(columns[at]).alias("text")
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.when(F.col("cut"), F.length("text").cast(kind["n_chars"].dataType)).otherwise(columns[at]).alias("n_chars")
    return cut.select(*columns)


def _cut(batches):
    """Rows (row, starts, stops) as (row, text, cut): text is what is left where there are spans to cut, else null."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("row").field("text")
        out = []
        for k, (starts, stops) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("stops").to_pylist())):
            if starts is None or not texts[k].is_valid:
                out.append(None)
                continue
            data, offsets = W.text_bytes(texts.slice(k, 1))
            begin, end, first = W.word_spans(data, offsets, W.SPACES)
            gone = np.zeros(len(begin) + 1, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, stops, -1)
            kept = np.cumsum(gone[:-1]) == 0
            edges = np.flatnonzero(np.diff(np.r_[False, kept, False].astype(np.int8)))
            # From a kept run's first word to the word after it, so the white space between stays as it is.
            pieces = [bytes(data[begin[x] : (begin[y] if y < len(begin) else len(data))]) for x, y in zip(edges[::2], edges[1::2])]
            out.append(b"".join(pieces).decode("utf-8").strip())
        left = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row"), left, left.is_valid()], ["row", "text", "cut"])


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    found = lambda: repeats(docs, shuffle_parts(spark)).select(shown("id").alias("doc_id"), shown("first_id").alias("first_doc_id"), F.col("start").alias("start_word"), F.col("first_start").alias("first_start_word"), "n_words")
    return finished(spark, "repeats", found)


# Every window of SPAN words by its words; equal texts as classes; runs of windows by their distance to the first place.
SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
longer AS (SELECT doc_id, words, min(doc_id) OVER (PARTITION BY words) AS first_id FROM docs WHERE len(words) >= {SPAN}),
windows AS (SELECT doc_id, k AS p, list_aggregate(words[k + 1 : k + {SPAN}], 'string_agg', ' ') AS w FROM longer, unnest(range(len(words) - {SPAN} + 1)) u(k) WHERE doc_id = first_id),
placed AS (SELECT doc_id, p, min(struct_pack(i := doc_id, a := p)) OVER (PARTITION BY w) AS f FROM windows),
hits AS (SELECT doc_id, p, f.i AS first_id, f.a AS first_p, p - f.a AS shift FROM placed WHERE doc_id <> f.i OR p <> f.a),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, first_id, shift ORDER BY p) AS run FROM hits)
SELECT doc_id, first_id AS first_doc_id, min(p)::BIGINT AS start_word, min(first_p)::BIGINT AS first_start_word, (max(p) - min(p) + {SPAN})::BIGINT AS n_words
FROM runs GROUP BY doc_id, first_id, shift, run
UNION ALL SELECT doc_id, first_id, 0, 0, len(words)::BIGINT FROM longer WHERE doc_id <> first_id"""
