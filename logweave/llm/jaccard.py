"""N-gram Jaccard join with a token-group matrix; exact.

A document's set is its distinct four-word shingles, as 64-bit hashes.
Documents with equal sets form one class.  (1) Classes that share a minhash
meet a leader of their key and are linked to it where the exact test holds.
Groups are the classes with the same most liked leader, linked or not.  (2) Tokens have one global order:
those found frequent in a hash sample last, else by hash.  The matrix holds
each group's union of its members' prefixes in that order, a row for each
token and group with the sizes it spans and the components in it.  A query
(class) counts its prefix tokens in each group's union, which bounds its
overlap with any member from above: to reach the threshold it must share LAP
tokens.  Only groups that qualify are opened: their members, in blocks, meet
the queries, in blocks, each pair of blocks a row of its own, and a bound on
the symmetric difference from 1,024-bit parity sketches, and for large sets
from counts by bucket, leaves few pairs, which are tested exactly.  A component
that fills blocks of a group by itself doesn't meet its own.  The order steers
cost only, and leaders supply links that were tested: no link is lost.

Classes are named by 128 bits and their size, and numbered once they are
written.  Their texts are shuffled only where pairs are tested, and of those
few others than the pairs' own; what a step wrote on the way goes when it ends.
Where all texts or all tokens must be shuffled, they are in SLICES, one after another;
so are the queries that meet groups, and the groups opened, in as many slices as
keep a slice's rows in proportion to the classes.

Defined results: null, empty and word-less texts have size 0 and are linked
with nothing; fewer words than four are one shingle; repeated rows are each
returned, in one component if their set isn't empty; rows with one doc_id and
unlike texts are each placed by their own text; a null doc_id ranks before all
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import finished, one_text, or_empty, read_table, shuffle_parts, small_batches, text_key, written
from .components import components

WIDTH, PERCENT = 4, 85
KEYS = 4  # minhash keys that offer leaders
LAP = 4  # tokens that prefixes must share; unlike texts share 2 by chance, so often that those hits grow with the square of the input
SAMPLE, FREQUENT, MOST_FREQUENT = 32, 3, 1 << 21  # 1 of 32 documents; that often there; 16 MB of hashes at most
BITS = 1024  # of a parity sketch
LONG = BITS // 2  # sets from that size on have counts too
SLOTS = 1 << 21  # by which texts are told from those of pairs; so many numbers are broadcast at most, 16 MB
SLICES = 4  # of the texts and of the tokens, shuffled one after another: the disk holds one slice's shuffle files at a time
PER_BLOCK = 256  # members or queries, on average
MET, ASKED = 16, 1  # rows a class that a slice of the hits and of the opened groups shuffles, on average
LEAST_MET, LEAST_ASKED = 1 << 21, 1 << 17  # rows for which no further slice is made
NO_ID = -(2**63)


def sets_of(column, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, at = W.hashed_words(column, W.SPACES)
    runs = W.window_hashes(hashes, width)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(W.span_hashes(hashes[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(tokens: np.ndarray, salt: int = 0) -> np.uint64:
    """Name of a set: equal sets have equal names."""
    if salt:
        tokens = W.mix(tokens ^ np.uint64(salt))
    return W.span_hashes(tokens, np.array([0]), np.array([len(tokens)]))[0]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def parity(tokens: np.ndarray) -> bytes:
    """Sketch in which each token flips a bit: two sketches differ in no more bits than their sets in tokens."""
    return np.packbits((np.bincount((tokens >> np.uint64(20)) & np.uint64(BITS - 1), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def bucket_counts(tokens: np.ndarray) -> bytes:
    """Tokens by bucket, 255 at most, of a set too large for a parity sketch: two sets differ in as many tokens at least as their counts, added up, do."""
    if len(tokens) < LONG:
        return b""
    return np.minimum(np.bincount((tokens >> np.uint64(20)) & np.uint64(BITS - 1), minlength=BITS), 255).astype(np.uint8).tobytes()


def prefix_length(n: int, percent: int, lap: int) -> int:
    """Tokens of which two sets that link share lap (or all that there are)."""
    return min(n, n - -(-percent * n // 100) + lap)


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """id, key, set size, set name, minhash keys and sketches of every document."""
    import pyarrow as pa

    def run(batches):
        seeds = W.mix(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        for batch in W.batches_of(batches):
            sets = sets_of(batch.column("text"), width)
            names = [np.array([signature(s, salt) for s in sets], np.uint64).view(np.int64) for salt in (0, 0xA0761D6478BD642F)]
            keys = [(W.mix(s[None, :] ^ seeds[:, None]).min(axis=1).view(np.int64).tolist() if len(s) else []) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, names), pa.array(keys, pa.list_(pa.int64())), pa.array(map(parity, sets), pa.binary()), pa.array(map(bucket_counts, sets), pa.binary())], ["id", "key", "n", "s1", "s2", "keys", "bits", "counts"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key long, n long, s1 long, s2 long, keys array<long>, bits binary, counts binary")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs of classes (a, b) whose sets pass the exact test; texts holds each class's (node, text).

    Texts are told apart by a hash of their class before they are shuffled, so
    those in no pair stay where they are, but for some that share a slot.
    """
    import pyarrow as pa

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = written(pairs.select(F.explode(F.array(slot("a"), slot("b"))).alias("slot")).distinct(), "slots")
    texts = written(texts.withColumn("slot", slot("node")).join(F.broadcast(slots), "slot", "left_semi").drop("slot"), "pair-texts")
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), "text"), "a")

    def run(batches):
        last, last_set = None, None
        for batch in W.batches_of(batches):
            a_names, b_names = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            b_sets = sets_of(batch.column("b_text"), width)
            a_texts = batch.column("text")
            kept = []
            for k, (a, b) in enumerate(zip(a_names, b_names)):
                if a != last:
                    last, last_set = a, sets_of(a_texts.slice(k, 1), width)[0]
                if similar(last_set, b_sets[k], percent):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.int64())], ["a", "b"])

    return both.select("a", "b", "text", "b_text").mapInArrow(run, "a long, b long")


def frequent_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes that are frequent in a hash sample: they go last in the order, which changes cost, never results."""
    import pyarrow as pa

    def run(batches):
        for batch in W.batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets_of(batch.column("text"), width)).view(np.int64))], ["token"])

    some = docs.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    got = written(counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token"), "frequent-tokens").toArrow().column("token").to_numpy()
    return np.sort(got.view(np.uint64))


def prefixes(texts: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, node, n) for the prefix tokens of every class (node, text)."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # at most 16 MB, see MOST_FREQUENT

    def run(batches):
        late = shared.value
        for batch in W.batches_of(batches):
            tokens, of = [], []
            sets = sets_of(batch.column("text"), width)
            for k, s in enumerate(sets):
                place = np.searchsorted(late, s)
                is_late = late[np.minimum(place, len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
                first = np.concatenate([s[~is_late], s[is_late]])[: prefix_length(len(s), percent, LAP)]
                tokens.append(first)
                of.append(np.full(len(first), k))
            of = np.concatenate(of)
            sizes = np.array([len(s) for s in sets])[of]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), batch.column("node").take(pa.array(of)), pa.array(sizes, pa.int32())], ["token", "node", "n"])

    return texts.select("node", "text").mapInArrow(run, "token long, node long, n int")


def in_slice(k: int, *columns: str, of: int = SLICES) -> Column:
    """Rows of the slice k, all that are equal in the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(of)) == k


def shared_by(rows: DataFrame, by: str) -> DataFrame:
    """The tokens that stand with several values of by."""
    return rows.groupBy("token").agg(F.min(by).alias("a"), F.max(by).alias("b")).where("a <> b").select("token")


def several_classes(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (token, node, n, grp, comp) of the matrix whose token stands in several classes: few, found slice by slice of the tokens."""

    def slices():
        for k in range(SLICES):
            rows = matrix.where(in_slice(k, "token"))
            several = rows.join(written(shared_by(rows, "node"), "shared-tokens"), "token", "left_semi")
            yield several.join(nodes.select("node", "grp", "comp"), "node")

    return written(slices(), "shared-slices")


def qualifying(several: DataFrame, percent: int, n_classes: int) -> DataFrame:
    """(node, grp) where the class shares LAP prefix tokens with the union of a group that holds a fitting size and a class not linked to it yet.

    Takes the rows of ``several_classes``.  Groups are summed up by token before
    they meet the queries, so a token that very many classes of one group share
    is a single row on that side, and the other side can be split.  Queries and
    groups that meet at a token grow faster than the input; they are shuffled in
    slices of queries, of about MET rows for each class.
    """
    rows = written(several.join(written(shared_by(several, "comp"), "live-tokens"), "token", "left_semi"), "live-matrix")
    union = written(rows.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("c")), "unions")
    meetings = union.groupBy("token").agg(F.count("*").alias("groups"), F.sum("c").alias("c")).agg(F.sum(F.col("groups").cast("double") * F.col("c"))).first()[0] or 0
    slices = max(1, math.ceil(meetings / max(MET * n_classes, LEAST_MET)))

    def hits(k):
        met = rows.where(in_slice(k, "node", of=slices)).drop("grp").join(union.drop("c"), "token")
        met = met.where(f"100 * high >= {percent} * n and 100 * n >= {percent} * low and (first <> comp or last <> comp)")
        # Sets too small for LAP tokens share as many as a link needs.
        shared = met.groupBy("node", "grp").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        return shared.where(f"shared >= least({LAP}, ({percent} * n + 99) div 100)").select("node", "grp")

    return written((hits(k) for k in range(slices)), "hits")


COLUMNS = ["node", "comp", "n", "bits", "counts"]


def in_blocks(rows: DataFrame, side: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows (grp and COLUMNS) packed into about PER_BLOCK a block, and the list of blocks (grp, tag, block).

    A component with PER_BLOCK rows in a group has blocks of its own, tagged
    with its number; the others share blocks tagged -1.
    """
    sizes = rows.groupBy("grp", "comp").agg(F.count("*").alias("c")).withColumn("tag", F.when(F.col("c") >= PER_BLOCK, F.col("comp")).otherwise(F.lit(-1)))
    sizes = written(sizes, "component-sizes")
    blocks = written(sizes.groupBy("grp", "tag").agg(F.ceil(F.sum("c") / PER_BLOCK).alias("blocks")), "block-counts")
    deal = written(sizes.join(blocks, ["grp", "tag"]).select("grp", "comp", "tag", "blocks"), "deal")
    dealt = rows.join(deal, ["grp", "comp"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # A group's rows lie in one task here, unless they are dealt anew by block.
    packed = dealt.repartition(parts, "grp", "tag", "block").groupBy("grp", "tag", "block").agg(F.collect_list(F.struct(*COLUMNS)).alias("rows"))
    names = [F.col(c).alias(f"{side}_{c}") for c in ("tag", "block", "rows")]
    listed = blocks.select("grp", "tag", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return packed.select("grp", *names), listed.select("grp", *names[:2])


def differing(a: bytes, b: bytes) -> int:
    """Tokens at least that two sets with these counts don't share."""
    return int(np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).sum())


def opened_pairs(queries: DataFrame, members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of queries and members of the groups they open that no bound rules out."""
    import pyarrow as pa

    def columns(rows):
        return [np.array([r[c] for r in rows]) for c in ("node", "comp", "n")] + [np.frombuffer(b"".join(r["bits"] for r in rows), np.uint64).reshape(len(rows), -1), [r["counts"] for r in rows]]

    def run(batches):
        for batch in batches:
            for q, m in zip(batch.column("q_rows"), batch.column("m_rows")):
                (q_node, q_comp, q_n, q_bits, q_counts), (m_node, m_comp, m_n, m_bits, m_counts) = columns(q.as_py()), columns(m.as_py())
                for k in range(len(q_node)):
                    # Apart in size at most as the threshold lets, and not linked yet; the sketches are read for those only.
                    ok = np.flatnonzero((m_comp != q_comp[k]) & (np.abs(m_n - q_n[k]) * (100 + percent) <= (m_n + q_n[k]) * (100 - percent)))
                    apart = np.bitwise_count(m_bits[ok] ^ q_bits[k]).sum(axis=1).astype(np.int64)
                    ok = ok[apart * (100 + percent) <= (m_n[ok] + q_n[k]) * (100 - percent)]
                    if q_counts[k]:
                        ok = ok[[not m_counts[x] or differing(m_counts[x], q_counts[k]) * (100 + percent) <= int(m_n[x] + q_n[k]) * (100 - percent) for x in ok]]
                    if len(ok):
                        mine = np.full(len(ok), q_node[k])
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(m_node[ok], mine)), pa.array(np.maximum(m_node[ok], mine))], ["a", "b"])

    (q, q_list), (m, m_list) = in_blocks(queries, "q", parts), in_blocks(members, "m", parts)
    pairs = q_list.join(m_list, "grp").where("q_tag = -1 or q_tag <> m_tag")
    both = pairs.join(q, ["grp", "q_tag", "q_block"]).join(m, ["grp", "m_tag", "m_block"])
    return both.select("q_rows", "m_rows").mapInArrow(run, "a long, b long").distinct()


def placed_documents(docs: DataFrame, parts: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, key, n, first_id and first_key of every document (doc_id, text): the first row of its component, itself where it is linked with nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_key().alias("key"), or_empty("text").alias("text"))
    all_docs = written(summaries(texts, width), "sets")
    name = ["s1", "s2", "n"]
    classes = all_docs.where("n > 0").groupBy(*name).agg(F.min(F.struct("id", "key")).alias("f"), *[F.first(c).alias(c) for c in ("keys", "bits", "counts")])
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), *name, "f.id", "f.key", "keys", "bits", "counts"), "classes")
    own = lambda k: classes.where(in_slice(k, "id", "key")).select("id", "key", "node")
    of_class = written((one_text(texts.where(in_slice(k, "id", "key"))).join(own(k), ["id", "key"]).select("node", "text") for k in range(SLICES)), "class-texts")

    # The leader of a key is the class that shares keys with most others: copies of one text are nearer to it than to each other.
    # Of equals it is the one that came first, as copies follow what they copy.
    keyed = classes.select("node", "n", F.bitwise_not("id").alias("back"), F.posexplode("keys").alias("k", "mark"))
    shared = written(keyed.groupBy("k", "mark").agg(F.count("*").alias("m")).where("m > 1"), "shared-keys")
    keyed = written(keyed.join(shared, ["k", "mark"]), "keyed")
    liked = keyed.groupBy("node").agg(F.sum("m").alias("liked"))
    leaders = keyed.join(liked, "node").groupBy("k", "mark").agg(F.max(F.struct("liked", "back", "node", "n")).alias("l"))
    led = keyed.join(written(leaders, "leaders"), ["k", "mark"])
    families = led.groupBy("node").agg(F.max(F.struct("l.liked", "l.back", "l.node"))["node"].alias("grp"))
    offered = led.where(f"node <> l.node and 100 * least(n, l.n) >= {percent} * greatest(n, l.n)")
    offered = offered.select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
    links = finished(spark, "verified", lambda: verified(written(offered, "offered"), of_class, width, percent))
    groups = finished(spark, "groups", lambda: components(links))

    nodes = classes.select("node", "n", "bits", "counts").join(groups, "node", "left").join(families, "node", "left")
    nodes = written(nodes.select("node", F.coalesce("component", "node").alias("comp"), F.coalesce("grp", "node").alias("grp"), "n", "bits", "counts"), "nodes")

    def asking():
        matrix = lambda: written(prefixes(of_class, width, percent, frequent_tokens(of_class, width)), "matrix")
        several = finished(spark, "shared-matrix", lambda: several_classes(matrix(), nodes))  # the matrix, mostly tokens of one class, goes
        return qualifying(several, percent, nodes.count())

    asked = finished(spark, "asked", asking)

    def linking():
        of_asked = nodes.join(written(asked.select("grp").distinct(), "asked-groups"), "grp", "left_semi").select("grp", *COLUMNS)
        slices = max(1, math.ceil(asked.count() / max(ASKED * nodes.count(), LEAST_ASKED)))

        def opened(k):
            mine = in_slice(k, "grp", of=slices)
            return opened_pairs(asked.where(mine).join(nodes.select(*COLUMNS), "node").select("grp", *COLUMNS), of_asked.where(mine), percent, parts)

        found = written((opened(k) for k in range(slices)), "opened-slices")
        more = verified(written(found.distinct(), "opened"), of_class, width, percent)
        return components(written(links.unionByName(more), "all-links"))

    linked = finished(spark, "components", linking)
    first = linked.join(classes.select("node", "id", "key"), "node").groupBy("component").agg(F.min(F.struct("id", "key")).alias("first"))
    of_node = classes.select("node", *name, F.struct("id", "key").alias("own")).join(linked, "node", "left").join(written(first, "firsts"), "component", "left")
    of_node = written(of_node.select(*name, F.coalesce("first", "own").alias("first")), "class-components")
    out = all_docs.select("id", "key", *name).join(of_node, name, "left")
    return out.select("id", "key", "n", F.coalesce("first.id", "id").alias("first_id"), F.coalesce("first.key", "key").alias("first_key"))


def join_documents(docs: DataFrame, parts: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (doc_id, text)."""
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    found = lambda: placed_documents(docs, parts, width, percent).select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("first_id").alias("component_id"))
    return finished(docs.sparkSession, "joined", found)


def one_of_each(docs: DataFrame, parts: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, with one row of each component: the first by doc_id.

    Rows are told apart by doc_id and text, so a doc_id that stands on unlike
    texts loses no text; of rows equal in both one stays.  Texts without words
    are in no component and all stay.
    """
    spark = docs.sparkSession

    def found():
        rows = placed_documents(docs.select("doc_id", "text"), parts, width, percent).where("n > 0")
        is_first = (F.col("id") == F.col("first_id")) & (F.col("key") == F.col("first_key"))
        return rows.groupBy("id", "key", is_first.alias("stays")).agg(F.count("*").alias("times")).where("not stays or times > 1")

    marks = finished(spark, "near-duplicates", found)
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": text_key()})
    on = lambda df: [keyed["_id"] == df["id"], keyed["_key"] == df["key"]]
    kept = keyed.join(marks, on(marks), "left_anti").drop("_id", "_key")
    again = marks.where("stays")
    if not again.head(1):
        return kept
    repeated = keyed.join(again, on(again), "left_semi").dropDuplicates(["_id", "_key"]).drop("_id", "_key")
    return kept.unionByName(repeated)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), shuffle_parts(spark))


# Shingles by their words, pairs by an inverted list, components by the smallest id reachable.
SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WIDTH} THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(len(words) - {WIDTH} + 1), lambda k: array_to_string(words[k + 1 : k + {WIDTH}], ' '))) END AS s FROM docs),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS rep FROM sets),
lists AS (SELECT doc_id, n, unnest(s) AS w FROM sets JOIN named USING (doc_id) WHERE rep = doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM lists a JOIN lists b ON a.w = b.w AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM named UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, f)::BIGINT AS component_id FROM named JOIN (SELECT a, min(b) AS f FROM reach GROUP BY a) ON a = rep"""
