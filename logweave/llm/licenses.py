"""License scans: a positional rare-token index over licence templates.

Main path: built-in functions only, and no shuffle of documents.  One pass
counts in how many documents each template word occurs.  Each template is then
indexed under its rarest words - so many that every match holds at least AGREE
of them (all, if the template has fewer or none may lack).  A file's rare
licence words are looked up and their postings intersected by relative position
(start of the template = position in the file - position in the template): a
start stays if as many postings give it as a match must hold.  There the words
at the implied places and the template's mandatory phrase are verified.

Templates are whole licence texts, the notices that licences ask authors to
place, and one-line notices (``licence_texts``).

Defined results: a null or empty text has no words, no places and empty
labels; repeated rows are scanned each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, or_empty, read_table
from .licence_texts import LICENCES

# The phrases and labels that every scan counts exactly.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

SHARE = 0.8  # of a template's weight that must stand at its places
AGREE = 3  # postings that must give one start

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def templates() -> list[dict]:
    """Base phrases (all words must match) and the method's own templates."""
    out = [{"label": label, "words": phrase.split(), "base": True, "must": phrase.split()} for phrase, label in BASE.items()]
    out += [{"label": label, "words": plain_words(text), "base": False, "must": must.split()} for label, text, must in LICENCES]
    for t in out:
        n = len(t["must"])
        t["must_at"] = next(i for i in range(len(t["words"])) if t["words"][i : i + n] == t["must"])
    return out


def rarity(n_docs: int, df: int) -> int:
    """Whole-number inverse document frequency: the bits of documents per document with the word."""
    return (n_docs // (df + 1)).bit_length() + 1


def weigh(found: list[dict], n_docs: int, df: dict[str, int]) -> None:
    """Give templates their words' weights, the weight they need and the offsets they are indexed under."""
    for t in found:
        t["weights"] = [rarity(n_docs, df.get(w, 0)) for w in t["words"]]
        total = sum(t["weights"])
        t["need"] = total if t["base"] else -int(-total * SHARE // 1)
        lack = total - t["need"]
        t["anchors"], held, order = [], 0, sorted(range(len(t["words"])), key=lambda i: (-t["weights"][i], t["words"][i], i))
        for t["agree"] in range(min(AGREE, len(order)) if not t["base"] else len(order), 0, -1):
            # A match without so many of the anchors would lack the others: more than it may, if they weigh more than lack.
            most = sum(t["weights"][i] for i in order[: t["agree"] - 1])
            if total - most > lack:
                break
        for i in order:
            if held - most > lack:
                break
            t["anchors"].append(i)
            held += t["weights"][i]


def document_frequencies(words: DataFrame, column: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each vocabulary word: one row a word comes to the driver."""
    present = words.select(F.explode(F.array_append(F.array_intersect(F.col(column), F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("w"))
    counts = {r["w"]: r["n"] for r in present.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and templates of every document."""
    words = docs.select("doc_id", words_of(or_empty("text")).alias("words"))
    known = templates()
    vocabulary = sorted({w for t in known for w in t["words"]})
    weigh(known, *document_frequencies(words, "words", vocabulary))

    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(known):
        for i in t["anchors"]:
            postings.setdefault(t["words"][i], []).append((k, i))
    rare = sorted(postings)
    one = lambda k, i: F.struct(F.lit(k).alias("t"), F.lit(i).alias("at"))
    listed = F.array(*[F.array(*[one(k, i) for k, i in postings[w]]) for w in rare])
    rare_words = F.split(F.lit(" ".join(rare)), " ")
    by_template = lambda name, kind: F.array(*[F.split(F.lit(" ".join(map(str, t[name]))), " ").cast(f"array<{kind}>") for t in known])
    of_template = lambda name: F.array(*[F.lit(t[name]) for t in known])

    w = F.col("words")
    hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), i)), lambda i: i.isNotNull())
    found = words.withColumn("hits", hits)
    offered = F.transform(
        "hits",
        lambda p: F.transform(
            F.element_at(listed, F.array_position(rare_words, F.get(w, p)).cast("int")),
            lambda e: F.struct(e["t"].alias("t"), (p - e["at"]).alias("start")),
        ),
    )

    def intersected(s: Column) -> Column:
        """Starts that stand as often in the sorted list as the template asks."""
        enough = lambda x, i: F.get(s, i + F.get(of_template("agree"), x["t"]) - 1).eqNullSafe(x)
        return F.filter(s, lambda x, i: enough(x, i) & ((i == 0) | ~F.get(s, i - 1).eqNullSafe(x)))

    # Bound as a lambda variable, so that the list isn't computed again for each element.
    starts = F.get(F.transform(F.array(F.sort_array(F.flatten(offered))), intersected), F.lit(0))
    found = found.withColumn("starts", starts)
    words_by, weights_by, must_by = by_template("words", "string"), by_template("weights", "int"), by_template("must", "string")
    at = lambda p: F.when(p >= 0, F.get(w, p))

    def weighed(s: Column) -> Column:
        mine, weights = F.get(words_by, s["t"]), F.get(weights_by, s["t"])
        gained = F.transform(mine, lambda x, i: F.when(x == at(s["start"] + i), F.get(weights, i)).otherwise(0))
        key = F.transform(F.get(must_by, s["t"]), lambda x, i: F.coalesce(x == at(s["start"] + F.get(of_template("must_at"), s["t"]) + i), F.lit(False)))
        return F.struct(s["t"].alias("t"), s["start"].alias("start"), F.aggregate(gained, F.lit(0), lambda a, x: a + x).alias("got"), F.forall(key, lambda x: x).alias("key"))

    verified = F.filter(F.transform("starts", weighed), lambda s: s["key"] & (s["got"] >= F.get(of_template("need"), s["t"])))
    found = found.withColumn("ok", F.when(F.size("starts") > 0, verified)).withColumn("base", F.filter("ok", lambda s: F.get(of_template("base"), s["t"])))
    label = lambda col: F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(col, F.array()), lambda s: F.get(of_template("label"), s["t"])))), ",")
    total = F.array(*[F.lit(sum(t["weights"])) for t in known])
    share = F.array_max(F.transform("ok", lambda s: s["got"] / F.get(total, s["t"])))
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["start"])).cast("long").alias("last_word"),
        label(F.col("base")).alias("base_labels"),
        label(F.col("ok")).alias("labels"),
        F.coalesce(share, F.lit(0.0)).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def sql() -> str:
    """The same result in DuckDB SQL, trying every template at every place."""
    known = templates()
    rows = ", ".join(f"({k}, '{t['label']}', {str(t['base']).lower()}, {i}, '{w}', {str(t['must_at'] <= i < t['must_at'] + len(t['must'])).lower()})" for k, t in enumerate(known) for i, w in enumerate(t["words"]))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH tw(t, label, base, i, w, must) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
places AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM docs),
df AS (SELECT w, count(DISTINCT r) AS n FROM places WHERE w IN (SELECT w FROM tw) GROUP BY w),
weights AS (SELECT tw.*, CASE WHEN (SELECT count(*) FROM docs) // (coalesce(df.n, 0) + 1) = 0 THEN 1
  ELSE length(bin((SELECT count(*) FROM docs) // (coalesce(df.n, 0) + 1))) + 1 END AS weight FROM tw LEFT JOIN df USING (w)),
totals AS (SELECT t, sum(weight) AS total, sum(must::INT) AS n_must, any_value(label) AS label, any_value(base) AS base FROM weights GROUP BY t),
hits AS (SELECT r, x.t, p - i AS start, sum(weight) AS got, sum(must::INT) AS got_must FROM places JOIN weights x USING (w) GROUP BY r, x.t, p - i),
ok AS (SELECT r, label, base, start, got / total AS share FROM hits JOIN totals USING (t)
  WHERE got_must = n_must AND got >= CASE WHEN base THEN total ELSE ceil(total * {SHARE}) END),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM ok GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN per USING (r)"""
