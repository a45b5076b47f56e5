"""The training-data operators against brute force, round trips and held-out accuracy, with the edge cases each states."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, sig int, words string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, "w") for i, t in rows], DOCS)


def real(spark, n=None):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return df if n is None else df.orderBy("doc_id").limit(n)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id text with some words in it"), (7, "é漢 😀 " * 30)]


# op1


def brute_licenses(text):
    from logweave.llm.licenses import BASE

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_licenses(spark):
    from logweave.llm import licenses

    rows = [*EDGE, (10, "CC BY cc-by\nAll Rights RESERVED."), (11, "general public  License. gnu general public license"), (12, "cc by " * 5000), (13, "marK cc bİy"), (14, "Licensed under the Apache License, Version 2.0.")]
    df = docs(spark, rows)
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    key = lambda x: str(x)
    want = sorted(((i, *brute_licenses(t)) for i, t in rows), key=key)
    assert sorted((tuple(r)[:6] for r in got), key=key) == want
    by = {r["doc_id"]: r for r in got}
    assert by[14]["labels"] == "apache-2" and by[14]["score"] == 1.0 and by[10]["labels"] == "cc-by,reserved" and by[1]["labels"] == ""
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_licence_texts(spark):
    """Each licence is found in a text around it, and with a word in twelve replaced unless that hits its mandatory phrase."""
    from logweave.llm import licenses

    rng, rows = random.Random(3), []
    known = [t for t in licenses.templates() if not t["base"]]
    assert sum(len(t["words"]) > 20 for t in known) >= 20
    for k, t in enumerate(known):
        words = [*t["words"]]
        rows.append((k, sentence(rng, 30) + " " + " ".join(words).upper() + ". " + sentence(rng, 30)))
        free = [i for i in range(len(words)) if not t["must_at"] <= i < t["must_at"] + len(t["must"])]
        for i in rng.sample(free, len(words) // 12):
            words[i] = "replaced"
        rows.append((1000 + k, " ".join(words)))
        rows.append((2000 + k, " ".join(words[: len(words) // 2])))
    found = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows + [(3000, sentence(rng, 2000))])).collect()}
    assert all(t["label"] in found[k]["labels"].split(",") and found[k]["score"] == 1.0 for k, t in enumerate(known))
    assert all(t["label"] in found[1000 + k]["labels"].split(",") for k, t in enumerate(known))
    short = {t["label"] for t in known if len(t["words"]) <= 60}  # one-line notices that stand in the long ones
    assert not any(t["label"] in found[2000 + k]["labels"].split(",") for k, t in enumerate(known) if t["label"] not in short)
    assert found[3000]["labels"] == ""


def test_every_match_holds_enough_anchors():
    from logweave.llm import licenses

    rng = random.Random(4)
    for _ in range(20):
        known = licenses.templates()
        licenses.weigh(known, 10**rng.randint(0, 7), {w: int(10 ** rng.uniform(0, 7)) for t in known for w in t["words"]})
        for t in known:
            spare = sum(t["weights"]) - t["need"]  # the weight that a match may lack, spent on the lightest anchors
            left = len(t["anchors"])
            for i in sorted(t["anchors"], key=lambda i: t["weights"][i]):
                if t["weights"][i] <= spare:
                    spare, left = spare - t["weights"][i], left - 1
            assert left >= t["agree"] >= 1


# op2


def test_chain_marginals_against_all_labelings():
    from itertools import product

    from logweave.llm.quality import BINS, N_FEATURES, Chain

    rng = np.random.default_rng(0)
    model = Chain(np.zeros((N_FEATURES, BINS - 1)), 0.5)
    model.steps = rng.normal(size=(2, 2))
    scores, first = rng.normal(size=9), np.array([0, 4, 4, 9])
    got, pairs = model.marginals(scores, first, pairs=np.ones(3))
    want, both = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 9)):
        total = 0.0
        for y in product((0, 1), repeat=b - a):
            w = np.exp(sum(scores[a + k] for k in range(b - a) if y[k]) + sum(model.steps[y[k], y[k + 1]] for k in range(b - a - 1)))
            total += w
        for y in product((0, 1), repeat=b - a):
            w = np.exp(sum(scores[a + k] for k in range(b - a) if y[k]) + sum(model.steps[y[k], y[k + 1]] for k in range(b - a - 1))) / total
            for k in range(b - a):
                want[a + k] += w * y[k]
                if k:
                    both[y[k - 1], y[k]] += w
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_quality_held_out_and_edges(spark):
    from logweave.llm import quality

    sf = "/root/testdata/sf0.01"
    data, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fitted(data, labels)
    got = quality.scored(data, model).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] == 1 for r in got if r["quality"] == 1]
    bad = [r["predicted"] == 0 for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) > 0.8
    out = {(r["doc_id"], r["held_out"], round(r["score"], 6)) for r in quality.scored(docs(spark, EDGE), model).collect()}
    assert {s for i, _, s in out if i in (1, 2, 3)} == {round(model.prior, 6)}
    assert all(h == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, h, _ in out)
    kept = quality.good_documents(docs(spark, EDGE), model, 0.0)
    assert kept.count() == len(EDGE) and kept.columns == docs(spark, []).columns
    assert quality.fitted(data.limit(0), labels).prior == 0.5


def test_quality_of_odd_texts(spark):
    from logweave.llm import quality

    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rng = random.Random(14)
    rows = [(k, "\n".join(sentence(rng, 9).capitalize() + "." for _ in range(4)) if k % 2 else "BUY!!! $$$ now now now\n" * 4) for k in range(60)]
    model = quality.fitted(docs(spark, rows), labels)
    odd = [(100, "word " * 300_000), (101, "\n" * 50_000), (102, "x\n" * 50_000), (103, None), (None, rows[1][1])]
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs(spark, odd + rows), model).collect()}
    assert len(scores) == 65 and all(0 <= s <= 1 for s in scores.values()) and scores[101] == scores[103] == model.prior
    assert np.mean([scores[k] for k in range(1, 60, 2)]) > 0.9 > 0.1 > np.mean([scores[k] for k in range(0, 60, 2)]) and scores[None] == scores[1]
    assert quality.scored(docs(spark, []), model).count() == 0


# op3


def brute_repeats(rows, span):
    """Words that repeat, by doc_id and text."""
    seen, cut = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        mine = set()
        for k in range(len(w) - span + 1):
            if seen.setdefault(tuple(w[k : k + span]), (i, k)) != (i, k):
                mine.update(range(k, k + span))
        if mine:
            cut[i] = mine
    return cut


def planted(rng):
    passage, text = sentence(rng, 60), sentence(rng, 120)
    rows = [(k, sentence(rng, rng.randint(0, 80)) + " " + passage + " " + sentence(rng, rng.randint(0, 80))) for k in range(12)]
    rows += [(20 + k, text) for k in range(4)] + [(30, sentence(rng, 200)), (31, "la " * 3000), (32, sentence(rng, 30) + " " + " ".join(passage.split()[:49]))]
    return rows


def test_repeats(spark):
    from logweave.llm import suffixes

    rows = planted(random.Random(2))
    df = docs(spark, rows + [(101, None), (102, ""), (103, " \n")])
    mine = defaultdict(set)
    for r in suffixes.repeats(df, 5).collect():
        mine[r["id"]].update(range(r["start"], r["start"] + r["n_words"]))
    want = brute_repeats(rows, 50)
    assert dict(mine) == want and 30 not in want and 32 not in want
    out = suffixes.without_repeats(df, 5)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in rows:
        left = [w for k, w in enumerate(t.split()) if k not in want.get(i, ())]
        assert (texts[i].split() if i in texts else []) == left
    assert {101, 102, 103} <= set(texts)
    assert suffixes.repeats(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("least,most", [(8192, 65536), (16, 64), (5, 12)])
def test_runs_cut_anywhere_give_the_same_repeats(spark, least, most):
    """A task may see the run of a hot passage in pieces."""
    from logweave.llm import suffixes

    rng = random.Random(12)
    passage, inner = sentence(rng, 90), sentence(rng, 30)
    rows = [(k, " ".join([sentence(rng, rng.randint(0, 30)), passage if k % 3 else passage[: len(passage) // 2], inner if k % 2 else "", sentence(rng, rng.randint(0, 30))])) for k in range(90)]
    rows += [(200 + k, f"{inner} {inner} {sentence(rng, 3)}") for k in range(9)] + [(300, "x" * 3000 + " " + "la " * 300), (301, "y " + "x" * 3000 + " " + "la " * 300)]
    mine = defaultdict(set)
    for r in suffixes.repeats(docs(spark, rows), 3, least=least, most=most).collect():
        mine[r["id"]].update(range(r["start"], r["start"] + r["n_words"]))
    assert dict(mine) == brute_repeats(rows, 50)


def test_open_matches_are_joined_by_place_not_by_copy(spark, monkeypatch):
    """Tasks that share a hot passage exchange rows that don't grow with its copies, and no match is lost."""
    from logweave.llm import suffixes

    rng = random.Random(14)
    passage = sentence(rng, 60)
    rows = [(k, f"{sentence(rng, 5)} {passage} {sentence(rng, 5)}") for k in range(300)]
    settle, joined = suffixes.settled, []
    monkeypatch.setattr(suffixes, "settled", lambda found: joined.append(found.where(found["kind"] == suffixes.OPEN)) or settle(found))
    monkeypatch.setattr(suffixes, "MOST_PAIRS", 50)
    mine = defaultdict(set)
    for r in suffixes.repeats(docs(spark, rows), 3).collect():
        mine[r["id"]].update(range(r["start"], r["start"] + r["n_words"]))
    assert dict(mine) == brute_repeats(rows, 50)
    assert 0 < joined[0].count() < 40


def test_cutting_makes_no_row_for_each_window(spark, monkeypatch):
    """Texts of two words over and over repeat a window at each word; what is cut is a range of a document."""
    import pyspark.sql.classic.dataframe as frames

    from logweave.llm import suffixes

    rng = random.Random(15)
    rows = [(k, f"{sentence(rng, 5)} {'la li ' * 100}{sentence(rng, 60)}") for k in range(40)]
    made, real_map = {}, frames.DataFrame.mapInArrow

    def counted(df, run, schema):
        total = made[schema] = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in run(batches):
                total.add(batch.num_rows)
                yield batch

        return real_map(df, count, schema)

    monkeypatch.setattr(frames.DataFrame, "mapInArrow", counted)
    out = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(docs(spark, rows), 3).collect()}
    want = brute_repeats(rows, 50)
    assert len(want) == 40 and sum(map(len, want.values())) > 7000
    assert all(out[i].split() == [w for k, w in enumerate(t.split()) if k not in want[i]] for i, t in rows)
    # Suffixes, kept or with their words, are a row a minimiser.
    matched = [total.value for schema, total in made.items() if "block" not in schema and "right" not in schema]
    assert len(matched) >= 2 and max(matched) < 1000


@pytest.mark.parametrize("least,most", [(8192, 65536), (16, 64), (5, 12)])
def test_words_that_repeat_are_those_of_the_passages(spark, least, most):
    from logweave.llm import suffixes

    rng = random.Random(16)
    rows = planted(rng) + [(100 + k, f"{sentence(rng, rng.randint(0, 9))} {'la li ' * rng.randint(20, 60)}{sentence(rng, 9)}") for k in range(30)]
    mine = defaultdict(set)
    for r in suffixes.repeated_words(docs(spark, rows), 3, least=least, most=most).collect():
        for start, stop in zip(r["starts"], r["stops"], strict=True):
            mine[r["id"]].update(range(start, stop))
    assert dict(mine) == brute_repeats(rows, 50)


def test_repeats_tell_rows_of_one_id_apart(spark):
    from logweave.llm import suffixes

    rng = random.Random(13)
    passage, alone = sentence(rng, 60), sentence(rng, 70)
    rows = [(1, passage + " " + sentence(rng, 20)), (5, sentence(rng, 10) + " " + passage), (5, alone), (5, alone), (6, None), (None, sentence(rng, 5) + " " + passage), (None, alone), (None, ""), (7, alone + " ")]
    out = sorted(((r["doc_id"], r["text"]) for r in suffixes.without_repeats(docs(spark, rows), 5).collect()), key=str)
    # A null doc_id ranks first, so its texts are whole and the others lose what they share with them.
    want = [(1, rows[0][1].removeprefix(passage).strip()), (5, " ".join(rows[1][1].split()[:10])), (6, None), (None, rows[5][1]), (None, alone), (None, "")]
    assert out == sorted(want, key=str)


def test_repeats_on_documents(spark):
    from logweave.llm import suffixes

    mine = defaultdict(set)
    for r in suffixes.op3_suffixes(spark, SF).collect():
        mine[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert dict(mine) == brute_repeats([tuple(r) for r in real(spark).collect()], 50)


# op4


def test_decontamination(spark):
    from logweave.llm import decontaminate as d

    rng = random.Random(4)
    items = [(k, sentence(rng, n)) for k, n in enumerate([40, 25, 14, 6])]
    replaced = items[0][1].split()
    for k in (3, 11, 19, 27, 35):
        replaced[k] = "zzz"
    rows = [(1, sentence(rng, 50) + " " + " ".join(replaced).upper() + ", " + sentence(rng, 9)), (2, items[1][1]), (3, sentence(rng, 300)), (4, items[2][1] + "!"), (5, "x " + items[3][1]), (6, " ".join(items[0][1].split()[:9]) + " " + sentence(rng, 20)), (7, None), (8, "")]
    bench = spark.createDataFrame(items + [(99, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in d.contaminated(docs(spark, rows), bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (4, 2), (5, 3)}
    assert found[1, 0]["doc_word"] == 50 and found[1, 0]["n_words"] == 40 and found[1, 0]["n_same"] == 35
    kept = d.clean_documents(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7, 8]
    assert d.contaminated(docs(spark, rows), bench.limit(0)).count() == 0 and d.contaminated(docs(spark, []), bench).count() == 0


def test_masks_leave_no_passage_out():
    from itertools import combinations

    from logweave.llm import decontaminate as d

    hit = lambda masks, n, gone: any(not any(0 <= k - at < len(m) and m[k - at] == "1" for k in gone) for m in masks for at in range(n - len(m) + 1))
    for n in range(d.SHORT, d.LEAST + 1):
        masks = d.MASKS if n >= d.LONG else d.SHORT_MASKS
        for gone in combinations(range(n), n - int(np.ceil(d.SHARE * n))):
            assert hit(masks, n, gone), (n, gone)


def brute_passages(text, item):
    """Passages at every shift of the item along the text, by words."""
    from logweave.llm import decontaminate as d

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    a, b, out = words(text), words(item), set()
    if 0 < len(b) < d.SHORT:
        return {(0, 0, len(b), len(b))} if a == b else set()
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), shift + len(b))
        same = np.array([a[p] == b[p - shift] for p in range(lo, hi)], bool)
        out |= {(lo + x, lo - shift + x, y - x, int(same[x:y].sum())) for x, y in d.agreeing(same, min(d.LEAST, len(b)))} if len(b) else set()
    return out


def test_decontamination_against_every_shift(spark):
    from logweave.llm import decontaminate as d

    rng = random.Random(5)
    vocabulary = [sentence(rng, 1) for _ in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(n, " ".join(some(n))) for n in [1, 2, 5, *range(6, 21), 30, 60]] + [(100, None), (101, ""), (102, "?!"), (None, " ".join(some(16)))]
    items += [(103, items[9][1]), (104, items[9][1].upper() + ".")]
    rows = [(1, None), (2, ""), (3, "oh yes we can " + items[0][1]), (4, items[0][1]), (5, items[1][1]), (6, items[2][1] + " more"), (7, " ".join(some(6000)))]
    for k in range(240):
        item = rng.choice(items[3:20])[1].split()
        for place in rng.sample(range(len(item)), rng.randint(0, max(1, len(item) // 4))):
            item[place] = "zzz"
        rows.append((10 + k, " ".join(some(rng.randint(0, 30)) + item[rng.choice([0, 0, 1]) :] + some(rng.randint(0, 30)))))
    rows += [(None, items[12][1]), (5, " ".join(some(30))), (4, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in d.contaminated(docs(spark, rows), bench).collect()), key=str)
    want = sorted({(i, k, *p) for i, t in set(rows) for k, item in items for p in brute_passages(t, item)}, key=str)
    assert got == want and len({i for i, *_ in want}) > 100
    dirty = {(i, t) for i, t in rows if any(brute_passages(t, item) for _, item in items)}
    kept = d.clean_documents(docs(spark, rows), bench)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((r for r in rows if r not in dirty), key=str)
    assert kept.columns == docs(spark, []).columns


def test_full_blooms_lose_nothing():
    from logweave.llm import decontaminate as d

    rng = np.random.default_rng(3)
    inside, outside = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for bloom, least, most in ((d.Bloom.fitting(5000), 0, 10), (d.Bloom(1 << 10), 4000, 5000)):
        bloom.add(inside)
        assert len(bloom.maybe(inside)) == 5000 and least <= len(bloom.maybe(outside)) <= most


# op5


def test_sharding(spark):
    from logweave.llm import sharding

    rng = random.Random(6)
    rows = [(k, "hot" if k % 3 == 0 else f"pair {k // 4}" if k % 2 else sentence(rng, 5)) for k in range(400)] + [(1000, None), (1001, ""), (None, "nul")]
    got = sharding.shard_documents(docs(spark, rows), 8, 5).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = dict(rows)
    for r in got.itertuples():
        t = "nul" if r.doc_id != r.doc_id else text[int(r.doc_id)] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
    parted = got[got["size"] != 4].groupby("text_crc32")["shard"].nunique()
    assert (parted > 1).sum() <= 7
    assert sharding.shard_documents(docs(spark, []), 8, 5).count() == 0


def test_sharding_of_odd_rows(spark):
    """Null and repeated ids, groups larger than one and than several shards, a very long text."""
    from logweave.llm import sharding

    rng = random.Random(16)
    rows = [(None, "hot")] * 50 + [(7, "hot")] * 150 + [(7, "warm")] * 60 + [(k, sentence(rng, 3)) for k in range(100)] + [(500, "long " * 400_000), (None, None)]
    got = sharding.shard_documents(docs(spark, rows), 8, 5).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    spread = got.groupby("text_crc32")["shard"].nunique()
    mean = len(rows) / 8
    assert spread[zlib.crc32(b"hot")] <= -(-200 // mean) + 2 and spread[zlib.crc32(b"warm")] <= 4
    assert got["size"].max() == 2_000_001


# op6


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, width, percent):
    from logweave.llm import jaccard

    rng = random.Random(8)
    base, rows = sentence(rng, 90).split(), []
    for k in range(40):  # a chain: neighbours are similar, ends are not
        base = [*base]
        base[rng.randrange(len(base))] = f"w{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, sentence(rng, rng.randint(0, 12))) for k in range(30)] + [(200, "A b C"), (201, "a B c"), (202, None), (203, ""), (204, " ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs(spark, rows), 5, width, percent).collect()}
    assert got == brute_components(rows, width, percent)
    assert jaccard.join_documents(docs(spark, []), 5).count() == 0


def test_jaccard_of_large_groups_and_sets(spark, monkeypatch):
    """A group of several blocks in two large and some small components, and sets large enough for counts by bucket."""
    from logweave.llm import jaccard

    monkeypatch.setattr(jaccard, "PER_BLOCK", 8)
    rng = random.Random(9)
    rows = []
    for k, size in enumerate((60, 60, 900)):
        base = sentence(rng, size).split()
        for c in range(60):
            copy = [*base]
            for place in rng.sample(range(size), rng.randint(0, size // 8)):
                copy[place] = f"w{rng.randint(0, 9)}"
            rows.append((1000 * k + c, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs(spark, rows), 5).collect()}
    assert got == brute_components(rows, 4, 85)
    assert len({c for _, c in got.values()}) > 3


def test_jaccard_tells_rows_of_one_id_apart(spark):
    from logweave.llm import jaccard

    rng = random.Random(10)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (8, b + " end"), (None, c), (9, None), (9, ""), (9, "")]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join_documents(docs(spark, rows), 5).collect())
    assert found == sorted([("1", 37, "1"), ("5", 37, "1"), ("5", 37, "5"), ("7", 37, "None"), ("7", 37, "None"), ("8", 38, "5"), ("None", 37, "None"), ("9", 0, "9"), ("9", 0, "9"), ("9", 0, "9")])
    kept = jaccard.one_of_each(docs(spark, rows), 5)
    assert kept.columns == docs(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (9, None), (9, ""), (9, "")], key=str)
    twice = jaccard.one_of_each(docs(spark, [(1, a), (1, a), (2, b)]), 5)
    assert sorted((r["doc_id"], r["text"]) for r in twice.collect()) == [(1, a), (2, b)]


def test_a_written_step_leaves_no_shuffle_files(spark):
    """The disk that a run takes is that of its largest step, not of all until garbage is collected."""
    import os
    import time

    from logweave.llm import common

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {x for top in dirs for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and x.endswith(".data")}
    before, setting = shuffled(), spark.conf.get(common.CLEAN_SETTING, "false")
    rows = spark.range(20_000).repartition(7).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n"))
    assert common.written(rows, "counts").agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(common.CLEAN_SETTING, "false") == setting
    # The sum's own shuffle, a row a task, may stay.
    ended = time.time() + 5
    while len({x.split("_")[1] for x in shuffled() - before}) > 1 and time.time() < ended:
        time.sleep(0.1)
    assert len({x.split("_")[1] for x in shuffled() - before}) <= 1


def test_jaccard_frees_tables_and_shuffles_texts_of_pairs_only(spark, monkeypatch):
    from logweave.llm import common, jaccard

    rng = random.Random(17)
    rows = [(k, sentence(rng, 60)) for k in range(300)] + [(1000 + k, " ".join(sentence(random.Random(k), 60).split()[:58])) for k in range(4)] + [(2000 + k, sentence(random.Random(k), 60)) for k in range(4)]
    steps, write = {}, jaccard.written

    def noted(df, what):
        out = write(df, what)
        live = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in common._LIVE]
        steps.setdefault(what, []).append((out.count(), live))
        return out

    monkeypatch.setattr(jaccard, "written", noted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs(spark, rows), 3).collect()}
    assert got == brute_components(rows, 4, 85) and got[2001][1] == 1001
    assert steps["class-texts"][0][0] == 308 and max(n for n, _ in steps["pair-texts"]) < 40
    assert {"matrix", "live-matrix", "unions"} <= set(steps) and not {"matrix", "shared-matrix", "live-matrix", "unions"} & set(steps["opened"][0][1])
    assert "pair-texts" not in steps["matrix"][0][1]


def test_jaccard_shuffles_texts_and_tokens_in_slices(spark, monkeypatch):
    """No step shuffles all texts or the whole matrix, whose rows are gone before groups are asked."""
    from logweave.llm import common, jaccard

    rng = random.Random(18)
    rows = [(k, sentence(rng, 60)) for k in range(300)] + [(1000 + k, sentence(random.Random(k), 60) + f" end{k}") for k in range(8)] + [(2000 + k, sentence(random.Random(k % 4), 60)) for k in range(8)]
    counts, live, write = {}, {}, jaccard.written

    def noted(df, what):
        def parts():
            for part in [df] if isinstance(df, DataFrame) else df:
                counts.setdefault(what, []).append(part.count())
                yield part

        out = write(parts(), what)
        live.setdefault(what, [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in common._LIVE])
        return out

    monkeypatch.setattr(jaccard, "written", noted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs(spark, rows), 3).collect()}
    assert got == brute_components(rows, 4, 85) and got[2001][1] == got[2005][1] == 1001
    assert sum(counts["class-texts"]) == 312 and max(counts["class-texts"]) < 0.4 * 312
    assert len(counts["shared-tokens"]) == len(counts["shared-slices"]) > 1 and max(counts["shared-tokens"]) < 0.6 * sum(counts["shared-tokens"])
    assert "matrix" in live["matrix"] and not {"matrix", "shared-tokens", "shared-slices"} & set(live["unions"])


def test_jaccard_meets_and_opens_groups_in_slices(spark, monkeypatch):
    """Queries that meet groups and the groups opened are shuffled a slice at a time; each pair is found whatever its slice."""
    from logweave.llm import jaccard

    rng, rows = random.Random(19), []
    for family in range(24):
        words = sentence(rng, 70).split()
        for k in range(7):
            changed = list(words)
            for at in rng.sample(range(len(words)), k % 4):
                changed[at] = f"w{family}x{k}x{at}"
            rows.append((100 * family + k, " ".join(changed)))
    # Short sets need all their tokens: a text of four to seven words has one to four shingles.
    rows += [(5000 + k, " ".join(f"s{k % 5}y{i}" for i in range(4 + k % 4))) for k in range(20)]
    counts, write = {}, jaccard.written

    def noted(df, what):
        def parts():
            for part in [df] if isinstance(df, DataFrame) else df:
                counts.setdefault(what, []).append(part.count())
                yield part

        return write(parts(), what)

    monkeypatch.setattr(jaccard, "written", noted)
    for name, value in (("KEYS", 1), ("MET", 0), ("LEAST_MET", 1500), ("ASKED", 0), ("LEAST_ASKED", 40)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs(spark, rows), 3).collect()}
    assert got == brute_components(rows, 4, 85)
    for what in ("hits", "opened-slices"):
        assert len(counts[what]) > 1, counts
    assert sum(n > 0 for n in counts["hits"]) > 1 and max(counts["hits"]) < 0.8 * sum(counts["hits"]), counts


def test_jaccard_does_not_ask_groups_met_by_chance(spark, monkeypatch):
    """Unlike texts with a few shingles in common open no group: such pairs grow with the square of the input."""
    from logweave.llm import jaccard

    monkeypatch.setattr(jaccard, "frequent_tokens", lambda *a: jaccard.np.empty(0, jaccard.np.uint64))
    rng = random.Random(20)
    common = [sentence(random.Random(300 + k), 10) for k in range(12)]
    rows = [(k, f"{sentence(rng, 150)} {common[k % 12]} {sentence(rng, 150)}") for k in range(180)]
    asked, found = [], jaccard.qualifying

    def noted(*a):
        asked.append(found(*a).count())
        return found(*a)

    monkeypatch.setattr(jaccard, "qualifying", noted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs(spark, rows), 3).collect()}
    assert got == brute_components(rows, 4, 85)
    assert asked and asked[0] < 180 * 15 * 0.05, asked


def test_jaccard_on_documents(spark):
    from logweave.llm import jaccard

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op6_jaccard(spark, SF).collect()}
    assert got == brute_components([tuple(r) for r in real(spark).collect()], 4, 85)


# op7


def brute_fingerprint(text, size=128, width=5):
    import xxhash

    words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", text) if w]
    found = set()
    for k in range(max(1, len(words) - width + 1)) if words else ():
        h = 42
        for w in words[k : k + width]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(found)[:size]


def test_fingerprints(spark):
    from logweave.llm import fingerprints as f

    rows = sorted([tuple(r) for r in real(spark, 40).collect()] + [(5000, None), (5001, ""), (5002, "a b c"), (5003, "x " * 20000)])
    got = {r["doc_id"]: r for r in f.fingerprint_documents(docs(spark, rows), 7).collect()}
    assert len(got) == len(rows)
    show = lambda h: "".join(f"{x & (2**64 - 1):016X}" for x in h)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(after)
        assert r["fingerprint"] == show(a) and r["edited_fingerprint"] == show(b)
        for other, name in ((b, "near_edited"), (c, "near_next")):
            union = sorted({*a, *other})[:128]
            assert r[name] == pytest.approx(len({*a} & {*other} & {*union}) / len(union) if union else 1.0)
    assert f.fingerprint_documents(docs(spark, []), 7).count() == 0


def test_fingerprints_of_odd_ids(spark):
    """Null and repeated ids are ordered by text; one bucket, many buckets and an even spread give the same."""
    from logweave.llm import fingerprints as f

    rng = random.Random(17)
    texts = [sentence(rng, 30) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (9, texts[4]), (-3, texts[5])]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    for buckets in (1, 3, 50):
        got = f.fingerprint_documents(docs(spark, rows), buckets).collect()
        assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want), buckets


def test_containment_and_merged_sketches(spark):
    from logweave.llm import fingerprints as f

    rng = random.Random(18)
    words = sentence(rng, 3000).split()
    rows = [(" ".join(words[:600]), " ".join(words)), (" ".join(words), " ".join(words[:600])), ("", " ".join(words)), (" ".join(words[:40]), " ".join(words[:80]))]
    df = spark.createDataFrame(rows, "a string, b string").select(f.sketch(f.words_of(F.col("a"))).alias("a"), f.sketch(f.words_of(F.col("b"))).alias("b"))
    got = [r[0] for r in df.select(f.containment(F.col("a"), F.col("b"))).collect()]
    assert got[0] > 0.8 and 0.1 < got[1] < 0.3 and got[2] == 1.0 and got[3] == 1.0
    # The sketch of the whole is that of its parts' sketches.
    parts = [(1, " ".join(words[k : k + 304])) for k in range(0, 3000, 300)]
    whole = spark.createDataFrame([(" ".join(words),)], "t string").select(f.sketch(f.words_of(F.col("t")))).first()[0]
    merged = f.merge_sketches(spark.createDataFrame(parts, "k int, t string").select("k", f.sketch(f.words_of(F.col("t"))).alias("h")), "k", "h").first()["h"]
    assert merged == whole


def test_sketches_merge(spark):
    from logweave.llm import fingerprints as f

    parts = spark.range(3000).select((F.col("id") % 3).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.xxhash64(F.col("id") + i)).alias("h"))
    got = f.merge_sketches(parts, "k", "h", 64).select("k", f.distinct_shingles(F.col("h"), 64).alias("n"), F.size("h").alias("s")).collect()
    assert all(r["s"] == 64 and 2000 < r["n"] < 4500 for r in got)


# op8


def test_bpe_as_tiktoken(spark):
    import tiktoken
    from logweave.llm import bpe

    content, pattern = bpe.default_vocabulary()
    ranks = bpe.Vocabulary.load(content, pattern).ranks
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = [*EDGE, (20, "a" * 1000 + " " + "xyz" * 400), (21, " " * 700), (22, "<|endoftext|>")] + [(100 + k, "".join(rng.choice("abc é漢\n\t 1!😀ß") for _ in range(rng.randint(0, 90)))) for k in range(200)]
    rows += [tuple(r) for r in real(spark, 60).collect()]
    got = sorted(map(tuple, bpe.encode_documents(docs(spark, rows), content, pattern).collect()), key=str)
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(docs(spark, []), content, pattern).count() == 0


# op9


def test_warc_salvage():
    import io

    from logweave.llm import warc

    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    records = [warc.page_record(k, "http://x/ y", p, hashlib.sha256(p).hexdigest(), None, False) for k, p in enumerate(payloads)]
    for packed in (True, False):
        parts = [warc.gzip_member(r) if packed else r for r in records]
        whole = list(warc.salvage(io.BytesIO(b"".join(parts))))
        assert [x[4] for x in whole] == payloads and all(x[0] == "record" for x in whole)
        broken = [*parts]
        middle = len(parts[4]) // 2
        broken[4] = parts[4][:middle] + b"\0\1\2" + parts[4][middle + 3 :]
        broken[7] = b"junk" + parts[7]
        broken[11] = parts[11][:-9]
        data = b"".join(broken)
        found = list(warc.salvage(io.BytesIO(data)))
        got = [x[4] for x in found if x[0] == "record"]
        assert [p for k, p in enumerate(payloads) if k not in (4, 11)] == got
        gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
        assert sum(x[2] for x in found) == len(data) and len(gaps) == 3
    assert list(warc.salvage(io.BytesIO(b""))) == []


def test_warc_wrong_lengths_and_many_damages():
    import io
    import time

    from logweave.llm import warc

    record = lambda k: warc.page_record(k, "u", b"page %d" % k, hashlib.sha256(b"page %d" % k).hexdigest(), None, False)

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            got = super().read(n)
            self.most = max(self.most, len(got))
            return got

    for length in (b"999999999999", b"5", b"-1", b"x", b"7" * 40):
        records = [record(k) for k in range(300)]
        records[0] = re.sub(rb"Content-Length: \d+", b"Content-Length: " + length, records[0])
        stream = Counted(b"".join(records))
        found = list(warc.salvage(stream))
        assert [x[4] for x in found if x[0] == "record"] == [b"page %d" % k for k in range(1, 300)]
        assert [x[1:3] for x in found if x[0] == "gap"] == [(0, len(records[0]))] and stream.most <= warc.BLOCK
    spent = []
    for n in (4000, 16000):  # time grows with the file, not with its square
        data = b"".join(re.sub(rb"Content-Length: \d+", b"Content-Length: 99999999", record(k)) if k % 2 else record(k) for k in range(n)) + b"WARC/1.0\r\n" * n
        start = time.process_time()
        assert sum(x[0] == "record" for x in warc.salvage(io.BytesIO(data))) == n // 2
        spent.append(time.process_time() - start)
    assert spent[1] < 10 * spent[0] + 0.5


def test_warc_pages(spark, tmp_path):
    from logweave.llm import warc

    big, small = "<p>é</p>" * 40, "tiny"
    rows = [(3, "u", big), (1, "u", big), (2, "u", small), (4, "u", small), (5, None, None), (6, "u", big + "x"), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w", file_bytes=300)
    found = {r["page_id"]: r for r in warc.read_archives(manifest, 3).where("kind = 'record'").collect()}
    assert len(found) == 7 and {i for i, r in found.items() if r["record_type"] == "revisit"} == {3, None}
    assert found[3]["refers_to"] == 1 and found[3]["payload_bytes"] == len(big.encode()) and found[3]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert found[5]["payload_bytes"] == 0
    import gzip

    texts = [gzip.decompress(f.read_bytes()) for f in tmp_path.glob("w/*.warc.gz")]  # any reader of gzip sees records
    assert all(t.startswith(b"WARC/1.1\r\n") for t in texts) and sum(t.count(b"WARC-Record-ID") for t in texts) == 7
    empty = warc.write_archives(warc.with_revisits(pages.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archives(empty, 1).count() == 0


def test_warc_long_urls(spark, tmp_path):
    import io

    from logweave.llm import warc

    long = "http://x/" + "é" * 900_000
    record = warc.page_record(1, long, b"page", hashlib.sha256(b"page").hexdigest(), None, False)
    for data in (warc.gzip_member(record), record, record + record):
        assert {(x[0], x[3]["warc-target-uri"], x[4]) for x in warc.salvage(io.BytesIO(data))} == {("record", long, b"page")}
    torn = b"WARC/1.1\r\n" + b"x" * 3_000_000
    assert [x[:3] for x in warc.salvage(io.BytesIO(torn))] == [("gap", 0, len(torn))]
    pages = spark.createDataFrame([(1, long, "<p>a"), (2, "u" * 66_000, None), (3, "u", "<p>b")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in warc.op9_warc(spark, str(tmp_path)).collect()) == [1, 2, 3]
    manifest = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="records read"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1), 1, whole=True).collect()


# op10


def test_blocks():
    from logweave.llm.html_text import blocks

    page = "<body>a <b>b</b>\n c<p>one<br>two<p>three &amp; &lt;<ul><li>x<li>y</ul><script>if (a<b) '<p>'</script><!-- <p>no --><div>d<div>e</div>f</div><p>last"
    assert [t for _, t, _ in blocks(page)] == ["a b c", "one two", "three & <", "x", "y", "d", "e", "f", "last"]
    assert blocks("") == [] and blocks("<<<>") and blocks("<p") is not None


def test_open_heads():
    from logweave.llm.html_text import blocks

    head, body = "<html><head><meta charset=utf-8><title>t</title><style>p {}</style>\n<link rel=x>", "<article><p>one<p>two</article>"
    want = [("one",), ("two",)]
    for page in (head + "</head><body>" + body, head + "<body>" + body, head + body, "<head>" + body, head + "<noframes>n<body>" + body):
        assert [b[1:2] for b in blocks(page)] == want, page
    assert [b[1] for b in blocks(head + "some text<p>one")] == ["some text", "one"]
    assert [b[0] for b in blocks(head + "<body>" + body)] == [b[0] for b in blocks(head + "</head><body>" + body)]


def test_lstm_slopes():
    from logweave.llm import html_text as h

    rng = np.random.default_rng(1)
    model = h.Labeller(3, 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.normal(size=(2, 4, h.DIM)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    y = rng.integers(0, 2, (2, 4)).astype(float)
    run = model._run
    model._run = lambda *a: tuple(z.astype(np.float64) if isinstance(z, np.ndarray) else z for z in run(*a))
    _, g = model.slopes(x, mask, y)
    for name, place in (("hf", (1, 5)), ("xb", (7, 2)), ("cf", (4,)), ("ob", (1,)), ("ox", (3,))):
        at = model.p[name][place]
        losses = []
        for step in (1e-2, -1e-2):
            model.p[name][place] = at + step
            losses.append(model.slopes(x, mask, y)[0])
        model.p[name][place] = at
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[name][place], rel=0.08, abs=2e-3)


def test_extraction(spark):
    from logweave.llm import html_text as h

    model = h.trained()
    held = h.examples(200, 123)
    right = sum(int(((model.probabilities(*h.padded([v]))[0] >= 0.5) == (y > 0)).sum()) for v, y in held)
    assert right / sum(len(y) for _, y in held) > 0.95
    page = '<nav><a href=/>Home</a></nav><div class="cookie">We use cookies.</div><article><h1>Title here</h1><p>First  text &amp; more.<p>Second text follows here.</article><section class="comments"><p>Nice post, thanks a lot.</p></section><footer>&copy; us</footer>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<nav><a>x</a></nav>")]
    got = {r["page_id"]: r for r in h.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string"), model).collect()}
    assert got[1]["text"] == "Title here\n\nFirst text & more.\n\nSecond text follows here." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    truth = lambda p: "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " " * ("<br>" in b), b)).split()) for b in re.split(r"</?(?:p|h1|article)>", p[p.index("<article>") : p.index("</article>")])) if x)
    real_pages = [r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    texts = h.main_texts([r["html"] for r in real_pages], model)
    assert np.mean([a == truth(r["html"]) for a, r in zip(texts, real_pages)]) > 0.9


def prose(rng, lo=12, hi=40):
    words = "the river ran past old houses where people kept small gardens while children played near a bridge that had stood for many years before rain came over hills".split()
    return " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi))).capitalize() + "."


def layouts(rng):
    """(name, page, main text) of pages of unlike build, none made by synthetic_page."""
    title, parts = prose(rng, 4, 8), [prose(rng) for _ in range(6)]
    links = lambda n: "".join(f'<li><a href="/{k}">{rng.choice(["Home", "News", "About", "Contact", "Archive", "Shop", "Help"])}</a></li>' for k in range(n))
    comments = "".join(f'<div class="comment"><span class="author">{rng.choice(["Ann", "Bo", "Cy"])}</span><p>{prose(rng)}</p></div>' for _ in range(3))
    whole = "\n\n".join([title, *parts])
    yield "semantic", f"<!doctype html><html><head><title>{title}</title></head><body><header><a href=/>Site</a><nav><ul>{links(5)}</ul></nav></header><main><article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in parts)}</article></main><aside><h3>Related</h3><ul>{links(4)}</ul></aside><footer>&copy; 2024 Site</footer></body></html>", whole
    yield "named divs", f'<html><head><title>x</title><body><div id="wrapper"><div class="navbar"><ul>{links(6)}</ul></div><div class="cookie-banner">We use cookies to improve your experience. <button>Accept</button></div><div class="post-content"><h1>{title}</h1>{"".join(f"<p>{p}" for p in parts)}</div><div class="sidebar"><h3>Popular</h3><ul>{links(5)}</ul></div><div class="comments"><h3>Comments</h3>{comments}</div><div class="site-footer"><p>All rights reserved. <a href=/terms>Terms</a></p></div></div>', whole
    yield "open tags", f"<title>x</title><nav><ul>{links(4).replace('</li>', '')}</ul></nav><article><h1>{title}</h1>{''.join(f'<p>{p}' for p in parts)}</article><footer>Imprint", whole
    yield "lists and quotes", f"<body><header><h2>The Site</h2></header><main><h1>{title}</h1><p>{parts[0]}<ul><li>{parts[1]}<li>{parts[2]}</ul><blockquote>{parts[3]}</blockquote><div class='ad'>Advertisement. Buy now and save.</div><p>{parts[4]}<p>{parts[5]}</main><form><label>Email</label><input><button>Subscribe</button></form><footer>Contact us</footer>", whole
    yield "section in wrappers", f'<html><body><div class="page"><div class="container"><div class="menu"><a href=/>Home</a> <a href=/n>News</a> <a href=/a>About</a></div><section class="article-body"><h2>{title}</h2>{"".join(f"<p>{p}</p>" for p in parts[:3])}<aside class="related"><h4>Read more</h4><ul>{links(3)}</ul></aside>{"".join(f"<p>{p}</p>" for p in parts[3:])}</section><section id="comments"><h4>Replies</h4>{comments}</section></div></div><footer>Powered by words</footer></body></html>', whole


def test_unlike_layouts():
    from logweave.llm import html_text as h

    rng, model, right = random.Random(31), h.trained(), defaultdict(list)
    for _ in range(40):
        for name, page, want in layouts(rng):
            right[name].append(h.main_texts([page], model)[0] == want)
    shares = {name: float(np.mean(x)) for name, x in right.items()}
    assert len(shares) == 5 and min(shares.values()) >= 0.8, shares


def test_deep_and_long_pages():
    import time

    from logweave.llm import html_text as h

    for piece in ("<div>x", "<b>x", "<div class=a>x</p>", "<svg>", "<p class='x'>y</div>", "</p>", "<li>z", "<!"):
        spent = []
        for n in (10_000, 40_000):
            start = time.process_time()
            h.blocks(piece * n)
            spent.append(time.process_time() - start)
        assert spent[1] < 12 * spent[0] + 0.5, piece  # in proportion to the length, not to its square
    page = "<article>" + "".join(f"<p>words of block {k} here.</p><div class='ad{k % 7}'>buy now</div>" for k in range(600)) + "</article>"
    model, cut = h.trained(), h.blocks(page)
    whole = model.probabilities(*h.padded([h.vectors(cut)]))[0]
    assert np.allclose(model.long_page(cut, 100), whole, atol=1e-4) and np.allclose(model.long_page(cut, 5000), whole, atol=1e-4)


def test_extraction_edges(spark):
    from logweave.llm import html_text as h

    page = next(p for name, p, _ in layouts(random.Random(1)) if name == "semantic")
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", "<article><p>" + "word " * 300_000)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = h.extract(df, h.trained()).collect()
    assert len(got) == 4 and len({r["text"] for r in got if r["page_id"] != 2}) == 1 and h.extract(df.limit(0), h.trained()).count() == 0
    assert next(r["n_chars"] for r in got if r["page_id"] == 2) in (0, 1_499_999)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from logweave.llm import bpe, suffixes

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    before = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    near = stage["near_duplicates"](spark, before, SF)
    assert near.columns == before.columns
    want = {i for i, (n, c) in brute_components([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80).items() if c == i}
    assert {r["doc_id"] for r in near.collect()} == want
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < before.count() and set(out[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage over nulls, empty texts, repeated rows, one doc_id on unlike texts, clashing columns, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(21)
    a, b, item, passage = sentence(rng, 40), sentence(rng, 45), sentence(rng, 20), sentence(rng, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None), (2, ""), (2, ""), (3, a), (3, b), (4, a), (4, item + " " + sentence(rng, 30)), (5, b), (5, b), (None, None)]
    rows += [(6, sentence(rng, 70) + " " + passage), (7, sentence(rng, 70)), (7, passage + " " + sentence(rng, 70))]
    stage = dict(corpus_pipeline.STAGES)
    odd = docs(spark, rows)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = {
        "quality": rows,  # without labels nothing is rejected
        "near_duplicates": [r for r in rows if r not in ((4, a), (5, b))],
        "repeated_passages": [r if r != rows[-1] else (7, rows[-1][1].removeprefix(passage).strip()) for r in rows],
        "decontamination": [r for r in rows if not (r[1] or "").startswith(item)],
    }
    for name, kept in want.items():
        got = stage[name](spark, odd, str(tmp_path))
        assert got.columns == odd.columns
        assert texts(got) == sorted(kept, key=str), name
        assert stage[name](spark, docs(spark, []), str(tmp_path)).count() == 0
    tokens = {(r["doc_id"], r["n_tokens"]) for r in stage["tokens"](spark, odd, str(tmp_path)).collect()}
    assert {(1, 0), (2, 0), (None, 0)} <= tokens and stage["tokens"](spark, odd, str(tmp_path)).count() == len(rows)
    assert stage["tokens"](spark, docs(spark, []), str(tmp_path)).count() == 0
