"""The pipeline's near-duplicate stage: near copies go, and no similar pair is lost."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from tessera.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_words(rng, n):
    return ["".join(rng.choices("aeinrst", k=rng.randint(3, 8))) for _ in range(n)]


def test_edited_copies_go(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        w = some_words(rng, 120)
        rows.append((i, " ".join(w), "en", "a", 0))
        for k in range(1, 4):  # one, two and three words changed, Jaccard .92 and less
            e = list(w)
            for j in range(k):
                e[10 + 35 * j] = f"edit{i}x{k}"
            rows.append((100 * k + i, " ".join(e), "en", "a", 0))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (None, "of no id", "en", "a", 0), (1002, "Of  no id", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    # Two changed words leave 106 of 126 shingles (.84); three leave 101 of 131 (.77) with any of the others.
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), *range(300, 340), 1000, 1002]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("crowd", (16, 2))
def test_no_similar_pair_is_lost(spark, crowd):
    rng = random.Random(2)
    shared, rows = some_words(rng, 25), []
    for _ in range(12):
        w = some_words(rng, 60)
        for _ in range(10):
            e = list(w)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                e[rng.randrange(60)] = some_words(rng, 1)[0]
            rows.append((len(rows), " ".join([*e, *(shared if rng.random() < 0.5 else [])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = [set(near_copies.shingles(t).tolist()) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[find(i)] = find(j)

    def groups(pairs):
        out = {}
        for x, label in pairs:
            out.setdefault(label, []).append(x)
        return sorted(map(sorted, out.values()))

    assert groups((r.doc_id, r.label) for r in near_copies.classes(docs, crowd).collect()) == groups((i, find(i)) for i in range(len(rows)))


def test_a_shared_line_costs_no_pairs_of_all(spark, monkeypatch):
    """Texts that share one line, which the sample of common shingles misses: pairs grow with the texts, not with their square; copies among them are found."""
    import numpy as np

    rng, pairs = random.Random(3), []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_common", lambda docs: np.empty(0, np.int64))
    monkeypatch.setattr(near_copies, "_similar", lambda docs, rows, p: pairs.append(p.distinct().count()) or similar(docs, rows, p))
    line, counts = some_words(rng, 20), []
    for n in (100, 200, 400):
        texts = [" ".join([*some_words(rng, 60), *line]) for _ in range(n)]
        texts += [t.replace(t.split()[5], "changed", 1) for t in texts[:10]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        pairs.clear()
        labels = {r.doc_id: r.label for r in near_copies.classes(docs).collect()}
        counts.append(sum(pairs))
        assert len(set(labels.values())) == n and all(labels[i] == labels[n + i] for i in range(10))
    assert counts[2] <= 3 * counts[1] <= 9 * counts[0] and counts[2] < 20 * 400


def test_prefixes_of_another_order(spark):
    import numpy as np

    texts = [("a b c d e f g h i j", 1), ("a b c d e f g h i k", 2), ("x y z a b c d e", 3), ("", 4)]
    sets = {i: set(near_copies.shingles(t).tolist()) for t, i in texts}
    late = sorted(set.union(*sets.values()))[:4]
    got = {i: set() for i in sets}
    for r in near_copies.reordered(spark.createDataFrame([(i, t) for t, i in texts], "set_id long, text string"), np.array(late)).collect():
        got[r.set_id].add(r.shingle)
        assert r.n == len(sets[r.set_id])
    for i, own in sets.items():
        assert got[i] == set(sorted(own, key=lambda s: (s in late, s))[: len(own) - -(-4 * len(own) // 5) + 1 if own else 0])


def test_pairs_that_share_too_little_are_no_candidates(spark, monkeypatch):
    """Texts that share a line of a tenth of their shingles, in crowds too small for heads: the line stands in their prefixes, but no pair is checked."""
    import numpy as np

    rng, pairs = random.Random(4), []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_common", lambda docs: np.empty(0, np.int64))
    monkeypatch.setattr(near_copies, "_similar", lambda docs, rows, p: pairs.append(p.distinct().count()) or similar(docs, rows, p))
    lines = [some_words(rng, 14) for _ in range(10)]
    texts = [" ".join([*some_words(rng, 120), *line]) for line in lines for _ in range(12)]
    texts += [t.replace(t.split()[60], "changed", 1) for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: r.label for r in near_copies.classes(docs).collect()}
    assert len(set(labels.values())) == 120 and all(labels[i] == labels[120 + i] for i in range(10))
    assert sum(pairs) <= 20


def test_least_shared(spark):
    """Any two sets of similarity 0.8 or more share so many shingles of their prefixes, whatever is common."""
    import numpy as np

    rng, found = random.Random(5), []
    for _ in range(400):
        both, one, other = (rng.randrange(1, 60), rng.randrange(8), rng.randrange(8))
        if 5 * both < 4 * (both + one + other):
            continue
        every = np.array(rng.sample(range(1000), both + one + other), np.int64)
        a, b = every[: both + one], np.concatenate([every[:both], every[both + one :]])
        common = np.sort(np.array(rng.sample(range(1000), 300), np.int64))
        found.append((len(a), len(b), len(np.intersect1d(near_copies.prefix(a, common), near_copies.prefix(b, common)))))
    assert len(found) > 50
    t = spark.createDataFrame(found, "n long, m long, c long")
    assert not t.where(t["c"] < near_copies.least_shared(t["n"], t["m"])).count()
    assert t.where(near_copies.least_shared(t["n"], t["m"]) > 1).count()


def test_similar_sets_share_a_box():
    """Any two sets of similarity 0.8 or more have as many boxes of their prefixes in common as the lengths say, in some class of sizes, whatever is late."""
    import numpy as np

    rng, found = random.Random(6), 0
    for _ in range(1500):
        both, one, other = (rng.randrange(1, rng.choice((8, 60, 700))), rng.randrange(12), rng.randrange(12))
        if one + other == 0 or 5 * both < 4 * (both + one + other):
            continue
        every = np.array([rng.randrange(-(2**63), 2**63) for _ in range(both + one + other)], np.int64)
        a, b = every[: both + one], np.concatenate([every[:both], every[both + one :]])
        late = every[[rng.random() < 0.3 for _ in every]]
        late = np.sort(np.concatenate([late, *[k[:3] for _, k in near_copies.boxes(a, late)[:1]]]))
        x, y = near_copies.boxes(a, late), near_copies.boxes(b, late)
        assert all(len(keys) == length == len(set(keys.tolist())) for length, keys in x + y)
        assert any(len(np.intersect1d(k, m)) >= max(1, min(p, q) - (len(a) + len(b)) // 9) for p, k in x for q, m in y)
        found += 1
    assert found > 300
    assert all(near_copies.boxes(every[:n], late) == [] for n in (0, 1, 2, 3))


def test_a_shared_passage_costs_no_pairs_of_all(spark, monkeypatch):
    """Texts of which three fifths are one passage: pairs grow with the texts, not with their square."""
    import numpy as np

    rng, pairs = random.Random(7), []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_common", lambda docs: np.empty(0, np.int64))
    monkeypatch.setattr(near_copies, "_similar", lambda docs, rows, p: pairs.append(p.distinct().count()) or similar(docs, rows, p))
    passage = some_words(rng, 76)
    texts = [" ".join([*some_words(rng, 44), *passage]) for _ in range(300)]
    texts += [t.replace(t.split()[5], "changed", 1) for t in texts[:10]]
    labels = {r.doc_id: r.label for r in near_copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(labels.values())) == 300 and all(labels[i] == labels[300 + i] for i in range(10))
    assert sum(pairs) < 30 * 300


def test_the_ring_comes_first(spark, monkeypatch):
    """Sets whose fingerprints op10's ring finds within two bits are the first candidates; what they join isn't checked again."""
    rng, pairs = random.Random(8), []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda docs, rows, p: pairs.append({tuple(sorted((r.a, r.b))) for r in p.collect()}) or similar(docs, rows, p))
    texts = [some_words(rng, 1500) for _ in range(10)]
    texts = [" ".join(w) for w in texts] + [" ".join([*w[:700], "changed", *w[701:]]) for w in texts]
    near = [near_copies.simhash.fingerprint(texts[i]) ^ near_copies.simhash.fingerprint(texts[10 + i]) for i in range(10)]
    within = [i for i in range(10) if near[i].bit_count() <= 2]
    labels = {r.doc_id: r.label for r in near_copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(labels[i] == labels[10 + i] for i in range(10)) and len(set(labels.values())) == 10
    assert len(pairs[0]) == len(within) > 0 and not any(pairs[0] & p for p in pairs[1:])


def test_sketches_tell_unlike_sets(spark):
    """The sketches of similar sets never part them; those of sets that share some two thirds nearly always do."""
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows = random.Random(9), []
    for i in range(600):
        both = rng.randrange(1, 300)
        one, other = ((rng.randrange(both // 8 + 1), rng.randrange(both // 8 + 1)) if i % 2 else (both // 4 + 20, both // 4 + 20))
        every = np.array([rng.randrange(-(2**63), 2**63) for _ in range(both + one + other)], np.int64)
        a, b = every[: both + one], np.concatenate([every[:both], every[both + one :]])
        similar = 5 * both >= 4 * (both + one + other)
        rows.append((len(a), len(b), near_copies.sketch(a).tolist(), near_copies.sketch(b).tolist(), similar))
    t = spark.createDataFrame(rows, "n_a long, n_b long, sketch_a array<long>, sketch_b array<long>, similar boolean")
    n = {(r.similar, r.alike): r["count"] for r in t.withColumn("alike", near_copies._alike()).groupBy("similar", "alike").agg(F.count(F.lit(1)).alias("count")).collect()}
    assert n[True, True] > 200 and (True, False) not in n and n[False, False] > 280


def test_texts_mostly_of_one_passage_arent_read_pair_by_pair(spark, monkeypatch):
    """Texts that are to seven tenths one passage, and no near copies, in one crowd at the end: their sketches part them, the texts of similar ones alone are read."""
    from pyspark.sql import functions as F

    rng, pairs = random.Random(10), []
    settled = near_copies.settle
    passage = some_words(rng, 100)
    texts = [" ".join([*some_words(rng, 20), *passage]) for _ in range(60)]
    texts += [texts[0].replace(texts[0].split()[5], "changed", 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = settled(near_copies.with_sets(docs))
    one = F.lit(1).cast("long")
    mixed = settled(rows.select("set_id", "n", one.alias("length"), one.alias("shingle"), F.lit(61).cast("long").alias("k"), one.alias("m"), F.col("set_id").alias("part")))

    def settle(df, what="table"):
        out = settled(df, what)
        if what == "near-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "settle", settle)
    parts = near_copies._finish(docs, rows, mixed, settled(spark.createDataFrame([], "set_id long, part long")))
    same = {r.set_id for r in rows.where("doc_id IN (0, 60)").collect()}
    assert {(r.set_id, r.part) for r in parts.collect()} == {(s, min(same)) for s in same}
    assert 1 <= sum(pairs) <= 3
