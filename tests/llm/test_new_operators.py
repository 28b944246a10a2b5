"""Packing, hard negatives and collocations against brute force, on small, odd and empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import public_tokenizers
from tests.llm.test_odd_tables import LONG, TEXTS

from tessera.llm import byte_tokens, collocations, hard_negatives, packing
from tessera.llm.token_files import tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, length long, item long, part long, n long, block long, words string"


def docs_of(spark, texts, langs=("en", "fr", None)):
    rows = [(i if i % 11 else None if i == 11 else i, t, langs[i % len(langs)], 1, 2, 3, 4, 5, "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# ---- byte tokens


def test_byte_tokens_equal_the_library():
    rng = np.random.default_rng(0)
    parts = ["a", "Bc", "don't", "'s", "é", "日本", "12", "naïve,", "\n", "\n\n", " ", "  ", "\t", "\r\n", ".", '"', "!?", "<|endoftext|>", "<|", "\xa0", " ", "ß", "--", "_", "²", "\x1c", "\0", "\U0001f600", "word" * 20 + "!"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)] + [t or "" for t in TEXTS] + ["\n", " a", "a ", "\na", "a\n", "a\n\n", "\n\na"]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer(BYTES).encode_batch(texts, add_special_tokens=False)]
    for size in (1, 500, len(texts)):
        assert [x for at in range(0, len(texts), size) for x in byte_tokens.encode(texts[at : at + size], BYTES)] == want
    assert byte_tokens.encode([None], BYTES) == [b""]


# ---- packing


def least_bins(lengths, capacity):
    """By trying all ways, longest pieces first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[k]:
                left = list(rooms)
                left.remove(r)
                place(k + 1, [*left, r - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_least():
    rng, tight = np.random.default_rng(1), 0
    for _ in range(150):
        lengths = rng.integers(1, 21, rng.integers(1, 9)) if rng.random() < 0.5 else rng.integers(6, 15, rng.integers(1, 9))
        least, bound = least_bins(lengths.tolist(), 20), packing.bound(np.bincount(lengths, minlength=21), 20)
        assert -(-lengths.sum() // 20) <= bound <= least
        tight += bound == least
    assert tight > 120 and packing.bound(np.zeros(21, int), 20) == 0
    # Three pieces of just over a third, or pieces over half: sums alone don't see these.
    assert packing.bound(np.bincount([11] * 4, minlength=21), 20) == 4 and packing.bound(np.bincount([7] * 6, minlength=21), 20) == 3


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 50, 200)
        where, place, fill = packing.best_fit(lengths, 64)
        rooms = []
        for size in sorted(lengths.tolist(), reverse=True):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 64) - size)
        assert sorted(64 - fill) == sorted(rooms)
        for b in range(len(fill)):
            own = sorted(zip(place[where == b], lengths[where == b], strict=True))
            assert [p for p, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()


def test_exchange_helps_and_is_whole(spark):
    rng = np.random.default_rng(3)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(200, 700, 3000))]
    df = spark.createDataFrame(items, "item long, length long")
    placed = packing.pack(df, per_part=300).toPandas()
    assert sorted(zip(placed.item, placed.length, strict=True)) == items
    alone = packing.pack(df, per_part=10_000).toPandas().sequence_id.nunique()
    first = sum(len(packing.best_fit(g.length.to_numpy())[2]) for _, g in df.select("*", F.pmod(F.xxhash64("item", F.lit(0)), F.lit(10)).alias("part")).toPandas().groupby("part"))
    assert alone <= placed.sequence_id.nunique() <= first
    assert placed.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(df.limit(0)).count() == 0


def checked_packing(rows, got, capacity=1024):
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer(BYTES).encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or min(len(ids), capacity)
        for k, (a, b) in enumerate([(0, first), *[(x, x + capacity) for x in range(first, len(ids), capacity)]]):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    rng = np.random.default_rng(4)
    texts = [*TEXTS, *TEXTS[4:7], *(" ".join(rng.choice(["alpha", "beta,", "Gamma.", "delta\n"], rng.integers(1, 900))) for _ in range(120))]
    docs = docs_of(spark, texts)
    placed = packing.packed(docs, BYTES, per_part=50, with_ids=True)
    rows = placed.collect()
    n = checked_packing([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert n <= 1.03 * sum(r.length for r in rows) / 1024 + 2
    for s in packing.sequences(placed).collect():
        own = sorted((r.offset, bytes(r.ids)) for r in rows if r.sequence_id == s.sequence_id)
        assert bytes(s.ids) == b"".join(x for _, x in own) and s.n_tokens == len(s.ids) // 2
    assert packing.packed(docs.limit(0), BYTES).count() == 0


# ---- hard negatives


def brute_negatives(rows, anchors, k=5, m=5):
    """rows: (id, label, vector), all fit and of one id each."""
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = set()
    for a in anchors:
        label, v = q[a]
        ranked = sorted((-dot(v, w), i, other) for i, (other, w) in q.items() if i != a)
        for score, p, _ in [r for r in ranked if r[2] == label][:k]:
            close = [(i, -s) for s, i, other in ranked if other != label and 80 * -score <= 100 * -s <= 100 * -score][:m]
            out |= {(a, p, n + 1, i, max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, -score)), max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, s))) for n, (i, s) in enumerate(close)}
    return out


def negatives_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("own") for c in ("id", "vector", "tops", "slot", "score")}).repartition(3)
    got = hard_negatives.hard_negatives(hard_negatives.valid_rows(df), F.col("id") % 10 == 0).collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e30])
def test_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), (scale * rng.normal(0.2, 0.3, 6)).tolist()) for i in range(90)]
    rows += [(-10, 1, rows[3][2]), (100, 1, rows[3][2]), (101, 2, rows[3][2]), (102, 0, rows[3][2]), (103, 1, [0.0] * 6), (110, 2, []), (120, 0, [scale])]
    padded = [(i, label, [*v, *[0.0] * (6 - len(v))]) for i, label, v in rows]
    assert negatives_of(spark, rows) == brute_negatives(padded, [i for i, *_ in rows if i % 10 == 0])


def test_negatives_of_odd_rows(spark):
    fit = [(i, i % 2, [1.0 + i / 100, 0.5]) for i in range(30)]
    odd = [(None, 1, [1.0, 1.0]), (200, None, [1.0, 1.0]), (210, 1, None), (220, 1, [1.0, None]), (230, 0, [float("nan"), 1.0]), (240, 0, [float("inf"), 1.0])]
    twice = [fit[4], fit[4], (20, 7, [9.0, 9.0])]  # a repeated row, and one more of the same id
    assert negatives_of(spark, fit + odd + twice) == brute_negatives(fit, [0, 10, 20])
    assert negatives_of(spark, fit[1:9]) == set()  # no anchors
    assert negatives_of(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == set()  # no negatives
    assert negatives_of(spark, []) == set()


def test_blocks_of_anchors_go_to_groups_and_are_never_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, [1.0, float(i % 7)]) for i in range(240)], "id long, label long, vector array<double>").repartition(60)  # a block for each
    blocks = hard_negatives.settle(hard_negatives.blocks_of(rows), "test-blocks")
    anchors = hard_negatives.settle(hard_negatives.blocks_of(rows.where("id % 10 = 0").repartition(6)), "test-anchors")
    n = hard_negatives.groups(blocks, 2)
    assert n == 2 * hard_negatives.SPREAD and (blocks.count(), anchors.count()) == (60, 6)
    met = hard_negatives._met(anchors, blocks, n, 2)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert met.count() == met.select("a.slot", "b.ids").distinct().count() == 6 * blocks.count() and met.select("at").distinct().count() <= n
    monkeypatch.setattr(hard_negatives, "GROUP", 64)
    assert hard_negatives.groups(blocks, 2) == 30  # 240 rows of 8 bytes


def test_keys_sort():
    keys = [(a, s, k, i) for a, s, k, i in product((-5, 0, 7), (-(1 << 80), -1, 0, 3, 1 << 80), (0, 1), (-2, 9))]
    assert all(hard_negatives.unkey(hard_negatives.key(*x)) == x for x in keys)
    assert sorted(keys, key=lambda x: hard_negatives.key(*x)) == sorted(keys, key=lambda x: (x[0], -x[1], x[2], x[3]))


def test_negatives_take_label_shifts(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 10)), rng.normal(0.3, 0.2, 4).tolist()) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.array(v, np.float32).astype(float).tolist()) for i, label, v in rows]
    got = hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert set(map(tuple, got)) == brute_negatives(moved, [0, 100, 200, 300]) and len(got) > 20


# ---- collocations


def brute_phrases(rows, least=10, kept=2000):
    grams, total, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", folded):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und" if lang is not None else "und"] += len(w)
            for k in (1, 2, 3):
                grams["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in grams.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(len(x) > len(g) and 100 * b >= 50 * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(rows)[:kept])]
    return sorted(out)


def phrases_of(docs, **sizes):
    got = collocations.collocations(docs, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def word_texts(n, seed=7):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "new", "york", "city", "Ünit", "日本", "x'y", "\x1c", "a\xa0b", "und", *[f"w{k}" for k in range(12)]]
    weights = 1 / np.arange(1, len(words) + 1)
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", ":"]
    return ["".join(w + rng.choice(marks) for w in rng.choice(words, rng.integers(0, 80), p=weights / weights.sum())) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"hot": 5, "limit": 50, "part_words": 200, "burst": 6, "chunk": 64, "block_words": 300}])
def test_phrases(spark, sizes):
    """In one piece; and with small blocks, containers that burst, tries that spill, hot prefixes and many parts."""
    texts = [*word_texts(150), *TEXTS, *TEXTS[4:7], "new york city " * 40, None]
    docs = docs_of(spark, texts)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert phrases_of(docs, **sizes) == brute_phrases(rows)
    assert phrases_of(docs, least=3, kept=7, **sizes) == brute_phrases(rows, 3, 7)


def test_phrases_of_nothing(spark):
    docs = docs_of(spark, [None, "", "one two", "...", LONG])
    assert phrases_of(docs) == [] and phrases_of(docs.limit(0)) == []


def test_trie_bursts():
    trie = collocations.HatTrie(30, burst=20)
    assert list(trie.add(np.full(200, 3), np.arange(200))) == [] and isinstance(trie.top[3], collocations.Branch)
    assert list(trie.add(np.array([3, 3, 4]), np.array([7, 7, 8]))) == []
    first, rest, n = trie.spill()
    assert len(first) == 201 and n.sum() == 203 and n[7] == 3 and rest[:3].tolist() == [0, 1, 2]


def test_trie_counts_everything():
    rng = np.random.default_rng(8)
    first, rest = rng.zipf(1.3, 5000) % 40 + 1, rng.integers(0, 900, 5000)
    trie, seen = collocations.HatTrie(30, burst=20, limit=300), Counter()
    runs = []
    for at in range(0, 5000, 500):
        runs += list(trie.add(first[at : at + 500], rest[at : at + 500]))
        assert sum(trie.sizes.values()) <= 300
    runs.append(trie.spill())
    for a, b, n in runs:
        assert list(zip(a, b)) == sorted(set(zip(a, b)))  # noqa: B905
        seen.update(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())))  # noqa: B905
    assert seen == Counter(zip(first.tolist(), rest.tolist())) and len(runs) > 2  # noqa: B905


def test_scores_are_exact(spark):
    big = [(999_999_999_989, 1_000_000_000_039, 999_999_999_999), (10, 10, 10), (10, 4_000_000_000, 3_000_000_000)]
    df = spark.createDataFrame(big, "a long, l long, r long").select("*", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert {(r.a, r.s) for r in df.collect() if r.l < 10**12} | {(r.a, r.s) for r in df.collect()} == {(a, 1_000_000 * a * a // (x * y)) for a, x, y in big}
