"""Operators on text against brute force, round trips and held-out rows; nulls, empty and long texts, repeats, empty tables, other columns."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import html_text, mixing, pieces, piecewise, pii, quality_model, quality_rules, simhash, token_files, toxicity
from tessera.llm.common import scratch
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin int, key string, size string, label string"


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("aeinrst", k=rng.randint(2, 7))) for _ in range(300)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 200))) for _ in range(60)]
    out += [out[0], out[0] + " more", out[1].replace(" ", "\n", 5), "", " ", None, "one", "one two", "Éé ß 日本語 \U0001f600 x́\tTAB\x0bVT", "a" * 500, "x y z " * 400, "line one two three\n" * 3 + out[2], "### $$$ %%% &&& *** <<< >>> ||| " * 20]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3 if i % 2 else 0], None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "of no id at all", "en", "a", 15)]
    return spark.createDataFrame([(*r, 1, "k", "s", "l") for r in rows], SCHEMA).repartition(5)


def local(df):
    return [r.asDict() for r in df.collect()]


def words(t):
    return WORD.findall(t or "")


# --- pieces


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encoded(docs, path).join(docs.select(F.col("doc_id").alias("d"), "text").dropDuplicates(["d", "text"]), F.col("doc_id").eqNullSafe(F.col("d")))
    rows = got.collect()
    assert len(rows) >= docs.select("doc_id").distinct().count()
    for r in rows:
        assert list(r.ids) == sp.encode(r.text or ""), r.text
        assert r.decodes and r.n_pieces == len(r.ids)
        # Only chunks longer than the lattice takes come from the library.
        assert r.n_library == sum(len(c) > pieces.LONGEST for c in pieces.chunks(r.text or "", pieces.model(path)))
    back = pieces.decoded(got.select("doc_id", "ids", "text"), path)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in rows)


def test_lattice_gives_the_library_s_ids(spark):
    """The relational lattice alone, without the library in its way."""
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(4)
    m = pieces.model(path)
    some = {w for t in texts() for w in pieces.chunks(t or "", m) if len(w) <= pieces.LONGEST}
    some |= {pieces.MARK + "".join(rng.choices(["er", "th", "ing", "é", "日", "tion", "a", "s", "\U0001f600", "-"], k=rng.randint(1, 12))) for _ in range(300)}
    some = {w for w in some if len(w) <= pieces.LONGEST}
    got = pieces.encoded_words(spark.createDataFrame([(w, 0) for w in sorted(some)], "word string, part int"), m.table(spark), m.byte_ids[0]).collect()
    assert len(got) == len(some)
    for r in got:
        assert np.array(r.ids, ">u2").tobytes() == pieces._spell(r.word, m), r.word


def test_parts_have_the_chunks_of_their_text():
    m, rng = pieces.model(public_tokenizers.path("piece_bpe_32k.model")), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices("ab  \n.,▁é#", k=rng.randint(0, 14)))
        assert [c for p in pieces.parts(t) for c in pieces.part_chunks(p, m)] == pieces.chunks(t, m), t


def test_blocks_are_the_same_for_any_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "BLOCK_CHARS", 100)
    monkeypatch.setattr(pieces, "SLICE_CHARS", 40)
    rng = random.Random(2)
    rows = ["x" * rng.randint(0, 60) if i % 9 else None for i in range(80)]

    def blocks(sizes):
        at, out = 0, []
        batches = []
        while at < len(rows):
            n = next(sizes)
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_arrays([pa.array([3] * len(part), pa.int32()), pa.array(part, pa.string())], names=["s", "t"]))
            at += n
        for block, b in pieces._blocks(iter(batches), 1):
            out += [(block, t) for t in b.column(1).to_pylist()]
        return out

    one = blocks(iter([80]))
    assert [t for _, t in one] == rows and one == blocks(iter([7] * 20)) and len({b for b, _ in one}) > 3


def test_viterbi_fold_is_the_best_path(spark):
    rng = random.Random(5)
    score = {p: rng.uniform(-8, -1) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "bca"]}
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(score.items())], "piece string, id int, score double")
    some = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(40)})
    got = pieces.encoded_words(spark.createDataFrame([(w,) for w in some], "word string"), table, 100, "viterbi").collect()
    names = list(score)
    for r in got:
        best = [0.0]
        for k in range(1, len(r.word) + 1):
            best.append(max(best[j] + score[r.word[j:k]] for j in range(k) if r.word[j:k] in score))
        assert "".join(names[i] for i in r.ids) == r.word
        assert sum(score[names[i]] for i in r.ids) == pytest.approx(best[-1])


# --- token files


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "test-shards")
    tok = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(docs, folder, path, docs_per_shard=20)
    rows = sorted(local(token_files.read_tokens(manifest, folder)), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x) and len(rows) == docs.count()
    text, at = {r["doc_id"]: r["text"] for r in local(docs)}, 0
    for r in rows:
        want = [*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"]) == (at, len(want))
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    shards = [token_files.Shard(folder, r["file"]) for r in local(manifest)]
    found = [s.find(7) for s in shards]
    assert [list(f) for f in found if f is not None] == [[*tok.encode(text[7], add_special_tokens=False).ids, 2]]


def test_token_ids_of_odd_words():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    tok = Tokenizer.from_file(path)
    odd = ["<|startoftext|>x it's IT'S", "a.b,c d!! \"x\" (y) -z- x-", "İstanbul ΣΑΣ ΑΣ.", "x" * 60 + " y. " + "x" * 60 + ".", "'s 't don't. you're!!", "\xa0a b\x1cc\x85d"]
    odd += ["".join(rng.choices("aBcÉß.,!*'1-\"#)Σσς İ\nǅ", k=rng.randint(1, 25))) for _ in range(3000)]
    for t, x in zip(odd, token_files.encode_texts(odd, path), strict=True):
        assert list(np.frombuffer(x, "<u2")) == tok.encode(t, add_special_tokens=False).ids, t


def test_no_documents_no_shards(spark, docs):
    folder = scratch(spark, "test-shards")
    manifest = token_files.write_tokens(docs.limit(0), folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_tokens(manifest, folder).count() == 0


# --- quality rules


def test_statistics(spark, docs):
    got = local(docs.select("text", quality_rules.statistics(F.col("text")).alias("s")).select("text", "s.*"))
    for r in got:
        t, w = r["text"] or "", words(r["text"])
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = list(zip(w, w[1:], w[2:]))
        n, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                cover |= {i, i + 1, i + 2}
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(cover)


def test_outliers_go_and_clean_stay(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 8))) for _ in range(rng.integers(60, 200))), "en", "a", 0) for i in range(120)]
    rows += [(1000 + i, " ".join(f"{w}***" for w in rows[i][1].split()), "en", "a", 0) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    v = {r["doc_id"]: r for r in local(quality_rules.verdicts(df))}
    assert all(v[i]["kept"] for i in range(120)) and not any(v[1000 + i]["kept"] for i in range(6))
    assert quality_rules.kept_documents(df).count() == 120
    assert quality_rules.verdicts(df.limit(0)).count() == 0


def test_mcd_against_numpy(spark):
    """Means, covariances and verdicts of the same starts, steps, choice and reweighting with exact halves, two groups at once."""
    rng, q = np.random.default_rng(5), quality_rules
    names, ridge = list(q.FEATURES), q.RIDGE * np.eye(q.N)
    data = {}
    for g, far in ((0, [2.0, 3.0, 1.5, 1.5]), (1, [-1.0, 2.0, 2.0, 0.0])):
        x = rng.multivariate_normal([1.6, 0.3, 0.4, 0.3], 0.02 * (np.eye(4) + 0.4), 400)
        x[:120] += far  # almost a third is contaminated
        data[g] = x
    df = spark.createDataFrame([(g, *map(float, r)) for g, x in data.items() for r in x], ["g", *names])
    fits = {r["g"]: r for r in local(q.estimates(df, ["g"]))}
    for g, x in data.items():
        def steps(centre, cov):
            for _ in range(q.STEPS):
                d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov + ridge), x - centre)
                near = x[np.argsort(d)[: len(x) // 2]]
                centre, cov = near.mean(axis=0), np.cov(near.T, bias=True)
            return np.linalg.slogdet(cov + ridge)[1], centre, cov

        quarter = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        starts = [steps(quarter[1], np.diag(((quarter[2] - quarter[0]) / 1.349) ** 2)), steps(x.mean(axis=0), np.cov(x.T, bias=True))]
        logdet, centre, cov = min(starts, key=lambda s: s[0])
        cov = cov * q.consistency(q.HALF) + ridge
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        inside = x[d <= q.chi_square_quantile(q.REWEIGHT, 4)]
        centre, cov = inside.mean(axis=0), np.cov(inside.T, bias=True) * q.consistency(q.REWEIGHT) + ridge
        low = np.array([[fits[g].get(f"l_{i}_{j}", 0.0) for j in range(4)] for i in range(4)])
        assert fits[g]["n_rows"] == 400 and min(s["logdet"] for s in fits[g]["starts"]) <= logdet + 0.1
        assert np.allclose([fits[g][f"m_{i}"] for i in range(4)], centre, atol=0.02)
        assert np.allclose(low @ low.T, cov, atol=0.006)
        mine = np.einsum("ij,jk,ik->i", x - [fits[g][f"m_{i}"] for i in range(4)], np.linalg.inv(low @ low.T), x - [fits[g][f"m_{i}"] for i in range(4)])
        brute = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        assert ((mine <= q.CUTOFF) == (brute <= q.CUTOFF)).mean() > 0.99
        assert (mine[:120] > q.CUTOFF).all() and (mine[120:] <= q.CUTOFF).mean() > 0.99


def test_small_groups_lean_on_the_whole(spark):
    """The shrunk estimate is that of the group's rows and rows of the whole taken together, so a lone outlier can't vouch for itself."""
    q, rng = quality_rules, np.random.default_rng(8)
    whole = {f"m_{i}": float(rng.normal()) for i in range(q.N)}
    a, b = rng.normal(size=(q.N, q.N)), rng.normal(size=(q.N, q.N))
    inner, outer = a @ a.T, b @ b.T
    whole |= {f"c_{i}_{j}": float(outer[i, j]) for i, j in q.CELLS}
    own = {"n_rows": 30} | {f"m_{i}": float(rng.normal()) for i in range(q.N)} | {f"c_{i}_{j}": float(inner[i, j]) for i, j in q.CELLS}
    got = q.shrunk(spark.createDataFrame([tuple(own.values())], list(own)), whole, 50).first()
    m, o = (np.array([x[f"m_{i}"] for i in range(q.N)]) for x in (own, whole))
    w, factor = 30 / 80, q.consistency(q.REWEIGHT)
    cov = factor * (w * inner + (1 - w) * outer) + w * (1 - w) * np.outer(m - o, m - o) + q.RIDGE * np.eye(q.N)
    low = np.array([[got[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(q.N)] for i in range(q.N)])
    assert np.allclose([got[f"m_{i}"] for i in range(q.N)], w * m + (1 - w) * o) and np.allclose(low @ low.T, cov)

    word = lambda: "".join(rng.choice(list("aeinrst"), rng.integers(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.integers(60, 200))), "en", f"s{i % 20}" if i % 5 == 0 else "a") for i in range(300)]
    rows += [(1000, " ".join(f"{word()}***" for _ in range(100)), "fr", "alone"), (1001, " ".join(word() for _ in range(100)), None, None)]
    v = {r["doc_id"]: r["kept"] for r in local(q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))}
    assert [i for i, kept in v.items() if not kept] == [1000]


def test_chi_square():
    assert quality_rules.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality_rules.chi_square(12.5916, 6) == pytest.approx(0.95, abs=1e-4)


def test_rules_on_odd_rows(spark, docs):
    v = local(quality_rules.verdicts(docs))
    assert len(v) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in v if r["n_words"] < 50)
    assert quality_rules.kept_documents(docs).columns == docs.columns


# --- quality model and toxicity


def labelled(spark, flag, bad, good, n=240):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeinrst", k=rng.randint(3, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=40)
        one = i % 3 == 0
        rows.append((i, " ".join((bad if one else good)(w, rng))))
        labels.append((i, int(one)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {flag} int")


def test_quality_model_on_held_out_rows(spark):
    docs, labels = labelled(spark, "quality", lambda w, r: w, lambda w, r: [f"{x}!!" for x in w])
    got = local(quality_model.scored(docs, quality_model.trained(docs, labels)).join(labels, "doc_id"))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(held) > 20
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in held) >= 0.97 * len(held)
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in local(quality_model.scored(empty, quality_model.fit([]))))
    a = quality_model._buckets("ab cd cd")
    assert (a == quality_model.REPEAT).sum() == 1


def test_features_by_a_plain_loop(monkeypatch):
    q, m = quality_model, 1 << 32
    one, two, three = int(q.P1), int(q.P2), int(q.P3)

    def bucket(h, salt):
        h = (h ^ salt) * three % m
        return (h ^ (h >> 15)) * two % m >> (32 - q.BITS)

    def plain(text):
        c = [32 if ch in " \t\n\x0b\x0c\r" else ord(ch) for ch in f" {text} "]
        out = []
        for i in range(len(c) - 2):
            tri = c[i] * one + c[i + 1] * two + c[i + 2] * three
            if c[i + 1] != 32:
                out.append(bucket(tri % m, 0x3A3A3A))
                if i + 3 < len(c) and c[i + 2] != 32:
                    out.append(bucket((tri * two + c[i + 3]) % m, 0x4B4B4B))
        words = [w for w in "".join(map(chr, c)).split(" ") if w]
        out += [bucket(sum((ord(ch) + 1) * pow(one, k + 1, m) for k, ch in enumerate(w)) % m, 0x1C1C1C) for w in words]
        return sorted(out + [q.REPEAT] * sum(x == y for x, y in zip(words, words[1:])))  # noqa: B905

    for text in [t for t in texts() if t] + ["a", " a", "ab", "cd cd\tcd", "\u00a0 \u2003x"]:
        assert sorted(q._buckets(text).tolist()) == plain(text), text[:50]
    # In pieces, only what crosses a cut is read in two parts, and each word stays whole.
    whole = q._buckets("abc def ghi jkl")
    monkeypatch.setattr(q, "PIECE", 8)
    assert sorted(np.concatenate(list(q.features("abc def ghi jkl"))).tolist()) == sorted(whole.tolist())


def test_steps_follow_the_numeric_gradient(monkeypatch):
    q = quality_model
    for name, value in (("BUCKETS", 10), ("DIM", 3), ("EPOCHS", 3)):
        monkeypatch.setattr(q, name, value)
    rng = np.random.default_rng(2)
    rows = [(k % 2, np.sort(rng.choice(10, 4, replace=False)), rng.integers(1, 4, 4).astype(np.float32)) for k in range(5)]
    got, got_bias = q.fit(rows, seed=3)
    draw = np.random.default_rng(3)
    vectors = draw.uniform(-1 / 3, 1 / 3, (10, 3))
    out, bias, done = np.zeros((2, 3)), np.zeros(2), 0
    for _ in range(3):
        for r in draw.permutation(5):
            label, ids, counts = rows[r]
            w = counts / counts.sum()

            def loss():
                z = out @ (w @ vectors[ids]) + bias
                return np.log(np.exp(z).sum()) - z[label]

            def slope(of):
                g = np.zeros_like(of)
                for at in np.ndindex(of.shape):
                    keep, sides = of[at], []
                    for d in (1e-5, -1e-5):
                        of[at] = keep + d
                        sides.append(loss())
                    of[at], g[at] = keep, (sides[0] - sides[1]) / 2e-5
                return g

            rate = q.RATE * (1 - done / 15)
            done += 1
            to_vectors, to_out, to_bias = slope(vectors), slope(out), slope(bias)
            vectors -= rate * 4 * to_vectors  # four features
            out -= rate * to_out
            bias -= rate * 0.1 * to_bias
    assert np.allclose(got, vectors @ (out[1] - out[0]), atol=1e-4) and got_bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_toxicity_on_held_out_rows(spark):
    insults = ["grobnak", "grobnit", "grobnol", "vexidu"]
    docs, labels = labelled(spark, "toxic", lambda w, r: [*w[:20], r.choice(insults), *w[20:], r.choice(insults)], lambda w, r: w)
    model = toxicity.learned(docs, labels)
    got = local(toxicity.scored(docs, model).join(labels, "doc_id"))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a grobnux")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in local(toxicity.scored(odd, model))}
    assert s[1] == s[2] < s[3]
    assert toxicity.learned(docs, labels.limit(0))[0] == {}


def test_composition_and_best_paths():
    """The composed grammar against all paths through the transducers run one after another."""
    rng = random.Random(6)
    chain = [toxicity._reported(), toxicity._negated(), toxicity._insults(), toxicity._threats(), toxicity._targets()]

    def paths(t, symbols):
        """All accepted outputs of a transducer: (symbols written, gains)."""
        found = [(t.start, [], [])]
        for x in symbols:
            found = [(s2, [*out, w], [*g, h]) for s, out, g in found for s2, w, h in t.step(s, x)]
        return [(out, g) for s, out, g in found if s in t.final]

    for _ in range(150):
        symbols = rng.choices(toxicity.SYMBOLS, k=rng.randint(0, 7))
        weights = [rng.uniform(1, 5) if x in ("insult", "threat") else 0.0 for x in symbols]
        found = [(symbols, [1.0] * len(symbols))]
        for t in chain:
            found = [(out, [a * b for a, b in zip(g, h, strict=True)]) for seen, g in found for out, h in paths(t, seen)]
        best = max((sum(w * a for w, a, x in zip(weights, g, out, strict=True) if x == "hit") for out, g in found), default=0.0)
        assert toxicity.GRAMMAR.best(list(zip(symbols, weights, strict=True))) == pytest.approx(best)


def test_target_after_the_insult():
    lex = toxicity.Lexicon({"w:idiot": 4.0})
    assert toxicity.clause_score("idiot, you", lex) == toxicity.clause_score("you idiot", lex) > toxicity.clause_score("idiot", lex)


def test_grammar():
    lex = toxicity.Lexicon({"w:idiot": 4.0})
    plain = toxicity.clause_score("the idiot came", lex)
    assert toxicity.clause_score("you idiot", lex) > plain > toxicity.clause_score("not an idiot", lex)
    assert toxicity.clause_score('he said "idiot"', lex) < plain
    assert toxicity.clause_score("i will kill you", lex) > toxicity.clause_score("they kill time", lex)


# --- html


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/x'>Menu</a></nav><div class=\"ad\">Buy</div><article><h1>Head &amp; line</h1><p><b>Bold text<br><p>First&nbsp;  one.</p><p>Second <i>one</i></p><div class='comments'>Nice!</div></article><footer>&copy; x</footer></body></html>"


def test_html_main_text(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", PAGE, 1), (2, None, None, 1), (3, "x", "", 1), (4, "http://a.b/d", PAGE[: PAGE.index("Second") + 9], 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in local(html_text.extracted(df))}
    assert got[1]["text"] == "Head & line\nBold text\nFirst one.\nSecond one"
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[4]["text"].endswith("Second")
    assert html_text.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("most_sent", (200_000, 0))
def test_style_tree_cuts_what_pages_repeat(spark, most_sent):
    page = "<body><div id='top'><span>Welcome to our place</span></div><div><p>Story {} told once</p><p>and {} more</p></div><div><ul><li>Home</li><li>Contact us</li></ul></div></body>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i, i * 7)) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in local(html_text.extracted(df, most_sent))}
    assert all(f"Story {i} told once\nand {i * 7} more" in t and "Contact us" not in t and "Welcome" not in t for i, t in got.items())


def test_style_tree_by_hand(spark):
    """Entropies of a small host, recomputed from the pages; repeated branches go within the article too, and names alone don't decide."""
    import math

    page = "<body><article><h1>Head {0}</h1><p>Story {0} told once</p><div>Read more on our site</div></article><div class='side'><p>Own words {0}</p></div><div><p>Same {1}</p></div></body>"
    n = 40
    df = spark.createDataFrame([(i, "http://h.org/x", page.format(i, i % 2)) for i in range(n)], "page_id long, url string, html string")
    found, children = html_text.blocks(page.format(0, 0))
    tree = {r["node"]: r for r in local(html_text.style_tree(df))}
    assert set(tree) == {b.node for b in found} and len(found) == 5
    for k, b in enumerate(found):
        values = [html_text.blocks(page.format(i, i % 2))[0][k].text for i in range(n)]
        # A block on one page only has entropy 0, one on m pages log m.
        of = Counter(values)
        content = 1 - sum(math.log(c) for c in of.values()) / len(of) / math.log(n)
        looks = Counter(" ".join(html_text.blocks(page.format(i, i % 2))[1].get(b.node, [])) for i in range(n))
        presentation = -sum(c / n * math.log(c / n) for c in looks.values()) / math.log(n)
        assert tree[b.node]["importance"] == pytest.approx(html_text.GAMMA * content + (1 - html_text.GAMMA) * presentation), b.text
    texts_ = {r["page_id"]: r["text"] for r in local(html_text.extracted(df))}
    assert all(texts_[i] == f"Head {i}\nStory {i} told once\nOwn words {i}" for i in range(n))
    # Without the tree the names and tags alone would keep the repeated branches and drop the words beside them.
    assert html_text.page_text(page.format(3, 1)) == "Head 3\nStory 3 told once\nRead more on our site\nSame 1"


def test_copies_of_a_page_keep_their_text(spark):
    df = spark.createDataFrame([(i, "http://h.org/x", PAGE) for i in range(60)], "page_id long, url string, html string")
    assert {r["text"] for r in local(html_text.extracted(df))} == {"Head & line\nBold text\nFirst one.\nSecond one"}


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<p>inner</p>" + "x <b>" * 20_000
    assert html_text.page_text(f"<article>{deep}").startswith("inner\nx x")
    assert html_text.page_text("<article>" + "<p>a b" * 50_000).count("\n") == 49_999


# --- personal data


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            d = [int(c) for c in reversed(g)]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(g) <= 19 and luhn or kind == "phone" and 9 <= len(g) <= 15:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    some = ["a@b.c.d@e.f", "@x.y a.b@c", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485 x +49 30 1234567", "12345.1.1.1"]
    some += ["".join(rng.choices("a1.@+ -()4_2", k=rng.randint(5, 60))) for _ in range(5000)]
    for t in some:
        assert pii.base_spans(t) == brute_spans(t), t


def test_patterns_find_unseen_identifiers(spark, tmp_path):
    """op7 itself: counts and spans of the fixed patterns by brute force, and planted identifiers that no fixed pattern matches are found."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(3, 8)))
    fill = lambda: " ".join(word() for _ in range(rng.randint(3, 9)))
    contexts = {"email": ("write me at {} today please", lambda: f"{word()}@{word()}.example.org", lambda: f"{word()}@intranet"), "phone": ("call my mobile {} after work", lambda: f"+49 30 {rng.randrange(10**6, 10**7)}", lambda: f"030 {rng.randrange(10**6, 10**7)}")}
    rows, planted, innocent = [], {}, []
    for k, (kind, (context, seed, unseen)) in enumerate(contexts.items()):
        for i in range(40):
            rows.append((1000 * k + i, f"{fill()} {context.format(seed())} {fill()}"))
        for i in range(4):
            lead, value = f"{fill()} ", unseen()
            text = f"{lead}{context.format(value)} {fill()}"
            rows.append((1000 * k + 500 + i, text))
            planted[1000 * k + 500 + i] = f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"
    for i in range(40):
        innocent.append(5000 + i)
        rows.append((5000 + i, f"{fill()} order number {rng.randrange(10**6, 10**7)} was {fill()}"))
    rows += [(9000, None), (9001, ""), (9002, "a@b.c.d@e.f 1.2.3.4 4111 1111 1111 1111 +1 (988) 555-2485"), (9002, "a@b.c.d@e.f 1.2.3.4 4111 1111 1111 1111 +1 (988) 555-2485"), (9003, "x" * 200_000 + "@y.zz " + "1-" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = local(pii.op7_pii(spark, str(tmp_path)))
    assert len(got) == len(rows)
    texts, extra = dict(rows), {}
    for r in got:
        base = brute_spans(texts[r["doc_id"]] or "")
        names = ["email", "ip", "card", "phone"]
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for k, _, _ in base) for i in range(4)]
        joined = [f"{names[k]}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(joined) <= set(spans)
        extra[r["doc_id"]] = sorted(set(spans) - set(joined))
    found = {i: x for i, x in extra.items() if x}
    right = sum(x == [planted.get(i)] for i, x in found.items())
    assert right == len(planted) == 8 and right >= 0.9 * len(found)
    assert not any(extra[i] for i in innocent)


def test_a_mention_counts_once(spark):
    """Two patterns of one mention, each sure by .8, adopt nothing; two mentions with other words around them do."""
    known = [(0, 100 * p + i, [p]) for p in (1, 2) for i in range(12)]
    doubt = [(-1, 900 + 10 * p + i, [p]) for p in (1, 2) for i in range(2)]
    schema = "kind int, instance long, patterns array<long>"
    one, two = [(-1, 1000, [1, 2])] * 5, [(-1, 2000, [1]), (-1, 2000, [2])]
    assert local(pii.adopted(spark.createDataFrame(known + doubt + one, schema))) == []
    assert [r["instance"] for r in local(pii.adopted(spark.createDataFrame(known + doubt + two, schema)))] == [2000]


def test_masked(spark):
    rows = [(i, f"some words then mail me at user{i}@mail.example.org today please") for i in range(12)] + [(101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    m = {r["doc_id"]: r for r in local(pii.masked(df.withColumns({"spans": F.lit(1), "row": F.lit(2), "id": F.lit(3), "of_id": F.lit(4)})))}
    assert m[0]["text"] == "some words then mail me at <EMAIL> today please" and m[0]["n_chars"] == len(m[0]["text"]) and m[101]["text"] is None and len(m) == 14
    assert (m[0]["spans"], m[0]["row"], m[0]["id"], m[0]["of_id"]) == (1, 2, 3, 4)
    assert pii.masked(df.limit(0)).count() == 0


def test_adoption(spark):
    rows = [(0, i, [7]) for i in range(10)] + [(-1, 99, [7]), (-1, 98, [8]), (0, 1, [8])]
    schema = "kind int, instance long, patterns array<long>"
    # One pattern, ten of whose eleven instances are known: .91.
    assert local(pii.adopted(spark.createDataFrame(rows, schema))) == [{"instance": 99, "kind": 0}]
    # A chain: each pattern is sure only when the instance adopted before it is known.
    chain = [(0, i, [0]) for i in range(10)] + [(-1, 100, [0, 1])] + [r for k in range(1, 6) for r in [*((0, 1000 * k + i, [k]) for i in range(9)), (-1, 100 + k, [k, k + 1])]]
    assert {r["instance"] for r in local(pii.adopted(spark.createDataFrame(chain, schema)))} == {100, 101, 102, 103, 104, 105}
    with pytest.raises(RuntimeError):
        pii.adopted(spark.createDataFrame(rows, schema), most_rounds=1)


# --- mixing


def test_targets():
    t = mixing.targets([("a", 100), ("b", 100), (None, 100)])
    assert t == {"a": 200, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


@pytest.mark.parametrize("per_bin", (20_000, 3))
def test_mixture_meets_targets(spark, docs, per_bin):
    rows = local(mixing.mixed(docs, per_bin=per_bin))
    assert len(rows) == docs.count()
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    want = mixing.targets(list(size.items()))
    largest = max(r["size"] for r in rows)
    for s in size:
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size[s] and r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= largest
    key = lambda r: (str(r["doc_id"]), r["text_hash"], r["times"])
    assert sorted(map(key, rows)) == sorted(map(key, local(mixing.mixed(docs.repartition(2), per_bin=per_bin))))
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("per_bin", (1000, 2))
def test_mixture_against_brute_force(spark, per_bin):
    """The same draws taken in order one by one."""
    import math

    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choices("abc#*", weights=(5, 5, 5, rng.choice((0, 40)), 0), k=4)) for _ in range(rng.randint(0, 30))), rng.choice("ab") if i % 5 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seeds = {r["doc_id"]: r for r in local(docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(mixing.SEED)), 11).alias("u"), mixing.quality_weight(F.col("text")).alias("q")))}
    size = {i: len(words(t)) for i, t, _ in rows}
    of_source = Counter()
    for i, _, src in rows:
        of_source[src] += size[i]
    target, taken = mixing.targets(list(of_source.items())), {}
    for src, total in of_source.items():
        epochs = min(2, math.floor(target[src] / total + 1e-9))
        rest, so_far = max(0.0, target[src] - epochs * total), 0
        order = sorted((i for i, _, x in rows if x == src), key=lambda i: -math.log((seeds[i]["u"] + 0.5) / 2**53) / seeds[i]["q"])
        for i in order:
            so_far += size[i]
            taken[i] = size[i] * (epochs + (so_far - size[i] / 2 <= rest and rest > 0))
    got = {r["doc_id"]: r["taken"] for r in local(mixing.mixed(docs, per_bin=per_bin))}
    assert got == taken


# --- piecewise hashing


def brute_piecewise(text):
    """One byte at a time."""
    data = (text or "").encode()
    if not data:
        return "3::"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hashes = []
    for i in range(len(data)):
        h = 0
        for k in range(min(7, i + 1)):
            h = (h + (data[i - k] + 1) * pow(0x01000193, k, 1 << 32)) % (1 << 32)
        h ^= h >> 15
        h = h * 0x9E3779B1 % (1 << 32)
        hashes.append(h ^ h >> 16)

    def pieces_of(block):
        out, total, n = "", 0, 0
        for i, h in enumerate(hashes):
            total, n = (total + h) % (1 << 32), n + 1
            if (h % block == block - 1 and len(out) < 63) or i == len(hashes) - 1:
                out += letters[(total * 0x9E3779B1 + n * 0x01000193) % (1 << 32) >> 26]
                total, n = 0, 0
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(pieces_of(block)) < 32:
        block //= 2
    return f"{block}:{pieces_of(block)}:{pieces_of(2 * block)}"


def test_fingerprints_byte_by_byte():
    rng = random.Random(3)
    for t in [*texts(), *("".join(rng.choices("abcdé ", k=n)) for n in (1, 5, 191, 192, 193, 500, 4000))]:
        assert piecewise.fingerprint(t) == brute_piecewise(t), t


def test_edit_distances():
    rng = random.Random(6)
    a, b = ([bytes(rng.choices(b"abcd", k=rng.randint(0, 64))) for _ in range(200)] for _ in range(2))

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    assert piecewise.edit_distances(a, b).tolist() == [lev(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("ranges", (None, 1, 7, 200))
def test_edited_texts(spark, docs, ranges):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(local(unique), key=lambda r: r["doc_id"])
    df = piecewise.compared(unique, ranges)
    got = sorted(local(df), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    for k, r in enumerate(got):
        t, after = rows[k]["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == piecewise.fingerprint(t) and r["edited_fingerprint"] == piecewise.fingerprint(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 300][:40]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 > 0.2 > np.mean([r["near_next"] for r in long[:-1]])


def test_piecewise_odd_tables(spark, docs):
    assert piecewise.compared(docs).count() == docs.count()
    assert piecewise.compared(docs.limit(0)).count() == 0
    assert piecewise.compared(docs.where("doc_id = 3")).first().near_next == 1
    assert piecewise.fingerprint(None) == piecewise.fingerprint("") == "3::"


# --- simhash


def brute_fingerprint(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "")
    w = WORD.findall(w)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(docs):
    for t in [r["text"] for r in local(docs)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("crowd", (64, 2))
def test_links_lose_nothing(spark, crowd):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.choice((0, 1, 2, 3)))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    parts = {r.node: r.root for r in connected_components(simhash.links(df, crowd)).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(find(i), set()).add(simhash._signed(f))
    got = {}
    for f in fps:
        s = simhash._signed(f)
        got.setdefault(parts.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_deduplication(spark, docs):
    c = local(simhash.classes(docs))
    assert len(c) == docs.count()
    kept = local(simhash.deduplicated(docs))
    assert len(kept) == len({r["label"] for r in c}) and list(kept[0]) == docs.columns
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[501] == 500


def test_html_entities_are_decoded():
    assert html.unescape("&amp") == "&" and html_text.page_text("<article><p>a &lt; b &amp</article>") == "a < b &"
