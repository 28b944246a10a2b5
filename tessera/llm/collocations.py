"""Collocations: phrases of two and three words that stand together more often than their parts would.

Texts become blocks of word numbers with a list of words each. Words counted over all blocks get a number if they are frequent enough to
stand in any candidate; blocks get these numbers back, and all other words part a text like a full stop does.

Each block is counted in a HAT-trie: a shallow trie over word numbers with hash containers of the rest of a phrase below its first
word. A container that grows large bursts into a branch by the second word. When the trie holds too many entries, its largest
subtrees are spilled whole, as sorted runs. Runs are dealt by the first two words and each part's runs are merged. A
prefix of two words that are both very frequent is dealt by its third word too, by counts that all blocks know; the sums of such
prefixes are added afterwards. So no key, however frequent, meets in one place, and each part holds about as much.

Cases: null texts are empty; a null lang counts as `und`; texts without words give nothing; words of any length count; repeated rows
count as often as they stand there; no documents, or no phrase frequent enough, give no rows. Other columns are neither read
nor changed. Scores are exact as long as counts stay below 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle

#: Least count of a candidate, candidates kept of each language, and the share at which a longer phrase stands for a shorter one.
LEAST, KEPT, SHARE = 10, 2000, (50, 100)
#: Words of a block.
BLOCK_WORDS = 2_000_000
#: Triples added at a time, entries at which a container bursts, and entries at which a trie spills.
CHUNK, BURST, LIMIT = 500_000, 8192, 1_000_000
#: Words for each part of the merge; and how often the rarer word of a prefix may stand before the prefix is dealt out.
PART_WORDS, HOT = 1_000_000, 1_000_000

#: Letters A-Z become small, all marks that end a piece a full stop, tabs spaces.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else 46 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x for x in range(256))


class _Numbers(dict):
    """Numbers from 1 in the order in which words come; 0 is a break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _planes(columns: list[np.ndarray]) -> bytes:
    """Whole numbers as compressed planes of bytes: high bytes are mostly alike."""
    return zstandard.compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), 1)


def _unplanes(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<i8").ravel() for c in raw]


BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def blocks_of(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of one language each: n words, their numbers in order (0: break), and the words with their counts, from number 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for lang, (numbers, texts) in open_.items():
                ids = np.concatenate(texts)
                counts = np.bincount(ids, minlength=len(numbers))[1:]
                row = [part << 32 | seq, lang, int(counts.sum()), _planes([ids]), list(numbers)[1:], counts]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)
            open_.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or b"").translate(_FOLD).replace(b".", b" . ").split()
                if lang not in open_:
                    open_[lang] = _Numbers({b".": 0}), []
                numbers, texts = open_[lang]
                words.append(b".")
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= block_words:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "block long, lang string, n long, ids binary, words array<binary>, counts array<long>")


class Branch(dict):
    """A burst container: second word -> container of third words."""


class HatTrie:
    """Counts of triples of numbers (the third 0 where a phrase ends after two); numbers are below `width`."""

    def __init__(self, width: int, burst: int = BURST, limit: int = LIMIT):
        self.width, self.burst, self.limit = width, burst, limit
        self.top: dict[int, Counter | Branch] = {}
        self.sizes: dict[int, int] = {}

    def add(self, first: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts phrases (first word, second * width + third) and gives the runs that had to be spilled."""
        if not len(first):
            return
        order = np.argsort(first, kind="stable")
        first, rest = first[order], rest[order]
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        values, ends = rest.tolist(), [*starts[1:].tolist(), len(first)]
        for word, a, b in zip(first[starts].tolist(), starts.tolist(), ends, strict=True):
            node = self.top.get(word)
            if node is None:
                node = self.top[word] = Counter()
            if isinstance(node, Branch):
                self._into_branch(node, values[a:b])
                self.sizes[word] = sum(map(len, node.values()))
                continue
            node.update(values[a:b])
            self.sizes[word] = len(node)
            if len(node) > self.burst:
                self.top[word] = Branch()
                for value, n in node.items():
                    self.top[word].setdefault(value // self.width, Counter())[value % self.width] = n
        if sum(self.sizes.values()) > self.limit:
            yield self.spill(self.limit // 2)

    def _into_branch(self, node: Branch, values: list[int]) -> None:
        for value in values:
            second, third = divmod(value, self.width)
            box = node.get(second)
            if box is None:
                box = node[second] = Counter()
            box[third] += 1

    def spill(self, leave: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes whole subtrees out, the largest first, until at most `leave` entries are left: (first, rest, count), sorted."""
        total, gone = sum(self.sizes.values()), []
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if total <= leave:
                break
            total -= self.sizes.pop(word)
            gone.append((word, self.top.pop(word)))
        boxes = [(word, node if isinstance(node, Counter) else Counter({s * self.width + t: n for s, box in node.items() for t, n in box.items()})) for word, node in gone]
        k = sum(len(box) for _, box in boxes)
        first = np.repeat(np.array([w for w, _ in boxes], np.int64), [len(box) for _, box in boxes])
        rest = np.fromiter(chain.from_iterable(box for _, box in boxes), np.int64, k)
        n = np.fromiter(chain.from_iterable(box.values() for _, box in boxes), np.int64, k)
        order = np.lexsort((rest, first))
        return first[order], rest[order], n[order]


def _mix(*ids: np.ndarray) -> np.ndarray:
    h = np.full(len(ids[0]), 0x9E3779B97F4A7C15, np.uint64)
    for x in ids:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _count(parts: int, hot: int, limit: int, burst: int, chunk: int):
    """Runs of triples from blocks (ids, known: local number, number, count): rows (part, run)."""

    def runs(ids: np.ndarray, local: np.ndarray, number: np.ndarray, f: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(number)  # ranks ascend with numbers, so what is sorted by one is sorted by the other
        local, number, f = local[order], np.concatenate([[-1], number[order]]), np.concatenate([[0], f[order]])
        rank = np.zeros(max(int(ids.max(initial=0)), int(local.max(initial=0))) + 1, np.int64)
        rank[local] = np.arange(1, len(local) + 1)
        t = np.concatenate([rank[ids], [0, 0]])
        width = len(number)
        trie = HatTrie(width, burst, limit)

        def dealt(first: np.ndarray, rest: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
            second, third = np.divmod(rest, width)
            salts = np.clip(-(-np.minimum(f[first], f[second]) // hot), 1, 1 << 16).astype(np.uint64)
            g1, g2, g3 = number[first], number[second], number[third]
            to = ((_mix(g1, g2) + _mix(g3) % salts) % np.uint64(parts)).astype(np.int64) + parts * (salts > 1)
            order = np.argsort(to, kind="stable")
            to, columns = to[order], [x[order] for x in (g1, g2, g3, n)]
            cuts = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                yield int(to[a]), _planes([c[a:b] for c in columns])

        for at in range(0, len(ids), chunk):
            a, b, c = t[at : at + chunk], t[at + 1 : at + 1 + chunk], t[at + 2 : at + 2 + chunk]
            a = a[: len(ids) - at]
            b, c = b[: len(a)], c[: len(a)]
            both = (a > 0) & (b > 0)
            for run in trie.add(a[both], (b * width + c)[both]):
                yield from dealt(*run)
        yield from dealt(*trie.spill())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                known = b.column(1)[k].values
                found = list(runs(_unplanes(b.column(0)[k].as_py(), 1)[0], *[known.field(i).to_numpy(zero_copy_only=False) for i in range(3)]))
                for at in range(0, len(found), 64):
                    part, data = zip(*found[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(data, pa.binary())], names=["part", "run"])

    return run


def merged(runs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The triples of sorted runs, and the pairs they begin with, each with its sum."""
    columns = [np.concatenate(c) for c in zip(*(_unplanes(r, 4) for r in runs), strict=True)]
    order = np.lexsort(columns[2::-1])
    columns = [c[order] for c in columns]

    def sums(keys: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
        new = np.flatnonzero(np.any([np.diff(k, prepend=k[0] - 1) != 0 for k in keys], axis=0))
        return [*(k[new] for k in keys), np.add.reduceat(n, new)]

    return sums(columns[:3], columns[3]), sums(columns[:2], columns[3])


def _merge(parts: int, least: int):
    def rows(part: int, runs: list[bytes]) -> pa.RecordBatch:
        (a, b, c, n), (x, y, m) = merged(runs)
        keep = (c >= 0) & (n >= least)
        # What is dealt by its third word too has only a part of its pairs here.
        pairs = (m >= least) | (part >= parts)
        out = [np.concatenate(z) for z in ((a[keep], x[pairs]), (b[keep], y[pairs]), (c[keep], np.full(pairs.sum(), -1)), (n[keep], m[pairs]))]
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in out], names=["w1", "w2", "w3", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != at and held:
                    yield rows(at, held)
                    held = []
                at = part
                held.append(data.as_py())
        if held:
            yield rows(at, held)

    return run


def phrase_counts(blocks: DataFrame, least: int = LEAST, hot: int = HOT, limit: int = LIMIT, part_words: int = PART_WORDS, burst: int = BURST, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """From settled blocks: (lang, word, id, f) of the frequent words and (w1, w2, w3 or -1, f: ids of words) of the frequent phrases."""
    vocabulary = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "lang", (F.col("at") + 1).cast("long").alias("local"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id())
    words = settle(words, "phrases-words")
    known = vocabulary.drop("n").join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("local", "id", "f")).alias("known"))
    parts = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // part_words))
    runs = blocks.select("block", "ids").join(known, "block").select("ids", "known").mapInArrow(_count(parts, hot, limit, burst, chunk), "part long, run binary")
    counted = runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge(parts, least), "w1 long, w2 long, w3 long, n long")
    counted = settle(counted, "phrases-counts")
    pairs = counted.where("w3 < 0").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return words, pairs.unionByName(counted.where("w3 >= 0").withColumnRenamed("n", "f"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)); at most 10^6, as no part is rarer than the whole."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def candidates(words: DataFrame, phrases: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(lang, phrase: bytes, a, l, r, score) of the phrases that no longer one stands for, each by its lowest cut."""
    phrases = settle(phrases, "phrases-all")
    pairs, triples = phrases.where("w3 < 0").select("w1", "w2", "f"), phrases.where("w3 >= 0")
    of = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    longer = triples.select(F.explode(F.array(F.struct("w1", "w2", "f"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))).alias("p")).select("p.*").groupBy("w1", "w2").agg(F.max("f").alias("m"))
    free = pairs.join(longer, ["w1", "w2"], "left").where(F.col("m").isNull() | (share[1] * F.col("m") < share[0] * F.col("f"))).drop("m")
    text = lambda n: F.concat(*[c for k in range(1, n + 1) for c in (F.lit(b" "), F.col(f"t{k}"))][1:])
    two = free.join(of(1), "w1").join(of(2), "w2").select("lang", text(2).alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"))
    heads = pairs.withColumnRenamed("f", "f12")
    tails = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"))
    cut = triples.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"]).join(of(1), "w1").join(of(2), "w2").join(of(3), "w3")
    cut = cut.withColumns({"s1": _score(F.col("f"), F.col("f1"), F.col("f23")), "s2": _score(F.col("f"), F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    three = cut.select("lang", text(3).alias("phrase"), F.col("f").alias("a"), pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("s1", "s2").alias("score"))
    return two.unionByName(three)


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, share: tuple[int, int] = SHARE, block_words: int = BLOCK_WORDS, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first candidates. sizes are those of phrase_counts."""
    blocks = settle(blocks_of(docs, block_words), "phrases-blocks")
    found = settle(candidates(*phrase_counts(blocks, least, **sizes), share), "phrases-candidates")
    n = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked(found, kept).join(n, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def ranked(found: DataFrame, kept: int) -> DataFrame:
    """The first rows of each language with their rank. Ranges of the whole order are counted, and each is numbered for itself from what
    stands before it, so that neither a language nor a tie meets in one place."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = settle(found.repartitionByRange("lang", *order).withColumn("part", F.spark_partition_id()), "phrases-ranges")
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("k")).select("lang", "part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)) + F.col("before")
    return dealt.join(before.where(F.col("before") < kept), ["lang", "part"]).withColumn("rank", rank.cast("long")).where(F.col("rank") <= kept).drop("part", "before")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of `documents`."""
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), gram AS (
  SELECT lang, 1 AS k, unnest(w) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2
), f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM gram GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS t FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, k, g, a, 1 AS j, t[1] AS x, substr(g, length(t[1]) + 2) AS y FROM c
  UNION ALL SELECT lang, k, g, a, 2, t[1] || ' ' || t[2], t[3] FROM c WHERE k = 3
), scored AS (
  SELECT cuts.*, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = cuts.x AND l.k = cuts.j JOIN f r ON r.lang = cuts.lang AND r.g = cuts.y AND r.k = cuts.k - cuts.j
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
longer AS (
  SELECT lang, g, max(a) AS m FROM (SELECT lang, t[1] || ' ' || t[2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, t[2] || ' ' || t[3], a FROM c WHERE k = 3) GROUP BY lang, g
), kept AS (
  SELECT least.* FROM least LEFT JOIN longer ON longer.lang = least.lang AND longer.g = least.g WHERE m IS NULL OR 100 * m < 50 * a
)
SELECT kept.lang, row_number() OVER o AS rank, g AS phrase, a, l, r, n, score FROM kept JOIN n ON n.lang = kept.lang
WINDOW o AS (PARTITION BY kept.lang ORDER BY score DESC, a DESC, g) QUALIFY row_number() OVER o <= 2000
"""
