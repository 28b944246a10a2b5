"""SentencePiece encoding and decoding by a relational lattice.

Text becomes chunks across which no piece reaches: a run of word marks with what follows it, marks after a letter, a line end
by itself. The
distinct chunks of the corpus are the words of the lattice. Their substrings of bounded length are exploded and equi-joined to
the piece table; the edges that remain are grouped by word; and a fold with Spark's higher-order `aggregate` finds the
segmentation.

A unigram model's segmentation is the Viterbi path of the best sum of scores. A BPE model's is not: its scores are ranks of
merges, and the library merges the adjacent pair of the best rank until none is left. For such a model the same lattice is
folded by merges (each step takes the edge of the best rank that spans exactly two present segments, the leftmost of equals),
which gives the library's ids; `objective` chooses the fold, by default as the model says.

The words' ids go back to the documents without moving a text: each block of the input (`BLOCK_CHARS` characters of one split)
lists its distinct words once, the ids come back as one dictionary file for each block in the shared folder, and a second
pass over the splits looks words up there. Words of more than `LONGEST` characters don't fit the lattice, whose ends are
the bits of a number; the library encodes them inside the tasks. So it does with words that a dictionary lacks because the
splits changed between the passes (executors that come or go change their number). `n_library` counts both for each
document, so that nothing stands in for the lattice unseen.

Cases: null and empty texts have no pieces; white space other than the blank, and characters without a piece, become bytes;
repeated rows get equal ids; a very long text is encoded as a whole; documents that don't come from stored files are written
to the shared folder first; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bind, documents, scratch, settle

MARK = "▁"
RUNS = re.compile(" +[^ ]*")
#: Marks before which a text is cut if a letter stands before them and no piece of the model joins the two.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?*#%&$|;:=+\"()<>-"
#: Longer chunks aren't put into the lattice, whose ends are the bits of a number: the library encodes them, to the same ids.
LONGEST = 60
#: Characters of text that share a dictionary (some 300 MB of a worker's memory), and those encoded at a time.
BLOCK_CHARS, SLICE_CHARS = 32_000_000, 4_000_000
#: Blocks whose number stands in one row of the distinct words: a word in more of them is folded once for each such group.
BLOCKS_IN_ROW = 4096
#: Substrings of this length and more are only made as far as the model's longest piece that starts like them.
PREFIX = 4


class Model:
    """A SentencePiece model: its pieces, their scores, and how it segments."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.scores = [self.sp.get_score(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.sp.is_byte(i)}
        self.plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        # In a BPE model scores fall by one from piece to piece; unigram scores are logarithms of probabilities.
        tail = [self.scores[i] for i in self.plain[-100:]]
        self.objective = "merges" if all(a - b == 1 for a, b in zip(tail, tail[1:], strict=False)) else "viterbi"
        cut = [c for c in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(c)}", self.pieces[i]) for i in self.plain)]
        marks = "".join(map(re.escape, cut))
        after = f"(?:[^{MARK}\n{marks}]+|(?<![{LETTERS}])[{marks}])*" if cut else f"[^{MARK}\n]*"
        self.chunk = re.compile(f"(?:{MARK}+|[^{MARK}\n]){after}|\n")
        if any("\n" in self.pieces[i] or MARK in self.pieces[i].lstrip(MARK) for i in self.plain):
            raise ValueError("this model has pieces that reach across chunks")
        #: The bytes that each id stands for.
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score) of the pieces that a text can have; its size is the model's, whatever the corpus."""
        return spark.createDataFrame([(self.pieces[i], i, float(self.scores[i])) for i in self.plain], "piece string, id int, score double")

    def decode(self, ids) -> str:
        """The text of ids; the blank that encoding put in front is taken away."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def chunks(text: str, m: Model) -> list[str]:
    return m.chunk.findall(MARK + text.replace(" ", MARK)) if text else []


def parts(text: str) -> list[str]:
    """The text cut before each run of blanks, each part with one blank less at its front; no chunk reaches from one into the next."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return RUNS.findall(f" {text}") if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")


def part_chunks(part: str, m: Model) -> list[str]:
    """The chunks of a part; those of a text are those of its parts one after another."""
    return m.chunk.findall((part if part[:1] == " " else f" {part}").replace(" ", MARK))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _merge_fold(edges: Column, n: Column) -> Column:
    """Bits of the segments' ends, from all places on: the best-ranked edge over two neighbours is merged until none is left.

    An edge (rank, tips, inner) fits if both its tips are ends of segments with just one other between them; of equal
    ranks the leftmost, with the lowest tips, goes first.
    """

    done = F.lit(1 << 62).cast("long")  # set when nothing fits any more

    def step(ends: Column, _: Column) -> Column:
        best = F.array_min(F.filter(edges, lambda e: (ends.bitwiseAND(e["tips"]) == e["tips"]) & (F.bit_count(ends.bitwiseAND(e["inner"])) == 1)))
        return F.when(ends >= done, ends).otherwise(F.coalesce(ends.bitwiseAND(F.bitwise_not(best["inner"])), ends.bitwiseOR(done)))

    every = _bit(n + 1) - 1
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), every, step)
    return F.when(F.size(edges) == 0, every).otherwise(folded.bitwiseAND(F.bitwise_not(done)))


def _viterbi_fold(edges: Column, n: Column) -> Column:
    """Bits of the ends on the path of the least sum of ranks (negative scores); a character without a piece costs 100."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("ends")))

    def step(best: Column, p: Column) -> Column:
        # The far tip is bit p; what is left of the tips is the near one, whose place is the number of bits below it.
        far = _bit(p)
        into = F.transform(
            F.filter(edges, lambda e: (e["tips"] >= far) & (e["tips"] < _bit(p + 1))),
            lambda e: bind(F.get(best, F.bit_count(e["tips"] - far - 1)), lambda f: F.struct((f["cost"] + e["rank"]).alias("cost"), f["ends"].alias("ends"))),
        )
        unknown = F.struct((F.get(best, p - 1)["cost"] + 100.0).alias("cost"), F.get(best, p - 1)["ends"].alias("ends"))
        return F.concat(best, F.array(bind(F.array_min(F.concat(into, F.array(unknown))), lambda t: F.struct(t["cost"].alias("cost"), t["ends"].bitwiseOR(far).alias("ends")))))

    path = F.aggregate(F.sequence(F.lit(1), n), start, step)
    return F.element_at(path, -1)["ends"].bitwiseOR(F.lit(1))


def encoded_words(words: DataFrame, table: DataFrame, byte_base: int, objective: str = "merges") -> DataFrame:
    """words (word, keys..., ...) with distinct words, or distinct (word, part) -> (word, ids array<int>, first of the other columns).

    byte_base is the id of byte 0; the ids of bytes follow one another.
    """
    keys = [c for c in ("word", "part") if c in words.columns]
    others = [c for c in words.columns if c not in keys]
    # Substrings by start and length; the other columns ride on the first of them only.
    at = words.where(F.length("word").between(1, LONGEST)).select(*keys, *others, F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    at = at.select(*keys, "i", *[F.when(F.col("i") == 0, F.col(c)).alias(c) for c in others])
    # Single characters stay without a piece too (id -1): they become bytes.
    # For merges the characters below 256 need no edge of their own (but the first, which carries the rest): their ids stand in
    # an array by code point.
    common = lambda c: F.ascii(c) < 256
    starts = table.where(F.length("piece") >= PREFIX).groupBy(F.substring("piece", 1, PREFIX).alias("prefix")).agg(F.max(F.length("piece")).alias("most"))
    with_starts = at.withColumn("prefix", F.substring(F.col("word"), F.col("i") + 1, F.lit(PREFIX))).join(F.broadcast(starts), "prefix", "left")
    most = F.least(F.coalesce("most", F.lit(PREFIX - 1)), F.length("word") - F.col("i"))
    spans = with_starts.select(*keys, "i", *others, F.explode(F.sequence(F.lit(1), most)).alias("n"))
    lattice = spans.select(*keys, "i", "n", F.substring("word", F.col("i") + 1, F.col("n")).alias("piece"), *[F.when(F.col("n") == 1, F.col(c)).alias(c) for c in others])
    if objective == "merges":
        lattice = lattice.where((F.col("n") > 1) | (F.col("i") == 0) | ~common(F.col("piece")))
    known = {r.piece: r.id for r in table.where("length(piece) = 1").collect()}  # the model's characters
    by_code = F.array(*[F.lit(known.get(chr(c), -1)) for c in range(256)])
    edges = lattice.join(F.broadcast(table), "piece", "left").where("n = 1 OR id IS NOT NULL")
    near, far = _bit(F.col("i")), _bit(F.col("i") + F.col("n"))
    edge = F.struct((-F.col("score")).alias("rank"), near.bitwiseOR(far).alias("tips"), (far - near - near).alias("inner"), F.coalesce("id", F.lit(-1)).alias("id"))
    grouped = edges.groupBy(*keys).agg(F.collect_list(edge).alias("edges"), *[F.first(c, ignorenulls=True).alias(c) for c in others])
    usable = F.filter("edges", (lambda e: e["inner"] != 0) if objective == "merges" else (lambda e: e["id"] >= 0))
    ends = bind(usable, lambda e: (_merge_fold if objective == "merges" else _viterbi_fold)(e, F.length("word")))

    def bytes_of(tips: Column) -> Column:
        place = F.bit_count(tips.bitwiseAND(-tips) - 1)
        code = F.hex(F.encode(F.substring(F.col("word"), place.cast("int") + 1, F.lit(1)), "UTF-8"))
        return bind(code, lambda c: F.transform(F.sequence(F.lit(1), F.length(c), F.lit(2)), lambda q: F.conv(F.substring(c, q, F.lit(2)), 16, 10).cast("int") + byte_base))

    def ids_of(mask: Column) -> Column:
        taken = F.filter("edges", lambda e: (mask.bitwiseAND(e["tips"]) == e["tips"]) & (mask.bitwiseAND(e["inner"]) == 0))
        taken = F.transform(taken, lambda e: F.struct(e["tips"].alias("tips"), e["id"].alias("id")))
        if objective == "merges":
            # Bit i of single is set if the segment from i is one character.
            places = bind(mask.bitwiseAND(F.shiftright(mask, 1)), lambda single: F.filter(F.sequence(F.lit(1), F.length("word") - 1), lambda i: (F.getbit(single, i) == 1) & common(F.substring(F.col("word"), i + 1, F.lit(1)))))
            places = F.when(F.length("word") > 1, places).otherwise(F.array().cast("array<int>"))
            taken = F.concat(taken, F.transform(places, lambda i: F.struct((_bit(i) * 3).alias("tips"), F.get(by_code, F.ascii(F.substring(F.col("word"), i + 1, F.lit(1)))).alias("id"))))
        ordered = F.array_sort(taken)
        mixed = lambda o: F.flatten(F.transform(o, lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(bytes_of(e["tips"]))))
        return bind(ordered, lambda o: F.when(F.exists(o, lambda e: e["id"] < 0), mixed(o)).otherwise(F.transform(o, lambda e: e["id"])))

    return grouped.select("word", bind(ends, ids_of).alias("ids"), *others)


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches of one split, each with its block: the split's number and how many times `BLOCK_CHARS` came before."""
    seen = 0
    for b in batches:
        if not b.num_rows:
            continue
        split, at, size, block = b.column(0)[0].as_py() << 20, 0, 0, 0
        for k, n in enumerate(pc.utf8_length(b.column(text_at)).fill_null(0).to_pylist()):
            here = seen // BLOCK_CHARS
            if k > at and (here != block or size >= SLICE_CHARS):
                yield split + block, b.slice(at, k - at)
                at, size = k, 0
            block, seen, size = here, seen + n, size + n
        yield split + block, b.slice(at)


def _distinct_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct chunks of each block, each once."""
        m, seen, met, last = model(path), set(), set(), None
        for block, b in _blocks(batches, 1):
            if block != last:
                seen, met, last = set(), set(), block
            found = set().union(*(parts(t.as_py() or "") for t in b.column(1))) - met
            met |= found
            # All parts in one string, as no chunk reaches from one into the next; those of blanks alone would.
            blank = {p for p in found if not p.strip(" ")}
            new = set(m.chunk.findall("".join([p if p[0] == " " else f" {p}" for p in found - blank]).replace(" ", MARK)))
            new.update(*(part_chunks(p, m) for p in blank))
            new -= seen
            seen |= new
            words = [w for w in new if len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([block] * len(words), pa.int64())], names=["word", "block"])

    return run


def _dictionary(folder: str, block: int) -> dict[str, bytes]:
    store, root = pafs.FileSystem.from_uri(f"{folder}/block={block}")
    if store.get_file_info(root).type == pafs.FileType.NotFound:
        return {}
    t = pads.dataset(root, filesystem=store, format="parquet").to_table(columns=["word", "ids"])
    return dict(zip(t.column("word").to_pylist(), t.column("ids").to_pylist(), strict=True))


def _spell(w: str, m: Model) -> bytes:
    """The library's ids of a chunk: it puts a blank in front itself; a chunk without one follows a line end, which is one byte."""
    if w[0] == MARK:
        ids = m.sp.encode(w[1:].replace(MARK, " ")) if len(w) > 1 else [m.sp.piece_to_id(MARK)]
    else:
        ids = m.sp.encode("\n" + w)[2:]
    return np.array(ids, dtype=">u2").tobytes()


def _assemble(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, last = model(path), None
        inner, met, helped = {}, {}, {}
        spelt = pa.array(m.bytes, pa.binary())
        for block, b in _blocks(batches, 2):
            if block != last:
                # A part that is one chunk has that chunk's ids; others are put beside them when they are met.
                words = _dictionary(folder, block)
                inner, last, helped = {w: x for w, x in words.items() if w[0] != MARK}, block, {}
                met = {w[1:]: x for w, x in words.items() if w[0] == MARK}
                del words

            def put(part: str) -> None:
                ids, lacking = [], 0
                for w in part_chunks(part, m):
                    x = met.get(w[1:]) if w[0] == MARK else inner.get(w)
                    if x is None:
                        x, lacking = _spell(w, m), lacking + 1
                    ids.append(x)
                met[part] = b"".join(ids)
                if lacking:
                    helped[part] = lacking

            texts = [t or "" for t in b.column(2).to_pylist()]
            coded, library = [], []
            for text in texts:
                cut = parts(text)
                for part in set(cut).difference(met):
                    put(part)
                coded.append(b"".join(map(met.__getitem__, cut)))
                library.append(sum(helped.get(part, 0) for part in cut) if helped else 0)
            sizes = np.array([len(x) // 2 for x in coded], np.int64)
            ids = np.frombuffer(b"".join(coded), dtype=">u2").astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(_same(ids, ends, spelt, texts)), pa.array(library, pa.int32())],
                names=["doc_id", "n_pieces", "ids", "decodes", "n_library"],
            )

    return run


def _same(ids: np.ndarray, ends: np.ndarray, spelt: pa.Array, texts: list[str]) -> list[bool]:
    """Whether the ids of each text decode to it: their pieces' bytes one after another, less the blank in front."""
    taken = spelt.take(pa.array(ids))
    data = taken.buffers()[2] if len(ids) else None
    at = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1][ends] if len(ids) else np.zeros(len(ends), np.int32)
    out = []
    for k, text in enumerate(texts):
        got = data[int(at[k]) : int(at[k + 1])].to_pybytes() if data is not None else b""
        out.append(got.removeprefix(b" ") == text.encode("utf-8", "surrogatepass"))
    return out


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids, decodes (the ids give the text again), n_library (chunks that the lattice lacks) of each row of docs."""
    spark, m = docs.sparkSession, model(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not docs.inputFiles() or "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        rows = settle(rows, "pieces-docs")
    rows = rows.select(F.spark_partition_id().alias("split"), "doc_id", "text")
    splits = max(1, rows.rdd.getNumPartitions())
    pairs = rows.select("split", "text").mapInArrow(_distinct_words(path), "word string, block long")
    # Each word becomes some twenty edges, so there are more and smaller partitions than of the input.
    pairs = pairs.withColumn("part", F.shiftright(F.col("block"), 20) % F.greatest(F.lit(1), F.lit(-(-splits // BLOCKS_IN_ROW))))
    pairs = pairs.repartition(4 * splits, "word", "part")
    words = pairs.groupBy("word", "part").agg(F.collect_list("block").alias("blocks"))
    coded = encoded_words(words, m.table(spark), m.byte_ids[0], m.objective)
    binary = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 4, "0")), ""))
    folder = scratch(spark, "piece-words")
    coded.select("word", binary.alias("ids"), F.explode("blocks").alias("block")).repartitionById(splits, F.shiftright("block", 20).cast("int")).write.partitionBy("block").parquet(folder)
    return rows.mapInArrow(_assemble(folder, path), "doc_id long, n_pieces int, ids array<int>, decodes boolean, n_library int")


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """coded (ids array<int>, ...) with a column text of what the ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    rows = coded.drop("text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
