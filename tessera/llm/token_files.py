"""Token ids in files: shards of separately compressed documents that share a trained zstandard dictionary.

A shard holds the documents of a range of doc_id in ascending order:

    magic b"TSRA1\n", then frames one after another, then the index, then a footer of 4 little-endian 64-bit numbers:
    where the index starts, number of documents, number of ids, hash of the dictionary (XXH64, seed 0).
    index: zstandard frame of three little-endian 64-bit arrays: doc_id, where each frame ends, ids up to and with each document.

A frame is the zstandard compression, with the shared dictionary, of a document's ids as little-endian unsigned numbers of
16 bits (32 if the vocabulary needs it). Any one document can be read from its offset with the dictionary alone. The
dictionary is stored beside the shards under its hash. A task writes a shard under a name of its own attempt and renames it
when complete; only shards that the manifest lists are read, so lost or repeated attempts leave nothing behind that counts.

Cases: null and empty texts are the end id alone; a null doc_id sorts first; repeated rows are each written; a very long
text is encoded piece by piece at white space; no documents give no shards.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, scratch, settle

MAGIC = b"TSRA1\n"
END_ID = 2
NULL_ID = -(1 << 63)
#: The dictionary is trained on the ids (4096 at most of each) of so many documents, those with the smallest hash of their doc_id.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 400, 4096, 64 << 10
#: Words, and their parts, whose ids a worker remembers from task to task (some 300 MB), those of up to so many characters only.
CACHE_WORDS, CACHE_PARTS, CACHE_CHARS = 500_000, 1_200_000, 48
#: Documents encoded at a time.
DOCS_AT_ONCE = 256
#: Marks that end a word and that the tokenizer parts from its letters.
SPACE, ODD = re.compile("[ \t\n\x0b\x0c\r]+"), re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MARKS = ".,;:!?*#%&$|)\"-"

_CACHE: dict[str, dict[str, bytes]] = {}
_TOKENIZER: dict[str, object] = {}
_HABITS: dict[str, tuple[bool, bool]] = {}


def tokenizer(path: str):
    if path not in _TOKENIZER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZER[path] = Tokenizer.from_file(path)
    return _TOKENIZER[path]


def _ids(tok, text: str) -> list[int]:
    return tok.encode(text, add_special_tokens=False).ids


def habits(path: str) -> tuple[bool, bool]:
    """Whether the tokenizer drops white space and never merges across it, and whether it also lower-cases and takes marks at a word's end apart.

    Both are told from its answers to probes; a tokenizer without them gets whole texts, or whole words.
    """
    if path not in _HABITS:
        tok, words = tokenizer(path), ["word", "Abc", "naïve", "x1", "É", "end.", "a-b", "日本"]
        apart = all(_ids(tok, f"{a}{s}{b}") == _ids(tok, a) + _ids(tok, b) for a in words for b in words for s in (" ", "\n", "\t  "))
        some = ["word", "Éa", "straße"]
        lower = all(_ids(tok, w) == _ids(tok, w.lower()) for w in ("Word", "ÉA", "GROẞ", "ABC"))
        ends = ["".join(m) for k in (1, 2) for m in itertools.product(MARKS, repeat=k)]
        _HABITS[path] = apart, apart and lower and all(_ids(tok, w + e) == _ids(tok, w) + _ids(tok, e) for w in some for e in ends)
    return _HABITS[path]


def _parts(word: str) -> tuple[str, str]:
    """A word as letters and closing marks, which the tokenizer takes apart too; or as it is, and nothing.

    Only letters with a simple lower case are put in it, as the tokenizer does.
    """
    core = word.rstrip(MARKS)
    if core.isalpha() and "\u03a3" not in core and "\u0130" not in core:
        return core.lower(), word[len(core) :]
    return word, ""


def _spell(parts: list[str], tok, known: dict[str, bytes]) -> None:
    for at in range(0, len(parts), 4096):
        group = parts[at : at + 4096]
        for w, e in zip(group, tok.encode_batch_fast(group, add_special_tokens=False), strict=True):
            known[w] = array("H", e.ids).tobytes()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 16-bit numbers.

    If the tokenizer drops white space and never merges across it, a text's ids are those of its words one after another,
    and each distinct word needs to be encoded once.
    """
    tok, known, parts = tokenizer(path), _CACHE.setdefault(path, {}), _CACHE.setdefault(f"{path}/parts", {"": b""})
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("this encoder needs a vocabulary of at most 65,536 ids")
    apart, marked = habits(path)
    if not apart:
        return [array("H", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    # Only ASCII white space: of the wider set, the tokenizer takes some marks for text.
    split = [SPACE.split(t.strip(" \t\n\x0b\x0c\r")) if ODD.search(t) else t.split() for t in texts]
    if len(known) > CACHE_WORDS:
        known.clear()
    if len(parts) > CACHE_PARTS:
        parts.clear()
        parts[""] = b""
    new = {w: _parts(w) if marked else (w, "") for w in set(itertools.chain.from_iterable(split)) if w not in known}
    _spell([p for p in {p for pair in new.values() for p in pair} if p not in parts], tok, parts)
    found = {w: parts[a] + parts[b] for w, (a, b) in new.items()}
    long = {w: x for w, x in found.items() if len(w) > CACHE_CHARS}
    known.update((w, x) for w, x in found.items() if len(w) <= CACHE_CHARS)
    for w in [p for p in parts if len(p) > CACHE_CHARS] if long else ():
        del parts[w]
    if not long:
        return [b"".join(map(known.__getitem__, words)) for words in split]
    return [b"".join([known[w] if len(w) <= CACHE_CHARS else long[w] for w in words]) for words in split]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u2").tobytes()
        for b in batches:
            # The way to the file goes through a shuffle: plain compression keeps it small there.
            pack = zstandard.ZstdCompressor(level=1)
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                part = b.slice(at, DOCS_AT_ONCE)
                ids = [pack.compress(x + end) for x in encode_texts([t or "" for t in part.column(1).to_pylist()], path)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unpack.decompress(x.as_py())[: 2 * SAMPLE_IDS] for x in b.column(1)], pa.binary())], names=["doc_id", "ids"])


def train_dictionary(encoded: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample; fewer than 8 documents, or too little text, give an empty one."""
    # The ids are chosen first, and each text's are cut before they come to the driver.
    chosen = [r.doc_id for r in encoded.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return b""
    first = encoded.where(F.col("doc_id").isin(chosen)).mapInArrow(_starts, "doc_id long, ids binary")
    samples = [bytes(r.ids) for r in first.groupBy("doc_id").agg(F.min("ids").alias("ids")).orderBy("doc_id").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=3)  # once, not for each document
    return zstandard.ZstdCompressor(level=3, dict_data=data)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _write(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        pack, unpack = _compressor(dictionary), zstandard.ZstdDecompressor()
        ids, ends, sums, out, place, total = [], [], [], None, len(MAGIC), 0
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/.{name}")
                    out.write(MAGIC)
                raw = unpack.decompress(x.as_py())
                frame = pack.compress(raw)
                out.write(frame)
                place, total = place + len(frame), total + len(raw) // 2
                ids.append(NULL_ID if doc is None else doc)
                ends.append(place)
                sums.append(total)
        if out is None:
            return
        out.write(zstandard.compress(np.array([ids, ends, sums], dtype="<i8").tobytes()))
        out.write(np.array([place, len(ids), total, 0], dtype="<u8").tobytes()[:24] + xxhash.xxh64_intdigest(dictionary).to_bytes(8, "little"))
        out.close()
        store.move(f"{root}/.{name}", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [name], "n_docs": [len(ids)], "n_ids": [total]}, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, docs_per_shard: int = 20_000) -> DataFrame:
    """Writes docs (doc_id, text) to shards in folder (any place that pyarrow's file systems reach) and returns the manifest (shard, file, n_docs, n_ids)."""
    spark = docs.sparkSession
    encoded = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, end_id), "doc_id long, ids binary"), "tokens")
    dictionary = train_dictionary(encoded)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary-{xxhash.xxh64_hexdigest(dictionary)}") as f:
        f.write(dictionary)
    shards = max(1, -(-encoded.count() // docs_per_shard))
    ordered = encoded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    manifest = ordered.mapInArrow(_write(folder, dictionary), "shard int, file string, n_docs long, n_ids long")
    done = settle(manifest, "manifest")
    done.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(done.schema).parquet(f"{folder}/manifest")


class Shard:
    """A shard file with its index; documents are read one by one."""

    def __init__(self, folder: str, file: str):
        self.store, self.root = pafs.FileSystem.from_uri(folder)
        self.file = self.store.open_input_file(f"{self.root}/{file}")
        size = self.file.size()
        self.file.seek(size - 32)
        place, n, self.n_ids, self.key = (int(x) for x in np.frombuffer(self.file.read(32), dtype="<u8"))
        self.file.seek(place)
        self.ids, self.ends, self.sums = np.frombuffer(zstandard.decompress(self.file.read(size - 32 - place)), dtype="<i8").reshape(3, n)
        with self.store.open_input_stream(f"{self.root}/dictionary-{self.key:016x}") as f:
            dictionary = f.read()
        if xxhash.xxh64_intdigest(dictionary) != self.key:
            raise ValueError("the dictionary doesn't match its hash")
        self.unpack = _decompressor(dictionary)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard."""
        at = int(self.ends[k - 1]) if k else len(MAGIC)
        self.file.seek(at)
        return np.frombuffer(self.unpack.decompress(self.file.read(int(self.ends[k]) - at)), dtype="<u2")

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document by its id (the first of that id), without reading any other."""
        k = int(np.searchsorted(self.ids, doc_id))
        return self.document(k) if k < len(self.ids) and self.ids[k] == doc_id else None


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Shard(folder, file)
                for lo in range(0, len(s.ids), 4096):
                    ks = range(lo, min(lo + 4096, len(s.ids)))
                    crc = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in ks]
                    starts = [before + (int(s.sums[k - 1]) if k else 0) for k in ks]
                    n = np.diff(s.sums[ks.start : ks.stop], prepend=s.sums[lo - 1] if lo else 0)
                    doc = [None if x == NULL_ID else x for x in s.ids[ks.start : ks.stop].tolist()]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each shard
    listed = manifest.select("file", before.alias("before"))
    return listed.repartition(max(1, manifest.count()), "file").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    import public_tokenizers

    folder = scratch(spark, "shards")
    return read_tokens(write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json")), folder)
