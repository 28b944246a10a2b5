"""Personal data: fixed patterns, widened by bootstrapped contextual extraction.

The fixed patterns (e-mail, IPv4, payment card, phone) give the seeds. Mentions that look like identifiers (something around
an @ or its spelt-out form, or six digits and more with separators), seeds or not, are instances; the words around a mention,
with whether it is of the @ kind or a number, are its lexical patterns. Spark scores the graph of patterns and instances in
rounds: a pattern's confidence for a kind is the share of its distinct instances that are known to be of that kind, if at
least `LEAST_KNOWN` are. The patterns of one mention overlap, so the surest of them speaks for it, and mentions with the same words around
them speak once; an instance that isn't known yet is adopted if its mentions together make its kind likely enough, and is known in the next
round. Rounds go on until none is adopted (beyond `MOST_ROUNDS` the run fails rather than stop early). Mentions of adopted instances are added to the spans of the fixed patterns, which all stay.

Cases: null and empty texts have no spans, an empty table gives no rows; repeated rows get the same spans; an added span never
overlaps a fixed one; spans count code points, the end exclusive; scanning takes time in proportion to a text's length, also for
long runs of letters, digits or signs, and an identifier may be of any length; of a neighbouring word the `NEAR_CHARS` characters
next to the mention count; other columns, whatever their names, pass through `masked` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, keyed, settle

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole by the fixed pattern, so a match can start only where a run starts.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: What may be an identifier. A match starts where a run of such characters does, so no run is read twice.
MENTION = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]++|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9.-]++|(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,}+")
#: Marks at the ends of an @ mention that are no part of it.
OUTER = ".,;:!?\"'()[]{}<>#*$%&|"
#: Characters of each neighbouring word that count, and how far it is looked for.
NEAR_CHARS, NEAR = 40, 200
LEAST_KNOWN, PATTERN_CONFIDENCE, INSTANCE_CONFIDENCE, MOST_ROUNDS = 4, 0.8, 0.9, 100
#: Parts into which the links of a pattern or an instance are dealt, as one may hold a third of all.
SALTS = 16


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        domain = DOMAIN.match(text, at + 1)
        if domain:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two words before and the two after a mention, in lower case, "^" and "$" where there is none."""
    left, right = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    before, after = left.split(), right.split()
    # A few characters that touch the mention, such as quotation marks, belong to its own word.
    if before and not left[-1].isspace() and len(before[-1]) <= 8:
        before.pop()
    if after and not right[0].isspace() and len(after[0]) <= 8:
        after.pop(0)
    before, after = [w[-NEAR_CHARS:].lower() for w in before[-2:]], [w[:NEAR_CHARS].lower() for w in after[:2]]
    return ["^"] * (2 - len(before)) + before, after + ["$"] * (2 - len(after))


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind or -1, start, end, instance, patterns) of what may be an identifier; kinds come from the fixed patterns."""
    found = [(k, a, b) for k, a, b in base]
    if "@" in text or DIGIT.search(text) or "(at)" in text or "[at]" in text:
        taken = sorted((a, b) for _, a, b in base)
        at = 0
        for m in MENTION.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                a, b = m.start(), m.end() - len(m[0]) + len(m[0].rstrip(OUTER))
                if "@" in m[0]:
                    a += len(m[0]) - len(m[0].lstrip(OUTER))
                if a < b:
                    found.append((-1, a, b))
    out = []
    for k, a, b in found:
        mention = text[a:b]
        kind = "9" if mention.lower() == mention.upper() and "@" not in mention else "@"
        (l2, l1), (r1, r2) = _near(text, a, b)
        patterns = [f"{l2} {l1} {kind}", f"{l1} {kind} {r1}", f"{kind} {r1} {r2}", f"{l2} {l1} {kind} {r1}"]
        hashed = [xxhash.xxh64_intdigest(p) >> 1 for p in patterns]
        out.append((k, a, b, xxhash.xxh64_intdigest(re.sub(r"[\s().-]", "", mention.lower())) >> 1, hashed))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, found = [], []
        for t in b.column(2):
            text = t.as_py() or ""
            base = base_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
            found.append([dict(zip(("kind", "start", "end", "instance", "patterns"), m, strict=True)) for m in mentions(text, base)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION))], names=["doc_id", "text_hash", "base", "mentions"])


SCANNED = "doc_id long, text_hash long, base array<struct<kind:int,start:int,end:int>>, mentions array<struct<kind:int,start:int,end:int,instance:bigint,patterns:array<bigint>>>"


def _matched(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """many joined to few (a row or two for each key) on key, with each key dealt to `SALTS` parts by a hash of `by`."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # Never broadcast: the copies of the smaller side grow with the corpus.
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few.select("*", salts).hint("merge"), [key, "salt"]).drop("salt")


def adopted(found: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """found (kind, instance, patterns) of each mention -> (instance, kind) of instances that patterns, not the fixed rules, make known."""
    edges = settle(found.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    links = settle(edges.select("instance", "pattern").distinct(), "pii-links")
    size = settle(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pii-sizes")
    known = settle(edges.where("kind >= 0").select("instance", "kind").distinct(), "pii-known")
    seeds = known
    # What surrounds the mentions that no fixed rule matches; a context is all patterns of a mention.
    contexts = settle(found.where("kind < 0").select("instance", F.xxhash64("patterns").alias("context"), F.explode("patterns").alias("pattern")).distinct(), "pii-contexts")
    for _ in range(most_rounds):
        hits = _matched(links, known, "instance", "pattern").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_KNOWN)
        sure = hits.join(size, "pattern").withColumn("confidence", F.col("k") / F.col("n")).where(F.col("confidence") >= PATTERN_CONFIDENCE).select("pattern", "kind", "confidence")
        # Patterns all of whose instances are known can't adopt any.
        sure = sure.where("confidence < 1")
        open_ = contexts.join(known.select("instance").distinct(), "instance", "left_anti")
        best = _matched(open_, sure, "pattern", "instance").groupBy("instance", "context", "kind").agg(F.max("confidence").alias("confidence"))
        doubt = best.groupBy("instance", "kind").agg(F.sum(F.log(1 - F.col("confidence"))).alias("l"))
        likely = doubt.where(1 - F.exp("l") >= INSTANCE_CONFIDENCE).groupBy("instance").agg(F.min(F.struct("l", "kind")).alias("b")).select("instance", F.col("b.kind").alias("kind"))
        likely = settle(likely, "pii-new")
        if not likely.limit(1).count():
            return known.join(seeds.select("instance").distinct(), "instance", "left_anti")
        known = settle(known.union(likely), "pii-known")
    raise RuntimeError(f"patterns still adopt instances after {most_rounds} rounds")


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans) of each row: the spans of the fixed patterns, and all spans, by kind and start."""
    scanned = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_scan, SCANNED), "pii")
    each = scanned.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    new = adopted(each.select("kind", "instance", "patterns"))
    more = _matched(each.where("kind < 0").drop("kind"), new, "instance", "text_hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = more.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "more")
    out = scanned.join(more, scanned["doc_id"].eqNullSafe(more["id"]) & (scanned["text_hash"] == more["hash"]), "left")
    return out.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("spans"))


def _mask(columns: list[str]):
    text_at, chars_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            out = b.column(0).flatten()
            for t, spans in zip(out[text_at], b.column(1), strict=True):
                text, found = t.as_py(), spans.as_py()
                if text is not None and found:
                    parts, at = [], 0
                    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                sizes.append(None if text is None else len(text))
            out[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                out[chars_at] = pa.array(sizes, pa.int64()).cast(out[chars_at].type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return run


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, n_chars (if there) set anew; all rows and columns stay."""
    s = found_spans(docs).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.first("spans").alias("spans"))
    s = settle(s, "pii-spans")
    rows = keyed(docs)
    both = rows.join(s, rows["id"].eqNullSafe(s["of_id"]) & (rows["hash"] == s["of_hash"]), "left").select("row", s["spans"])
    return both.mapInArrow(_mask(docs.columns), docs.schema)


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: int) -> Column:
    # A lambda of two parameters would get the index as its second.
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the fixed patterns, hash of their spans, and all spans, of every document."""
    f = found_spans(documents(spark, sf_dir))
    base = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return f.select("doc_id", *base, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
