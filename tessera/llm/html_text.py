"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements with their style (tag, class, id and role, numbers aside).
Every node with text of its own, in <article> and <main> too and at any depth, has an importance from two entropies. Content: one
less the mean, over the distinct blocks of text that the host's pages have in the node, of the entropy of a block's spread over those
pages; what every page repeats is noise, what one page says is content. Presentation: the entropy of the ways in which pages fill the
node (the sequences of its children). Their mixture, as log-odds relative to that of the whole host (so that many copies of a page
don't count against its text), is the tree's evidence for the node. It grows with the number of pages of the host that have the node;
what a small host lacks is made up for by the same node's evidence over all hosts.

The markup's meaning is a prior that adds to this evidence: <nav>, <footer>, <aside>, forms and the like, and names such as "comments"
or "ad" as a whole class, count heavily, as their texts may differ on every page and are still no main text; parts of compound names
and vague names ("side", "search") count little, so that the tree decides; names of headings, paragraphs and sections within
<article> and <main> don't count. A node whose sum is not above zero is cut from every page of the host. Scripts, styles and controls are
no text at all.

Cases: null and empty html have no text; markup cut off in the middle ends with what came before it; repeated pages count as
pages each; unclosed and wrongly nested elements are closed where the next block starts; a null url is a host of its own; time and
memory for a page are in proportion to its length, however deep it nests; other columns are not read; no pages give no rows.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html head li main menu nav ol optgroup option p pre section summary table caption tbody thead tfoot tr td th title ul".split())
#: Elements whose content is no text.
NO_TEXT = frozenset("script style noscript template iframe button select option textarea input label head title svg math object canvas".split())
#: Log-odds of an element's being main text by its tag, outside and within <article> and <main>.
TAG_PRIOR = {"nav": (-5.0, -5.0), "menu": (-5.0, -5.0), "header": (-5.0, -0.5), "footer": (-5.0, -3.0), "aside": (-5.0, -5.0), "form": (-5.0, -5.0), "fieldset": (-5.0, -5.0), "dialog": (-5.0, -5.0)}
#: Names of what isn't main text, and vague ones.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav rail widget widgets related recommended share sharing social breadcrumb breadcrumbs menu menubar navbar nav navigation toolbar header masthead topbar footer pagination pager comment comments commentlist reply replies respond disqus complementary contentinfo".split()
)
VAGUE_WORDS = frozenset("side search form hidden copyright legal discussion".split())
#: Log-odds of a whole name, of a part of a compound name, and of a vague name; of being within <article> or <main>; of any text.
NAME, PART, VAGUE, MAIN, TEXT = -5.0, -2.5, -1.5, 1.5, 1.1
MAIN_TAGS = frozenset(("article", "main"))
#: Elements whose class or id says nothing within <article> or <main>.
PLAIN_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
#: First parts of names that tell what else the page has, as in has-sidebar.
TELLING = frozenset(("has", "with", "no"))
CLOSED_BY = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
SCOPE = frozenset("article aside body div footer form header main nav ol section table td th ul html".split())
#: Share of content in a node's importance, pages that weigh as much as the other hosts, and the largest log-odds.
GAMMA, OTHERS, MOST = 0.9, 8.0, 3.5


class Block:
    """A block of text with its node (hash of the path of elements) and the node's prior."""

    __slots__ = ("node", "prior", "text")

    def __init__(self, node: int, prior: float, text: str):
        self.node, self.prior, self.text = node, prior, text


def _name_prior(marks: list[tuple[str, ...]], main: bool) -> float:
    """Prior of class, id and role: of whole names, and outside the main text of their parts but for names like has-sidebar."""
    names = [re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower() for x in marks for n in (x[1] or x[2] or x[3]).split()]
    if not names:
        return 0.0
    if not NOISE_WORDS.isdisjoint(names):
        return NAME
    if main:
        return 0.0
    found = 0.0
    for n in names:
        parts = [w for w in re.split("[^a-z0-9]+", n) if w]
        if not parts or parts[0] in TELLING:
            continue
        if len(parts) == 1:
            found = min(found, VAGUE if parts[0] in VAGUE_WORDS else 0.0)
        elif not NOISE_WORDS.isdisjoint(parts):
            found = min(found, PART)
        elif not VAGUE_WORDS.isdisjoint(parts):
            found = min(found, VAGUE)
    return found


def blocks(page: str) -> tuple[list[Block], dict[int, list[int]]]:
    """All blocks of text in page order, and for each node the tags of its children."""
    out: list[Block] = []
    children: dict[int, list[str]] = {}
    # Of each open element: tag, hash of its path, prior, whether a tag made it noise, within main, no text, node of its blocks.
    stack: list[tuple[str, int, float, bool, bool, bool, int]] = []
    top = ("", 0, 0.0, False, False, False, 0)
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                at = stack[-1] if stack else top
                out.append(Block(at[6], at[2], text))

    def close(depth: int) -> None:
        if len(stack) > depth:
            if any(s[0] in BLOCKS or s[6] == s[1] for s in stack[depth:]):
                flush()
            del stack[depth:]

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not (stack and stack[-1][5]):
            buffer.append(_html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    close(d)
                    break
                if stack[d][0] in SCOPE and tag not in SCOPE:
                    break
            if tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        for d in range(len(stack) - 1, -1, -1):
            if tag in CLOSED_BY.get(stack[d][0], ()):
                close(d)
                break
            if stack[d][0] in SCOPE:
                break
        above = stack[-1] if stack else top
        children.setdefault(above[1], []).append(tag)
        if tag in VOID:
            continue
        marks = MARKED.findall(m[3] or m[6] or "")
        style = ".".join(re.sub("[0-9]+", "0", x[1] or x[2] or x[3]) for x in marks)
        node = xxhash.xxh64_intdigest(f"{above[1]}/{tag}.{style}") >> 1
        prior, by_tag, main = above[2], above[3], above[4]
        if tag in MAIN_TAGS and not by_tag:
            prior, main = (MAIN if not main else prior), True
        elif tag in TAG_PRIOR:
            own = TAG_PRIOR[tag][main] + MAIN * main
            by_tag, prior = by_tag or own <= NAME + MAIN, min(prior, own)
        elif tag not in ("body", "html") and not (main and tag in PLAIN_TAGS):
            named = _name_prior(marks, main)
            prior = min(prior, named + MAIN * main) if named else prior
        if prior != above[2] and tag not in BLOCKS:
            flush()
        stack.append((tag, node, prior, by_tag, main, above[5] or tag in NO_TEXT, node if tag in BLOCKS or prior != above[2] else above[6]))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
    close(0)
    flush()
    return out, children


STATISTICS = "host string, node long, prior double, what int, value long, times long"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, node, prior, what, value, times) of each page: the blocks of each node (what 0), and the sequence of its children (1)."""
    for b in batches:
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found, children = blocks(page.as_py() or "")
            times: dict[tuple[int, int], int] = {}
            priors: dict[int, float] = {}
            for x in found:
                key = x.node, xxhash.xxh64_intdigest(x.text) >> 1
                times[key] = times.get(key, 0) + 1
                priors[x.node] = x.prior
            for (node, value), k in times.items():
                for c, v in zip(columns, (host, node, priors[node], 0, value, k), strict=True):
                    c.append(v)
            for node, prior in priors.items():
                for c, v in zip(columns, (host, node, prior, 1, xxhash.xxh64_intdigest(" ".join(children.get(node, []))) >> 1, 1), strict=True):
                    c.append(v)
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in STATISTICS.split(", ")])


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]+)", 1)), F.lit(""))


def _importance(each: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pages, importance (0 to 1; null with one page) of each node from its values (t: total, klogk, pages)."""
    node = each.groupBy(*keys).agg(
        F.first("prior").alias("prior"),
        F.sum(F.when(F.col("what") == 1, F.col("pages"))).alias("pages"),
        F.sum(F.when(F.col("what") == 0, F.log("t") - F.col("klogk") / F.col("t"))).alias("h"),
        F.sum((F.col("what") == 0).cast("long")).alias("l"),
        F.sum(F.when(F.col("what") == 1, F.col("t") * F.log("t"))).alias("tlogt"),
    )
    m = F.log("pages")
    content = 1 - F.col("h") / F.col("l") / m
    presentation = (m - F.col("tlogt") / F.col("pages")) / m
    return node.withColumn("importance", F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), F.lit(GAMMA) * content + (1 - GAMMA) * presentation)))


def _log_odds(share: Column) -> Column:
    edge = 1 / (1 + math.exp(MOST))
    p = F.least(F.greatest(share, F.lit(edge)), F.lit(1 - edge))
    return F.log(p / (1 - p))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, prior, pages, importance, evidence, keep) of each node with text of its own."""
    rows = pages.select(_host().alias("host"), "html").mapInArrow(_statistics, STATISTICS)
    # Of each value (a block of text, or a sequence of children): total over pages and the sum of k log k of each page's k.
    each = rows.groupBy("host", "node", "what", "value").agg(F.first("prior").alias("prior"), F.sum("times").alias("t"), F.sum(F.col("times") * F.log("times")).alias("klogk"), F.count(F.lit(1)).alias("pages"))
    each = settle(each, "style-values")
    own = settle(_importance(each, ["host", "node"]), "style-nodes")
    everywhere = _importance(each.groupBy("node", "what", "value").agg(F.first("prior").alias("prior"), F.sum("t").alias("t"), F.sum("klogk").alias("klogk"), F.sum("pages").alias("pages")), ["node"])
    # A host's level: the mean over its nodes, by their number of distinct blocks.
    level = own.where("importance IS NOT NULL").groupBy("host").agg((F.sum(F.col("importance") * F.col("l")) / F.sum("l")).alias("level"))
    joined = own.join(everywhere.select("node", F.col("importance").alias("of_all"), F.col("pages").alias("all_pages")), "node").join(level, "host", "left")
    base = F.least(F.lit(0.0), F.coalesce(_log_odds(F.col("level")), F.lit(0.0)))
    mine = (F.col("pages") - 1) / (F.col("pages") - 1 + OTHERS)
    theirs = (1 - mine) * (F.col("all_pages") - 1) / (F.col("all_pages") - 1 + OTHERS)
    evidence = mine * F.coalesce(_log_odds(F.col("importance")) - base, F.lit(0.0)) + theirs * F.coalesce(_log_odds(F.col("of_all")) - base, F.lit(0.0))
    scored = joined.withColumn("evidence", F.least(F.greatest(evidence, F.lit(-MOST)), F.lit(MOST)))
    return scored.select("host", "node", "prior", "pages", "importance", "evidence", (F.col("prior") + F.col("evidence") + TEXT > 0).alias("keep"))


def decided(tree: DataFrame) -> DataFrame:
    """(host, node) of the nodes whose evidence overrules their prior."""
    return tree.where(F.col("keep") != (F.col("prior") + TEXT > 0)).select("host", "node")


def page_text(page: str | None, overruled: frozenset | set = frozenset()) -> str:
    """The text of a page; the priors decide but for the overruled nodes, where the contrary holds."""
    return "\n".join(b.text for b in blocks(page or "")[0] if (b.prior + TEXT > 0) != (b.node in overruled))


def _extract(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overruled: dict[str, set] = {}
        for host, node in sent.value if sent is not None else ():
            overruled.setdefault(host, set()).add(node)
        for b in batches:
            own = b.column(4).to_pylist() if b.num_columns > 4 else None
            texts = [page_text(p.as_py(), set(own[i] or ()) if own is not None else overruled.get(h, frozenset())) for i, (h, p) in enumerate(zip(b.column(2).to_pylist(), b.column(3), strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame, most_sent: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Up to `most_sent` overruled nodes (3 MB) go to all tasks; more are joined to the pages that have them.
    """
    overruled = settle(decided(style_tree(pages)), "style-tree")
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host().alias("host"), "html")
    few = overruled.limit(most_sent + 1).collect()
    if len(few) <= most_sent:
        return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast([tuple(r) for r in few])), schema)
    there = rows.select("host", F.xxhash64("html").alias("key"), "html").mapInArrow(_nodes, "host string, key long, node long")
    per_page = there.join(overruled, ["host", "node"]).groupBy("host", "key").agg(F.collect_set("node").alias("nodes"))
    keyed = rows.withColumn("key", F.xxhash64("html")).join(per_page, ["host", "key"], "left").select("page_id", "url", "host", "html", "nodes")
    return keyed.mapInArrow(_extract(None), schema)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(h, k, n) for h, k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for n in {x.node for x in blocks(p.as_py() or "")[0]}]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "key", "node"])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages"))
