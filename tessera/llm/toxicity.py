"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, intent, target, negation, report, quote, word); an insult has its weight in the lexicon, a
threat a fixed one. Five small transducers, each with states and arcs (symbol read, symbol written, gain), are composed into one:

    reported: after a verb of speech, or within quotation marks, insults and threats lose most of their gain;
    negated:  so do those at most three words after a negation;
    insult:   writes an attack for an insult, with more gain right after another;
    threat:   writes an attack for a threat, in full only after a word of intent;
    target:   an attack with a person addressed in the same clause gains; where the person comes later the transducer
              bets on it, and the path only counts if it is found by the clause's end.

In the composition gains multiply. A path's score is the sum, over its words, of the word's weight times the arc's gain; a clause's
score is that of its best path (one state set moved along the words), and a document's evidence the sum over its clauses with an
attack. A logistic curve of the evidence is the score. Function words are listed; the insult lexicon (words and stems) and its
weights are learned from labelled rows that aren't held out: words and prefixes that toxic texts hold far more often than others.
How strong a term's evidence must be is chosen, and the curve fitted, by two-fold cross-validation among the same rows.

Learning takes a bounded sample of labelled rows, `MOST_ROWS` with the smallest hash of their doc_id; every text is scored
as a whole. Language, source and ids are no inputs.

Cases: null and empty texts, and texts without a match, get the score of no evidence; repeated rows get equal scores; without
toxic rows to learn from only the listed words count; an empty table gives no rows; a very long text takes time in proportion to its
length; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, settle

MOST_ROWS = 8000
#: Evidence (in nats beyond chance) that a term of the lexicon may be asked for; cross-validation chooses among them.
STRENGTHS = (6.0, 8.0, 10.0, 14.0, 20.0)
THRESHOLD = 0.7
#: Function words of the grammar, in English, German, French and Spanish.
NEGATION = frozenset("not never no nor isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ne pas jamais ni nunca jamás tampoco sin".split())
TARGET = frozenset("you your yours yourself u ur he she they him her them his their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti usted ustedes tus su".split())
REPORT = frozenset("said says wrote writes called calls quoted reported claims claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
INTENT = frozenset("will gonna going shall must should let werde werden muss soll vais allons veux faut voy vamos quiero debo".split())
THREAT = frozenset("kill hurt destroy beat burn stab shoot smash strangle murder töten umbringen schlagen verbrennen tuer frapper brûler égorger matar golpear quemar destruir".split())
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")
PREFIXES = (4, 5, 6)


SYMBOLS = ("insult", "threat", "intent", "target", "negation", "report", "quote", "word")
#: Gains of the arcs, and the weight of a threat.
REPORTED, NEGATED, STACKED, BARE_THREAT, AIMED, THREAT_WEIGHT = 0.4, 0.5, 1.2, 0.3, 1.25, 3.0


class Transducer:
    """Arcs (state, symbol read) -> [(next state, symbol written, gain)]; a symbol without arcs in a state passes through, in that state."""

    def __init__(self, start, arcs: dict, final):
        self.start, self.arcs, self.final = start, arcs, frozenset(final)

    def step(self, state, symbol: str) -> list[tuple]:
        return self.arcs.get((state, symbol)) or [(state, symbol, 1.0)]

    def then(self, other: Transducer, symbols=SYMBOLS) -> Transducer:
        """The composition: what self writes other reads, states are pairs, gains multiply."""
        start = (self.start, other.start)
        arcs, final, open_, seen = {}, set(), [start], {start}
        while open_:
            pair = a, b = open_.pop()
            if a in self.final and b in other.final:
                final.add(pair)
            for symbol in symbols:
                out = arcs[pair, symbol] = [((a2, b2), written, g * h) for a2, between, g in self.step(a, symbol) for b2, written, h in other.step(b, between)]
                for state, _, _ in out:
                    if state not in seen:
                        seen.add(state)
                        open_.append(state)
        return Transducer(start, arcs, final)


def _reported() -> Transducer:
    arcs: dict = {("plain", "report"): [("said", "word", 1.0)], ("plain", "quote"): [("quoted", "word", 1.0)], ("said", "quote"): [("both", "word", 1.0)], ("quoted", "quote"): [("plain", "word", 1.0)], ("quoted", "report"): [("both", "word", 1.0)], ("both", "quote"): [("said", "word", 1.0)]}
    for state in ("said", "quoted", "both"):
        arcs |= {(state, x): [(state, x, REPORTED)] for x in ("insult", "threat")}
    return Transducer("plain", arcs, ("plain", "said", "quoted", "both"))


def _negated() -> Transducer:
    arcs: dict = {}
    for left in range(4):
        arcs[left, "negation"] = [(3, "word", 1.0)]
        if left:
            arcs |= {(left, x): [(left - 1, x, NEGATED if x in ("insult", "threat") else 1.0)] for x in SYMBOLS if x != "negation"}
    return Transducer(0, arcs, range(4))


def _insults() -> Transducer:
    arcs: dict = {("plain", "insult"): [("after", "attack", 1.0)], ("after", "insult"): [("after", "attack", STACKED)]}
    arcs |= {("after", x): [("plain", x, 1.0)] for x in SYMBOLS if x != "insult"}
    return Transducer("plain", arcs, ("plain", "after"))


def _threats() -> Transducer:
    return Transducer("idle", {("idle", "intent"): [("bent", "word", 1.0)], ("idle", "threat"): [("idle", "attack", BARE_THREAT)], ("bent", "threat"): [("bent", "attack", 1.0)]}, ("idle", "bent"))


def _targets() -> Transducer:
    arcs: dict = {(state, "target"): [("seen", "word", 1.0)] for state in ("none", "seen", "owed")}
    arcs |= {("none", "attack"): [("none", "hit", 1.0), ("owed", "hit", AIMED)], ("seen", "attack"): [("seen", "hit", AIMED)], ("owed", "attack"): [("owed", "hit", AIMED)]}
    return Transducer("none", arcs, ("none", "seen"))


def grammar() -> Transducer:
    return _reported().then(_negated()).then(_insults()).then(_threats()).then(_targets())


class Machine:
    """A composed grammar with numbered states; only arcs that write "hit" add to a score."""

    def __init__(self, composed: Transducer):
        states = list(dict.fromkeys([composed.start, *(s for s, _ in composed.arcs)]))
        number = {s: i for i, s in enumerate(states)}
        self.start, self.final = number[composed.start], [s in composed.final for s in states]
        self.arcs = {(number[s], x): [(number[t], g if written == "hit" else 0.0) for t, written, g in out] for (s, x), out in composed.arcs.items()}

    def best(self, pairs: list[tuple[str, float]]) -> float:
        """The score of the best accepted path over (symbol, weight) pairs."""
        at = {self.start: 0.0}
        for symbol, weight in pairs:
            moved: dict[int, float] = {}
            for state, score in at.items():
                for target, gain in self.arcs[state, symbol]:
                    new = score + weight * gain
                    if new > moved.get(target, -1.0):
                        moved[target] = new
            at = moved
        return max((v for s, v in at.items() if self.final[s]), default=0.0)


GRAMMAR = Machine(grammar())


class Lexicon:
    """Weights of words and stems; a word takes the larger of its own and its stems' weights."""

    def __init__(self, terms: dict[str, float]):
        self.words = {k[2:]: v for k, v in terms.items() if k[0] == "w"}
        self.stems = {k[2:]: v for k, v in terms.items() if k[0] == "p"}
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            w = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) > n)])
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = w
        return w


def symbol(token: str, lexicon: Lexicon) -> tuple[str, float]:
    w = lexicon.weight(token)
    if w:
        return "insult", w
    if token in THREAT:
        return "threat", THREAT_WEIGHT
    if not token[0].isalpha():
        return "quote", 0.0
    return "negation" if token in NEGATION else "report" if token in REPORT else "intent" if token in INTENT else "target" if token in TARGET else "word", 0.0


def clause_score(clause: str, lexicon: Lexicon) -> float:
    pairs = [symbol(t, lexicon) for t in TOKEN.findall(clause)]
    return GRAMMAR.best(pairs) if any(w for _, w in pairs) else 0.0


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, int]:
    """Sum of the scores of matched clauses, and their number."""
    low = (text or "").lower()
    words = set(WORD.findall(low))
    if not any(map(lexicon.weight, words)) and words.isdisjoint(THREAT):
        return 0.0, 0
    total, n = 0.0, 0
    for clause in CLAUSE.findall(low):
        s = clause_score(clause, lexicon)
        total, n = total + s, n + (s > 0)
    return total, n


def curve(pairs: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve of log(1 + evidence), fitted with a weak prior towards slope 3 and offset -4."""
    x, y = np.array([math.log1p(e) for e, _ in pairs]), np.array([t for _, t in pairs], float)
    w, prior = np.array([3.0, -4.0]), np.array([3.0, -4.0])
    design = np.stack([x, np.ones_like(x)], axis=1) if len(x) else np.zeros((0, 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (y - p) - 1.0 * (w - prior)
        h = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(w[0], 0.1)), float(w[1])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(counts: list, folds: tuple[int, ...], totals: dict[int, tuple[int, int]]) -> dict[str, tuple[float, float]]:
    """(weight, strength) of the telling terms, by the counts of some folds."""
    n1, n0 = sum(totals[f][0] for f in folds), sum(totals[f][1] for f in folds)
    out = {}
    for term, by_fold in counts:
        pos, neg = sum(by_fold[f][0] for f in folds), sum(by_fold[f][1] for f in folds)
        if pos <= 0 or not n1 or not n0:
            continue
        odds = math.log(((pos + 0.5) / (n1 + 1)) / ((neg + 0.5) / (n0 + 1)))
        # How far the toxic count exceeds the expected one, in nats.
        strength = pos * math.log(pos / ((pos + neg) * n1 / (n1 + n0)))
        if odds >= math.log(20.0) and pos >= 3 * neg:
            out[term] = (min(6.0, odds), strength)
    return out


def _strong(terms: dict[str, tuple[float, float]], least: float) -> dict[str, float]:
    return {t: w for t, (w, s) in terms.items() if s >= least}


def learned(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[dict[str, float], float, float]:
    """Weights of words (w:) and stems (p:), and the curve."""
    rows = labels.where(~held_out(F.col("doc_id"))).where("toxic IN (0, 1)").select(F.col("doc_id").alias("of_id"), F.col("toxic").cast("int").alias("is_toxic"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"))
    chosen = F.broadcast(rows.dropDuplicates(["of_id"]).orderBy(F.xxhash64("of_id"), "of_id").limit(most_rows))
    sample = settle(docs.join(chosen, docs["doc_id"] == chosen["of_id"]).select(docs["text"], chosen["is_toxic"], chosen["fold"]), "toxic-sample")
    found = sample.groupBy("fold").agg(F.sum("is_toxic").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    totals = {f: (0, 0) for f in (0, 1)} | {r.fold: (r.pos, r.n - r.pos) for r in found}
    n1, n0 = sum(t[0] for t in totals.values()), sum(t[1] for t in totals.values())
    if not n1 or not n0:
        return {}, 3.0, -4.0
    terms = sample.select("is_toxic", "fold", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("length(w) BETWEEN 3 AND 40")
    stems = [F.when(F.length("w") > n, F.concat(F.lit("p:"), F.substring("w", 1, n))) for n in PREFIXES]
    # A stem counts once for each distinct word of a text that has it; that is enough to tell which are telling.
    each = terms.select("is_toxic", "fold", F.explode(F.array_compact(F.array(F.concat(F.lit("w:"), "w"), *stems))).alias("term"))
    of = lambda f, y: F.count(F.when((F.col("fold") == f) & (F.col("is_toxic") == y), 1))
    counts = each.groupBy("term").agg(of(0, 1).alias("p0"), of(0, 0).alias("n0"), of(1, 1).alias("p1"), of(1, 0).alias("n1"))
    pos, neg = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    # The least that any fold, or both, could find telling; the sample bounds their number.
    counts = counts.where("p0 >= 2 OR p1 >= 2").where((pos >= 3 * neg) | (F.col("p0") >= 3 * F.col("n0")) | (F.col("p1") >= 3 * F.col("n1")))
    table = [(r.term, ((r.p0, r.n0), (r.p1, r.n1))) for r in counts.orderBy("term").collect()]
    # Each fold's texts are read with the lexicon of the other, at each strength.
    others = [_terms(table, (1 - f,), totals) for f in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast([[_strong(others[f], s) for s in STRENGTHS] for f in (0, 1)])
    got = sorted((r.is_toxic, list(r.evidence)) for r in sample.mapInArrow(_evidence(sent), "is_toxic int, evidence array<double>").collect())  # a few numbers for each row of the bounded sample
    fits = []
    for k, strength in enumerate(STRENGTHS):
        pairs = [(e[k], y) for y, e in got]
        slope, offset = curve(pairs)
        loss = sum(math.log1p(math.exp(-min(30.0, max(-30.0, (2 * y - 1) * (slope * math.log1p(e) + offset))))) for e, y in pairs)
        fits.append((round(loss, 6), -strength, slope, offset))
    _, strength, slope, offset = min(fits)
    return _strong(_terms(table, (0, 1), totals), -strength), slope, offset


def _evidence(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [[Lexicon(t) for t in of_fold] for of_fold in sent.value]
        for b in batches:
            found = [[evidence(t, lexicon)[0] for lexicon in lexicons[fold]] for t, fold in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.float64()))], names=["is_toxic", "evidence"])

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, offset = model.value
        lexicon = Lexicon(weights)
        for b in batches:
            got = [evidence(t.as_py(), lexicon) for t in b.column(2)]
            s = 1 / (1 + np.exp(-np.clip(slope * np.log1p(np.array([e for e, _ in got], np.float64)) + offset, -30, 30)))
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array([n for _, n in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_clauses"])

    return run


def scored(docs: DataFrame, model: tuple[dict[str, float], float, float]) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matched clauses of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded sample
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scored(sent), "doc_id long, held_out boolean, score double, predicted int, n_clauses int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, learned(docs, documents(spark, sf_dir, "labels")))
