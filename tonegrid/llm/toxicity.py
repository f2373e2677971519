"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed: target, negation and reported speech rewrite the evidence that a
clause's words are, by their order in it; insult and threat weigh what comes out. A clause's score
is the weight of the best path of the composition; a document's is a logistic function of its
clauses' paths. The words' first symbols come from seed lexicons and from stems learned from
labelled rows.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, logistic

# The seed lexicons, in lower case.
INSULTS = ("bastard", "clown", "crap", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum",
           "stupid", "trash", "ugly", "useless", "vermin", "worthless")
THREATS = ("kill", "murder", "strangle", "stab", "shoot", "slaughter", "destroy", "tuer", "töten", "matar")
TARGETS = ("you", "your", "he", "she", "him", "her", "they", "them", "this", "these", "that", "du", "dich", "ihr", "tu", "toi", "vous", "tú", "usted")
NEGATIONS = ("not", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "jamais", "pas", "nunca")
REPORTED = ("said", "says", "wrote", "writes", "called", "calls", "quoted", "quote", "according", "alleged", "sagte", "dit", "dijo")

CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
EDGE = "\"'()[]{}<>*_~#$%&|,:.!?;…«»„“”‘’–—-/\\"
N_FEATURES = 7
MIN_STEM, MAX_STEM = 3, 8
#: Symbols of words. Evidence is an insult or a threat; I and H are aimed ones, - marks what is
#: negated and ~ what is reported.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oihtnr"
EVIDENCE = "iIhH"


@dataclass(frozen=True)
class Transducer:
    """Arcs from (state, symbol) to any number of (output, weight, next state). A symbol without an
    entry passes as it is and leaves the state; an entry without arcs ends the path. Paths start in
    state 0 and count where they end in a state of ``final``."""

    arcs: dict
    final: frozenset

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), ((symbol, 0.0, state),))


def compose(a: Transducer, b: Transducer, symbols: str = OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT, start=(0, 0)) -> Transducer:
    """The transducer that reads what ``a`` reads and writes what ``b`` makes of ``a``'s output.

    States are the pairs that can be reached, numbered from 0.
    """
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        pair = todo.pop()
        for x in symbols:
            out = []
            for y, w, na in a.step(pair[0], x):
                for z, v, nb in b.step(pair[1], y):
                    if (na, nb) not in number:
                        number[na, nb] = len(number)
                        todo.append((na, nb))
                    out.append((z, w + v, number[na, nb]))
            arcs[number[pair], x] = tuple(out)
    return Transducer(arcs, frozenset(i for (sa, sb), i in number.items() if sa in a.final and sb in b.final))


def target_machine(reach: int = 4, ahead: int = 3) -> Transducer:
    """Insults within ``reach`` words after a target, and insults and threats with one within
    ``ahead`` words after them, become aimed. States: 0, words a target still reaches (1..reach),
    and minus the words within which a target is owed."""
    arcs = {}
    for s in range(-ahead, reach + 1):
        owing = s < 0
        nxt = s + 1 if owing else max(0, s - 1)
        ends = s == -1  # the target that is owed must come now
        for x in (OTHER, NEGATION, REPORT):
            arcs[s, x] = () if ends else ((x, 0.0, nxt),)
        arcs[s, TARGET] = ((TARGET, 0.0, reach),)
        for x in (INSULT, THREAT):
            if owing:  # what is aimed at the target that comes is all of it
                arcs[s, x] = () if ends else ((x.upper(), 0.0, nxt),)
            elif x == INSULT and s > 0:
                arcs[s, x] = ((x.upper(), 0.0, nxt),)
            else:
                arcs[s, x] = ((x, 0.0, nxt), (x.upper(), 0.0, -ahead))
    return Transducer(arcs, frozenset(range(reach + 1)))


def negation_machine(reach: int = 3) -> Transducer:
    """Evidence within ``reach`` words after a negation is negated. States: words it still reaches."""
    arcs = {}
    for s in range(reach + 1):
        for x in (OTHER, TARGET, REPORT, *EVIDENCE):
            arcs[s, x] = ((x + "-" * (s > 0 and x in EVIDENCE), 0.0, max(0, s - 1)),)
        arcs[s, NEGATION] = ((NEGATION, 0.0, reach),)
    return Transducer(arcs, frozenset(range(reach + 1)))


def report_machine() -> Transducer:
    """Evidence in a clause with a word of speech is reported, before that word too. States: 0
    nothing yet, 1 the word was there, 2 evidence passed as reported and the word is owed, 3
    evidence passed as plain and no such word may follow."""
    arcs = {(0, REPORT): ((REPORT, 0.0, 1),), (2, REPORT): ((REPORT, 0.0, 1),), (3, REPORT): ()}
    for x in EVIDENCE:
        for y in (x, x + "-"):
            arcs |= {(0, y): ((y, 0.0, 3), (y + "~", 0.0, 2)), (1, y): ((y + "~", 0.0, 1),), (2, y): ((y + "~", 0.0, 2),), (3, y): ((y, 0.0, 3),)}
    return Transducer(arcs, frozenset({0, 1, 3}))


def weigher(kind: str, base: float, aimed: float, negated: float, reported: float) -> Transducer:
    """Weighs the evidence of one kind; everything else passes."""
    arcs = {}
    for x, w in ((kind, base), (kind.upper(), aimed)):
        for y in (x, x + "-", x + "~", x + "-~"):
            arcs[0, y] = ((y, w + negated * ("-" in y) + reported * ("~" in y), 0),)
    return Transducer(arcs, frozenset({0}))


def machines() -> tuple[Transducer, ...]:
    """Target, negation, reported speech, insult, threat: the cascade in its order."""
    return target_machine(), negation_machine(), report_machine(), weigher(INSULT, 0.0, 1.5, -3.0, -2.5), weigher(THREAT, -1.5, 1.5, -3.0, -2.5)


@functools.cache
def composition() -> Transducer:
    return functools.reduce(compose, machines())


def best_path(machine: Transducer, symbols: list[str], weights: list[float]) -> tuple[float, tuple]:
    """(weight, ((output, weight), ...)) of the best accepted path. A word's own weight counts where
    the path gives it out as evidence; of equal paths the first found stays."""
    live: dict = {0: (0.0, ())}
    for x, own in zip(symbols, weights, strict=True):
        after: dict = {}
        for state, (score, path) in live.items():
            for y, w, nxt in machine.step(state, x):
                if y[0] in EVIDENCE:
                    now = (score + w + own, (*path, (y, w + own)))
                else:
                    now = (score + w, path)
                if nxt not in after or now[0] > after[nxt][0]:
                    after[nxt] = now
        live = after
    ends = [live[s] for s in live if s in machine.final]
    return max(ends, key=lambda e: e[0], default=(0.0, ()))


@dataclass
class Grammar:
    """Words and stems with their symbols and weights, and the weights of the final states."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    memo: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def arc(self, token: str) -> tuple[str, float] | None:
        """The symbol and weight that a token's longest entry gives; None: any other word."""
        try:
            return self.memo[token]
        except KeyError:
            word = token.strip(EDGE)
            found = self.words.get(word)
            if found is None:
                for k in range(min(len(word), MAX_STEM), MIN_STEM - 1, -1):
                    if (w := self.stems.get(word[:k])) is not None:
                        found = (INSULT, w)
                        break
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[token] = found
            return found

    def clauses(self, text: str) -> Iterator[tuple[float, tuple]]:
        """(weight, evidence) of the best path of each clause that has an insult or a threat."""
        arc, lowered = self.arc, text.lower()
        hot = {t for t in set(WORD.findall(lowered)) if (a := arc(t)) is not None and a[0] in EVIDENCE}
        if not hot:
            return
        machine = composition()
        for clause in CLAUSE.split(lowered):
            tokens = WORD.findall(clause)
            if hot.isdisjoint(tokens):
                continue
            found = [arc(t) or (OTHER, 0.0) for t in tokens]
            yield best_path(machine, [x for x, _ in found], [w for _, w in found])

    def features(self, text: str | None) -> list[float]:
        total = best = plain = aimed = soft = 0.0
        for weight, path in self.clauses(text or ""):
            total += max(weight, 0.0)
            best = max(best, weight)
            for y, w in path:
                if len(y) > 1:
                    soft += 1.0
                else:
                    plain += max(w, 0.0)
                    aimed += max(w, 0.0) * y.isupper()
        length = np.log1p(len(text or "")) / 10
        return [1.0, min(best, 12.0), np.log1p(total), np.log1p(plain), np.log1p(aimed), np.log1p(soft), length]

    def score(self, text: str | None) -> float:
        return float(logistic.sigmoid(np.dot(self.features(text), self.weights)))


def seed_grammar() -> Grammar:
    words: dict[str, tuple[str, float]] = {}
    for symbol, lexicon, weight in ((REPORT, REPORTED, 0.0), (NEGATION, NEGATIONS, 0.0), (TARGET, TARGETS, 0.0), (THREAT, THREATS, 4.0), (INSULT, INSULTS, 4.0)):
        words |= {w: (symbol, weight) for w in lexicon}
    return Grammar(words)


def held_out(id_col, folds: int = 3, fold: int = 1):
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> DataFrame:
    """At most ``per_class`` training rows of each label, those whose id hashes lowest: (id, text, label)."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(train(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    picks = rows.where("label = 1").orderBy(*order).limit(per_class).unionByName(rows.where("label = 0").orderBy(*order).limit(per_class))
    picks = common.materialize(picks, "labelled")
    text = docs.select(F.col("doc_id").alias("id"), "text")
    return common.materialize(text.join(common.small(picks), "id"), "labelled-text")


def without_copies(sample: DataFrame, passes: int = 2) -> DataFrame:
    """One row of each group of near copies, which would make their common words look frequent:
    rows whose 3-word shingles have the same least hash are taken as copies, by ``passes`` hashes."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    for i in range(passes):
        triples = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda k: F.xxhash64(F.slice(F.col("words"), k, 3), F.lit(i))
        )
        sample = sample.withColumn("words", words).withColumn("least", F.array_min(triples)).drop("words").dropDuplicates(["least"]).drop("least")
    return sample


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, hot, cold, hot2, cold2): rows labelled 1 and 0 that have a word with the stem, and those
    that have two or more; counted per part before anything moves."""

    def count(part: pa.RecordBatch) -> dict:
        found: dict[str, list[int]] = {}
        for label, text in zip(part.column("label").to_pylist(), common.texts_of(part), strict=True):
            own = Counter(w[:k] for w in WORD.findall(text.lower()) for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1))
            for stem, n in own.items():
                row = found.setdefault(stem, [0, 0, 0, 0])
                row[0 if label else 1] += 1
                row[2 if label else 3] += n > 1
        columns = itertools.zip_longest(*([k, *v] for k, v in found.items())) if found else [[]] * 5
        return dict(zip(("stem", "hot", "cold", "hot2", "cold2"), map(list, columns), strict=True))

    rows = common.map_parts(sample.select("label", "text"), lambda: count, "stem string, hot long, cold long, hot2 long, cold2 long")
    return rows.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("hot", "cold", "hot2", "cold2")])


def learn_stems(sample: DataFrame, purity: float = 0.97, risk: float = 0.01) -> dict[str, float]:
    """Stems whose words occur (nearly) only in rows labelled 1, or that only those rows repeat, with
    their log odds: a stem that clean rows have by chance once counts less, and adds up where it recurs.

    Counts are documents, over all of the sample, whose size bounds what is collected here. A stem must be so one-sided that among all stems
    tried, less than ``risk`` would be by chance. Of a chain of prefixes the longest that keeps nine
    tenths of the documents of the shorter one stays, and no longer one beside it.
    """
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = common.materialize(stem_counts(sample).where("hot > 1"), "toxic-stems")
    tried = max(2, counts.count())
    share, rows = float(np.log(n1 / (n0 + n1))), float(np.log(tried))
    # log of C(hot + cold, cold) * share ** hot, bounded by (hot + cold) ** cold
    chance = lambda h, c: F.col(c) * F.log(F.greatest(F.col(h) + F.col(c), F.lit(1))) + F.col(h) * share + rows < float(np.log(risk))
    pure = (F.col("hot") >= purity * (F.col("hot") + F.col("cold"))) & chance("hot", "cold")
    one_sided = F.col("hot2") / n1 >= (F.col("hot2") / n1 + F.col("cold2") / n0) * (purity - 0.03)
    kept = counts.where(pure | (one_sided & chance("hot2", "cold2"))).collect()
    found = {r["stem"]: (int(r["hot"]), int(r["cold"])) for r in kept}
    best: dict[str, int] = {}
    for stem, (hot, _) in found.items():
        best[stem[:-1]] = max(best.get(stem[:-1], 0), hot)
    odds = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
    ends = {s for s, (h, _) in found.items() if best.get(s, 0) < 0.9 * h}
    # an inflection of a stem that stays says no more than the stem
    ends = {s for s in ends if not any(s[:k] in ends for k in range(MIN_STEM, len(s)))}
    return {s: float(np.clip(odds(found[s][0], n1) - odds(found[s][1], n0), 1.0, 8.0)) for s in ends}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Grammar:
    """Learn the stems and final weights from at most ``per_class`` training rows of each label."""
    sample = labelled_sample(docs, labels, "toxic", lambda c: ~held_out(c), per_class)
    grammar = seed_grammar()
    grammar.stems = learn_stems(without_copies(sample))

    def features(part: pa.RecordBatch) -> dict:
        return {"label": part.column("label"), "x": [grammar.features(t) for t in common.texts_of(part)]}

    rows = common.map_parts(sample.select(F.col("label").cast("int").alias("label"), "text"), lambda: features, "label int, x array<double>").collect()
    if len({r["label"] for r in rows}) == 2:
        x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], dtype=float)
        grammar.weights = logistic.fit(x, y, l2=1e-4, weights=np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    else:
        grammar.weights = np.array([-3.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0])
    grammar.memo = {}
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The whole text is read, however long. Null and empty texts have no clause and get the grammar's
    base score; a null id stays null and is in the training folds, as the empty string is. Texts
    alone decide a score: equal texts, in repeated rows too, score alike. Other columns are
    ignored. Empty table: empty result.
    """

    def score(part: pa.RecordBatch) -> dict:
        x = np.array([grammar.features(t) for t in common.texts_of(part)]).reshape(-1, N_FEATURES)
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": logistic.sigmoid(x @ grammar.weights)}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = common.map_parts(rows, lambda: score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
