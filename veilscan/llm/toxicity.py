"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult and threat (by stems), target, negation, reported speech, other. Letter transducers rewrite the symbols
of a clause one after the other: negation marks hits shortly behind a negation, reported speech marks hits behind a verb of saying,
target remembers whether someone is addressed. They are composed into one deterministic transducer. What counts is the clause:
its kind (what is matched, how it is marked, whether at someone) and the weight of its heaviest stem. A document's score is
a logistic function of its clauses' weights by kind.

Stems, their weights and the weights of kinds are fitted to labelled rows that are not held out, at most TRAIN_ROWS of them, drawn by a hash of the
id. Only texts go into a score.

* Null, empty and wordless texts have no clause and get the score of such texts. Texts are scored whole. Repeated rows are scored alike.
* Without labels, or with labels of one kind, the weights below are used as they stand. Null labels count for nothing; of contradicting
  labels of one id the higher one does.
* In ``accepted`` other columns pass unread, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import in_small_batches, settle

TRAIN_ROWS = 10_000
THRESHOLD = 0.3
#: Learned stems at most.
STEMS = 5_000
#: Toxic documents that a stem must explain at least.
LEAST = 2

INSULTS = "idiot moron imbecil imbécil scum trash loser stupid pathetic worthless disgusting clown dummkopf abschaum abruti salaud".split()
THREATS = "kill murder strangle shoot destroy hurt beat burn umbringen töten verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = set("you your yours yourself they them their he him she her we us these those people du dich dir dein deine ihr euch sie tu te toi ton vous votre ils elles tú ti usted ustedes vosotros ellos ellas".split())
NEGATIONS = set("not no never neither nor isn't aren't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni".split())
REPORTS = set("said says say told wrote writes quoted quotes called claimed reported sagte sagt schrieb dit écrit dijo dice escribió".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
PLAIN, NEGATED, REPORTED = "", "negated ", "reported "
#: Words behind a negation that it reaches.
REACH = 3
#: Kinds of clauses, with the weight that each has before labels are seen; a target adds to it.
KINDS = {m + h: w for m, w in ((PLAIN, 6.0), (NEGATED, 2.0), (REPORTED, 2.5)) for h in (INSULT, THREAT)}
KINDS |= {k + " at target": w + 0.5 for k, w in KINDS.items()}
BIAS = -4.0
CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter transducer: (state, symbol) to (state, symbol). What is not in steps keeps state and symbol."""

    steps: dict[tuple, tuple]
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        return self.steps.get((state, symbol), (state, symbol))


def negation() -> Transducer:
    steps = {}
    for left in range(REACH + 1):
        for symbol in (INSULT, THREAT, TARGET, OTHER, REPORT):
            marked = NEGATED + symbol if left and symbol in (INSULT, THREAT) else symbol
            steps[left, symbol] = max(0, left - 1), marked
        steps[left, NEGATION] = REACH, OTHER
    return Transducer(steps)


def reported_speech() -> Transducer:
    steps: dict[tuple, tuple] = {(s, REPORT): (1, OTHER) for s in (0, 1)}
    for hit in (INSULT, THREAT):
        steps[1, hit] = 1, REPORTED + hit
    return Transducer(steps)


def target() -> Transducer:
    return Transducer({(s, TARGET): (1, OTHER) for s in (0, 1)})


def composed(parts: list[Transducer], alphabet: list[str]) -> Transducer:
    """One transducer that does what the parts do one after the other; its states are the reachable tuples of theirs."""
    start = tuple(p.start for p in parts)
    steps, open_states, seen = {}, [start], {start}
    while open_states:
        state = open_states.pop()
        for symbol in alphabet:
            out, new = symbol, []
            for part, s in zip(parts, state, strict=True):
                s, out = part.step(s, out)
                new.append(s)
            steps[state, symbol] = tuple(new), out
            if tuple(new) not in seen:
                seen.add(tuple(new))
                open_states.append(tuple(new))
    return Transducer(steps, start)


GRAMMAR = composed([negation(), reported_speech(), target()], [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER])


class Model:
    """Stems with their weights, and the weights of kinds. ``$`` at a stem's end: the word ends there."""

    def __init__(self, insults: dict[str, float], kinds: dict[str, float] | None = None, bias: float = BIAS):
        self.insults, self.kinds, self.bias = insults, kinds or dict(KINDS), bias
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def _find(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for stem in THREATS:
                self._automaton.add_word(stem, (stem, THREAT, 1.0))
            for stem, weight in self.insults.items():
                self._automaton.add_word(stem.rstrip("$"), (stem, INSULT, weight))
            self._automaton.make_automaton()
        return self._automaton.iter

    def hits(self, low: str) -> dict[int, tuple[str, float]]:
        """Places of words that begin with a stem: what they are, and their weight; the heaviest stem counts."""
        found: dict[int, tuple[str, float]] = {}
        for end, (stem, symbol, weight) in self._find()(low):
            begin = end - len(stem.rstrip("$")) + 1
            if begin and (low[begin - 1].isalpha() or low[begin - 1] == "'"):
                continue
            if stem.endswith("$") and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            if begin not in found or found[begin][1] < weight:
                found[begin] = symbol, weight
        return found

    def clauses(self, text: str) -> Counter:
        """Weights by kind of the text's clauses that match. A clause's kind is that of its heaviest hit, the least marked one first."""
        low = text.lower()
        hits = self.hits(low)
        total: Counter = Counter()
        if not hits:
            return total
        places = np.sort(np.fromiter(hits, np.int64))
        for clause in CLAUSE.finditer(low):
            a, b = clause.span()
            if np.searchsorted(places, a) == np.searchsorted(places, b):
                continue
            state, best = GRAMMAR.start, (0.0, 0, "")
            for word in WORD.finditer(low, a, b):
                symbol, weight = hits.get(word.start(), ("", 0.0))
                if not symbol:
                    w = word.group()
                    symbol = NEGATION if w in NEGATIONS else REPORT if w in REPORTS else TARGET if w in TARGETS else OTHER
                state, out = GRAMMAR.steps[state, symbol]
                if weight:
                    best = max(best, (weight, out in (INSULT, THREAT), out))
            if best[2]:
                total[best[2] + (" at target" if state[2] else "")] += best[0]
        return total

    def features(self, text: str) -> list[float]:
        found = self.clauses(text)
        return [math.log1p(found[k]) for k in KINDS]

    def score(self, text: str) -> float:
        z = self.bias + sum(self.kinds[k] * math.log1p(w) for k, w in self.clauses(text).items())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most ``rows`` labelled documents that are not held out. Their ids, a bounded number, are broadcast."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return settle(docs.select("doc_id", "text").join(F.broadcast(settle(chosen, "chosen")), "doc_id").select("text", "label"), "training")


def stems_of(text: str) -> set[str]:
    out = set()
    for word in set(WORD.findall(text.lower())):
        if len(word) > 2:
            out.add(word + "$")
            out.update(word[:k] for k in range(4, min(8, len(word)) + 1))
    return out


def stem_counts(training: DataFrame) -> DataFrame:
    """stem, n, toxic: documents with the stem. Tasks count before rows go through the shuffle."""

    def count(batches):
        n, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stems = stems_of(text or "")
                n.update(stems)
                if label:
                    toxic.update(stems)
        stems = list(n)
        yield pa.RecordBatch.from_pydict({"stem": pa.array(stems, pa.string()), "n": pa.array([n[s] for s in stems], pa.int64()), "toxic": pa.array([toxic[s] for s in stems], pa.int64())})

    counts = training.select("text", "label").mapInArrow(count, "stem string, n bigint, toxic bigint")
    return counts.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen_stems(counts: list[tuple[str, int, int]], documents: list[list[str]], base: float) -> dict[str, float]:
    """Weights of the stems that explain the toxic documents: again and again the one with the most documents that no chosen stem has.

    Words that merely stand beside insults, in copies of a document for instance, explain nothing that is left. A longer stem
    takes a shorter one's place if it keeps nearly all its toxic documents and is more precise."""
    of = {s: (n, t) for s, n, t in counts}
    left = [{s for s in stems if s in of} for stems in documents]
    out: dict[str, float] = {}
    while True:
        gain = Counter(s for stems in left for s in stems)
        best = max(gain, key=lambda s: (gain[s], of[s][1] / of[s][0], -len(s), s), default=None)
        if best is None or gain[best] < LEAST:
            return out
        for other in sorted(of, key=lambda s: (len(s), s)):
            if other.startswith(best.rstrip("$")) and of[other][1] / of[other][0] > of[best][1] / of[best][0] and of[other][1] >= 0.95 * of[best][1]:
                best = other
        n, t = of[best]
        lift = math.log((t + 0.5) / (n - t + 0.5)) - math.log(base / (1 - base))
        out[best] = min(2.0, max(0.2, lift / 4))
        left = [stems for stems in left if best not in stems]


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    training = training_rows(in_small_batches(docs), labels, rows)
    total, toxic = training.agg(F.count("*"), F.sum("label")).first()
    insults = dict.fromkeys(INSULTS, 1.0)
    if not toxic or toxic == total:
        return Model(insults)
    base = toxic / total
    z = (F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    found = stem_counts(training).where((F.col("n") >= LEAST) & (F.col("toxic") >= 0.9 * F.col("n")) & (z > 5))
    top = found.orderBy(z.desc(), "stem").limit(STEMS).collect()
    candidates = {r[0] for r in top}

    def present(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"stems": pa.array([sorted(stems_of(t or "") & candidates) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))})

    documents = training.where("label > 0").select("text").mapInArrow(present, "stems array<string>").collect()
    learned = chosen_stems([tuple(r) for r in top], [r[0] for r in documents], base)
    insults = {s: w for s, w in insults.items() if not any(s.startswith(k.rstrip("$")) for k in learned)} | learned
    model = Model(insults)

    def features(batches):
        for batch in batches:
            x = [model.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows_ = training.mapInArrow(features, "x array<double>, label int").groupBy("x", "label").count().orderBy("x", "label").collect()
    return Model(insults, *_logistic(np.array([r[0] for r in rows_]), np.array([r[1] for r in rows_], float), np.array([r[2] for r in rows_], float)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[dict[str, float], float]:
    """Weights of kinds and the bias by Newton's method, drawn towards the weights that stand above."""
    x = np.hstack([x, np.ones((len(x), 1))])
    mean = np.array([*KINDS.values(), BIAS])
    w, pull = mean.copy(), np.full(len(mean), 0.5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (n * (p - y)) + pull * (w - mean)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(KINDS, np.maximum(w[:-1], 0.0).tolist(), strict=True)), float(w[-1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    score = _score(model)(F.col("text"))
    rows = in_small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted to be toxic."""
    return in_small_batches(docs).where(_score(model)(F.col("text")) < THRESHOLD)


def _score(model: Model):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t or "") for t in batch], dtype=float)

    return score
