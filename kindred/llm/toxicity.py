"""Toxicity by a weighted finite-state grammar of clauses.

Words have classes: insult, threat, target, negation, report. Three transducers over classes are
composed into one: the first marks what a negation covers, the second what is told of somebody else's
speech, the third matches patterns (insult, insult with a target, threat with a target, run of
insults). The composed transducer runs over the clauses in which an insult or a threat
stands; its outputs, counted by pattern, are the features of a logistic model. So a score comes from
clauses: a negated or reported insult has a weight of its own, learnt like the others.

Insults are known by a small list and by stems that are learnt from labelled texts of any language: word
beginnings and whole words that cover toxic texts not covered yet, and hardly any other.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import fold, give_back, lean, staged

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "H", "T", "N", "R", "o"
#: Words of the classes in English, German, French and Spanish.
INSULTS = "idiot moron scum trash worthless pathetic disgusting stupid clown loser imbecile filth vermin dumbass bastard trottel abschaum dummkopf connard salaud ordure idiota basura escoria imbécil".split()
THREATS = "kill hurt destroy burn stab shoot beat strangle töten umbringen verletzen schlagen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yourself he she they them him her du dich dir ihr euch er sie tu toi vous te il elle ils tú usted ustedes ellos ella él".split()
NEGATIONS = "not no never nobody n't cannot don't isn't aren't nicht kein keine nie ne pas jamais aucun nunca ningún jamás".split()
REPORTS = "said says wrote writes called calls claimed quoted told according sagte sagt schrieb nannte laut dit écrit selon dijo dice escribió según".split()
PATTERNS = ("insult", "directed", "threat", "run", "negated", "reported")
#: Words that a negation covers.
REACH = 3
#: Bounds of learning: labelled texts that are read for the stems and the weights, candidate stems, and
#: the rounds of the fit.
LABELLED, CANDIDATES, ROUNDS = 20_000, 4_096, 50
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n\r|]")


class Transducer:
    """``step(state, symbol) -> (state, outputs)`` from state ``start``; ``last(state)`` at the end."""

    def __init__(self, start, step, last=lambda state: ()):
        self.start, self.step, self.last = start, lru_cache(None)(step), lru_cache(None)(last)

    def compose(self, after: Transducer) -> Transducer:
        """The transducer that feeds this one's outputs to ``after``."""

        def feed(state, symbols):
            out = []
            for symbol in symbols:
                state, made = after.step(state, symbol)
                out += made
            return state, out

        def step(state, symbol):
            mine, made = self.step(state[0], symbol)
            theirs, out = feed(state[1], made)
            return (mine, theirs), tuple(out)

        def last(state):
            theirs, out = feed(state[1], self.last(state[0]))
            return (*out, *after.last(theirs))

        return Transducer((self.start, after.start), step, last)

    def run(self, symbols) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, made = self.step(state, symbol)
            out += made
        return [*out, *self.last(state)]


def negation() -> Transducer:
    """Insults and threats in the next words after a negation are written in lower case."""

    def step(left, symbol):
        if symbol == NEGATION:
            return REACH, ()
        return max(0, left - 1), (symbol.lower() if left and symbol in (INSULT, THREAT) else symbol,)

    return Transducer(0, step)


def reported() -> Transducer:
    """After a word of speech, insults and threats of the clause are marked as reported."""

    def step(said, symbol):
        if symbol == REPORT:
            return True, ()
        return said, ("r" if said and symbol in (INSULT, THREAT) else symbol,)

    return Transducer(False, step)


def matching() -> Transducer:
    """Patterns of a clause. State: (a target was seen, an open insult, an open threat, the last word was an
    insult). A target closes what is open, so a target may stand before or after its insult or threat."""

    def step(state, symbol):
        target, insult, threat, last = state
        if symbol == TARGET:
            return (True, False, False, False), (*(["directed"] if insult else []), *(["threat"] if threat else []))
        if symbol == INSULT:
            out = ("directed" if target else "insult", *(["run"] if last else []))
            return (target, not target, threat, True), out
        if symbol == THREAT:
            return (target, insult, not target, False), ("threat",) if target else ()
        if symbol in "ih":
            return (target, insult, threat, False), ("negated",)
        if symbol == "r":
            return (target, insult, threat, False), ("reported",)
        return (target, insult, threat, False), ()

    return Transducer((False, False, False, False), step)


GRAMMAR = negation().compose(reported()).compose(matching())


@dataclass
class Model:
    """Stems (a beginning of words) and words that insult, with the weights of the patterns."""

    stems: tuple[str, ...] = ()
    words: tuple[str, ...] = tuple(INSULTS)
    weights: tuple[float, ...] = (0.0,) * (2 * len(PATTERNS) + 1)
    bias: float = 0.0
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return (self.stems, self.words, self.weights, self.bias)

    def __setstate__(self, state):
        self.stems, self.words, self.weights, self.bias = state
        self._made = {}

    def anchors(self):
        """An automaton of everything that can open a clause's match."""
        if "anchors" not in self._made:
            import ahocorasick

            found = ahocorasick.Automaton()
            for stem in self.stems:
                found.add_word(stem, len(stem))
            for word in (*self.words, *THREATS):
                found.add_word(word, len(word))
            found.make_automaton()
            classes = dict.fromkeys(self.words, INSULT)
            for kind, list_ in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
                for word in list_:
                    classes.setdefault(word, kind)
            lengths = sorted({len(s) for s in self.stems})
            self._made |= {"anchors": found, "classes": classes, "lengths": lengths, "stems": frozenset(self.stems)}
        return self._made["anchors"]

    def class_of(self, word: str) -> str:
        kind = self._made["classes"].get(word)
        if kind is None and any(word[:n] in self._made["stems"] for n in self._made["lengths"] if n <= len(word)):
            kind = INSULT
        return kind or OTHER

    def counts(self, text: str | None) -> np.ndarray:
        """How often each pattern matches."""
        found = np.zeros(len(PATTERNS))
        if not text:
            return found
        low, anchors, done = text.lower(), self.anchors(), 0
        for last, size in anchors.iter(low):
            first = last - size + 1
            if first < done or (first and low[first - 1].isalpha()):
                continue
            start = done
            for end in CLAUSE_END.finditer(low, done, first):
                start = end.end()
            start = max(start, 0)
            close = CLAUSE_END.search(low, last + 1)
            stop = close.start() if close else len(low)
            done = stop
            for name in GRAMMAR.run(map(self.class_of, WORD.findall(low, start, stop))):
                found[PATTERNS.index(name)] += 1
        return found

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Logarithm of each count, whether there is any, and whether anything matched at all."""
        counts = np.atleast_2d(counts)
        return np.concatenate([np.log1p(counts), counts > 0, (counts[:, :4].sum(1) > 0)[:, None]], 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self.features(counts) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _beginnings(text: str) -> set[str]:
    """Words (with a leading '=') and their beginnings of 4 to 8 letters."""
    out = set()
    for word in set(WORD.findall(text.lower())):
        if len(word) <= 24:
            out.add("=" + word)
        out.update(word[:n] for n in range(4, min(len(word), 9)))
    return out


def _stems(labelled: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Stems and words of rows (text, toxic)."""

    def count(batches):
        ones, zeros = Counter(), Counter()

        def out():
            keys = [*ones, *(k for k in zeros if k not in ones)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([ones[k] for k in keys], pa.int64()), pa.array([zeros[k] for k in keys], pa.int64())], ["stem", "one", "zero"]
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (ones if toxic else zeros).update(_beginnings(text or ""))
                if len(ones) + len(zeros) > 400_000:
                    yield out()
                    ones, zeros = Counter(), Counter()
        yield out()

    texts = labelled.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies count once
    texts = staged(texts, "labelled")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return (), tuple(INSULTS)
    totals = texts.mapInArrow(lean(count), "stem string, one long, zero long").groupBy("stem").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    odds = F.log((F.col("one") + 0.5) / (n1 + 1.0)) - F.log((F.col("zero") + 0.5) / (n0 + 1.0))
    sure = totals.where((F.col("one") >= 3) & (odds > 3) & (F.col("zero") <= 0.05 * F.col("one")))
    best = sure.orderBy(F.desc(F.col("one") - F.col("zero")), F.length("stem"), "stem").limit(CANDIDATES).collect()
    names = [r["stem"] for r in best]
    number = {name: i for i, name in enumerate(names)}

    def held(batches):
        for batch in batches:
            found = [sorted(number[s] for s in _beginnings(t or "") if s in number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["found"])

    rows = texts.where("toxic = 1").select("text").mapInArrow(lean(held), "found array<int>").collect()  # at most LABELLED
    left = [set(r["found"]) for r in rows if r["found"]]
    chosen, least = [], max(2, n1 // 200)
    while left:
        gain = Counter(i for own in left for i in own)
        top, new = min(gain.items(), key=lambda kv: (-kv[1], kv[0]))
        if new < least:
            break
        chosen.append(names[top])
        left = [own for own in left if top not in own]
    # Others as frequent and as sure as these, which the cover did not need.
    chosen += [r["stem"] for r in best if r["one"] >= max(8, 0.03 * n1) and r["zero"] == 0]
    stems = tuple(sorted({s for s in chosen if s[0] != "="}))
    words = tuple(sorted({s[1:] for s in chosen if s[0] == "="} | set(INSULTS)))
    return stems, words


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with a pull to zero, by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    hold = np.full(len(w), pull)
    hold[-1] = 1e-3
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(hold), x1.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled texts whose id's crc32 modulo ``parts`` is not ``held``.

    ``bound``: labelled texts that are read at most, about; beyond it a hash of the id picks them. Labels that
    are null, and texts that are null, are left out. Without labels of both kinds the weights are
    fixed: any insult or threat scores 0.73, else 0.05."""
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & (fold("id", parts) != held)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > bound:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("text IS NOT NULL")
    sample = staged(texts.join(marks, "id").select("text", "toxic"), "sample")
    stems, words = _stems(sample)
    model = Model(stems, words)

    def count(batches):
        for batch in batches:
            found = [model.counts(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["counts", "toxic"])

    rows = sample.mapInArrow(lean(count), "counts array<double>, toxic int").groupBy("counts", "toxic").count().collect()  # at most `bound`
    y = np.array([r["toxic"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        any_ = [0.0] * (2 * len(PATTERNS)) + [3.94]
        return Model(stems, words, tuple(any_), -2.94)
    many = np.array([r["count"] for r in rows])
    x = model.features(np.array([r["counts"] for r in rows], float))
    weights, bias = _fit(np.repeat(x, many, 0), np.repeat(y, many))
    return Model(stems, words, tuple(weights.tolist()), bias)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, one count for each pattern) for every row. Null text is empty and
    matches nothing; rows without an id are not held out; rows that repeat each have their score."""

    def run(batches):
        for batch in batches:
            counts = np.array([model.counts(t.as_py()) for t in batch.column(2)]).reshape(-1, len(PATTERNS))
            score = model.score(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in counts.T)],
                ["doc_id", "held_out", "score", "predicted", *(f"n_{p}" for p in PATTERNS)],
            )

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    texts = texts.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "text")
    return texts.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, " + ", ".join(f"n_{p} long" for p in PATTERNS))


def clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""

    def keep(texts: pa.Array) -> pa.Array:
        counts = np.array([model.counts(t.as_py()) for t in texts]).reshape(-1, len(PATTERNS))
        give_back()
        return pa.array(model.score(counts) < threshold)

    return docs.where(F.arrow_udf(keep, "boolean")(F.col(text_col)))
