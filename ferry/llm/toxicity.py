"""Toxicity by a weighted finite-state pattern grammar.

Six transducers read a clause as a sequence of word classes: negation,
reported speech and quotation mark what stands in their scope, target marks
what is aimed at someone, threat follows "I/we - will - harm - someone", and
insult weighs marked insults.  They are composed into one deterministic
automaton (the product of their states) whose transitions carry the weight of
the composed match, so a clause is scored by one walk.  What a bare insult,
without a target, is worth against other matches is fixed; from which evidence
on a text is toxic, the labels decide.

The classes of function words are fixed lists.  Insults are a short fixed
list plus words and stems learned from labelled documents: a stem must occur
in many different contexts of many different toxic texts and in practically
no other text.  Only labels outside the held-out fold are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm.quality import held_out, labelled_sample

#: Labelled documents that are read for learning, at most.
SAMPLE = 12_000
#: Toxic texts, and contexts, that a learned stem needs at least.
SUPPORT = 5
#: The same as a share of the best supported stem (copies of one text give rare words some support).
SUPPORT_SHARE = 0.05
#: Share of toxic texts among the texts with a learned stem, at least (texts that negate or quote it are the others).
PURITY = 0.8
STEM_SIZES = (4, 5, 6)

# The grammar's word classes in English, German, French and Spanish.
INSULTS = "idiot moron scum loser clown worthless pathetic disgusting stupid trash imbecile dumbass arschloch trottel vollidiot abschaum connard abruti ordure gilipollas imbécil escoria".split()
THREATS = "kill hurt destroy beat stab shoot crush punch töten umbringen vernichten verprügeln tuer frapper détruire matar destruir golpear".split()
TARGETS = "you your yourself he she him her they them du dich dir euch ihn tu toi te vous lui tú ti usted ustedes ellos ella".split()
SPEAKERS = "i we ich wir je nous yo nosotros".split()
INTENTS = "will shall gonna going must werde werden vais allons voy vamos".split()
NEGATIONS = "not never n't isn't aren't wasn't don't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says say called calls claimed quoted reported alleged wrote sagte behauptete nannte dit appelé écrit dijo llamó escribió".split()

OTHER, INSULT, THREAT, TARGET, SPEAKER, INTENT, NEGATION, REPORT, QUOTE = range(9)
CLASSES = 9
_CLASS = {w: c for words, c in ((TARGETS, TARGET), (SPEAKERS, SPEAKER), (INTENTS, INTENT), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}

NEGATED, REPORTED, QUOTED, AIMED, THREATENED = 0.35, 0.5, 0.25, 1.25, 1.5
#: Words after a negation that it covers; words around a target that are aimed at it; words of an open quotation.
SCOPE, REACH, QUOTATION = 3, 4, 6

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(_WORD.pattern + r"|[\"'“”„‘’«»]")


# -------------------------------------------------------------- transducers
# Each: (number of states, step(state, class) -> (state, mark)).


def _negation(state: int, c: int) -> tuple[int, bool]:
    return (SCOPE, False) if c == NEGATION else (max(0, state - 1), state > 0)


def _reported(state: int, c: int) -> tuple[int, bool]:
    return (1, False) if c == REPORT else (state, state > 0)


def _quoted(state: int, c: int) -> tuple[int, bool]:
    """A quotation mark opens a quotation or closes it; an unclosed one ends by itself."""
    if c == QUOTE:
        return 0 if state else QUOTATION, False
    return max(0, state - 1), state > 0


def _target(state: int, c: int) -> tuple[int, bool]:
    return (REACH, True) if c == TARGET else (max(0, state - 1), state > 0)


def _threat(state: int, c: int) -> tuple[int, bool]:
    """0 nothing, 1 speaker, 2 speaker and intent, 3 and harm; a target then completes it."""
    if c == SPEAKER:
        return 1, False
    if c == INTENT and state == 1:
        return 2, False
    if c == THREAT and state in (1, 2):
        return 3, False
    if c == TARGET and state == 3:
        return 0, True
    return state, False


def _insult(marks: tuple[bool, ...], c: int) -> tuple[float, float]:
    """(factor of an insult's own weight, weight of a completed threat)."""
    negated, reported, quoted, aimed, threat = marks
    context = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0) * (QUOTED if quoted else 1.0)
    return (context * (AIMED if aimed else 1.0) if c == INSULT else 0.0), (THREATENED * context if threat else 0.0)


#: The transducers that mark words, in the order in which ``_insult`` reads their marks.
MARKS: tuple[Callable[[int, int], tuple[int, bool]], ...] = (_negation, _reported, _quoted, _target, _threat)


def composed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, insult factor, threat weight) by state and class, of the
    states that the start state 0 reaches."""
    start = (0,) * len(MARKS)
    number, queue = {start: 0}, [start]
    rows = []
    for state in queue:  # grows while it is read
        row = []
        for c in range(CLASSES):
            moved = [f(s, c) for f, s in zip(MARKS, state)]
            to = tuple(m[0] for m in moved)
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append((number[to], *_insult(tuple(m[1] for m in moved), c)))
        rows.append(row)
    table = np.array(rows)
    return table[:, :, 0].astype(int), table[:, :, 1], table[:, :, 2]


class Grammar:
    """The composed automaton over a lexicon of insult words and stems."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.needles = sorted({*words, *stems, *THREATS}, key=len)
        to, factor, threat = composed()
        self.to, self.factor, self.threat = to.tolist(), factor.tolist(), threat.tolist()
        # An insult one word after a target is aimed: the states where the target's mark is already in the factor.
        values = [a * b * c for a in (1.0, NEGATED) for b in (1.0, REPORTED) for c in (1.0, QUOTED)]
        self.is_aimed = [any(abs(f[INSULT] - AIMED * v) < 1e-9 for v in values) for f in self.factor]

    def _insult_weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.stems[word[:n]] for n in STEM_SIZES if word[:n] in self.stems), default=0.0)

    def clause_score(self, words: list[str]) -> float:
        """The walk forwards, and backwards for a target after its insult; the larger counts."""
        seen = []
        for w in words:
            weight = self._insult_weight(w)
            seen.append((INSULT if weight else THREAT if w in THREATS else _CLASS.get(w, OTHER if w[0].isalnum() else QUOTE), weight))
        best = 0.0
        late = [c == TARGET for c, _ in seen]
        state, total = 0, 0.0
        for k, (c, weight) in enumerate(seen):
            factor = self.factor[state][c] * weight
            if factor and not self.aimed(state) and any(late[k + 1 : k + 1 + REACH]):
                factor *= AIMED
            total += factor + self.threat[state][c]
            state = self.to[state][c]
            best = max(best, total)
        return best

    def aimed(self, state: int) -> bool:
        """Whether an insult read in ``state`` is already aimed at someone."""
        return self.is_aimed[state]

    def evidence(self, text: str | None) -> float:
        """The sum of the clause scores of a whole text."""
        low = (text or "").lower()
        if not any(n in low for n in self.needles):
            return 0.0
        total = 0.0
        for clause in _CLAUSE.split(low):
            if any(n in clause for n in self.needles):
                total += self.clause_score(_TOKEN.findall(clause))
        return total


# ----------------------------------------------------------------- learning


def _word_stems(words: list[str]) -> dict[str, set[int]]:
    """Candidates of a text, each with the contexts (word before, word after) it has."""
    found: dict[str, set[int]] = {}
    for k, w in enumerate(words):
        around = zlib.crc32(" ".join((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "")).encode())
        for s in {w + "$", *(w[:n] for n in STEM_SIZES if len(w) >= n)}:
            found.setdefault(s, set()).add(around)
    return found


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = _word_stems(_WORD.findall((text or "").lower()))
            rows = [(s, key, c) for s, around in found.items() for c in around]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["stem", "doc", "context"])


def learned_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their weights, from ``sample(text, label)``.

    Equal texts count once.  Weights are log-odds of toxic to other texts,
    as a share of the largest, at least a half.
    """
    texts = sample.select(F.xxhash64("text").alias("doc"), "text", "label").dropDuplicates(["doc", "label"])
    toxic = texts.where("label = 1").select("doc", "text").mapInArrow(_candidates, "stem string, doc long, context long")
    support = toxic.groupBy("stem").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("context").alias("contexts"))
    found = {r["stem"]: r["docs"] for r in support.where(f"docs >= {SUPPORT} and contexts >= {SUPPORT}").collect()}

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                own = set(_WORD.findall((text or "").lower()))
                counts.update({s for w in own for s in (w + "$", *(w[:n] for n in STEM_SIZES if len(w) >= n)) if s in found})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])

    clean = texts.where("label = 0").select("doc", "text").mapInArrow(others, "stem string, n long")
    against = {r[0]: r[1] for r in clean.groupBy("stem").agg(F.sum("n")).collect()}
    sizes = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    odds = {s: math.log((t + 0.5) / (n_toxic + 1)) - math.log((against.get(s, 0) + 0.5) / (n_clean + 1)) for s, t in found.items() if t / (t + against.get(s, 0)) >= PURITY}
    most = max((found[s] for s in odds), default=0)
    odds = {s: o for s, o in odds.items() if found[s] >= SUPPORT_SHARE * most}
    # The chance that a harmless stem shows up in toxic texts only must be small beside the number of stems.
    share = n_toxic / max(1, n_toxic + n_clean)
    odds = {s: o for s, o in odds.items() if found[s] * -math.log(max(share, 1e-9)) > math.log(max(2, len(found)) * 20)}
    chosen = {}
    for s in sorted(odds, key=len):
        if any(c != s and s.startswith(c) for c in chosen):
            continue
        longer = [x for x in odds if x.startswith(s) and found[x] >= 0.97 * found[s]]
        best = max(longer, key=len, default=s)
        chosen[best] = odds[best]
    top = max(chosen.values(), default=1.0)
    weights = {s: max(0.5, o / top) for s, o in chosen.items()}
    return {s[:-1]: w for s, w in weights.items() if s.endswith("$")}, {s: w for s, w in weights.items() if not s.endswith("$")}


def fit_scale(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over log(1 + evidence), by
    Newton steps with a weak prior; slope 4 and intercept -2 without labels
    of both kinds."""
    if len(set(label.tolist())) < 2:
        return 4.0, -2.0
    x = np.stack([np.log1p(evidence), np.ones(len(evidence))], axis=1)
    beta, prior = np.array([4.0, -2.0]), np.array([0.02, 0.02])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - label) + prior * (beta - [4.0, -2.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), grad)
        beta = beta - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (4.0, -2.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, evidence) per row of ``docs``: score
    in 0..1 for ``labels.toxic`` = 1, predicted 1 from 0.5.

    Null and empty texts have no evidence and the lowest score.  Repeated rows
    score alike; a null id is not held out and has no label.  Only the text is
    scored: labels, ids and other columns are never inputs.
    """
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, id_col, text_col)
    words, stems = learned_lexicon(sample)
    grammar = Grammar({w: 1.0 for w in INSULTS} | words, stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.evidence(t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "label"])

    points = sample.mapInArrow(measure, "x double, label double").collect()
    slope, base = fit_scale(np.array([r["x"] for r in points]), np.array([r["label"] for r in points]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([grammar.evidence(t) for t in b.column(1).to_pylist()], dtype=np.float64)
            s = 1 / (1 + np.exp(-np.clip(slope * np.log1p(x) + base, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x)], names=["id", "held_out", "score", "predicted", "evidence"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(score, "id long, held_out boolean, score double, predicted int, evidence double").withColumnRenamed("id", id_col)
