"""Toxicity scores from a lexicon that tolerates misspelling, with the context of each hit.

The lexicon (words, and stems that many words begin with) is learned from labelled rows. Its trie is
intersected with the Levenshtein automaton of one edit: a state is a set of trie nodes with the edits
spent so far, made deterministic as words are read and remembered, so most words end in the dead state
after a few characters. Each hit is judged in its context: between the quotation marks of its line, and
in its window of words reported, or addressed to somebody. The judgement's points are fixed; what quoted
and unquoted hits weigh is learned: a logistic regression over their counts gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import hold, learn_split, materialize, slices

#: The bound of the training sample: labelled documents of either class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 12_000
#: A term is learned if so many, and such a share, of the toxic sample texts have it, and so small a share of the clean ones.
LEAST_TOXIC, LEAST_SHARE, MOST_CLEAN, LEAST_ODDS = 5, 0.015, 0.002, 20.0
#: A word near the lexicon is none of its misspellings if so many clean sample texts use it outside quotation, unless toxic texts do so this much oftener.
LEAST_KNOWN, KNOWN_ODDS = 2, 4.0
STEMS = range(4, 9)
#: Terms shorter than this have to be spelled right. Stems match only as they are; the words they were learned from tolerate an edit.
FUZZY_FROM = 5
WINDOW_WORDS = 6
REMEMBERED_WORDS = 400_000
NONE, EXACT, FUZZY = 0, 1, 2
#: Words that report speech and words that address somebody, in the corpus' languages.
REPORTING = frozenset("said says called calls quoted quote word term wrote dit disait mot sagte nannte wort dijo llamó palabra".split())
ADDRESSING = frozenset("you your yours u ur du dich dein deine ihr euch tu toi te vous votre tú usted vosotros tus eres".split())
#: Quotation marks, but for those between two letters, which are apostrophes.
_QUOTE = re.compile("(?<![^\\W\\d_])[\"“”„«»‚‘’]|[\"“”„«»‚‘’](?![^\\W\\d_])")
#: Signs that stand for letters in misspelled words stay inside words; all other marks, symbols and blanks part them.
_PART = {i: " " for i in range(0x20000) if unicodedata.category(chr(i)) in ("Cc", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "Sc", "Sk", "Sm", "So", "Zl", "Zp", "Zs") and chr(i) not in "@$*!"}
_WORD = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    return [w.strip("@$*!") for w in text.lower().translate(_PART).split()]


def placed_words(low: str) -> list[tuple[int, int, str]]:
    """Where each of words_of(text) stands in the text's lower-case form, and the word."""
    return [(m.start(), m.end(), m[0].strip("@$*!")) for m in _WORD.finditer(low.translate(_PART))]


class Automaton:
    """The trie of the lexicon, intersected with the automaton of at most one edit."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}  # node: length of the word that ends there
        self.stem_at: set[int] = set()
        for term, stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node = 0
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                node = self.child[node][c]
            if stem:
                self.stem_at.add(node)
            else:
                self.word_at[node] = len(term)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.stemmed: list[bool] = []
        self.kind: list[int] = []
        self.dead = self.state(frozenset())
        self.start = self.state(self.closed({(0, 0)}))

    def closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With what one left-out letter of the lexicon reaches, and without what a cheaper twin covers."""
        more = states | {(n, 1) for node, e in states if e == 0 for n in self.child[node].values()}
        return frozenset((n, e) for n, e in more if e == 0 or (n, 0) not in more)

    def state(self, states: frozenset) -> int:
        if states not in self.states:
            self.states[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            self.stemmed.append(any(n in self.stem_at and e == 0 for n, e in states))
            ends = [EXACT if e == 0 else FUZZY for n, e in states if n in self.word_at and (e == 0 or self.word_at[n] >= FUZZY_FROM)]
            self.kind.append(min(ends, default=NONE))
        return self.states[states]

    def step(self, at: int, c: str) -> int:
        to = set()
        for node, e in self.sets[at]:
            if c in self.child[node]:
                to.add((self.child[node][c], e))
            if e == 0:
                to.add((node, 1))
                to.update((n, 1) for n in self.child[node].values())
        n = self.next[at][c] = self.state(self.closed(to))
        return n

    def read(self, word: str) -> int:
        """EXACT, FUZZY or NONE for a word."""
        at = self.start
        for c in word:
            n = self.next[at].get(c)
            at = self.step(at, c) if n is None else n
            if self.stemmed[at]:
                return EXACT
            if at == self.dead:
                return NONE
        return self.kind[at]


class _Read(dict):
    """What the automaton says of words, each read once; known words are no misspellings."""

    def __init__(self, model: Model):
        super().__init__(dict.fromkeys(model.known, NONE))
        self.automaton = Automaton(model.words, model.stems)

    def __missing__(self, word: str) -> int:
        k = self[word] = self.automaton.read(word)
        return k


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    known: list[str] = field(default_factory=list)  # words one edit from the lexicon that are words of their own
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0, 0, 0, 0]))
    key: str = ""


_read: dict[str, _Read] = {}


def _reader(model: Model) -> _Read:
    hold("toxicity", _read.clear)
    if model.key not in _read or len(_read[model.key]) > REMEMBERED_WORDS:
        _read.clear()
        _read[model.key] = _Read(model)
    return _read[model.key]


def hits(read: _Read, text: str) -> Iterator[tuple[str, int, bool]]:
    """word, EXACT or FUZZY, and whether it stands in quotation, of each hit of a text.

    Two points for standing between the marks of its line (an odd number of marks before it and another one behind
    it), one for a reporting word in its window, one less for an addressing word; from two points on it is quoted."""
    if not any(map(read.__getitem__, words_of(text))):
        return
    low = text.lower()
    placed = placed_words(low)
    marks, breaks = [m.start() for m in _QUOTE.finditer(low)], [i for i, c in enumerate(low) if c == "\n"]
    for i, (start, end, word) in enumerate(placed):
        kind = read[word]
        if not kind:
            continue
        near = [w for _, _, w in placed[max(0, i - WINDOW_WORDS) : i] + placed[i + 1 : i + 1 + WINDOW_WORDS]]
        line = bisect_left(breaks, start)
        first, here = bisect_left(marks, breaks[line - 1] if line else 0), bisect_left(marks, start)
        after = bisect_left(marks, end)
        closed = after < len(marks) and (line == len(breaks) or marks[after] < breaks[line])
        quoted = (here - first) % 2 == 1 and closed
        yield word, kind, (2 * quoted + any(x in REPORTING for x in near) - any(x in ADDRESSING for x in near)) >= 2


def features(read: _Read, text: str) -> list[float]:
    """1, abusive hits, misspelled hits, quoted hits, all as log1p, and whether anything isn't a quotation."""
    counts = Counter("quoted" if quoted else kind for _, kind, quoted in hits(read, text))
    return [1.0, float(np.log1p(counts[EXACT])), float(np.log1p(counts[FUZZY])), float(np.log1p(counts["quoted"])), float(counts[EXACT] > 0)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column is the constant and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + shrink * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, stem, best: counts of the documents of a slice that have a word, or a word that begins with a stem."""
    for b in slices(batches, "text"):
        n: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = {w for w in words_of(text) if len(w) >= 3}
            for term in {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}:
                n.setdefault(term, [0, 0])[toxic] += 1
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([n[k][1] for k in keys], pa.int64()), pa.array([n[k][0] for k in keys], pa.int64())],
            ["term", "stem", "toxic", "clean"],
        )


def _features(model: Model):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            read = _reader(model)
            x = [features(read, t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    return extract


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            read = _reader(model)
            x = np.array([features(read, t or "") for t in b.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return score


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """doc_id, text, toxic of about so many learning documents of either class, chosen by the hash of the id.

    Rows without id, text or a label of 0 or 1, and held-out rows, aren't learned from; an id with both labels is toxic."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(~learn_split("l_id"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(toxic / max(1, n.get(1, 0)))).otherwise(F.lit(clean / max(1, n.get(0, 0))))
    chosen = known.filter(F.pmod(F.xxhash64("l_id", F.lit("toxic")), F.lit(1 << 40)) < share * (1 << 40))
    # the choice holds about toxic + clean ids, whatever the corpus has
    return materialize(docs.filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic"), "toxic-sample")


def train_toxicity(docs: DataFrame, labels: DataFrame, lexicon: list[str] | None = None, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """A model learned from docs (doc_id, text) and labels (doc_id, toxic); lexicon: words to know besides.

    Without toxic labels only the given lexicon counts, and every score is low."""
    import uuid

    sample = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample_toxic, sample_clean)
    different = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies of a text prove nothing more
    total = {r["toxic"]: r["count"] for r in different.groupBy("toxic").count().collect()}
    t_all, c_all = max(1, total.get(1, 0)), max(1, total.get(0, 0))
    counted = different.mapInArrow(_terms, "term string, stem boolean, toxic long, clean long")
    counted = counted.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") / t_all) / ((F.col("clean") + 0.5) / c_all)
    good = materialize(counted.filter((F.col("toxic") >= max(LEAST_TOXIC, LEAST_SHARE * t_all)) & (F.col("clean") <= MOST_CLEAN * c_all) & (odds >= LEAST_ODDS)), "toxic-terms")
    # the lexicon has a few of the sample's words, and the sample is bounded
    found = good.select("term", "stem", "toxic").collect()
    word_n = {r["term"]: r["toxic"] for r in found if not r["stem"]}
    best: dict[str, int] = {}
    for w, k in word_n.items():
        for i in STEMS:
            best[w[:i]] = max(best.get(w[:i], 0), k)
    stems = {r["term"] for r in found if r["stem"] and r["toxic"] >= 1.3 * best.get(r["term"], 0)}
    stems = {s for s in stems if not any(s[:i] in stems for i in range(min(STEMS), len(s)))}
    # a stem has its words read exactly; each of them is in the lexicon besides, so that an edit inside the stem is one of a word
    inflected = different.filter("toxic = 1").mapInArrow(_inflected(sorted(stems)), "term string").distinct().collect() if stems else []
    words = sorted({*word_n, *(w.lower() for w in lexicon or []), *(r["term"] for r in inflected)})
    model = Model(words, sorted(stems), key=uuid.uuid4().hex)
    near = different.mapInArrow(_near(model), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model.known = sorted(r["term"] for r in near.filter((F.col("clean") >= LEAST_KNOWN) & (odds < KNOWN_ODDS)).select("term").collect())
    model.key = uuid.uuid4().hex
    rows = sample.mapInArrow(_features(model), "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    if total.get(1) and total.get(0):
        model.weights = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float))
    model.key = uuid.uuid4().hex
    return model


def _inflected(stems: list[str]):
    """term: the words of a slice that begin with a stem."""

    def inflected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([], stems)
        for b in slices(batches, "text"):
            words = {w for text in b.column("text").to_pylist() for w in words_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if automaton.read(w) == EXACT], pa.string())], ["term"])

    return inflected


def _near(model: Model):
    """term, toxic, clean: counts of the documents of a slice that have a misspelled hit outside quotation."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            read = _reader(model)
            n: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for w in {w for w, kind, quoted in hits(read, text) if kind == FUZZY and not quoted}:
                    n.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([k[1] for k in n.values()], pa.int64()), pa.array([k[0] for k in n.values()], pa.int64())], ["term", "toxic", "clean"])

    return near


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs; a null or empty text has the score of no hits.

    Null ids and repeated rows keep their rows; other columns don't matter; empty tables give none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")
