"""Toxicity of texts: a learned lexicon, met through Levenshtein automata, read in context.

learn() finds from labelled texts which words and word beginnings mark toxic
ones, and takes as few as cover them. The words are kept in a trie; a Levenshtein automaton runs along it, as a
lazily determinised product whose states are sets of (trie node, edits so far),
so misspelled terms are found in one pass over a word and most words leave at
once. Each place found is looked at in a window of words around it: a term in
quotation marks, or near words of reporting and without an address, is
quotation rather than abuse and counts for its own, weaker feature. A logistic
model over the three sums (exact, misspelled, quoted) gives the score.

Only texts and labels are inputs. The sample is bounded (rows, a parameter); the
lexicon's counts, the model and the broadcast are bounded with it. All documents
are scored in whole.

Edge cases: null and empty texts have no hits and get the score of a text
without any; rows of labels with a null id or label are not learned from, an id
labelled twice counts once, by its largest label; without labels of both kinds
there is no lexicon and every score is the share of the larger kind that is
toxic (0 without any). Extra columns pass through; a column named score or hits
gives way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import durable, kept, release, ship

WORD = re.compile(r"[^\W_]+")
QUOTED = re.compile(r'"[^"\n]+"|“[^”\n]+”|«[^»\n]+»|„[^“\n]+“')
#: Words of reporting, and of addressing somebody, in English, French, German and Spanish.
REPORTS = frozenset("said says quote quoted quotes word words term slur called wrote writes dit mot disait sagte sagt wort nannte dijo dice palabra".split())
ADDRESSES = frozenset("you your youre u tu vous toi du ihr sie dich usted eres".split())


class Automaton:
    """A trie of whole words (with edits) and of beginnings (exact), as one lazy automaton."""

    def __init__(self, words: list[str], stems: list[str], edits: int = 1, shortest: int = 5, most: int = 50_000):
        self.kids: list[dict[str, int]] = [{}]
        self.word_edits, self.stem, self.room = [-1], [False], [0]
        for w in words:
            allowed = edits if len(w) >= shortest else 0
            node = self._add(w, allowed)
            self.word_edits[node] = allowed
        for s in stems:
            self.stem[self._add(s, 0)] = True
        self.most, self.arcs = most, {}
        self.start = self._closed({(0, 0, "")})

    def _add(self, word: str, allowed: int) -> int:
        node = 0
        self.room[0] = max(self.room[0], allowed)
        for c in word:
            nxt = self.kids[node].get(c)
            if nxt is None:
                nxt = self.kids[node][c] = len(self.kids)
                self.kids.append({})
                self.word_edits.append(-1)
                self.stem.append(False)
                self.room.append(0)
            node = nxt
            self.room[node] = max(self.room[node], allowed)
        return node

    def _closed(self, states: set) -> frozenset:
        """With all states that leaving out letters of a term leads to."""
        todo = list(states)
        while todo:
            node, e, due = todo.pop()
            if due or e >= self.room[node]:
                continue
            for kid in self.kids[node].values():
                if e + 1 <= self.room[kid] and (kid, e + 1, "") not in states:
                    states.add((kid, e + 1, ""))
                    todo.append((kid, e + 1, ""))
        return frozenset(states)

    def _arc(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, due in state:
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            kids = self.kids[node]
            if (kid := kids.get(c)) is not None:
                out.add((kid, e, ""))
            if e < self.room[node]:
                out.add((node, e + 1, ""))
                for x, kid in kids.items():
                    if e + 1 <= self.room[kid]:
                        out.add((kid, e + 1, ""))
                        turned = self.kids[kid].get(c)
                        if turned is not None and x != c and e + 1 <= self.room[turned]:
                            out.add((turned, e + 1, x))
        if len(self.arcs) > self.most:
            self.arcs.clear()
        made = self.arcs[state, c] = self._closed(out)
        return made

    def find(self, word: str) -> int:
        """Edits to the nearest term, -1 if none is near enough."""
        state, arcs = self.start, self.arcs
        for c in word:
            nxt = arcs.get((state, c))
            if nxt is None:
                nxt = self._arc(state, c)
            state = nxt
            if not state:
                return -1
            for node, e, due in state:
                if e == 0 and not due and self.stem[node]:
                    return 0
        return min((e for node, e, due in state if not due and 0 <= e <= self.word_edits[node]), default=-1)


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0, 0.0)
    window: int = 8


class Scorer:
    """A model at work; kept by a Python worker between batches."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.automaton = Automaton(model.words, model.stems)
        self.clean: set[str] = set()
        self.near: dict[str, int] = {}

    def sums(self, text: str) -> tuple[int, int, int]:
        """Places of exact terms, of misspelled ones, and of quoted ones."""
        low = text.lower()
        hits = {}
        for w in set(WORD.findall(low)) - self.clean:
            e = self.near.get(w)
            if e is None:
                e = self.automaton.find(w)
                if e < 0:
                    self.clean.add(w)
                    continue
                self.near[w] = e
            hits[w] = e
        if len(self.clean) > self.most:
            self.clean.clear()
        if len(self.near) > self.most:
            self.near.clear()
        if not hits:
            return 0, 0, 0
        spans, at = [m.span() for m in QUOTED.finditer(low)], 0
        exact = fuzzy = quoted = 0
        all_words = list(WORD.finditer(low))
        for i, m in enumerate(all_words):
            e = hits.get(m[0])
            if e is None:
                continue
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            around = {x[0] for x in all_words[max(0, i - self.model.window) : i + self.model.window + 1]}
            inside = at < len(spans) and spans[at][0] < m.start()
            if inside or (around & REPORTS and not around & ADDRESSES):
                quoted += 1
            elif e:
                fuzzy += 1
            else:
                exact += 1
        return exact, fuzzy, quoted

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.model.weights, features(*self.sums(text))))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def features(exact: float, fuzzy: float, quoted: float) -> tuple[float, ...]:
    """What the logistic model sees: the sums, damped, and whether a text has more than one place."""
    return 1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), float(exact + fuzzy > 1)


def _marks(text: str, longest: int = 12) -> set[str]:
    """A text's words, ended by $, and their beginnings."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:k] for k in range(4, min(longest, len(w)) + 1))
    return out


def _good(counts: list[tuple[str, int, int]], pos: int, neg: int, needed: float, purity: float) -> dict[str, int]:
    """Marks of toxic texts by themselves: how many toxic texts have each."""
    base = pos / (pos + neg)
    return {t: p for t, p, n in counts if p / (p + n) >= purity and p * math.log(p / (p + n) / base) >= needed}


def _lexicon(good: dict[str, int], texts: list[frozenset], least: int = 3, common: float = 0.3) -> tuple[list[str], list[str]]:
    """Words and beginnings that cover the toxic texts, chosen one by one for the most that are not covered yet.

    Texts that are near copies of one another share all their words; once one
    term covers them, the others explain nothing more. Marks nearly as common as
    the commonest chosen one are taken without that. Of marks that begin
    alike and cover nearly the same, the longest is taken. The good whole words
    behind a chosen beginning are kept beside it, for their misspellings.
    """
    having: dict[str, set[int]] = {}
    for i, marks in enumerate(texts):
        for m in marks:
            having.setdefault(m, set()).add(i)
    left, chosen, todo = set(range(len(texts))), [], dict(having)
    while todo:
        mark = max(todo, key=lambda m: (len(todo[m]), len(m), m))
        mark = max((m for m, s in todo.items() if m.startswith(mark) and len(s) >= 0.9 * len(todo[mark])), key=lambda m: (len(m), m))
        gain = todo.pop(mark)
        if len(gain) < least:
            break
        chosen.append(mark)
        left -= gain
        todo = {m: kept for m, s in todo.items() if not (mark.startswith(m) or m.startswith(mark)) and (kept := s - gain)}
    most = max((good[m] for m in chosen), default=0)
    for mark in sorted(good, key=lambda m: (-good[m], -len(m), m)):
        if good[mark] >= common * most and not any(mark.startswith(c) or c.startswith(mark) for c in chosen):
            chosen.append(mark)
    # The whole words behind a beginning stay, for their misspellings.
    stems = sorted(m for m in chosen if not m.endswith("$"))
    behind = {m for m in good if m.endswith("$") and m.startswith(tuple(stems))}
    return sorted(m[:-1] for m in behind.union(m for m in chosen if m.endswith("$"))), stems


def _fit(x: np.ndarray, y: np.ndarray, prior=(-3.0, 2.5, 1.0, 0.5, 1.0), width=(4.0, 2.0, 1.0, 0.5, 2.0), rounds: int = 60) -> tuple[float, ...]:
    """Logistic weights at the mode, around a prior that stays where the data say nothing; Newton steps, halved until they help."""
    a = np.array([features(*row) for row in x])
    m, s = np.array(prior), 1 / np.square(np.array(width))

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (s * (w - m) ** 2).sum())

    w = m.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step, size = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(s), a.T @ (p - y) + s * (w - m)), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 16_000, needed: float = 12.0, purity: float = 0.7, seed: int = 3) -> Model:
    """A model from the labelled documents. rows: those learned from, about, at most."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias("y"))
    n = known.count()
    part = min(1.0, rows / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1_000_000)) < part * 1_000_000)
    sample = durable(docs.select(id, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), id).groupBy("text").agg(F.max("y").cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(weights=(20.0 if pos else -20.0, 0.0, 0.0, 0.0, 0.0))

    def count(wanted):
        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in range(0, len(b), 500):
                    c = Counter()
                    for t in b["text"].iloc[k : k + 500]:
                        marks = _marks(t)
                        c.update(marks if wanted is None else marks & wanted.value)
                    yield pd.DataFrame({"mark": list(c.keys()), "n": list(c.values())}).astype({"mark": "str", "n": "int64"})

        return counted

    def totals(kind: str, wanted) -> DataFrame:
        return sample.where(kind).select("text").mapInPandas(count(wanted), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))

    least = needed / math.log((pos + neg) / pos) if neg else 1
    found = {r["mark"]: r["n"] for r in totals("y > 0", None).where(F.col("n") >= least).collect()}  # bounded by the sample
    wanted = spark.sparkContext.broadcast(frozenset(found))
    against = {r["mark"]: r["n"] for r in totals("y <= 0", wanted).collect()}
    good = _good([(t, p, against.get(t, 0)) for t, p in found.items()], pos, neg, needed, purity)
    marks = spark.sparkContext.broadcast(frozenset(good))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"marks": [sorted(_marks(t) & marks.value) for t in b["text"]]})

    texts = sample.where("y > 0").select("text").mapInPandas(marked, "marks array<string>").collect()  # bounded by the sample
    words, stems = _lexicon(good, [frozenset(r["marks"]) for r in texts])
    model = Model(words, stems)
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.sums(t) for t in b["text"]]
            yield pd.DataFrame(got, columns=["exact", "fuzzy", "quoted"]).assign(y=(b["y"] > 0).astype("int64").to_numpy())

    x = sample.mapInPandas(sums, "exact long, fuzzy long, quoted long, y long").groupBy("exact", "fuzzy", "quoted", "y").count().collect()  # bounded by the sample
    rows_x = np.repeat(np.array([[r["exact"], r["fuzzy"], r["quoted"]] for r in x], np.float64), [r["count"] for r in x], axis=0)
    model.weights = _fit(rows_x, np.repeat([float(r["y"]) for r in x], [r["count"] for r in x]))
    return model


def score(text: Column, model: Model, spark) -> Column:
    """The score of a text, from 0 to 1."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scorer = kept(("scorer", tuple(m.words), tuple(m.stems), m.weights), lambda: Scorer(m))
        for texts in batches:
            yield pa.array([scorer.score(t.as_py() or "") for t in texts], pa.float64())
        release()

    return scored(text)


def held_out(id: str = "doc_id") -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs with score and predicted, learned from the labels of rows that are not held out."""
    model = learn(docs, labels.where(~held_out()), **options)
    return docs.withColumn("score", score(F.col("text"), model, docs.sparkSession)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
