"""Toxicity by weak supervision: many lexicon and pattern voters, a label model, a linear classifier.

Training looks at a bounded sample of labelled rows. Marks of toxic texts become voters: a lexicon
voter fires on a word, a pattern voter on any longer word with a certain beginning, or on two such
words. A mark needs support by different rows and precision. A clean voter fires where no other
does, and the given label is one more voter, an annotator who may err. A generative model of their
votes with a hidden label is fitted by expectation maximisation: it estimates how often each voter
fires on either label and, from the votes that the label leaves unexplained, how voters depend on each
other; the votes of dependent voters count for less. A logistic regression on the text's voters is
then fitted to the posterior labels and scores every text.

A NULL or empty text fires only the clean voter and gets a low score. Labels of NULL are left out.
Repeated rows are scored alike. With no toxic training row, every score is 0. An empty table gives
no rows. Only the text is an input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import batches_of_text, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word's beginning that pattern voters look at.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Bytes of text that are scored at a time, and words whose voters are remembered; both only bound memory.
SCORE_BYTES, REMEMBERED = 1 << 20, 100_000
#: Multipliers of the four min-hashes that tell training rows apart.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of rows that no label is learnt from."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def bounded(words: set[str], limit: int) -> Iterable[str]:
    """The words, or those with the smallest hashes that fit into ``limit`` bytes with a space each."""
    if sum(map(len, words)) * 4 + len(words) <= limit:
        return words
    kept, room = [], limit
    for word in sorted(words, key=lambda w: (zlib.crc32(w.encode()), w)):
        room -= len(word.encode()) + 1
        if room < 0:
            break
        kept.append(word)
    return kept


def marks_of(words: Iterable[str]) -> set[str]:
    """Words as they are; beginnings of longer words with a plus, with two if two words have them."""
    longer = Counter(word[:n] for word in words for n in PREFIXES if len(word) > n)
    return {*words, *(f"{p}+" for p in longer), *(f"{p}++" for p, k in longer.items() if k > 1)}


@dataclass
class ToxicityModel:
    """Voters and their weights; small, whatever it was trained on."""

    voters: list[str]
    weights: np.ndarray  # of the voters, then of the numbers of ``totals``
    bias: float

    def __post_init__(self) -> None:
        self.place = {v: i for i, v in enumerate(self.voters)}
        self.begins = {v.rstrip("+") for v in self.voters if v.endswith("+")}
        self.cache: dict[str, tuple[str, ...]] = {}

    def fired(self, words: set[str]) -> set[int]:
        found = {self.place[w] for w in words if w in self.place}
        longer: Counter[str] = Counter()
        for word in words:
            hits = self.cache.get(word)
            if hits is None:
                if len(self.cache) >= REMEMBERED:
                    self.cache.clear()
                hits = tuple(word[:n] for n in PREFIXES if len(word) > n and word[:n] in self.begins)
                self.cache[word] = hits
            if hits:
                longer.update(hits)
        for beginning, times in longer.items():
            for mark in (f"{beginning}+", f"{beginning}++")[: 1 + (times > 1)]:
                if mark in self.place:
                    found.add(self.place[mark])
        return found

    def score(self, text: str) -> float:
        if not self.voters:
            return 0.0
        words = words_of(text)
        fired = self.fired(words)
        total = self.bias + sum(self.weights[i] for i in fired) + self.weights[len(self.voters) :] @ totals(len(fired), len(words))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def totals(fired: int, words: int) -> np.ndarray:
    """What the classifier knows besides the voters: how many fired, whether none did, the text's size."""
    return np.array([np.log1p(fired), float(fired == 0), np.log1p(words) / 5])


def choose_voters(rows: list[tuple[str, int]], *, most: int, support: int, precision: float) -> list[str]:
    """Marks found in at least ``support`` different toxic rows, almost only there; the strongest ``most``.

    Copies of a text would lend support to all of its words. So rows are told apart by a min-hash of
    their marks, under four hash functions, and a mark counts by the function that tells fewest apart.
    Rows are their distinct words in one string; marks are made row by row, to keep memory small.
    """
    toxic: Counter[str] = Counter()
    for words, label in rows:
        if label:
            toxic.update(marks_of(words.split()))
    candidates = {mark for mark, hits in toxic.items() if hits >= support}
    clean: Counter[str] = Counter()
    different: dict[str, list[set[int]]] = {mark: [set() for _ in MULTIPLIERS] for mark in candidates}
    for words, label in rows:
        marks = marks_of(words.split())
        if not label:
            clean.update(marks & candidates)
            continue
        hashes = np.array([zlib.crc32(m.encode()) for m in marks] or [0], np.uint64)
        least = [int((hashes * np.uint64(k) % np.uint64(4294967291)).min()) for k in MULTIPLIERS]
        for mark in marks & candidates:
            for seen, x in zip(different[mark], least, strict=True):
                seen.add(x)
    n_toxic = max(1, sum(label for _, label in rows))
    n_clean = max(1, len(rows) - n_toxic)
    ranked = []
    for mark, seen in different.items():
        hits = min(map(len, seen))
        if hits >= support and hits / (hits + clean[mark] + 0.1) >= precision:
            ranked.append((hits * np.log((hits / n_toxic + 1e-4) / (clean[mark] / n_clean + 1e-4)), mark))
    return [mark for _, mark in sorted(ranked, key=lambda x: (-x[0], x[1]))[:most]]


def label_model(votes: np.ndarray, prior: float, turns: int = 30, dependent: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label, firing rates per label and voter, and dependence weights.

    ``votes`` holds 0 or 1 per row and voter; the last columns are the clean voter and the annotator,
    whose labels are the first guess. Each round gives
    posteriors from rates and weights, then rates from posteriors. After a few rounds the
    correlation of what the label leaves unexplained is measured; the weight of a voter is one over
    its total correlation with voters it depends on, itself included. The clean voter is the
    others' silence and the annotator stands alone, so both are left out of that.
    """
    n, m = votes.shape
    posterior = np.where(votes[:, -1] == 1, 0.98, 0.02 * prior)
    weight, rates = np.ones(m), np.zeros((2, m))
    for turn in range(turns):
        for label, share in ((0, 1 - posterior), (1, posterior)):
            rates[label] = (share @ votes + 0.1) / (share.sum() + 1.0)
        if turn == 3:
            left = votes - np.outer(posterior, rates[1]) - np.outer(1 - posterior, rates[0])
            left = left[:, :-2] * np.sqrt(posterior)[:, None]  # toxic voters hardly fire on clean rows
            scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
            correlation = np.abs(left.T @ left) / np.outer(scale, scale)
            weight[:-2] = 1 / np.maximum(1.0, np.where(correlation > dependent, correlation, 0).sum(axis=1))
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        odds = np.log(prior / (1 - prior)) + votes @ (weight * on) + (1 - votes) @ (weight * off)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, rates, weight


def fit_linear(features: np.ndarray, target: np.ndarray, ridge: float = 1e-3, turns: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by damped Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) / len(x) + penalty * w
        curve = (x.T * (p * (1 - p))) @ x / len(x) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 4_000,
    max_voters: int = 600,
    support: int = 4,
    precision: float = 0.75,
    word_bytes: int = 65_536,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fifth.

    The sample takes rows by a hash of ``doc_id``; each row reaches the driver as its distinct words, in at most
    ``word_bytes`` bytes: of a larger vocabulary, the words with the smallest hashes. An id that is repeated counts
    once, with its smallest text and its highest label. Scores read all words of all texts.
    """
    chosen = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .withColumn("at", F.xxhash64("doc_id"))
        .orderBy("at", "doc_id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label", "at").agg(F.min("text").alias("text"))

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches, limit=SCORE_BYTES):
            words = [" ".join(sorted(bounded(words_of(t), word_bytes))) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(words)], ["label", "at", "words"])

    sample = rows.mapInArrow(tidy(distinct), "label int, at long, words string").collect()
    sample = sorted((r["at"], r["words"], r["label"]) for r in sample)
    return fit([(words, label) for _, words, label in sample], max_voters, support, precision)


def fit(rows: list[tuple[str, int]], max_voters: int = 600, support: int = 4, precision: float = 0.75) -> ToxicityModel:
    voters = choose_voters(rows, most=max_voters, support=support, precision=precision)
    if not voters:
        return ToxicityModel([], np.zeros(3), 0.0)
    place = {v: i for i, v in enumerate(voters)}
    votes, sizes = np.zeros((len(rows), len(voters) + 2)), []
    for i, (words, label) in enumerate(rows):
        fired = [place[m] for m in marks_of(words.split()) if m in place]
        votes[i, fired] = 1
        votes[i, -2:] = (not fired, label)
        sizes.append(totals(len(fired), len(words.split())))
    posterior, _, _ = label_model(votes, float(np.clip(votes[:, -1].mean(), 1e-3, 0.5)))
    weights, bias = fit_linear(np.hstack([votes[:, :-2], np.stack(sizes)]), posterior)
    return ToxicityModel(voters, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score; a column of that name is replaced."""
    kept = [f for f in docs.schema if f.name.lower() != column.lower()]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches, limit=SCORE_BYTES):
            scores = pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), scores], [*names, column])

    schema = docs.select(*[f"`{c}`" for c in names]).schema.add(column, "double")
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(tidy(run), schema)
