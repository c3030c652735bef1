"""Toxicity by weak supervision: a generative label model over many voters, then a linear classifier.

Texts become sets of hashed features: lower-cased words and their beginnings. From a bounded sample of labelled rows
(SAMPLE_ROWS, chosen by a hash of doc_id) come the voters: a public lexicon of insults, patterns of writing, and the
features that go most with the label; the given label is one more voter. The label model is generative: a class share,
for each voter how often it votes in either class, and for pairs of voters that go together within the classes a factor:
voters form a forest, a voter's rates depend on the class and on its parent's vote, and the forest is that of the largest mutual
information given the class, edges that pay for their two parameters only (by BIC). Everything is estimated by expectation
maximisation from the voters' agreement, starting from how many of them vote; the label's own error rates are estimated like
any other's. The label is no voter's parent or child, and tells which class is the toxic one. Copies of a text count once.
A logistic regression on the features is then trained on the posteriors, never on the labels themselves, and scores every text.

What it is not: which features become voters is found with the label; a forest has one parent for each voter, so a voter that goes
with several others is tied to the nearest. A very long text is one row.

Score: 0 to 1, higher for likelier toxic. Null and empty texts get the score of a text without features. Without any
labelled row, or with labels of one kind only, the lexicon and pattern voters alone make the label model. A null label
or doc_id is not learned from. Repeated rows are scored each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.runtime import release, texts_of

#: At most about so many labelled rows are learned from.
SAMPLE_ROWS = 10_000
HASH_BITS = 20
#: Voters mined from the sample, and features of the linear model.
MINED, FEATURES = 400, 4_000
#: Evidence (nats against chance) that makes a feature a voter, or a feature of the linear model.
VOTER_EVIDENCE, FEATURE_EVIDENCE = 14.0, 9.0
#: Least share of toxic rows among those that a mined voter votes on.
VOTER_RATE = 0.8
THRESHOLD = 0.3
#: Common English insults.
LEXICON = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "dumb", "imbecile", "filth", "garbage", "jerk", "creep", "fool", "ugly", "vermin", "freak")
#: Patterns of writing that may vote; the label model finds out whether they mean anything.
PATTERNS = (r"!{2,}", r"\b[A-Z]{4,}\b", r"[*#$%&@]{3,}", r"\byou(?:'re| are)\b", r"(\w)\1{3,}")
WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(p) for p in PATTERNS]


def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << HASH_BITS) - 1)


class _WordFeatures(dict):
    def __missing__(self, word: str) -> bytes:
        names = {"w " + word, *(f"b {word[:n]}" for n in (3, 4, 5, 6) if len(word) > n)}
        value = np.array(sorted(hashed(n) for n in names), np.uint32).tobytes()
        if len(self) < 300_000:
            self[word] = value
        return value


_WORDS = _WordFeatures()


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a text, ascending."""
    return np.unique(np.frombuffer(b"".join(map(_WORDS.__getitem__, set(WORD.findall(text.lower())))), np.uint32)) if text else np.zeros(0, np.uint32)


def pattern_votes(text: str) -> int:
    return sum(1 << i for i, p in enumerate(_PATTERNS) if p.search(text))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    voters: int

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.weights[features(t)].sum() if t else 0.0 for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def joint_votes(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[a, b, j, k]: weighted rows where voter j votes a and voter k votes b."""
    w = weight.astype(np.float32)
    both = sum(((votes[a : a + 1000] * w[a : a + 1000, None]).T @ votes[a : a + 1000]).astype(float) for a in range(0, len(votes), 1000))
    own, total = np.diag(both), float(weight.sum())
    return np.maximum(np.array([[total - own[:, None] - own + both, own - both], [own[:, None] - both, both]]), 0)


def information(joint: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters, times the rows' weight."""
    own, other, total = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True), joint.sum((0, 1)) + 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(joint > 1e-9, joint * np.log(joint * total / (own * other)), 0).sum((0, 1))


def forest(gain: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent, -1 if none, in the maximum spanning forest over the gains above `least`."""
    m = len(gain)
    parent, best, left = np.full(m, -1), np.full(m, least, float), np.ones(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(left, best, -np.inf)))
        left[j] = False
        closer = left & (gain[j] > best)
        best[closer], parent[closer] = gain[j][closer], j
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray | None = None, alone: int = 0, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes: rows x voters, 0 or 1. start: first posterior. weight: how much a row counts. The last `alone` voters have
    no factors with others. (posterior, vote rates in class 1 and 0 by voter, parent of each voter)."""
    votes = votes.astype(np.float32)
    n, m = votes.shape
    weight = np.ones(n) if weight is None else weight
    posterior, parent, own = start.astype(float), np.full(m, -1), np.arange(m)
    for step in range(rounds):
        classes = (posterior * weight, (1 - posterior) * weight)
        joint = [joint_votes(votes, c) for c in classes]
        if step % 5 == 0:
            # The first posterior is no estimate yet: taken as it is, the class itself would show as factors.
            gain = sum(map(information, joint if step else [joint_votes(votes, weight * side) for side in (posterior > 0.5, posterior <= 0.5)]))
            gain[m - alone :], gain[:, m - alone :] = 0, 0
            parent = forest(gain, np.log(max(2.0, weight.sum())))
        child = np.flatnonzero(parent >= 0)
        above = parent[child]
        prior = np.clip(classes[0].sum() / max(1e-9, weight.sum()), 1e-4, 1 - 1e-4)
        z, rates = np.full(n, np.log(prior / (1 - prior))), []
        for sign, j, c, floor in ((1, joint[0], classes[0], 0.5), (-1, joint[1], classes[1], 0.05)):
            rate = np.clip((j[1, 1, own, own] + floor) / (c.sum() + 2), 1e-6, 1 - 1e-6)
            # Log odds of a vote, and log chance of none, given the parent's vote 0 or 1; rates draw towards the voter's own.
            given = [np.clip((j[1, b, child, above] + rate[child]) / (j[:, b, child, above].sum(0) + 1), 1e-6, 1 - 1e-6) for b in (0, 1)]
            base = rate.copy()
            base[child] = given[0]
            none, odds = np.log(1 - base), np.log(base / (1 - base))
            linear = odds + np.bincount(above, weights=np.log((1 - given[1]) / (1 - given[0])), minlength=m)
            pairs = np.log(given[1] / (1 - given[1])) - odds[child]
            z += sign * (none.sum() + votes @ linear.astype(np.float32) + (votes[:, child] * votes[:, above]) @ pairs.astype(np.float32))
            rates.append(rate)
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return posterior, np.stack(rates), parent


def logistic(at: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, steps: int = 250, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for rows columns[at[i]:at[i+1]] (presence of features) by Adam on the soft labels."""
    row = np.repeat(np.arange(len(target)), np.diff(at))
    w, b = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[columns], minlength=len(target)) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        g = np.append(np.bincount(columns, weights=gap[row], minlength=width) + penalty * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(rows: list[np.ndarray], patterns: np.ndarray, toxic: np.ndarray) -> Model:
    """From the features, pattern votes and labels of the sample."""
    weights = np.zeros(1 << HASH_BITS, np.float32)
    if not rows:
        for w in LEXICON:
            weights[hashed("w " + w)] = 6
        return Model(weights, -3.0, len(LEXICON))
    size = 1 << HASH_BITS
    # Copies of one text would make its rare words look telling: of rows with the same four smallest hashes one counts.
    least = {}
    for i, f in enumerate(rows):
        h = np.sort(f * np.uint32(2654435761))[:4] if len(f) else f
        least.setdefault((h.tobytes(), toxic[i]), i)
    counts = np.zeros(len(rows))
    counts[list(least.values())] = 1
    n_on, n_off = max(1.0, (toxic * counts).sum()), max(1.0, ((1 - toxic) * counts).sum())
    on, off = np.zeros(size), np.zeros(size)
    for f, label, counted in zip(rows, toxic, counts, strict=True):  # a row's features are distinct
        if counted:
            (on if label else off)[f] += 1
    base, rate = n_on / (n_on + n_off), np.clip(on / np.maximum(on + off, 1), 1e-9, 1 - 1e-9)
    #: Log-likelihood ratio of "goes with the label" against chance, for features that are likelier in toxic texts.
    evidence = np.where(rate > base, on * np.log(rate / base) + off * np.log((1 - rate) / (1 - base)), 0)
    both_kinds = 0 < toxic.sum() < len(toxic)
    mined = np.argsort(-evidence, kind="stable")[:MINED]
    mined = mined[(evidence[mined] >= VOTER_EVIDENCE) & (rate[mined] > VOTER_RATE)] if both_kinds else mined[:0]
    voters = np.unique(np.concatenate([mined, [hashed("w " + w) for w in LEXICON]])).astype(np.int64)
    number = np.full(size, -1)
    number[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters) + len(PATTERNS)), np.float32)
    for i, f in enumerate(rows):
        own = number[f]
        votes[i, own[own >= 0]] = 1
    for i in range(len(PATTERNS)):
        votes[:, len(voters) + i] = patterns >> i & 1
    lexical = votes[:, number[[hashed("w " + w) for w in LEXICON]]].max(1)
    if both_kinds:
        agreed = votes[:, : len(voters)].sum(1)
        posterior, rates, _ = label_model(np.column_stack([votes, toxic]), np.where(agreed > 1, 0.95, np.where(agreed == 1, 0.7, 0.02)), counts, alone=1)
        if rates[0, -1] < rates[1, -1]:  # the class where the label is rarer
            posterior = 1 - posterior
    else:
        posterior, _, _ = label_model(votes, np.clip(lexical, 0.05, 0.95), counts)
    chosen = np.argsort(-evidence, kind="stable")[:FEATURES]
    chosen = np.unique(np.concatenate([chosen[evidence[chosen] >= FEATURE_EVIDENCE], voters]))
    number = np.full(size, -1)
    number[chosen] = np.arange(len(chosen))
    own = [k[k >= 0] for k in (number[f] for f in rows)]
    w, b = logistic(np.cumsum([0, *map(len, own)]), np.concatenate(own), posterior, len(chosen))
    weights[chosen] = w
    return Model(weights, b, votes.shape[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, excluded: Callable[[Column], Column] = held_out) -> Model:
    """A model from labelled rows that `excluded` doesn't hold out."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~excluded(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = 1_000_000 if n <= sample_rows else int(1_000_000 * sample_rows / n)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = texts_of(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([features(t).tobytes() for t in own], pa.binary()), pa.array([pattern_votes(t) for t in own], pa.int32())], names=["doc_id", "features", "patterns"])
        _WORDS.clear()
        release()

    found = chosen.join(texts, "doc_id").select("doc_id", "text").mapInArrow(extract, "doc_id long, features binary, patterns int").join(chosen, "doc_id").orderBy("doc_id").limit(2 * sample_rows).toArrow()
    rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in found["features"]]
    try:
        return fit(rows, found["patterns"].to_numpy().astype(np.int64), (found["toxic"].to_numpy() > 0).astype(float))
    finally:
        del rows, found
        release()


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column."""
    spark = docs.sparkSession
    nonzero = np.flatnonzero(model.weights)
    sent = spark.sparkContext.broadcast((nonzero, model.weights[nonzero], model.bias))  # at most FEATURES and the voters

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        where, weights, bias = sent.value
        full = np.zeros(1 << HASH_BITS, np.float32)
        full[where] = weights
        own = Model(full, bias, 0)
        for batch in texts:
            yield pd.Series(own.scores(["" if t is None else t for t in batch]))
        _WORDS.clear()  # a worker lives on after its task
        release()

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col(f"`{text_col}`")))

