"""Toxic spans and scores by a linear-chain conditional random field.

Labels are of documents; tokens get theirs from them. A feature (a word, or the
first 3 to 7 letters of one) marks toxicity if the labelled sample has it in
toxic documents far more than chance allows, counting each pair of neighbouring
words once, so that copies of one passage don't add up. Tokens of toxic
documents with such a feature are labelled toxic, all others clean, and a
two-state chain is fitted to windows of them: a bias, a weight for each feature,
and the transitions.

Scoring runs forward-backward over every whole text. Tokens without a feature
all have the same potential, so a run of them is a power of one 2 x 2 matrix,
and only tokens with features cost a step. A document's score is the chance
under the chain that any token with a feature is toxic: one less the weight of
the paths that are clean at all of them over that of all paths. Its offending
spans are the tokens with a marginal of a half or more.

The labelled sample is bounded: ``TOXIC`` and ``CLEAN`` documents with the least
hashes of their doc_id, as many of each as have ``SAMPLE_CHARS`` characters
together (longer documents are not drawn); whole texts are learnt from. The
model is bounded to ``MOST_FEATURES``, and of windows without any feature one of
``PLAIN`` is fitted. Nothing bounds what is scored. Documents whose
crc32(doc_id) mod 3 is 1 are held out.

Defined cases: null and empty texts score 0, as does everything where no label
or no toxic label is there to learn from. Very long texts are scored whole. Of
repeated labels for a doc_id the largest holds; null labels are none. Null
doc_ids are scored and not learned from. Ties of hashes go by doc_id, features
with equal statistics by name. Repeated rows are scored alike. An empty table
gives no rows. Other columns pass through or are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.storage import materialise
from quire.llm.textcols import text_or_empty

TOXIC, CLEAN, SAMPLE_CHARS = 1000, 5000, 24_000_000
#: Least distinct contexts, share of toxic ones among them and G-test statistic of a feature.
CONTEXTS, PURITY, STATISTIC = 6, 0.95, 25.0
MOST_FEATURES = 5000
WINDOW, PLAIN, STEPS, RATE, PENALTY = 48, 16, 100, 0.25, 0.02
THRESHOLD, OFFENDING = 0.7, 0.5
MEMO = 500_000
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: Log potentials of going from state (row) to state (column).
    moves: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        step = np.exp(self.moves) * np.exp([0.0, self.bias])
        self.step = step / step.max()
        self.values, self.left = np.linalg.eig(self.step)
        self.right = np.linalg.inv(self.left)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "moves": self.moves}

    def __setstate__(self, state):
        self.__init__(**state)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "bias": self.bias, "moves": self.moves.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        found = json.loads(text)
        return cls(found["weights"], found["bias"], np.array(found["moves"]))

    def lift(self, word: str) -> float:
        """How much a word's features add to the bias; 0 where it has none."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            w = self.weights
            found = self.memo[word] = math.fsum(w[f] for f in features(word) if f in w)
        return found

    def power(self, n: int) -> np.ndarray:
        """The background's matrix to the n, up to a factor."""
        values = self.values / np.abs(self.values).max()
        return np.real(self.left * values**n @ self.right)

    def marginals(self, places: list[int], lifts: list[float], n: int) -> tuple[np.ndarray, float]:
        """The chance of state 1 for each of the tokens at ``places`` among ``n``, and that any of them has it."""
        ups = [np.array([1.0, math.exp(min(x, 50.0))]) for x in lifts]
        runs = [b - a for a, b in zip([-1, *places], places, strict=False)]
        powers = {run: self.power(run) for run in {*runs, n - 1 - places[-1]}}
        alphas, state = [], np.array([1.0, 0.0])  # before the first word stands a clean one
        # The share of paths that are clean at all places so far, and the weight of state 0 among them.
        clean = 1.0
        for up, run in zip(ups, runs, strict=True):
            move = powers[run]
            all_paths = state @ move * up
            clean *= move[0, 0] / all_paths.sum()
            state = all_paths / all_paths.sum()
            alphas.append(state)
        last = powers[n - 1 - places[-1]] @ np.ones(2)
        clean *= last[0] / (state @ last)
        beta = last
        out = np.empty(len(places))
        for k in range(len(places) - 1, -1, -1):
            both = alphas[k] * beta
            out[k] = both[1] / both.sum()
            beta = powers[runs[k]] @ (ups[k] * beta)
            beta = beta / beta.sum()
        return out, float(min(1.0, max(0.0, 1.0 - clean)))

    def judge(self, text: str) -> tuple[float, list[dict]]:
        """Score and offending spans (start, end, p) of a text."""
        lowered = text.lower()
        words = WORDS.findall(lowered)
        lifts = list(map(self.lift, words))
        if not any(lifts):
            return 0.0, []
        places = [i for i, x in enumerate(lifts) if x]
        p, score = self.marginals(places, [lifts[i] for i in places], len(words))
        bad = {i for i, x in zip(places, p, strict=True) if x >= OFFENDING}
        chance = dict(zip(places, p.tolist(), strict=True))
        found = enumerate(WORDS.finditer(text)) if len(lowered) == len(text) else enumerate(WORDS.finditer(lowered))
        return score, [{"start": m.start(), "end": m.end(), "p": chance[i]} for i, m in found if i in bad]


def choose_features(texts: list[str], toxic: list[int]) -> dict[str, int]:
    """Numbers of the features that mark toxicity in a labelled sample."""
    often: Counter = Counter()
    for text, label in zip(texts, toxic, strict=True):
        if label:
            for word, n in Counter(WORDS.findall(text.lower())).items():
                for f in features(word):
                    often[f] += n
    names = sorted(f for f, n in often.items() if n >= CONTEXTS)
    number = {f: i for i, f in enumerate(names)}
    del often
    mass, counts = [0, 0], []
    for label in (0, 1):
        memo: dict[str, tuple[int, ...]] = {}
        pairs = array("Q")  # a feature's number above, its neighbours' hash below
        for text in (t for t, y in zip(texts, toxic, strict=True) if y == label):
            words = WORDS.findall(text.lower())
            mass[label] += len(words)
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                own = memo.get(word)
                if own is None:
                    own = memo[word] = tuple(number[f] << 32 for f in features(word) if f in number)
                if own:
                    context = zlib.crc32(f"{before} {after}".encode())
                    pairs.extend(f | context for f in own)
        distinct = np.unique(np.frombuffer(pairs, dtype=np.uint64)) >> np.uint64(32)
        counts.append(np.bincount(distinct.astype(np.int64), minlength=len(names)))
    share = mass[1] / max(1, sum(mass))
    found = []
    for f, zeros, ones in zip(names, counts[0].tolist(), counts[1].tolist(), strict=True):
        if ones >= CONTEXTS and ones / (ones + zeros) >= PURITY:
            n = ones + zeros
            g = 2 * (ones * math.log(ones / (n * share)) + (zeros * math.log(zeros / (n * (1 - share))) if zeros else 0))
            if g >= STATISTIC:
                found.append((-g, f))
    return {f: i for i, (_, f) in enumerate(sorted(found)[:MOST_FEATURES])}


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """A model from labelled texts, or None where nothing marks toxicity."""
    index = choose_features(texts, toxic)
    if not index:
        return None
    memo: dict[str, tuple[int, ...]] = {}
    rows, labels = [], []
    for text, label in zip(texts, toxic, strict=True):
        marks = []
        for word in WORDS.findall(text.lower()):
            if word not in memo:
                memo[word] = tuple(index[f] for f in features(word) if f in index)
            marks.append(memo[word])
        for at in range(0, len(marks), WINDOW):
            cut = marks[at : at + WINDOW]
            # Windows without features say little; one of ``PLAIN`` stands for them.
            if any(cut) or (at // WINDOW) % PLAIN == 0:
                rows.append(cut)
                labels.append(label)
    n = len(rows)
    valid = np.zeros((WINDOW, n))
    y = np.zeros((WINDOW, n))
    hit_t, hit_n, hit_f = [], [], []
    for k, (row, label) in enumerate(zip(rows, labels, strict=True)):
        valid[: len(row), k] = 1
        for t, found in enumerate(row):
            if found:
                y[t, k] = label
                hit_t += [t] * len(found)
                hit_n += [k] * len(found)
                hit_f += found
    hit_t, hit_n, hit_f = (np.array(x, dtype=np.int64) for x in (hit_t, hit_n, hit_f))
    flat = hit_t * n + hit_n
    size = len(index)
    theta = np.zeros(size + 1 + 3)  # weights, bias, moves 0>1, 1>0, 1>1
    theta[size] = -3.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    before = np.concatenate([np.zeros((1, n)), y[:-1]])
    for step in range(1, STEPS + 1):
        lift = np.bincount(flat, weights=theta[hit_f], minlength=WINDOW * n).reshape(WINDOW, n)
        emit = (lift + theta[size]) * valid
        up = np.exp(np.clip(emit, -30, 30))
        m01, m10, m11 = np.exp(theta[size + 1 :])
        a0, a1 = np.empty((WINDOW, n)), np.empty((WINDOW, n))
        p0, p1 = np.ones(n), np.zeros(n)
        for t in range(WINDOW):
            q0, q1 = p0 + p1 * m10, (p0 * m01 + p1 * m11) * up[t]
            live = valid[t] > 0
            q0, q1 = np.where(live, q0, p0), np.where(live, q1, p1)
            total = q0 + q1
            p0, p1 = q0 / total, q1 / total
            a0[t], a1[t] = p0, p1
        grad = np.zeros_like(theta)
        b0, b1 = np.ones(n), np.ones(n)
        marginal = np.zeros((WINDOW, n))
        for t in range(WINDOW - 1, -1, -1):
            live = valid[t]
            both = a0[t] * b0 + a1[t] * b1
            marginal[t] = a1[t] * b1 / both * live
            c0, c1 = (a0[t - 1], a1[t - 1]) if t else (np.ones(n), np.zeros(n))
            joint = np.stack([c0 * b0, c0 * m01 * up[t] * b1, c1 * m10 * b0, c1 * m11 * up[t] * b1])
            joint = joint / joint.sum(axis=0) * live
            grad[size + 1] += ((1 - before[t]) * y[t] * live).sum() - joint[1].sum()
            grad[size + 2] += (before[t] * (1 - y[t]) * live).sum() - joint[2].sum()
            grad[size + 3] += (before[t] * y[t] * live).sum() - joint[3].sum()
            d0, d1 = b0 + m01 * up[t] * b1, m10 * b0 + m11 * up[t] * b1
            total = d0 + d1
            b0, b1 = np.where(live > 0, d0 / total, b0), np.where(live > 0, d1 / total, b1)
        off = (y - marginal) * valid
        grad[size] = off.sum()
        grad[:size] = np.bincount(hit_f, weights=off.ravel()[flat], minlength=size)
        grad = grad - PENALTY * theta
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    moves = np.array([[0.0, theta[size + 1]], [theta[size + 2], theta[size + 3]]])
    return Model({f: float(theta[i]) for f, i in index.items()}, float(theta[size]), moves)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from the labelled ``docs`` (doc_id, text) that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    drawn = [known.where(F.col("toxic") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(n) for y, n in ((1, toxic), (0, clean))]
    sample = materialise(drawn[0].unionAll(drawn[1]), "toxicity-sample")  # no more rows than ``toxic`` and ``clean`` allow
    met = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").where(F.char_length("text") <= sample_chars)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, used = [], Counter()
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                used[label] += len(text)
                if used[label] <= sample_chars:
                    rows.append((doc_id, text, label))
        rows.sort()
        model = fit([r[1] for r in rows], [r[2] for r in rows])
        yield pa.record_batch([pa.array([model.to_json() if model else None], pa.string())], names=["model"])

    # One task fits the bounded sample, so that its texts and the fit's arrays aren't the driver's.
    held = met.select("doc_id", "text", "toxic", "h").repartition(1).sortWithinPartitions("h", "doc_id", "text")
    found = held.mapInArrow(learn, "model string").where("model is not null").first()
    return Model.from_json(found["model"]) if found else None


def score(docs: DataFrame, model: Model | None, carry: list[str], names: tuple[str, str, str] = ("score", "predicted", "spans")) -> DataFrame:
    """Columns ``carry`` of ``docs`` with score, predicted and spans (start, end, p) of ``text``, under ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [model.judge(t) if model else (0.0, []) for t in texts]
            values = [s for s, _ in found]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32()), pa.array([s for _, s in found], kind)],
                names=[*batch.schema.names[:-1], *names],
            )

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], span)])
    return docs.select(*carry, text_or_empty(F.col("text")).alias("_text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    judged = score(docs, train(docs, labels), docs.columns, ("_score", "_predicted", "_spans"))
    return judged.where("_predicted = 0").select(*docs.columns)
