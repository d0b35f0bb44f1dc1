"""Toxicity by maximum-scoring segments of token log-odds.

A token is a run of characters between white space; its features are its runs of
letters, lower-cased, and their prefixes. A feature's weight is the log-odds of the documents that hold it,
toxic against clean, under a Dirichlet prior in proportion to its overall
frequency; features whose log-odds are not clearly positive (by their standard
error) weigh nothing. A token scores its best feature's weight, or ``-DRIFT``.

A linear scan finds all maximal segments of positive score in a document. Under
Karlin and Altschul's extreme-value law a segment of score S in n clean tokens has
the expectation K n exp(-lambda S); lambda comes from the clean documents' token
scores. A document's features are its best normalised score and the sum of the
normalised scores of its significant segments; a logistic curve, fitted out of
fold, turns them into one probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view, tidy
from .training import SAMPLE, labelled_sample

PREFIXES = (4, 5, 6)
#: Strength of the prior in documents, least z of a feature, least toxic documents that hold it.
PRIOR, LEAST_Z, LEAST_DOCS = 1000.0, 3.0, 3
#: Least prior count of a feature in clean documents, least log-odds of a weight.
LEAST_PRIOR, LEAST_ODDS = 0.3, 1.5
DRIFT, K, SIGNIFICANT = 0.25, 0.1, 0.05
#: Token scores that a worker remembers.
MEMO = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return text.split()


def features(token: str) -> Iterator[str]:
    """A token's lower-cased runs of letters and their prefixes."""
    for word in LETTERS.findall(token.lower()):
        yield word
        for n in PREFIXES:
            if len(word) > n:
                yield word[:n] + "*"


def _held(text: str) -> set[str]:
    return {f for w in set(tokens(text)) for f in features(w)}


def log_odds(docs: list[tuple[str, int]]) -> dict[str, float]:
    """Weights of the features that clearly speak for toxic documents. A feature
    counts once a document, and its odds are against all such counts, so long
    documents and common words weigh nothing. Texts are read one at a time, and
    clean ones only for features that enough toxic ones hold."""
    total, toxic, clean = [0, 0], Counter(), Counter()
    for text, y in docs:
        if y:
            held = _held(text)
            total[1] += len(held)
            toxic.update(held)
    toxic = {f: k for f, k in toxic.items() if k >= LEAST_DOCS}
    for text, y in docs:
        if not y:
            held = _held(text)
            total[0] += len(held)
            clean.update(f for f in held if f in toxic)
    found = []
    for f, k in toxic.items():
        share = (k + clean[f]) / (total[0] + total[1])
        a, b = k + PRIOR * share, clean[f] + max(PRIOR * share, LEAST_PRIOR)
        odds = math.log(a / (total[1] + PRIOR - a)) - math.log(b / (total[0] + PRIOR - b))
        z = odds / math.sqrt(1 / a + 1 / b)
        if z >= LEAST_Z and odds >= LEAST_ODDS:
            found.append((z, f, odds))
    found.sort(reverse=True)
    return {f: odds for _, f, odds in found}


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) as (first, end, score), from
    the tokens of positive score alone: the others cost ``drift`` each. Every
    segment holds on to the last one before it whose left sum is smaller; a search
    goes along these and never over the same ones twice, so time is linear."""
    out: list[list] = []  # first, end, sum before, sum after, place in ``out`` of the smaller left sum
    total, last = 0.0, 0
    for at, score in zip(places, scores):
        total -= drift * (at - last)
        left, total, last = total, total + score, at + 1
        item = [at, at + 1, left, total, -1]
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= item[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= item[3]:
                item[4] = j
                out.append(item)
                break
            item, smaller = [out[j][0], item[1], out[j][2], item[3], -1], out[j][4]
            del out[j:]
            j = smaller
    return [(x[0], x[1], x[3] - x[2]) for x in out]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def score_of(self, word: str) -> float:
        """The best weight of a token's features; 0 for none."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        return found

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Segments as (first token, end, normalised score). All occurrences of a
        token count, however often it came before, but those that follow a counted
        one more closely than its score reaches; these score nothing and only
        lengthen the passage."""
        if not self.weights or not words:
            return []
        scores = list(map(self.score_of, words))
        # a token repeated over and over speaks once until the drift has used up its score
        places, counted, last = [], {}, {}
        for i, s in enumerate(scores):
            if s:
                at = counted.get(words[i])
                if at is not None and DRIFT * (i - at) <= s:
                    last[at] = i
                else:
                    counted[words[i]] = i
                    places.append(i)
        if not places:
            return []
        base = math.log(K * len(words) + 1)
        found = segments(places, [scores[i] for i in places])
        out, k = [], 0
        for (a, b, s), (limit, *_) in zip(found, found[1:] + [(len(words), 0, 0.0)]):
            end = b
            while k < len(places) and places[k] < b:  # damped repeats belong to their token's passage
                if places[k] >= a:
                    end = max(end, last.get(places[k], -1) + 1)
                k += 1
            out.append((a, min(end, limit), self.decay * s - base))
        return out

    def evidence(self, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The best normalised score, and the sum over significant segments."""
        least = -math.log(SIGNIFICANT)
        best = max((s for *_, s in found), default=0.0)
        return max(best, 0.0), sum(s for *_, s in found if s >= least)

    def probability(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(evidence[0]) + c * math.log1p(evidence[1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _decay(weights: dict[str, float], docs: list[tuple[str, int]]) -> float:
    """lambda: the positive root of sum p(s) exp(lambda s) = 1 over clean tokens."""
    model, counts, total = Model(weights), Counter(), 1
    counts[round(max(weights.values(), default=1.0), 1)] = 1
    for text, y in docs:
        if not y:
            words = tokens(text)
            total += len(words)
            counts.update(round(s, 1) for s in map(model.score_of, words) if s)
    counts[-DRIFT] = total - sum(counts.values())
    low, high = 1e-3, 5.0
    for _ in range(50):
        mid = (low + high) / 2
        if sum(n * math.exp(min(mid * s, 500)) for s, n in counts.items()) > total:
            high = mid
        else:
            low = mid
    return low


def fit(docs: list[tuple[str, int]]) -> Model:
    """Weights from all documents, the curve from documents that the weights did
    not see (two folds). Without documents of both labels every score is the
    share of toxic ones (0 without any)."""
    share = sum(y for _, y in docs) / len(docs) if docs else 0.0
    if share in (0.0, 1.0):
        return Model(curve=(-30.0 if share == 0 else 30.0, 0.0, 0.0))
    x, ys = [], []
    for half in (0, 1):
        part = _weighted(docs[1 - half :: 2])
        for text, y in docs[half::2]:
            best, total = part.evidence(part.passages(tokens(text)))
            x.append((1.0, math.log1p(best), math.log1p(total)))
            ys.append(y)
    model = _weighted(docs)
    model.curve = _logistic(np.array(x), np.array(ys, float))
    return model


def _weighted(docs: list[tuple[str, int]]) -> Model:
    weights = log_odds(docs)
    return Model(weights, _decay(weights, docs))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w + np.clip(step, -2, 2)
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """``_id``, ``_score`` and, unless turned off, ``_passages`` (first and end token and normalised score of every
    significant passage). Null and empty texts have no tokens and get the score of
    no evidence; repeated rows are scored alike; an empty table gives no rows;
    further columns are ignored."""
    view = documents_view(docs, id_col, text_col)
    least = -math.log(SIGNIFICANT)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, out = [], []
            for text in batch.column(1):
                found = model.passages(tokens(text.as_py()))
                scores.append(model.probability(model.evidence(found)))
                out.append([{"first": a, "end": b, "score": s} for a, b, s in found if s >= least])
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays(columns[: 2 + passages], names=["_id", "_score", "_passages"][: 2 + passages])

    id_type = view.schema["_id"].dataType.simpleString()
    return view.mapInArrow(tidy(run), f"_id {id_type}, _score double" + ", _passages array<struct<first:int,end:int,score:double>>" * passages)


def scorer(model: Model):
    """The probability as a function of a text column, for filters over whole rows."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.probability(model.evidence(model.passages(tokens(t.as_py() or "")))) for t in texts], pa.float64())
        model.memo.clear()

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(batches)

    return probability


def fit_on(docs: DataFrame, labels: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the labels (column ``toxic``) for which ``keep`` holds."""
    return fit(labelled_sample(docs, labels, "toxic", keep, id_col, text_col, sample))
