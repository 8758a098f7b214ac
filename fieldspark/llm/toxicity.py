"""Toxicity classifier with counterfactual regularisation.

Logistic regression on the presence of words and word beginnings (64-bit
hashes), and on whether they come at least twice or four times.  Each labelled text that
mentions an identity gets a counterfactual in which identity terms are
swapped within their group, with all features that follow from a term: its
beginning and how often both occur; the squared difference of the two scores
is added to the loss.  Mentions of a group then carry no evidence by themselves, which
lowers false positives on neutral texts about it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Block, mix, tidy
from .repeats import _chunks
from .session import cut
from .text_features import Sparse, adam, labelled_sample, letter_runs, sigmoid

PREFIX = 6
TIMES = (1, 2, 4)

#: Identity terms that replace one another (folded A-Z).
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"), ("musulmans", "chrétiens", "juifs"),
    ("muslime", "christen", "juden"),
)



def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of letter runs and of the first bytes of longer ones, documents."""
    word, prefix, longer, doc = letter_runs(block, PREFIX)
    return (np.concatenate([word, mix(prefix + U64(1))]),
            np.concatenate([doc, doc[longer]]))


def features(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, document): a token once for each of TIMES it reaches."""
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(token)))
    token, doc = token[at], doc[at]
    out = [(token, doc)] + [(mix(token[count >= t] + U64(t)), doc[count >= t]) for t in TIMES[1:]]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def find(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted hashes, -1 if it is not there."""
    if not len(hashes):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
    return np.where(hashes[at] == values, at, -1)


@dataclass(frozen=True)
class ToxicityModel:
    base: np.ndarray  # sorted hashes of tokens that any feature needs
    hashes: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    bias: float

    def score(self, block: Block) -> np.ndarray:
        token, doc = tokens(block)
        ok = find(self.base, token) >= 0
        feature, doc = features(token[ok], doc[ok])
        at = find(self.hashes, feature)
        known = at >= 0
        return sigmoid(self.bias + np.bincount(doc[known], weights=self.weights[at[known]],
                                               minlength=len(block.lengths)))


def swaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the identity terms, and of each one, in two columns, the
    tokens that a mention has and those of the next term of its group: the
    word and its beginning, 0 where a term is no longer than that."""
    words, tokens_of, following = [], [], []
    for group in IDENTITY_GROUPS:
        word, prefix, longer, _ = letter_runs(Block(pa.array(group)), PREFIX)
        begin = np.zeros(len(group), dtype=U64)
        begin[longer] = mix(prefix + U64(1))
        both = np.stack([word, begin], axis=1)
        words.append(word)
        tokens_of.append(both)
        following.append(np.roll(both, -1, axis=0))
    words, tokens_of, following = map(np.concatenate, (words, tokens_of, following))
    order = np.argsort(words)
    return words[order], tokens_of[order], following[order]


def counterfactual(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and documents after every identity term became the next of its group."""
    terms, before, after = swaps()
    at = find(terms, token)
    mention = at >= 0
    at, where = at[mention], doc[mention]
    # beginnings that go with the replaced words, as often as they are replaced
    gone, gone_doc = before[at, 1], where
    gone, gone_doc = gone[gone > 0], gone_doc[gone > 0]
    token, doc = token[~mention], doc[~mention]
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    keep = np.ones(len(token), dtype=bool)
    if len(gone):
        # the n-th of equal tokens in a document goes if n is below the number to remove
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        nth = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
        pair = np.unique(np.stack([gone_doc.astype(U64), gone], axis=1), axis=0,
                         return_counts=True)
        number = {(int(d), int(t)): int(n) for (d, t), n in zip(*pair)}
        for k in np.flatnonzero(np.isin(token, gone)):
            keep[k] = nth[k] >= number.get((int(doc[k]), int(token[k])), 0)
    put, put_doc = after[at].ravel(), np.repeat(where, 2)
    return (np.concatenate([token[keep], put[put > 0]]),
            np.concatenate([doc[keep], put_doc[put > 0]]))


def fit_toxicity(y: np.ndarray, x: Sparse, difference: Sparse, ridge: float, penalty: float,
                 steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias; classes weigh the same, whatever their numbers."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def gradient(p):
        w, b = p[:-1], p[-1]
        error = (sigmoid(x.dot(w) + b) - y) * weight
        g = x.tdot(error) + ridge * w
        if len(difference.index):
            g += penalty * difference.tdot(difference.dot(w)) / x.n
        return np.append(g, error.sum())

    p = adam(gradient, np.zeros(x.width + 1), steps, rate)
    return p[:-1], float(p[-1])


def _count_features(batches):
    """Rows and positive rows of each feature, summed over a chunk."""
    for table in _chunks(batches):
        token, doc = tokens(Block(table["_text"]))
        feature, doc = features(token, doc)
        y = table["_y"].to_numpy()
        found, place = np.unique(feature, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(np.bincount(place).astype(np.int64)),
             pa.array(np.bincount(place, weights=y[doc]).astype(np.int64))],
            names=["feature", "n", "hits"])


def _list_features(base: np.ndarray, hashes: np.ndarray):
    """Features of each text, those that its counterfactual lacks, and those it adds."""
    terms = swaps()[0]

    def run(batches):
        for table in _chunks(batches):
            token, doc = tokens(Block(table["_text"]))
            mentions = np.unique(doc[find(terms, token) >= 0])
            part = np.isin(doc, mentions)

            def pairs(token, doc):
                ok = find(base, token) >= 0
                feature, doc = features(token[ok], doc[ok])
                at = find(hashes, feature)
                return np.sort(doc[at >= 0] * len(hashes) + at[at >= 0])

            def listed(pair):
                ends = np.searchsorted(pair, np.arange(len(table) + 1) * len(hashes))
                return pa.ListArray.from_arrays(ends.astype(np.int32),
                                                pa.array((pair % len(hashes)).astype(np.int32)))

            text = pairs(token[part], doc[part])
            other = pairs(*counterfactual(token[part], doc[part]))
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), table["_y"].combine_chunks(),
                 listed(pairs(token, doc)), listed(np.setdiff1d(text, other)),
                 listed(np.setdiff1d(other, text))],
                names=["doc_id", "y", "features", "gone", "added"])

    return run


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry."""
    return (np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())),
            lists.flatten().to_numpy())


def train_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic",
                   limit: int = 8_000, least: int = 5, z: float = 6.0, ridge: float = 1e-4,
                   penalty: float = 10.0, steps: int = 300, rate: float = 0.1) -> ToxicityModel:
    """Fit on at most ``limit`` labelled documents (chosen by hash of doc_id).

    Spark counts how often each feature comes with either label; features of
    fewer than ``least`` texts, and those whose share of toxic texts is within
    ``z`` standard errors of the average, get no weight.  Identity terms
    always get one.
    """
    sample = cut(labelled_sample(docs, labels, label_col, limit))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    share = positive / n if n else 0.0
    none = np.zeros(0, dtype=U64)
    if share in (0.0, 1.0):
        return ToxicityModel(none, none, np.zeros(0), 20.0 if share else -20.0)
    counts = sample.mapInArrow(_count_features, "feature long, n long, hits long").groupBy(
        "feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    off = F.abs(F.col("hits") - F.col("n") * share) > z * F.sqrt(F.col("n") * share * (1 - share))
    telling = counts.where((F.col("n") >= least) & off).select("feature").toArrow()["feature"]
    hashes = np.union1d(telling.to_numpy().view(U64), swaps()[0])
    base = _bases(sample, hashes)
    table = sample.mapInArrow(
        _list_features(base, hashes), "doc_id long, y int, features array<int>, "
        "gone array<int>, added array<int>").toArrow().sort_by("doc_id")
    y = table["y"].to_numpy().astype(float)
    lists = table["features"].combine_chunks()
    index = lists.flatten().to_numpy()
    x = Sparse(index, lists.offsets.to_numpy(), np.ones(len(index)), len(hashes))
    minus, plus = (_entries(table[c].combine_chunks()) for c in ("gone", "added"))
    r, f = np.concatenate([minus[0], plus[0]]), np.concatenate([minus[1], plus[1]])
    sign = np.repeat([-1.0, 1.0], [len(minus[0]), len(plus[0])])
    order = np.argsort(r, kind="stable")
    difference = Sparse(f[order], np.searchsorted(r[order], np.arange(len(y) + 1)), sign[order],
                        len(hashes))
    weights, bias = fit_toxicity(y, x, difference, ridge, penalty, steps, rate)
    return ToxicityModel(base, hashes, weights, bias)


def _bases(sample: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Tokens of the sample that some feature in ``hashes`` is made from."""

    def run(batches):
        for table in _chunks(batches):
            token = np.unique(tokens(Block(table["_text"]))[0])
            made = [token] + [mix(token + U64(t)) for t in TIMES[1:]]
            ok = np.any([find(hashes, m) >= 0 for m in made], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(token[ok].view(np.int64))], names=["token"])

    found = sample.mapInArrow(run, "token long").distinct().toArrow()["token"].to_numpy()
    return np.union1d(found.view(U64), hashes)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    ``held_out`` is crc32(doc_id as text) mod 5 = 0.  Defined cases: a NULL
    or empty text gets the score without any word; a NULL id is not held out;
    repeated rows are scored alike; without labels of both kinds every
    document gets their share; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"),
                       (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0)
                       .alias("held_out"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def run(batches):
        for table in _chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(),
                 pa.array(model.score(Block(table["_text"])))],
                names=["doc_id", "held_out", "score"])

    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("held_out", F.coalesce("held_out", F.lit(False))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op8_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return score_toxicity(docs, train_toxicity(docs, labels))
