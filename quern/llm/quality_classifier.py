"""Quality classifier with site priors (operator 3).

Method: hierarchical empirical Bayes. A logistic regression on features of the text,
trained on labelled documents, gives each document's own evidence. The mean evidence of
a host's documents is shrunk towards that of all documents, and that of a path (a part
of a host) towards its host's, the more the fewer documents it has; how much is estimated
from how hosts and paths vary. A document's score is its site's odds, without the
document itself, times its own likelihood ratio.

Scale: texts are read once; features and evidence are numbers. Hosts and paths are sums,
aggregated map-side. Only the bounded training sample goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_keys

#: Labelled rows that the classifier is fitted on, at most: those of smallest hash.
SAMPLE_ROWS = 20_000
#: Sites that are broadcast, at most; of more, only those of a large share are.
BROADCAST_SITES = 100_000
#: Bytes of one text that are split into words at a time, besides what is left of the last word.
_PIECE = 8_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Documents' own evidence is held to this many nats either way.
_MOST_LOGIT = 12.0

_CLASSES = (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!", b"|", b"#*$%&<>@^~_=+\\", b".", b",;:", b"\n", b"?\"'()", bytes(range(128, 256)))
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars), _k] = 1.0
N_FEATURES = len(_CLASSES) + 5


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces that end at white space, so that no word is cut."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + _PIECE)
        to = space.start() if space else len(data)
        yield data[at:to]
        at = to


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Words of a text, and its features: rates of kinds of characters and repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_OF
    n, echoes, lengths, distinct, last = 0, 0, 0, set(), []
    for piece in _pieces(data):
        words = piece.split()
        n += len(words)
        echoes += sum(map(eq, words, words[1:])) + (last == words[:1] != [])
        last = words[-1:] or last
        lengths += sum(map(len, words))
        distinct.update(words)
    if not n:
        return 0, np.zeros(N_FEATURES)
    rest = [np.log1p(n), lengths / n, echoes / n, len(distinct) / n, len(distinct) / n * np.log1p(n)]
    return n, np.concatenate([counts / n, rest])


def with_features(df: DataFrame, *, columns: list[Column], text_col: str) -> DataFrame:
    """``columns`` with ``__n`` (words) and ``__x`` (features) of every row's whole text."""
    source = df.select(*columns, F.col(text_col).alias("__text"))
    kept = [c for c in source.columns if c != "__text"]
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("__n", T.LongType()), T.StructField("__x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column("__text")]
            x = pa.array([x for _, x in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([n for n, _ in got], pa.int64()), x], names=[*kept, "__n", "__x"])

    return source.mapInArrow(run, schema)


class Logistic:
    """Ridge logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._expand(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._expand(x) @ self.weights, -_MOST_LOGIT, _MOST_LOGIT)


def fit(labelled: DataFrame, sample_rows: int) -> tuple[Logistic | None, float]:
    """The classifier, and the share of good ones, of a bounded sample of (id, x, y).

    Without rows of both kinds there is no classifier; the share is then that of the
    labels, or 1 without any.
    """
    rows = labelled.orderBy("h", "id", "y").limit(sample_rows).select("x", "y").collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 1.0
    return Logistic(np.array([r.x for r in rows]), y), float(y.mean())


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(n: Column, s: Column, mean: Column) -> Column:
    """Documents that a prior of groups is worth: the method of moments for beta groups.

    ``n`` and ``s`` are a group's documents and their evidence, ``mean`` what its prior
    expects. Aggregates over groups.
    """
    rest = F.sum(n * F.pow(s / n - mean, 2)) - F.sum(mean * (1 - mean))
    between = rest / F.greatest(F.sum(n) - F.count(F.lit(1)), F.lit(1.0))
    within = F.sum(n * mean * (1 - mean)) / F.sum(n)
    k = within / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.greatest(F.coalesce(k, F.lit(1.0)), F.lit(1.0)), F.lit(1e4))


def _evidence(x: np.ndarray, n: np.ndarray, model: Logistic | None, prior: float) -> np.ndarray:
    """Probability of each text to be good, by itself; 0 without words."""
    if model is None:
        z = np.full(len(n), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    else:
        z = model.logits(x)
    return np.where(n > 0, 1 / (1 + np.exp(-z)), 0.0)


class SiteModel(NamedTuple):
    """What is learnt from all documents: the classifier, and sums and priors of sites."""

    model: Logistic | None
    prior: float  #: share of good ones among the labels
    mean: float  #: mean evidence of all documents
    k_h: float  #: documents that the prior of a host is worth
    k_p: float  #: documents that the prior of a path is worth
    sites: DataFrame  #: (h2, p2, n, s, n_h, s_h) of every host and path

    def scored(self, docs: DataFrame, threshold: float, most_shift: float) -> DataFrame:
        """``docs`` (host, path, evidence) with posteriors, ``score`` and ``kept``."""
        same = [F.col("host").eqNullSafe(F.col("h2")), F.col("path").eqNullSafe(F.col("p2"))]
        both = join_keys(docs, self.sites, same, weight="n", how="left", most=BROADCAST_SITES)
        # without the document itself, whose evidence comes on its own
        e, some = F.col("evidence"), F.col("evidence") > 0
        host = (F.col("s_h") - e + self.k_h * self.mean) / (F.col("n_h") - 1 + self.k_h)
        path = (F.col("s") - e + self.k_p * F.col("host_posterior")) / (F.col("n") - 1 + self.k_p)
        both = both.withColumn("host_posterior", host).withColumn("path_posterior", path)
        usual = _logit(F.lit(self.mean))
        shift = F.least(F.greatest(_logit(F.col("path_posterior")) - usual, F.lit(-most_shift)), F.lit(most_shift))
        z = shift + usual + _logit(e) - _logit(F.lit(self.prior))
        done = both.withColumn("score", F.when(some, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0)))
        return done.withColumn("kept", (F.col("score") >= threshold) & some).drop("h2", "p2", "n", "s", "n_h", "s_h")


def learn(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str, sample_rows: int) -> tuple[SiteModel, DataFrame]:
    """The model, and (id, row, host, path, evidence) of every row; row is the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.col(host_col).alias("host"), F.col(path_col).alias("path")]
    known = cut(with_features(df, columns=columns, text_col=text_col))
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    labelled = known.where("__n > 0").select("id", F.col("__x").alias("x")).join(y, "id").withColumn("h", F.xxhash64("id"))
    model, prior = fit(labelled, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("__n").to_numpy()
            x = batch.column("__x").flatten().to_numpy().reshape(len(n), N_FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "host", "path")), pa.array(_evidence(x, n, model, prior))], names=["id", "row", "host", "path", "evidence"])

    kinds = {f.name: f for f in known.schema.fields}
    schema = T.StructType([*(kinds[c] for c in ("id", "row", "host", "path")), T.StructField("evidence", T.DoubleType())])
    docs = cut(known.mapInArrow(score, schema))

    paths = cut(docs.where("evidence > 0").groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("evidence").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_h"), F.sum("s").alias("s_h"))
    # three numbers that all sites share
    mean = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = prior if mean is None else mean
    k_h = hosts.agg(_strength(F.col("n_h"), F.col("s_h"), F.lit(mean))).first()[0]
    hosts = hosts.withColumn("m_h", (F.col("s_h") + k_h * mean) / (F.col("n_h") + k_h))
    sites = cut(paths.join(hosts.withColumnRenamed("host", "h2"), F.col("host").eqNullSafe(F.col("h2"))).drop("h2"))
    k_p = sites.agg(_strength(F.col("n"), F.col("s"), F.col("m_h"))).first()[0]
    sites = sites.select(F.col("host").alias("h2"), F.col("path").alias("p2"), "n", "s", "n_h", "s_h")
    return SiteModel(model, prior, mean, k_h, k_p, sites), docs


def classify(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = 0.5,
    most_shift: float = 2.0,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """For every row of ``df``: id, row (hash of the text), evidence, host and path
    posteriors, score, and whether it is kept.

    A site moves a document's log odds by at most ``most_shift`` from those of all
    documents, so that good documents of bad sites can stay.

    ``labels`` has (id_col, label_col), 0 or 1; null labels and ids are left out, and several
    labels of an id all count. Texts without words have no evidence: their score is 0, they
    are not kept and don't count for their site. Null hosts and paths are sites like
    others. Repeated rows each count and are scored alike. Without labels of both kinds
    nothing is known about texts, and all with words are kept unless all labels are 0.
    Other columns are not read; an empty table gives an empty result.
    """
    model, docs = learn(df, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, label_col=label_col, sample_rows=sample_rows)
    return model.scored(docs, threshold, most_shift).select("id", "row", "evidence", "host_posterior", "path_posterior", "score", "kept")


def keep_good(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = 0.5,
    most_shift: float = 2.0,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of ``df`` that :func:`classify` keeps, unchanged.

    Texts are scored where they are, a second time, rather than shuffled to their scores.
    """
    model, _ = learn(df, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, label_col=label_col, sample_rows=sample_rows)
    logistic, prior = model.model, model.prior

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__all"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in ("__all", "host", "path")), T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                got = [features(t.as_py()) for t in part.column("__text")]
                e = _evidence(np.array([x for _, x in got]), np.array([n for n, _ in got]), logistic, prior)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("__all", "host", "path")), pa.array(e)], names=["__all", "host", "path", "evidence"])

    return model.scored(rows.mapInArrow(run, schema), threshold, most_shift).where("kept").select("__all.*")
