"""Quality: a document classifier, and posteriors of hosts and paths by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, spread_join, written
from .labelled import fold, logistic, sample

#: Training documents of each label; bounds what the driver holds, which is their features.
PER_CLASS = 4000
#: Paths up to this many are broadcast; more are joined through a shuffle.
BROADCAST_PATHS = 100_000
_CLASSES = np.zeros((256, 5))
_CLASSES[65:91, 0] = 1
_CLASSES[97:123, 1] = 1
_CLASSES[48:58, 2] = 1
_CLASSES[[ord(c) for c in "!?#$%&*|<>=+~^_@\\/{}[]"], 3] = 1
_CLASSES[[10], 4] = 1


def features(text: str) -> list[float]:
    """What the document classifier sees of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, lower, digits, marks, lines = np.bincount(raw, minlength=256) @ _CLASSES
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = len(set(words))
    repeats = sum(map(eq, words, words[1:])) / n
    parts = text.split("\n")
    same = 1 - len(set(parts)) / len(parts)
    upper_share = upper / max(1, upper + lower)
    return [
        1.0, np.log(n) / 5, kinds / n, kinds / n**0.5 / 10, repeats, np.sqrt(repeats), upper_share, np.sqrt(upper_share), digits / size, np.sqrt(digits / size),
        marks / size, np.sqrt(marks / size), lines / n, same, min(size / n, 50) / 10, float(not words),
    ]


@dataclass
class Classifier:
    """Weights of the standardised features; the logit is that of good quality at even odds of the labels."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(len(texts), len(self.mean))
        return np.clip((x - self.mean) / self.spread @ self.weights, -30, 30)


def train(texts: Sequence[str], labels: Sequence[int], prior: float = 0.5) -> Classifier:
    """A logistic regression with both labels weighted alike. Without examples of both labels it says nothing of any text."""
    return _trained(np.array([features(t) for t in texts]), np.array(labels, np.int64), prior)


def _trained(x: np.ndarray, y: np.ndarray, prior: float) -> Classifier:
    """The classifier of examples' features x and labels y."""
    size = len(features(""))
    if not 0 < y.sum() < len(y):
        return Classifier(np.zeros(size), np.ones(size), np.zeros(size), prior)
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[spread < 1e-9] = 0, 1
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    return Classifier(mean, spread, logistic((x - mean) / spread, y, weight, ridge=0.3), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier of a bounded sample of labelled documents outside fold 0; the share of good ones among all labels outside fold 0 is its prior.

    Texts stay where they are: tasks turn them into features, and only those come to the driver.
    """
    chosen = sample(docs, labels, label, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), x], names=["id", "label", "x"])

    kind = chosen.schema["id"].dataType.simpleString()
    found = chosen.mapInArrow(run, f"id {kind}, label int, x array<double>").toArrow().sort_by([("id", "ascending")])
    share = labels.where(F.col(label).isin(0, 1) & (fold(id_col) != 0)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = min(0.999, max(0.001, 0.5 if share is None else share))
    return _trained(np.array(found.column("x").to_pylist()), np.array(found.column("label").to_pylist(), np.int64), prior)


def _strength(units: DataFrame, n: str, rate: str, above: str) -> float:
    """How many documents' worth a unit's prior is: the moment estimator of a beta-binomial's concentration.

    above: the rate that the unit's is drawn around.
    """
    k, total, squares, var, chance = units.agg(
        F.count("*"), F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(F.col(n) * (F.col(rate) - F.col(above)) ** 2), F.avg(F.col(above) * (1 - F.col(above)))
    ).first()
    if not k or k < 2 or not chance:
        return 100.0
    room = (total - squares / total - (k - 1)) * chance
    rho = (var - (k - 1) * chance) / room if room > 0 else 0.0
    return min(1e6, max(1.0, 1 / rho - 1)) if rho > 0 else 1e6


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(docs: DataFrame, model: Classifier, host: Column, path: Column, threshold: float = 0.5, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(row, doc_score, host_quality, path_quality, score, kept): row is a struct of the columns to carry, by default all of docs.

    doc_score is the document's own probability of good quality; host_quality and path_quality are
    posterior shares of good documents, where a host is drawn around the global share and a path around its host's;
    their strength is estimated from all documents, so small sites stay near the prior. score adds the path's
    log-odds, without the document itself, to the document's evidence; kept is score >= threshold.

    Null texts count as empty; null hosts and paths are one host and one path more. Repeated rows are
    rows like others; no rows give no rows. Texts are read once; sums are combined before the shuffle, so
    a large host is no more than a row from each task. Few paths are broadcast to the scored rows; more than
    BROADCAST_PATHS are joined by a shuffle with large ones apart.
    """
    carry = list(carry or docs.columns)
    schema = docs.select(*(F.col(f"`{c}`") for c in carry)).schema.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            logits = sent.value.logits(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), batch.column("path"), pa.array(logits)], names=["row", "host", "path", "logit"])

    key = F.concat(F.coalesce(host.cast("string"), F.lit("\0")), F.lit("\1"), F.coalesce(path.cast("string"), F.lit("\0")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), key.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = written(rows.mapInArrow(run, f"row {schema}, host string, path string, logit double"), "scored")
    good = 1 / (1 + F.exp(-(F.col("logit") + float(np.log(model.prior / (1 - model.prior))))))
    scored = scored.withColumn("p", good)

    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    overall = (s + 1) / (n + 2) if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count("*").alias("host_paths")).withColumn("overall", F.lit(overall))
    hosts = written(hosts.withColumn("rate", F.col("host_s") / F.col("host_n")), "hosts")
    m_host = _strength(hosts, "host_n", "rate", "overall")
    hosts = hosts.select("host", "host_paths", ((F.col("host_s") + m_host * overall) / (F.col("host_n") + m_host)).alias("host_quality"))
    paths = written(spread_join(paths, hosts, "host", "host_paths", F.col("path")).withColumn("rate", F.col("s") / F.col("n")), "path-hosts")
    m_path = _strength(paths, "n", "rate", "host_quality")

    sums = paths.select("path", "n", "s", "host_quality")
    if sums.count() <= BROADCAST_PATHS:
        found = scored.join(F.broadcast(sums), "path")
    else:
        found = spread_join(scored, sums, "path", "n", F.col("row"))
    around = m_path * F.col("host_quality")
    others = (F.col("s") - F.col("p") + around) / (F.col("n") - 1 + m_path)
    others = F.least(F.lit(0.999), F.greatest(F.lit(0.001), others))
    score = 1 / (1 + F.exp(-(F.col("logit") + _logit(others))))
    return found.select("row", F.col("p").alias("doc_score"), "host_quality", ((F.col("s") + around) / (F.col("n") + m_path)).alias("path_quality"), score.alias("score"), (score >= threshold).alias("kept"))
