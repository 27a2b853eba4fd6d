"""Toxicity by weak supervision.

1. *Voters.* From labelled rows that are not held out, words and word prefixes that go with toxic texts beyond
   chance (likelihood ratio above ``2 ln(terms) + 2``) are dealt to word lexicons and prefix patterns of
   about even precision, each of which votes toxic when a text has one of its terms. Style patterns (shouting, exclamations)
   vote toxic; a text without any lexicon word or prefix pattern gets a vote for clean. Otherwise a voter
   abstains.
2. *Label model.* A generative model with a latent label: each voter, when it votes, is right with its own accuracy.
   Accuracies start at their agreement with the labels and are refined by expectation maximisation, in which a
   text counts half by its label and half by its posterior. Pairwise correlations of the voters' errors and co-votes are estimated in each round, and a voter's
   evidence is divided by the sum of its positive correlations, so that a stem and its word do not count twice.
3. *Classifier.* A logistic regression on term presence and style is trained on the posterior labels and scores
   every whole text.

Fitting uses at most ``SAMPLE`` labelled rows, in hash order of their ids; scoring reads all documents. ``lang``,
``source``, ``doc_id`` and labels are never inputs of a score. A row is held out if crc32 of its id as text, modulo 3, is 1;
labels of such rows are never read. Null and empty texts are scored like any other; rows with null ``doc_id`` are
scored and not held out (``held_out`` false). If several label rows name a document, one toxic vote suffices; null
labels are skipped. Without labels of both kinds every score is 0. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Kept, slices, stored

SAMPLE = 20_000
TIERS, LEXICONS = 4, 6
TERMS = 512
PREFIXES = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
STYLES = 3
SURE = 0.95
STRONG = 0.5
"""Correlations from here on are discounted: two voters that read the same word, not two words of one insult."""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(piece: str) -> tuple[str, ...]:
    """Words (w:) and prefixes (p:) of a stretch without white space."""
    out = []
    for w in LETTERS.findall(piece.lower()):
        if len(w) >= 3:
            out.append(f"w:{w}")
        out.extend(f"p:{w[:n]}" for n in PREFIXES if len(w) > n)
    return tuple(out)


def style_of(text: str) -> np.ndarray:
    """Upper-case share, exclamation share, log length: each from 0 to about 1."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    return np.array([upper / n, min(1.0, 20 * text.count("!") / n), np.log1p(len(raw)) / 12])


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, positive, n): labelled texts, and toxic ones, with each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        known = Kept(100_000, terms_of)

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                              pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "positive", "n"])
            seen.clear()
            return got
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for t in {t for p in set(text.split()) for t in known[p]}:
                    counts = seen[t]
                    counts[0] += toxic
                    counts[1] += 1
                if len(seen) > 300_000:
                    yield out()
        yield out()
    return labelled.mapInArrow(run, "term string, positive long, n long").groupBy("term").agg(
        F.sum("positive").alias("positive"), F.sum("n").alias("n"))


def likelihood_ratio(positive: Column, n: Column, toxic: int, clean: int) -> Column:
    """G statistic of a term against the label, from its two by two table."""
    total = toxic + clean
    out = F.lit(0.0)
    for seen, row, side in ((positive, n, toxic), (n - positive, n, clean), (toxic - positive, total - n, toxic),
                            (clean - (n - positive), total - n, clean)):
        out = out + F.when(seen > 0, seen * F.log(seen * float(total) / (row * float(side)))).otherwise(0.0)
    return 2 * out


class Marks:
    """Which terms of a fixed list a text has."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.pieces = Kept(200_000, lambda p: tuple(self.place[t] for t in terms_of(p) if t in self.place))

    def of(self, text: str) -> list[int]:
        return sorted({i for p in set(text.split()) for i in self.pieces[p]})


def votes(has: np.ndarray, style: np.ndarray, lexicons: list[list[int]]) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 abstains) of every voter; a lexicon is a list of terms."""
    cols = [has[:, own].any(1).astype(np.int8) for own in lexicons]
    cols.append(-(~has[:, [i for terms in lexicons for i in terms]].any(1)).astype(np.int8))
    cols.append((style[:, 0] > 0.3).astype(np.int8))
    cols.append((style[:, 1] > 0.2).astype(np.int8))
    return np.stack(cols, axis=1)


def deal(positive: np.ndarray, n: np.ndarray, chosen: np.ndarray, is_word: np.ndarray) -> list[list[int]]:
    """Toxic terms dealt to lexicons: by kind, then by precision in ``TIERS`` tiers, then in turn, so that the
    terms of a lexicon are about equally right."""
    precision = (positive + 0.5) / (n + 1)
    out = []
    for kind in (True, False):
        own = [i for i in np.argsort(-precision, kind="stable").tolist() if is_word[i] == kind and chosen[i]]
        for tier in np.array_split(np.array(own, int), TIERS):
            out += [tier[k::LEXICONS].tolist() for k in range(LEXICONS) if len(tier) > k]
    return out


def trusted(has: np.ndarray, labels: np.ndarray, positive: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which terms become votes: those that are nearly always right, and, best first, those that still
    are right more often than not on texts which no better term covers. A stem that is only toxic in some of its
    words is left to those words."""
    precision = (positive + 0.5) / (n + 1)
    keep = np.zeros(len(n), bool)
    covered = np.zeros(len(has), bool)
    for i in np.lexsort((-n, -precision)).tolist():
        new = has[:, i] & ~covered
        a, m = int(labels[new].sum()), int(new.sum())
        if precision[i] >= SURE or (a >= 3 and a + 0.5 > 0.8 * (m + 1)):
            keep[i] = True
            covered |= has[:, i]
    return keep


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def label_model(v: np.ndarray, labels: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic label, accuracies and correlations of the voters."""
    voted, agree = v != 0, np.where(v > 0, 1.0, 0.0)
    posterior = labels.astype(np.float64)
    for _ in range(rounds):
        anchored = (posterior + labels) / 2
        right = np.where(agree > 0, anchored[:, None], 1 - anchored[:, None]) * voted
        accuracy = (right.sum(0) + 1) / (voted.sum(0) + 2)
        # Correlation of co-votes that the label leaves unexplained.
        expected = np.zeros_like(right)
        for side in (posterior, 1 - posterior):
            weight = side[:, None]
            expected += weight * ((voted * weight).sum(0) / max(1e-9, side.sum()))
        rest = voted - expected
        scale = np.sqrt((rest ** 2).sum(0)) + 1e-9
        correlation = (rest.T @ rest) / np.outer(scale, scale)
        evidence = np.log(accuracy / (1 - accuracy)) / np.where(correlation > STRONG, correlation, 0).sum(0).clip(1)
        # An accuracy is the chance to be right given the vote, so it holds the prior already; abstaining is no evidence.
        posterior = sigmoid(v @ evidence)
    return posterior, accuracy, correlation


def train(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray] | None:
    """Terms and weights learned from (doc_id, text) and (doc_id, toxic); None without labels of both kinds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = stored(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    # ``sample`` rows of two numbers at most.
    labelled = stored(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    total, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return None
    counts = stored(term_counts(labelled).where(F.col("n") >= 3), "terms")
    tested = counts.count()
    scored = counts.withColumn("g", likelihood_ratio(F.col("positive"), F.col("n"), toxic, total - toxic))
    scored = scored.where(F.col("g") >= 2 * np.log(max(2, tested)) + 2)
    best = scored.orderBy(F.col("g").desc(), "term").limit(TERMS).collect()
    if not best:
        return None
    terms = [r["term"] for r in best]
    is_word = np.array([t.startswith("w:") for t in terms])
    positive, n = np.array([r["positive"] for r in best]), np.array([r["n"] for r in best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(terms)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([marks.of(t) for t in texts], pa.list_(pa.int32())),
                                              pa.array([style_of(t).tolist() for t in texts], pa.list_(pa.float64())),
                                              batch.column("toxic")], names=["has", "style", "toxic"])

    got = labelled.mapInArrow(run, "has array<int>, style array<double>, toxic int").collect()  # ``sample`` rows
    got.sort(key=lambda r: (r["has"], r["style"], r["toxic"]))
    has = np.zeros((len(got), len(terms)), bool)
    for i, r in enumerate(got):
        has[i, r["has"]] = True
    style = np.array([r["style"] for r in got])
    truth = np.array([r["toxic"] for r in got])
    lexicons = deal(positive, n, trusted(has, truth, positive, n), is_word)
    posterior, _, _ = label_model(votes(has, style, lexicons), truth)
    return terms, train(np.hstack([has, style]), posterior)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = fit(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(model[0]) if model else None
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    if marks is None:
                        out.append(0.0)
                        continue
                    w = model[1]
                    out.append(float(sigmoid(w[marks.of(text)].sum() + w[-1 - STYLES:-1] @ style_of(text) + w[-1])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
