"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, row_and, texts_of
from .wordhash import words_of

#: Features are hashed into so many weights.
BUCKETS = 1 << 22
#: The model is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
MOST_RATINGS = 20_000
#: Ratings: 0 toxic, 1 low quality, 2 good.
GRADES = 3
#: Chosen are documents whose rating is good with at least this probability.
LEAST_TAIL = 0.5
#: Features of fewer rated documents have no weight.
LEAST_ROWS = 3
#: Steps and their size; decay and price of weights; how far rare grades are weighed up (0 not, 1 fully).
EPOCHS, RATE, DECAY, PRICE, BALANCE = 150, 0.1, 3e-5, 3e-4, 0.35

#: Words: letters, digits and other characters' bytes, in lower case. Marks: runs of ASCII signs.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MARKS = bytes(32 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c < 32 or c == 127 else c for c in range(256))
BLANK = np.array([c == 32 for c in range(256)])
_WORD, _MARK, _SHAPE = np.uint64(0), np.uint64(0x5851F42D4C957F2D), BUCKETS - 128


def _shapes(text: bytes) -> list[int]:
    """Levels of a text's form: share of capitals, share of signs, repeated lines."""
    data = np.frombuffer(text, np.uint8)
    letters = int(((data | 32) - 97 < 26).sum()) or 1
    capitals = int((data - 65 < 26).sum())
    signs = int((((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    level = lambda share: min(9, int(share * 10))
    return [_SHAPE + level(capitals / letters), _SHAPE + 10 + level(signs / max(1, len(data))), _SHAPE + 20 + level(again)]


def _word_shapes(hashes: np.ndarray, first: np.ndarray, words: bool) -> np.ndarray:
    """Levels of a text's words or marks: how many, and how many are the one before again."""
    n = np.diff(first)
    again = np.r_[0, np.cumsum(np.r_[False, hashes[1:] == hashes[:-1]])] if len(hashes) else np.zeros(1, int)
    share = 10 * (again[first[1:]] - again[first[:-1]]) // np.maximum(n, 1)
    length = np.minimum(np.log2(n + 1).astype(np.int64), 19)
    base = _SHAPE + 30 if words else _SHAPE + 62
    return np.column_stack([base + length, base + 20 + np.minimum(share, 10)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the features present in each text, and where each text's begin (one more at the end)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    parts, docs, forms = [], [], []
    for table, salt in ((LOWER, _WORD), (MARKS, _MARK)):
        of = words_of([t.translate(table) for t in data], BLANK)
        parts.append(((of.hashes ^ salt) % np.uint64(BUCKETS - 128)).astype(np.int64))
        docs.append(np.repeat(np.arange(len(data)), np.diff(of.first)))
        forms.append(_word_shapes(of.hashes, of.first, salt == _WORD))
    shapes = np.column_stack([np.array([_shapes(t) for t in data], np.int64).reshape(len(data), 3), *forms])
    parts.append(shapes.ravel())
    docs.append(np.repeat(np.arange(len(data)), shapes.shape[1]))
    both = np.unique(np.concatenate(docs) * BUCKETS + np.concatenate(parts))
    doc, index = both // BUCKETS, both % BUCKETS
    return index, np.searchsorted(doc, np.arange(len(data) + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade >= j) = sigmoid(score - thresholds[j - 1]): one set of weights, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(self.weights[index], dtype=np.float64)]
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def tails(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each grade from 1 on."""
        return _sigmoid(self.scores(index, bounds)[:, None] - self.thresholds[None, :])


def fit_ordinal(index: np.ndarray, bounds: np.ndarray, grades: np.ndarray) -> Ordinal:
    """Minimum of the weighted negative log likelihood with decayed and priced weights, by Adam over all rows.

    The price makes most weights zero. Without rows all probabilities are a half.
    """
    weights, first, gap = np.zeros(BUCKETS), 0.0, np.zeros(GRADES - 2)
    n = len(grades)
    if not n:
        return Ordinal(weights, np.zeros(GRADES - 1))
    often = np.bincount(index, minlength=BUCKETS) >= LEAST_ROWS
    bounds = np.r_[0, np.cumsum(often[index])][bounds]
    index = index[often[index]]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    counts = np.bincount(grades, minlength=GRADES)
    share = 1.0 / np.maximum(counts, 1)[grades] ** BALANCE
    share /= share.sum()
    used = np.flatnonzero(np.bincount(index, minlength=BUCKETS))
    of = np.zeros(BUCKETS, np.int32)
    of[used] = np.arange(len(used))
    place = of[index]
    del index, of, often
    w = np.zeros(len(used))
    state = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(GRADES - 1), np.zeros(GRADES - 1)]
    for step in range(1, EPOCHS + 1):
        thresholds = np.cumsum(np.r_[first, np.exp(gap)])
        sums = np.r_[0.0, np.cumsum(w[place])]
        score = sums[bounds[1:]] - sums[bounds[:-1]]
        edges = np.r_[-np.inf, thresholds, np.inf]
        below, above = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        below[grades == GRADES - 1], above[grades == 0] = 1.0, 0.0
        chance = np.maximum(below - above, 1e-9)
        d_below, d_above = below * (1 - below) / chance * share, above * (1 - above) / chance * share
        g_score = d_below - d_above
        g_edge = np.zeros(GRADES + 1)
        np.add.at(g_edge, grades + 1, -d_below)
        np.add.at(g_edge, grades, d_above)
        g_threshold = g_edge[1:-1]
        g_cut = np.r_[g_threshold.sum(), [g_threshold[k:].sum() * np.exp(gap[k - 1]) for k in range(1, GRADES - 1)]]
        g_w = np.bincount(place, weights=g_score[row], minlength=len(used)) + DECAY * w
        cut = np.r_[first, gap]
        for x, g, m, v in ((w, g_w, state[0], state[1]), (cut, g_cut, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            scale = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            x -= scale * (m / (1 - 0.9**step))
            if x is w:  # weights that don't earn their price become zero
                x[:] = np.sign(x) * np.maximum(np.abs(x) - scale * PRICE, 0)
        first, gap = cut[0], cut[1:]
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.r_[first, np.exp(gap)]))


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade): the lowest rating of each document. Rows without an id or any label are left out; a missing label is a good one."""
    rated = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("q"), labels["toxic"].cast("int").alias("t"))
    grade = F.when(F.coalesce("t", F.lit(0)) > 0, 0).when(F.coalesce("q", F.lit(1)) <= 0, 1).otherwise(2)
    return rated.filter("id is not null and not (q is null and t is null)").groupBy("id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_RATINGS) -> Ordinal:
    """Fit on at most `most` labelled documents: their features, not their texts, go to the driver."""
    ids = docs.select(docs["doc_id"].cast("long").alias("known")).distinct()
    chosen = graded(labels).join(ids, F.col("id") == F.col("known"), "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    rated = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id")  # `most` rows of two numbers
    ).dropDuplicates(["doc_id"]).select("doc_id", "text", "grade")

    def make(part: pa.RecordBatch) -> dict:
        index, bounds = features(part.column("text").to_pylist())
        rows = [index[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {"doc_id": part.column("doc_id"), "grade": part.column("grade"), "found": pa.array(rows, pa.binary())}

    rows = map_rows(rated, make, "doc_id long, grade int, found binary").toPandas().sort_values("doc_id")
    each = [np.frombuffer(x, "<i4") for x in rows["found"]]
    bounds = np.cumsum([0, *map(len, each)])
    return fit_ordinal(np.concatenate(each) if each else np.empty(0, np.int32), bounds, rows["grade"].to_numpy(np.int64))


def rate(docs: DataFrame, model: Ordinal, least_tail: float = LEAST_TAIL) -> DataFrame:
    """(row, expected_grade, tail_probability, kept); row has all columns of `docs`."""
    used = np.flatnonzero(model.weights)  # BUCKETS at most, mostly hundreds
    known = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def make(part: pa.RecordBatch) -> dict:
        index, bounds = features(texts_of(part))
        at, some, thresholds = known.value
        weights = np.zeros(BUCKETS, np.float32)
        weights[at] = some
        tails = Ordinal(weights, thresholds).tails(index, bounds)
        return {"row": part.column("row"), "expected_grade": tails.sum(axis=1), "tail_probability": tails[:, -1], "kept": tails[:, -1] >= least_tail}

    return map_rows(out, make, row_and(out, "expected_grade double, tail_probability double, kept boolean"), "row.text")


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_RATINGS, least_tail: float = LEAST_TAIL) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability, kept.

    Ratings are 0 toxic, 1 low quality, 2 good. tail_probability is the chance of the best
    grade; kept are documents where it reaches `least_tail`. Weights are shared by all grades,
    the thresholds between grades are ordered.

    Null and empty texts have the features of an empty text. Labels without an id, without
    any value or of unknown documents are not used; of several labels for a document the
    worst counts. Without labels each tail is a half and all are kept. Repeated rows give a
    row each, of the rows of one id one is fitted on. Other columns are not read.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rated = rate(slim, fit(docs, labels, most), least_tail)
    return rated.select("row.doc_id", "expected_grade", "tail_probability", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_RATINGS, least_tail: float = LEAST_TAIL, labelled: DataFrame | None = None) -> DataFrame:
    """The documents that are kept, with all their columns. The model is fitted on `labelled` documents, or on `docs`."""
    return rate(docs, fit(docs if labelled is None else labelled, labels, most), least_tail).filter("kept").select("row.*")
