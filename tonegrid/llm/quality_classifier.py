"""Quality classifier: Bradley-Terry ranking learned from all preference pairs of a good and a bad row.

A pair's preference depends on the difference of two strengths alone, so all pairs are summed from
the rows' counts and sums on a grid of strengths; no pair is formed or drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, logistic
from .quality_rules import NOT_LETTERS, NOT_UPPER
from .text_stats import SYMBOL, WORDS, duplicate_lines, repeated_words
from .toxicity import held_out

N_FEATURES = 15
#: Step of the grid of strengths. Between its points a pair's probability is interpolated, which errs by less than GRID**2 / 40.
GRID = 1 / 64
#: Grid points with rows, of both labels, up to which the driver sums pairs; beyond them the grid is made coarser.
MOST_POINTS = 1 << 14
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def features(text: str | None) -> list[float]:
    """Features of a whole text, all finite and bounded; an empty text has zeros but for the first."""
    text = text or ""
    words = WORDS.findall(text)
    n, chars = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    ascii_letters, upper = len(raw.translate(None, NOT_LETTERS)), len(raw.translate(None, NOT_UPPER))
    distinct = set(words)
    return [
        0.0,
        np.log1p(n) / 10,
        min(2.0, sum(map(len, words)) / n / 10),
        len(distinct) / n,
        len(SYMBOL.findall(text)) / chars,
        upper / max(1, ascii_letters),
        min(3.0, text.count("!") / n),
        min(1.0, text.count("|") / n),
        duplicate_lines(lines) / max(1, len(lines)),
        repeated_words(words) / n,
        min(1.0, (text.count(".") + text.count(",")) / n),
        min(1.0, len(lines) / n * 5),
        sum(c in raw for c in (b"http://", b"https://", b"@")) / 3,
        len(raw.translate(None, NOT_DIGIT)) / chars,
        sum(x[-1] not in ".!?\"'" for x in lines) / max(1, len(lines)),
    ]


@dataclass
class Ranking:
    """score = sigmoid(gain * (strength - cut) + logit(level)); ``cut`` is a quantile of strengths."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    gain: float
    level: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Summed in the order of the features, so a row's strength doesn't depend on the rows beside it."""
        out = np.zeros(len(x))
        for k, w in enumerate(self.weights):
            out += (x[:, k] - self.mean[k]) / self.scale[k] * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic.sigmoid(self.gain * (self.strength(x) - self.cut) + np.log(self.level / (1 - self.level)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights): P(good beats bad) = sigmoid(weights . (x_good - x_bad)). For rows in memory and drawn
    pairs; ``fit`` takes all pairs."""
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    i, j = rng.integers(len(good), size=pairs), rng.integers(len(bad), size=pairs)
    diff = (good[i] - bad[j]) / scale
    return mean, scale, logistic.fit(diff, np.ones(pairs), l2=l2)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) of every row."""

    def work(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "x": [features(t) for t in common.texts_of(part)]}

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return common.map_parts(rows, lambda: work, "doc_id long, held_out boolean, x array<double>")


def matrix_of(part: pa.RecordBatch) -> np.ndarray:
    return part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def on_grid(strength: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, up): a strength counts as 1 - up at the grid point below it and as up at the next."""
    at = strength / step
    point = np.floor(at)
    return point.astype(np.int64), at - point


def grid_sums(train: DataFrame, model: Ranking, step: float) -> DataFrame:
    """(label, point, s0, s1...): how many rows count at a grid point, and the sums of their standardised features."""

    def work(part: pa.RecordBatch) -> dict:
        x = matrix_of(part)
        point, up = on_grid(model.strength(x), step)
        label = common.longs_of(part, "label").astype(np.int64)
        keys, where = np.unique(np.concatenate([point, point + 1]) * 2 + np.tile(label, 2), return_inverse=True)
        z = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
        z = np.concatenate([z * (1 - up)[:, None], z * up[:, None]])
        sums = np.stack([np.bincount(where, column, len(keys)) for column in z.T], axis=1)
        return {"label": keys & 1, "point": keys >> 1, "sums": sums.tolist()}

    found = common.map_parts(train, lambda: work, "label int, point long, sums array<double>")
    return found.groupBy("label", "point").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(N_FEATURES + 1)])


@dataclass
class Side:
    """One label's rows on the grid: points in order, rows and sums of features at them, and of all pairs with the
    other side the chance to be on the wrong side and its slope, summed over the other's rows."""

    points: np.ndarray
    rows: np.ndarray
    sums: np.ndarray
    wrong: np.ndarray
    slope: np.ndarray


def sides(train: DataFrame, model: Ranking, step: float) -> tuple[Side, Side, float]:
    """(bad, good, step); the step is doubled while more than MOST_POINTS points have rows."""
    while (found := grid_sums(train, model, step).limit(MOST_POINTS + 1).toArrow()).num_rows > MOST_POINTS:
        step *= 2
    table = np.stack([c.to_numpy() for c in found.columns], axis=1).astype(float)
    out = []
    for label in (0, 1):
        own = table[table[:, 0] == label]
        own = own[np.argsort(own[:, 1])]
        out.append(Side(own[:, 1].astype(np.int64), own[:, 2], own[:, 3:], np.zeros(len(own)), np.zeros(len(own))))
    return *out, step


def sum_pairs(bad: Side, good: Side, step: float, block: int = 512) -> tuple[float, np.ndarray]:
    """(loss, cross): the loss of all pairs of grid points, and their slopes times both sides' sums of features;
    fills in ``wrong`` and ``slope``."""
    loss, cross = 0.0, np.zeros((N_FEATURES, N_FEATURES))
    for at in range(0, len(good.points), block):
        now = slice(at, at + block)
        lead = (good.points[now, None] - bad.points[None]) * step
        p = logistic.sigmoid(-lead)
        loss += float(good.rows[now] @ np.logaddexp(0, -lead) @ bad.rows)
        good.wrong[now] = p @ bad.rows
        bad.wrong += good.rows[now] @ p
        p *= 1 - p
        good.slope[now] = p @ bad.rows
        bad.slope += good.rows[now] @ p
        cross += good.sums[now].T @ (p @ bad.sums)
    return loss, cross


def weighted_squares(train: DataFrame, model: Ranking, both: tuple[Side, Side], step: float) -> np.ndarray:
    """Sum of z z' of all rows' standardised features, by the slope of each row's pairs."""
    grids = [(side.points, side.slope) for side in both]

    def work(part: pa.RecordBatch) -> dict:
        x = matrix_of(part)
        point, up = on_grid(model.strength(x), step)
        label, weight = common.longs_of(part, "label"), np.zeros(len(x))
        for y, (points, slope) in enumerate(grids):
            own = label == y
            for shift, share in ((0, 1 - up), (1, up)):
                place = np.minimum(np.searchsorted(points, point[own] + shift), len(points) - 1)
                weight[own] += share[own] * slope[place]
        z = (x - model.mean) / model.scale
        return {"sums": [((z * weight[:, None]).T @ z).ravel().tolist()]}

    found = common.map_parts(train, lambda: work, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    out = np.zeros(N_FEATURES * N_FEATURES)
    for r in found.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(N_FEATURES, N_FEATURES)


def fit_pairs(train: DataFrame, mean: np.ndarray, scale: np.ndarray, n_pairs: int, l2: float, rounds: int = 60) -> np.ndarray:
    """The weights with the least mean loss of all pairs and penalty, by Newton's method, a step halved where it overshoots.

    ``train`` is (label, x), written; each round reads it twice, and grid points and matrices come to the driver.
    """
    last, move, least, w = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf, np.zeros(N_FEATURES)
    for _ in range(rounds):
        model = Ranking(mean, scale, w, 0.0, 1.0, 0.5)
        bad, good, step = sides(train, model, GRID)
        loss, cross = sum_pairs(bad, good, step)
        loss = loss / n_pairs + l2 / 2 * float(w @ w)
        if loss > least + GRID**2 / 40 and np.abs(move).max() > 1e-6:
            move /= 2
            w = last + move
            continue
        squares = weighted_squares(train, model, (bad, good), step)
        slope = (bad.wrong @ bad.sums - good.wrong @ good.sums) / n_pairs + l2 * w
        move = -np.linalg.solve((squares - cross - cross.T) / n_pairs + l2 * np.eye(N_FEATURES), slope)
        last, least, w = w, loss, w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def values_at(rows: DataFrame, wanted: list[tuple[Column, int]], cells: int = 4096) -> list[float]:
    """The values of ``s`` at ranks, from 0, among the rows of a condition.

    The range that holds a rank is cut into cells and rows are counted by cell; the least and
    greatest value of the cell with the rank are the next range, until they are one value. Exact,
    and what comes to the driver are counts of cells.
    """
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    ranges = [(low, high, rank) for _, rank in wanted]
    while open_ := [i for i, (lo, hi, _) in enumerate(ranges) if lo < hi]:
        places = []
        for i in open_:
            lo, hi, _ = ranges[i]
            cell = F.least(F.floor((F.col("s") - lo) / (hi - lo) * cells), F.lit(cells - 1))
            places.append(F.when(wanted[i][0] & F.col("s").between(lo, hi), F.struct(F.lit(i).alias("target"), cell.alias("cell"))))
        counted = rows.select("s", F.explode(F.array(*places)).alias("c")).where("c is not null").groupBy("c.target", "c.cell")
        counted = counted.agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()
        for i in open_:
            rank = ranges[i][2]
            for r in sorted((r for r in counted if r["target"] == i), key=lambda r: r["cell"]):
                if rank < r["n"]:
                    ranges[i] = (r["lo"], r["hi"], rank)
                    break
                rank -= r["n"]
    return [lo for lo, _, _ in ranges]


def learn(found: DataFrame, labels: DataFrame, scratch: common.Scratch, level: float, l2: float) -> Ranking:
    """``fit`` from ``featured`` rows that were written."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = scratch.write(known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")), "labels")
    train = scratch.write(found.join(common.small(known), "doc_id").select("label", "x"), "train")
    means, spreads = ([f(F.col("x")[k]) for k in range(N_FEATURES)] for f in (F.avg, F.stddev_pop))
    n, good, *moments = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *means, *spreads).first()
    bad = n - good
    if not good or not bad:
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -1.0, 1.0, level)
    mean, scale = np.array(moments[:N_FEATURES]), np.array(moments[N_FEATURES:]) + 1e-6
    model = Ranking(mean, scale, fit_pairs(train, mean, scale, good * bad, l2), 0.0, 1.0, level)

    def work(part: pa.RecordBatch) -> dict:
        return {"label": part.column("label"), "s": model.strength(matrix_of(part))}

    strengths = scratch.write(common.map_parts(train, lambda: work, "label int, s double"), "strengths")
    is_good = F.col("label") == 1
    ranks = [(F.lit(True), bad - 1), (F.lit(True), bad)]
    ranks += [(is_good, (good - 1) // 2), (is_good, good // 2), (~is_good, (bad - 1) // 2), (~is_good, bad // 2)]
    below, above, *middles = values_at(strengths, ranks)
    spread = sum(middles[:2]) / 2 - sum(middles[2:]) / 2
    model.cut, model.gain = (below + above) / 2, 8.0 / max(spread, 1e-6)
    return model


def fit(docs: DataFrame, labels: DataFrame, level: float = 0.3, l2: float = 1e-3) -> Ranking:
    """Learn from every training row with a label, and from all pairs of a good and a bad one.

    ``cut`` is the quantile of the training rows' strengths at the share of low-quality rows among
    them, between two neighbours; it maps to ``level``.
    """
    with common.Scratch(docs.sparkSession, "quality") as scratch:
        rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
        return learn(scratch.write(featured(rows), "features"), labels, scratch, level, l2)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, level: float = 0.3, l2: float = 1e-3) -> DataFrame:
    """``score_documents`` by the model that ``fit`` learns from the same rows; each text is read once."""
    with common.Scratch(docs.sparkSession, "quality") as scratch:
        found = scratch.write(featured(docs), "features")
        model = learn(found, labels, scratch, level, l2)

        def work(part: pa.RecordBatch) -> dict:
            return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": model.score(matrix_of(part))}

        scored = common.map_parts(found, lambda: work, "doc_id long, held_out boolean, score double")
        return common.materialize(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "quality-result")


def score_documents(docs: DataFrame, model: Ranking, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Whole texts are read, however long, and decide alone; null and empty texts share one score, as
    do repeated rows; a null id stays null and is held out, as the empty string is. Other columns are
    ignored. Empty table: empty result. No shuffle.
    """

    def work(part: pa.RecordBatch) -> dict:
        x = np.array([features(t) for t in common.texts_of(part)]).reshape(-1, N_FEATURES)
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": model.score(x)}

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    scored = common.map_parts(rows, lambda: work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
