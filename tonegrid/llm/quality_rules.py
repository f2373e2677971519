"""Quality rules: counts, and a linear-chain conditional random field over lines.

Each line is labelled content or boilerplate by Viterbi decoding; the share of words in content
lines decides whether the document stays. Document-level limits come first. The field's weights are
learned from labelled documents by conditional likelihood.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common
from .text_stats import SYMBOL, WORDS, duplicate_lines, repeated_words

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


@dataclass(frozen=True)
class LineField:
    """Potentials of the field, as log weights in favour of boilerplate.

    ``state`` weighs the line features in the order of ``line_features``; ``change`` is the cost
    of a change of label between neighbours, ``start`` the cost of starting in boilerplate. The
    values here are what ``fit_field`` learned from 800 labelled rows of each quality of the tables
    at scale 0.1, to three places.
    """

    state: tuple[float, ...] = (-0.945, 11.108, 4.818, 4.944, 8.048, 1.259, 0.0, 9.407)
    change: float = 6.615
    start: float = 1.234

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most probable labels (True: boilerplate) of a sequence of feature rows."""
        emit = (x @ np.array(self.state)).tolist()
        content, junk, back = 0.0, -self.start, []
        content, junk = 0.0, junk + emit[0]
        for e in emit[1:]:
            from_junk, from_content = junk - self.change > content, content - self.change > junk
            back.append((from_junk, from_content))
            content, junk = (junk - self.change if from_junk else content), (content - self.change if from_content else junk) + e
        labels = [junk > content]
        for from_junk, from_content in reversed(back):
            labels.append((not from_content) if labels[-1] else from_junk)
        return np.array(labels[::-1])


def line_features(line: str, repeated: bool, stutter: float = 0.0) -> tuple[float, ...]:
    """1, symbol share, share of capitals beyond a third, exclamation marks a word, bars a word,
    repeated, no letters at all, share of words equal to the one before."""
    n = max(1, len(line))
    words = max(1, line.count(" ") + 1)
    letters = sum(map(str.isalpha, line)) if not line.isascii() else len(line.encode().translate(None, NOT_LETTERS))
    upper = len(line.encode().translate(None, NOT_UPPER))
    caps = max(0.0, upper / max(1, letters) - 0.34) if letters >= 8 else 0.0
    return (
        1.0,
        min(0.5, len(SYMBOL.findall(line)) / n),
        caps * 1.5,
        min(1.0, line.count("!") / words),
        min(0.5, line.count("|") / words),
        float(repeated),
        float(letters == 0),
        stutter,
    )


N_STATE = 8
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def line_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of the text's lines that have a word."""
    seen: set[str] = set()
    rows, words = [], []
    for line in text.split("\n"):
        found = WORDS.findall(line)
        n = len(found)
        if n:
            stutter = sum(map(operator.eq, found, found[1:])) / n if n > 4 else 0.0
            rows.append(line_features(line, line in seen, stutter))
            words.append(n)
            seen.add(line)
    return np.array(rows).reshape(-1, N_STATE), np.array(words)


def content_share(text: str, field: LineField) -> float:
    """Share of the text's words in lines labelled content; 1 for a text without words."""
    x, words = line_rows(text)
    if not len(x):
        return 1.0
    return float(words[~field.decode(x)].sum() / words.sum())


def judge(text: str | None, field: LineField, least_words: int, most_repeated: int, least_share: float) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    repeat = repeated_words(words)
    failed = n < least_words or 100 * repeat > most_repeated * n
    share = content_share(text, field)
    kept = not failed and share >= least_share
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), duplicate_lines(text.split("\n")), repeat, failed, kept, share


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    field: LineField = LineField(),
    least_words: int = 20,
    most_repeated: int = 30,
    least_share: float = 0.5,
) -> DataFrame:
    """One row per input row: id, counts, base_failed, kept, content_share.

    Whole texts, however long; null counts as empty, and an empty text fails the base rule with
    content share 1. Rows are judged one by one, so repeated rows and ties are judged alike; a
    null id stays null. Other columns are ignored. Empty table: empty result. No shuffle.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def work(part: pa.RecordBatch) -> dict:
        judged = [judge(t, field, least_words, most_repeated, least_share) for t in common.texts_of(part)]
        return {"doc_id": part.column("doc_id")} | dict(zip(names, zip(*judged, strict=True), strict=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_parts(rows, lambda: work, SCHEMA).withColumnRenamed("doc_id", id_col)


def kept_column(text, field: LineField = LineField(), least_words: int = 20, most_repeated: int = 30, least_share: float = 0.5):
    """The verdict as a boolean column of a text column, to filter rows in place."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(t, field, least_words, most_repeated, least_share)[6] for t in texts], dtype=bool)

    return pandas_udf(run, "boolean")(text)


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, np.ndarray]:
    """Conditional log-likelihood of padded label sequences, and its gradient, by forward and backward sums.

    ``x`` (sequences, lines, features), ``y`` labels, ``on`` which places are lines; ``theta`` is the
    state weights, the cost of a change and that of starting in boilerplate.
    """
    state, change, start = theta[:-2], theta[-2], theta[-1]
    n, length, _ = x.shape
    emit = np.stack([np.zeros((n, length)), x @ state], axis=-1)
    emit[:, 0, 1] -= start
    move = np.array([[0.0, -change], [-change, 0.0]])
    forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + emit[:, t]
        forward[:, t] = np.where(on[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(on[:, t + 1, None], step, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    share = np.exp(forward + backward - total[:, None, None])[..., 1] * on
    both = on[:, 1:] & on[:, :-1]
    pair = forward[:, :-1, :, None] + move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    moved = np.exp(pair[..., 0, 1]) + np.exp(pair[..., 1, 0])
    changes = (y[:, 1:] != y[:, :-1]) & both
    value = float((emit[..., 1] * y * on).sum() - change * changes.sum() - total.sum())
    grad_state = ((y - share) * on)[..., None] * x
    grad = np.concatenate([grad_state.sum((0, 1)), [-(changes.sum() - moved[both].sum()), -(y[:, 0] - share[:, 0])[on[:, 0]].sum()]])
    return value, grad


def fit_sequences(x: np.ndarray, y: np.ndarray, on: np.ndarray, l2: float = 1e-6, steps: int = 400, rate: float = 0.3) -> np.ndarray:
    """Weights of greatest penalised conditional likelihood, by Adam's rule over all sequences."""
    theta, first, second = np.zeros(x.shape[2] + 2), 0.0, 0.0
    for t in range(1, steps + 1):
        _, grad = likelihood(theta, x, y, on)
        grad = grad / max(1, on.sum()) - l2 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta


def fit_field(docs: DataFrame, labels: DataFrame, per_class: int = 800, most_lines: int = 40, rounds: int = 2) -> LineField:
    """Learn a field from at most ``per_class`` labelled rows of each quality, by id hash, and
    ``most_lines`` lines of each.

    Lines have no labels of their own. All lines of a row of quality 1 are content; those of a row
    of quality 0 start as boilerplate, and after each round take the labels that the field decodes
    where it finds any boilerplate in the row.
    """
    from .toxicity import held_out, labelled_sample

    sample = labelled_sample(docs, labels, "quality", lambda c: ~held_out(c, 5, 0), per_class)

    def work(part: pa.RecordBatch) -> dict:
        rows = [line_rows(t)[0][:most_lines] for t in common.texts_of(part)]
        return {"label": part.column("label"), "x": [r.ravel().tolist() for r in rows]}

    rows = common.map_parts(sample.select(F.col("label").cast("int").alias("label"), "text"), lambda: work, "label int, x array<double>").collect()
    found = [(r["label"], np.array(r["x"]).reshape(-1, N_STATE)) for r in rows if r["x"]]
    if len({good for good, _ in found}) < 2:
        return LineField()
    length = max(len(x) for _, x in found)
    x, on = np.zeros((len(found), length, N_STATE)), np.zeros((len(found), length), dtype=bool)
    y = np.zeros((len(found), length), dtype=bool)
    for i, (good, rows_) in enumerate(found):
        x[i, : len(rows_)], on[i, : len(rows_)], y[i, : len(rows_)] = rows_, True, not good
    for again in range(rounds):
        theta = fit_sequences(x, y, on)
        field = LineField(tuple(theta[:-2].tolist()), float(theta[-2]), float(theta[-1]))
        if again + 1 < rounds:
            for i, (good, rows_) in enumerate(found):
                if not good and (junk := field.decode(rows_)).any():
                    y[i, : len(rows_)] = junk
    return field
