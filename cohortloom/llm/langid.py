"""Language identification by a convolutional network over bytes.

A window is a fixed number of bytes. Each byte has an embedding; filters of several widths run over the window, the
greatest response of each filter is kept, and a softmax layer gives the languages. The network is trained in numpy on
windows of a bounded sample of labelled rows (``per_language`` rows a language at most on average, chosen by a hash of
the id; ``windows`` windows a row). It is applied to all windows of every whole text, many at a time; a text's language
is the one with the greatest mean probability over its windows, weighted by their bytes.

Once trained, a filter's response is a sum of table rows, one for each pair of neighbouring bytes, so no matrix product
runs over the text.

A null text, or one without a letter, is ``und`` with score 0; so is everything if no row is labelled. Repeated rows and
ties need no rule (equal probabilities take the first language in order). Rows with a null id are predicted, not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import small_batches, slices
from cohortloom.runtime import bounded_rows

WINDOW = 128
WIDTHS = (2, 3, 4)
MAX_LANGUAGES = 1000


def cut(held: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text number of each, bytes in each): all texts cut into windows, the last of a text padded with zeros."""
    sizes = np.diff(at)
    n = np.maximum(1, -(-sizes // WINDOW))
    text = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][text] + nth * WINDOW
    fill = np.minimum(WINDOW, at[1:][text] - start)
    padded = np.concatenate([held, np.zeros(WINDOW, np.uint8)])
    found = padded[start[:, None] + np.arange(WINDOW)]
    found[np.arange(WINDOW) >= fill[:, None]] = 0
    return found, text, fill


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Network:
    def __init__(self, languages: list[str], filters: int = 16, depth: int = 8, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"bytes": draw.normal(0, 0.5, (256, depth)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = draw.normal(0, (w * depth) ** -0.5, (w, depth, filters)).astype(np.float32)
            self.p[f"shift{w}"] = np.zeros(filters, np.float32)
        self.p["out"] = draw.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))).astype(np.float32)
        self.p["out0"] = np.zeros(len(languages), np.float32)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: the response of each byte value at each place of the filter."""
        return [[self.p["bytes"] @ self.p[f"filter{w}"][k] for k in range(w)] for w in WIDTHS]

    def train(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 6, batch: int = 128, step: float = 0.01,
              seed: int = 11) -> "Network":
        draw, moments = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = (len(labels) / (len(self.languages) * np.bincount(labels, minlength=len(self.languages)).clip(1)))[labels]
        turn = 0
        for _ in range(rounds):
            order = draw.permutation(len(labels))
            for first in range(0, len(order), batch):
                rows = order[first:first + batch]
                turn += 1
                for name, slope in self._slopes(windows[rows], labels[rows], weight[rows]).items():
                    m, v = moments[name]
                    m += 0.1 * (slope - m)
                    v += 0.001 * (slope * slope - v)
                    self.p[name] -= step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        return self

    def _slopes(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        rows, best, pooled = np.arange(len(x)), [], []
        for w, tables in zip(WIDTHS, self.tables()):
            n = WINDOW - w + 1
            response = sum(t[x[:, k:k + n]] for k, t in enumerate(tables)) + self.p[f"shift{w}"]
            best.append(response.argmax(axis=1))
            pooled.append(np.take_along_axis(response, best[-1][:, None], axis=1)[:, 0])
        top = np.concatenate(pooled, axis=1)
        active = np.maximum(top, 0)
        miss = softmax(active @ self.p["out"] + self.p["out0"])
        miss[rows, labels] -= 1
        miss *= (weight / len(x))[:, None].astype(np.float32)
        slopes = {"out": active.T @ miss, "out0": miss.sum(axis=0), "bytes": np.zeros_like(self.p["bytes"])}
        back = (miss @ self.p["out"].T) * (top > 0)
        filters = back.shape[1] // len(WIDTHS)
        for i, w in enumerate(WIDTHS):
            part = back[:, i * filters:(i + 1) * filters]
            slopes[f"shift{w}"] = part.sum(axis=0)
            slopes[f"filter{w}"] = np.empty_like(self.p[f"filter{w}"])
            for k in range(w):
                held = x[rows[:, None], best[i] + k]
                table = np.zeros((256, filters), np.float32)
                np.add.at(table, (held, np.arange(filters)[None]), part)
                slopes[f"filter{w}"][k] = self.p["bytes"].T @ table
                slopes["bytes"] += table @ self.p[f"filter{w}"][k].T
        return slopes

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width: tables over pairs of bytes (65,536 rows), and one over single bytes if the width is odd."""
        found = []
        for tables in self.tables():
            two = [(a[:, None] + b[None]).reshape(65536, -1) for a, b in zip(tables[::2], tables[1::2])]
            found.append(two + ([tables[-1]] if len(tables) % 2 else []))
        return found

    def probabilities(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for first in range(0, len(x), 1024):
            part = x[first:first + 1024]
            two = part[:, :-1].astype(np.uint16) << 8 | part[:, 1:]
            pooled = []
            for w, tables in zip(WIDTHS, pairs):
                n = WINDOW - w + 1
                response = np.take(tables[0], two[:, :n], axis=0)
                for k, t in enumerate(tables[1:], 1):
                    response += np.take(t, (two if len(t) == 65536 else part)[:, 2 * k:2 * k + n], axis=0)
                pooled.append(response.max(axis=1) + self.p[f"shift{w}"])
            out[first:first + 1024] = softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["out"] + self.p["out0"])
        return out


def held_out(id: str) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 600,
        windows: int = 4) -> Network | None:
    """Train on the labelled rows that are not held out; None if there are none.

    Rows are chosen by a hash of the id so that a language gives ``per_language`` on average, at most its all; of each
    row ``windows`` windows, evenly spread, are brought to the driver. That bounds what the driver holds.
    """
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"),
                       F.col(label).cast("string").alias("lang"), held_out(id).alias("out"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~F.col("out") & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in bounded_rows(rows.groupBy("lang").count(), MAX_LANGUAGES, "languages")}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_language / counts[k]))])
    place = F.abs(F.xxhash64("id") % 1_000_000) / 1_000_000.0
    chosen = rows.filter(place < share[F.col("lang")]).select("id", "lang", "text")

    def spread(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for ids, held, at, part in slices(iter([batch]), "id", "text"):
                found, of, fill = cut(held, at)
                counts = np.bincount(of, minlength=len(ids))
                nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                stride = np.maximum(1, counts // windows)[of]
                take = np.flatnonzero((nth % stride == 0) & (nth // stride < windows) & ((fill >= WINDOW // 4) | (nth == 0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids)[:0] if not len(ids) else part.column(0).take(pa.array(of[take])),
                     part.column(1).take(pa.array(of[take])), pa.array(nth[take]), pa.array([w.tobytes() for w in found[take]], pa.binary())],
                    ["id", "lang", "nth", "window"])

    sample = chosen.mapInArrow(spread, "id string, lang string, nth long, window binary").toArrow()
    sample = sample.sort_by([("id", "ascending"), ("nth", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    x = np.frombuffer(b"".join(sample.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    place_of = {k: i for i, k in enumerate(languages)}
    return Network(languages).train(x, np.array([place_of[k] for k in sample.column("lang").to_pylist()]))


def predict(docs: DataFrame, network: Network | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row; one pass without a shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(id).alias("held_out"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn(
                           "letters", F.col("text").rlike(r"\p{L}"))
    if network is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        pairs, names = network.pairs(), np.array([*network.languages, "und"], dtype=object)
        for ids, held, at, part in slices(batches, "doc_id", "text", 1 << 19):
            x, of, fill = cut(held, at)
            weight = np.maximum(fill, 1).astype(np.float64)
            total = np.zeros((len(ids), len(network.languages)))
            np.add.at(total, of, network.probabilities(x, pairs) * weight[:, None])
            mean = total / np.bincount(of, weights=weight, minlength=len(ids))[:, None]
            best, score = mean.argmax(axis=1), mean.max(axis=1).clip(0, 1)
            none = ~part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best[none], score[none] = len(network.languages), 0.0
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()),
                                              pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
