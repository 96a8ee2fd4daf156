"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed rows: one of the whole word and one of each of its beginnings of 3 to 7 letters, each
from a table of its own, so that words which collide in one differ in others and compounds share what they begin with. Rows
that fewer than MIN_DOCS documents of the sample use stay zero. Filters of widths 1 to 3 run over the whole text, the largest value of each filter is pooled, and a logistic layer scores
them. It is trained by Adam on a bounded sample of labelled rows (POSITIVES and NEGATIVES at most, by hash of the id, none
of the held-out fold); gradients only reach the words that pooling selected. A part of the sample is set aside: for each
language, guessed from the text's function words, the cut that separates it best is found there, and scores are shifted so
that 0.5 is that cut.

Filters are linear before pooling, so a word is multiplied by all filters once while it stays among the KNOWN last ones, and
scoring a text only adds rows. Memory is bounded by PIECE words at a time on texts of any length.

Defined results: a null or empty text is scored like one without words; without labelled rows of both classes every score
is the share of toxic rows among them, or 0; rows without doc_id aren't held out; labels that are null or contradict each
other for one doc_id: null ones are ignored, the largest counts; repeated rows keep a row each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm.common import arrow_map, documents, null_to_empty

FOLDS = 5
POSITIVES, NEGATIVES = 1500, 2000
TABLE = 1 << 16
#: Letters of the beginnings that are hashed besides the whole word (0).
BEGINNINGS = (0, 3, 4, 5, 6, 7)
MIN_DOCS = 3
#: Words whose products with all filters are kept.
KNOWN = 200_000
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 10
BATCH = 32
RATE = 0.02
DECAY = 1e-4
DROP_WORDS = 0.15
#: Words convolved at a time.
PIECE = 1 << 16
#: Every how many-th row of the sample calibrates, and how many rows of both classes a language's own cut needs.
CALIBRATE, OWN_CUT = 5, 12

WORD = re.compile(r"[^\W_]+")
#: Frequent function words that one of the languages has.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as be at by this from are an or",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les et des en du une que est pour qui dans par plus pas au sur se ce il",
    "es": "el los que y del las por con para una su al lo como más pero sus no se ya",
}


def word_rows(word: str) -> list[int]:
    """The rows of a word in the joined tables; a beginning that isn't shorter than the word is the word."""
    return [t * TABLE + zlib.crc32(word[: k or None].encode(), t) % TABLE for t, k in enumerate(BEGINNINGS)]


def word_ids(text: str, seen: dict[str, list[int]]) -> np.ndarray:
    """(words, tables): the rows of each word."""
    words = WORD.findall(text.lower())
    for w in {w for w in words if w not in seen}:
        seen[w] = word_rows(w)
    return np.array([seen[w] for w in words], dtype=np.int32).reshape(-1, len(BEGINNINGS))


def guess_language(text: str) -> str:
    """The language whose function words the text has most of; `other` without any."""
    words = text.lower().split()
    counts = {lang: sum(map(own.__contains__, words)) for lang, own in _FUNCTION_SETS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


_FUNCTION_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}


class Convolution:
    """The model: tables, filters of each width, output weights, and a cut by language."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.01, (len(BEGINNINGS) * TABLE, DIMENSIONS)).astype(np.float32)
        self.alive = np.ones(len(self.tables), dtype=bool)
        self.filters = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-2.0)
        self.cuts: dict[str, float] = {}
        self.fixed: float | None = None

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest value of each filter, at least 0, and where it stands (-1: nowhere above 0)."""
        values, places = [], {}
        x = self.tables[ids].sum(axis=1)
        for w in WIDTHS:
            padded = np.concatenate((x, np.zeros((max(w - len(x), 0), DIMENSIONS), dtype=np.float32)))
            n = len(padded) - w + 1
            maps = sum(padded[k : k + n] @ self.filters[w][k] for k in range(w)) + self.bias[w]
            at = maps.argmax(axis=0)
            top = maps[at, np.arange(FILTERS)]
            values.append(np.maximum(top, 0))
            places[w] = np.where(top > 0, at, -1)
        return np.concatenate(values), places

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.out + self.base)

    def train(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        used = np.zeros(len(self.tables), dtype=np.int64)
        for ids in rows:
            used[np.unique(ids)] += 1
        self.alive = used >= MIN_DOCS
        self.tables[~self.alive] = 0
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        names = ["tables", "out", "base", *(("filters", w) for w in WIDTHS), *(("bias", w) for w in WIDTHS)]
        get = lambda n: getattr(self, n) if isinstance(n, str) else getattr(self, n[0])[n[1]]
        first = {n: np.zeros_like(get(n)) for n in names}
        second = {n: np.zeros_like(get(n)) for n in names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                grads = {n: np.zeros_like(get(n)) for n in names if n != "tables"}
                touched: dict[int, np.ndarray] = {}
                for i in chosen:
                    ids = rows[i]
                    if len(ids) > 4:
                        ids = ids[rng.random(len(ids)) > DROP_WORDS]
                    pooled, places = self.pooled(ids)
                    p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))
                    d = np.float32((p - labels[i]) * weight[i] / len(chosen))
                    grads["out"] += d * pooled
                    grads["base"] += d
                    back = d * self.out
                    for j, w in enumerate(WIDTHS):
                        for f in np.nonzero(places[w] >= 0)[0]:
                            g = back[j * FILTERS + f]
                            grads[("bias", w)][f] += g
                            for k in range(w):
                                if (t := int(places[w][f]) + k) < len(ids):
                                    grads[("filters", w)][k, :, f] += g * self.tables[ids[t]].sum(axis=0)
                                    own = g * self.filters[w][k, :, f]
                                    for row in ids[t].tolist():
                                        if self.alive[row]:
                                            touched[row] = touched.get(row, 0) + own
                step += 1
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for n, g in grads.items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    moved = get(n) - (rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32)
                    if isinstance(n, str):
                        setattr(self, n, moved)
                    else:
                        getattr(self, n[0])[n[1]] = moved
                if touched:
                    r = np.array(list(touched), dtype=np.int64)
                    g = np.array(list(touched.values()), dtype=np.float32) + DECAY * self.tables[r]
                    first["tables"][r] = m = 0.9 * first["tables"][r] + 0.1 * g
                    second["tables"][r] = v = 0.999 * second["tables"][r] + 0.001 * g * g
                    self.tables[r] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, languages: list[str]) -> None:
        """The cut of each language that has enough rows, and of all together under the name ''."""
        names = np.array(languages)
        for lang in ["", *sorted(set(languages))]:
            own = names == lang if lang else np.ones(len(names), dtype=bool)
            if lang and min((labels[own] == 1).sum(), (labels[own] == 0).sum()) < OWN_CUT:
                continue
            self.cuts[lang] = best_cut(logits[own], labels[own])


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among those between neighbours that separate with the best balanced F1; 0 if unknown."""
    if not len(logits) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    hits = y.sum() - np.cumsum(y)[:-1]
    f1 = 2 * hits / (len(y) - np.arange(1, len(y)) + y.sum())
    best = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    k = best[np.argmax((x[1:] - x[:-1])[best])]
    return float((x[k] + x[k + 1]) / 2)


class Scorer:
    """The model folded for scoring: for each width and place in the window, both tables times all filters."""

    def __init__(self, model: Convolution):
        self.model = model
        self.filters = np.concatenate([np.concatenate([model.filters[w][k] for k in range(w)], axis=1) for w in WIDTHS], axis=1)
        self.known = np.empty((KNOWN, self.filters.shape[1]), dtype=np.float32)
        self.place: dict[str, int] = {}

    def products(self, words: list[str]) -> np.ndarray:
        """A row per word: its embedding times every filter at every place of the window."""
        place = self.place
        new = list({w for w in words if w not in place})
        if len(place) + len(new) > KNOWN:
            place.clear()
            new = list(set(words))
        if new:
            rows = np.array([word_rows(w) for w in new])
            self.known[len(place) : len(place) + len(new)] = self.model.tables[rows].sum(axis=1) @ self.filters
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        return self.known[[place[w] for w in words]]

    def score(self, text: str) -> float:
        model = self.model
        if model.fixed is not None:
            return float(model.fixed)
        words = WORD.findall(text.lower())
        top = np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
        reach = max(WIDTHS) - 1
        for at in range(0, max(len(words), 1), PIECE):
            part = words[at : at + PIECE + reach]
            x = self.products(part)
            col = 0
            for j, w in enumerate(WIDTHS):
                n = max(len(part), w) - w + 1
                total = np.zeros((n, FILTERS), dtype=np.float32)
                for k in range(w):
                    piece = x[k : k + n, col : col + FILTERS]
                    total[: len(piece)] += piece
                    col += FILTERS
                slot = slice(j * FILTERS, (j + 1) * FILTERS)
                top[slot] = np.maximum(top[slot], (total + model.bias[w]).max(axis=0))
        logit = float(np.maximum(top, 0) @ model.out + model.base)
        cut = model.cuts.get(guess_language(text), model.cuts.get("", 0.0))
        return 1 / (1 + float(np.exp(-np.clip(logit - cut, -30, 30))))


def held_out(doc_id, folds: int = FOLDS):
    """True for rows of the held-out fold: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Convolution:
    """Train on labelled rows that aren't held out: at most so many of each class, by hash of the id."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = marked.where("toxic = 1").orderBy(*order).limit(positives).unionByName(marked.where("toxic = 0").orderBy(*order).limit(negatives))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "id__")), F.col("doc_id") == F.col("id__")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    # One text an id, so that the bound on ids is one on rows.
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in sample.toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()[::-1]), r[0], r[1]))
    model, seen = Convolution(), {}
    y = np.array([r[2] for r in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        model.fixed = float(y.mean()) if len(y) else 0.0
        return model
    ids = [word_ids(r[1], seen) for r in rows]
    aside = np.arange(len(rows)) % CALIBRATE == 0
    if min((y[aside] == 1).sum(), (y[~aside] == 1).sum(), (y[~aside] == 0).sum()) < 3:
        aside = np.zeros(len(rows), dtype=bool)
    model.train([x for x, a in zip(ids, aside, strict=True) if not a], y[~aside])
    use = aside if aside.any() else ~aside
    logits = np.array([model.logit(x) for x, u in zip(ids, use, strict=True) if u])
    model.calibrate(logits, y[use], [guess_language(r[1]) for r, u in zip(rows, use, strict=True) if u])
    return model


def score(docs: DataFrame, model: Convolution, *, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the tables

    def make():
        scorer = Scorer(shared.value)

        def f(batch: pa.RecordBatch) -> dict:
            scores = [scorer.score(t) for t in null_to_empty(batch.column("text"))]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return f

    return arrow_map(docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, documents(spark, sf_dir, "labels")))
