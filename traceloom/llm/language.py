"""Operator 2, language identification in two levels: the language family, then one-versus-one machines.

A text is its byte trigrams, lower-cased, hashed to DIMS weights; a linear machine's value is the mean weight
over the whole text. One-versus-rest linear support vector machines choose the family, and within it a machine
for each pair of languages votes; equal votes go to the larger sum of margins. All are trained by dual
coordinate descent in one task, on a hash sample of about SAMPLE different labelled texts (of each language at most
PER_LANGUAGE, but about LEAST or all it has, also where this makes the sample larger); the sample's features are
made where its texts lie, and only the finished weights reach the driver.

Defined results: `und` with score 0 for a null text or one without a letter, and for all if nothing is labelled;
a null doc_id is never learned from and not held out. Rows are judged one by one, so ties and repeated rows
agree; a repeated row is learned from once. A very long text is counted piece by piece, so it takes no more than its
own bytes and one table of DIMS counts. An empty table gives an empty result. lang, source and doc_id are no inputs of
a prediction. Extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.word_tokens import slices

DIMS, SAMPLE, PER_LANGUAGE, LEAST = 1 << 13, 2400, 600, 12
COST, EPOCHS = 50.0, 30
MIN_SCORE = 0.3  # under it both levels are near a toss-up
PIECE, ROWS = 1 << 20, 256  # bytes of a text, and texts, that are counted at once
# Language families by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _hashed(b: np.ndarray) -> np.ndarray:
    """A hash under DIMS of each byte trigram."""
    b = b.astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed trigram stands in a text; it is set between blanks, so it has one at least."""
    raw = f" {text.lower()} ".encode()
    raw = np.frombuffer(raw if len(raw) > 2 else b"   ", np.uint8)
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw) - 2, PIECE):
        counts += np.bincount(_hashed(raw[at : at + PIECE + 2]), minlength=DIMS)
    return counts


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, at, share: the trigrams of each text (little-endian uint16) and their shares (float32)."""
    for pdf in batches:
        rows = []
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            counts = gram_counts(text)
            at = np.flatnonzero(counts)
            rows.append((lang, at.astype("<u2").tobytes(), (counts[at] / counts.sum()).astype("<f4").tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "at", "share"])


def svm(kernel: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Dual variables times labels of a linear machine with hinge loss; kernel has the bias in it."""
    alpha, value = np.zeros(len(y)), np.zeros(len(y))
    diagonal = np.maximum(kernel.diagonal(), 1e-12)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * value[i] - 1) / diagonal[i], 0.0), cost)
            if new != alpha[i]:
                value += (new - alpha[i]) * y[i] * kernel[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return alpha * y


class Model:
    """weights[DIMS, machines], bias[machines]; machines: one a family, then one a pair of languages."""

    def __init__(self, families: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray):
        self.families, self.pairs, self.weights, self.bias = families, pairs, weights.astype(np.float64), bias

    def to_row(self) -> tuple[str, bytes, bytes]:
        return json.dumps([self.families, self.pairs]), self.weights.astype("<f4").tobytes(), self.bias.astype("<f8").tobytes()

    @classmethod
    def from_row(cls, names: str, weights: bytes, bias: bytes) -> Model:
        families, pairs = json.loads(names)
        return cls(families, [tuple(p) for p in pairs], np.frombuffer(weights, "<f4").reshape(DIMS, -1), np.frombuffer(bias, "<f8"))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        values = np.empty((len(texts), self.weights.shape[1]))
        for at in range(0, len(texts), ROWS):
            counts = np.stack([gram_counts(t) for t in texts[at : at + ROWS]])
            values[at : at + ROWS] = counts @ self.weights / counts.sum(1)[:, None] + self.bias
        chosen = values[:, : len(names)].argmax(1) if len(names) > 1 else np.zeros(len(texts), int)
        score = np.ones(len(texts))
        if len(names) > 1:
            top = np.sort(values[:, : len(names)], axis=1)
            score = 1 / (1 + np.exp(-(top[:, -1] - top[:, -2])))
        langs = np.empty(len(texts), object)
        for f, name in enumerate(names):
            at, own = np.flatnonzero(chosen == f), self.families[name]
            votes, margins = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
            for k, (a, b) in enumerate(self.pairs, len(names)):
                if a in own and b in own:
                    m = values[at, k]
                    votes[:, own.index(a)] += m > 0
                    votes[:, own.index(b)] += m <= 0
                    margins[:, own.index(a)] += m
                    margins[:, own.index(b)] -= m
            best = np.lexsort((margins, votes), axis=1)[:, -1] if len(own) > 1 else np.zeros(len(at), int)
            langs[at] = np.array(own, object)[best]
            if len(own) > 1:
                score[at] *= 1 / (1 + np.exp(-2 * np.abs(margins[np.arange(len(at)), best]) / (len(own) - 1)))
        return langs.tolist(), score.round(6)


def train(rows: Iterable[tuple]) -> Model | None:
    """Machines from rows (language, trigrams, shares)."""
    rows = sorted(rows, key=lambda r: (r[0], bytes(memoryview(np.asarray(r[1], "<u2"))), bytes(memoryview(np.asarray(r[2], "<f4")))))
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family(lang), []).append(lang)
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (_, at, share) in enumerate(rows):
        x[i, at] = share
    own = np.array([r[0] for r in rows], object)
    scale = 1 / max(1e-9, float(np.median(np.linalg.norm(x, axis=1))))
    kernel = x @ x.T
    kernel *= scale**2
    kernel += 1
    names = list(families)
    tasks = [(np.arange(len(rows)), np.where([lang in families[n] for lang in own], 1.0, -1.0)) for n in names]
    pairs = [p for n in names for p in combinations(families[n], 2)]
    for a, b in pairs:
        at = np.flatnonzero((own == a) | (own == b))
        tasks.append((at, np.where(own[at] == a, 1.0, -1.0)))
    weights, bias = np.zeros((DIMS, len(tasks)), np.float32), np.zeros(len(tasks))
    for k, (at, y) in enumerate(tasks):
        if k >= len(names) or len(names) > 1:
            dual = svm(kernel if len(at) == len(rows) else kernel[np.ix_(at, at)], y)
            weights[:, k], bias[k] = (dual @ x[at]) * scale**2, dual.sum()
    return Model(families, pairs, weights, bias)


def sample(docs: DataFrame) -> DataFrame:
    """features() of the labelled texts that are learned from, out of docs(doc_id, text, lang) that are not held out."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("pick"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    each = min(PER_LANGUAGE, max(LEAST, SAMPLE // max(1, len(counts))))
    chance = F.when(F.lit(False), F.lit(0.0))  # one flat list of cases, however many languages
    for r in counts:
        chance = chance.when(F.col("lang") == r["lang"], F.lit(each / r["n"]))
    picked = usable.filter(F.pmod("pick", F.lit(1 << 30)) < chance * (1 << 30)).dropDuplicates(["lang", "pick"])
    return picked.select("lang", "text").mapInPandas(features, "lang string, at binary, share binary")


def _trainer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [(lang, np.frombuffer(at, "<u2"), np.frombuffer(share, "<f4")) for pdf in batches for lang, at, share in pdf.itertuples(index=False)]
    model = train(rows)
    if model is not None:
        yield pd.DataFrame([model.to_row()], columns=["names", "weights", "bias"])


def fit(docs: DataFrame) -> Model | None:
    """A model from docs(doc_id, text, lang); the sample is bounded, so one task can hold and learn it."""
    got = sample(docs).repartition(1).mapInPandas(_trainer, "names string, weights binary, bias binary").collect()
    return Model.from_row(*got[0]) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for docs(doc_id, text)."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lettered = pdf["_letter"].to_numpy(bool)
            langs, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            at = np.flatnonzero(lettered)
            if model is not None and len(at):
                texts = pdf["text"].iloc[at].tolist()
                for a, b in slices(texts):
                    langs[at[a:b]], score[at[a:b]] = model.predict(texts[a:b])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": langs, "score": score})

    letter = has_letter(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), letter.alias("_letter"), F.when(letter, F.col("text")).alias("text"))
    return rows.mapInPandas(judged, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs, with all its columns, without the rows that get no language or one of a score under min_score.

    Where nothing is labelled there is no model to reject by, and only rows whose text has no letter go.
    """
    model = fit(docs)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep = np.zeros(len(texts), bool)
            at = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
            if model is None:
                keep[at] = True
            for a, b in slices([texts[i] for i in at]) if model else ():
                keep[at[a:b]] = model.predict([texts[i] for i in at[a:b]])[1] >= min_score
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(passed, docs.schema)
