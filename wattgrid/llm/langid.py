"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte n-grams of the lower-cased text that do not cross a word; each is hashed to one
of ``BUCKETS`` embeddings, a text is the average of its subwords' embeddings, and a softmax over it
gives the language. Numpy trains both layers by stochastic gradient descent on counts that Spark
gathers from a bounded, hash-drawn sample of labelled rows. A part of the sample that is not trained
on sets the temperature of the scores and the score below which a text is rejected. The softmax is sure of
junk as well, so a text is also rejected if its subwords are too unlike those of all learned rows together;
that bound is set between the part not trained on and the same texts with their letters shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import fresh, give_back, quoted, text_batches, text_of, without

BUCKETS = 8192
SIZES = (2, 3, 4)
WIDTH = 16
#: Labelled rows drawn in all, and so the most languages that can be learned.
SAMPLE_ROWS = 6000
EPOCHS = 12
#: Bytes looked at in one piece.
PIECE = 1 << 20
#: Rejection: accuracy asked of what is kept, and the share of right answers that may be lost.
ASKED_ACCURACY = 0.99
LOST_SHARE = 0.001
#: Rejection: the share of shuffled texts that should fall. A larger one loses clean texts: at 0.99, one of 200.
CAUGHT_SHARE = 0.5


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text, lower-cased, with a space before and after."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PIECE):
        b = data[at:at + PIECE + max(SIZES) - 1].astype(np.uint32)
        own = len(b) if at + PIECE >= len(data) else PIECE  # a piece owns the n-grams that begin in it
        blank, code, inner = b <= 32, b, np.zeros(len(b), bool)
        for n in range(2, max(SIZES) + 1):
            code = code[:-1] * np.uint32(257) + b[n - 1:]
            inner = inner[:len(code)] | (blank[n - 2:n - 2 + len(code)] if n > 2 else False)
            if n in SIZES:
                within = code[:own][~inner[:own]]
                mixed = (within * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                counts += np.bincount((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(19), minlength=BUCKETS)
    return counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket embeddings times softmax weights: BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray | None = None  # log share of each bucket in the rows learned from
    least_known: float = -np.inf

    def scores(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.table / max(counts.sum(), 1) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def likeness(self, counts: np.ndarray) -> float:
        """Mean log share of the text's subwords among those learned from; 0 for a text without any."""
        return float(counts @ self.known / max(counts.sum(), 1)) if self.known is not None else 0.0


class Rows:
    """Subword counts of texts, packed; a few rows at a time are written out as numbers for each bucket."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[np.ndarray]:
        for one in self.packed:
            yield unpacked(one)

    def take(self, chosen: np.ndarray) -> Rows:
        return Rows([self.packed[k] for k in (np.flatnonzero(chosen) if chosen.dtype == bool else chosen).tolist()])

    def dense(self, chosen: np.ndarray) -> np.ndarray:
        return np.stack([unpacked(self.packed[k]) for k in chosen.tolist()]).astype(np.float32)


def packed(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes(), 1)


def unpacked(value: bytes) -> np.ndarray:
    data = zlib.decompress(value)
    n = len(data) // 6
    counts = np.zeros(BUCKETS, np.int64)
    counts[np.cumsum(np.frombuffer(data, np.uint16, n), dtype=np.int64)] = np.frombuffer(data, np.uint32, n, 2 * n) if n else []
    return counts


def shares_of(counts: Rows) -> np.ndarray:
    """Log share of each bucket, every row counting the same; buckets never seen get a little."""
    seen = np.full(BUCKETS, 1e-3)
    for row in counts:
        seen += row / max(row.sum(), 1)
    return np.log(seen / seen.sum())


def shuffled(text: str) -> str:
    """The text with its characters in another order, the same one each time."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(len(points)).permutation(points).tobytes().decode("utf-32-le", "surrogatepass")


def train(counts: Rows, marks: np.ndarray, languages: list[str], seed: int = 1) -> Model:
    """Embeddings and softmax by stochastic gradient descent with a falling rate; ``counts`` stays packed but for a batch."""
    rng = np.random.default_rng(seed)
    kinds = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.1, (WIDTH, kinds)).astype(np.float32)
    bias = np.zeros(kinds, np.float32)
    steps = EPOCHS * max(1, -(-len(marks) // 32))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(marks))
        for at in range(0, len(order), 32):
            rows = order[at:at + 32]
            x = counts.dense(rows)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            z = x @ embed
            logits = z @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), marks[rows]] -= 1
            p /= len(rows)
            rate = 20.0 * (1 - step / steps)
            back = p @ weight.T
            weight -= 0.1 * rate * (z.T @ p)
            bias -= 0.01 * rate * p.sum(0)
            used = np.flatnonzero(x.any(0))
            embed[used] -= rate * 4 * (x[:, used].T @ back)
            step += 1
    return Model(languages, (embed @ weight).astype(np.float64), bias.astype(np.float64))


def calibrate(model: Model, counts: Rows, marks: np.ndarray, junk: Rows | None = None) -> Model:
    """Set the temperature (least log loss), the threshold and, with rows of ``junk``, the least likeness.

    The threshold is the lowest score above which the asked accuracy holds, but never so high that
    more than ``LOST_SHARE`` of the right answers fall below it. The least likeness is that which
    ``CAUGHT_SHARE`` of the junk does not reach, under the same bound.
    """
    if not len(marks):
        return model
    def table(t: float) -> np.ndarray:
        return np.array([Model(model.languages, model.table, model.bias, t).scores(c) for c in counts])
    grid = [2.0 ** k for k in range(-6, 5)]
    model.temperature = min(grid, key=lambda t: -np.log(np.maximum(table(t)[np.arange(len(marks)), marks], 1e-12)).mean())
    scored = table(model.temperature)
    best, right = scored.max(1), scored.argmax(1) == marks
    order = np.argsort(-best, kind="stable")
    accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(accuracy >= ASKED_ACCURACY)
    risky = float(best[order[good[-1]]]) if len(good) and good[-1] < len(order) - 1 else 0.0 if len(good) else 1.0
    spared = float(np.quantile(best[right], LOST_SHARE)) if right.any() else 0.0
    model.threshold = min(risky, spared)
    if junk is not None and len(junk) and right.any():
        clean = np.array([model.likeness(c) for c in counts.take(right)])
        bad = np.array([model.likeness(c) for c in junk])
        model.least_known = min(float(np.quantile(bad, CAUGHT_SHARE)), float(np.quantile(clean, LOST_SHARE, method="lower")))
    return model


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from rows whose ``crc32(doc_id) mod 5`` is not 0; remainder 4 calibrates.

    Rows without language, text or id teach nothing; with none left, the model has no language. The draw is
    by hash of id and text, as many rows for each language, ``SAMPLE_ROWS`` in all; each row drawn
    is counted whole.
    """
    text_batches(docs)
    usable = docs.select(quoted(lang).cast("string").alias("lang"), text_of(text).alias("text"), quoted(doc_id).alias("id"),
                         remainder(quoted(doc_id)).alias("part")).where("lang is not null and part > 0 and text != ''")
    per = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()
    if not per:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = SAMPLE_ROWS / len(per)
    space = 1 << 30
    rate = F.create_map(*[x for r in per for x in (F.lit(r["lang"]), F.lit(int(min(1.0, share / r["count"]) * space)))])

    @F.arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        out = pa.array([packed(subword_counts(t.as_py())) for t in texts], pa.binary())
        give_back()
        return out

    @F.arrow_udf("binary")
    def counted_shuffled(texts: pa.Array) -> pa.Array:
        out = pa.array([packed(subword_counts(shuffled(t.as_py()))) if t.is_valid and has_letter(t.as_py()) else None for t in texts], pa.binary())
        give_back()
        return out

    place = F.pmod(F.xxhash64("id", "text"), F.lit(space))
    drawn = usable.withColumn("place", place).where(F.col("place") < F.element_at(rate, F.col("lang")))
    # Rows alike share a place, so the draw alone is no bound; the limit is.
    junk = F.when(F.col("part") == 4, F.col("text"))
    rows = drawn.select("lang", "part", "place", "id", counted("text").alias("counts"), counted_shuffled(junk).alias("junk")).orderBy("place", "id").limit(2 * SAMPLE_ROWS).toArrow().to_pylist()
    rows = [r for r in rows if unpacked(r["counts"]).any()]
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    counts = Rows([r["counts"] for r in rows])
    marks = np.array([languages.index(r["lang"]) for r in rows], int)
    held = np.array([r["part"] == 4 for r in rows], bool)
    taught = ~held if (~held).any() else held
    model = train(counts.take(taught), marks[taught], languages)
    model.known = shares_of(counts.take(taught))
    return calibrate(model, counts.take(held), marks[held], Rows([r["junk"] for r in rows if r["junk"] and unpacked(r["junk"]).any()]))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "lang_rejected")) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and lang_rejected (``names``); other columns are kept.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Else lang_pred is
    the likeliest language learned, rejected if its score or its likeness to what was learned is below its calibrated bound. A
    model without languages says ``und`` and rejects only texts without letters.
    """
    text_batches(docs)
    docs = without(docs, *names)
    (found,) = fresh(docs, "language_found")

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def judged(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            t = value.as_py()
            if not t or not has_letter(t):
                out.append(("und", 0.0, True))
            elif not model.languages:
                out.append(("und", 0.0, False))
            else:
                counts = subword_counts(t)
                p = model.scores(counts)
                k = int(p.argmax())
                out.append((model.languages[k], float(min(1.0, p[k])), bool(p[k] < model.threshold or model.likeness(counts) < model.least_known)))
        give_back()
        names, scores, rejected = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    kept = [quoted(c) for c in docs.columns]
    return docs.withColumn(found, judged(text_of(text))).select(
        *kept, *[F.col(f"{found}.{field}").alias(name) for field, name in zip(("lang", "score", "rejected"), names)])


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose language is not rejected, with their own columns."""
    names = fresh(docs, "lang_pred", "score", "lang_rejected")
    marked = predict(docs, fit(docs, text, lang, doc_id), text, tuple(names))
    return marked.where(~F.col(names[2])).select(*[quoted(c) for c in docs.columns])
