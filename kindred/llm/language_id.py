"""Language identification in two levels: the language's family, then one-versus-one linear SVMs within it.

A text becomes hashed counts of its byte 2-, 3- and 4-grams, square-rooted and scaled to length 1; digits, symbols and
white space count as one separator. A softmax regression over these picks the family. Within the family, a linear
support vector machine per pair of languages votes, so that closely related languages are told apart by a boundary of
their own. Models are fitted on the driver from a bounded sample of labelled rows, and applied where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.texts import held_out, table

#: Dimensions of the hashed counts.
DIMENSIONS = 4096
#: Labelled rows to fit on: at most this many in all, shared out evenly among the languages, at least LEAST each.
SAMPLE_ROWS = 2000
LEAST = 20
STEPS = 300
SEED = 5
CHUNK = 256
UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}

_FOLD = np.zeros(256, dtype=np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The text's features, of length 1; zeros if it has no letters."""
    folded = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    folded = np.concatenate(([np.uint32(0)], folded, [np.uint32(0)]))
    counts = np.zeros(dimensions)
    gram = folded
    for n in (2, 3, 4):
        if len(folded) < n:
            break
        gram = gram[:-1] * np.uint32(0x01000193) + folded[n - 1 :]
        solid = folded[: len(gram)] > 0 if n > 2 else (folded[:-1] > 0) | (folded[1:] > 0)
        slot = (gram[solid] * np.uint32(0x9E3779B1)) >> np.uint32(32 - dimensions.bit_length() + 1)
        counts += np.bincount(slot, minlength=dimensions)
    counts = np.sqrt(counts)
    return counts / max(np.linalg.norm(counts), 1e-9)


def _descend(gradient, shape: tuple[int, ...], step: float, steps: int = STEPS) -> np.ndarray:
    """Accelerated gradient descent from zero."""
    x = y = np.zeros(shape, dtype=np.float32)
    for t in range(steps):
        after = y - step * gradient(y)
        y, x = after + np.float32(t / (t + 3)) * (after - x), after
    return x


def softmax_regression(x: np.ndarray, label: np.ndarray, classes: int, penalty: float = 1e-4) -> np.ndarray:
    """Weights (dimensions + 1, classes) of a regression whose classes count alike, whatever their rows."""
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    goal = np.eye(classes, dtype=x.dtype)[label]
    share = (1 / (classes * np.maximum(np.bincount(label, minlength=classes), 1)))[label][:, None].astype(x.dtype)

    def gradient(w: np.ndarray) -> np.ndarray:
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return x.T @ (share * (p - goal)) + penalty * w

    return _descend(gradient, (x.shape[1], classes), step=1.0)


def linear_svm(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights (dimensions + 1) of a linear SVM with squared hinge loss; both sides count alike."""
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(x.dtype)

    def gradient(w: np.ndarray) -> np.ndarray:
        short = np.maximum(1 - sign * (x @ w), 0)
        return penalty * w - 2 * x.T @ (share * sign * short)

    return _descend(gradient, (x.shape[1],), step=0.2)


@dataclass
class Model:
    """Families in order, the languages of each, and the weights of both levels."""

    families: list[list[str]]
    of_family: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row and a score from 0 to 1: the family's probability times the language's share in it."""
        x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
        z = x @ self.of_family
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        found, score = np.empty(len(x), dtype=object), p[np.arange(len(x)), best]
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(languages)))
            belief = np.zeros((len(rows), len(languages)))
            for (i, a), (j, b) in combinations(enumerate(languages), 2):
                margin = x[rows] @ self.pairs[a, b]
                sure = 1 / (1 + np.exp(-3 * np.clip(margin, -50, 50)))
                votes[:, i] += margin > 0
                votes[:, j] += margin <= 0
                belief[:, i] += sure
                belief[:, j] += 1 - sure
            if len(languages) == 1:
                belief += 1
            choice = (votes + 1e-3 * belief).argmax(axis=1)
            found[rows] = np.array(languages, dtype=object)[choice]
            score[rows] *= belief[np.arange(len(rows)), choice] / belief.sum(axis=1)
        return list(found), score


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES) -> Model | None:
    """Fits both levels on at most SAMPLE_ROWS rows with a language and a letter; None if there are none.

    Rows are drawn in each language by a hash of id and text. With more than SAMPLE_ROWS / LEAST languages every
    language keeps LEAST rows, which then bounds the sample.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(SEED), F.col(doc_id), F.length(F.col(text))).alias("draw")
    )
    rows_of = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not rows_of:
        return None
    each = max(LEAST, SAMPLE_ROWS // len(rows_of))
    # Twice the share by hash, which needs no order, then the first of each language.
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2 * each / n))) for k, n in rows_of.items()])
    drawn = usable.where(F.pmod("draw", F.lit(1 << 40)) <= chance * float(1 << 40))
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= each)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            x = [vector(t).astype(np.float16).tobytes() for _, t in kept]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array(x, pa.binary())], names=["lang", "x"])

    sample = drawn.select("lang", "text").mapInArrow(featurise, "lang string, x binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in sample]).astype(np.float32)
    known = np.array([r["lang"] for r in sample])
    family_of = {code: name for name, codes in families.items() for code in codes}
    grouped: dict[str, list[str]] = {}
    for code in sorted(set(known)):
        grouped.setdefault(family_of.get(code, f"own {code}"), []).append(str(code))
    groups = [grouped[name] for name in sorted(grouped)]
    number = {code: f for f, codes in enumerate(groups) for code in codes}
    of_family = softmax_regression(x, np.array([number[k] for k in known]), len(groups))
    pairs = {}
    for codes in groups:
        for a, b in combinations(codes, 2):
            both = (known == a) | (known == b)
            pairs[a, b] = linear_svm(x[both], np.where(known[both] == a, 1.0, -1.0).astype(np.float32))
    return Model(groups, of_family, pairs)


def predict(docs: DataFrame, model: Model | None, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry``, lang_pred and score of every row; ``und`` and 0 for a text that is null or has no letter.

    Without a model, as nothing was labelled, every row is undetermined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs) x DIMENSIONS numbers
    rows = docs.select(*carry, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(low, CHUNK)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                sayable = [k for k, t in enumerate(texts) if has_letter(t)] if own else []
                if sayable:
                    best, sure = own.predict(np.stack([vector(texts[k]) for k in sayable]))
                    score[sayable] = sure
                    for k, code in zip(sayable, best, strict=True):
                        found[k] = code
                columns = [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(apply, f"{kinds}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3).alias("held_out"))
    model = fit(docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
