"""Language identification by string kernels.

A text is the set of its byte n-grams (n = 1 to 3, lower case, whatever is no letter counts as a
space), hashed into DIM bits: a blended-spectrum presence vector. The kernel of two texts is the
square of the cosine of their vectors. A one-versus-rest kernel ridge regression with Nystrom
landmarks is fitted from a bounded sample of the labelled rows: `per_lang` a language, of which
`landmarks` serve as landmarks (fewer, but one at least, where all languages would have more than
`most_landmarks`). The sample's kernel rows are multiplied on the executors; the landmarks' bits and the
products, whose size is the square of the number of landmarks, reach the driver. All texts are scored in
batches by two matrix products.

A text that is null or has no letter (by str.isalpha) gets `und`, score 0, as do all where no labelled row exists (`und_reason` tells the two apart).
`claimed` is false for `und` and where every one-versus-rest score is negative: no language takes
the text. Null labels teach nothing. Ties go to the language that sorts first. Every row gives a row.
Columns of `keep` that bear a new column's name are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.llm.common import Scratch, field, map_texts, read

DIM = 1 << 14
BATCH = 256
SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def presence(texts: list) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams each text has."""
    x = np.zeros((len(texts), DIM), np.float32)
    for row, t in zip(x, texts):
        b = np.frombuffer((t or "").lower().encode().translate(SPACED), np.uint8)
        for a in range(0, len(b), 1 << 20):  # by pieces, so that memory stays bounded
            code = b[a : a + (1 << 20) + 2].astype(np.uint32)
            whole = code
            for n in (1, 2, 3):
                if n > 1:
                    code = (code[:-1] << np.uint32(8)) | whole[n - 1 :]
                row[((code + np.uint32(n << 28)) * np.uint32(2654435761)) >> np.uint32(32 - 14)] = 1
    return x


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[None, :]
    return (x @ landmarks.T / norm) ** 2


class Model:
    """Languages, the landmarks' packed bits, and a column of weights for each language."""

    def __init__(self, langs: list[str], bits: np.ndarray, alpha: np.ndarray):
        self.langs, self.bits, self.alpha = langs, bits, alpha

    def scorer(self):
        landmarks = np.unpackbits(self.bits, axis=1).astype(np.float32) if self.langs else None

        def f(texts: list) -> list[list]:
            lang, score, claimed, reason = [], [], [], []
            for a in range(0, len(texts), BATCH):
                part = texts[a : a + BATCH]
                s = kernel(presence(part), landmarks) @ self.alpha if self.langs else None
                for i, t in enumerate(part):
                    letter = any(map(str.isalpha, t or ""))
                    if not self.langs or not letter:
                        lang.append("und"), score.append(0.0), claimed.append(False), reason.append("no model" if letter else "no letter")
                        continue
                    k = int(np.argmax(s[i]))
                    others = np.delete(s[i], k)
                    lead = float(s[i][k] - others.max()) if len(others) else 2.0
                    lang.append(self.langs[k]), score.append(min(1.0, max(0.0, 0.5 + lead / 4))), claimed.append(bool(s[i][k] > 0)), reason.append(None)
            return [lang, score, claimed, reason]
        return f


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def fit(
    docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, lang_col: str, per_lang: int, landmarks: int, most_landmarks: int = 4096, ridge: float = 1e-3,
) -> Model:
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold_of(id_col) != 1))
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    sizes = labelled.groupBy("lang").count()  # a row for each language
    # a hash of the id picks about 1.5 per_lang rows of each language where they are; of these the per_lang least stay
    luck = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003))
    some = labelled.withColumn("luck", luck).join(F.broadcast(sizes), "lang").filter(F.col("luck") * F.col("count") < 1.5 * per_lang * 1_000_003)

    def make():
        return lambda texts: [[b.tobytes() for a in range(0, len(texts), BATCH) for b in np.packbits(presence(texts[a : a + BATCH]).astype(bool), axis=1)]]

    bits = map_texts(some, "text", ["lang", "luck", "id"], [field("bits", "binary")], make)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "id", "bits"))
    sample = scratch.write(bits.withColumn("place", place).filter(F.col("place") <= per_lang).select("lang", "place", "bits"), "sample")

    taught = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    langs = sorted(taught)
    if not langs:
        return Model([], np.zeros((0, DIM // 8), np.uint8), np.zeros((0, 0), np.float32))
    each = max(1, min(landmarks, most_landmarks // len(langs)))
    marks = np.stack([np.frombuffer(r["bits"], np.uint8) for r in sample.filter(F.col("place") <= each).orderBy("lang", "place").collect()])
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # most_landmarks or one a language

    def products(batches):
        import pyarrow as pa

        own = np.unpackbits(shared.value, axis=1).astype(np.float32)
        gram, right = np.zeros((len(own), len(own))), np.zeros((len(own), len(langs)))
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.slice(a, BATCH)
                x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in part.column(1).to_pylist()]), axis=1).astype(np.float32)
                names = part.column(0).to_pylist()
                weight = np.array([1 / taught[n] for n in names])[:, None]  # languages count alike
                y = np.where(np.array(names)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
                k = kernel(x, own).astype(np.float64)
                gram += k.T @ (weight * k)
                right += k.T @ (weight * y)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], names=["gram", "right"])

    rows = sample.select("lang", "bits", "place").repartition(1 + sum(taught.values()) // 8192, "lang", "place").select("lang", "bits").mapInArrow(products, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(len(marks), -1) for r in rows)
    right = sum(np.frombuffer(r["right"]).reshape(len(marks), -1) for r in rows)
    x = np.unpackbits(marks, axis=1).astype(np.float32)
    alpha = np.linalg.solve(gram + ridge * kernel(x, x).astype(np.float64) + 1e-8 * np.eye(len(marks)), right)
    return Model(langs, marks, alpha.astype(np.float32))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, per_lang: int = 300, landmarks: int = 32,
    scratch: Scratch | None = None,
) -> DataFrame:
    """`keep` (all) columns of docs and lang_pred, score, claimed, und_reason; columns of these names are replaced."""
    model = fit(docs, scratch or Scratch(docs.sparkSession), id_col, text_col, lang_col, per_lang, landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of landmarks
    fields = [field("lang_pred", "string"), field("score", "double"), field("claimed", "boolean"), field("und_reason", "string")]
    return map_texts(docs, text_col, docs.columns if keep is None else keep, fields, lambda: shared.value.scorer())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
