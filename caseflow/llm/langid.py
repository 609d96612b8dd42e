"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 3, lower case) that both hold, presence only,
summed over the n (blended spectrum) and divided by the geometric mean of the texts' own numbers. The n-grams are those
that occur in the landmark texts. Nyström: kernel values against the landmarks stand for the whole kernel matrix. One
ridge regression per language on those values; scores of a batch are one product of its presence matrix with the
landmarks' and one with the coefficients.

Texts are read whole, in segments of ``SEGMENT`` characters, for fitting and for prediction: presence says little about
a text so long that it holds every n-gram once. A text's score is the mean of its segments', by length.

The model is fitted on a bounded sample of labelled rows: at most ``per_language`` rows of each language with at most
``longest`` characters, those with the smallest hash of their id and text. Characters of any script have codes of their
own as far as they occur in the landmarks; an n-gram with another character is in no landmark.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import set_apart, table, text_blocks, texts_of

PER_LANGUAGE = 400
LANDMARKS = 32
LONGEST = 20_000
RIDGE = 1e-3
SEGMENT = 1500
BLOCK_BYTES = 1 << 20
#: N-grams up to this number are looked up in a table, beyond it by binary search.
TABLE = 1 << 26
#: The pipeline rejects documents whose known share is below this part of the lowest one in the sample.
FLOOR_SHARE = 0.65
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: F.Column) -> F.Column:
    """True for documents whose crc32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    """``code``: character to code from 1 to ``base`` - 1; ``features``: sorted n-gram numbers; ``landmarks``: features by landmark.

    ``floor``: the lowest known share of a text of the sample, times ``FLOOR_SHARE``.
    """

    code: np.ndarray
    base: int
    features: np.ndarray
    landmarks: np.ndarray
    own: np.ndarray
    weights: np.ndarray
    languages: list[str]
    floor: float = 0.0

    def __post_init__(self):
        self.gram = None
        if self.base**3 <= TABLE:
            self.gram = np.full(self.base**3, -1, np.int32)
            self.gram[self.features] = np.arange(len(self.features))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the features among the n-grams."""
        if self.gram is not None:
            at = self.gram[grams]
            return at[at >= 0]
        if not len(self.features):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, grams), len(self.features) - 1)
        return at[self.features[at] == grams]

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of zeros and ones for each text: which features it holds; and how many of its n-grams are features."""
        out, known = np.zeros((len(texts), self.landmarks.shape[0]), np.float32), np.zeros(len(texts))
        for n, text in enumerate(texts):
            found = self.find(_grams(self.code, self.base, text))
            out[n, found] = 1
            known[n] = len(found)
        return out, known

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held, known = self.presence(texts)
        size = np.maximum(held.sum(1), 1)
        return (held @ self.landmarks) / np.sqrt(size[:, None] * self.own[None, :]), known

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and known share of each text.

        The score is the softmax share of the best regression; the known share that part of all n-grams which the landmarks hold.
        """
        cut = [segments(t) for t in texts]
        flat = [x for c in cut for x in c]
        parts = [self.kernel(flat[i : i + 256]) for i in range(0, len(flat), 256)]
        by_segment = np.concatenate([k for k, _ in parts]) @ self.weights[:-1] + self.weights[-1]
        size = np.array([len(x) + 1 for x in flat], float)
        first = np.cumsum([0, *[len(c) for c in cut[:-1]]])
        known = np.add.reduceat(np.concatenate([n for _, n in parts]), first) / np.add.reduceat(3 * size, first)
        raw = np.add.reduceat(by_segment * size[:, None], first) / np.add.reduceat(size, first)[:, None]
        share = np.exp(8 * (raw - raw.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = raw.argmax(1)
        letters = np.array([LETTER.search(t) is not None for t in texts], bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, share[np.arange(len(texts)), best], 0.0).astype(np.float64), known


def segments(text: str) -> list[str]:
    """The text in pieces of SEGMENT characters, the last one shorter; one piece at least."""
    return [text[i : i + SEGMENT] for i in range(0, max(len(text), 1), SEGMENT)]


def _grams(code: np.ndarray, base: int, text: str) -> np.ndarray:
    """Numbers of all 1-, 2- and 3-grams of a text, repeats included; code 0 (any other character) gives numbers of no feature."""
    points = code[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    points = points[np.concatenate([[True], (points[1:] > 0) | (points[:-1] > 0)])]  # one of a run of other characters
    two = points[:-1] * base + points[1:]
    two_known, known = (points[:-1] > 0) & (points[1:] > 0), points > 0
    three = (two[:-1] * base + points[2:])[two_known[:-1] & known[2:]]
    return np.concatenate([points[known], two[two_known], three])


def fit(labelled: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``labelled``: (text, language) pairs in a fixed order. All segments of all texts are fitted on; a language's landmarks are
    ``landmarks`` of its segments, those with the smallest checksums."""
    languages = sorted({lang for _, lang in labelled})
    whole = labelled
    labelled = [(part, lang) for text, lang in labelled for part in segments(text)]
    if not languages:
        return Model(np.zeros(0x110000, np.int32), 1, np.zeros(0, np.int64), np.zeros((1, 1), np.float32), np.ones(1, np.float32), np.zeros((2, 1)), [UNKNOWN])
    first = sorted(range(len(labelled)), key=lambda i: (zlib.crc32(labelled[i][0].encode("utf-8", "surrogatepass")), i))
    chosen = [labelled[i][0] for lang in languages for i in [i for i in first if labelled[i][1] == lang][:landmarks]]
    letters = sorted({c for text in chosen for c in f" {text.lower()} "})
    code, base = np.zeros(0x110000, np.int32), len(letters) + 1
    code[[ord(c) for c in letters]] = np.arange(1, base)
    held = [np.unique(_grams(code, base, t)) for t in chosen]
    features = np.unique(np.concatenate(held))
    rows = np.zeros((len(features), len(chosen)), np.float32)
    for j, h in enumerate(held):
        rows[np.searchsorted(features, h), j] = 1
    model = Model(code, base, features, rows, np.maximum(rows.sum(0), 1), np.zeros((1, 1)), languages)
    kernel = np.concatenate([model.kernel([t for t, _ in labelled[i : i + 128]])[0] for i in range(0, len(labelled), 128)]).astype(np.float64)
    between = model.kernel(chosen)[0].astype(np.float64)
    mean = kernel.mean(0)
    target = np.array([[1.0 if x == lang else 0.0 for lang in languages] for _, x in labelled])
    sizes = Counter(lang for _, lang in labelled)
    weigh = 1.0 / np.array([sizes[x] for _, x in labelled])[:, None]
    centred = kernel - mean
    coefficients = np.linalg.solve(centred.T @ (weigh * centred) + ridge * (between + np.eye(len(chosen))), centred.T @ (weigh * (target - 1 / len(languages))))
    model.weights = np.vstack([coefficients, 1 / len(languages) - mean @ coefficients])
    known = [model.predict([t for t, _ in whole[i : i + 128]])[2] for i in range(0, len(whole), 128)]
    model.floor = FLOOR_SHARE * float(np.concatenate(known).min())
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """The bounded sample of labelled rows the model is fitted on."""
    pool = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pool = pool.filter((F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    ranked = pool.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("hash"), "text")
    # all but about four times the wanted number of a language are left out by their hash before any row is ranked, and
    # those wanted have the smallest hashes, so the rank sees as few rows whatever the size of the corpus
    counts = ranked.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count("*")).alias("share"))
    # one row a language, of which the model holds a column of weights each; a broadcast, so that no row moves before the filter
    few = ranked.join(F.broadcast(counts), "lang").filter((F.col("hash") / F.lit(2.0**64) + 0.5) < F.col("share"))
    # rows that repeat a document are one row of the sample
    once = few.groupBy("lang", "hash", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    rows = once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("doc_id", "hash", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["hash"], r["lang"]))]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``text`` and any others) with ``lang_pred``, ``score`` and ``known``; null texts and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK_BYTES):
            names, score, known = shared.value.predict([t or "" for t in block.column("text").to_pylist()])
            block = block.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(score)).append_column("known", pa.array(known))
            yield from block.combine_chunks().to_batches()

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language. Those without a letter go, and those with a known share below the model's floor: text
    that is like none of the learned languages. Columns as they were."""
    model = fit(sample(docs))
    apart, names = set_apart(docs, "text")
    return identify(apart, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= model.floor)).select(*apart.columns).toDF(*names)


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(sample(docs))
    found = identify(texts_of(docs), model).select("doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
