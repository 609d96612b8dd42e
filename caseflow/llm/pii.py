"""Personal data by weak supervision.

Patterns find base spans (email, ip, card, phone), which always stay, and wider candidates (phone numbers without a
country code, social security numbers, account numbers, names). Labelers vote on every candidate: the shape of the
text, checksums, word lists around it, what stands directly beside it, and how often its value occurs in the text. All
votes and features of a candidate are one short code, so the corpus comes down to a count for each code. There are at
most a few thousand codes, however large the corpus is. Expectation-maximisation on those counts estimates how
reliable each labeler is; a logistic span classifier is trained on the expected labels; codes it accepts are kept.

Texts are read once; the table of spans that the first pass writes holds no text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import set_apart, staged, table, text_blocks, texts_of

BLOCK_BYTES = 1 << 20
BASE_KINDS = ("email", "ip", "card", "phone")
WIDE_KINDS = ("local_phone", "ssn", "iban", "name")
KINDS = BASE_KINDS + WIDE_KINDS
ACCEPT = 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
CLAIMS = ("name is", "ich heiße", "je m'appelle", "me llamo")
NAME = re.compile(rf"(?:\b(?:{'|'.join(TITLES)})\b\.?|{'|'.join(CLAIMS)})\x20([^\W\d_]+(?:\x20[^\W\d_]+)?)")
GAZETTEER = {
    "email": {"mail", "email", "contact", "write", "correo", "courriel"}, "ip": {"ip", "host", "address", "server"},
    "card": {"card", "visa", "credit", "karte", "carte", "tarjeta"}, "phone": {"call", "phone", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "local_phone": {"call", "phone", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"}, "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"}, "name": {"anna", "maria", "john", "peter", "paul", "carlos", "marie", "hans", "james", "laura"},
}
NOT_PERSONAL = {"version", "isbn", "page", "order", "invoice", "section", "chapter", "no", "nr", "id", "$", "€", "eur", "usd"}
WORD = re.compile(r"[^\W_]+|[$€]")
LABELERS = ("shape", "checksum", "near_word", "other_word", "edges", "repeats")


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start; per kind leftmost and without overlap."""
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        start = past + len(text[past:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        past = domain.end() if domain else at + 1
        if domain:
            found.append(("email", start, past))
        at = text.find("@", past)
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _at_most_255(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def wide_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the wider kinds that overlap no base span."""
    found = []
    if DIGIT.search(text):
        for kind, pattern in (("local_phone", LOCAL_PHONE), ("ssn", SSN), ("iban", IBAN)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if any(t in text for t in TITLES) or any(c in text for c in CLAIMS):
        found += [("name", *m.span(1)) for m in NAME.finditer(text)]
    edges = sorted((b, e) for _, b, e in taken)
    starts, reach = [b for b, _ in edges], list(accumulate((e for _, e in edges), max))
    # the base spans that start before a candidate's end are the first few; one of them overlaps it if any reaches into it
    return [s for s in found if not (n := bisect_left(starts, s[2])) or reach[n - 1] <= s[1]]


def votes(text: str, kind: str, start: int, end: int, times: int = 1) -> str:
    """A digit for each labeler: 2 for personal, 1 for not, 0 for no opinion. ``times``: spans of the text with this value."""
    value = text[start:end]
    digits = _digits(value)
    before = WORD.findall(text[max(0, start - 60) : start].lower())[-5:]
    after = WORD.findall(text[end : end + 40].lower())[:3]
    shape = {"email": len(value) <= 80, "ip": not value.startswith("0"), "card": len(digits) == 16, "phone": len(digits) >= 10,
             "local_phone": value[0] == "(" or value.count("-") == 2, "ssn": True, "iban": 15 <= len(value.replace(" ", "")) <= 34, "name": value[:1].isupper()}[kind]
    checked = 0
    if kind == "card":
        checked = 2 if luhn(digits) else 1
    elif kind == "iban":
        moved = value.replace(" ", "")
        moved = moved[4:] + moved[:4]
        checked = 2 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else 1
    elif kind == "ssn":
        checked = 1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2
    elif kind == "local_phone":
        checked = 1 if digits[0] in "01" or digits[3] in "01" else 2
    elif kind == "name":
        checked = 2 if all(w[:1].isupper() for w in value.split()) else 1
    near = 2 if GAZETTEER[kind] & {*before, *after, *(value.lower().split() if kind == "name" else ())} else 0
    other = 1 if before and before[-1] in NOT_PERSONAL else 0
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    edges = 1 if any(c.isalnum() or c in "_/-=" for c in beside) else 2
    repeats = 1 if times > 3 else 0
    return "".join(map(str, (2 if shape else 1, checked, near, other, edges, repeats)))


class SpanModel:
    """Labeler reliabilities by expectation-maximisation and the classifier trained on the expected labels."""

    def __init__(self, counts: dict[tuple[str, str], int], rounds: int = 50):
        self.codes = sorted(counts)
        n = np.array([counts[c] for c in self.codes], float)
        vote = np.array([[int(v) for v in code] for _, code in self.codes], int).reshape(len(self.codes), len(LABELERS))
        #: reliability[label, labeler, vote]: chance of a vote given the label; starts from labelers mostly right.
        self.reliability = np.tile(np.array([[0.4, 0.4, 0.2], [0.4, 0.2, 0.4]])[:, None, :], (1, len(LABELERS), 1))
        self.prior = 0.5
        expected = np.full(len(self.codes), 0.5)
        for _ in range(rounds if len(self.codes) else 0):
            log = [np.log(p) + sum(np.log(self.reliability[y, k][vote[:, k]]) for k in range(len(LABELERS))) for y, p in ((0, 1 - self.prior), (1, self.prior))]
            expected = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            self.prior = float(np.clip((n * expected).sum() / n.sum(), 0.01, 0.99))
            for y, w in ((0, n * (1 - expected)), (1, n * expected)):
                for k in range(len(LABELERS)):
                    tally = np.bincount(vote[:, k], weights=w, minlength=3) + [1.0, 1.0 + (y == 0), 1.0 + (y == 1)]
                    self.reliability[y, k] = tally / tally.sum()
        kinds = np.array([[k == kind for kind in KINDS] for k, _ in self.codes], float).reshape(-1, len(KINDS))
        features = np.hstack([kinds, vote == 2, vote == 1]).astype(float)
        self.weights = np.zeros(features.shape[1])
        weigh = np.sqrt(n) / max(np.sqrt(n).sum(), 1)
        for _ in range(400 if len(self.codes) else 0):
            p = 1 / (1 + np.exp(-features @ self.weights))
            self.weights += 4.0 * (features.T @ (weigh * (expected - p)) - 1e-3 * self.weights)
        self.score = dict(zip(self.codes, (1 / (1 + np.exp(-features @ self.weights))).tolist()))
        self.expected = dict(zip(self.codes, expected.tolist()))

    def accepted(self, threshold: float = ACCEPT) -> list[str]:
        return [f"{kind}:{code}" for kind, code in self.codes if kind in WIDE_KINDS and self.score[kind, code] >= threshold]


SPAN = "array<struct<kind:string,start:bigint,stop:bigint,code:string>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("code", pa.string())]))


def spans_with_votes(docs: DataFrame) -> DataFrame:
    """``docs`` (``text`` and any others) with ``found``: base and wide spans with the votes on them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK_BYTES):
            rows = []
            for text in block.column("text").to_pylist():
                base = base_spans(text or "")
                wide = sorted(wide_spans(text or "", base), key=lambda s: (KINDS.index(s[0]), s[1]))
                times = Counter(text[a:b] for _, a, b in base + wide)
                rows.append([{"kind": k, "start": a, "stop": b, "code": votes(text, k, a, b, times[text[a:b]])} for k, a, b in base + wide])
            yield from block.append_column("found", pa.array(rows, SPAN_TYPE)).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, found {SPAN}")


def fit(found: DataFrame) -> SpanModel:
    """The span model of all spans; only counts by kind and code come to the driver, at most 8 kinds times 3^6 codes."""
    counts = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.code").count().collect()
    return SpanModel({(r["kind"], r["code"]): r["count"] for r in counts})


def with_accepted(found: DataFrame, model: SpanModel) -> DataFrame:
    """``found`` without the wide spans that the classifier refuses."""
    wanted = F.array(*[F.lit(c) for c in model.accepted()]) if model.accepted() else F.array(F.lit(""))
    return found.withColumn(
        "found", F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS) | F.array_contains(wanted, F.concat_ws(":", s["kind"], s["code"])))
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)`` for every row of ``docs`` (``doc_id``, ``text``): spans by kind and start, in code points.

    Null and empty texts have no spans; repeated rows each get their row; ties of a kind cannot start at one place.
    """
    found = staged(spans_with_votes(texts_of(docs)).drop("text"), "spans")
    return with_accepted(found, fit(found))


def joined(spans, kinds: tuple[str, ...] | None = None):
    """Spans as kind:start:end, comma-joined."""
    own = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    All rows and columns stay; null texts stay null. ``n_chars``, where there is one, follows the text.
    """
    apart, names = set_apart(docs, "text")
    found = staged(spans_with_votes(apart), "redacted")
    chosen = with_accepted(found, fit(found))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK_BYTES):
            texts = block.column("text").to_pylist()
            for i, spans in enumerate(block.column("found").to_pylist()):
                if spans:
                    texts[i] = replaced(texts[i], [(s["kind"], s["start"], s["stop"]) for s in spans])
            at = block.schema.get_field_index("text")
            yield from block.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["found"]).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in apart.schema.fields)
    out = chosen.mapInArrow(run, schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(table(spark, folder, "documents"))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("found"), BASE_KINDS), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
