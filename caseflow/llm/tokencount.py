"""Token counts of a piece vocabulary by rank-synchronous merging of ragged arrays.

A block's distinct pre-tokens are one ragged array of symbols. In every round each sequence applies its lowest-ranked
pair, all sequences at once; ranks are looked up again only beside merged symbols, and finished sequences leave the
array. The symbols that survive are counted. Where a merge makes a pair that ranks no higher than the one just
applied (runs of white space do), the sequence is merged alone by the plain rule.

No piece holds a space mark after another character, so texts can be cut before each run of marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.merging import NEVER, Numbers, Pairs, leftmost
from caseflow.llm.shared import table, text_blocks, texts_of

BLOCK_BYTES = 6 << 20
LIMIT = 4096
#: The mark that stands for a space in pieces.
MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """Pieces by score and the length in tokens of every character that is no piece (its UTF-8 bytes)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids}, reverse=True))}
        pieces = {model.id_to_piece(i): n for n, i in enumerate(ids)}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        self.pairs = Pairs(pieces, [scores[model.get_score(i)] for i in ids])
        self.none = len(pieces)
        self.char = np.full(0x110000, self.none, np.int32)
        for piece, n in pieces.items():
            if len(piece) == 1:
                self.char[ord(piece)] = n

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.char[points]
        width = np.where(symbol == self.none, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
        starts = np.cumsum(sizes) - sizes
        unknown = np.add.reduceat(width - 1, starts) if len(width) else np.zeros(len(words), np.int64)
        out = np.zeros(len(words), np.int64)
        word = np.arange(len(words))
        rank, whole = self._pairs(symbol, starts)
        alone: list[np.ndarray] = []
        size = sizes
        while len(word):
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                out[word[over]] = size[over]
                stay = np.repeat(~over, size)
                symbol, rank, whole = symbol[stay], rank[stay], whole[stay]
                word, size, least = word[~over], size[~over], least[~over]
                starts = np.cumsum(size) - size
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[leftmost(np.concatenate([[False], at[1:] == at[:-1] + 1]))]
            symbol[at] = whole[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            lost = np.add.reduceat(~stay, starts)
            moved = np.cumsum(stay) - 1
            symbol, rank, whole = symbol[stay], rank[stay], whole[stay]
            size = size - lost
            starts = np.cumsum(size) - size
            last = np.zeros(len(symbol) + 1, bool)
            last[starts + size - 1] = True
            here = moved[at]
            begins = np.zeros(len(symbol), bool)
            begins[starts] = True
            touched = np.concatenate([here, here[~begins[here]] - 1])
            rank[touched] = NEVER
            touched = touched[~last[touched]]
            rank[touched], whole[touched] = self.pairs.find(symbol[touched], symbol[touched + 1])
            of = np.searchsorted(starts, touched, "right") - 1
            odd = of[rank[touched] <= least[of]]
            if len(odd):
                odd = np.unique(odd)
                alone.append(word[odd])
                stay = np.ones(len(word), bool)
                stay[odd] = False
                keep = np.repeat(stay, size)
                symbol, rank, whole = symbol[keep], rank[keep], whole[keep]
                word, size = word[stay], size[stay]
                starts = np.cumsum(size) - size
        begin = np.cumsum(sizes) - sizes
        for i in np.concatenate(alone).tolist() if alone else []:
            out[i] = len(self.pairs.merge_one(self.char[points[begin[i] : begin[i] + sizes[i]]].tolist()))
        return out + unknown

    def _pairs(self, symbol: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, whole = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int32)
        inner = np.ones(len(symbol), bool)
        inner[starts[1:] - 1] = False
        inner[-1:] = False
        at = np.flatnonzero(inner)
        rank[at], whole[at] = self.pairs.find(symbol[at], symbol[at + 1])
        return rank, whole

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a mark goes before every text that is not empty."""
        number = Numbers()
        found = []
        for text in texts:
            marked = text.replace(" ", MARK)
            if not text:
                found.append([])
            elif MARK + MARK in marked or marked[0] == MARK:
                found.append([number[m[1:]] for m in RUNS.findall(MARK + marked)])
            else:
                found.append(list(map(number.__getitem__, marked.split(MARK))))
        if not number:
            return np.zeros(len(texts), np.int64)
        counts = self.count([MARK + w for w in number])
        return np.array([int(counts[x].sum()) if x else 0 for x in found], np.int64)


def count_tokens(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs`` (``doc_id``, ``text``); null and empty texts have none."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, block_bytes):
            text = block.column("text").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks(), pa.compute.binary_length(text).cast(pa.int64()), pa.array(pieces.value.tokens(text.to_pylist()), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op6_tokencount(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
