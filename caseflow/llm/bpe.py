"""Byte-level BPE encoding and decoding by merge replay over a corpus of distinct words.

A task cuts its texts into blocks; the distinct pre-tokens of a block form a corpus laid out as one array of symbols.
An inverted index takes a rank to the positions of the pairs that merge at that rank. Merges are replayed in rank
order: each applies to all its positions in all words at once, and only the pairs with the new symbol's neighbours are
looked up again and entered in the index under their rank. A word whose new pair has a rank below the one being
replayed (vocabularies can hold such pieces) is merged alone by the plain rule instead.

Texts are independent, so nothing is shuffled; one key holding many rows makes no difference.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.merging import NEVER, PART, Numbers, Pairs, leftmost
from caseflow.llm.shared import ragged, table, text_blocks, texts_of

BLOCK_BYTES = 6 << 20


class Ranks:
    """A vocabulary of byte strings by rank and the pattern that cuts texts into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = pattern
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.pairs = Pairs(self.rank, list(range(size)))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        total = len(symbol)
        place = np.int32 if total < 1 << 31 else np.int64
        starts = np.cumsum(sizes) - sizes
        after, before = np.arange(1, total + 1, dtype=place), np.arange(-1, total - 1, dtype=place)
        after[starts + sizes - 1] = -1
        before[starts] = -1
        rank = np.full(total, NEVER)
        index: list[list | None] = [None] * len(self.token)
        for i in range(0, total, 4 * PART):
            inner = np.flatnonzero(after[i : i + 4 * PART] >= 0).astype(place) + place(i)
            rank[inner], _ = self.pairs.find(symbol[inner], symbol[inner + 1])
            self._enter(index, inner, rank[inner])
        alone = np.zeros(len(words), bool)
        for now, held in enumerate(index):
            if held is None:
                continue
            at = np.unique(np.concatenate(held))
            index[now] = None
            at = at[rank[at] == now]
            if not len(at):
                continue
            at = at[leftmost(np.concatenate([[False], after[at[:-1]] == at[1:]]))]
            gone = after[at]
            symbol[at] = now
            rank[gone] = NEVER
            beyond = after[gone]
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            symbol[gone] = -1
            earlier = before[at]
            rank[at[beyond < 0]] = NEVER
            touched = np.concatenate([at[beyond >= 0], earlier[earlier >= 0]])
            if not len(touched):
                continue
            rank[touched], _ = self.pairs.find(symbol[touched], symbol[after[touched]])
            low = rank[touched] < now
            if low.any():
                alone[np.searchsorted(starts, touched[low], "right") - 1] = True
                touched = touched[~low]
            self._enter(index, touched, rank[touched])
        left = symbol >= 0
        counts = np.add.reduceat(left, starts).astype(np.int64) if total else sizes
        ids = symbol[left]
        if alone.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(alone):
                parts[i] = np.array(self.pairs.merge_one(self.byte[np.frombuffer(words[i], np.uint8)].tolist()), np.int32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    @staticmethod
    def _enter(index: list, at: np.ndarray, rank: np.ndarray) -> None:
        some = rank != NEVER
        at, rank = at[some], rank[some]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        edges = [0, *cuts.tolist(), len(rank)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                r = int(rank[a])
                if index[r] is None:
                    index[r] = [at[a:b]]
                else:
                    index[r].append(at[a:b])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        cut, number = regex.compile(self.pattern).findall, Numbers()
        found = [np.fromiter(map(number.__getitem__, cut(t)), np.int32) for t in texts]
        words = [w.encode() for w in number]
        known = np.array([self.rank.get(w, -1) for w in words], np.int32)
        ids, counts = known.copy(), np.ones(len(words), np.int64)
        rest = np.flatnonzero(known < 0)
        if len(rest):
            merged, sizes = self.merge([words[i] for i in rest])
            counts[rest] = sizes
            ids = np.zeros(int(counts.sum()), np.int32)
            first = np.cumsum(counts) - counts
            whole = np.flatnonzero(known >= 0)
            ids[first[whole]] = known[whole]
            ids[ragged(first[rest], sizes)] = merged
        first = np.cumsum(counts) - counts
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        per_text = np.array([len(x) for x in found], np.int64)
        del found, number, words
        tokens, some = np.zeros(len(texts), np.int64), per_text > 0
        if some.any():
            tokens[some] = np.add.reduceat(counts.astype(np.int32)[flat], (np.cumsum(per_text) - per_text)[some], dtype=np.int64)
        parts = [ids[ragged(first[own], counts[own])] for own in (flat[i : i + PART] for i in range(0, len(flat), PART))]
        return np.concatenate(parts) if parts else ids, tokens

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` for every row of ``docs`` (``doc_id``, ``text``).

    ``ids`` are little-endian unsigned 32-bit integers as binary, ``decoded`` the bytes that the ids stand for. Null
    and empty texts have no tokens. No special token is recognised. Repeated rows each get their row.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(path, pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks.value
        for block in text_blocks(batches, block_bytes):
            flat, counts = vocabulary.encode(block.column("text").to_pylist())
            parts = np.split(flat, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").combine_chunks(), pa.array(counts, pa.int64()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()),
                    pa.array([vocabulary.decode(p) for p in parts], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def encode_back(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    found = encode_decode(docs, path, pattern)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return encode_back(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
