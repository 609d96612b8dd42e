"""Divergence audit, collocations and packing against plain versions of their contracts."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from caseflow.llm import collocations, divergence, packing

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, item string, value bigint, `left` int"
ODD = [None, "", " ", "\n\t ", "Wort", "Zwei Wörter-zwei", "a" * 5000, "12345 678", "né\x1cà b\xa0c", "日本語 テキスト 🤣🤣", "x" * 300_000 + " end", "the The THE of 1the"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(spark, seed=3, n=160):
    """Odd texts, nulls in every column, a repeated row, a hot source and language, columns that clash with the operators' own."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(14)] + ["Été", "été", "the", "The"]
    rows = [(i, t, "en", "s", "x", "x", 1, 1) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "the the the", None, None, None, None, None, None), (40, None, None, "s", None, None, None, None), (41, "lone", "fr", "", None, None, None, None)]
    rows += [(42, None, "xx", "a", None, None, None, None), (43, "", "xx", "b", None, None, None, None)]
    for i in range(n):
        text = "".join(rng.choice(words[: 4 + i % 15]) + rng.choice([" ", " ", " ", "  ", ", ", "\t"]) for _ in range(rng.randint(0, 40)))
        rows.append((100 + i, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["s", "s", "s", "t", "u", None, "v"]), "x", "x", 1, 1))
    return spark.createDataFrame(rows, SCHEMA)


def plain_divergence(rows, min_docs, top):
    total, docs, own, sources = Counter(), Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))
        sources[lang].add(source)
        for w in found:
            total[lang, w] += 1
            own[lang, source, w] += 1
        docs.update((lang, w) for w in set(found))
    out = []
    for lang, names in sources.items():
        kept = [w for la, w in total if la == lang and docs[la, w] >= min_docs]

        def share(count):
            n = sum(count(w) for w in kept)
            return {w: 1 + 1_000_000_000 * (count(w) + 5) // (n + 5 * len(kept)) for w in kept}

        of = {s: share(lambda w, s=s: own[lang, s, w]) for s in names}
        whole = share(lambda w: total[lang, w])
        for s in names:
            pairs = sorted((-sum(abs(of[s][w] - of[o][w]) for w in kept), o.encode(), o) for o in names if o != s)
            terms = sorted((whole[w] - of[s][w], w.encode(), w) for w in kept if own[lang, s, w] and of[s][w] > whole[w])[:top]
            out += [(lang, s, part, w, -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, _, w) in enumerate(found)]
    return sorted(out)


def test_divergence(spark):
    df = corpus(spark)
    rows = [(r["text"] or "", r["lang"] or "", r["source"] or "") for r in df.collect()]
    for min_docs, top, shards, block in ((30, 50, None, 64 << 20), (2, 3, 5, 2000), (1, 50, 1, 1)):
        want = plain_divergence(rows, min_docs, top)
        got = divergence.source_divergence(df.repartition(7), min_docs, top, shards, block)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    assert any(r[0] == "xx" and r[4] == 0 for r in want)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_pair_corrections_leave_the_task_in_parts(spark):
    rng = random.Random(1)
    rows = [("en", f"t{t}", f"s{s}", rng.randint(5, 99), 4) for t in range(30) for s in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "lang string, term string, source string, p bigint, p0 bigint")
    want = Counter()
    by_term = defaultdict(list)
    for _, t, s, p, _ in rows:
        by_term[t].append((s, p))
    for found in by_term.values():
        for i, (a, p) in enumerate(sorted(found)):
            for b, q in sorted(found)[i + 1 :]:
                want[a, b] += abs(p - q) - (p - 4) - (q - 4)
    for held in (1, 7, 1 << 20):
        got = Counter()
        for r in divergence.pair_corrections(df, held).collect():
            got[r["source"], r["item"]] += r["value"]
        assert got == want


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    odd = ["<|endoftext|> x <|endoftext|>", "\xa0\xa0 a\x85b", " " * 5000 + "z", "\n" * 2000, "l'été c'est «ça» don't 12½ ", "x\x1c\x1d y", "word " * 9000, "ab1" * 4000]
    df = corpus(spark).unionByName(spark.createDataFrame([(500 + i, t, "en", "s", "x", "x", 1, 1) for i, t in enumerate(odd)], SCHEMA))
    capacity = 128
    want = Counter()
    for r in df.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r["doc_id"], n, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    total = sum(k[3] * n for k, n in want.items())
    for settings in ({}, {"island": 40, "population": 3, "generations": 3}):
        rows = packing.pack_documents(df, path, public_tokenizers.PATTERN, capacity, **settings).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for found in sequences.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) <= -(-total // capacity) + 1
    assert packing.pack_documents(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_texts_that_go_to_the_library():
    texts = ["plain é", "\xa0", "日", " " * 999, " " * 1000, "a" + " " * 600, " " * 600 + "b", "", None, "c"]
    assert packing.Encoder.plain_texts(pa.chunked_array([texts])).tolist() == [True, False, False, False, False, False, False, True, True, True]
    assert packing.Encoder.plain_texts(pa.chunked_array([["x", " " * 999, "y", "z" + "\n" * 1000]])).tolist() == [True, True, True, False]


def test_island_operators():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 300)
    island = packing.Island(lengths, 100, 1)
    a, b = island.fresh(0), island.fresh(0.5)
    donated = island.well_filled(b)
    child = island.inject(a.copy(), donated)
    for bins in (a, b, child, island.mutate(child)):
        assert np.bincount(bins, lengths).max() <= 100
        assert len(bins) == 300
    for pieces in donated:  # injected bins are whole and have no other piece
        assert set(np.flatnonzero(child == child[pieces[0]])) >= set(pieces)
    patterns = [sorted(lengths[m].tolist()) for m in donated]
    assert [sorted(lengths[m].tolist()) for m in island.filled_from(patterns)] == patterns
    assert island.filled_from([[100]]) == []
    best = island.evolve([], patterns, 4, 10)[0]
    assert island.worth(best) <= island.worth(a)


def test_bins_are_measured_once_per_choice(monkeypatch):
    """What all bins are compared with is not computed again for each of them."""
    calls, median = [], np.median
    monkeypatch.setattr(np, "median", lambda x: calls.append(1) or median(x))
    island = packing.Island(np.random.default_rng(1).integers(1, 100, 500), 100, 1)
    bins = island.fresh(0.5)
    fuller = median(island.fills(bins))
    chosen = island.well_filled(bins)
    assert len(calls) == 1 and chosen and all(island.lengths[m].sum() >= fuller for m in chosen)


def test_bins_of_large_pieces(spark):
    """No two pieces fit together: every piece stays alone, however often it is dealt."""
    df = spark.range(300).selectExpr("id as unit", "60 as length")
    rows = packing.pack(df, 100, island=50).collect()
    assert len({r["sequence_id"] for r in rows}) == 300 and all(r["offset"] == 0 for r in rows)


def plain_collocations(rows, min_count, most_words, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        kept = [p for p, c in count.items() if len(p) > 1 and c >= min_count]
        inside = {q[i:j] for q in kept for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and count[q] >= count[q[i:j]]}
        scored = []
        for p in kept:
            if p in inside:
                continue
            score, k = min((1000 * count[p] * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_collocations(spark):
    df = corpus(spark, 8, 220)
    rows = [(r["text"] or "", r["lang"] or "und") for r in df.collect()]
    for min_count, top, block, phrases in ((8, 2000, 8 << 20, 2_000_000), (3, 15, 3000, 200), (100, 10, 1, 5)):
        want = plain_collocations(rows, min_count, 5, top)
        got = collocations.collocations(df.repartition(5), min_count, 5, top, block, phrases)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == want
    assert collocations.collocations(df.limit(0)).count() == 0


def test_trie():
    rng = np.random.default_rng(5)
    for words in (3, 300, 70_000):
        text = rng.integers(0, words + 1, 4000).astype(np.int32) if words < 1000 else np.concatenate([rng.integers(1, words + 1, 40)] * 30).astype(np.int32)
        grams = {tuple(text[i : i + k].tolist()) for k in (2, 3, 4) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all()}
        some = {g for i, g in enumerate(sorted(grams)) if i % 3}
        some = {g[:k] for g in some for k in range(2, len(g) + 1)}
        phrases = np.array([list(g) + [0] * (5 - len(g)) for g in sorted(some)], np.int32)
        trie = collocations.Trie(phrases, words)
        for k, (at, state) in enumerate(trie.walk(text, 5), 1):
            found = {i for i in range(len(text) - k + 1) if tuple(text[i : i + k].tolist()) in some}
            if k > 1:
                assert set(at.tolist()) == found
                assert all(tuple(phrases[n][:k].tolist()) == tuple(text[i : i + k].tolist()) for i, n in zip(at.tolist(), trie.number[state].tolist()))
