"""Sequence packing and hard-negative mining against plain versions, and their edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortis.llm import hard_negatives as h
from cohortis.llm import packing as p

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity):
    """Sequences without a gap or an overlap; how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = p.packed_documents(docs, VOCABULARY).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pieces([tuple(r) for r in docs.select("doc_id", "text").collect()], 2048)
    assert check_places(got, 2048) == -(-sum(r["length"] for r in got) // 2048)


def test_piece_edges(spark):
    odd = ["", None, "a　b\x0bc'S d's <|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ é\n ́x\t\ty", "don't 12ab c\x1cd\x85e!?", "\x01 a\x01b \x01",
           "Straße STRASSE ǅ ﬁ ＡＢ", "ab, " * 700_000, "x" * 3000, "ééé 漢字かな ไทย 😀!"]
    rows = [*enumerate(odd), (3, odd[3]), (None, "nothing known"), (5, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"len": F.lit(1), "bucket": F.lit(2), "length": F.lit("x")})
    got = p.packed_documents(docs, VOCABULARY, 64)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_pieces(rows, 64)
    assert p.packed_documents(docs.limit(0), VOCABULARY).collect() == []
    ids = p.pieces(docs, VOCABULARY, 64, with_ids=True).where("doc_id = 4").collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in ids)


def test_encoder_learns_a_word_once_in_all_its_forms(monkeypatch):
    learnt, given = [], []
    words, others = p.Encoder.whole_words, p.Encoder.others
    monkeypatch.setattr(p.Encoder, "whole_words", lambda self, w: (learnt.extend(w), words(self, w))[1])
    monkeypatch.setattr(p.Encoder, "others", lambda self, r: (given.extend(r), others(self, r))[1])
    encode = p.Encoder(VOCABULARY)
    learnt.clear(), given.clear()
    texts = ["Été été. été&&& ÉTÉ*** word word-word WORD!? word$$$ it's", "Word) été\n\tword'"]
    got = [*encode(texts), *encode(texts[::-1])]
    assert sorted(learnt) == ["word", "été"]
    assert sorted(given) == sorted(["", ".", "&&&", "***", "!?", "$$$", ")", "'", "word-word", "it's"])
    whole = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert got == whole + whole[::-1]


def test_encoder_in_small_steps(monkeypatch):
    """Any characters, with texts over the step, memories that are cleared and runs that are not remembered."""
    rng = random.Random(4)
    latin = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    odd = [*map(chr, range(128)), "\x85", "\xa0", "　", "\u0301", "Σ", "ς", "ﬁ", "漢", "ไ", "😀", "\u212a", "<|endoftext|>", "'s", "'RE", "’"]
    texts = ["".join(rng.choices([*latin, *odd, *" " * 100], k=n)) for n in (1, 10, 200, 201, 450, 2000) for _ in range(20)]
    texts += [f"A{c}b! {c}{s}" for c in latin for s in ("", ".", "'s", "&&&", "\u0301")] + ["", " ", "\n"]
    encode = p.Encoder(VOCABULARY)
    whole = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(encode([*texts, None])) == [*whole, b""] and list(encode([])) == []
    for name, value in {"GROUP": 200, "TOGETHER": 7, "JOINED": 30, "CACHED": 50, "LONG": 10}.items():
        monkeypatch.setattr(p, name, value)
    assert list(encode(texts)) == whole and max(map(len, encode.words)) <= 10
    encode.lower = False
    assert list(encode(texts)) == whole


def test_pack_any_columns(spark):
    parts = spark.createDataFrame([(n % 7 + 1, f"r{n}") for n in range(200)], "length int, rank string").withColumns({c: F.lit(c) for c in ("own", "n", "row", "sequence_id", "first")})
    got = p.pack(parts, 10).collect()
    assert check_places(got, 10) == -(-sum(r["length"] for r in got) // 10) and {r["rank"] for r in got} == {f"r{n}" for n in range(200)}
    for bad in (0, 11, None):
        with pytest.raises(Exception, match="tokens"):
            p.pack(spark.createDataFrame([(bad,)], "length int"), 10).collect()


def least_bins(items, capacity):
    """Fewest bins by trying everything."""
    best = len(items)
    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= items[k] and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, capacity - items[k]])
    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(2)
    worse = 0
    for _ in range(150):
        capacity = rng.choice([12, 30, 100])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        found = p.Completion(dict(Counter(items)), capacity).solve()
        used = Counter()
        for filling, times in found:
            assert sum(x * m for x, m in filling) <= capacity
            for x, m in filling:
                used[x] += m * times
        assert used == Counter(items)
        worse += sum(n for _, n in found) > least_bins(items, capacity)
    assert worse == 0


def test_bin_completion_beats_best_fit():
    search = p.Completion(dict(Counter(random.Random(1).choices(range(300, 1500), k=50_000))), 2048)
    first = search.bins
    assert sum(n for _, n in search.solve()) < first


def test_hilbert_curve():
    for dims, bits in ((1, 4), (2, 4), (3, 3)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = h.hilbert(points, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours in space


def plain_negatives(rows, k=5):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            kept[(i, label, tuple(int(np.floor(256 * x)) for x in v))] = None
    kept, out = list(kept), []
    width = max((len(v) for _, _, v in kept), default=0)
    m = np.array([[*v, *[0] * (width - len(v))] for _, _, v in kept], dtype=np.int64).reshape(len(kept), width)
    for (i, label, _), a in zip(kept, m):
        if i % 100:
            continue
        scores = (m @ a).tolist()
        ranked = sorted(range(len(kept)), key=lambda j: (-scores[j], kept[j][0]))
        for j in [j for j in ranked if kept[j][1] == label and kept[j][0] != i][:k]:
            s = scores[j]
            hits = [n for n in ranked if kept[n][1] != label and 80 * s <= 100 * scores[n] <= 100 * s][:k]
            out += [(i, kept[j][0], rank, kept[n][0], s, scores[n]) for rank, n in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 4096])
def test_mined_table(spark, monkeypatch, block):
    monkeypatch.setattr(h, "BLOCK", block)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(tuple(r) for r in h.mined(table).collect())
    assert got == plain_negatives([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]) and got


def test_mined_clusters_skip_blocks(spark, monkeypatch):
    """Tight clusters: the bounds leave most blocks unread, and the result stays exact."""
    monkeypatch.setattr(h, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.05 * rng.normal(size=8)], int(rng.integers(3))) for i in range(2400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    stored = [tuple(r) for r in table.collect()]
    assert sorted(tuple(r) for r in h.mined(table).collect()) == plain_negatives(stored)
    q = h.quantised(table)
    index = h.build_index(q)
    asks = q.where("vec_id % 100 = 0").withColumns({"ask": F.col("vec_id"), "same": F.lit(1), "w_lo": F.array(F.lit(40_000).cast("long")), "w_hi": F.array(F.lit(10**9).cast("long"))})
    assert h._bounds(asks, index.zones).count() < 0.6 * 24 * index.zones.count()


def test_mining_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [0.5], 1), (1, [1.0, 0.25], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, None, 2), (5, [1.0, None], 2),
            (6, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (10, [], 3), (14, [1.0, 0.5], 0), (200, [-1.0, -1.0], 2), (300, [1e6, 3e6], 4), (301, [1e6, 3e6], 4), (302, [9e5, 3e6], 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(c) for c in ("block", "ask", "vec", "cell", "curve")})
    assert sorted(tuple(r) for r in h.mined(table).collect()) == plain_negatives(rows)
    assert h.mined(table.limit(0)).collect() == []
    assert h.mined(table.where("vec_id = 4")).collect() == []
