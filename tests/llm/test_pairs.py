"""Fingerprints, near duplicates, line dedup and decontamination against brute force, and their edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.llm import decontam, fingerprints, line_dedup, neardup
from cohortis.llm.components import components
from cohortis.llm.hashing import WordHasher, shingles

SCHEMA = "doc_id long, text string, part string, id long, key long"


def texts(seed=1, n=40):
    """Documents with edited copies, exact copies, and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 120))] for _ in range(n)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for _ in range(r.randint(0, 4)):
            copy = list(words)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    return [*out, None, "", "   ", "One", "one", "two words", "A b c", "a B\tc", "x" * 200_000]


def table(spark, values, start=10):
    return spark.createDataFrame([(start + 3 * i, t, "p", 1, 2) for i, t in enumerate(values)], SCHEMA)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize(("width", "part"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, part):
    docs = table(spark, texts())
    sets = {r.doc_id: shingle_set(r.text, width) for r in docs.collect()}
    low = {i: i for i in sets}

    def root(i):
        return i if low[i] == i else root(low[i])

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= part * len(x | y):
                i, j = sorted((root(a), root(b)))
                low[j] = i
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, width, part).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Groups of many blocks give what one block gives."""
    docs = table(spark, texts(3, 12))
    want = sorted(neardup.near_duplicates(docs, 3, 85).collect())
    monkeypatch.setattr(neardup, "BLOCK", 2)
    assert sorted(neardup.near_duplicates(docs, 3, 85).collect()) == want


def test_near_duplicates_of_nothing_and_of_repeats(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []
    rows = [(1, "a b c d e f", "p", 1, 2)] * 2 + [(None, "a b c d e f", "p", 1, 2), (7, "a b c d e f", "p", 1, 2)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("1", "1", True), ("1", "1", True), ("7", "1", False), ("None", "None", True)]


def test_key_guarantee():
    """Signatures that differ in fewer than twice the chunks share a key."""
    chunks, size = neardup.layout(0.85)
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, chunks * size).astype(np.int32)
        b = a.copy()
        b[rng.choice(len(a), 2 * chunks - 1, replace=False)] ^= 1
        x, y = neardup._chunk_keys(np.stack([a, b]), chunks)
        assert (x == y).any()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (50, 50)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components(links.limit(0)).collect() == []


def test_fingerprints(spark):
    docs = table(spark, texts(2))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    prints = dict(zip((t for _, t in rows), (got[i].fingerprint for i, _ in rows)))
    for k, (i, t) in enumerate(rows):
        j, following = rows[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == prints[t]
        hashes = shingles(WordHasher()([edited.encode()])[0], 5)
        assert got[i].edited_fingerprint == fingerprints._write(hashes)
        assert got[i].near_edited == fingerprints.likeness(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == fingerprints.likeness(got[i].fingerprint, got[j].fingerprint)


def test_fingerprint_estimates(spark):
    r = random.Random(4)
    long = [f"v{r.randrange(10**6)}" for _ in range(4000)]
    a, b = " ".join(long), " ".join(long[:1000])
    got = fingerprints.sketches(spark.createDataFrame([(1, a), (2, b), (3, None)], "fingerprint long, text string"))
    assert got.columns == ["text", "fingerprint"]
    fa, fb, fn = (x.fingerprint for x in got.collect())
    assert abs(fingerprints.likeness(fa, fb) - 0.25) < 0.08 and fingerprints.containment(fb, fa) == 1.0
    assert fingerprints.retained(fingerprints.merged(fa, fb)) == fingerprints.retained(fa)
    assert fn.startswith("0-") and fingerprints.likeness(fn, fa) == 0.0


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.edited_fingerprints(table(spark, [])).collect() == []
    (one,) = fingerprints.edited_fingerprints(table(spark, ["a b c d"])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a b c"[:4] + b"a b ").hexdigest() or one.n_chars == 7
    twice = spark.createDataFrame([(5, "x y", "p", 1, 2)] * 2 + [(None, None, "p", 1, 2)], SCHEMA)
    assert len(fingerprints.edited_fingerprints(twice).collect()) == 3


def test_words_do_not_depend_on_segments(monkeypatch):
    from cohortis.llm import hashing

    text = " ".join(texts(9)[0:30]).encode() + b"  END"
    whole = WordHasher()([text, b"", b"x"])
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    parts = WordHasher()([text, b"", b"x"])
    assert [list(a) for a in whole] == [list(b) for b in parts]


def near_words(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = sorted((a, b), key=len, reverse=True)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup(spark):
    r = random.Random(8)
    lines = []
    for _ in range(30):
        words = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 14))]
        lines += [words, [w.upper() for w in words], words[:-1], words[:3] + ["new"] + words[3:], words[:2] + ["old"] + words[3:]]
    docs = []
    for _ in range(40):
        docs.append("\n".join(" " * r.randint(0, 1) + " ".join(r.choice(lines)) for _ in range(r.randint(0, 6))))
    docs += [None, "", "\n\n", "one two three\none two three"]
    seen, want = [], {}
    df = table(spark, docs)
    for row in sorted(df.collect(), key=lambda x: x.doc_id):
        kept, n = [], 0
        for line in (row.text or "").split("\n"):
            words = line.strip(" ").lower().split(" ")
            gone = words != [""] and any(words == s or (min(len(words), len(s)) >= 3 and near_words(words, s)) for s in seen)
            if words != [""]:
                seen.append(words)
            n += gone
            if not gone:
                kept.append(line)
        want[row.doc_id] = (None if row.text is None else "\n".join(kept), n)
    got = {x.doc_id: (x.text, x.n_dropped) for x in line_dedup.without_repeated_lines(df).collect()}
    assert got == want


def test_line_dedup_edges(spark):
    assert line_dedup.without_repeated_lines(table(spark, [])).collect() == []
    rows = [(None, "a b c\na b c", "p", 1, 2)] + [(4, "a b c\nd e f", "p", 1, 2)] * 2 + [(5, "A B C \nz", "p", 1, 2)]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "part", "id", "key", "n_lines", "n_dropped"]
    assert sorted((str(x.doc_id), x.text, x.n_dropped) for x in got.collect()) == [
        ("4", "a b c\nd e f", 0), ("4", "a b c\nd e f", 0), ("5", "z", 1), ("None", "a b c\na b c", 0)]


def test_line_dedup_compares_words(spark):
    """Lines equal but for the white space between their words, and lines of scripts without blanks."""
    long = "a b c d e f g h i"
    chinese, japanese, thai = "敏捷的棕色狐狸", "いろはにほへとちりぬるを", "สวัสดีครับ"
    cases = [("a b c", "a  b c", True), ("a b c", "A b c\r", True), ("a b c", "a\tb\tc", True), ("a b c", "\t a b\f c ", True),
             ("x\ty\tz", "x\ty\tz", True), (long, long.replace(" ", "  "), True), (long, long.replace(" ", "\t") + "\r", True),
             (long, long.replace("e", "E\te"), True), (long, long.replace("e f", "x\ty"), False), ("a b c", "a bc", False),
             (chinese, chinese, True), (chinese, " " + chinese + "\r", True), (chinese, chinese[2:], False), (thai, thai, True),
             (japanese, japanese.replace("と", "ど"), True), (japanese, japanese.replace("とち", "どし"), False)]
    docs = []
    for k, (first, line, _) in enumerate(cases):  # two words of their own keep the cases apart
        docs += [f"k{k} k{k} {first}\nq{k}", f"k{k} k{k} {line}\nz{k}"]
    got = sorted(line_dedup.without_repeated_lines(table(spark, docs)).collect())
    for k, (first, line, gone) in enumerate(cases):
        assert (got[2 * k].text, got[2 * k].n_dropped) == (docs[2 * k], 0)
        assert (got[2 * k + 1].text, got[2 * k + 1].n_dropped) == ((f"z{k}", 1) if gone else (docs[2 * k + 1], 0)), (first, line)


def test_line_dedup_knows_a_line_by_its_words(spark):
    """Rows that repeat a doc_id with other texts: the unrelated line at the same place stays."""
    long = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    other = "totally different line of words here standing alone in row two"
    rows = [(1, long), (5, long.replace("w4", "new")), (5, other), (7, other.replace("alone", "apart")), (8, "one"), (9, "ONE\r\n\ntwo words"), (10, "two\twords"), (11, "a b c"), (12, "a b d"), (13, "a b")]
    clash = {c: F.lit(c) for c in ("drops", "row_id", "lines", "n_lines", "n_dropped", "stop", "row", "h", "first")}
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash))
    assert got.columns == ["doc_id", "text", "drops", "row_id", "lines", "stop", "row", "h", "first", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_dropped, r.drops) for r in got.collect()) == [
        (1, long, 0, "drops"), (5, "", 1, "drops"), (5, other, 0, "drops"), (7, "", 1, "drops"), (8, "one", 0, "drops"), (9, "\ntwo words", 1, "drops"),
        (10, "", 1, "drops"), (11, "a b c", 0, "drops"), (12, "", 1, "drops"), (13, "a b", 0, "drops")]


def test_line_dedup_leaves_no_shuffles_and_asks_for_no_collection(spark):
    jvm, sc = spark._jvm, spark.sparkContext
    old = [b for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName()]

    def state():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}, sum(b.getCollectionCount() for b in old)

    docs = spark.createDataFrame([(i, f"one line of its own {i}\na line that all have\nand one that\nword {i} is other in") for i in range(20)], "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files, full = state()
    line_dedup.without_repeated_lines(docs)
    for _ in range(50):  # removal is asked for, not waited for
        if state()[0] <= files:
            break
        time.sleep(0.1)
    assert state()[0] <= files and state()[1] == full
    assert spark.conf.get(key) == sc.getConf().get(key, "false")


def test_decontamination(spark):
    r = random.Random(6)
    word = lambda: f"t{r.randrange(400)}"
    items = [[word() for _ in range(n)] for n in (30, 20, 13, 6, 1)]
    docs = []
    for k in range(60):
        words = [word() for _ in range(r.randint(0, 80))]
        item = items[k % 4]
        a = r.randrange(max(1, len(item) - 12))
        piece = list(item[a : a + r.randint(10, 16)] if len(item) > 12 else item)
        for _ in range(r.randint(0, 3)):
            piece[r.randrange(len(piece))] = word()
        at = r.randint(0, len(words))
        docs.append(", ".join([*words[:at], *piece, *words[at:]]))
    docs += [None, "", "..."]
    df = table(spark, docs)
    tests = spark.createDataFrame([(i, " ".join(t).upper(), 0) for i, t in enumerate(items)] + [(9, None, 0), (10, "", 0)], "item_id long, text string, doc_id long")
    want = set()
    for row in df.collect():
        words = re.findall(r"\w+", (row.text or "").lower())
        for i, item in enumerate(items):
            w, need = (13, 11) if len(item) >= 13 else (len(item), len(item))
            windows = [(p, sum(x == y for x, y in zip(words[p : p + w], item[q : q + w])))
                       for p in range(len(words) - w + 1) for q in range(len(item) - w + 1)]
            good = [(p, n) for p, n in windows if n >= need]
            if good:
                want.add((row.doc_id, i, min(p for p, _ in good), max(n for _, n in good)))
    assert {tuple(x) for x in decontam.overlaps(df, tests).collect()} == want and want
    clean = {x.doc_id for x in decontam.uncontaminated(df, tests).collect()}
    assert clean == {x.doc_id for x in df.collect()} - {x[0] for x in want}
    assert decontam.overlaps(df.limit(0), tests).collect() == [] == decontam.overlaps(df, tests.limit(0)).collect()


def test_masks_find_every_overlap():
    """Whichever two places of a window are replaced, one seed fits beside them."""
    from itertools import combinations

    places = [{o + p for p in m} for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1])]
    for wrong in combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(not p & set(wrong) for p in places)
