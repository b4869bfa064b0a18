"""Best-fit packing: token pieces into sequences of a fixed length, by bin completion over counts of piece lengths."""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .shared import small

CAPACITY = 2048  # tokens in a sequence
END = (0).to_bytes(4, "little")  # the id that closes a document
CACHED = 1_200_000  # words and other runs whose ids a worker remembers
LONG = 100  # characters of a run beyond which it is not remembered
GROUP = 1 << 22  # bytes of text split at once; bounds the memory of one step, not the length of a text
TOGETHER, JOINED = 5_000, 1 << 20  # new runs encoded at once, and their characters
BETWEEN = "\x01"
LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"  # Latin ones that are composed and have one letter in lower case
STOPS = "!-/:-@\\[-`{-~"  # a class of a regular expression: neither letters nor digits
PROBES = ("a", "the", "sequence", "qzxjv", "été", "straße", "über", "łódź")  # words on which an encoder tries whether words and stops can be told apart
WIDTH = 6  # fillings tried at a node
STEPS = 4_000  # partial fillings looked at per node
NODES = 20_000  # nodes of the search after which the incumbent stands
BUCKET = 250_000  # pieces ranked together, about

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    No token of the vocabularies that this is made for reaches over white space, so the ids of a text are those of its
    runs between blanks, tabs and line feeds. The distinct runs of many texts are taken together. Latin words, with or
    without stops behind them, are the ids of the word in lower case and those of the stops (where the vocabulary does
    not tell capitals apart and is over bytes); words come back in every text, their ids are remembered. Other
    runs are encoded as they are, many together with a control character between them, and remembered too.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}
        mark = self.encoded(BETWEEN)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.words: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, the others follow
        self.bytes = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.lower = not any(re.fullmatch(f"{LETTERS}*[{STOPS}]*", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.lower:
            self.whole_words(list(PROBES))
            stops = ["", "?!", *re.findall(f"[{STOPS}]", "".join(map(chr, range(128))))]
            self.lower = all(self.encoded(w.title() + s).tobytes() == self.words[w] + self.encoded(s).tobytes() for w in PROBES for s in stops)
        self.words.clear()

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def whole_words(self, words: list[str]) -> None:
        """Learn lower-cased words: the vocabulary's normaliser and splitter leave them as they are."""
        tokens = self.tokenizer.model.tokenize
        for w in words:
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes)
            self.words[w] = b"".join([t.id.to_bytes(4, "little") for t in tokens(spelt)])

    def others(self, runs: list[str]) -> None:
        """Learn runs as they are."""
        at = 0
        while at < len(runs):
            past, size = at + 1, len(runs[at])
            while past < min(len(runs), at + TOGETHER) and (size := size + len(runs[past])) <= JOINED:
                past += 1
            some = [r for r in runs[at:past] if BETWEEN not in r]
            if self.mark is not None and some:
                ids = self.encoded(f" {BETWEEN} ".join(some))
                ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
                if len(ends) == len(some):
                    raw, last = ids.tobytes(), -4
                    for r, end in zip(some, ends):
                        self.known[r] = raw[last + 4 : 4 * end]
                        last = 4 * end
            for r in runs[at:past]:
                if r not in self.known:
                    self.known[r] = self.encoded(r).tobytes()
            at = past

    def looked_up(self, strings: pa.Array, memory: dict[str, bytes], learn: Callable[[list[str]], None]) -> pa.Array:
        """The ids of each string, from ``memory`` where it has them; null where the string is null."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(memory.get, distinct))
        missing = [k for k, found in enumerate(ids) if found is None]
        learn([distinct[k] for k in missing])
        for k in missing:
            s = distinct[k]
            ids[k] = memory[s] if len(s) <= LONG else memory.pop(s)
        return pa.array(ids, pa.large_binary()).take(coded.indices)

    def group(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that together are about ``GROUP`` bytes."""
        if len(self.known) + len(self.words) > CACHED:
            self.known.clear()
            self.words.clear()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.values.dictionary_encode()
        runs = coded.dictionary
        if self.lower:
            parts = pc.extract_regex(runs, f"^(?P<word>{LETTERS}+)(?P<stops>[{STOPS}]*)$")
            whole = parts.is_null()
            words, stops = (pc.if_else(whole, None, parts.field(k)) for k in range(2))
            ids = pc.binary_join_element_wise(
                self.looked_up(pc.utf8_lower(words), self.words, self.whole_words),
                self.looked_up(stops, self.known, self.others),
                pa.scalar(b"", pa.large_binary()),
            )
            ids = pc.coalesce(ids, self.looked_up(pc.if_else(whole, runs, None), self.known, self.others))
        else:
            ids = self.looked_up(runs, self.known, self.others)
        ids = ids.take(coded.indices)
        _, offsets, raw = ids.buffers()
        past = np.frombuffer(offsets, dtype=np.int64)[split.offsets.to_numpy()].tolist()
        held = memoryview(raw or b"")
        return [bytes(held[i:j]) for i, j in zip(past, past[1:])]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            width = len(text.encode())
            if held and size + width > GROUP:
                yield from self.group(held)
                held, size = [], 0
            if width > GROUP:
                yield b"".join(self.group([slice_])[0] for slice_ in self.slices(text))
                continue
            held.append(text)
            size += width
        yield from self.group(held)

    def slices(self, text: str) -> Iterator[str]:
        """A long text cut before blanks and line feeds."""
        at = 0
        while at < len(text):
            ends = [e for e in (text.find(c, at + GROUP // 4) for c in " \n\t") if e >= 0]
            end = min(ends, default=len(text))
            yield text[at:end]
            at = end


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process: tasks that run in it one after another share what it remembers."""
    state = sys.modules.setdefault("_token_encoders", ModuleType("_token_encoders"))
    if vocabulary not in state.__dict__:
        state.__dict__[vocabulary] = Encoder(vocabulary)
    return state.__dict__[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document: its ids and id 0, cut where they exceed a sequence.

    With ``with_ids`` the ids of the piece follow as ``ids`` (little-endian unsigned 32-bit). Null and empty texts are
    id 0 alone; every row gives pieces, repeated rows and null ids too; other columns are not read.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator) -> Iterator:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            cols = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


Filling = tuple[tuple[int, int], ...]  # (length, how many) of what shares a sequence


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: fillings with the number of sequences filled so."""
    space: dict[int, list[list]] = {}
    free: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in space:
            space[room] = []
            insort(free, room)
        space[room].append([filling, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(free, length)
            if k == len(free):
                room, filling, n = capacity, (), left
            else:
                room = free[k]
                filling, n = space[room].pop()
                if not space[room]:
                    del space[room], free[k]
            q = min(room // length, left)
            use = min(n, left // q)
            put(room - q * length, (*filling, (length, q)), use)
            left -= use * q
            if room < capacity and use < n:
                put(room, filling, n - use)
    return [(f, n) for fillings in space.values() for f, n in fillings]


class Completion:
    """Bin completion: fill the sequence of the largest length left, branch over undominated fillings, bound by waste."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.counts = {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.counts)
        self.total = sum(k * n for k, n in self.counts.items())
        large = sum(n for k, n in self.counts.items() if 2 * k > capacity)
        self.lower = max(-(-self.total // capacity), large)
        self.best = best_fit(self.counts, capacity)
        self.bins = sum(n for _, n in self.best)

    def take(self, filling: Filling, times: int) -> None:
        for length, m in filling:
            left = self.counts[length] - m * times
            self.counts[length] = left
            if left == 0:
                del self.lengths[bisect_left(self.lengths, length)]
            elif left == m * -times:  # given back to none
                insort(self.lengths, length)

    def dominated(self, largest: int, chosen: tuple[int, ...], waste: int) -> bool:
        """Whether a length that is left can stand for one or two of the chosen ones and use more of the space."""
        kinds = set(chosen)
        two = {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
        for low, least in [(x, x + 1) for x in kinds] + [(s, s) for s in two]:
            k = bisect_right(self.lengths, min(low + waste, largest)) - 1
            if k >= 0 and self.lengths[k] >= least and (self.lengths[k] not in kinds or self.lengths[k] == low):
                return True
        return False

    def fillings(self) -> list[tuple[int, Filling]]:
        """``(waste, filling)`` around the largest length: first those that waste least, then those of few pieces."""
        largest = self.lengths[-1]
        room = self.capacity - largest
        left = dict(self.counts)
        left[largest] -= 1
        found: dict[tuple[int, ...], int] = {}
        exact = steps = 0

        def below(limit: int) -> Iterator[int]:
            k = bisect_right(self.lengths, limit) - 1
            while k >= 0:
                if left[self.lengths[k]] > 0:
                    yield self.lengths[k]
                k -= 1

        def close(chosen: tuple[int, ...], space: int) -> None:
            """Best fit for the space that is left."""
            nonlocal exact, steps
            taken: list[int] = []
            while space and (x := next(below(min(space, (*chosen, *taken, largest)[-1] if chosen or taken else space)), None)):
                taken.append(x)
                left[x] -= 1
                space -= x
                steps += 1
            for x in taken:
                left[x] += 1
            found[(*chosen, *taken)] = space
            exact += space == 0

        def choose(chosen: tuple[int, ...], space: int, more: int) -> None:
            nonlocal steps
            if not more:
                return close(chosen, space)
            for x in below(min(space, chosen[-1] if chosen else space)):
                if steps > STEPS or exact >= WIDTH or x * (more + 1) < space and found and more > 1:
                    break
                steps += 1
                left[x] -= 1
                choose((*chosen, x), space - x, more - 1)
                left[x] += 1

        for free in range(4):
            choose((), room, free)
            if exact >= (1 if free == 0 else WIDTH) or steps > STEPS:
                break
        ranked = sorted(found.items(), key=lambda f: (f[1], len(f[0]), [-x for x in f[0]]))
        out: list[tuple[int, Filling]] = []
        for chosen, waste in ranked:
            if len(out) == WIDTH:
                break
            if out and self.dominated(largest, chosen, waste):
                continue
            whole = (largest, *chosen)
            out.append((waste, tuple((x, whole.count(x)) for x in dict.fromkeys(whole))))
        return out

    def solve(self) -> list[tuple[Filling, int]]:
        """The best packing found; optimal if it meets the lower bound or the search ends."""
        if self.bins == self.lower or not self.lengths:
            return self.best
        path: list[tuple[Filling, int]] = []
        used = waste = nodes = 0
        open_nodes: list[Iterator] = [iter(self.fillings())]
        while open_nodes and nodes < NODES and self.bins > self.lower:
            step = next(open_nodes[-1], None)
            allowed = (self.bins - 1) * self.capacity - self.total
            if step is None:
                open_nodes.pop()
                if path:
                    filling, times = path.pop()
                    self.take(filling, -times)
                    used -= times
                    waste -= times * (self.capacity - sum(x * m for x, m in filling))
                continue
            lost, filling = step
            times = min(self.counts[x] // m for x, m in filling)
            if lost:  # no more of these than the bound has room for, one at least
                times = max(1, min(times, (allowed - waste) // lost))
            if waste + times * lost > allowed:
                continue
            nodes += 1
            self.take(filling, times)
            path.append((filling, times))
            used, waste = used + times, waste + times * lost
            if self.lengths:
                open_nodes.append(iter(self.fillings()))
                continue
            if used < self.bins:
                self.best, self.bins = list(path), used
            open_nodes.append(iter(()))
        return self.best


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first, past, sequence, offset, share)``: the pieces of a length ranked ``first`` to ``past`` - 1 go to

    sequence ``sequence + (rank - first) div share``, at ``offset + (rank - first) mod share * length``.
    """
    out = []
    given = dict.fromkeys(counts, 0)
    sequence = 0
    for filling, times in Completion(counts, capacity).solve():
        offset = 0
        for length, m in filling:
            out.append((length, given[length], given[length] + m * times, sequence, offset, m))
            given[length] += m * times
            offset += m * length
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: its rows, of 1 to ``capacity`` tokens (``length``), in few sequences.

    Only counts by length, ``capacity`` rows at most, are searched (:class:`Completion`), in one task, whatever the
    number of rows; rows of a length are interchangeable and take its places by rank. A rank is counted within buckets
    of rows, so that a very common length is no single task's. Rows that are null, below 1 or over ``capacity`` in
    ``length`` raise an error. Columns called ``sequence_id`` and ``offset`` are replaced, all others stay; an empty
    table stays empty. ``parts`` is read more than once: cut it before if it is dear.
    """
    kept = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    rows = parts.select(F.struct(*kept).alias("row"), F.col("length").cast("long").alias("len"))
    fits = F.col("len").between(1, capacity)
    rows = rows.withColumn("len", F.when(fits, F.col("len")).otherwise(F.raise_error(F.lit("a piece must hold 1 to capacity tokens"))))
    buckets = max(32, -(-rows.count() // BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.to_json("row")), F.lit(buckets)))
    counts = cut(rows.groupBy("len", "bucket").agg(F.count("*").alias("n")))

    def search(batches: Iterator) -> Iterator:
        held: dict[int, int] = {}
        for batch in batches:
            held.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        found = slots(held, capacity) if held else []
        cols = zip(*found) if found else [[] for _ in range(6)]
        names = ["len", "first", "past", "sequence", "at", "share"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names)

    lengths = counts.groupBy("len").agg(F.sum("n").alias("n")).coalesce(1)
    plan = cut(lengths.mapInArrow(search, "len long, first long, past long, sequence long, at long, share long"))
    upto = Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("len", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("len", "bucket").orderBy(F.xxhash64("row")))
    ranked = rows.withColumn("own", own).join(small(before), ["len", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1)
    placed = ranked.join(small(plan), (ranked["len"] == plan["len"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "row.*",
        (F.col("sequence") + F.floor(nth / F.col("share"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("share") * ranked["len"]).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` (see :func:`pieces`) with their place in a sequence (see :func:`pack`)."""
    return pack(cut(pieces(docs, vocabulary, capacity)), capacity)
