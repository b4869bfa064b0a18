"""Conversation repair: generalised LR parsing of roles with weighted deletions, role changes and insertions."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# White space of a blank text, ends of a whole one, roles by initial, costs of the edits.
BLANK = "\t\n\x0b\x0c\r "
STOPS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
# Role grammar for s?(ua)+ or nothing, left recursive: an opened turn (O) waits for its answer, a talk (T) is whole.
GRAMMAR = (("D", ""), ("D", "T"), ("T", "Oa"), ("O", "u"), ("O", "Hu"), ("O", "Tu"), ("H", "s"))
REMEMBERED = 50_000  # shapes of conversations whose repair a worker remembers
SHORT = 64  # rows of the longest shape that is remembered


class Tables:
    """SLR tables of a grammar, all actions of a state and a symbol beside each other where they conflict.

    Symbols are single characters, the left sides of rules are nonterminals, ``$`` ends the input.
    """

    def __init__(self, rules: tuple[tuple[str, str], ...] = GRAMMAR) -> None:
        self.rules = (("'", rules[0][0]), *rules)
        heads = {h for h, _ in self.rules}
        self.terminals = sorted({s for _, body in rules for s in body} - heads)
        empty: set[str] = set()
        first: dict[str, set[str]] = {s: {s} for s in self.terminals} | {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads}
        follow["'"].add("$")
        grown = True
        while grown:
            before = len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))
            for head, body in self.rules:
                after = set(follow[head])
                for s in reversed(body):
                    if s in heads:
                        follow[s] |= after
                    after = after | first[s] if s in empty else set(first[s])
                for s in body:
                    first[head] |= first[s]
                    if s not in empty:
                        break
                else:
                    empty.add(head)
            grown = before != (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))

        def closure(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            todo = list(items)
            while todo:
                rule, dot = todo.pop()
                for k, (head, _) in enumerate(self.rules):
                    if self.rules[rule][1][dot : dot + 1] == head and (k, 0) not in items:
                        items.add((k, 0))
                        todo.append((k, 0))
            return frozenset(items)

        states = [closure({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        self.reduce: list[dict[str, list[int]]] = []
        for state in states:  # grows
            moves: dict[str, set[tuple[int, int]]] = {}
            ends: dict[str, list[int]] = {}
            for rule, dot in sorted(state):
                head, body = self.rules[rule]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((rule, dot + 1))
                else:
                    for s in follow[head]:
                        ends.setdefault(s, []).append(rule)
            self.goto.append({})
            for s, items in moves.items():
                to = closure(items)
                if to not in states:
                    states.append(to)
                self.goto[-1][s] = states.index(to)
            self.reduce.append(ends)


class Node:
    """A stack top: its state, and the node below it; nodes are shared by all stacks that go through them."""

    __slots__ = ("above", "below", "state")

    def __init__(self, state: int, below: Node | None = None) -> None:
        self.state, self.below = state, below
        self.above: dict[int, Node] = {}

    def push(self, state: int) -> Node:
        if state not in self.above:
            self.above[state] = Node(state, self)
        return self.above[state]


class Repairer:
    """Cheapest edits of a row of role initials to a sentence of the grammar."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = GRAMMAR, roles: str = "".join(ROLES)) -> None:
        self.tables = Tables(rules)
        self.roles = roles  # those that a row may get and that may be put in
        self.known: OrderedDict[str, tuple[int, str, str]] = OrderedDict()
        self.shortest, tops = 0, [Node(0)]  # insertions that make a sentence out of nothing
        while not any(self.shifted(t, "$") for t in tops):
            tops = [n for t in tops for r in roles for n in self.shifted(t, r)]
            self.shortest += 1
            if not tops:
                raise ValueError("no sentence can be made of the roles that may be put in")

    def shifted(self, top: Node, symbol: str) -> list[Node]:
        """All stacks after the reductions that ``symbol`` allows and its shift (``$``: that the input may end in)."""
        done, todo, out = {id(top)}, [top], []
        while todo:
            node = todo.pop()
            if symbol == "$":
                if 0 in self.tables.reduce[node.state].get("$", ()):
                    out.append(node)
            elif symbol in self.tables.goto[node.state]:
                out.append(node.push(self.tables.goto[node.state][symbol]))
            for rule in self.tables.reduce[node.state].get(symbol, ()):
                if rule:
                    head, body = self.tables.rules[rule]
                    base = node
                    for _ in body:
                        base = base.below
                    to = base.push(self.tables.goto[base.state][head])
                    if id(to) not in done:
                        done.add(id(to))
                        todo.append(to)
        return out

    def __call__(self, shape: str) -> tuple[int, str, str]:
        """``(cost, audit, roles)`` for ``shape``: two characters a row, its initial and ``b`` (blank or repeated), ``t``

        (cut short) or ``-``. Roles are those of what stays, as initials; ties go to the audit that sorts first.

        Equal stack tops merge by the least (cost, audit). That is exact: edits before a top of equal cost never have
        an audit that begins with another's, since what is added to it would cost something. Stacks dearer than a way
        known to the end (delete all that follows) are left.
        """
        if (found := self.known.get(shape)) is not None:
            return found
        root = Node(0)
        live: dict[Node, tuple[int, str, str]] = {root: (0, "", "")}

        def offer(to: dict[Node, tuple[int, str, str]], node: Node, value: tuple[int, str, str]) -> bool:
            if node not in to or value < to[node]:
                to[node] = value
                return True
            return False

        rows = len(shape) // 2
        most = self.shortest * INSERT + rows * DELETE

        def inserted(left: int) -> None:
            nonlocal most
            todo = list(live)
            while todo:
                node = todo.pop()
                cost, audit, roles = live[node]
                if cost > most:
                    del live[node]
                    continue
                if cost + left * DELETE < most and self.shifted(node, "$"):
                    most = cost + left * DELETE
                for r in self.roles if cost + INSERT <= most else ():
                    todo += [n for n in self.shifted(node, r) if offer(live, n, (cost + INSERT, audit + "I", roles + r)) and n not in todo]

        for at in range(0, len(shape), 2):
            inserted(rows - at // 2)
            initial, fault = shape[at], shape[at + 1]
            after: dict[Node, tuple[int, str, str]] = {}
            for node, (cost, audit, roles) in live.items():
                offer(after, node, (cost + DELETE, audit + "D", roles))
                if fault == "b":
                    continue
                more = CUT_SHORT if fault == "t" else 0
                for n in self.shifted(node, initial) if initial in self.tables.terminals else ():
                    offer(after, n, (cost + KEEP + more, audit + "K", roles + initial))
                for r in self.roles:
                    for n in self.shifted(node, r):
                        offer(after, n, (cost + REROLE + more, audit + "R", roles + r))
            live = after
        inserted(0)
        ends = [value for node, value in live.items() if self.shifted(node, "$")]
        best = min(ends)
        if len(shape) <= 2 * SHORT:
            self.known[shape] = best
            if len(self.known) > REMEMBERED:
                self.known.popitem(last=False)
        return best


def _rows(turns: DataFrame) -> DataFrame:
    """``(conv, conv_id, turn, role, text)``: ``conv`` names the conversation and is never null; nulls become blanks."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    return turns.select(conv, "conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "text"]


def _groups(batches: Iterator, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


class _Report:
    """What is known of one conversation, row by row."""

    def __init__(self) -> None:
        self.shape: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        initial = initial if initial in ("s", "u", "a") else "-"
        if self.shape and self.shape[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.shape.append(initial + ("-" if not fault else "t" if fault == "truncated" else "b"))

    def row(self, repair: Repairer) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, roles = repair("".join(self.shape))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, roles


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string"


def _written(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def reports(turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation in ``turns(conv_id, turn, role, text)``.

    Rows go by turn, nulls first, then by role and text. ``gaps`` are turns missing between the first and the last;
    a row's first fault counts: ``blank``, ``duplicate`` (role and text as in an earlier row) or ``truncated`` (does
    not end a sentence); ``illegal`` are neighbours other than system-user, user-assistant and assistant-user.
    ``cost``, ``audit`` (K keep, R role changed, D delete, I insert, in order) and ``roles`` (initials of what stays)
    are those of :class:`Repairer`. ``conv`` is ``=`` and the id, empty for null ids, which are one conversation.
    Null roles and texts count as one blank. Other columns are not read; no rows give no reports.

    Texts move once, to be ordered and compared; sorting spills, and a task holds two characters of each row of the
    conversation that it reads.
    """
    rows = _rows(turns).repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    rows = rows.withColumn("again", again).withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy(*_order())))
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("again"), "duplicate").when(~end.isin(*STOPS), "truncated").otherwise("")
    narrow = rows.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))

    def run(batches: Iterator) -> Iterator:
        repair = Repairer()
        now, held, out = None, _Report(), []
        for conv, turn, initial, fault in _groups(batches, "conv", "turn", "initial", "fault"):
            if conv != now:
                if now is not None:
                    out.append((now, *held.row(repair)))
                    if len(out) == 4096:
                        yield _written(out, REPORT)
                        out = []
                now, held = conv, _Report()
            held.add(turn, initial, fault)
        if now is not None:
            out.append((now, *held.row(repair)))
        yield _written(out, REPORT)

    return narrow.sortWithinPartitions("conv", "at").mapInArrow(run, REPORT)


TURNS = "conv string, place long, turn long, edit string, role string, text string"


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the repaired conversations, in order within a task: ``(conv, place, turn, edit, role, text)``.

    ``found`` are the :func:`reports` of ``turns``. Kept rows stay as they are, those with another role keep turn and
    text, put-in rows have no turn and an empty text. Conversations of which nothing stays have no rows. Each
    conversation's audit leads its rows through one sorted partition, so no conversation is held.
    """
    rows = _rows(turns).select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    lead = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("roles").alias("role"), F.col("audit").alias("text"))
    both = rows.union(lead).repartition("conv").sortWithinPartitions("conv", "kind", *_order())

    def run(batches: Iterator) -> Iterator:
        out: list[tuple] = []
        size = 0
        conv, audit, roles, step, place = "", "", "", 0, 0

        def put(turn: int | None, edit: str, role: str, text: str) -> None:
            nonlocal place, size
            out.append((conv, place, turn, edit, role, text))
            place += 1
            size += len(text)

        def insertions() -> None:
            nonlocal step
            while step < len(audit) and audit[step] == "I":
                put(None, "I", ROLES[roles[place]], "")
                step += 1

        for name, kind, turn, role, text in _groups(batches, "conv", "kind", "turn", "role", "text"):
            if kind == 0:
                insertions()
                conv, roles, audit, step, place = name, role, text, 0, 0
                continue
            insertions()
            edit = audit[step]
            step += 1
            if edit != "D":
                put(turn, edit, role if edit == "K" else ROLES[roles[place]], text)
            if len(out) >= 4096 or size > 1 << 24:
                yield _written(out, TURNS)
                out, size = [], 0
        insertions()
        yield _written(out, TURNS)

    return both.mapInArrow(run, TURNS)


def transcript_hashes(repaired: DataFrame) -> DataFrame:
    """``(conv, sha256)`` over ``role:text`` of a conversation's rows, joined by line feeds; rows as :func:`repaired_turns` gives them."""
    schema = "conv string, sha256 string"

    def run(batches: Iterator) -> Iterator:
        now, digest, out = None, None, []
        for conv, role, text in _groups(batches, "conv", "role", "text"):
            if conv != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
            if len(out) == 4096:
                yield _written(out, schema)
                out = []
        if now is not None:
            out.append((now, digest.hexdigest()))
        yield _written(out, schema)

    return repaired.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a checksum of conversation and turn: rows dropped, emptied, without stops, repeated, or the user's.

    Nulls are one blank; a dropped row is gone, a repeated one stands twice in the same turn.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"),
                        (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("harm"))
    rows = rows.where("harm <> 0").withColumns({
        "text": F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")),
        "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role")),
    })
    return rows.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``turns``, after :func:`damaged`: its report and the hash of the repaired transcript."""
    harmed = damaged(turns)
    found = cut(reports(harmed))
    hashes = transcript_hashes(repaired_turns(harmed, found))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    whole = turns.select("conv_id", conv).distinct().join(found, "conv", "left").join(hashes, "conv", "left")
    figures = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
