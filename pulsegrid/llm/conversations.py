"""Cheapest repairs of conversations whose roles don't alternate or whose turns are empty, repeated or cut short.

A conversation's signature has a symbol a row: its role's initial and what is wrong with it. Signatures are sorted from
their ends, so that conversations with a common suffix follow each other and share its nodes; the cost-to-go and the
first letter of the best audit are computed once for each node and grammar state. All options of a state begin with
different letters, so the first letter decides ties, and the rest of an audit is a link to a node that is there already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, sized_partitions, small_batches, table

# fixed values: what edits cost
RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Grammar states: nothing yet, a system turn, a user's turn, an assistant's turn. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that must come next.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols of rows: initials s, u, a, or o for any other; as capitals if the text is cut short; x if the row must go.
SYMBOLS = "suaoSUAOx"
_NEVER = 1 << 40

BLANK_SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``rows``, nulls of role and text as a space, damaged by the checksum of
    "conv_id:turn" (nulls as a space there too) modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3
    repeats it, 4 makes its role user. Repeated rows fare alike."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    mark = F.crc32(F.concat_ws(":", *plain).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(mark == 1, F.lit("")).when(mark == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    marked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(mark == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), mark.alias("mark"))
    return marked.filter("mark <> 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, text): conv is never null, and (turn, role, digest) order a conversation's rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"), text.alias("text"))


def _symbol() -> Column:
    """A row's symbol, or b if it is blank."""
    first = F.left("role", F.lit(1))
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    blank = ~F.col("text").rlike(f"[^{BLANK_SPACE}]")
    short = F.col("text").rlike(rf"[^{BLANK_SPACE}.!?][{BLANK_SPACE}]*\z")
    return F.when(blank, F.lit("b")).when(short, F.upper(initial)).otherwise(initial)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (conv, turn, initial, symbol, n, seen, part) in their order: for each conversation of a batch its symbols,
    a row's later copies and rows seen before as x, and what is counted, with what the seam to its next part needs."""
    seq = 0
    for b in batches:
        if not b.num_rows:
            continue
        count = b.column("n").to_numpy()
        at = np.repeat(np.arange(b.num_rows), count)
        again = np.ones(len(at), bool)
        again[np.cumsum(count) - count] = b.column("seen").to_numpy(zero_copy_only=False)
        symbol = np.frombuffer("".join(b.column("symbol").to_pylist()).encode(), np.uint8)[at]
        initial = np.frombuffer("".join(b.column("initial").to_pylist()).encode(), np.uint8)[at]
        blank = symbol == ord("b")
        repeat = again & ~blank
        short = ~blank & ~repeat & (symbol < ord("a"))
        sig = np.where(blank | repeat, ord("x"), symbol).astype(np.uint8)
        conv = b.column("conv").dictionary_encode()
        code = conv.indices.to_numpy()[at]
        new = np.concatenate(([True], code[1:] != code[:-1]))
        legal = np.isin(initial[:-1].astype(int) * 256 + initial[1:], [ord(x) * 256 + ord(y) for x, y in ("su", "ua", "au")])
        illegal = np.concatenate(([False], ~legal)) & ~new
        turn = b.column("turn")
        there = ~np.asarray(turn.is_null())[at]
        when = turn.fill_null(0).to_numpy()[at]
        step = there & (new | np.concatenate(([True], (when[1:] != when[:-1]) | ~there[:-1])))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at))
        low = [int(when[i:j][there[i:j]][0]) if there[i:j].any() else None for i, j in zip(head, tail, strict=True)]
        high = [int(when[j - 1]) if there[j - 1] else None for j in tail]
        raw = sig.tobytes().decode()
        out = {"conv": b.column("conv").take(pa.array(at[head])), "part": pa.array(np.full(len(head), b.column("part")[0].as_py(), np.int32)), "seq": pa.array(np.full(len(head), seq, np.int32)), "sig": pa.array([raw[i:j] for i, j in zip(head, tail, strict=True)]), "first": pa.array([chr(initial[i]) for i in head]), "last": pa.array([chr(initial[j - 1]) for j in tail]), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())}
        for name, x in (("turns", step), ("blank", blank), ("duplicate", repeat), ("truncated", short), ("illegal", illegal)):
            out[name] = pa.array(np.add.reduceat(x.astype(np.int64), head))
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        seq += 1


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, sig, gaps, blank, duplicate, truncated, illegal) of every conversation of ``rows``. Its rows are read in
    order by tasks that deal it among them, so that a long conversation is many tasks; only its symbols meet."""
    spark = rows.sparkSession
    short = _keyed(rows).withColumn("symbol", _symbol()).groupBy("conv", "turn", "role", "digest", "symbol").agg(F.count("*").cast("int").alias("n"))
    seen = short.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("since"))
    first = F.left("role", F.lit(1))
    short = short.join(seen, ["conv", "role", "digest"]).withColumns({"seen": ~F.col("turn").eqNullSafe(F.col("since")), "initial": F.when(first.isin("s", "u", "a"), first).otherwise("o")})
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = cut(short.select("conv", "turn", "role", "digest", "symbol", "initial", "n", "seen")).repartitionByRange(sized_partitions(spark), *order).sortWithinPartitions(*order)
    parts = dealt.select("conv", "turn", "initial", "symbol", "n", "seen", F.spark_partition_id().alias("part"))
    counts = "turns long, blank long, duplicate long, truncated long, illegal long"
    parts = parts.mapInArrow(_parts, f"conv string, part int, seq int, sig string, first string, last string, low long, high long, {counts}")
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "first", "last", "low", "high", "sig"))).alias("p"), *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")))
    seams = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: i > 0)

    def at(seam: Column, c: str) -> Column:
        return F.get("p", seam)[c]

    wrong = F.size(F.filter(seams, lambda i: ~F.concat(at(i - 1, "last"), at(i, "first")).isin("su", "ua", "au")))
    shared = F.size(F.filter(seams, lambda i: at(i - 1, "high") == at(i, "low")))
    low, high = F.array_min(F.transform("p", lambda x: x["low"])), F.array_max(F.transform("p", lambda x: x["high"]))
    gaps = F.coalesce(high - low + 1 - (F.col("turns") - shared), F.lit(0)).cast("long")
    return whole.select("conv", F.array_join(F.transform("p", lambda x: x["sig"]), "").alias("sig"), gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + wrong).alias("illegal"))


class Suffixes:
    """The automaton: nodes of the suffixes of signatures that come sorted from their ends. Nodes whose states differ by the
    same costs are alike, so a node is the number of its kind and what is added to its costs."""

    def __init__(self):
        #: Of each kind: the states' costs above the least, and for each state the letter and the state that follow.
        self.kinds: list[tuple[tuple[int, ...], str, tuple[int, ...]]] = []
        self.number: dict[tuple, int] = {}
        self.made: dict[tuple[str, int], tuple[int, int]] = {}
        self.nodes = 0
        base, kind = self._kind([[(0, "", q)] if q in (START, ASSISTANT) else [] for q in range(4)])
        self.suffix, self.node, self.cost = "", [kind], [base]
        self.answer: tuple[int, str] | None = None

    def _kind(self, options: list[list[tuple[int, str, int]]]) -> tuple[int, int]:
        """From each state's ways (cost, letter, state after it) of taking the row: the least cost and the kind."""
        cost = [min((o[0] for o in ways), default=_NEVER) for ways in options]
        for _ in range(3):  # no more than two turns are ever inserted at a place
            cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
        best = [min([*ways, (INSERT + cost[NEXT[q]], "I", NEXT[q])]) for q, ways in enumerate(options)]
        least = min(cost)
        kind = (tuple(c - least for c in cost), tuple(b[1] for b in best), tuple(b[2] for b in best))
        if kind not in self.number:
            self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
        return least, self.number[kind]

    def _before(self, symbol: str, after: int) -> tuple[int, int]:
        """What a row with this symbol makes of the kind behind it."""
        to_go = self.kinds[after][0]
        options = []
        for q in range(4):
            ways = [(DELETE + to_go[q], "D", q)]
            if symbol != "x":
                short = CUT_SHORT if symbol.isupper() else 0
                role = symbol.lower()
                ways.append((RENAME + short + to_go[NEXT[q]], "R", NEXT[q]))
                if role == "s" and q == START:
                    ways.append((short + to_go[SYSTEM], "K", SYSTEM))
                elif role == ("a" if q == USER else "u"):
                    ways.append((short + to_go[NEXT[q]], "K", NEXT[q]))
            options.append(ways)
        return self._kind(options)

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, the least audit of equals."""
        suffix = signature[::-1]
        if self.answer is not None and suffix == self.suffix:
            return self.answer
        n = min(len(suffix), len(self.suffix))
        if suffix[:n] == self.suffix[:n]:
            shared = n
        else:
            x, y = (np.frombuffer(s[:n].encode(), np.uint8) for s in (suffix, self.suffix))
            shared = int((x != y).argmax())
        del self.node[shared + 1 :], self.cost[shared + 1 :]
        for symbol in suffix[shared:]:
            key = (symbol, self.node[-1])
            if key not in self.made:
                self.made[key] = self._before(*key)
            more, kind = self.made[key]
            self.node.append(kind)
            self.cost.append(self.cost[-1] + more)
            self.nodes += 1
        self.suffix = suffix
        at, q, audit = len(suffix), START, []
        total = self.cost[at] + self.kinds[self.node[at]][0][START]
        while at or self.kinds[self.node[0]][1][q]:
            _, letters, after = self.kinds[self.node[at]]
            audit.append(letters[q])
            at, q = at - (letters[q] != "I"), after[q]
        self.answer = (total, "".join(audit))
        return self.answer


def solved(signed: DataFrame) -> DataFrame:
    """``signed`` (of signatures()) with cost and audit. A suffix that two tasks have is computed in both; a signature that
    many conversations share is dealt to several tasks."""
    order = [F.reverse("sig").alias("_from_end"), F.col("conv")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Suffixes()
        for b in batches:
            answers = [automaton.solve(s) for s in b.column("sig").to_pylist()]
            cost, audit = pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, cost, audit], names=[*b.schema.names, "cost", "audit"])

    dealt = signed.repartitionByRange(sized_partitions(signed.sparkSession), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{n} {t}" for n, t in signed.dtypes)
    return dealt.mapInArrow(run, f"{fields}, cost long, audit string")


class Replay:
    """Carries out an audit over a conversation's rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
            yield role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield ROLES[self.state], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        if self.at != len(self.audit):
            raise ValueError("an audit with more edits than rows")


def _replayed(rows: DataFrame, audits: DataFrame, run, schema: str) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one task, to ``run``. Texts stream through it: no more of
    them than a batch is held, however long the conversation is."""
    spark = rows.sparkSession
    small_batches(spark)
    order = [F.col("conv"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    texts = _keyed(rows).withColumn("kind", F.lit(1))
    first = audits.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = first.unionByName(texts).repartition(sized_partitions(spark), "conv").sortWithinPartitions(*order)
    return both.select("conv", "kind", "role", "text").mapInArrow(run, schema)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
    """(conv, role, text) of every row that a repaired conversation has, and (conv, None, None) at its end."""
    conv, replay = None, None
    for b in batches:
        for c, kind, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if not kind:
                if replay is not None:
                    yield from ((conv, *r) for r in replay.end())
                    yield conv, None, None
                conv, replay = c, Replay(text)
            else:
                yield from ((conv, *r) for r in replay.row(role, text))
    if replay is not None:
        yield from ((conv, *r) for r in replay.end())
        yield conv, None, None


def _id(conv: str = "conv") -> Column:
    return F.nullif(F.col(conv), F.lit("")).cast("long")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, from place 0. ``audits``: conv and audit, of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = place = 0
        for conv, role, text in _events(batches):
            if role is None:
                place = 0
                continue
            held.append((conv, place, role, text))
            place, size = place + 1, size + len(text)
            if len(held) >= 512 or size >= 1 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv", "place", "role", "text"), h, strict=True)) for h in held])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv", "place", "role", "text"), h, strict=True)) for h in held])

    return _replayed(rows, audits, run, "conv string, place long, role string, text string").select(_id().alias("conv_id"), "place", "role", "text")


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the repaired rows as role:text, joined by newlines. A hash has to be taken in order, so a
    conversation passes through one task, row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun, convs, hashes = hashlib.sha256(), False, [], []
        for conv, role, text in _events(batches):
            if role is None:
                convs.append(conv)
                hashes.append(state.hexdigest())
                state, begun = hashlib.sha256(), False
                if len(convs) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(convs), pa.array(hashes)], names=["conv", "repaired_sha256"])
                    convs, hashes = [], []
            else:
                state.update(f"{chr(10) * begun}{role}:{text}".encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(hashes, pa.string())], names=["conv", "repaired_sha256"])
        give_back()

    return _replayed(rows, audits, run, "conv string, repaired_sha256 string")


def repaired(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``rows`` (conv_id, turn, role, text), and of those of ``every`` (conv_id) that have no rows: zeros, an empty audit and
    the hash of nothing.

    Rows go by turn, null turns first; rows of one turn by role and by their texts' hashes, so equal rows are adjacent. A
    null role or text is a space, a null conv_id a conversation of its own. A very long conversation is dealt to many tasks
    but for its audit, a letter a row, and its hash. An empty table gives no rows; other columns are ignored.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    answers = cut(solved(cut(signatures(rows))).drop("sig"))
    hashes = repaired_hashes(rows, answers)
    ids = (rows if every is None else every).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    found = ids.join(answers, "conv", "left").join(hashes, "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(_id().alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), every=rows)
