"""Conversation structure repair by signature deduplication.

A conversation's rows become a string of one character each: the initial of the role, in upper case
if the text is truncated, or ``-`` for a row that must go. Equal strings have equal repairs, so each
distinct one is solved once, by a memoised recursion over (row, state), and the audits are joined
back and replayed over the rows.

Rows are told apart by turn and by the digest of role and text. What finds faults shuffles digests
only; texts move once, for the replay, sorted by conversation and turn, and stream through it: a
conversation of any length needs its signature and its audit in a task, never its texts. Which rows are
copies is found by an aggregation of digests, whatever number of rows share one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Stash, bound_batches, give_back

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of what has been said so far: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state can be followed by: the role that comes next, and the state after it.
_NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that leave ``(s?(ua)+)?``; of equal costs the ASCII-least audit.

    From a state an edit's initial decides which state follows, so ties are decided where audits first
    differ. The memo is filled from the end, so no call goes deep, and keeps the costs of two rows and
    one byte for each row and state. Two insertions behind an assistant row lead back to it for nothing.
    """
    memo: dict[tuple[int, int], int] = {}
    edits = bytearray(4 * (len(signature) + 1))

    def ways(at: int, state: int, insert: bool = True) -> tuple[int, str]:
        """(cost, initial of the first edit) of the best way on; ``insert``: whether that may be an insertion."""
        role, after = _NEXT[state]
        options = []
        if at == len(signature):
            if state in (START, ASSISTANT):
                return 0, ""
        else:
            c = signature[at]
            options.append((DELETE + rest(at + 1, state), "D"))
            if c != "-":
                more = TRUNCATED if c.isupper() else 0
                options.append((REROLE + more + rest(at + 1, after), "R"))
                if c.lower() == role:
                    options.append((KEEP + more + rest(at + 1, after), "K"))
                elif c.lower() == "s" and state == START:
                    options.append((KEEP + more + rest(at + 1, SYSTEM), "K"))
        if insert:
            options.append((INSERT + (ways(at, USER, False)[0] if state == ASSISTANT else rest(at, after)), "I"))
        return min(options)

    def rest(at: int, state: int) -> int:
        if (at, state) not in memo:
            memo[at, state], edit = ways(at, state)
            edits[4 * at + state] = ord(edit or "\0")
        return memo[at, state]

    for at in range(len(signature), -1, -1):
        for state in (ASSISTANT, USER, SYSTEM, START):
            rest(at, state)
        for state in range(4):
            memo.pop((at + 1, state), None)
    audit, at, state = bytearray(), 0, START
    while edit := edits[4 * at + state]:
        audit.append(edit)
        edit = chr(edit)
        if edit in "KR":
            state = SYSTEM if edit == "K" and state == START and signature[at] in "sS" else _NEXT[state][1]
        elif edit == "I":
            state = _NEXT[state][1]
        at += edit != "I"
    return memo[0, START], audit.decode()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): test damage by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 leaves no copy, 1 empties the text, 2 takes its ``.!?`` out, 3 makes two copies, 4 sets the role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _signatures(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows that are sorted within partitions by conversation, turn and digest."""

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, turn, initial, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    # conv, least turn, greatest turn, distinct turns, blank, duplicate, truncated, illegal, last initial, signature
                    now = [conv, None, None, 0, 0, 0, 0, 0, None, []]
                if not copies:
                    continue
                if turn is not None:
                    if now[1] is None:
                        now[1] = turn
                    now[3] += now[2] is None or turn != now[2]
                    now[2] = turn
                for copy in range(copies):
                    if now[8] is not None:
                        now[7] += now[8] + initial not in ("su", "ua", "au")
                    now[8] = initial
                    what = fault if fault == "blank" or not copy else "duplicate"
                    if what:
                        now[{"blank": 4, "duplicate": 5, "truncated": 6}[what]] += 1
                    c = initial if initial in ("s", "u", "a") else "x"
                    now[9].append("-" if what in ("blank", "duplicate") else c.upper() if what else c)
            yield _summed(done)
        if now is not None:
            yield _summed([now])
        give_back()

    return rows.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(run, _SUMMED)


_SUMMED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _summed(done: list[list]) -> pa.RecordBatch:
    rows = []
    for c, low, high, n, b, d, t, i, _, s in done:
        gaps = 0 if low is None else high - low + 1 - n
        rows.append((c, gaps if gaps < 1 << 63 else None, b, d, t, i, "".join(s)))
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.int64()] * 6 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])


def _solved(signatures: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            got = [solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], ["solved", "cost", "audit"])

    return signatures.mapInArrow(run, "solved string, cost long, audit string")


class _Replay:
    """Applies an audit to a conversation's rows as they come: lines of ``role:text``, hashed and, if asked, kept."""

    def __init__(self, conv, audit: str, keep: bool):
        self.conv, self.audit, self.at, self.state = conv, audit, 0, START
        self.sha, self.lines, self.keep, self.first = hashlib.sha256(), [], keep, True

    def _say(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.sha.update((line if self.first else "\n" + line).encode())
        self.first = False
        if self.keep:
            self.lines.append((role, text))

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = _NEXT[self.state]
            self._say(ROLES[role], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        expected, after = _NEXT[self.state]
        if edit == "R":
            role = ROLES[expected]
        self.state = SYSTEM if edit == "K" and self.state == START and role[:1] == "s" else after
        self._say(role, text)


def _replayed(rows: DataFrame, keep: bool) -> DataFrame:
    """(conv_id, repaired_sha256[, repaired]) of rows sorted within partitions: a conversation's audit, then its rows."""

    def run(batches):
        now = None

        def give(done):
            for x in done:
                x.insertions()
            columns = [pa.array([x.conv for x in done], pa.int64()), pa.array([x.sha.hexdigest() for x in done], pa.string())]
            if keep:
                columns.append(pa.array([[{"role": r, "text": t} for r, t in x.lines] for x in done], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "repaired_sha256", "repaired"][: len(columns)])

        for batch in batches:
            done = []
            for conv, audit, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    if now is not None:
                        done.append(now)
                    now = _Replay(conv, audit, keep)
                for _ in range(copies):
                    now.row(role, text)
            yield give(done)
        if now is not None:
            yield give([now])
        give_back()

    return rows.select("conv_id", "audit", "role", "text", "copies").mapInArrow(run, "conv_id long, repaired_sha256 string" + (", repaired array<struct<role:string,text:string>>" if keep else ""))


def repair(rows: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, copies), with its faults, the cheapest repair and its digest. Runs jobs.

    Rows are taken by turn, nulls first; rows of one turn by the digest of role and text, so their order
    never depends on how they are read. ``copies`` says how often a row occurs there; where it is 0 for all
    rows of a conversation, counts are 0, the audit is empty and the digest is that of an empty string.
    Repeated rows count as copies. A null conv_id is a conversation of its own; role and text must not be
    null. Roles are known by their initials s, u and a; any other, an empty one too, can only be replaced or
    deleted. Gaps that don't fit a long are null. With ``keep_rows`` the repaired conversation is given too, as an array of (role, text), which
    then is in memory whole. An empty table gives an empty one; other columns are not looked at.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    stash = Stash(spark, "conversations")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("long").alias("copies"))
    key = _digest(F.col("role"), F.col("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    skinny = rows.select("conv_id", "turn", key.alias("key"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")
    # a conversation of which nothing is left stays as a row without copies
    counted = stash.put(skinny.groupBy("conv_id", "turn", "key").agg(F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.sum("copies").alias("copies")))
    again = counted.where("copies > 0").groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("first.turn").alias("t"))
    marked = counted.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    said = F.col("k").isNotNull() & ~F.col("turn").eqNullSafe(F.col("t"))
    marked = marked.withColumn("fault", F.when((F.col("fault") != "blank") & said, "duplicate").otherwise(F.col("fault")))
    summed = stash.put(_signatures(marked.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "key")))
    audits = _solved(summed.select("signature").distinct())
    # a common signature is a hot key here: the sort-merge join is one that Spark splits
    summed = stash.put(summed.join(audits, F.col("signature") == F.col("solved")).drop("solved", "signature"))
    heads = summed.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    lines = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", key.alias("key"), F.lit(None).cast("string").alias("audit"), "role", "text", "copies")
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), F.col("key").asc_nulls_first()]
    replayed = _replayed(heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order), keep_rows)
    replayed = replayed.withColumnRenamed("conv_id", "of")
    return summed.join(replayed, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
