"""Conversation structure repair by secondary-sorted streams.

The rows of a conversation pass through one task in the order of their turns, first from the last to the
first, then forward again; both passes hold one row at a time and carry their state from Arrow batch to Arrow
batch.  The backward pass knows for each of the four states in which the repaired roles may stand (nothing
yet, after the system turn, after a user turn, after an assistant turn) what the rest costs at least and how
the cheapest edits of the rest compare as strings.  States of the pass are few once the least cost is taken
off, so its steps are kept in a table.  Each row takes along a backpointer of two bytes: what to do in each of
the four states.  Spark's own sort, which spills, turns the rows round; the forward pass follows the
backpointers.  Nothing of a giant conversation stands in memory but its audit, a byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant; what an edit may add in each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of first letters of a role: none, s, u, a, other.
LETTERS = ["", "s", "u", "a"]
OTHER = len(LETTERS)
#: What a row's text is like: sound, truncated, or to be deleted.
SOUND, CUT, GONE = range(3)
_EDITS = "DKR"


def after(state: int, letter: int) -> int | None:
    """The state after a kept role of that first letter; a role without letters changes nothing."""
    if letter == 0:
        return state
    if letter == 1:
        return SYSTEM if state == NOTHING else None
    if letter == 2:
        return USER if state != USER else None
    return ASSISTANT if letter == 3 and state == USER else None


class Backward:
    """What is left to pay from each state on, and the order of the edits' strings, row by row from the end."""

    #: Costs and string ranks behind the last row: '' may end, 'I' and 'II' complete a pair.
    END = ((0, INSERT * 2, INSERT, 0), (0, 2, 1, 0))

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}

    def step(self, now: tuple, kind: int) -> tuple[tuple, int]:
        """Before a row of `kind` (letter * 3 + text): the new costs and ranks, and the row's backpointer."""
        if (found := self.steps.get((now, kind))) is None:
            found = self.steps[now, kind] = self._step(now, *divmod(kind, 3))
        return found

    def _step(self, now: tuple, letter: int, text: int) -> tuple[tuple, int]:
        costs, ranks = now
        plain = []
        for s in range(4):
            ways = [(DELETE + costs[s], ("D", ranks[s]))]
            if text != GONE:
                extra = TRUNCATED if text == CUT else 0
                if (t := after(s, letter)) is not None:
                    ways.append((KEEP + extra + costs[t], ("K", ranks[t])))
                ways.append((REROLE + extra + costs[NEXT[s]], ("R", ranks[NEXT[s]])))
            plain.append(min(ways))
        best = plain
        for _ in range(2):  # a third turn inserted would only lead back to a state passed already
            best = [min(plain[s], (INSERT + best[NEXT[s]][0], ("I", *best[NEXT[s]][1]))) for s in range(4)]
        order = sorted({key for _, key in best})
        least = min(c for c, _ in best)
        pointer = 0
        for _, key in reversed(best):
            pointer = pointer * 9 + (len(key) - 2) * 3 + _EDITS.index(key[-2])
        return (tuple(c - least for c, _ in best), tuple(order.index(key) for _, key in best)), pointer


@cache
def backward() -> Backward:
    return Backward()


def _point(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Backpointers of rows that come conversation by conversation, the last turn first."""
    step, end, held, now = backward().step, Backward.END, object(), Backward.END
    for rows in batches:
        out = []
        for key, kind, dropped in zip(rows["key"], rows["kind"], rows["dropped"], strict=True):
            if key != held:
                held, now = key, end
            pointer = 0
            if not dropped:
                now, pointer = step(now, kind)
            out.append(pointer)
        yield rows.assign(pointer=pd.array(out, "int32"))


class Forward:
    """One conversation on its way: follows the backpointers and tells what it does to `emit`."""

    def __init__(self, key: str | None, emit: Callable[[str, str, str], None]) -> None:
        self.key, self.emit, self.state, self.cost = key, emit, NOTHING, 0
        self.faults, self.illegal, self.letter = [0, 0, 0], 0, None
        self.turns, self.least, self.last = 0, None, None
        self.audit, self.sha, self.lines = bytearray(), hashlib.sha256(), 0

    def _line(self, edit: str, role: str, text: str) -> None:
        self.audit += edit.encode()
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.emit(edit, role, text)

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self.cost += INSERT
        self._line("I", NAMES[self.state], "")

    def row(self, turn: int | None, role: str, text: str, kind: int, fault: int, pointer: int) -> None:
        letter, state_of_text = divmod(kind, 3)
        if fault:
            self.faults[fault - 1] += 1
        if self.letter is not None and self.letter + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.letter = role[:1]
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        inserts, edit = divmod(pointer // 9**self.state % 9, 3)
        for _ in range(inserts):
            self._insert()
        if _EDITS[edit] == "D":
            self.audit += b"D"
            self.cost += DELETE
            return
        if _EDITS[edit] == "K":
            self.state, self.cost = after(self.state, letter), self.cost + KEEP
        else:
            self.state, self.cost = NEXT[self.state], self.cost + REROLE
            role = NAMES[self.state]
        self.cost += TRUNCATED if state_of_text == CUT else 0
        self._line(_EDITS[edit], role, text)

    def close(self) -> tuple:
        while self.state not in (NOTHING, ASSISTANT):
            self._insert()
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.key, gaps, *self.faults, self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "key string, position long, edit string, role string, text string"


def _follow(turns: bool):
    """mapInPandas function over rows by conversation and turn: a report a conversation, or the repaired turns."""
    names = [c.split()[0] for c in (_TURNS if turns else _REPORT).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Forward | None = None
        out: list[tuple] = []

        def emit(edit: str, role: str, text: str) -> None:
            if turns:
                out.append((now.key, now.lines, edit, role, text))

        def close() -> None:
            report = now.close()
            if not turns:
                out.append(report)

        for rows in batches:
            for key, none, turn, role, text, kind, fault, dropped, pointer in zip(*(rows[c] for c in ("key", "no_turn", "turn", "role", "text", "kind", "fault", "dropped", "pointer")), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        close()
                    now = Forward(key, emit)
                if not dropped:
                    now.row(None if none else turn, role, text, kind, fault, pointer)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if now is not None:
            close()
        yield pd.DataFrame(out, columns=names)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of `conv_id:turn` modulo 20 (nulls: one space): conv_id, turn, role, text and
    dropped; a dropped row stays as a mark without text, so that its conversation is still known."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(lot < 2, F.lit("")).when(lot == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(lot == 0, F.lit("")).when(lot == 4, F.lit("user")).otherwise(spaced("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(lot == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (lot == 0).alias("dropped"), times.alias("copy")).drop("copy")


def _pointed(rows: DataFrame) -> DataFrame:
    """Rows with fault, kind and backpointer, a conversation in one partition, by turn within it."""
    rows = rows.select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").isNull().alias("no_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped",
    )
    rows = rows.withColumns({"bare": F.rtrim("text", F.lit(SPACES)), "digest": F.sha2("text", 256)}).withColumn("last", F.substring("bare", -1, 1)).withColumn("blank", F.col("bare") == "").drop("bare")
    seen = F.row_number().over(Window.partitionBy("key", "dropped", "role", "digest").orderBy(F.desc("no_turn"), "turn")) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("seen"), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    letter = F.coalesce(F.array_position(F.array(*map(F.lit, LETTERS)), F.substring("role", 1, 1)) - 1, F.lit(-1))
    text = F.when(F.col("fault") == 0, SOUND).when(F.col("fault") == 3, CUT).otherwise(GONE)
    rows = rows.repartition("key").withColumn("seen", seen).withColumn("fault", fault)
    rows = rows.withColumn("kind", (F.when(letter < 0, OTHER).otherwise(letter) * 3 + text).cast("int"))
    rows = rows.select("key", "no_turn", "turn", "role", "text", "dropped", "fault", "kind").sortWithinPartitions("key", "no_turn", F.desc("turn"), F.desc("role"), F.desc("text"))
    rows = rows.mapInPandas(_point, "key string, no_turn boolean, turn long, role string, text string, dropped boolean, fault int, kind int, pointer int")
    return rows.sortWithinPartitions("key", F.desc("no_turn"), "turn", "role", "text")


def _with_mark(conversations: DataFrame) -> DataFrame:
    return conversations if "dropped" in conversations.columns else conversations.select("conv_id", "turn", "role", "text", F.lit(False).alias("dropped"))


def audit(conversations: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `conversations` has conv_id, turn, role, text and maybe dropped (marks of rows that are gone: they count for
    nothing, but their conversation is reported); further columns are not read.  Null roles and texts are one
    space, rows without a conv_id are one conversation, rows of one turn go by role and text, turns that are null
    come first.  A role without letters may be kept anywhere; any other first letter than s, u and a can't be kept.
    One shuffle, of whole conversations; three sorts within partitions, all of which spill.
    """
    out = _pointed(_with_mark(conversations)).mapInPandas(_follow(False), _REPORT)
    return out.select(F.col("key").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *[c.split()[0] for c in _REPORT.split(", ")[1:]])


def repaired(conversations: DataFrame) -> DataFrame:
    """The turns of the cheapest repair: conv_id, position (from 1), edit (K, R or I), role, text; as audit() otherwise.

    A conversation of which nothing is left has no rows.
    """
    out = _pointed(_with_mark(conversations)).mapInPandas(_follow(True), _TURNS)
    return out.select(F.col("key").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), "position", "edit", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by a recursion over whole strings: each state carries cost, audit and repaired lines of the rest."""
    states = ("e", "s", "u", "a")
    follow = dict(zip(states, "uuau", strict=True))
    name = {"u": "'user'", "a": "'assistant'"}
    put = lambda way, cost, edit, line: f"{{'c': {way}.c + {cost}, 'a': '{edit}' || {way}.a, 'r': {line}{way}.r}}"
    row = lambda role: f"{role} || ':' || x.text || chr(10) || "
    kept = {"e": "CASE l WHEN 's' THEN {s} WHEN 'u' THEN {u} WHEN '' THEN {e} END", "s": "CASE l WHEN 'u' THEN {u} WHEN '' THEN {s} END", "u": "CASE l WHEN 'a' THEN {a} WHEN '' THEN {u} END", "a": "CASE l WHEN 'u' THEN {u} WHEN '' THEN {a} END"}
    keep = {s: k.format(**{t: put(f"w.{t}", "extra", "K", row("x.role")) for t in states}) for s, k in kept.items()}
    plain = {s: f"list_min([{put(f'w.{s}', 4, 'D', '')}, CASE WHEN sound THEN {keep[s]} END, CASE WHEN sound THEN {put(f'w.{follow[s]}', '3 + extra', 'R', row(name[follow[s]]))} END])" for s in states}
    # one more turn inserted in front, at most; `of` has no insert here yet, `by` maybe one
    more = lambda of, by: {s: f"list_min([{of}.{s}, {put(f'{by}.{follow[s]}', 3, 'I', f'{name[follow[s]]} || chr(58) || chr(10) || ')}])" for s in states}
    struct = lambda of: "{" + ", ".join(f"'{s}': {x}" for s, x in of.items()) + "}"
    end = "{'c': 0, 'a': '', 'r': ''} AS e, {'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s, {'c': 3, 'a': 'I', 'r': 'assistant:' || chr(10)} AS u, {'c': 0, 'a': '', 'r': ''} AS a"
    return f"""WITH RECURSIVE bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot FROM conversations, bits),
    hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed, range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS l, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
    faulty AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(l) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
    x AS (SELECT *, fault IN (0, 3) AS sound, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM faulty),
    facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || l NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
    walk AS (SELECT conv_id, n + 1 AS i, {end} FROM facts UNION ALL
      SELECT conv_id, i, {', '.join(more('p', 'q').values())} FROM (SELECT conv_id, i, p, {struct(more('p', 'p'))} AS q FROM (
        SELECT x.conv_id, x.i, {struct(plain)} AS p FROM walk w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i - 1)))
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.e.c, 0)::BIGINT AS cost, coalesce(w.e.a, '') AS audit, sha256(coalesce(w.e.r[:-2], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 1"""


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL = {"op12_conversation_repair": _sql()}
