"""Conversation structure repair: the cheapest edits that leave an optional system turn and pairs of user and assistant.

Each way to edit a conversation is a path through a graph of (turns read, state), and its weight is one integer: the high
digits are its cost, the low digits its audit, three digits of eight for each turn in the turn's own place (inserts before
it, then the turn's letter, zeros behind), so that plain integer order is cost first, then the audit's ASCII order: no
turn's digits are the start of another's, as only the last of them is no insert. The least weight of a node is the least
sum over the edges into it.

A conversation is read turn by turn. After some turns the audits so far are replaced by their rank among the paths that
are left, so integers stay short however long it is, and turns on whose edit all of these agree are handed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE = "\t\n\x0b\x0c\r "
#: States: nothing kept yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Digits in ASCII order; 0 pads the end.
LETTERS = " DIKR"
#: Turns between two rankings, digits of a turn, bits of a digit.
TURNS, DIGITS, BITS = 32, 3, 3
_LOW = BITS * DIGITS * (TURNS + 1)  # the digits of the turns, and of inserts after the last
_HIGH = _LOW + 3  # then the rank of what came before, then the cost


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Of a truncated turn that isn't deleted.
    truncated: int = 5


def _number(letters: str) -> int:
    """The letters of a turn as digits, the first one highest."""
    out = 0
    for x in letters.ljust(DIGITS):
        out = out << BITS | LETTERS.index(x)
    return out


def _inserted(state: int, costs: Costs) -> list[tuple[int, int, str]]:
    """state, cost, letters after no, one or two inserts; a third would only go round."""
    out = [(state, 0, "")]
    for _ in range(2):
        at, cost, letters = out[-1]
        out.append((AFTER.get((at, "u"), AFTER.get((at, "a"))), cost + costs.insert, letters + "I"))
    return out


@lru_cache(maxsize=256)
def edges(initial: str, must_go: bool, truncated: bool, costs: Costs) -> list[tuple[int, int, int, int]]:
    """from, to, cost in its high place, digits: the least edge between each two states for a turn."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        for at, cost, letters in _inserted(state, costs):
            ends = [(at, cost + costs.delete, letters + "D")]
            if not must_go:
                extra = costs.truncated if truncated else 0
                if (at, initial) in AFTER:
                    ends.append((AFTER[at, initial], cost + costs.keep + extra, letters + "K"))
                ends += [(AFTER[at, x], cost + costs.rerole + extra, letters + "R") for x in "ua" if (at, x) in AFTER]
            for to, total, said in ends:
                edge = (total, _number(said))
                best[state, to] = min(best.get((state, to), edge), edge)
    return [(a, b, cost << _HIGH, digits) for (a, b), (cost, digits) in best.items()]


@dataclass
class Turn:
    turn: int | None
    role: str
    text: str
    fault: str


class Repair:
    """One conversation, turn by turn. add and end give (edit, new role, turn or None) of what is decided."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs
        self.values = {START: 0}
        self.said: list[list[str]] = [[]]  # letters of each turn that waits, by rank
        self.waiting: list[Turn] = []
        self.n = 0
        self.state = START  # of what is handed on

    def add(self, turn: Turn) -> Iterator[tuple[str, str, Turn | None]]:
        self.waiting.append(turn)
        place = BITS * DIGITS * (TURNS - self.n)
        values: dict[int, int] = {}
        for a, b, cost, digits in edges(turn.role[:1], turn.fault in ("blank", "duplicate"), turn.fault == "truncated", self.costs):
            if a in self.values:
                weight = self.values[a] + cost + (digits << place)
                if b not in values or weight < values[b]:
                    values[b] = weight
        self.values = values
        self.n += 1
        if self.n == TURNS:
            self._rank()
            yield from self._agreed()

    def end(self) -> Iterator[tuple[str, str, Turn | None]]:
        place = BITS * DIGITS * (TURNS - self.n)
        ends = [value + (cost << _HIGH) + (_number(letters) << place) for state, value in self.values.items() for at, cost, letters in _inserted(state, self.costs) if at in (START, ASSISTANT)]
        self.values = {START: min(ends)}
        self.n += 1
        self._rank()
        yield from self._agreed()

    def _rank(self) -> None:
        """Read the digits of each value into letters, and put the rank of its audit in their stead. Of two states the worse one goes if whatever follows it could follow the other for less."""
        v, c = self.values, self.costs
        cost = {state: value >> _HIGH for state, value in v.items()}
        if ASSISTANT in v:
            for state, extra in ((START, max(0, c.delete - c.keep)), (SYSTEM, 0)):  # a system turn kept later would be deleted instead
                if state in v and cost[ASSISTANT] + extra < cost[state]:
                    del v[state]
        said = []
        for value in sorted({x & (1 << _HIGH) - 1 for x in v.values()}):
            letters = [_letters(value >> BITS * DIGITS * (TURNS - i) & (1 << BITS * DIGITS) - 1) for i in range(self.n)]
            said.append((value, self.said[value >> _LOW] + letters))
        ranks = {value: rank for rank, (value, _) in enumerate(said)}
        self.values = {state: value >> _HIGH << _HIGH | ranks[value & (1 << _HIGH) - 1] << _LOW for state, value in v.items()}
        self.said = [letters for _, letters in said]
        self.n = 0

    def _agreed(self) -> Iterator[tuple[str, str, Turn | None]]:
        """Hand on the turns on whose letters all paths agree."""
        first, k = self.said[0], 0
        while k < len(first) and all(x[k] == first[k] for x in self.said):
            k += 1
        for i, letters in enumerate(first[:k]):
            turn = self.waiting[i] if i < len(self.waiting) else None  # after the last turn inserts may stand alone
            for x in letters:
                role = ""
                if x == "K":
                    self.state, role = AFTER[self.state, turn.role[:1]], turn.role
                elif x in "IR":
                    self.state = USER if self.state != USER else ASSISTANT
                    role = ROLES[self.state]
                yield x, role, None if x == "I" else turn
        self.waiting = self.waiting[k:]
        self.said = [x[k:] for x in self.said]


def _letters(digits: int) -> str:
    return "".join(LETTERS[digits >> BITS * i & (1 << BITS) - 1] for i in reversed(range(DIGITS))).rstrip()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 makes its role user. A null in the key, role or text is one space; conv_id and turn stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, nth (among equal roles and texts), fault: a turn's first fault (blank, duplicate, truncated) or an empty text.

    A duplicate has the role and text of an earlier turn; they are told apart by their SHA-256, so that a conversation of
    any size is dealt to many tasks here. Equal turns are copies of each other, whichever comes first.
    """
    digest = F.sha2(F.encode(F.concat_ws(":", F.length("role"), "role", "text"), "UTF-8"), 256)
    seen = Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", digest)
    rows = rows.withColumn("nth", F.row_number().over(seen))
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "nth", fault.alias("fault"))


EDIT_SCHEMA = "conv_id long, edit string, turn long, role_was string, role string, text string, fault string"


def repaired(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each edit, in order within each conversation and partition: conv_id, edit (Keep, Rerole, Delete, Insert by initial), turn, role_was, role (null if deleted), text, fault.

    turns: conv_id, turn, role, text (null: one space). A conversation's turns are taken by turn, nulls first; equal
    turns by role and text. A role without letters can't be kept. Turns whose edit still depends on later ones are held
    in memory, usually a few; no other part of a conversation is. A null conv_id is a conversation of its own; an empty
    table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, repair = None, None

        def take(conv_id, edits) -> None:
            for edit, role, turn in edits:
                out.append((conv_id, edit, None, None, role, "", "") if turn is None else (conv_id, edit, turn.turn, turn.role, role or None, turn.text, turn.fault))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv_id, turn, role, text, fault in zip(*columns, strict=True):
                if repair is None or conv_id != current:
                    if repair is not None:
                        take(current, repair.end())
                    current, repair = conv_id, Repair(costs)
                take(conv_id, repair.add(Turn(turn, role, text, fault)))
            if out:
                yield _batch(out)
                out = []
        if repair is not None:
            take(current, repair.end())
            yield _batch(out)

    rows = with_faults(turns).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "fault", "nth")
    order = (F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("nth"))
    return rows.repartition("conv_id").sortWithinPartitions(*order).drop("nth").mapInArrow(run, EDIT_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "edit", "turn", "role_was", "role", "text", "fault"]
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


DIGEST_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Digest:
    """What a conversation's edits add up to; the repaired text is hashed as it comes."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.sha, self.letters, self.kept = costs, hashlib.sha256(), [], 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.before, self.least, self.last = None, None, None

    def add(self, edit: str, turn: int | None, role_was: str | None, role: str | None, text: str, fault: str) -> None:
        c = self.costs
        self.letters.append(edit)
        self.cost += {"K": c.keep, "R": c.rerole, "D": c.delete, "I": c.insert}[edit] + (c.truncated if fault == "truncated" and edit != "D" else 0)
        if role is not None:
            self.sha.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
            self.kept += 1
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before[:1] + role_was[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role_was
        if turn is not None:  # turns come in order
            self.turns += turn != self.last
            self.least = turn if self.least is None else self.least
            self.last = turn

    def row(self, conv_id: int | None) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest())


def repair_digest(edits: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each conversation of repaired(), whose partitions and order it relies on: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, out = None, None, []
        for batch in batches:
            for conv_id, *edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv_id != current:
                    if digest is not None:
                        out.append(digest.row(current))
                    current, digest = conv_id, Digest(costs)
                digest.add(*edit)
            if len(out) >= 1000:
                yield _digests(out)
                out = []
        if digest is not None:
            out.append(digest.row(current))
        if out:
            yield _digests(out)

    return edits.mapInArrow(run, DIGEST_SCHEMA)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """Each original conv_id with the digest of its damaged and then repaired turns; one without turns after the damage has zeros, an empty audit and the empty text's hash. Odd rows as in damaged and repaired."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_digest(repaired(damaged(conversations))).withColumnRenamed("conv_id", "found_id")
    rows = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same by a recursive query over (cost, audit) pairs.
ORACLE = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, (SELECT unnest([1, 2]) AS c) WHERE kind <> 0 AND (c = 1 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d)),
r AS (SELECT *, role[1] AS x, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
ins(q, m, c, l) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (2, 2, 10, 'II'), (3, 3, 0, ''), (3, 2, 5, 'I'), (3, 3, 10, 'II')),
act(m, q2, x, c, l) AS (VALUES (0, 0, NULL, 2, 'D'), (1, 1, NULL, 2, 'D'), (2, 2, NULL, 2, 'D'), (3, 3, NULL, 2, 'D'), (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'), (3, 2, 'u', 0, 'K'), (0, 2, NULL, 1, 'R'), (1, 2, NULL, 1, 'R'), (2, 3, NULL, 1, 'R'), (3, 2, NULL, 1, 'R')),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0, 'a': ''} AS v FROM r GROUP BY conv_id
 UNION ALL SELECT dp.conv_id, dp.i + 1, act.q2, min({'c': dp.v.c + ins.c + act.c + CASE WHEN act.l <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END, 'a': dp.v.a || ins.l || act.l})
 FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN ins ON ins.q = dp.q JOIN act ON act.m = ins.m AND (act.x IS NULL OR act.x = r.x) WHERE act.l = 'D' OR r.fault NOT IN ('blank', 'duplicate') GROUP BY dp.conv_id, dp.i + 1, act.q2),
s AS (SELECT conv_id, max(i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
best AS (SELECT dp.conv_id, min({'c': v.c + ins.c, 'a': v.a || ins.l}) AS v FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.i JOIN ins ON ins.q = dp.q AND ins.m IN (0, 3) GROUP BY dp.conv_id),
e AS (SELECT r.conv_id, r.i, r.role, r.text, substr(v.a, r.i, 1) AS l, row_number() OVER (PARTITION BY r.conv_id ORDER BY r.i) AS p, first_value(r.x || substr(v.a, r.i, 1)) OVER (PARTITION BY r.conv_id ORDER BY r.i) = 'sK' AS s FROM r JOIN best ON best.conv_id IS NOT DISTINCT FROM r.conv_id WHERE substr(v.a, r.i, 1) <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (p - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS h FROM e GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""
