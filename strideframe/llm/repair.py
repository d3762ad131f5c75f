"""Conversation structure repair: the cheapest edits of each conversation, decided by one integer minimum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: Digits of the audit letters in the order of ASCII; 0 pads the end, so a prefix is smaller than what goes on.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
DIGIT = 3  # bits of a digit
START, SYSTEM, USER, ASSISTANT = range(4)  # what the kept rows end in
#: The turn that may follow, when it is free to choose.
FREE = (USER, USER, ASSISTANT, USER)
#: Where a kept row with that initial leads.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows (role initial, fault); of equal costs the ASCII-least audit.

    A weight is one integer: the cost in its high digits, below it a fixed number of places for the audit's letters,
    filled from the highest with zeros behind the last.  A letter put before a suffix shifts the suffix by one place,
    so the minimum of integers over the edits of row i and what follows decides costs and ties at once, from the last
    row to the first over four states.  The winner's digits are the audit.
    """
    places = DIGIT * (3 * len(rows) + 2)
    low, top = (1 << places) - 1, places - DIGIT

    def put(letter: str, cost: int, rest: int) -> int:
        return (((rest >> places) + cost) << places) | (LETTERS[letter] << top) | ((rest & low) >> DIGIT)

    def with_inserts(plain: list[int | None]) -> list[int]:
        """Two rows at most are inserted at a place: a third leads to a state that was there before."""
        out = []
        for state in range(4):
            one, two = FREE[state], FREE[FREE[state]]
            options = [plain[state], *(put("I", INSERT, plain[x]) for x in (one,) if plain[x] is not None)]
            options += [put("I", INSERT, put("I", INSERT, plain[two]))] if plain[two] is not None else []
            out.append(min(x for x in options if x is not None))
        return out

    best = with_inserts([0, None, None, 0])
    for initial, fault in reversed(rows):
        plain = []
        for state in range(4):
            options = [put("D", DELETE, best[state])]
            if fault not in (BLANK, DUPLICATE):
                more = UNFINISHED if fault == TRUNCATED else 0
                if initial in KEEP[state]:
                    options.append(put("K", more, best[KEEP[state][initial]]))
                options.append(put("R", REROLE + more, best[FREE[state]]))
            plain.append(min(options))
        best = with_inserts(plain)
    digits = f"{best[START] & low:0{places // DIGIT}o}".rstrip("0")
    return best[START] >> places, digits.translate(str.maketrans("1234", "DIKR"))


class _Repaired:
    """SHA-256 of the repaired rows, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.rows = audit, 0, START, hashlib.sha256(), 0

    def _add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.rows else "") + role + ":" + text).encode())
        self.rows += 1

    def _free(self) -> str:
        self.state = FREE[self.state]
        return NAMES[self.state]

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add(self._free(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state][role[:1]]
            self._add(role, text)
        elif letter == "R":
            self._add(self._free(), text)

    def end(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def _fault(text: Column) -> tuple[Column, Column]:
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of `rows` (see `repair`).

    Rows of a conversation pass in order; what is held of them is a role initial, a fault and a 128-bit identity.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank, cut = _fault(F.col("text"))
    same = F.concat(F.hex(F.xxhash64("role", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "role", "text")))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    slim = dealt.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), same.alias("same"))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def closed(conv, first, last, distinct: int, marks: list[tuple[str, int]]) -> tuple:
        gaps = last - first + 1 - distinct if distinct else 0
        faults = [f for _, f in marks]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marks, marks[1:]))
        return (conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *cheapest(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, last, distinct, marks, seen, out, begun = None, None, None, 0, [], set(), [], False
        for b in batches:
            for c, turn, initial, blank, cut, same in zip(*(x.to_pylist() for x in b.columns)):
                if not begun or c != conv:
                    if begun:
                        out.append(closed(conv, first, last, distinct, marks))
                    conv, first, last, distinct, marks, seen, begun = c, None, None, 0, [], set(), True
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
                marks.append((initial, BLANK if blank else DUPLICATE if same in seen else TRUNCATED if cut else 0))
                seen.add(same)
            if len(out) > 1000:
                yield _batches(out, names, [b.schema.field(0).type, *[pa.int64()] * 6, pa.string()])
                out = []
        if begun:
            out.append(closed(conv, first, last, distinct, marks))
            yield _batches(out, names, [b.schema.field(0).type, *[pa.int64()] * 6, pa.string()])

    return slim.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_hashes(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The columns of `decided` (`audits`) and repaired_sha256; a conversation's rows follow its decision, texts are not held."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    empty = {f: F.lit(None) for f in ("role", "text")}
    heads = decided.withColumns({"part": F.lit(0), "turn": F.lit(None).cast(rows.schema["turn"].dataType), **empty})
    both = heads.unionByName(rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("part")), allowMissingColumns=True)
    names = decided.columns
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select(*names, "part", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at, out, kinds = None, None, [], []
        for b in batches:
            kinds = kinds or [b.schema.field(c).type for c in names]
            for *values, part, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if part == 0:
                    if head:
                        out.append((*head, at.end()))
                    head, at = values, _Repaired(values[-1])
                else:
                    at.row(role, text)
            if len(out) > 1000:
                yield _batches(out, [*names, "repaired_sha256"], [*kinds, pa.string()])
                out = []
        if head:
            yield _batches([*out, (*head, at.end())], [*names, "repaired_sha256"], [*kinds, pa.string()])

    return dealt.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation: one row for each distinct conv_id of `convs`.

    `rows` has conv_id, turn (a number), role and text; rows are taken by turn, null first, then role and text, and rows
    that are equal stand side by side.  The roles of repaired rows spell `(s?(ua)+)?` by their initials.  Blank rows and
    those whose role and text came before are deleted (4), others may be kept (0), get another role (3) or be deleted;
    a user or assistant row may be inserted anywhere (3); a truncated row that stays costs 3.  A role without initial or
    with another one cannot be kept.  A null conv_id is a conversation of its own; a conversation of `convs` without rows
    has zeros, an empty audit and the hash of the empty string; an empty `convs` gives an empty result.

    Two passes: one decides by small marks of the rows, one hashes the repaired texts as they come by.  A conversation is
    one sequence, so its marks and its audit, some 100 bytes a row, lie in one task; the weights grow with its length.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = repaired_hashes(rows, audits(rows)).withColumnRenamed("conv_id", "_found")
    every = convs.select("conv_id").distinct()
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").drop("_found").withColumns({**zeros, **empty})


def damage(rows: DataFrame, share: int = 20) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv_id:turn` modulo `share`: 0 is dropped, 1 loses its text, 2 its
    `[.!?]`, 3 comes twice, 4 becomes a user's.  Null parts count as one space; conv_id, turn, role and text are returned.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"),
                       (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % share).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")
