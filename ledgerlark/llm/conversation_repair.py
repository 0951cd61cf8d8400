"""Conversation structure repair: error-correcting Earley parsing of roles, with delete, rerole and insert productions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clusters import cut

#: Costs of the error productions; a row that isn't whole and stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
KEPT, REROLED, DELETED, INSERTED = "KRDI"
LINK = 64

#: (s?(ua)+)? and an end as productions; terminals are the initials of roles, and the end.
GRAMMAR = (("All", ("Talk", "$")), ("Talk", ()), ("Talk", ("Turns",)), ("Talk", ("s", "Turns")), ("Turns", ("Pair",)), ("Turns", ("Turns", "Pair")), ("Pair", ("u", "a")))
TERMINALS = "sua$"
#: Roles that rows may be given, and that may be inserted.
ROLES = {"u": "user", "a": "assistant"}


class Path(NamedTuple):
    """The cheapest way to an item: its cost, its place among the ways that the last row left, and the letters since then.

    Ways that a row has left end in that row's letter, so none is the beginning of another, and of two
    ways of one cost the one that is less by (rank, letters) is less as a string, whatever follows both.
    """

    cost: int
    rank: int
    letters: str
    before: tuple | None  # (before, letters) of the earlier rows, as a linked list of strings of LINK letters

    def step(self, letter: str, cost: int) -> Path:
        return Path(self.cost + cost, self.rank, self.letters + letter, self.before)

    def linked(self) -> tuple:
        """The list with the letters at its end."""
        if self.before is None or len(self.before[1]) >= LINK:
            return self.before, self.letters
        return self.before[0], self.before[1] + self.letters


class Item(NamedTuple):
    """A production with a dot, the column that it began in, and the cheapest way here."""

    rule: int
    dot: int
    origin: Between
    path: Path


class Between(dict):
    """A chart's column: the items between two rows, one for each dotted production, that of the least (cost, audit)."""

    def add(self, item: Item, agenda: list[Item]) -> None:
        old = self.get(item[:2])
        if old is None or item.path[:3] < old.path[:3]:
            self[item[:2]] = item
            agenda.append(item)

    def close(self, agenda: list[Item]) -> None:
        """Predict, complete and insert until nothing changes; an insertion stays in the column."""
        while agenda:
            item = agenda.pop()
            if self[item[:2]] is not item:
                continue  # a cheaper one has come
            head, body = GRAMMAR[item.rule]
            if item.dot == len(body):
                for waiting in list(item.origin.values()):
                    right = GRAMMAR[waiting.rule][1]
                    if waiting.dot < len(right) and right[waiting.dot] == head:
                        self.add(Item(waiting.rule, waiting.dot + 1, waiting.origin, item.path), agenda)
            elif (symbol := body[item.dot]) in ROLES:
                self.add(Item(item.rule, item.dot + 1, item.origin, item.path.step(INSERTED, INSERT)), agenda)
            elif symbol not in TERMINALS:
                for number, (left, _) in enumerate(GRAMMAR):
                    if left == symbol:
                        self.add(Item(number, 0, self, item.path), agenda)


class Chart:
    """The chart of one conversation, row by row. Only the last column is held, and what its items began in.

    The grammar is linear, so items of one dotted production differ in their past alone and one of them, the cheapest, is enough.
    """

    def __init__(self):
        self.column = Between()
        agenda: list[Item] = []
        self.column.add(Item(0, 0, self.column, Path(0, 0, "", None)), agenda)
        self.column.close(agenda)

    def row(self, initial: str, lost: bool, truncated: bool) -> None:
        """Read a row by its role's initial. One that is ``lost`` (blank or a duplicate) has to be deleted."""
        stays = TRUNCATED if truncated else 0
        scanned: list[Item] = []
        for item in self.column.values():
            body = GRAMMAR[item.rule][1]
            if item.dot == len(body) or body[item.dot] not in TERMINALS:
                continue
            scanned.append(item._replace(path=item.path.step(DELETED, DELETE)))
            if not lost:
                if initial == body[item.dot]:
                    scanned.append(item._replace(dot=item.dot + 1, path=item.path.step(KEPT, stays)))
                if body[item.dot] in ROLES:
                    scanned.append(item._replace(dot=item.dot + 1, path=item.path.step(REROLED, stays + REROLE)))
        least: dict[tuple[int, int], Item] = {}
        for item in scanned:
            if item[:2] not in least or item.path[:3] < least[item[:2]].path[:3]:
                least[item[:2]] = item
        paths = {item.path[1:3]: item.path for item in least.values()}
        ranked = {key: (rank, paths[key].linked()) for rank, key in enumerate(sorted(paths))}
        self.column, agenda = Between(), []
        for item in least.values():
            rank, before = ranked[item.path[1:3]]
            self.column.add(item._replace(path=Path(item.path.cost, rank, "", before)), agenda)
        self.column.close(agenda)

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest whole parse."""
        path = self.column[0, 1].path  # the end is all that is missing
        parts, before = [path.letters], path.before
        while before is not None:
            before, letters = before
            parts.append(letters)
        return path.cost, "".join(reversed(parts))


#: Rows of a conversation whose parse is looked up by its roles and faults; longer ones are parsed row by row.
SHORT = 32


@lru_cache(maxsize=1 << 15)
def _short(rows: tuple[tuple[str, bool, bool], ...]) -> tuple[int, str]:
    chart = Chart()
    for row in rows:
        chart.row(*row)
    return chart.best()


REPORT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_KINDS = [pa.int64()] * 6 + [pa.string()]
_LEGAL = ("su", "ua", "au")
#: Characters of the audits, or rows, that are gathered before they leave a task.
_BATCH_CHARS, _BATCH_ROWS = 1 << 20, 4096


def _parsed(batches):
    """Arrow function: (conv_id, turn, initial, fault), a conversation's rows together and in order, to one row of its figures and edits."""
    kind, ids, rows, size = None, [], [], 0
    now, chart, waiting = batches, None, []  # no conversation yet
    counts, turns, least, last, before, illegal = {}, 0, None, None, None, 0

    def close() -> None:
        nonlocal size
        cost, audit = chart.best() if chart else _short(tuple(waiting))
        gaps = last - least + 1 - turns if turns else 0
        ids.append(now)
        rows.append((gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit))
        size += len(audit)

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        kind = batch.schema.types[0]
        for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is batches or conv != now:
                if now is not batches:
                    close()
                now, chart, waiting = conv, None, []
                counts, turns, least, last, before, illegal = dict.fromkeys("bdt", 0), 0, None, None, None, 0
            if fault == "absent":
                continue
            if turn is not None:
                least = turn if least is None else least
                turns += turn != last
                last = turn
            illegal += before is not None and before + initial not in _LEGAL
            before = initial
            if fault:
                counts[fault] += 1
            row = (initial, fault in ("b", "d"), fault == "t")
            if chart is None and len(waiting) < SHORT:
                waiting.append(row)
                continue
            if chart is None:
                chart = Chart()
                for each in waiting:
                    chart.row(*each)
            chart.row(*row)
        if size >= _BATCH_CHARS or len(rows) >= _BATCH_ROWS:
            yield out()
            ids, rows, size = [], [], 0
    if now is not batches:
        close()
    if rows:
        yield out()


def _given(rows: DataFrame, present: Column) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")), present.alias("present"))


_SPACE = " \t\n\x0b\x0c\r"


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def parse(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A conversation's rows (conv_id, turn, role, text) are taken by turn, nulls first, those of one turn by role and text. Each
    row's first fault counts: blank (no character but white space), duplicate (role and text stood before), truncated (the last
    character other than white space isn't one of . ! ?). ``gaps`` are the turns missing between the first and the last, ``illegal`` the
    neighbours whose roles' initials aren't su, ua or au. ``cost`` and ``audit`` are the cheapest edits, of equal ones the least
    string, that give roles as ``(s?(ua)+)?``: K keep (0), R other role (1), D delete (2; blank and duplicate rows have to go), I insert
    a row without text (5); a truncated row that stays costs 5 more.

    Rows of which ``present`` doesn't hold only name their conversation; one without others has zeros and an empty audit. A null
    role or text is empty; rows with a null conv_id are one conversation; repeated rows are duplicates; an empty table
    gives no rows; other columns are ignored. A conversation is dealt to one task, sorted there and streamed: the task holds one
    column of its chart and one letter a row.
    """
    given = _given(rows, F.lit(True) if present is None else F.coalesce(present, F.lit(False))).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))) > 1
    ends = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    fault = F.when(~F.col("present"), "absent").when(ends == "", "b").when(F.col("again"), "d").when(~ends.isin(".", "!", "?"), "t")
    ordered = given.withColumn("again", again).sortWithinPartitions("conv_id", *_order())
    kind = given.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")).mapInArrow(_parsed, REPORT.format(kind))


REPAIRED = "conv_id {0}, place long, turn long, role string, text string, edit string"


class Edits:
    """A conversation's edits, applied row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.want = audit, 0, 0, "u"

    def _out(self, turn: int | None, role: str, text: str, edit: str) -> tuple:
        self.want = "a" if role[:1] == "u" else "u"
        self.place += 1
        return self.place - 1, turn, role, text, edit

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == INSERTED:
            self.at += 1
            yield self._out(None, ROLES[self.want], "", INSERTED)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETED:
            yield self._out(turn, role if edit == KEPT else ROLES[self.want], text, edit)


def _repaired(batches):
    """Arrow function: a conversation's audit, then its rows in order, to its repaired rows."""
    now, edits, kind, rows, size = None, None, None, [], 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "turn", "role", "text", "edit"])

    for batch in batches:
        kind = batch.schema.types[0]
        for conv, audit, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                rows += [(now, *r) for r in edits.inserted()] if edits else []
                now, edits = conv, Edits(audit)
            else:
                rows += [(now, *r) for r in edits.row(turn, role, text)]
                size += len(text)
            if size >= _BATCH_CHARS or len(rows) >= _BATCH_ROWS:
                yield out()
                rows, size = [], 0
    rows += [(now, *r) for r in edits.inserted()] if edits else []
    if rows:
        yield out()


def repair(rows: DataFrame, report: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn, role, text, edit; a conversation's rows stand together, in order.

    ``report`` is what ``parse`` gives for the same rows; its audits are carried out. An inserted row has no turn and no text.
    """
    given = _given(rows, F.lit(True) if present is None else F.coalesce(present, F.lit(False))).where("present")
    both = given.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text").unionByName(report.select("conv_id", "audit"), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(F.asc("conv_id"), F.asc_nulls_last("audit"), *_order())
    return ordered.mapInArrow(_repaired, REPAIRED.format(given.schema["conv_id"].dataType.simpleString()))


def _digests(batches):
    """Arrow function: repaired rows, a conversation's together and in order, to (conv_id, repaired_sha256)."""
    kind, now, digest, done = None, None, None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])
    for batch in batches:
        kind = batch.schema.types[0]
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not place:
                done += [(now, digest.hexdigest())] if digest else []
                now, digest = conv, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if len(done) >= _BATCH_ROWS:
            yield out()
            done = []
    done += [(now, digest.hexdigest())] if digest else []
    if done:
        yield out()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): by the checksum of a row's place one in twenty each isn't present, has no text, lacks
    its . ! ?, stands twice, or is the user's. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    role = F.when(place == 4, "user").otherwise(text("role"))
    said = F.when(place == 1, "").when(place == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.explode(F.when(place == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), (place != 0).alias("present"), times.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    report = cut(parse(rows, F.col("present")))
    repaired = repair(rows, report, F.col("present")).select("conv_id", "place", "role", "text")
    digests = repaired.mapInArrow(_digests, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    empty = F.lit(hashlib.sha256().hexdigest())
    return report.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*report.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
