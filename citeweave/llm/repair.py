"""Conversation structure repair by Knuth's lightest derivations.

A conversation's rows are to be edited so that the initials of their roles read ``(s?(ua)+)?``. Repairs are deductions
over a weighted hypergraph. An item says that the rows from l to r take the conversation from one state to another; its
weight is (cost, audit), the audit being the initials of the edits in order. First deductions read one row: edits, and
what is inserted before it. Others let an item go on with the next stretch's, adding costs and appending its audit; the
last close a conversation that waits for a reply. The agenda pops the lightest item, which is then final, because every
rule is superior (a conclusion is no lighter than the item that goes on) and monotone: two audits over the same rows of
equal cost are never prefixes of each other, since each further edit that reads no row costs something.

Scale. Texts never meet the agenda: a row enters as one letter for its role and fault. Rows are sorted across the
cluster by conversation, turn, role and digest of the text, so that a conversation with a third of all rows is spread
over many tasks, and cut into blocks of ``BLOCK`` rows. Blocks of one conversation become tables of states, all in
parallel; joining tables is associative. Only letters of edits, which the audit of the result holds anyway, come together
for one conversation. The digest of a repaired conversation is sequential by definition: its rows stream through
one task in order, and only the audit and the running digest are held.

Defined results: null ids, turns, roles and texts read as one space; turns that are null come first; rows of one turn
are ordered by role and digest of the text; repeated rows are duplicates of the first. A conversation whose rows were
all dropped has zeros, an empty audit and the digest of nothing; an empty table gives an empty result. Roles with
another initial than s, u, a can be rerolled or deleted only. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

#: Neighbouring rows whose letters form one block.
BLOCK_BITS = 9
BLOCK = 1 << BLOCK_BITS
_SPACE = " \t\n\x0b\x0c\r"

#: Roles by class, and the class of roles that cannot be kept.
ROLES, OTHER = "sua", 3
#: Faults of a row: none, must go (blank or duplicate), truncated.
SOUND, GONE, TRUNCATED = range(3)

#: What has been written: nothing, the system's turn, the user's, or a whole exchange; and where a role leads.
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)

Weight = tuple[int, str]
Table = dict[tuple[int, int], Weight]


def lightest(axioms: Iterable[tuple[Weight, Hashable]], conclude: Callable[[Hashable, Weight, dict], Iterator[tuple[Weight, Hashable]]], goal: Hashable | None = None) -> dict[Hashable, Weight]:
    """The lightest weight of every derivable item, or of those up to the goal. ``conclude`` gives what follows from
    a final item together with items that were final before."""
    agenda = [(weight, item) for weight, item in axioms]
    heapify(agenda)
    final: dict[Hashable, Weight] = {}
    while agenda:
        weight, item = heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            break
        for more, head in conclude(item, weight, final):
            if head not in final:
                heappush(agenda, (more, head))
    return final


def _plus(a: Weight, b: Weight) -> Weight:
    return a[0] + b[0], a[1] + b[1]


@lru_cache(maxsize=64)
def _row_edits(letter: str) -> tuple[tuple[int, int, Weight], ...]:
    """Axioms of one row: state before, state after, lightest weight; roles inserted before the row included."""
    role, fault = divmod(ord(letter) - 65, 3)
    more = 1 if fault == TRUNCATED else 0

    def conclude(item, weight, final):
        read, state = item
        if read:
            return
        yield _plus(weight, (DELETE[1], DELETE[0])), (1, state)
        for to in "ua":
            if (state, to) in STEP:
                yield _plus(weight, (INSERT[1], INSERT[0])), (0, STEP[state, to])
                if fault != GONE:
                    yield _plus(weight, (REROLE[1] + more, REROLE[0])), (1, STEP[state, to])
        if fault != GONE and role != OTHER and (state, ROLES[role]) in STEP:
            yield _plus(weight, (KEEP[1] + more, KEEP[0])), (1, STEP[state, ROLES[role]])

    out = []
    for start in range(4):
        final = lightest([((0, ""), (0, start))], conclude)
        out += [(start, end, weight) for (read, end), weight in sorted(final.items()) if read]
    return tuple(out)


def _row_table(letter: str) -> Table:
    return {(a, z): weight for a, z, weight in _row_edits(letter)}


def join(left: Table, right: Table) -> Table:
    """The table of two neighbouring stretches: a left item goes on with every right one that begins where it ends."""

    def conclude(item, weight, final):
        side, a, z = item
        if side == "left":
            yield from ((_plus(weight, w), ("both", a, y)) for (x, y), w in right.items() if x == z)

    return {(a, z): w for (side, a, z), w in lightest([(w, ("left", *k)) for k, w in left.items()], conclude).items() if side == "both"}


def join_all(tables: list[Table]) -> Table:
    """All stretches in order, joined in a balanced way, so that audits are copied a logarithmic number of times."""
    while len(tables) > 1:
        tables = [join(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


@lru_cache(maxsize=20_000)
def block_table(letters: str) -> Table:
    """The lightest items over a block of rows, one letter a row."""
    return join_all([_row_table(x) for x in letters])


def close(table: Table) -> Weight:
    """The lightest whole repair: what lies open at the end gets its missing turns."""

    def conclude(item, weight, final):
        if item == "goal":
            return
        if item in (EMPTY, ANSWERED):
            yield weight, "goal"
        elif item == ASKED:
            yield _plus(weight, (INSERT[1], INSERT[0])), ANSWERED
        else:
            yield _plus(weight, (INSERT[1], INSERT[0])), ASKED

    return lightest([(w, z) for (a, z), w in table.items() if a == EMPTY], conclude, "goal")["goal"]


def _illegal(roles: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(roles, roles[1:])))


def _roles(letters: str) -> str:
    return "".join("suao"[(ord(x) - 65) // 3] for x in letters)


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after damage that depends on conversation and turn alone."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with their place ``at`` in the order of all rows, and a digest of the text."""
    marked = rows.withColumn("m", F.md5(F.col("text").cast("binary"))).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("m"), F.col("salt")]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id())


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, at, role class, fault (blank, duplicate, truncated or null: the first that holds) of ordered rows."""
    slim = rows.select("conv", "turn", "at", "role", "m", F.rtrim(F.col("text"), F.lit(_SPACE)).alias("t")).select(
        "conv", "turn", "at", "role", "m", (F.col("t") == "").alias("blank"), (~F.right("t", F.lit(1)).isin(".", "!", "?")).alias("truncated")
    )
    again = slim.groupBy("conv", "role", "m").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("m").alias("d"), "first")
    seen = slim.join(again, _same("conv", "c") & (F.col("role") == F.col("r")) & (F.col("m") == F.col("d")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    return seen.select("conv", "turn", "at", kind.alias("kind"), fault.alias("fault"))


_TABLE = "array<struct<a:int,z:int,cost:long,audit:string>>"


def repairs(found: DataFrame) -> DataFrame:
    """conv, cost, audit, illegal of the conversations whose rows' faults are given."""
    fault = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(SOUND)
    lettered = found.select("conv", F.shiftright("at", BLOCK_BITS).alias("block"), "at", F.char(65 + 3 * F.col("kind") + fault).alias("letter"))
    blocks = lettered.groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("letters"))

    def derive(batches):
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            tables = [[{"a": a, "z": z, "cost": c, "audit": t} for (a, z), (c, t) in block_table(x).items()] for x in letters]
            roles = [_roles(x) for x in letters]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            columns = [batch.column("conv"), batch.column("block"), pa.array(tables, kind), pa.array([_illegal(r) for r in roles], pa.int64()), pa.array([r[:1] for r in roles], pa.string()), pa.array([r[-1:] for r in roles], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "block", "table", "illegal", "first", "last"])

    derived = blocks.mapInArrow(derive, f"conv long, block long, table {_TABLE}, illegal long, first string, last string")
    whole = derived.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "illegal", "first", "last", "table"))).alias("blocks"))

    def finish(batches):
        for batch in batches:
            out = []
            for blocks in batch.column("blocks").to_pylist():
                tables = [{(x["a"], x["z"]): (x["cost"], x["audit"]) for x in b["table"]} for b in blocks]
                edges = sum(_illegal(x["last"] + y["first"]) for x, y in zip(blocks, blocks[1:]))
                out.append((*close(join_all(tables)), sum(b["illegal"] for b in blocks) + edges))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], ["conv", "cost", "audit", "illegal"])

    return whole.mapInArrow(finish, "conv long, cost long, audit string, illegal long")


class Rewriter:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        # The repaired roles are a system turn or none, then exchanges: the number of turns tells which.
        self.left = len(audit) - audit.count("D")

    def _role(self) -> str:
        self.left -= 1
        return "user" if self.left % 2 else "assistant"

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            written = self._role()
            yield role if edit == "K" else written, text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in order, its audit first, each conversation in one task."""
    heads = audits.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv", "at", "role", "text").unionByName(heads)
    return both.repartition("conv").sortWithinPartitions("conv", "at")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, text: the repaired conversations, row by row."""

    def run(batches):
        now, number = None, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "role", "text"))):
                if at < 0:
                    if now is not None:
                        out += [(now[0], number + i, *x) for i, x in enumerate(now[1].rest())]
                    now, number = (conv, Rewriter(text)), 0
                else:
                    for x in now[1].row(role, text):
                        out.append((conv, number, *x))
                        number += 1
            yield _turns(out)
        if now is not None:
            yield _turns([(now[0], number + i, *x) for i, x in enumerate(now[1].rest())])

    return _stream(rows, audits).mapInArrow(run, "conv_id long, turn_no long, role string, text string")


def _turns(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn_no", "role", "text"])


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the conversations with rows."""

    class Digest:
        def __init__(self, conv, audit: str):
            self.conv, self.rewriter, self.hash, self.any = conv, Rewriter(audit), hashlib.sha256(), False

        def add(self, turns) -> None:
            for role, text in turns:
                self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
                self.any = True

        def row(self) -> tuple:
            self.add(self.rewriter.rest())
            return self.conv, self.hash.hexdigest()

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["conv", "repaired_sha256"])

    def run(batches):
        now: Digest | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "role", "text"))):
                if at < 0:
                    if now is not None:
                        out.append(now.row())
                    now = Digest(conv, text)
                else:
                    now.add(now.rewriter.row(role, text))
            yield made(out)
        if now is not None:
            yield made([now.row()])

    return _stream(rows, audits).mapInArrow(run, "conv long, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    rows = materialize(ordered(damage(conversations)), "repair-rows")
    found = materialize(faults(rows), "repair-faults")
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    counts = found.groupBy("conv").agg(F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    edits = materialize(repairs(found), "repair-edits")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (counts, edits, digests(rows, edits)):
        out = out.join(part, _same("conv_id", "conv"), "left").drop("conv")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
