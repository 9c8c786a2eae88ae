"""Repair of conversation structure with square-root checkpoints (operator 13).

Wanted are the cheapest edits of a conversation's rows (keep 0, new role 1, delete 2, insert 5; a
truncated row that stays adds 5; blank and repeated rows have to go) after which the roles read
``(system? (user assistant)+)?``; of equally cheap ones the ASCII-least string of edit initials.

Four states say what was read last: nothing, system, user, assistant. A row of one of twelve kinds is
a 4x4 matrix of costs over (min, +), inserts before it included. A conversation of n rows is cut into
blocks of sqrt(n) rows (64 at least). Then

1. every block after the first is multiplied out to one matrix, blocks in parallel;
2. a walk back over a conversation's blocks gives the cost vector at the end of each: the
   checkpoints, the only vectors that are stored;
3. every block recomputes its inner vectors from its checkpoint and walks forward through the tight
   edits, from each state it may be entered in, blocks in parallel;
4. a walk forward over the blocks picks the entered state of each.

So one group holds at most sqrt(n) rows or sqrt(n) blocks. Only the last pass, SHA-256 over the
repaired rows, reads a conversation in one task: the hash is sequential. It streams the rows, cut
into pieces of ``PIECE`` characters, and keeps nothing but the state of the hash. The edits of one
conversation are one string in the result.

Defined results: NULL in role or text is one space (so a NULL text is blank), NULL in conv_id or turn
is one space in the hashed key; rows without conv_id are one conversation; rows go by turn (NULL first),
then by a hash of role and text, so repeated rows are neighbours; a conversation all of whose rows
are lost has zeros, no edits and the hash of nothing; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import shared_table
from trellis.llm.turn_order import numbered

BLOCK_ROWS = 64
#: cells (blocks times rows) that are computed at once in a task
CELLS = 250_000
#: characters of a text that travel in one row
PIECE = 8192

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Whitespace and the marks that end a sentence.
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])  # the role an insert or a new role gives, by state
FAR = np.int64(1 << 40)
#: kinds of rows: 3 * (system, user, assistant, other) + (sound, to be deleted, truncated); PAD fills up a block
PAD = 12


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _edit_costs() -> tuple[np.ndarray, np.ndarray]:
    """The matrices of the kinds (the last for PAD) and the vector after the last row."""
    insert = np.full((4, 4), FAR)
    np.fill_diagonal(insert, 0)
    for q in range(4):
        insert[q, NEXT[q]] = min(insert[q, NEXT[q]], INSERT)
    insert = _times(insert, insert)
    kinds = np.full((PAD + 1, 4, 4), FAR)
    np.fill_diagonal(kinds[PAD], 0)
    for kind in range(PAD):
        role, fault = SYSTEM + kind // 3, kind % 3
        extra = TRUNCATED if fault == 2 else 0
        for q in range(4):
            kinds[kind, q, q] = DELETE
            if fault != 1:
                kinds[kind, q, NEXT[q]] = min(kinds[kind, q, NEXT[q]], REROLE + extra)
                if KEPT[role][q]:
                    kinds[kind, q, role] = min(kinds[kind, q, role], KEEP + extra)
        kinds[kind] = _times(insert, kinds[kind])
    end = np.array([0, FAR, FAR, 0])
    return kinds, (insert + end).min(axis=1)


#: from which states a row of a role (system, user, assistant, other) can be kept
KEPT = {SYSTEM: [True, False, False, False], USER: [True, True, False, True],
        ASSISTANT: [False, False, True, False], ASSISTANT + 1: [False] * 4}
COSTS, END = _edit_costs()


# ------------------------------------------------------------------ rows

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: ``c`` (conversation as text), ``turn, role, text, m`` (hash of role and text)."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat(name, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        name.alias("c"), F.col("turn").cast("long").alias("turn"), harm.alias("harm"),
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"))
    return rows.where("harm != 0").select(
        "c", "turn", "role", "text", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("m"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _kinds(rows: DataFrame) -> DataFrame:
    """``c, turn, m, pos, rows, fault, kind`` of every row; faults blank, duplicate, truncated or none."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    short = rows.select("c", "turn", "m", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"),
                        (~F.substring(body, -1, 1).isin(*STOPS)).alias("cut"))
    at = shared_table(numbered(short, "c", "turn", ["m"]), "repair-rows")
    firsts = at.groupBy(F.col("c").alias("fc"), "m").agg(F.min("_pos").alias("first")).select("fc", "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    fault_no = F.when(fault == "truncated", 2).when(fault.isNotNull(), 1).otherwise(0)
    role_no = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return at.join(firsts, (F.col("c") == F.col("fc")) & (F.col("_pos") == F.col("first")), "left").select(
        "c", "turn", "m", F.col("_pos").alias("pos"), F.col("_rows").alias("rows"), fault.alias("fault"),
        F.char(F.lit(65) + 3 * role_no + fault_no).alias("kind"))


def _blocks(kinds: DataFrame) -> DataFrame:
    """One row a block: the kinds of its rows as a string, counts of faults, the place of its first row."""
    length = F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.sqrt("rows")))
    placed = kinds.withColumn("block", F.floor((F.col("pos") - 1) / length)).withColumn("blocks", F.ceil(F.col("rows") / length))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"])
    faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    return placed.groupBy("c", "block", "blocks").agg(
        F.concat_ws("", in_order).alias("kinds"), *faults, F.min(F.struct("turn", "m")).alias("place"))


# ------------------------------------------------------------------ blocks

def _groups(kinds: list[str]):
    """Numbers of blocks and their kinds as one padded array, blocks of like length together."""
    order = sorted(range(len(kinds)), key=lambda i: len(kinds[i]))
    while order:
        width = len(kinds[order[-1]])
        take = max(1, CELLS // max(width, 1))
        picked, order = order[-take:], order[:-take]
        cells = np.full((len(picked), width), PAD, np.int64)
        for r, i in enumerate(picked):
            cells[r, :len(kinds[i])] = np.frombuffer(kinds[i].encode(), np.uint8).astype(np.int64) - 65
        yield np.array(picked), cells


def _multiplied(batches):
    """Blocks with their matrix (none for the first, nobody asks for it)."""
    for pdf in batches:
        matrix = [None] * len(pdf)
        later = np.flatnonzero(pdf.block.to_numpy() > 0)
        for picked, cells in _groups(list(pdf.kinds.iloc[later])):
            product = np.broadcast_to(COSTS[PAD], (len(picked), 4, 4))
            for j in range(cells.shape[1] - 1, -1, -1):
                product = _times(COSTS[cells[:, j]], product)
            for i, p in zip(picked, product):
                matrix[later[i]] = p.ravel().tolist()
        yield pdf.assign(matrix=pd.Series(matrix, dtype=object, index=pdf.index))


def _checkpointed(batches):
    """Blocks, last ones first, with the cost vector at their end."""
    conv, vector = None, END
    for pdf in batches:
        ends = []
        for c, matrix in zip(pdf.c, pdf.matrix):
            if c != conv:
                conv, vector = c, END
            ends.append(vector.tolist())
            if matrix is not None:
                vector = (np.asarray(matrix, np.int64).reshape(4, 4) + vector).min(axis=1)
        yield pdf.drop(columns="matrix").assign(end=pd.Series(ends, dtype=object, index=pdf.index))


def _vectors(cells: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The cost vectors before every row of the blocks, and the given ones after the last."""
    out = np.empty((len(cells), cells.shape[1] + 1, 4), np.int64)
    out[:, -1] = end
    for j in range(cells.shape[1] - 1, -1, -1):
        out[:, j] = (COSTS[cells[:, j]] + out[:, j + 1][:, None, :]).min(axis=2)
    return out


def _tight(cells: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk the blocks from ``state``: the letters (up to two inserts and an edit a row) and the states at their ends."""
    n, width = cells.shape
    letters, at, state = np.zeros((n, width, 3), np.uint8), np.arange(n), state.copy()
    kept = np.array([KEPT[r] for r in (SYSTEM, USER, ASSISTANT, ASSISTANT + 1)])
    for j in range(width):
        kind, now, then = cells[:, j], cost[:, j], cost[:, j + 1]
        open_ = kind != PAD
        for i in range(3):
            delete = open_ & (now[at, state] == DELETE + then[at, state])
            insert = open_ & ~delete & (now[at, state] == INSERT + now[at, NEXT[state]])
            edit = open_ & ~delete & ~insert
            role = np.minimum(kind // 3 + SYSTEM, ASSISTANT)
            extra = np.where(kind % 3 == 2, TRUNCATED, 0)
            keep = edit & (kind % 3 != 1) & kept[np.minimum(kind // 3, 3), state] & (now[at, state] == KEEP + extra + then[at, role])
            rerole = edit & ~keep
            for mark, which in ((b"D", delete), (b"I", insert), (b"K", keep), (b"R", rerole)):
                letters[which, j, i] = mark[0]
            state = np.where(insert | rerole, NEXT[state], np.where(keep, role, state))
            open_ = insert
    return letters, state


def _walked(batches):
    """Blocks with edits, end state and cost from every state they may be entered in, and their illegal neighbours."""
    legal = {(0, 1), (1, 2), (2, 1)}
    for pdf in batches:
        n = len(pdf)
        edits, exits, costs = ([[None] * 4 for _ in range(n)] for _ in range(3))
        kinds, ends, block = list(pdf.kinds), list(pdf.end), pdf.block.to_numpy()
        for picked, cells in _groups(kinds):
            cost = _vectors(cells, np.array([ends[i] for i in picked], np.int64))
            for q in range(4):
                some = np.arange(len(picked)) if q == START else np.flatnonzero(block[picked] > 0)
                if not len(some):
                    continue
                letters, state = _tight(cells[some], cost[some], np.full(len(some), q))
                for k, s in enumerate(some):
                    i = picked[s]
                    edits[i][q] = letters[k].tobytes().replace(b"\0", b"").decode()
                    exits[i][q], costs[i][q] = int(state[k]), int(cost[s, 0, q])
        roles = [[(ord(x) - 65) // 3 for x in k] for k in kinds]
        yield pd.DataFrame({
            "c": pdf.c, "block": pdf.block, "blocks": pdf.blocks, "edits": edits, "exits": exits, "cost": [x[START] for x in costs],
            "illegal": [sum(p not in legal for p in zip(r, r[1:])) for r in roles],
            "first": [r[0] for r in roles], "last": [r[-1] for r in roles],
            "blank": pdf.blank, "duplicate": pdf.duplicate, "truncated": pdf.truncated, "place": pdf.place})


def _chained(batches):
    """Blocks in order, each with the edits from the state it is entered in; the last one's inserts at the end."""
    legal = {(0, 1), (1, 2), (2, 1)}
    conv, state, last = None, START, None
    for pdf in batches:
        picked, seams = [], []
        for c, block, blocks, edits, exits, first, final in zip(pdf.c, pdf.block, pdf.blocks, pdf.edits, pdf.exits, pdf["first"], pdf["last"]):
            if c != conv:
                conv, state, last = c, START, None
            chosen, state = edits[state], int(exits[state])
            seams.append(int(last is not None and (last, first) not in legal))
            last, tail = final, state
            while block == blocks - 1 and END[tail]:
                chosen, tail = chosen + "I", NEXT[tail]
            picked.append(chosen)
        out = pdf[["c", "block", "blank", "duplicate", "truncated", "place"]].copy()
        first_block = pdf.block.to_numpy() == 0
        yield out.assign(edits=picked, illegal=pdf.illegal.to_numpy() + np.array(seams, np.int64),
                         cost=np.where(first_block, pdf.cost.to_numpy(), 0))


BLOCK = "c string, block long, blocks long, kinds string, blank long, duplicate long, truncated long, place struct<turn:long,m:string>"
WALKED = ("c string, block long, blocks long, edits array<string>, exits array<int>, cost long, illegal long, first int, "
          "last int, blank long, duplicate long, truncated long, place struct<turn:long,m:string>")
CHAINED = "c string, block long, blank long, duplicate long, truncated long, place struct<turn:long,m:string>, edits string, illegal long, cost long"


def edit_blocks(blocks: DataFrame) -> DataFrame:
    """The cheapest edits of every block, from its kinds."""
    back = blocks.mapInPandas(_multiplied, BLOCK + ", matrix array<long>").repartition("c") \
        .sortWithinPartitions("c", F.col("block").desc()).mapInPandas(_checkpointed, BLOCK + ", end array<long>")
    ahead = back.mapInPandas(_walked, WALKED).repartition("c").sortWithinPartitions("c", "block")
    return ahead.mapInPandas(_chained, CHAINED)


# ------------------------------------------------------------------ repaired rows

class _Repaired:
    """SHA-256 of the repaired rows of one conversation, fed with edits and pieces of rows in order."""

    def __init__(self):
        self.sha, self.edits, self.at, self.state, self.any, self.writing = hashlib.sha256(), "", 0, START, False, False

    def _line(self, role: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":").encode("utf-8", "surrogatepass"))
        self.any = True

    def _given(self) -> str:
        self.state = int(NEXT[self.state])
        return "user" if self.state == USER else "assistant"

    def more(self, edits: str) -> None:
        self.edits, self.at = self.edits[self.at:] + edits, 0

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self._line(self._given())
            self.at += 1

    def row(self, part: int, role: str, text: str) -> None:
        if part == 0:
            self.inserts()
            edit = self.edits[self.at]
            self.at += 1
            self.writing = edit != "D"
            if edit == "K":
                self._line(role)
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            elif edit == "R":
                self._line(self._given())
        if self.writing:
            self.sha.update(text.encode("utf-8", "surrogatepass"))

    def done(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _hashed(batches):
    conv, work = None, None
    for pdf in batches:
        out = []
        for c, part, role, text, edits in zip(pdf.c, pdf.part, pdf.role, pdf.text, pdf.edits):
            if c != conv:
                if work is not None:
                    out.append((conv, work.done()))
                conv, work = c, _Repaired()
            if edits is not None:
                work.more(edits)
            else:
                work.row(part, role, text)
        yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
    if work is not None:
        yield pd.DataFrame([(conv, work.done())], columns=["c", "repaired_sha256"])


def _repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``c, repaired_sha256``: a block's edits come before its first row, rows in their order."""
    none = F.lit(None).cast("string")
    pieces = F.when(F.length("text") <= PIECE, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    # equal rows of a conversation are told apart, so that the pieces of one stay together
    told = rows.select("c", "turn", "m", "role", F.monotonically_increasing_id().alias("same"), F.posexplode(pieces).alias("part", "text"))
    lines = told.select("c", "turn", "m", F.lit(1).alias("what"), "same", "part", "role", "text", none.alias("edits"))
    marks = edits.select("c", F.col("place.turn").alias("turn"), F.col("place.m").alias("m"), F.lit(0).alias("what"),
                         F.col("block").alias("same"), F.lit(0).alias("part"), none.alias("role"), none.alias("text"), "edits")
    ordered = lines.unionByName(marks).repartition("c").sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "m", "what", "same", "part")
    return ordered.select("c", "part", "role", "text", "edits").mapInPandas(_hashed, "c string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the input: faults after damage, the cheapest edits and their cost,
    the hash of the repaired rows."""
    rows = damaged(conversations)
    blocks = shared_table(_blocks(_kinds(rows)), "repair-blocks")
    edits = shared_table(edit_blocks(blocks), "repair-edits")
    totals = edits.groupBy("c").agg(
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"])).alias("audit"))
    gaps = rows.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    convs = conversations.groupBy("conv_id").agg(F.lit(1).alias("_")).select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c"))
    zero: Column = F.lit(0).cast("long")
    out = convs.join(gaps, "c", "left").join(totals, "c", "left").join(_repaired(rows, edits), "c", "left")
    return out.select("conv_id", *[F.coalesce(x, zero).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
