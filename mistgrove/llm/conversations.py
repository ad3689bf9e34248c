"""Repair of conversations: the cheapest edits that leave turns in the order `(s?(ua)+)?`, and of these the least audit.

A conversation is cut into pieces of consecutive rows. A piece is one 4 x 4 matrix of least costs between the states in
which its rows may be entered and left (nothing yet, after a system turn, after a user turn, after an assistant turn);
matrices combine as sums and minima, so pieces of any conversation, however long, are solved side by side and joined by doubling.
With the cost of all that follows known, every node (row, state) of a piece has its optimal arcs. Nodes are ranked by the
letters of their audits, 1, 2, 4, ... of them at a time, by the ranks and pointers of the round before; an arc's letter and its
target's rank choose among a node's arcs, and the doubled pointers gather the nodes of the least path.

States: 0 nothing, 1 system, 2 user, 3 assistant. A row's code is its role class (0 system, 1 user, 2 assistant, 3 other,
by the role's first letter) plus four times its fault (0 none, 1 blank, 2 duplicate, 3 truncated).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mistgrove.llm.common import attach, remainder, stored

#: Rows of one piece, as a power of two; the bound on what a group of rows holds.
PIECE_BITS = 12
#: Rows handled at once by a task.
HELD = 1 << 16

# Costs of the edits, of an undeleted truncated row, and letters of the audit.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LETTERS = np.frombuffer(b" DIKR", np.uint8)
#: What a conversation that ends in a state still costs, and the inserts that end it.
ENDING, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")

FAR = 1 << 60
#: The state an inserted turn, or one given the role that is due, leads to.
ONWARD = np.array([2, 2, 3, 2])
#: The state that a kept turn of each class leads to, by class and state; -1: not allowed.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])

SOLVED = "at long, illegal long, first int, last int, matrix array<long>"
PATHS = "at long, cost array<long>, leaves array<int>, audits array<string>"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def damaged(talks: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, was_role, was_text, copy) after the damage that crc32 of `conv_id:turn` deals out.

    Remainder 0 of 20 drops a row, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    blank = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    rows = talks.select("conv_id", "turn", F.coalesce("role", blank).alias("was_role"), F.coalesce("text", blank).alias("was_text"),
                        remainder(F.concat_ws(":", *named), 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("was_text", ".!?", "")).otherwise(F.col("was_text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("was_role")).alias("role"), text.alias("text"),
                       "was_role", "was_text", F.explode(copies).alias("copy"))


def in_order() -> list[Column]:
    """The order of a conversation's rows: by turn, nulls first; rows of one turn by role, then by MD5 of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("was_role"), F.md5(F.col("was_text").cast("binary")), F.col("copy")]


def role_class(role: Column) -> Column:
    start = F.substring(role, 1, 1)
    return F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)


def numbered(rows: DataFrame) -> DataFrame:
    """Columns conv_id, turn, pos (the order of all rows), kind (role class), key (of equal role and text), blank, cut."""
    key = F.md5(F.concat_ws("\x00", F.col("conv_id").isNull().cast("string"), F.col("conv_id").cast("string"), F.length("role").cast("string"), "role", "text").cast("binary"))
    narrow = rows.select(
        "conv_id", *[c.alias(f"_{i}") if i else F.col("turn") for i, c in enumerate(in_order())], role_class(F.col("role")).alias("kind"), F.unhex(key).alias("key"),
        (~F.col("text").rlike(NOT_SPACE)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")).alias("cut"),
        F.monotonically_increasing_id().alias("_4"))  # parts rows that are equal in all else
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "_1", "_2", "_3", "_4"]
    return stored(narrow.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", F.monotonically_increasing_id().alias("pos"), "kind", "key", "blank", "cut"), "talk-rows")


def pieces(rows: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Columns conv_id, at (first pos), codes in order, and counts, of at most 2 ** piece_bits consecutive rows each."""
    numbers = numbered(rows)
    again = numbers.groupBy("key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    told = attach(numbers, stored(again, "talk-repeats"), "key", F.col("times"), numbers.count())
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    coded = told.select("conv_id", "turn", "pos", fault.alias("fault"), (F.col("kind") + 4 * fault).cast("byte").alias("code"),
                        F.shiftright("pos", piece_bits).alias("block"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return stored(coded.groupBy("conv_id", "block").agg(
        F.min("pos").alias("at"), F.transform(listed, lambda x: x["code"]).alias("codes"), F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        F.size(F.collect_set("turn")).alias("turns"), *[F.count_if(F.col("fault") == k).alias(c) for k, c in enumerate(("blank", "duplicate", "truncated"), 1)],
    ).drop("block"), "talk-pieces")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums through the middle state, of rows of matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def row_matrices(codes: np.ndarray) -> np.ndarray:
    """For each code the least costs from state to state over inserts before the row and one edit of it."""
    inserts = np.full((4, 4), FAR)
    inserts[range(4), range(4)] = 0
    inserts[range(4), ONWARD] = INSERT
    inserts[[0, 1], 3] = 2 * INSERT
    table = np.full((16, 4, 4), FAR)
    for code in range(16):
        kind, fault = code % 4, code // 4
        table[code, range(4), range(4)] = DELETE
        if fault in (0, 3):
            left = TRUNCATED * (fault == 3)
            for state in range(4):
                for to, cost in ((ONWARD[state], REROLE + left), (KEPT[kind, state], left)):
                    if to >= 0:
                        table[code, state, to] = min(table[code, state, to], cost)
    return product(inserts[None], table)[codes]


def suffixes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every row the matrix from it to the end of its piece (`ends`: where that is), by doubling."""
    found, here, step = row_matrices(codes), np.arange(len(codes)), 1
    while len(on := np.flatnonzero(here + step < ends)):
        found[on] = product(found[on], found[on + step])
        step *= 2
    return found


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the lists of a column hold about HELD values."""
    for batch in batches:
        sizes, start, held = batch.column(column).value_lengths().to_pylist(), 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > HELD:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and where each piece ends."""
    codes = batch.column("codes")
    return codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's matrix, its first and last role class and its illegal neighbours."""
    for batch in slices(batches, "codes"):
        codes, ends = flat(batch)
        starts = np.append(0, ends[:-1])
        owner = np.repeat(np.arange(len(ends)), ends - starts)
        kinds = codes % 4
        legal = np.isin(4 * kinds[:-1] + kinds[1:], LEGAL)
        bad = np.bincount(owner[1:], ~legal & (owner[1:] == owner[:-1]), len(ends)).astype(np.int64)
        matrices = suffixes(codes, ends[owner])[starts].reshape(len(ends), 16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("at"), pa.array(bad), pa.array(kinds[starts].astype(np.int32)), pa.array(kinds[ends - 1].astype(np.int32)), pa.array(matrices.tolist(), pa.list_(pa.int64()))],
            names=["at", "illegal", "first", "last", "matrix"])


#: Neighbouring classes that are in order: system user, user assistant, assistant user.
LEGAL = (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)


def least_paths(codes: np.ndarray, ends: np.ndarray, after: np.ndarray, entered: list[int]):
    """Per piece the costs from its first row, and for every state in `entered` the state it is left in and the least audit.

    `after`: per piece the cost of all that follows, by the state it is left in.
    """
    starts = np.append(0, ends[:-1])
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    onward = (suffixes(codes, ends[owner]) + after[owner][:, None, :]).min(-1)
    # layers: one per row, and one more at the end of each piece; node = 4 * layer + state
    layer = np.arange(len(codes)) + owner
    total = len(codes) + len(ends)
    cost = np.zeros((total, 4), np.int64)
    last = ends + np.arange(len(ends))
    cost[layer], cost[last] = onward, after
    kind, fault = codes % 4, codes // 4
    usable, left = np.isin(fault, (0, 3))[:, None], (TRUNCATED * (fault == 3))[:, None]
    state = np.arange(4)
    here, kept = cost[layer], KEPT[kind]
    # arcs of a node in the order of their letters D I K R: target and whether it is optimal
    below = 4 * (layer + 1)[:, None]
    target = np.stack([below + state, 4 * layer[:, None] + ONWARD, below + np.maximum(kept, 0), below + ONWARD], -1)
    price = np.stack([np.full(here.shape, DELETE), np.full(here.shape, INSERT), np.broadcast_to(left, here.shape), np.broadcast_to(REROLE + left, here.shape)], -1)
    allowed = np.stack([np.ones(here.shape, bool), np.ones(here.shape, bool), usable & (kept >= 0), np.broadcast_to(usable, here.shape)], -1)
    optimal = allowed & (here[..., None] == price + cost.reshape(-1)[target])
    nodes = 4 * total
    letter, pointer = np.zeros(nodes, np.int64), np.arange(nodes)
    inside = (4 * layer[:, None] + state).ravel()
    target, optimal = target.reshape(-1, 4), optimal.reshape(-1, 4)

    def choose(rank: np.ndarray) -> None:
        key = np.where(optimal, np.arange(1, 5) * (rank.max() + 1) + rank[target], FAR)
        best = key.argmin(1)
        letter[inside], pointer[inside] = best + 1, target[np.arange(len(best)), best]

    # Letters out of a node differ, so the first choice already names the arc; the ranks order whole audits.
    choose(np.zeros(nodes, np.int64))
    rank, jump, steps = letter.copy(), pointer.copy(), (letter > 0).astype(np.int64)
    doubled = [jump]
    while letter[jump].any():
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        steps = steps + steps[jump]
        jump = jump[jump]
        doubled.append(jump)
    choose(rank)
    out = []
    for begin in entered:
        on = 4 * (starts + np.arange(len(ends))) + begin
        for jump in doubled[:-1]:
            beyond = jump[on]
            on = np.concatenate([on, beyond[letter[beyond] > 0]])
        of = np.searchsorted(last, on // 4)
        order = np.lexsort((-steps[on], of))
        on, of = on[order], of[order]
        upto = np.searchsorted(of, np.arange(len(ends)), "right")
        text = LETTERS[letter[on]].tobytes().decode()
        out.append((pointer[on[upto - 1]] % 4, [text[a:b] for a, b in zip(np.append(0, upto[:-1]), upto, strict=True)]))
    return cost[starts + np.arange(len(ends))], out


def paths(entered: list[int]):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "codes"):
            after = np.array(batch.column("after").to_pylist(), np.int64).reshape(-1, 4)
            cost, out = least_paths(*flat(batch), after, entered)
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), pa.array(cost.tolist(), pa.list_(pa.int64())), pa.array(np.stack([x[0] for x in out], 1).tolist(), pa.list_(pa.int32())),
                 pa.array([list(x) for x in zip(*[x[1] for x in out], strict=True)], pa.list_(pa.string()))],
                names=["at", "cost", "leaves", "audits"])

    return walked


def longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def doubled(table: DataFrame, value: str, combine, forward: bool, most: int) -> DataFrame:
    """Combine the value of every piece with those of all later (or, not forward, earlier) pieces of its conversation, by doubling."""
    step = 1
    while step < most:
        other = table.select("head", (F.col("i") - step if forward else F.col("i") + step).alias("i"), F.col(value).alias("_other"))
        table = stored(table.join(other, ["head", "i"], "left").withColumn(value, F.when(F.col("_other").isNull(), F.col(value)).otherwise(
            combine(F.col(value), F.col("_other")))).drop("_other"), "talk-doubled")
        step *= 2
    return table


def through(a: Column, b: Column) -> Column:
    """The product of two matrices held as arrays."""
    return F.array(*[F.least(F.lit(FAR), *[a[4 * s + m] + b[4 * m + t] for m in range(4)]) for s in range(4) for t in range(4)])


def chained(many: DataFrame, found: DataFrame) -> DataFrame:
    """Columns head, i, at, cost, leaves, audit of the pieces of conversations with several; `many` has head, i, at, codes, pieces."""
    most = many.agg(F.max("pieces")).first()[0] or 1
    suffix = doubled(stored(many.join(found.select("at", "matrix"), "at").select("head", "i", "matrix"), "talk-matrices"), "matrix", through, True, most)
    beyond = suffix.select("head", (F.col("i") - 1).alias("i"), F.col("matrix").alias("m"))
    after = F.when(F.col("m").isNull(), longs(ENDING)).otherwise(
        F.array(*[F.least(*[F.col("m")[4 * s + t] + ENDING[t] for t in range(4)]) for s in range(4)]))
    walked = stored(many.join(beyond, ["head", "i"], "left").select("at", "codes", after.alias("after")).mapInArrow(paths([0, 1, 2, 3]), PATHS), "talk-paths")
    placed = stored(many.select("head", "i", "at").join(walked, "at"), "talk-placed")
    # where each piece leaves a conversation that began in the state 0..3 of its first piece
    maps = doubled(placed.select("head", "i", "leaves"), "leaves", lambda late, early: F.transform(early, lambda x: F.get(late, x)), False, most)
    entered = F.coalesce(F.col("entry"), F.lit(0))
    return placed.join(maps.select("head", (F.col("i") + 1).alias("i"), F.col("leaves")[0].alias("entry")), ["head", "i"], "left").select(
        "head", "i", "at", F.get("cost", entered).alias("cost"), F.get("leaves", entered).alias("left"), F.get("audits", entered).alias("audit"))


def repairs(rows: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """One row per conversation of `rows` (as `damaged` gives them): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A row's first fault counts. Pieces of all conversations are solved side by side, so one that holds a third of all rows is no
    hot task; its audit is one value, as long as its rows are many. Rows without a conv_id are one conversation; rows without a turn
    come first; repeated rows are duplicates. An empty table gives an empty one.
    """
    parts = pieces(rows, piece_bits)
    found = stored(parts.select("at", "codes").mapInArrow(solved, SOLVED), "talk-solved")
    heads = parts.groupBy("conv_id").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("pieces"))
    cut_up = stored(heads.where("pieces > 1"), "talk-cut")  # at most one conversation per end of a piece's block
    same = parts["conv_id"].eqNullSafe(cut_up["conv_id"])
    whole = parts.join(cut_up, same, "left_anti").select("at", "codes", longs(ENDING).alias("after")).mapInArrow(paths([0]), PATHS).select(
        "at", F.col("at").alias("head"), F.lit(1).alias("i"), F.col("cost")[0].alias("cost"), F.col("leaves")[0].alias("left"), F.col("audits")[0].alias("audit"))
    if not cut_up.isEmpty():
        turn = F.row_number().over(Window.partitionBy("head").orderBy("at"))
        many = stored(parts.join(cut_up, same).select("head", "pieces", "at", "codes").withColumn("i", turn), "talk-many")
        whole = whole.unionByName(chained(many, found))
    fields = ["i", "cost", "left", "audit", "first", "last", "illegal", "lo", "hi", "turns", "blank", "duplicate", "truncated"]
    each = parts.drop("codes").join(found.drop("matrix"), "at").join(whole, "at").groupBy("head").agg(
        F.min("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda sum_, x: sum_ + x[name])
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pair = lambda x: x["a"]["last"] * 4 + x["b"]["first"]
    shared = F.size(F.filter(pairs, lambda x: x["a"]["hi"] == x["b"]["lo"]))
    broken = F.size(F.filter(pairs, lambda x: ~pair(x).isin(*LEGAL)))
    lo, hi = F.array_min(F.transform("p", lambda x: x["lo"])), F.array_max(F.transform("p", lambda x: x["hi"]))
    tail = F.get(F.array(*[F.lit(t) for t in TAIL]), F.element_at("p", -1)["left"])
    return each.select(
        "conv_id", F.coalesce(hi - lo + 1 - (total("turns") - shared), F.lit(0)).cast("long").alias("gaps"),
        *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")], (total("illegal") + broken).cast("long").alias("illegal"),
        F.col("p")[0]["cost"].alias("cost"), F.concat(F.array_join(F.transform("p", lambda x: x["audit"]), ""), tail).alias("audit"))


ROLES = ("user", "user", "assistant", "user")


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Columns conv_id, place, edit, role, text: the repaired turns in order, by the audits that `repairs` gave for the same rows.

    Each conversation's rows follow its audit through one task in order, and are read as a stream: nothing is held but the audit.
    """
    kind = told.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "_told", *[f"_{i}" for i in range(4)]]
    keys = [c.alias(f"_{i}") for i, c in enumerate([F.col("turn"), *in_order()[1:]])]
    texts = rows.select("conv_id", F.lit(1).alias("_told"), *keys, "role", "text")
    types = {f.name: f.dataType for f in texts.schema}
    audits = told.select("conv_id", F.lit(0).alias("_told"), *[F.lit(None).cast(types[f"_{i}"]).alias(f"_{i}") for i in range(4)], F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    sorted_ = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    out_type = f"conv_id {kind}, place long, edit string, role string, text string"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state, out = None, "", 0, 0, 0, []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                put("I", ROLES[state], "")
                state, at = int(ONWARD[state]), at + 1

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for name, told_, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_told", "role", "text")), strict=True):
                if not told_:
                    insert()
                    conv, audit, at, place, state = name, text, 0, 0, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put("K", role, text)
                    state = {"s": 1, "u": 2, "a": 3}[role[0]]
                elif edit == "R":
                    put("R", ROLES[state], text)
                    state = int(ONWARD[state])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "edit", "role", "text"])
            out.clear()
        insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "edit", "role", "text"])

    return sorted_.select("conv_id", "_told", "role", "text").mapInArrow(follow, out_type)


def digests(turns: DataFrame) -> DataFrame:
    """Columns conv_id, repaired_sha256 over `role:text` lines of turns in the order in which `repaired` gives them."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out, type_ = None, None, [], None
        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for name, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if place:
                    held.update(b"\n" + line)
                    continue
                if held is not None:
                    out.append((conv, held.hexdigest()))
                conv, held = name, hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type_), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
            out.clear()
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([held.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(talks: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Every conv_id of `talks` (also null, and those that lost all rows: zeros) with its counts, cost, audit and repaired_sha256."""
    rows = damaged(talks)
    told = stored(repairs(rows, piece_bits), "talk-repairs")
    hashes = digests(repaired(rows, told))
    names = talks.select("conv_id").distinct()
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    out = names.alias("n").join(told.alias("t"), F.expr("n.conv_id <=> t.conv_id"), "left").join(hashes.alias("h"), F.expr("n.conv_id <=> h.conv_id"), "left")
    return out.select("n.conv_id", *[F.coalesce(c, F.lit(v).cast("long" if isinstance(v, int) else "string")).alias(c) for c, v in none.items()])
