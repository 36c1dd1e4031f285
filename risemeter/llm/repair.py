"""Repair of damaged conversations by iterative-deepening A*.

A conversation is a list of rows; its role initials must read ``(s?(ua)+)?``. Edits: Keep a row (0), Rerole it to user or assistant (2), Delete it (3; the only
edit of a blank or repeated row), Insert an empty user or assistant row anywhere (2). A truncated row that stays adds 1. The cheapest edits count; of several the
one whose initials, in order, are least in ASCII.

1. **Order.** Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread; blocks of at most ``BLOCK`` rows of one conversation are
   repaired one by one.
2. **Search.** Within a block: depth-first in the order Delete, Insert, Keep, Rerole, cut off where the cost so far plus a lower bound of the rest (what each row costs at the least, and breaks of the
   pattern) exceeds the bound; the bound rises to the least cost that was cut off. States (row, place in the pattern) that failed are kept with the most that was left to spend, and are not entered
   again with as much or less. The first accepting path is the answer: with costs whole and the order that of ASCII, it is the cheapest and the least.
3. **Blocks.** Inserted rows belong to the row that follows, so the edits of a block are never a prefix of other edits of it, and the least edits of a conversation are made of
   least edits of its blocks. A conversation of several blocks is searched once for each entry and exit state; the states are then chained, a few numbers per block.
4. **Digest.** Texts meet their edits once more and stream through in order. A conversation of one block is hashed there; of others the blocks' digest pieces follow one another.

Defined results: rows with a null ``conv_id`` take no part. A null role or text is one space, and a null turn is one space in the key of its damage. Rows with equal turns are ordered by
role and text. A role that is empty has no initial; it can be reroled or deleted. A conversation without rows gives zeros, no edits and the digest of nothing.
Further columns are not read. The repaired text of one conversation is one chain of hash blocks and passes one task, in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from risemeter.llm.ordering import digests, in_order
from risemeter.llm.tables import saved

#: Rows of a block.
BLOCK = 64
#: Bytes of a digest piece.
PIECE = 1 << 20

#: Costs of the edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Places in the pattern: nothing yet, after s, after u, after a; the row that may be inserted (or reroled to) at each, and the place after it.
START, SYSTEM, USER, ASSISTANT = range(4)
FILL = (USER, USER, ASSISTANT, USER)
#: The least cost of completing the pattern from each place.
CLOSE = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


def search(rows: list[tuple[str, bool, bool]], entry: int = START, leave: int | None = None) -> tuple[int, str] | None:
    """The cheapest, then least, edits of ``rows`` (initial, must go, truncated) from place ``entry`` to ``leave``: (cost, edits), or None if none lead there.

    Without ``leave`` the pattern must be complete after the last row, and rows may be inserted there.
    """
    n = len(rows)
    if leave == START != entry or (leave == SYSTEM and entry != SYSTEM and (entry != START or not any(s == "s" and not gone for s, gone, _ in rows))):
        return None
    # A lower bound: what each row costs at the least, and 2 for each two breaks of the pattern, since an edit beyond that costs 2 or more and mends two breaks at the most.
    rest, breaks, live = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, gone, cut = rows[i]
        rest[i] = rest[i + 1] + (DELETE if gone else cut * CUT)
        after_it = live[i + 1]
        if gone:
            breaks[i], live[i] = breaks[i + 1], after_it
        elif after_it < n:
            breaks[i], live[i] = breaks[i + 1] + (initial + rows[after_it][0] not in LEGAL), i
        else:
            breaks[i], live[i] = int(leave is None and initial != "a"), i

    def after(i: int, place: int) -> int:
        if leave in (START, SYSTEM):  # nothing but deletions stays there, and one system row leads from the one to the other
            return DELETE * (n - i - (place != leave)) if place in (START, leave) else DELETE * (n + 1)
        k = live[i]
        if k == n:
            return rest[i] + (CLOSE[place] if leave is None else 0)
        return rest[i] + 2 * ((breaks[i] + ((place, rows[k][0]) not in KEEP) + 1) // 2)

    def edits(i: int, place: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, next row, next place) in ASCII order."""
        if i == n:
            return [("I", INSERT, i, FILL[place])] if leave is None else []
        initial, gone, cut = rows[i]
        out = [("D", DELETE, i + 1, place), ("I", INSERT, i, FILL[place])]
        if not gone:
            if (place, initial) in KEEP:
                out.append(("K", cut * CUT, i + 1, KEEP[place, initial]))
            out.append(("R", REROLE + cut * CUT, i + 1, FILL[place]))
        return out

    def goal(i: int, place: int) -> bool:
        return i == n and (place in (START, ASSISTANT) if leave is None else place == leave)

    if goal(0, entry):
        return 0, ""
    failed: dict[tuple[int, int], int] = {}
    bound = after(0, entry)
    while True:
        beyond = DELETE * (n + 1) + 3 * INSERT
        path: list[str] = []
        stack = [(0, entry, bound, iter(edits(0, entry)))]  # row, place, what is left to spend, edits still to try
        while stack:
            i, place, left, tries = stack[-1]
            for edit, cost, j, to in tries:
                spare = left - cost
                short = after(j, to) - spare
                if (j, to) in failed:
                    short = max(short, failed[j, to] + 1 - spare)
                if short > 0:
                    beyond = min(beyond, short)
                elif goal(j, to):
                    return bound - spare, "".join(path) + edit
                else:
                    path.append(edit)
                    stack.append((j, to, spare, iter(edits(j, to))))
                    break
            else:
                stack.pop()
                failed[i, place] = max(left, failed.get((i, place), left))
                if path:
                    path.pop()
        bound += beyond


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage, which a hash of conversation and turn deals."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), kind
    )
    hurt = rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return hurt.select("*", F.explode(F.expr("sequence(1, times)"))).select("conv_id", "turn", "role", "text")


def _last_sign(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x20\x09-\x0D]+$", ""), -1, 1)


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, alone, final, faults and rows) of each block; the rows as (seq, initial, must go, truncated)."""
    marked = rows.select(
        "conv_id", "block", "seq", F.substring("role", 1, 1).alias("initial"), (F.col("sign") == "").alias("blank"), (~F.col("sign").isin(".", "!", "?")).alias("open"), "hx", "hy"
    )
    # A fault group of any size is combined before it moves; only groups of several rows meet their rows again.
    first = marked.groupBy("conv_id", "hx", "hy").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    judged = marked.join(first, ["conv_id", "hx", "hy"], "left").selectExpr(
        "conv_id", "block", "seq", "initial", "blank", "not blank and coalesce(seq > first, false) as twice", "not blank and not coalesce(seq > first, false) and open as cut"
    )
    span = rows.groupBy("conv_id").agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    blocks = judged.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("seq", "initial", F.expr("blank or twice as gone"), "cut"))).alias("rows"),
        *(F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("twice", "duplicate"), ("cut", "truncated"))),
    )
    return blocks.join(span, "conv_id").selectExpr(
        "conv_id", "block", "b0 = b1 as alone", "block = b0 as opening", "block = b1 as closing", "blank", "duplicate", "truncated", "rows.initial as initial", "rows.gone as gone", "rows.cut as cut"
    )


_SOLVED = (
    "conv_id long, block long, alone boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "options array<struct<entry:int,leave:int,cost:long,edits:string>>"
)
_END = 4


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv_id", pa.int64()), ("block", pa.int64()), ("alone", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("first", pa.string()), ("last", pa.string()),
        ("options", pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))),
    ])
    for b in batches:
        out = []
        for r in b.to_pylist():
            rows = list(zip(r["initial"], r["gone"], r["cut"], strict=True))
            options = []
            for entry in (START,) if r["opening"] else range(4):
                for leave in (_END,) if r["closing"] else range(4):
                    found = search(rows, entry, None if leave == _END else leave)
                    if found is not None:
                        options.append({"entry": entry, "leave": leave, "cost": found[0], "edits": found[1]})
            illegal = sum(x + y not in LEGAL for x, y in zip(r["initial"], r["initial"][1:], strict=False))
            out.append({**r, "illegal": illegal, "first": r["initial"][0], "last": r["initial"][-1], "options": options})
        yield pa.RecordBatch.from_pylist([{k: o[k] for k in schema.names} for o in out], schema)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last block first: keep, for each entry, the option of the least cost to the end of the conversation, then of the least edits."""
    conv, onward = None, {}
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["conv_id"] != conv:
                conv, onward = r["conv_id"], {_END: 0}
            best: dict[int, tuple] = {}
            for o in r["options"]:
                if o["leave"] in onward:
                    rank = (o["cost"] + onward[o["leave"]], o["edits"], o)
                    if o["entry"] not in best or rank[:2] < best[o["entry"]][:2]:
                        best[o["entry"]] = rank
            onward = {entry: rank[0] for entry, rank in best.items()}
            out.append({**r, "options": [rank[2] for rank in best.values()]})
        yield pa.RecordBatch.from_pylist(out, b.schema)


_EDITS = "conv_id long, block long, alone boolean, entry int, cost long, edits string, blank long, duplicate long, truncated long, illegal long"


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First block first: follow the options from the start."""
    conv, place, last = None, START, ""
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["conv_id"] != conv:
                conv, place, last = r["conv_id"], START, None
            o = next(o for o in r["options"] if o["entry"] == place)
            illegal = r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
            place, last = o["leave"], r["last"]
            out.append((r["conv_id"], r["block"], r["alone"], o["entry"], o["cost"], o["edits"], r["blank"], r["duplicate"], r["truncated"], illegal))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _EDITS.split(", ")])


def _edits(rows: DataFrame) -> DataFrame:
    """The edits of each block of the rows."""
    # Small rows with much work in each: as many tasks as the session shuffles into, whatever their size.
    blocks = _blocks(rows).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "block")
    solved = saved(blocks.mapInArrow(_solve, _SOLVED), "solved")
    several = solved.where("not alone")
    # A block is a row of sixteen options at most; a conversation's blocks pass one task, a few hundred rows in each.
    chosen = several.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_backwards, _SOLVED)
    chained = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_forwards, _EDITS)
    single = solved.where("alone").selectExpr("conv_id", "block", "alone", "options[0].entry as entry", "options[0].cost as cost", "options[0].edits as edits", "blank", "duplicate", "truncated", "illegal")
    return saved(single.unionByName(chained), "edits")


def _streamed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of each block after a leading row with its edits."""
    texts = rows.select("conv_id", "block", "seq", "role", "text", F.lit(None).cast("int").alias("entry"), F.lit(False).alias("alone"))
    heads = edits.select("conv_id", "block", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.col("edits").alias("text"), "entry", "alone")
    return texts.unionByName(heads).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, block, alone, seq, role, text) of each repaired row; a last item without a role ends a block."""
    block, edits, at, place, seq = None, "", 0, START, -1

    def inserted():
        nonlocal at, place
        while at < len(edits) and edits[at] == "I":
            place, at = FILL[place], at + 1
            yield (*block, seq, "user" if place == USER else "assistant", "")

    for b in batches:
        for conv, number, k, role, text, entry, alone in zip(*(b.column(c) for c in ("conv_id", "block", "seq", "role", "text", "entry", "alone")), strict=True):
            if k.as_py() == -1:
                if block:
                    yield from inserted()
                    yield (*block, seq, None, None)
                block, edits, at, place = (conv.as_py(), number.as_py(), alone.as_py()), text.as_py(), 0, entry.as_py()
                continue
            seq = k.as_py()
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == "K":
                place = KEEP[place, role.as_py()[:1]]
                yield (*block, seq, role.as_py(), text.as_py())
            elif edit == "R":
                place = FILL[place]
                yield (*block, seq, "user" if place == USER else "assistant", text.as_py())
    if block:
        yield from inserted()
        yield (*block, seq, None, None)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation of one block; of others the bytes of their lines, each line after a line break, in pieces."""
    out, size, state, empty = [], 0, hashlib.sha256(), True
    held, kept, number = [], 0, 0

    def batch():
        nonlocal out, size
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        out, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["conv_id", "block", "piece", "bytes", "sha256"])

    for conv, block, alone, _, role, text in _lines(batches):
        if alone:
            if role is None:
                out.append((conv, block, 0, None, state.hexdigest()))
                state, empty = hashlib.sha256(), True
            else:
                state.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        else:
            if role is not None:
                held.append(f"\n{role}:{text}".encode())
                kept += len(held[-1])
            if held and (role is None or kept >= PIECE):
                out.append((conv, block, number, b"".join(held), None))
                size, number, held, kept = size + kept, number + 1, [], 0
            if role is None:
                number = 0
        if len(out) >= 5000 or size >= 4 * PIECE:
            yield batch()
    if out:
        yield batch()


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) in order, with blocks; saved, since texts are needed again once the edits are known."""
    placed = in_order(rows, ["conv_id", "turn", "role", "text"])
    return saved(
        placed.select(
            "*",
            F.floor(F.col("seq") / BLOCK).cast("long").alias("block"),
            _last_sign(F.col("text")).alias("sign"),
            F.xxhash64("role", "text").alias("hx"),
            F.xxhash64(F.lit("row"), "text", "role").alias("hy"),
        ),
        "rows",
    )


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, seq, nth, role, text), ordered within a conversation by seq and nth; inserted rows go by the row they precede."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, nth, size = [], None, 0, 0
        for conv, _, _, seq, role, text in _lines(batches):
            if role is not None:
                nth = nth + 1 if (conv, seq) == last else 0
                last = (conv, seq)
                out.append((conv, seq, nth, role, text))
                size += len(text)
            if len(out) >= 5000 or size >= 4 * PIECE:
                yield _line_rows(out)
                out, size = [], 0
        if out:
            yield _line_rows(out)

    wanted = _ordered(rows.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    return _streamed(wanted, _edits(wanted)).mapInArrow(lines, "conv_id long, seq long, nth int, role string, text string")


def _line_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "seq", "nth", "role", "text"])


def repairs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, edits and the digest of the repaired rows (conv_id, turn, role, text; no nulls but turns) of each of ``ids`` (conv_id)."""
    ordered = _ordered(rows)
    edits = _edits(ordered)
    counts = edits.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x.edits), "").alias("audit"),
    )
    turns = ordered.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
    pieces = saved(_streamed(ordered, edits).mapInArrow(_pieces, "conv_id long, block long, piece long, bytes binary, sha256 string"), "pieces")
    parted = pieces.where("bytes is not null").select("conv_id", F.struct("block", "piece").alias("at"), F.col("bytes").alias("text"))
    texts = pieces.where("sha256 is not null").select("conv_id", "sha256").unionByName(digests(parted, ["conv_id"], "at", skip=1))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(counts, "conv_id", "left").join(gaps, "conv_id", "left").join(texts, "conv_id", "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """The repairs of the damaged conversations, a row for each original conversation."""
    return repairs(damaged(conversations), conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
