"""Conversation structure repair by a square-root checkpointed dynamic programme.

The cheapest edits lead the roles of a conversation to ``(s?(ua)+)?``. A state says what the
role before was; the costs from a place on, one for each state, are a vector, and what a row
does to it is a (min, +) product. So a conversation is cut into blocks of about the square
root of the longest one's rows: each block is summed up as a 4 x 4 matrix, the vectors are
stored at the ends of the blocks only, and walking forward each block computes its own
vectors again and emits the edits. Blocks are worked on apart; only their summaries,
one for each block, meet by conversation.

Row order comes from a range-partitioned sort, so a conversation of any length is spread
over tasks. Texts are represented by hashes until the last step, which reads each
conversation once in order, because the digest of its text is one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscade.llm.common import per_batch, table
from corpuscade.session import materialize

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: The least block; longer conversations have blocks of about the square root of their rows.
LEAST_BITS = 6
SPACE = r"[\x20\x09-\x0D]"

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that a user or assistant row, as is in order, leads to.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: The state that a kept row leads to.
KEEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Cost of ending in each state: the rows that are still missing are inserted.
ENDS = (0, 2 * INSERT, INSERT, 0)

OK, GONE, CUT_OFF = range(3)  # a row's fault: none, has to go, truncated


def _back(after: list[int], kind: str, fault: int) -> list[int]:
    """Costs before a row from the costs after it."""
    if fault == GONE:
        return [c + DELETE for c in after]
    own = TRUNCATED if fault == CUT_OFF else 0
    costs = [min(DELETE + after[q], own + REROLE + after[NEXT[q]]) for q in range(4)]
    for (q, k), to in KEEP.items():
        if k == kind:
            costs[q] = min(costs[q], own + after[to])
    costs[AFTER_U], costs[AFTER_A] = (
        min(costs[AFTER_U], INSERT + costs[AFTER_A]), min(costs[AFTER_A], INSERT + costs[AFTER_U]),
    )  # fmt: skip
    return [min(costs[q], INSERT + costs[AFTER_U]) if q < AFTER_U else costs[q] for q in range(4)]


def _vectors(rows: list[tuple[str, int, int]], after: list[int]) -> list[list[int]]:
    """Costs before each row of a block, and after the last; all but the first of a row's
    copies have to go, which no other choice can better."""
    out = [after]
    for kind, fault, copies in reversed(rows):
        out.append(_back([c + DELETE * (copies - 1) for c in out[-1]], kind, fault))
    return out[::-1]


def matrix(rows: list[tuple[str, int, int]]) -> list[int]:
    """Least cost through a block from each state (rows) to each state (columns)."""
    columns = [_vectors(rows, [0 if q == to else FAR for q in range(4)])[0] for to in range(4)]
    return [min(columns[to][q], FAR) for q in range(4) for to in range(4)]


def through(block: list[int], after: list[int]) -> list[int]:
    return [min(block[4 * q + to] + after[to] for to in range(4)) for q in range(4)]


def walk(rows: list[tuple[str, int, int]], after: list[int], state: int) -> tuple[int, list[tuple[str, str, str]]]:
    """(last state, for each row what is inserted before it, its edit and its new role), the
    ASCII-least of the cheapest edits: D before I before K before R."""
    vectors, out = _vectors(rows, after), []
    for (kind, fault, copies), costs, later in zip(rows, vectors, vectors[1:]):
        rest = [c + DELETE * (copies - 1) for c in later]
        own = TRUNCATED if fault == CUT_OFF else 0
        before, cost = "", costs[state]
        while True:
            if cost == DELETE + rest[state]:
                out.append((before, "D", ""))
            elif cost == INSERT + costs[NEXT[state]]:
                state = NEXT[state]
                cost = costs[state]
                before += "a" if state == AFTER_A else "u"
                continue
            elif (state, kind) in KEEP and cost == own + rest[KEEP[state, kind]]:
                state = KEEP[state, kind]
                out.append((before, "K", ""))
            else:
                state = NEXT[state]
                out.append((before, "R", "assistant" if state == AFTER_A else "user"))
            break
    return state, out


def tail(state: int) -> str:
    """What is inserted at the end."""
    return {AFTER_S: "ua", AFTER_U: "a"}.get(state, "")


def damaged(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, copies: conversations with the faults that the hash of
    ``conv_id:turn`` asks for. Nulls count as one space, but for turn, which stays null; ``conv``
    is a key that is never null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    fault = (F.crc32(key.cast("binary")) % 20).alias("fault")
    text = (
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    return (
        rows.select(conversation(), "conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault)
        .where("fault != 0")
        .select(
            "conv", "conv_id", "turn",
            F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )  # fmt: skip


def conversation() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


#: Rows of a conversation in order: by turn, null first; then by role and by the text's SHA-256.
ORDER = ("conv", "turn", "role", "h")


def _runs(rows: DataFrame) -> DataFrame:
    """Each different row once, with its copies, what is wrong with it, and the kind of its role.

    ``repeats``: an earlier turn has the same role and text.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    marked = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), "copies", blank.alias("blank"), truncated.alias("truncated"))
    # Sums are made where rows are read, so one row that fills the table is a few rows here.
    runs = marked.groupBy(*ORDER, "blank", "truncated").agg(F.sum("copies").alias("copies"))
    runs = materialize(runs, "turn-runs")
    earliest = runs.groupBy("conv", "role", "h").agg(F.min(F.struct("turn")).alias("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("kind")
    return runs.join(earliest, ["conv", "role", "h"]).select(
        *ORDER, "copies", "blank", "truncated", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("repeats"), kind
    )


def _counts(runs: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated."""
    again = ~F.col("blank") & F.col("repeats")
    first = ~F.col("blank") & ~F.col("repeats")
    duplicate = F.when(again, F.col("copies")).when(first, F.col("copies") - 1).otherwise(0)
    turns = runs.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    faults = runs.groupBy("conv").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(duplicate).alias("duplicate"),
        F.sum(F.when(first & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    return faults.join(turns, "conv")


BLOCK = "rows array<struct<pos long, kind string, fault int, copies long, turn long, role string, h binary>>"


def _blocks(runs: DataFrame, least_bits: int) -> DataFrame:
    """conv, block, rows: rows in order, in blocks of about the square root of the longest conversation."""
    fault = F.when(F.col("blank") | F.col("repeats"), GONE).when(F.col("truncated"), CUT_OFF).otherwise(OK)
    rows = runs.select(*ORDER, "copies", "kind", fault.cast("int").alias("fault"))
    # Partitions in order, rows in order within them: a conversation may go over several.
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered = materialize(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns-in-order")
    most = ordered.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    bits = max(least_bits, (most.bit_length() + 1) // 2)
    row = F.struct("pos", "kind", "fault", "copies", "turn", "role", "h")
    gathered = ordered.groupBy("conv", F.shiftright("pos", bits).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return materialize(gathered, "turn-blocks")


def _light(rows: list[dict]) -> list[tuple[str, int, int]]:
    return [(r["kind"], r["fault"], r["copies"]) for r in rows]


def _summaries(blocks: DataFrame) -> DataFrame:
    """conv, block, costs (the matrix), illegal (within the block), first and last kind."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("costs", "illegal", "first", "last")}
            for rows in batch.column("rows").to_pylist():
                kinds = [r["kind"] for r in rows]
                out["costs"].append(matrix(_light(rows)))
                within = sum(r["copies"] - 1 for r in rows)
                out["illegal"].append(within + sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:])))
                out["first"].append(kinds[0])
                out["last"].append(kinds[-1])
            return {"conv": batch.column("conv"), "block": batch.column("block"), **out}

        return step

    return per_batch(blocks, "conv string, block long, costs array<long>, illegal long, first string, last string", make)


def _checkpoints(summaries: DataFrame) -> DataFrame:
    """conv, cost, illegal, and for each block (number, costs after it, whether it is first and last)."""
    gathered = summaries.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "illegal", "first", "last"))).alias("all"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("cost", "illegal", "blocks", "after")}
            for found in batch.column("all").to_pylist():
                after = [list(ENDS)]
                for b in reversed(found):
                    after.append(through(b["costs"], after[-1]))
                out["cost"].append(after[-1][START])
                between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(found, found[1:]))
                out["illegal"].append(between + sum(b["illegal"] for b in found))
                out["blocks"].append([b["block"] for b in found])
                out["after"].append([c for v in after[-2::-1] for c in v])
            return {"conv": batch.column("conv"), **out}

        return step

    return per_batch(gathered, "conv string, cost long, illegal long, blocks array<long>, after array<long>", make)


EDITS = (
    "conv string, block long, entry int, exit int, turn long, role string, h binary, pos long, copies long, "
    "before string, edit string, new_role string"
)


def _edits(blocks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The edits of each block, for each state in which it may be entered (``entry``); a row
    for each run. ``exit`` stands in a block's first row. First blocks are entered at START."""
    ends = checkpoints.select("conv", F.posexplode("blocks").alias("i", "block"), "after").select(
        "conv", "block", F.slice("after", F.col("i") * 4 + 1, F.lit(4)).alias("after"), (F.col("i") == 0).alias("opens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = EDITS.replace(",", "").split()[::2]
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(n, types[t]) for n, t in zip(names, EDITS.replace(",", "").split()[1::2])])
        for batch in batches:
            out: list[tuple] = []
            for block in batch.to_pylist():
                light = _light(block["rows"])
                for entry in [START] if block["opens"] else range(4):
                    state, edits = walk(light, block["after"], entry)
                    for i, (r, edit) in enumerate(zip(block["rows"], edits)):
                        out.append((block["conv"], block["block"], entry, None if i else state, r["turn"], r["role"], r["h"], r["pos"], r["copies"], *edit))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return materialize(blocks.join(ends, ["conv", "block"]).mapInArrow(run, EDITS), "turn-edits")


def _chosen(edits: DataFrame) -> DataFrame:
    """conv, block, entry, and the rows inserted after the conversation's last block (else empty)."""
    ways = edits.where("exit is not null").select("conv", F.struct("block", "entry", "exit").alias("way"))
    gathered = ways.groupBy("conv").agg(F.sort_array(F.collect_list("way")).alias("ways"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("conv", "block", "entry", "tail")}
            for conv, ways in zip(batch.column("conv").to_pylist(), batch.column("ways").to_pylist()):
                state = START
                for way in ways:
                    if way["entry"] == state and (not out["conv"] or (out["conv"][-1], out["block"][-1]) != (conv, way["block"])):
                        for name, value in zip(out, (conv, way["block"], state, "")):
                            out[name].append(value)
                        state = way["exit"]
                out["tail"][-1] = tail(state)
            return out

        return step

    return per_batch(gathered, "conv string, block long, entry int, tail string", make)


def _read_out(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, audit, sha: each conversation is read once, in order, its edits beside its texts.

    One task reads all rows of a conversation, as one digest needs, but holds one at a time.
    """
    text = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), F.lit(1).alias("side"), "text")
    both = edits.select("conv", "turn", "role", "h", F.lit(0).alias("side"), "pos", "copies", "before", "edit", "new_role", "tail").unionByName(text, allowMissingColumns=True)
    dealt = both.repartition("conv").sortWithinPartitions(*ORDER, "side")
    names = ["conv", "side", "role", "text", "copies", "before", "edit", "new_role", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, audit, opened, waiting, later = None, None, bytearray(), False, None, ""

        def line(role: str, text: str) -> None:
            nonlocal opened
            digest.update((("\n" if opened else "") + f"{role}:{text}").encode())
            opened = True

        def insert(kinds: str) -> None:
            for kind in kinds:
                audit.extend(b"I")
                line("assistant" if kind == "a" else "user", "")

        def close() -> list[str]:
            insert(later)
            return [conv, audit.decode(), digest.hexdigest()]

        for batch in batches:
            out = []
            for own, side, role, text, copies, before, edit, new_role, after in zip(*(batch.column(n).to_pylist() for n in names)):
                if own != conv:
                    if conv is not None:
                        out.append(close())
                    conv, digest, audit, opened, waiting, later = own, hashlib.sha256(), bytearray(), False, None, ""
                if side == 0:
                    insert(before)
                    audit.extend(edit.encode() + b"D" * (copies - 1))
                    waiting, later = (new_role or role) if edit != "D" else None, after
                elif waiting is not None:
                    line(waiting, text)
                    waiting = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "audit", "sha"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in close()], ["conv", "audit", "sha"])

    return dealt.select(*names).mapInArrow(run, "conv string, audit string, sha string")


def repair(rows: DataFrame, least_bits: int = LEAST_BITS) -> DataFrame:
    """For each conversation of ``rows(conv, turn, role, text, copies)``: conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows go by turn, null first; rows of one turn by role, then by the SHA-256 of the text,
    equal ones beside each other. ``conv`` and ``role`` and ``text`` are not null. A
    conversation of any length is worked on in blocks. An empty table gives an empty one;
    other columns are not looked at.
    """
    runs = materialize(_runs(rows), "turns")
    blocks = _blocks(runs, least_bits)
    checkpoints = materialize(_checkpoints(_summaries(blocks)), "turn-checkpoints")
    edits = _edits(blocks, checkpoints)
    chosen = _chosen(edits)
    final = edits.join(chosen, ["conv", "block", "entry"])
    texts = _read_out(rows, final)
    return (
        _counts(runs).join(checkpoints.select("conv", "illegal", "cost"), "conv").join(texts, "conv")
        .select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    )  # fmt: skip


def repaired_conversations(rows: DataFrame, least_bits: int = LEAST_BITS) -> DataFrame:
    """Damage and repair ``conversations``: a row for each original conv_id, null one of them.

    A conversation of which the damage leaves nothing has zeros, an empty audit and the
    digest of the empty string. An empty table gives an empty table.
    """
    found = repair(damaged(rows), least_bits)
    every = rows.select("conv_id", conversation()).distinct()
    number = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        "conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )  # fmt: skip


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The same in SQL: costs, audits and repaired rows of all four states, row by row from the end."""
    way = lambda cost, edit, rows, q, at="b": f"{{'c': {at}{q}.c + {cost}, 'a': '{edit}' || {at}{q}.a, 't': {rows}}}"  # noqa: E731
    put = lambda row, q, at="b": f"list_concat([{row}], {at}{q}.t)"  # noqa: E731
    least = lambda *ways: f"list_sort(list_concat({', '.join(ways)}))[1]"  # noqa: E731
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {2: "'user:'", 3: "'assistant:'"}

    def edited(q: int) -> str:
        to = NEXT[q]
        keeps = " ".join(f"WHEN kind = '{k}' THEN [{way('own', 'K', put(chr(34) + 'row' + chr(34), t), t)}]" for k, t in kept[q].items())
        own = f"[{way('own + 1', 'R', put(name[to] + ' || text', to), to)}], CASE {keeps} ELSE [] END"
        return least(f"[{way('2', 'D', f'b{q}.t', q)}]", f"CASE WHEN gone THEN [] ELSE list_concat({own}) END")

    def closed(q: int, at: str) -> str:
        to = NEXT[q]
        return least(f"[a{q}]", f"[{way('5', 'I', put(name[to], to, at), to, at)}]")

    return rf"""
WITH RECURSIVE keyed AS (
  SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS chars
  FROM conversations),
hashed AS (
  SELECT conv, turn, role, text, xor(list_reduce(
      list_concat([4294967295], list_transform(chars, lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS damage
  FROM keyed),
damaged AS (
  SELECT conv, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE damage <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faulty AS (
  SELECT conv, i, turn, text, role || ':' || text AS row, substr(role, 1, 1) AS kind,
         substr(lag(role) OVER (PARTITION BY conv ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counted AS (
  SELECT conv, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv),
walked AS (
  SELECT conv, n + 1 AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b0,
         {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS b1, {{'c': 5, 'a': 'I', 't': ['assistant:']}} AS b2,
         {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b3
  FROM counted
  UNION ALL
  SELECT conv, i, {closed(0, "c")}, {closed(1, "c")}, c2, c3 FROM (
    SELECT *, {closed(2, "a")} AS c2, {closed(3, "a")} AS c3 FROM (
      SELECT conv, i, {edited(0)} AS a0, {edited(1)} AS a1, {edited(2)} AS a2, {edited(3)} AS a3 FROM (
        SELECT f.conv, f.i, row, text, kind, fault IN ('blank', 'duplicate') AS gone,
               CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS own, b0, b1, b2, b3
        FROM walked w JOIN faulty f ON f.conv = w.conv AND f.i = w.i - 1)))),
every AS (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS conv FROM conversations)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b0.c, 0) AS BIGINT) AS cost,
       coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN counted USING (conv) LEFT JOIN (SELECT * FROM walked WHERE i = 1) w USING (conv)
"""


OP13_SQL = _oracle()
