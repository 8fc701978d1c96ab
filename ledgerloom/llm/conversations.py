"""Repair of the turn structure of conversations by depth-first branch and bound.

Rows of a conversation stand in the order of their turn (null first; rows of one turn by role, then
by a hash of the text, copies side by side). A row's first fault counts: blank, duplicate (role
and text of an earlier row) or truncated (the last character that is no white space is none of
``.!?``). Edits keep a row (0), give it the role user or assistant (1), delete it (2; blank and
duplicate rows must go) or insert an empty row of user or assistant (5). A truncated row that stays
adds 5. The cheapest edits are wanted after which the first letters of the roles read
``(s?(ua)+)?``; of equally cheap ones the least string of their letters D, I, K, R.

The role that a letter stands for follows from the letters before it: only the first row may be
``s``, and user and assistant take turns. So four states (start, after s, u or a) describe a prefix.

1. Faults and first letters are columns. Narrow rows without texts (a letter, two flags, sixteen
   bytes of digest) are sorted by conversation and turn and read as a stream.
2. At the end of a conversation ``search`` walks the tree of edits with a stack of its own. The
   suffix bound of a row and state is the least cost of any completion, gathered backwards. Deleting
   everything is the first incumbent. A node goes if its cost and bound pass the incumbent's
   cost, if they meet it and its letters are no longer ahead of the incumbent's, or if the
   table of its row and state holds a prefix that is cheaper or as cheap with smaller letters. An equally
   cheap prefix of the same node is never the beginning of another one (the rest could
   only be insertions, which cost), so the order of prefixes is the order of the whole strings.
   When the stack is empty the incumbent is proved.
3. The letters go back to the texts: both are dealt by conversation, the letters first, and the texts
   pass by once in order. Texts are shuffled once and never held together.

So a very long conversation needs some 700 bytes a row in one task, however long its texts are, and
its repaired text is hashed as a stream, which is one task's work by nature.

Null role and null text count as one space; so does a null id or turn in the damage's draw. Null ids
are one conversation. A first letter other than s, u or a, or none, fits nowhere. Equal rows are
separate rows of which the later ones are duplicates. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import read

__all__ = ["damaged", "audits", "repaired", "repaired_texts", "search", "op13", "ORACLE"]

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
# The state after a row of the other role, the only one that may be inserted or given.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60


def _step(state: int, letter: str) -> int | None:
    """State after a row that keeps its role; None where it does not fit."""
    if letter == "s":
        return SYSTEM if state == START else None
    return TURN[state] if letter == {USER: "u", ASSISTANT: "a"}[TURN[state]] else None


# The state after keeping a row, for each letter; any other letter is a "?".
KEPT = {letter: [_step(state, letter) for state in range(4)] for letter in "sua?"}


def suffix_bounds(rows: list[tuple[str, bool, bool]]) -> list[list[int]]:
    """For each row and state the least cost of what is left, and after the last row what is to be inserted."""
    def with_inserts(least: list[int]) -> list[int]:
        for _ in range(2):
            least = [min(c, INSERT + least[TURN[s]]) for s, c in enumerate(least)]
        return least

    bounds = [with_inserts([0, NEVER, NEVER, 0])]
    for letter, forced, cut in reversed(rows):
        after = bounds[-1]
        least = [DELETE + c for c in after]
        if not forced:
            stays, kept = CUT * cut, KEPT[letter]
            for s in range(4):
                least[s] = min(least[s], stays + REROLE + after[TURN[s]])
                if kept[s] is not None:
                    least[s] = min(least[s], stays + KEEP + after[kept[s]])
        bounds.append(with_inserts(least))
    bounds.reverse()
    return bounds


def search(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """``(cost, letters)`` of the cheapest edits of rows ``(letter, must go, truncated)``, ties to the least letters."""
    n = len(rows)
    bounds = suffix_bounds(rows)
    best_cost, best = DELETE * n, "D" * n
    # Nodes of the tree: parent, letter. Node 0 is the root.
    parents, letters = [-1], [""]
    table: dict[tuple[int, int], tuple[int, int]] = {}

    def path(node: int) -> str:
        out = []
        while node > 0:
            out.append(letters[node])
            node = parents[node]
        return "".join(reversed(out))

    stack = [(0, START, 0, -1, "", 0)]
    # Letters in which the walk agrees with the incumbent, and whether it is ahead of it behind them.
    agree, ahead = 0, False
    while stack:
        row, state, cost, parent, letter, depth = stack.pop()
        if depth and depth - 1 <= agree:
            agree, ahead = depth - 1, False
        least = cost + bounds[row][state]
        if least > best_cost:
            continue
        if depth and depth - 1 == agree:
            if depth > len(best) or letter > best[depth - 1]:
                behind = True
            else:
                behind, ahead = False, letter < best[depth - 1]
                agree += not ahead
        else:
            behind = depth > 0 and not ahead
        if least == best_cost and behind:
            continue
        node = 0
        if depth:
            node = len(parents)
            parents.append(parent)
            letters.append(letter)
        known = table.get((row, state))
        if known is not None and (known[0] < cost or known[0] == cost and path(known[1]) <= path(node)):
            continue
        table[row, state] = cost, node
        if row == n and state in (START, ASSISTANT):
            whole = path(node)
            if (cost, whole) < (best_cost, best):
                best_cost, best = cost, whole
                agree, ahead = len(best), False
            continue
        branches = [(cost + INSERT, "I", row, TURN[state])]
        if row < n:
            letter_of, forced, cut = rows[row]
            branches.append((cost + DELETE, "D", row + 1, state))
            if not forced:
                kept = KEPT[letter_of][state]
                branches.append((cost + REROLE + CUT * cut, "R", row + 1, TURN[state]))
                if kept is not None:
                    branches.append((cost + KEEP + CUT * cut, "K", row + 1, kept))
        # The most promising branch is walked first, of equal ones that of the least letter.
        branches = sorted((c + bounds[r][s], x, r, s, c) for c, x, r, s in branches if c + bounds[r][s] <= best_cost)
        stack.extend((r, s, c, node, x, depth + 1) for _, x, r, s, c in reversed(branches))
    return best_cost, best


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after a fixed damage, with ``_present`` and the order ``_by``.

    By ``crc32("conv_id:turn") % 20``: 0 drops a row (it stays with ``_present`` false, so that its conversation is
    known), 1 empties the text, 2 takes its ``.!?`` away, 3 repeats the row, 4 makes the role user.
    """
    rows = ordered(conversations)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("_h", F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20)
    text = F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumns({"text": text, "role": role, "_present": F.col("_h") != 0}).withColumn("_copy", F.explode(times))
    return rows.select("conv_id", "turn", "role", "text", "_present", F.struct("_by.*", "_copy").alias("_by"))


def ordered(conversations: DataFrame) -> DataFrame:
    """The four columns without null roles and texts, ``_present`` and the order ``_by`` of rows of one turn."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumns({"_present": F.lit(True), "_by": F.struct(F.col("role").alias("_role"), F.unhex(F.md5("text")).alias("_md5"))})


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows: id, turn, order, presence, first letter, blank and truncated flags, digest of role and text."""
    words = F.rtrim(F.col("text"), F.lit(SPACE))
    letter = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", "_by", "_present", F.when(letter.isin("s", "u", "a"), letter).otherwise("?").alias("letter"), (words == "").alias("blank"),
        (~F.substring(words, -1, 1).isin(".", "!", "?")).alias("cut"), F.unhex(F.md5(F.concat_ws("\x00", "role", "text"))).alias("digest"))


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(column.to_pylist() for column in batch.slice(start, 256).columns))


def _conversations(rows: Iterable[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """``(id, rows without id)``; rows of a conversation must be read before the next one is asked for."""
    rows = iter(rows)
    ahead = next(rows, None)

    def of(name):
        nonlocal ahead
        while ahead is not None and ahead[0] == name:
            row, ahead = ahead[1:], next(rows, None)
            yield row

    while ahead is not None:
        yield ahead[0], of(ahead[0])


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost and letters of the cheapest edits."""
    def judged(conversation: Iterator[tuple]) -> tuple:
        items, seen = [], set()
        first = last = None
        turns = blank = duplicate = truncated = illegal = 0
        before = ""
        for turn, present, letter, is_blank, is_cut, digest in conversation:
            if not present:
                continue
            if turn is not None and turn != last:
                first = turn if first is None else first
                last, turns = turn, turns + 1
            illegal += bool(before) and before + letter not in ("su", "ua", "au")
            before = letter
            again = not is_blank and digest in seen
            seen.add(digest)
            is_cut = is_cut and not is_blank and not again
            blank, duplicate, truncated = blank + is_blank, duplicate + again, truncated + is_cut
            items.append((letter, is_blank or again, is_cut))
        gaps = 0 if first is None else last - first + 1 - turns
        return gaps, blank, duplicate, truncated, illegal, *search(items)

    def run(batches):
        out = []
        for name, conversation in _conversations(_lists(batches)):
            out.append((name, *judged(conversation)))
            if len(out) == 4096:
                yield _batch(out, AUDIT)
                out = []
        if out:
            yield _batch(out, AUDIT)

    narrow = faults(rows)
    order = [F.col("turn").asc_nulls_first(), "_by"]
    ready = narrow.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    return ready.select("conv_id", "turn", "_present", "letter", "blank", "cut", "digest").mapInArrow(run, AUDIT)


_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, _TYPES[kind]) for column, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def edited(letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of the repaired conversation."""
    state = START
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[role[:1]][state]
        else:
            state = TURN[state]
            role = ROLES[state]
        yield role, text


def _with_letters(rows: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over streams of ``(conv_id, audit columns or None, role, text)`` in which a conversation's audit comes first."""
    audit = F.struct(*[f for f in found.columns if f != "conv_id"])
    texts = rows.filter("_present").select("conv_id", "turn", "_by", F.lit(None).cast(found.select(audit).schema[0].dataType).alias("_found"), "role", "text")
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast(rows.schema["_by"].dataType).alias("_by"), audit.alias("_found"),
                         F.lit("").alias("role"), F.lit("").alias("text"))
    both = heads.unionByName(texts)
    ready = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("_found").isNull(), F.col("turn").asc_nulls_first(), "_by")
    return ready.select("conv_id", "_found.*", "role", "text").mapInArrow(run, schema)


def repaired_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations as rows: ``(conv_id, place, role, text)``, places from 0."""
    at = found.columns.index("audit")

    def run(batches):
        out, held = [], 0
        for name, conversation in _conversations(_lists(batches)):
            letters = next(conversation)[at - 1]
            for place, (role, text) in enumerate(edited(letters, (r[-2:] for r in conversation))):
                out.append((name, place, role, text))
                held += len(text)
                if len(out) == 4096 or held > 4 << 20:
                    yield _batch(out, "conv_id long, place long, role string, text string")
                    out, held = [], 0
            for _ in conversation:  # rows that go at the end
                pass
        if out:
            yield _batch(out, "conv_id long, place long, role string, text string")
    return _with_letters(rows, found, run, "conv_id long, place long, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """The audit of every conversation and the SHA-256 of its repaired rows, ``role:text`` joined by line ends."""
    found = audits(rows)
    schema = f"{AUDIT}, repaired_sha256 string"
    width = len(found.columns)

    def run(batches):
        out = []
        for name, conversation in _conversations(_lists(batches)):
            head = next(conversation)[: width - 1]
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(edited(head[-1], (r[-2:] for r in conversation))):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            for _ in conversation:
                pass
            out.append((name, *head, digest.hexdigest()))
            if len(out) == 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)
    return _with_letters(rows, found, run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(read(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT n, 0 AS k, n::BIGINT AS c FROM range(256) x(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS tab FROM t WHERE k = 8),
r AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT r.*, xor(list_reduce(list_concat([4294967295], list_transform(range(length(key)), lambda i: ascii(substr(key, i + 1, 1))::BIGINT)),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS h FROM r, tab),
d AS (SELECT conv_id, turn, role AS role0, text AS text0, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy,
        CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, md5(text0), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w FROM d),
p AS (SELECT *, w = '' AS blank, w <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, left(role, 1) AS l,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
f AS (SELECT *, NOT blank AND NOT dup AND right(w, 1) NOT IN ('.', '!', '?') AS cut FROM p),
n AS (SELECT conv_id, COUNT(*) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0)::BIGINT AS gaps, SUM(blank::INT)::BIGINT AS blank, SUM(dup::INT)::BIGINT AS duplicate,
        SUM(cut::INT)::BIGINT AS truncated, SUM((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM f GROUP BY conv_id),
s AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, {'cost': 0, 'audit': '', 'body': []::VARCHAR[]} AS b FROM n
  UNION ALL
  SELECT conv_id, i, st, MIN({'cost': cost, 'audit': audit, 'body': body}) FROM (
    SELECT q.conv_id, f.i, e.op, CASE WHEN e.op = 'D' THEN q.st WHEN e.op = 'R' THEN nx WHEN f.l = 's' THEN 1 ELSE nx END AS st,
      cost + CASE e.op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN f.cut AND e.op <> 'D' THEN 5 ELSE 0 END AS cost, audit || e.op AS audit,
      CASE e.op WHEN 'D' THEN body WHEN 'R' THEN list_append(body, CASE nx WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text) ELSE list_append(body, f.role || ':' || f.text) END AS body
    FROM (SELECT z.*, CASE z.st WHEN 2 THEN 3 ELSE 2 END AS nx FROM (
      SELECT conv_id, i, CASE WHEN k = 0 THEN st WHEN (k = 1) = (st <> 2) THEN 2 ELSE 3 END AS st, b.cost + 5 * k AS cost, b.audit || repeat('I', k) AS audit,
        list_concat(b.body, CASE WHEN k = 0 THEN []::VARCHAR[] WHEN st = 2 THEN ['assistant:', 'user:'][1:k] ELSE ['user:', 'assistant:'][1:k] END) AS body
      FROM s, (SELECT unnest([0, 1, 2]) AS k) ks) z) q
    JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1
    JOIN (SELECT unnest(['D', 'K', 'R']) AS op) e ON e.op = 'D' OR NOT f.blank AND NOT f.dup AND (e.op = 'R' OR f.l = 's' AND q.st = 0 OR f.l = CASE q.nx WHEN 2 THEN 'u' ELSE 'a' END)
  ) GROUP BY conv_id, i, st),
z AS (
  SELECT n.conv_id, MIN({'cost': s.b.cost + 5 * k, 'audit': s.b.audit || repeat('I', k),
    'body': list_concat(s.b.body, CASE WHEN k = 0 THEN []::VARCHAR[] WHEN st = 2 THEN ['assistant:', 'user:'][1:k] ELSE ['user:', 'assistant:'][1:k] END)}) AS b
  FROM s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.i, (SELECT unnest([0, 1, 2]) AS k) ks
  WHERE k = 0 AND st IN (0, 3) OR k = 1 AND st = 2 OR k = 2 AND st <> 2 GROUP BY n.conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
  COALESCE(illegal, 0) AS illegal, COALESCE(z.b.cost, 0)::BIGINT AS cost, COALESCE(z.b.audit, '') AS audit,
  sha256(COALESCE(array_to_string(z.b.body, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
