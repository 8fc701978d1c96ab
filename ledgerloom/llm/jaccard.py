"""Similarity join on word shingles by T-occurrence search (DivideSkip).

1. Every text becomes its set of distinct shingle hashes. The hash space is cut into so
   many parts that two sets which may be linked agree in two parts at least; a signature is
   the hash of the set's members in a part, or in two parts with few members. Linked
   sets therefore share a signature. The number of parts comes from the
   size class of a set; sets near the upper end of their class also sign as the next.
   For thresholds under ``PARTS_FROM`` signatures are runs of neighbours in hash order instead.
2. Signatures are gathered by ranges, each with the number of its set's content, so that equal sets
   are one from the start. Sets sharing one form stars around the smallest, first inside a
   slice of documents, then inside a range; a slice and a range each send a spanning forest, one
   link per set and not one per shared signature. Components of these forests are the groups in
   which links can exist.
3. Small groups are packed together, large ones are cut into blocks. In a block an inverted index over
   shingles is searched: the longest lists are set aside, the short ones merged with a heap that skips
   what cannot reach the count, members with enough occurrences looked up in the long lists by
   binary search, and those that reach the required overlap are linked. Sets that are joined to
   the hub of their group already need no search of their own: every pair outside one component
   has been searched from one side at least.
4. Blocks of a large group meet by way of representatives: the smallest set of each component found so far
   is searched among its like. Then all sets outside their group's largest component are *open*, and only
   blocks of open sets are compared with all blocks of the group. A group of near copies has few open
   sets, so every text is sent a few times whatever the size of the group; for a group whose sets are
   unlike each other that is the comparison of all its blocks, which is exact.

Nothing is approximate except the 64-bit hashes. Sets with equal content are one member.
Null, empty and word-less texts have no shingles and are linked with nothing. Equal rows
are linked unless empty. Null ids take part; a component of null ids only has a null id.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, give_back, mapped, mix64, planes, read, row_key, row_slices, text_bytes, unplanes, window_hashes, word_hashes
from ledgerloom.llm.links import components

SHINGLE = 3
THRESHOLD = (90, 100)
RANGE_BYTES = 16 << 20  # text whose signatures meet in one range
BLOCK_SHINGLES = 300_000  # a block of a group holds about so many, and so many members
BLOCK_MEMBERS = 1024
CLASS_RATIO = 1.3
CROWD = 4096  # members in short lists from which they are merged as arrays
RUN = 3  # shingles of a run
PARTS_FROM = 0.9  # thresholds below sign by runs: parts would have so few members that many are empty, and empty ones agree in any two sets
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column, size: int = SHINGLE):
    """``(row, sorted distinct hashes)`` of every text of a column."""
    data, bounds = text_bytes(column)
    for first, end, part, inner in row_slices(data, bounds):
        words = word_hashes(part, inner, lower=True)
        at, hashes = window_hashes(words, size)
        cuts = np.searchsorted(at, words.first)
        for i in range(end - first):
            n = words.first[i + 1] - words.first[i]
            if n >= size:
                yield first + i, np.unique(hashes[cuts[i]: cuts[i + 1]])
            elif n:
                # All the words as one; the number of words keeps it apart from longer ones.
                h = mix64(np.array([n], np.uint64) ^ _SALT)[0]
                for w in words.hashes[words.first[i]: words.first[i + 1]]:
                    h = mix64(np.array([h ^ w]))[0]
                yield first + i, np.array([h], np.uint64)
            else:
                yield first + i, np.zeros(0, np.uint64)


def size_class(n: int, ratio: float = CLASS_RATIO) -> int:
    return int(math.floor(math.log(n) / math.log(ratio) + 1e-9))


def class_parts(k: int, t: float, ratio: float = CLASS_RATIO) -> int:
    """Two parts more than the members in which linked sets up to the size class's upper end may differ."""
    top = math.ceil(ratio ** (k + 1))
    return int(2 * top * (1 - t) / (1 + t) + 1e-9) + 2


def signatures(hashes: np.ndarray, t: float) -> np.ndarray:
    """Signatures of a set in its own class, and in the next if a linked set may lie there.

    Linked sets agree in two parts at least. A part with enough members signs alone. Parts
    with hardly any would bring together unlike sets, so those sign in pairs: two sets
    that agree in such parts only still share the signature of a pair.
    """
    n = len(hashes)
    if not n:
        return hashes
    own = size_class(n)
    out = []
    mixed = mix64(hashes ^ _SALT)
    for k in (own, own + 1):
        if k > own and size_class(int(n / t + 1e-9)) == own:
            break
        parts = class_parts(k, t)
        part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        sums = np.zeros(parts, np.uint64)
        sums[part[at]] = np.add.reduceat(mixed, at)
        sums = mix64(sums ^ mix64(np.arange(parts, dtype=np.uint64) + np.uint64((k + 1) << 32)))
        light = np.bincount(part, minlength=parts) <= (3 if parts <= 128 else 1)
        out.append(sums[~light])
        i, j = np.triu_indices(int(light.sum()), 1)
        weak = sums[light]
        out.append(mix64(weak[i] * np.uint64(3) + weak[j]))
    return np.concatenate(out)


def run_length(n: int, num: int, den: int) -> int:
    """Longest runs, up to ``RUN``, of which linked sets share one at least when the larger has ``n`` members."""
    for w in range(RUN, 1, -1):
        if _shared_runs(n, w, num, den) >= 1:
            return w
    return 1


def _shared_runs(n: int, w: int, num: int, den: int) -> int:
    """Least number of runs of ``w`` that linked sets share when their union has ``n`` members (or more, once it is positive).

    In hash order the members of only one set cut the common ones into stretches. All runs inside a stretch are
    runs of both sets, and ``common - (w - 1) * (others + 1)`` is the least number of them.
    """
    common = -(-num * n // den)
    return common - (w - 1) * (n - common + 1)


def run_signatures(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set for a low threshold: its runs of members that are neighbours in hash order.

    Linked sets share some of their runs, so one is among those of smallest hash, as many as
    leave out fewer than are shared. A set also signs with the run length of the largest set it may be linked with.
    """
    n = len(hashes)
    if not n:
        return hashes
    mixed = mix64(hashes ^ _SALT)
    out = []
    most = den * n // num
    # Least numbers grow with a period; only small sets have lengths out of order.
    period = den // math.gcd(num, den)
    for w in {run_length(u, num, den) for u in (range(n, most + 1) if n < 100 else (n, most))}:
        if n < w:
            continue
        runs = np.full(n - w + 1, w, np.uint64)
        for j in range(w):
            runs = mix64(runs * np.uint64(3) + mixed[j: n - w + 1 + j])
        spare = min(_shared_runs(u, w, num, den) for u in range(n, min(most, n + period) + 1)) - 1
        out.append(np.sort(runs)[: len(runs) - max(0, spare)])
    return np.concatenate(out)


def _stars(sigs: np.ndarray, owners: np.ndarray):
    """Sorted distinct signatures with their smallest owner, and ``(owner, smallest owner)`` pairs."""
    order = np.lexsort((owners, sigs))
    sigs, owners = sigs[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
    pivot = np.repeat(owners[first], np.diff(np.append(first, len(sigs))))
    other = owners != pivot
    return sigs[first], owners[first], np.stack([owners[other], pivot[other]], 1)


def forest(pairs: np.ndarray) -> np.ndarray:
    """``(member, smallest member)`` of each connected component of pairs, without the smallest themselves; sorted by member."""
    members, at = np.unique(pairs, return_inverse=True)
    x, y = at.reshape(-1, 2).T
    root = np.arange(len(members))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(members))
    return np.stack([members[other], members[root[other]]], 1)


def _named(owners: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Owners by the roots of a forest."""
    if not len(links):
        return owners
    at = np.minimum(np.searchsorted(links[:, 0], owners), len(links) - 1)
    return np.where(links[at, 0] == owners, links[at, 1], owners)


def _rows(documents: DataFrame, size: int) -> DataFrame:
    """``(doc_id, key, n, c1, c2)``: the size of every set and 128 bits of its content."""
    def run(batch):
        sizes, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for row, hashes in shingle_sets(batch.column(1), size):
            sizes[row], one[row], two[row] = _content(hashes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(one), pa.array(two)], ["doc_id", "key", "n", "c1", "c2"])
    return mapped(documents.select("doc_id", "text", row_key().alias("key")), run, "doc_id long, key long, n long, c1 long, c2 long")


def _content(hashes: np.ndarray) -> tuple[int, int, int]:
    if not len(hashes):
        return 0, 0, 0
    return len(hashes), np.add.reduce(hashes).astype(np.int64), np.bitwise_xor.reduce(mix64(hashes ^ (_SALT >> np.uint64(1)))).astype(np.int64)


def _owner(content: tuple[int, int, int]) -> np.int64:
    """The number under which a set signs. Unlike sets of one number only meet in a group, where texts decide."""
    return content[1] ^ (content[2] >> np.int64(1))


def _signed(documents: DataFrame, size: int, num: int, den: int, bits: int) -> DataFrame:
    """Signatures and the forest of each slice of documents, by range."""
    def run(batch):
        seen: set = set()
        sigs, owners = [], []
        for row, hashes in shingle_sets(batch.column(0), size):
            content = _content(hashes)
            if not content[0] or content in seen:
                continue  # nothing to sign, or an equal set of this slice has signed already
            seen.add(content)
            sigs.append(signatures(hashes, num / den) if num / den >= PARTS_FROM else run_signatures(hashes, num, den))
            owners.append(np.full(len(sigs[-1]), _owner(content)))
        if not sigs:
            return
        sig, key, pairs = _stars(np.concatenate(sigs), np.concatenate(owners))
        pairs = forest(pairs)
        key = _named(key, pairs)
        ranges = (sig >> np.uint64(64 - bits)).astype(np.int64)
        pair_ranges = mix64(pairs[:, 0].astype(np.uint64)) >> np.uint64(64 - bits)
        out: list[list] = [[], [], [], [], []]
        for r in range(1 << bits):
            a, b = np.searchsorted(ranges, [r, r + 1])
            mine = pairs[pair_ranges == r]
            if a == b and not len(mine):
                continue
            for column, value in zip(out, (r, planes(sig[a:b]), planes(key[a:b].astype(np.uint64)),
                                           planes(mine[:, 0].astype(np.uint64)), planes(mine[:, 1].astype(np.uint64)))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["range", "sigs", "owners", "a", "b"])
    return mapped(documents.select("text"), run, "range int, sigs binary, owners binary, a binary, b binary")


def _range_stars(table: pa.Table) -> pa.Table:
    def column(name):
        return np.concatenate([unplanes(b.as_py()) for b in table[name]])
    _, _, pairs = _stars(column("sigs"), column("owners").astype(np.int64))
    local = np.stack([column("a"), column("b")], 1).astype(np.int64)
    pairs = forest(np.concatenate([pairs, local]))
    give_back()
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def merge_skip(lists: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """Members of at least ``least`` of the sorted lists, and of how many, by a heap of list heads.

    Heads that stand together are counted and moved on. If there are too few of them, as many heads are taken as can be
    missed, and all jump to the next head by binary search: nothing before it can reach the count.
    """
    heap = [(head[0], i) for i, head in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    found, counts = [], []
    while len(heap) >= least:
        member, popped = heap[0][0], []
        while heap and heap[0][0] == member:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found.append(member)
            counts.append(len(popped))
            for i in popped:
                at[i] += 1
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            target = heap[0][0]
            for i in popped:
                at[i] = bisect_left(lists[i], target, at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return found, counts


class InvertedIndex:
    """Shingle -> members, over the sets of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")  # owners stay in order inside a list
        self.members = owner[order]
        self.terms, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)

    def search(self, hashes: np.ndarray, num: int, den: int) -> np.ndarray:
        """Members whose overlap with a set reaches num / den of the union."""
        n = len(hashes)
        least = -(-num * n // den)  # a linked set shares this many at least
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        at = at[self.terms[at] == hashes]
        if len(at) < least:
            return np.zeros(0, np.int64)
        starts, counts = self.starts[at], self.counts[at]
        # Set aside the longest lists, as many as leaves one occurrence among the short ones to ask for.
        aside = min(len(counts), least - 1, int(least / (0.05 * math.log2(max(2, counts.max())) + 1)))
        order = np.argsort(counts, kind="stable")
        short, long = order[: len(counts) - aside], order[len(counts) - aside:]
        lists = [self.members[starts[i]: starts[i] + counts[i]] for i in short]
        if counts[short].sum() > CROWD:
            # Near copies stand in nearly all lists and nothing can be skipped: a merge sort of the sorted runs, counted.
            merged = np.sort(np.concatenate(lists), kind="stable")
            first = np.flatnonzero(np.diff(merged, prepend=-1))
            have = np.diff(np.append(first, len(merged)))
            may, have = merged[first[have >= least - aside]], have[have >= least - aside]
        else:
            may, have = (np.array(x, np.int64) for x in merge_skip([part.tolist() for part in lists], least - aside))
        sizes = self.sizes[may]
        fit = (den * sizes >= num * n) & (den * n >= num * sizes)
        may, have = may[fit], have[fit]
        need = -(-num * (n + self.sizes[may]) // (num + den))
        for k, i in enumerate(long):
            if not len(may):
                break
            members = self.members[starts[i]: starts[i] + counts[i]]
            place = np.minimum(np.searchsorted(members, may), len(members) - 1)
            have = have + (members[place] == may)
            still = have + (len(long) - k - 1) >= need
            may, need, have = may[still], need[still], have[still]
        return may[have >= need]


class Links:
    """Components of a block's links, with their sizes."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.root, self.size = keys, list(range(len(keys))), [1] * len(keys)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, x: int, y: int) -> None:
        p, q = self.find(x), self.find(y)
        if p != q:
            p, q = (p, q) if self.size[p] >= self.size[q] else (q, p)
            self.root[q] = p
            self.size[p] += self.size[q]

    def table(self) -> pa.Table:
        """``(a, b)``: every member but the roots, and the root of its component."""
        roots = np.array([self.find(i) for i in range(len(self.keys))], np.int64)
        other = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": pa.array(self.keys[other], pa.int64()), "b": pa.array(self.keys[roots[other]], pa.int64())})


def _sets(table: pa.Table, size: int) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by("key")
    sets: list = [None] * table.num_rows
    for row, hashes in shingle_sets(table["text"], size):
        sets[row] = hashes
    return table, sets


def _links_in_block(size: int, num: int, den: int):
    """Links inside a block, group by group (column ``root``)."""
    def run(table: pa.Table) -> pa.Table:
        table, sets = _sets(table, size)
        index, links = InvertedIndex(sets), Links(table["key"].to_numpy())
        groups: dict[int, list[int]] = {}
        for i, group in enumerate(table["root"].to_pylist()):
            groups.setdefault(group, []).append(i)
        for members in groups.values():
            hub, waiting = members[0], members
            # Done when all that were not searched are in the hub's component.
            while waiting:
                later = []
                for q in waiting:
                    if q != hub and links.find(q) == links.find(hub):
                        later.append(q)
                        continue
                    for other in index.search(sets[q], num, den).tolist():
                        links.add(q, other)
                    if links.size[links.find(q)] > links.size[links.find(hub)]:
                        hub = q
                waiting = [q for q in later if links.find(q) != links.find(hub)]
        del index, sets
        give_back()
        return links.table()
    return run


def _links_to_open(size: int, num: int, den: int):
    """Links between the open sets sent to a block and the sets that live there."""
    def run(table: pa.Table) -> pa.Table:
        table, sets = _sets(table, size)
        is_open = np.array(table["_open"])
        home, asking = np.flatnonzero(~is_open), np.flatnonzero(is_open)
        links = Links(table["key"].to_numpy())
        if len(home) and len(asking):
            index = InvertedIndex([sets[i] for i in home])
            for q in asking:
                for other in index.search(sets[q], num, den).tolist():
                    links.add(int(q), int(home[other]))
        return links.table()
    return run


def _between_blocks(members: DataFrame, found: DataFrame, texts: DataFrame, search, search_open) -> DataFrame:
    """Links between blocks of large groups, given those inside blocks."""
    # Roots of the blocks' components find one another, in as many blocks of them as they need.
    inside = members.join(found.select(F.col("a").alias("key"), F.col("b").alias("_l")), "key", "left").withColumn("label", F.coalesce("_l", "key")).drop("_l")
    inside = cut(inside)
    speakers = inside.filter("key = label")
    room = speakers.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).cast("int").alias("_room"))
    met = speakers.join(room, "root").select("key", "root", F.col("root").alias("_g"), F.pmod(F.xxhash64("key"), F.col("_room")).cast("int").alias("_block"))
    links = cut(texts.join(met, "key").groupBy("_g", "_block").applyInArrow(search, "a long, b long"))

    # What is not in the largest component of its group is open and meets every block.
    whole = cut(inside.join(links.select(F.col("a").alias("label"), F.col("b").alias("_l")), "label", "left").withColumn("label", F.coalesce("_l", "label")).drop("_l"))
    counts = whole.groupBy("root", "label").agg(F.count("*").alias("_c"))
    largest = counts.groupBy("root").agg(F.max(F.struct("_c", "label")).alias("_top")).select(F.col("root").alias("_r"), F.col("_top.label").alias("_label"))
    open_sets = cut(whole.join(largest, F.col("root") == F.col("_r")).filter("label <> _label").select("key", "root", "n", "_blocks"))
    if open_sets.isEmpty():
        return links
    shares = open_sets.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).cast("int").alias("_shares"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = open_sets.join(shares, "root").select("key", "root", F.pmod(F.xxhash64("key"), F.col("_shares")).cast("int").alias("_share"), each("_blocks").alias("_block"), F.lit(True).alias("_open"))
    home = members.join(shares, "root").select("key", "root", "_block", each("_shares").alias("_share"), F.lit(False).alias("_open"))
    placed = texts.join(home.unionByName(asking).withColumn("_g", F.col("root")), "key")
    return links.unionByName(cut(placed.groupBy("_g", "_share", "_block").applyInArrow(search_open, "a long, b long")))


def join(documents: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``(doc_id, key, n_shingles, component_id, kept)``, one row per row of documents.

    ``key`` is that of ``row_key``. ``kept`` marks the row that stays of a component: the one
    with the smallest id (then key); equal rows are all marked.
    """
    num, den = threshold
    documents = documents.select("doc_id", "text")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, math.ceil(math.log2(max(1, total / RANGE_BYTES))))
    # Two passes over the texts cost less than a copy of the signatures on the shared folder.
    rows = cut(_rows(documents, size))
    stars = _signed(documents, size, num, den, bits).groupBy("range").applyInArrow(_range_stars, "a long, b long")
    groups = components(stars)

    # Equal sets: the smallest key stands for all of them.
    content = ["n", "c1", "c2"]
    equal = cut(rows.filter("n > 0").groupBy(*content).agg(F.min("key").alias("_rep")))
    named = cut(rows.join(equal, content, "left").select("doc_id", "n", "key", "_rep"))
    owner = F.col("c1").bitwiseXOR(F.shiftright("c2", 1))
    members = cut(equal.select(F.col("_rep").alias("key"), "n", owner.alias("v")).join(groups, "v").select("key", "root", "n"))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).cast("int")
    sized = cut(members.groupBy("root").agg(F.count("*").alias("_m"), F.sum("n").alias("_sum"), blocks.alias("_blocks")).filter("_m > 1"))
    packs = max(1, math.ceil((sized.filter("_blocks = 1").agg(F.sum("_sum")).first()[0] or 0) / BLOCK_SHINGLES))
    members = cut(members.join(sized, "root").select("key", "root", "n", "_blocks", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int").alias("_block")))
    large = F.col("_blocks") > 1

    # The texts of members are looked up once and kept; every later round deals these only.
    texts = cut(documents.select("text", row_key().alias("key")).join(members.hint("shuffle_merge"), "key").dropDuplicates(["key"]))
    placed = texts.select("key", "root", "text", "_block", F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))).alias("_g"), large.alias("_large"))
    search = _links_in_block(size, num, den)
    found = cut(placed.groupBy("_large", "_g", "_block").applyInArrow(search, "a long, b long"))
    many = members.filter(large)
    if not many.isEmpty():
        found = found.unionByName(_between_blocks(many, found, texts.filter(large).select("key", "text"), search, _links_to_open(size, num, den)))

    # Links between sets, then the smallest id of each component over all rows.
    roots = components(found)
    whole = cut(named.withColumn("_v", F.coalesce("_rep", "key")).join(roots, F.col("_v") == F.col("v"), "left").select(
        "doc_id", "key", "n", F.coalesce("root", "_v").alias("_root")))
    # Sets without shingles are alone, even when their rows are equal.
    linked = whole.filter("n > 0")
    least = cut(linked.groupBy("_root").agg(F.min("doc_id").alias("_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_best")))
    out = linked.join(least, "_root").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"),
                                             (F.col("key") == F.col("_best.key")).alias("kept"))
    alone = whole.filter("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op5(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i: i + {SHINGLE - 1}], ' ')) AS h
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id WHERE c.root < e.b)
SELECT d.doc_id, COALESCE(any_value(n.n), 0)::BIGINT AS n_shingles, MIN(c.root) AS component_id
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
