"""Similarity join on word n-grams with adaptive multi-match prefixes.

Shingles have one order over the corpus. Texts with a Jaccard similarity of t
share at least l of the first |x| - ceil(t|x|) + l shingles of either (Wang, Li and Feng, "Can we
beat the prefix filtering?", SIGMOD 2012). First every text is held against the whole corpus at a deep l, in
proportion to its size: if fewer of its prefix's shingles stand in any other prefix than the smallest partner
would ask for, it links with nothing; that order is by hash. The others' sets are stored once and held against each other whole, which leaves near
copies, whose shingles are put in order of how many sets hold them, rare ones first. Each takes the l that its prefix's frequencies make cheapest. Texts of equal sets are one class from the start; links are
first sought to one class per shared shingle, and pairs already in one component need no further check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.lineage import cut
from cytoframe.llm.components import components
from cytoframe.llm.words import find_words, mix, runs, slices

WIDTH = 4
PERCENT = 85
DEEP_PERCENT = 8
MATCH_PERCENT = 30
SLICE_BYTES = 2 << 20
FLUSH_SHINGLES = 1_000_000
PART_BYTES = 16 << 20
CHECK_SHINGLES = 1 << 21
BLOCK_SHINGLES = 1 << 19
TOKEN_BITS = 48
FILTER_BITS = 1 << 25
HOT = 64
_LOW = np.uint64((1 << 58) - 1)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """58-bit hashes of all shingles of each text, repeats included, and where each text's begin."""
    words = find_words(texts, lower=True)
    ptr, n = words.ptr, words.counts()
    if not len(words.hash):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_ptr = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(out_ptr[-1]) + np.repeat(ptr[:-1] - out_ptr[:-1], many)
    length = np.repeat(np.minimum(n, width), many)
    value = length.astype(np.uint64)
    for step in range(width):
        inside = length > step
        value[inside] = mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + words.hash[first[inside] + step])
    return value & _LOW, out_ptr


def signature(members: np.ndarray) -> int:
    """One 64-bit number of a set."""
    spread = mix(members)
    parts = np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(spread)) if len(spread) else 0, len(members)], np.uint64)
    return int(mix(parts[:1] ^ mix(parts[1:2] ^ mix(parts[2:])))[0].view(np.int64))


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    values, ptr = shingles(texts, width)
    for a, b in zip(ptr[:-1], ptr[1:], strict=True):
        yield np.unique(values[a:b])


def _needed(n, percent: int):
    """Shingles that a set of n shares with any set it links with; of a number, an array or a column."""
    return F.ceil(n * percent / 100) if isinstance(n, Column) else -(-percent * n // 100)


def _deepest(n, percent: int, share: int):
    """The greatest l that a set of n takes part with: ``share`` percent of it, as far as a link asks for so many."""
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.least(_needed(n, percent), F.ceil(n * share / 100)))
    return max(1, min(_needed(n, percent), -(-share * n // 100)))


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _six(tokens: np.ndarray) -> bytes:
    """The high 48 of the 58 bits of each shingle."""
    return _pack(tokens >> np.uint64(58 - TOKEN_BITS))


def _unsix(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def _shared_counts(described: DataFrame, parts: int) -> DataFrame:
    """(class, shared): at least as many shingles of a class's prefix as other classes' prefixes hold.

    A task counts what its own classes share and sends such a shingle once, marked; the others go, packed, to the part that owns
    their hash. So a shingle that a third of all classes hold moves once for a flush. Shingles are told apart by 32
    bits and the part's; a class that stands in several flushes may count a shingle more than once. Both only make more classes stay:
    a shingle taken for another still counts for itself.
    """
    bits = parts.bit_length() - 1
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            names = np.fromiter(held, np.int64, len(held))
            token = _unsix(b"".join(held.values()))
            owner = np.repeat(names, [len(b) // 6 for b in held.values()])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            new = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
            many = np.diff(new, append=len(token))
            again = np.repeat(many > 1, many)
            own, times = np.unique(owner[again], return_counts=True)
            token, owner, marked = token[new], owner[new], many > 1
            part = (token >> np.uint64(TOKEN_BITS - bits)).astype(np.int64)
            order = np.lexsort((owner, marked, part))
            token, owner, marked, part = token[order].astype(np.uint32), owner[order], marked[order], part[order]
            home = mix(own.view(np.uint64)) % np.uint64(parts)
            turn = np.argsort(home, kind="stable")
            own, times = own[turn], times[turn].astype(np.uint32)
            edges, homes = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(home[turn], np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for k in np.flatnonzero(np.diff(edges) + np.diff(homes)):
                low, high, mine = edges[k], edges[k + 1], slice(homes[k], homes[k + 1])
                single = low + int((~marked[low:high]).sum())
                first = np.flatnonzero(np.diff(owner[low:single], prepend=~owner[low:single][:1]) != 0)
                sizes = np.diff(first, append=single - low)
                head = np.array([len(first), single - low, high - single, len(own[mine])], np.uint32).tobytes()
                lists = owner[low:single][first].tobytes() + sizes.astype(np.uint32).tobytes() + token[low:high].tobytes()
                rows.append((k, head + lists + own[mine].tobytes() + times[mine].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "blob"])

        for batch in batches:
            for name, n, prefix in zip(*(batch.column(c).to_pylist() for c in ("class", "n_shingles", "prefix")), strict=True):
                if n and name not in held:
                    held[name] = prefix
                    size += len(prefix) // 6
                    if size >= FLUSH_SHINGLES:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tokens, owners, shared, names, counts = [], [], [], [], []
        for item in table.column("blob"):
            data = memoryview(item.as_py())
            heads, single, marked, m = (int(x) for x in np.frombuffer(data, np.uint32, 4))
            owners.append(np.repeat(np.frombuffer(data, np.int64, heads, 16), np.frombuffer(data, np.uint32, heads, 16 + 8 * heads)))
            at = 16 + 12 * heads
            tokens.append(np.frombuffer(data, np.uint32, single, at))
            shared.append(np.frombuffer(data, np.uint32, marked, at + 4 * single))
            at += 4 * (single + marked)
            names.append(np.frombuffer(data, np.int64, m, at))
            counts.append(np.frombuffer(data, np.uint32, m, at + 8 * m).astype(np.int64))
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1) != 0)
        if len(new):
            fresh = np.ones(len(token), np.int64)
            fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            several = (np.add.reduceat(fresh, new) > 1) | np.isin(token[new], np.concatenate(shared))
            kept = np.repeat(several, np.diff(new, append=len(token)))
            names.append(owner[kept])
            counts.append(np.ones(int(kept.sum()), np.int64))
        names, which = np.unique(np.concatenate(names), return_inverse=True)
        return pa.table([names, np.bincount(which, np.concatenate(counts), len(names)).astype(np.int64)], ["class", "shared"])

    sent = described.select("class", "n_shingles", "prefix").mapInArrow(send, schema)
    return sent.groupBy("part").applyInArrow(count, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """A column of lists, or of packed ones, as flat dense numbers, their bounds, and how many numbers there are."""
    rows = column.combine_chunks()
    if pa.types.is_binary(rows.type) or pa.types.is_large_binary(rows.type):
        sets = [_unsix(x.as_py()) for x in rows]
        flat, sizes = np.concatenate(sets), [len(x) for x in sets]
    else:
        flat, sizes = rows.flatten().to_numpy(), rows.value_lengths().to_numpy()
    known, dense = np.unique(flat, return_inverse=True)
    return dense, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), len(known)


def _ordered_sets(sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """(class, n, members, levels): of sets (class, n, members) the shingles that others hold too, rarest first.

    Only sets that share as many as a link asks for stay. A shingle's level is the logarithm of how many of the sets hold it, ``HOT`` if ``HOT``
    sets or more of one flush do; such a shingle is announced once, so that what one part gets of it is bounded by
    the flushes. A level is the shingle's own, the same in every set. Levels return to the flush that asked, one row from each
    part. Members are packed in 48 bits, levels a byte each.
    """
    bits = parts.bit_length() - 1
    number, blob = T.StructField("flush", T.LongType()), T.StructField("blob", T.BinaryType())
    sent = T.StructType([T.StructField("part", T.IntegerType()), number, blob])
    ranked = T.StructType([number, blob])

    def lists(owner: np.ndarray, n: np.ndarray, token: np.ndarray) -> bytes:
        """Rows sorted by owner as heads (owner, its size, how many) and tokens."""
        first = np.flatnonzero(np.diff(owner, prepend=~owner[:1]) != 0)
        many = np.diff(first, append=len(owner)).astype(np.uint32)
        return np.uint32(len(first)).tobytes() + owner[first].tobytes() + n[first].astype(np.uint32).tobytes() + many.tobytes() + _pack(token)

    def unlist(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        heads = int(np.frombuffer(data, np.uint32, 1)[0])
        many = np.frombuffer(data, np.uint32, heads, 4 + 12 * heads)
        end = 4 + 16 * heads + 6 * int(many.sum())
        owner, n = np.frombuffer(data, np.int64, heads, 4), np.frombuffer(data, np.uint32, heads, 4 + 8 * heads)
        return np.repeat(owner, many), np.repeat(n, many), _unsix(bytes(data[4 + 16 * heads : end])), end

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, bytes]] = {}
        size, name_of_flush = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            packed = [b for _, b in held.values()]
            token, many = _unsix(b"".join(packed)), [len(b) // 6 for b in packed]
            owner = np.repeat(np.fromiter(held, np.int64, len(held)), many)
            n = np.repeat(np.array([n for n, _ in held.values()]), many)
            _, which, times = np.unique(token, return_inverse=True, return_counts=True)
            hot = times[which] >= HOT
            announced = np.unique(token[hot])
            home = np.where(hot, name_of_flush % parts, (token >> np.uint64(TOKEN_BITS - bits)).astype(np.int64))
            order = np.lexsort((token, owner, hot, home))
            owner, n, token, hot, home = (x[order] for x in (owner, n, token, hot, home))
            edges = np.searchsorted(home, np.arange(parts + 1))
            marks = np.searchsorted(announced >> np.uint64(TOKEN_BITS - bits), np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for k in np.flatnonzero(np.diff(edges) + np.diff(marks)):
                low, high, marked = edges[k], edges[k + 1], announced[marks[k] : marks[k + 1]]
                middle = low + int((~hot[low:high]).sum())
                cold, own = (lists(owner[a:b], n[a:b], token[a:b]) for a, b in ((low, middle), (middle, high)))
                rows.append((k, cold + own + _pack(marked)))
            columns = [pa.array([k for k, _ in rows], pa.int32()), pa.array([name_of_flush] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, sent.names)

        for batch in batches:
            for name, n, members in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "members")), strict=True):
                if name not in held:
                    held[name] = n, members
                    size += n
                    if size >= FLUSH_SHINGLES:
                        yield flush()
                        held, size, name_of_flush = {}, 0, name_of_flush + 1
        if held:
            yield flush()

    def rank(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cold, own, marks, sizes = [], [], [], []
        for item in table.column("blob"):
            data = memoryview(item.as_py())
            owner, n, token, at = unlist(data)
            cold.append((owner, n, token))
            sizes.append(len(owner))
            *rows, end = unlist(data[at:])
            own.append(rows)
            marks.append(_unsix(bytes(data[at + end :])))
        owner, token = np.concatenate([c[0] for c in cold]), np.concatenate([c[2] for c in cold])
        order = np.lexsort((owner, token))
        ordered, whose = token[order].view(np.int64), owner[order]
        new = np.diff(ordered, prepend=-1) != 0
        fresh = (new | (np.diff(whose, prepend=~whose[:1]) != 0)).astype(np.int64)
        first = np.flatnonzero(new)
        times = np.add.reduceat(fresh, first) if len(first) else fresh
        hot = np.isin(ordered[first].view(np.uint64), np.concatenate(marks))
        level = np.where(hot, HOT, np.minimum(HOT - 1, np.floor(np.log2(np.maximum(times, 1))).astype(np.int64)))
        levels = np.empty(len(order), np.uint8)
        levels[order] = np.repeat(level, np.diff(first, append=len(order)))
        out = []
        for (owner, n, token), (owner_, n_, token_), level in zip(cold, own, np.split(levels, np.cumsum(sizes)[:-1]), strict=True):
            kept = level > 0
            marked = np.full(len(owner_), HOT, np.uint8)
            out.append(lists(owner[kept], n[kept], token[kept]) + lists(owner_, n_, token_) + level[kept].tobytes() + marked.tobytes())
        return pa.table([table.column("flush"), pa.array(out, pa.binary())], names=ranked.names)

    names = ["class", "n", "members", "levels"]

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = []
        for item in table.column("blob"):
            data = memoryview(item.as_py())
            *one, at = unlist(data)
            *two, end = unlist(data[at:])
            level = np.frombuffer(data, np.uint8, len(one[0]) + len(two[0]), at + end)
            rows += [(*one, level[: len(one[0])]), (*two, level[len(one[0]) :])]
        owner, n, token, level = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((token, level, owner))
        owner, n, token, level = owner[order], n[order], token[order], level[order]
        first = np.flatnonzero(np.diff(owner, prepend=~owner[:1]) != 0)
        ends = np.append(first[1:], len(owner))[: len(first)]
        made = [(int(owner[a]), int(n[a]), _pack(token[a:b]), level[a:b].tobytes()) for a, b in zip(first, ends, strict=True) if b - a >= _needed(int(n[a]), percent)]
        return pa.table([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    asked = sets.select("class", "n", "members").mapInArrow(send, sent)
    near = asked.groupBy("part").applyInArrow(rank, ranked).groupBy("flush").applyInArrow(gather, "class long, n long, members binary, levels binary")
    return near.groupBy("class").agg(*[F.first(c).alias(c) for c in names[1:]])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n), where n is the size of b's set, those (a, b) whose sets are as alike as asked.

    All partners of one ``a`` meet it in one task, or in several of about ``CHECK_SHINGLES`` shingles: the set of ``a`` moves once for each.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.sum("n") / CHECK_SHINGLES).alias("chunks"))
    salted = cut(pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk")))
    ours = salted.select("a", "chunk").distinct().join(sets.select(F.col("class").alias("a"), "n", "members"), "a")
    theirs = salted.join(sets.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("members").alias("other")), "b")
    theirs = theirs.select(F.col("a").alias("a"), F.col("chunk").alias("chunk"), "b", "m", "other")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows:
            name, n, x = (left.column(c)[0].as_py() for c in ("a", "n", "members"))
            x = _unsix(x)
            for b, m, other in zip(*(right.column(c).to_pylist() for c in ("b", "m", "other")), strict=True):
                both = len(np.intersect1d(x, _unsix(other), assume_unique=True))
                if 100 * both >= percent * (n + m - both):
                    found.append((name, b))
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return ours.groupBy("a", "chunk").cogroup(theirs.groupBy("a", "chunk")).applyInArrow(check, "a long, b long")


class _Postings:
    """Which lists hold each number at which level, for counting what one list shares with all others."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, many: int, level: np.ndarray):
        self.values, self.bounds = values, bounds
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort(values, kind="stable")
        self.owner, self.ptr = owner[order], np.concatenate([[0], np.cumsum(np.bincount(values, minlength=many))])
        self.level, self.sorted_level = level, level[order]

    def shared(self, row: int, deepest: np.ndarray) -> np.ndarray:
        """How many numbers of list ``row`` each list holds, counting levels up to the lesser of both lists' ``deepest``."""
        own = slice(self.bounds[row], self.bounds[row + 1])
        tokens = self.values[own]
        sizes = self.ptr[tokens + 1] - self.ptr[tokens]
        at = runs(self.ptr[tokens], sizes)
        owner = self.owner[at]
        both = np.minimum(deepest[owner], deepest[row])
        within = (self.sorted_level[at] <= both) & (np.repeat(self.level[own], sizes) <= both)
        return np.bincount(owner[within], minlength=len(self.bounds) - 1)


def _meet(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join components among the classes of two blocks, no more than there are classes."""
    side, names, n = (table.column(c).to_numpy() for c in ("side", "class", "n"))
    depth, component = table.column("depth").to_numpy(), table.column("component").to_numpy()
    members, member_bounds, _ = _lists(table.column("members"))
    prefix = _Postings(*_lists(table.column("prefix")), table.column("levels").combine_chunks().flatten().to_numpy())
    parent = {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    across = bool((side == 1).any())
    links = []
    for i in np.flatnonzero(side == 0):
        near = (prefix.shared(i, depth) >= np.minimum(depth, depth[i])) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n)
        near &= (component != component[i]) & ((side == 1) if across else (names > names[i]))
        for j in np.flatnonzero(near):
            one, two = root(int(component[i])), root(int(component[j]))
            if one == two:
                continue
            x, y = (members[member_bounds[k] : member_bounds[k + 1]] for k in (i, j))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (n[i] + n[j] - both):
                parent[max(one, two)] = min(one, two)
                links.append((int(names[i]), int(names[j])))
    return links


def _many(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among classes that meet in the prefix shingles of ``entries``.

    Classes tied by these form families. Small families share blocks; one of more than ``BLOCK_SHINGLES`` shingles is cut,
    by the leading class of a class's most frequent shingle and then by hash. Blocks that share a frequent shingle, which
    only blocks of one family do, meet in one task, to which a set moves once for a pair of blocks instead of once for a
    pair of classes. All candidates between the two are checked there, and only links that join components leave it.
    """
    lead = entries.groupBy("class").agg(F.max(F.struct("df", "token", "lead"))["lead"].alias("lead"), F.first("n").alias("n"))
    family = components(entries.select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct())
    known = lead.join(family.select(F.col("node").alias("class"), F.col("component").alias("family")), "class", "left")
    known = cut(known.withColumn("family", F.coalesce("family", "class")))
    blocks = max(1, -(-(known.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES))
    size = known.groupBy("family").agg(F.sum("n").alias("many"))
    led = known.groupBy("family", "lead").agg(F.sum("n").alias("led"))
    parts = F.ceil(F.col("many") / BLOCK_SHINGLES)
    own = F.when(F.col("led") > BLOCK_SHINGLES, F.xxhash64("family", "lead", F.pmod(F.xxhash64("class"), F.ceil(F.col("led") / BLOCK_SHINGLES))))
    own = own.otherwise(F.xxhash64("family", F.pmod(F.xxhash64("lead"), parts)))
    shared = F.pmod(F.xxhash64("family"), F.lit(blocks))
    placed = known.join(size, "family").join(led, ["family", "lead"])
    placed = cut(placed.select("class", F.when(F.col("many") > BLOCK_SHINGLES, own).otherwise(shared).alias("block")))
    at = entries.select("token", "class").join(placed, "class").select("token", "block").distinct()
    pairs = (
        at.alias("x").join(at.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")))
        .select(F.col("x.block").alias("one"), F.col("y.block").alias("two")).distinct()
    )
    pairs = cut(pairs)
    facts = entries.join(placed, "class", "left_semi").groupBy("class").agg(
        F.first("n").alias("n"), F.first("depth").cast("long").alias("depth"), F.first("component").alias("component"),
        F.collect_list(F.struct("token", "level")).alias("_prefix"),
    )
    rows = cut(
        facts.join(placed, "class").join(sets.select("class", "members"), "class")
        .select("block", "class", "n", "depth", "component", F.col("_prefix.token").alias("prefix"), F.col("_prefix.level").alias("levels"), "members")
    )
    first = pairs.select("one", "two", F.col("one").alias("block"), F.lit(0).alias("side"))
    second = pairs.where("one <> two").select("one", "two", F.col("two").alias("block"), F.lit(1).alias("side"))
    met = first.unionByName(second).join(rows, "block").drop("block")

    def meet(table: pa.Table) -> pa.Table:
        links = _meet(table, percent)
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return met.groupBy("one", "two").applyInArrow(meet, "a long, b long")


def _bitmap(places: DataFrame) -> np.ndarray:
    """Bytes of a bitmap of ``FILTER_BITS`` with every ``bit`` of the table set; at most that many bits come to the driver."""
    from_one = places.select((F.col("bit") + 1).alias("bit"))  # Spark's bitmaps hold 1 to 32768, 32769 to 65536 and so on
    number = F.bitmap_bucket_number("bit").alias("bucket")
    rows = from_one.groupBy(number).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Two texts link when 100 * |x & y| >= percent * |x | y| for their sets of ``width``-word shingles (A-Z
    folded; a shorter text is one shingle, a text without words or a null has none and links with
    nothing). ``component_id`` is the smallest doc_id reachable. Rows that share a doc_id or lack one stay
    rows; a component of null ids only has a null id. Whole texts of any length take part, in slices of ``SLICE_BYTES``, a longer one
    by itself; an empty table gives an empty result; other columns don't matter. Shingles are counted by 58-bit hashes and
    compared by 48 bits of them, equal sets found by 64-bit ones.
    """
    docs = docs.select("doc_id", "text")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << min(16, max(3, (held // PART_BYTES).bit_length()))

    # every document's size, class and deepest prefix
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                rows = [(len(s), signature(s), _six(s[: len(s) - _needed(len(s), percent) + _deepest(len(s), percent, DEEP_PERCENT)])) for s in _sets(batch.column("text"), width)]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), *columns], ["doc_id", "content", "n_shingles", "class", "prefix"])

    id_type = docs.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("content", "n_shingles", "class")], T.StructField("prefix", T.BinaryType())])
    keyed = docs.withColumn("content", F.xxhash64("text"))
    described = cut(keyed.mapInArrow(describe, shape))

    # classes whose prefix shares enough with the rest of the corpus; a partner has at least ``percent`` of a set's shingles
    shared = _shared_counts(described, parts)
    n = F.col("n_shingles")
    asked = _deepest(_needed(n, percent), percent, DEEP_PERCENT)
    classes = described.where("n_shingles > 0").groupBy("class", "n_shingles").agg(F.min(F.struct("content", "doc_id")).alias("one"))
    chosen = cut(classes.join(shared, "class").where(F.col("shared") >= asked).select("class", "one"))

    # their sets, from one document of each: a bitmap of fixed size tells which texts to read, the join by class is exact
    place = F.pmod(F.xxhash64("content", "doc_id"), F.lit(FILTER_BITS))
    bits = _bitmap(chosen.select("one.*").select(place.alias("bit")))

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            texts = batch.column("text").filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES):
                for members in _sets(part.column("text"), width):
                    name = signature(members)
                    if name not in done:
                        done.add(name)
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([len(members)], pa.int64()), pa.array([_six(members)], pa.binary())], ["class", "n", "members"])

    read = keyed.select(place.alias("bit"), "text").mapInArrow(collect_sets, "class long, n long, members binary")
    sets = cut(read.join(chosen.select("class"), "class", "left_semi"))

    # among these, whole sets: a set that links shares ``percent`` of its shingles with its partner, so with the others together
    sets = cut(_ordered_sets(sets, parts, percent))

    # their prefixes, and how many of them hold each shingle; shingles that no other set holds come first and are left out
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for name, n, members in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "members")), strict=True):
                every = _unsix(members)
                first = n - _needed(n, percent) + 1
                place = n - len(every) + np.arange(len(every))
                taken = every[place < first + _deepest(n, percent, MATCH_PERCENT) - 1].view(np.int64)
                row = (taken, np.full(len(taken), name, np.int64), np.full(len(taken), n), np.maximum(1, place[: len(taken)] - first + 2).astype(np.int32))
                for column, values in zip(columns, row, strict=True):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["token", "class", "n", "level"])

    every = cut(sets.select("class", "n", "members").mapInArrow(prefixes, "token long, class long, n long, level int"))
    held_by = every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    entries = cut(every.join(held_by, "token"))

    # each class takes the number of matches that costs least: entries read, and candidates that can have so many
    costs = [F.struct(F.lit(float("inf")).alias("cost"), F.lit(1).alias("depth"))]
    for depth in (1 << k for k in range(20)):
        read = F.sum(F.when(F.col("level") <= depth, F.col("df") - 1).otherwise(0))
        possible = F.lit(depth) <= _deepest(F.max("n"), percent, MATCH_PERCENT)
        costs.append(F.when(possible, F.struct((read + read / depth * F.max("n")).alias("cost"), F.lit(depth).alias("depth"))))
    depth = entries.groupBy("class").agg(F.least(*costs)["depth"].alias("depth"))
    prefix = cut(entries.join(depth, "class").where(F.col("level") <= F.col("depth")))

    # first to one class of each shared shingle: as many pairs as prefix entries at most, and all of a group of copies meet
    hub = prefix.groupBy("token").agg(F.min(F.struct("n", "class", "depth")).alias("hub"))
    rays = cut(
        prefix.join(hub, "token").where((F.col("hub.class") != F.col("class")) & (100 * F.col("hub.n") >= percent * F.col("n")))
        .groupBy(F.col("hub.class").alias("a"), F.col("class").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("depth", "hub.depth")).alias("depth"), F.first("n").alias("n"))
        .where(F.col("shared") >= F.col("depth")).select("a", "b", "n")
    )
    star_links = cut(_linked(rays, sets, percent))
    labels = components(star_links)

    # then every other pair with enough shared prefix shingles, unless it is in one component already
    labelled = prefix.drop("df").join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "class"))
    mixed = labelled.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.min("class").alias("lead"), (F.min("component") != F.max("component")).alias("open")
    )
    open_ = cut(labelled.join(mixed.where("open").drop("open"), "token"))
    joined = components(star_links.unionByName(cut(_many(open_, sets, percent))))

    grouped = described.join(joined.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    grouped = cut(grouped.select("doc_id", "n_shingles", "component"))
    smallest = grouped.where(F.col("n_shingles") > 0).groupBy("component").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("rows"))
    several = cut(smallest.where(F.col("rows") > 1).select("component", "smallest"))
    found = grouped.join(several, "component", "left")
    alone = F.when((F.col("n_shingles") > 0) & F.col("smallest").isNotNull(), F.col("smallest")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", alone.alias("component_id"))
