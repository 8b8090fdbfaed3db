"""Near-duplicate join of word-shingle sets by exact Jaccard similarity.

Sets are arrays of sorted 64-bit shingle hashes. The join loses no link:

1. Equal sets share a digest (``sid``) and are one node from there on.
2. Candidates. Two sets that link overlap so much that they share an element of their prefixes:
   the first n - ceil(n * percent / 100) + 1 elements in any order that holds for all sets.
   Here rare shingles come first, as a table of SLOTS counters over all documents
   tells (the order decides how much work there is, never the result). Sets with a common
   prefix element and sizes within a factor of two (those near the upper end are in two such
   bands, since what links may differ that much in size) form a group; equal groups are kept once. Within a group, sets are tied
   unless their sizes or their hashed bitmaps rule a link out: a bit is the parity of the elements
   that hash to it, so bits that differ can't be more than elements that differ. What ties
   connect is a cluster, and every link lies within a cluster.
3. Verification. The sets of clusters travel in tiles of about TILE sets of one cluster. Within a
   tile sets are ordered by size and only bands of sizes that may link meet; larger bitmaps
   bound the overlap from above (an element whose bit the other set lacks isn't in it), and
   what passes is intersected exactly. Pairs that are already connected are not compared again,
   so a group of thousands of near copies takes about as many exact comparisons as it has
   members. Clusters of several tiles are then compared across these (see ``_across``).

Defined results: texts that are null or without words have an empty set and link with
nothing; fewer words than a shingle has give one shingle of all words; equal ids and
repeated rows are kept row by row; null ids take part, and a component's id is the smallest
id that isn't null; an empty table gives no rows; other columns are not read. Two different
sets are taken for one only if their 64-bit digests collide (n^2 / 2^65 for n sets).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, membership, numbered, pieces, present
from .graph import components

TILE = 500
#: Rows of a table that may be broadcast (about 16 bytes each).
BROADCAST_ROWS = 500_000
#: Counters of the rarity table, the pieces in which it travels, and how many tasks' tables are added at a time.
SLOT_BITS, CHUNKS, PARTS = 20, 64, 64
#: Least and most bits of the signatures that travel with groups, and members of a group that meet in one task.
LEAST_BITS, MOST_BITS, GROUP = 512, 1 << 15, 4_096
SEEN = 200_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, _U)
    for k in range(size):
        total = _mix(total + h[k : k + len(total)])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(hashes: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Prefix elements: keys of which two sets that link share at least one."""
    size = len(hashes) - -(-len(hashes) * percent // 100) + 1
    ordered = levels[(hashes >> _U(64 - SLOT_BITS)).astype(np.int64)].astype(_U) << _U(56) | hashes >> _U(8)
    return np.partition(ordered, size - 1)[:size]


def banded(keys: np.ndarray, size: int, percent: int) -> np.ndarray:
    """The keys within the set's band of sizes (a power of two), and within the next one where a larger set may link."""
    band = size.bit_length() - 1
    bands = [band, band + 1] if 100 * size >= percent << band + 1 else [band]
    return np.concatenate([_mix(keys + _U((b + 1) * 0x9E3779B97F4A7C15 % 2**64)) for b in bands])


def signature(hashes: np.ndarray) -> bytes:
    """Parities of the elements that hash to each bit; about as many bits as elements, since fewer would be alike for any two large sets."""
    bits = MOST_BITS
    while bits > LEAST_BITS and bits >= 2 * len(hashes):
        bits //= 2
    return np.packbits(np.bincount((_mix(hashes) & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _count_slots(width: int):
    """(chunk, part, packed): how many of this task's distinct sets have an element in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SLOT_BITS, np.int64), set()
        for batch in pieces(batches, most=4 << 20, operator="ngram_join"):
            for text in batch.column(0).to_pylist():
                h = shingles(text, width)
                if (sid := set_id(h)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    np.add.at(counts, (h >> _U(64 - SLOT_BITS)).astype(np.int64), 1)
        chunks = counts.reshape(CHUNKS, -1)
        part = TaskContext.get().partitionId() // PARTS
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "part", "packed"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.int64) for x in table.column("packed").to_pylist()], axis=0)
    return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "packed": pa.array([total.tobytes()], pa.binary())})


def rarity(texts: DataFrame, width: int) -> np.ndarray:
    """A level for each slot, higher for slots whose shingles are in more sets; its size doesn't depend on the data."""
    schema = "chunk int, part int, packed binary"
    parts = texts.mapInArrow(_count_slots(width), schema).groupBy("chunk", "part").applyInArrow(_added, schema)
    counts = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.int64)
    for r in parts.groupBy("chunk").applyInArrow(_added, schema).collect():
        counts[r.chunk] = np.frombuffer(r.packed, np.int64)
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts.ravel()))).astype(np.uint8)


def _sketch(width: int, percent: int, levels):
    """(doc_id, row, n, sid, keys, sig): keys and signature only where this task hasn't lately met the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = levels.value, set()
        for batch in pieces(batches, most=4 << 20, operator="ngram_join"):
            sizes, sids, lists, sigs = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingles(text, width)
                sizes.append(len(h))
                sids.append(sid := set_id(h))
                if sid in seen or not len(h):
                    lists.append(np.empty(0, np.int64))
                    sigs.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                lists.append(banded(prefix(h, rank, percent), len(h), percent).view(np.int64))
                sigs.append(signature(h))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "row", "n", "sid", "keys", "sig"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key and sid: (group, i, j, sid) of the sets of each key that has two or more.

    The group's name is a digest of its members, so that keys with the same members, as near copies
    have by the hundred, are one group. Of a group, 8 bytes for each member are held; large ones are
    dealt out as pairs (i, j) of parts.
    """
    last, held, seen = None, [], set()

    def close(members: np.ndarray, out: list) -> None:
        name = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
        if name in seen:
            return
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(name)
        parts = -(-len(members) // GROUP)
        part = np.arange(len(members)) % parts
        for i, j in [(0, 0)] if parts == 1 else [(i, j) for i in range(parts) for j in range(i + 1, parts)]:
            some = members[(part == i) | (part == j)]
            out.append(np.stack([np.full(len(some), name), np.full(len(some), i), np.full(len(some), j), some], 1))

    def batch_of(out: list) -> pa.RecordBatch:
        rows = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(4)], ["g", "i", "j", "sid"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([starts[1:], [len(key)]])
        out: list = []
        if key[0] != last and held:  # the key that the last batch ended with is complete
            if len(members := np.unique(np.concatenate(held))) > 1:
                close(members, out)
            held = []
        last = key[-1]
        some = (ends - starts > 1) | (starts == 0) | (ends == len(key))  # keys with one row in the midst of a batch have one set
        for first, end in zip(starts[some], ends[some], strict=True):
            whole = [*held, sid[first:end]] if first == 0 else [sid[first:end]]
            if end == len(key):
                held = whole
            elif len(members := np.unique(np.concatenate(whole))) > 1:
                close(members, out)
            if first == 0 and end < len(key):
                held = []
        yield batch_of(out)
    out = []
    if held and len(members := np.unique(np.concatenate(held))) > 1:
        close(members, out)
    yield batch_of(out)


def _ties(percent: int):
    """Rows come ordered by group: ties (a forest of them) between the sets of a group that signatures and sizes don't tell apart."""

    def tied(sids: list[int], sizes: list[int], sigs: list[bytes]) -> list[tuple[int, int]]:
        n, width = np.array(sizes), np.array([len(x) for x in sigs])
        label, found, of = np.arange(len(n)), [], {}
        for w in np.unique(width):  # every signature of this width or more, folded to it: parities of halves add up
            rows = np.flatnonzero(width >= w)
            place = np.zeros(len(n), np.int64)
            place[rows] = np.arange(len(rows))
            folded = []
            for k in rows:
                x = np.frombuffer(sigs[k], _U)
                while x.nbytes > w:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                folded.append(x)
            of[int(w)] = place, np.stack(folded)
        for k in range(1, len(n)):
            near = np.flatnonzero(label[:k] != label[k])
            least = -(-percent * (n[near] + n[k]) // (100 + percent))
            fits = np.minimum(n[near], n[k]) >= least
            near, least = near[fits], least[fits]
            common, differ = np.minimum(width[near], width[k]), np.zeros(len(near), np.int64)
            for w in np.unique(common):
                place, bits = of[int(w)]
                differ[common == w] = np.bitwise_count(bits[place[near[common == w]]] ^ bits[place[k]]).sum(1)
            near = near[differ <= n[near] + n[k] - 2 * least]  # elements that may differ
            for j in near:
                if label[j] != label[k]:
                    found.append((sids[j], sids[k]))
                    label[label == label[j]] = label[k]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [])

        def close():
            found = tied(*held) if len(held[0]) > 1 else []
            for h in held:
                h.clear()
            return found

        for batch in batches:
            out = []
            for *name, sid, n, sig in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if name != group:
                    out += close()
                    group = name
                for h, v in zip(held, (sid, n, sig), strict=True):
                    h.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _member_sets(width: int, bitmap):
    """(sid, set) of the documents whose digest is in the bitmap; the few wrong ones go in the join that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = bitmap.value, set()
        for batch in pieces(batches, most=4 << 20, operator="ngram_join"):
            sids, sets = [], []
            for text in batch.column(0).to_pylist():
                h = shingles(text, width)
                sid = set_id(h)
                if sid in seen or not len(h) or not present(words, sid):
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                sids.append(sid)
                sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "set"])

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted arrays."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a forest of them) that connect what the links among these sets connect."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    bits = 64
    while bits < 2 * sizes[-1] and bits < 1 << 14:
        bits *= 2
    marks = np.zeros((n, bits // 64), _U)
    for k, i in enumerate(order):
        h = _mix(sets[i])
        np.bitwise_or.at(marks[k], ((h >> _U(6)) % _U(bits // 64)).astype(np.int64), _U(1) << (h & _U(63)))
    label, links = np.arange(n), []
    for k in range(1, n):
        least = -(-sizes[k] * percent // 100)
        near = np.arange(np.searchsorted(sizes, least), k)
        while True:
            near = near[label[near] != label[k]]
            if not len(near):
                break
            some, rest = near[-256:], near[:-256]  # the nearest in size first
            need = -(-percent * (sizes[some] + sizes[k]) // (100 + percent))
            most = np.minimum(sizes[some] - np.bitwise_count(marks[some] & ~marks[k]).sum(1), sizes[k] - np.bitwise_count(marks[k] & ~marks[some]).sum(1))
            good = np.flatnonzero(most >= need)
            for g in good[np.argsort(-(most[good] - need[good]), kind="stable")]:
                j = some[g]
                if label[j] != label[k] and overlap(sets[order[j]], sets[order[k]]) >= need[g]:
                    links.append((int(order[j]), int(order[k])))
                    label[label == label[j]] = label[k]
            near = rest
    return links


def _verify(percent: int):
    """Rows come ordered by tile and sid: the links of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sids, sets = None, [], []

        def close():
            found = [(sids[i], sids[j]) for i, j in linked(sets, percent)] if len(sets) > 1 else []
            sids.clear(), sets.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in pieces(batches, "set", operator="ngram_join"):
            for *key, sid, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != tile:
                    if tile is not None:
                        yield close()
                    tile = key
                if not sids or sids[-1] != sid:
                    sids.append(sid)
                    sets.append(np.frombuffer(raw, _U))
        yield close()

    return run


def _linked(tiled: DataFrame, n: int, percent: int) -> DataFrame:
    """Links within each tile. tiled: cluster, i, j (the tile), sid, set."""
    return tiled.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "sid").mapInArrow(_verify(percent), "a long, b long")


def _across(members: DataFrame, sets: DataFrame, links: DataFrame, n: int, percent: int) -> DataFrame:
    """links, and those between the tiles of large clusters.

    Members that are already connected needn't be compared, which spares a large group of near
    copies all but one or two comparisons for each: a few members of each part are compared
    first, to join the parts that tiles have made; then, in each cluster, what isn't in the largest part
    is compared with everything, the largest part being read once for each TILE of the others.
    """

    def parts(links: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("node").alias("sid"), "root")
        return cut(members.join(roots, "sid", "left").withColumn("part", F.coalesce("root", "sid")).select("cluster", "sid", "part"))

    def several(parted: DataFrame) -> DataFrame:
        return parted.groupBy("cluster").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("cluster")

    parted = parts(links)
    a, b = F.struct(F.xxhash64("sid"), "sid"), F.struct(F.xxhash64("sid", F.lit(1)), "sid")
    some = parted.join(several(parted), "cluster").groupBy("cluster", "part").agg(F.array_distinct(F.array(F.min(a)["sid"], F.max(a)["sid"], F.min(b)["sid"], F.max(b)["sid"])).alias("sids"))
    some = some.select("cluster", F.explode("sids").alias("sid"))
    tiles = some.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    some = cut(some.join(tiles, "cluster").select("cluster", F.expr("cast(pmod(xxhash64(sid), tiles) as int)").alias("i"), F.lit(0).alias("j"), "sid"))
    links = cut(links.unionByName(_linked(some.join(sets, "sid").select("cluster", "i", "j", "sid", "set"), n, percent)))

    parted = parts(links)
    parted = cut(parted.join(several(parted), "cluster"))
    if parted.isEmpty():
        return links
    counts = parted.groupBy("cluster", "part").agg(F.count("*").alias("rows"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("rows", "part")).alias("m"), F.sum("rows").alias("all"))
    main = cut(main.select("cluster", F.col("m.part").alias("main"), F.ceil(F.col("m.rows") / TILE).cast("int").alias("in"), F.ceil((F.col("all") - F.col("m.rows")) / TILE).cast("int").alias("out")))
    tile = "cast(pmod(xxhash64(sid), if(part = main, in, out)) as int)"
    pairs = f"""if(part = main, transform(sequence(0, out - 1), x -> struct({tile} as i, -1 - x as j)),
        concat(transform(sequence(0, in - 1), x -> struct(x as i, -1 - {tile} as j)), transform(sequence(0, out - 1), x -> struct(-1 - least(x, {tile}) as i, -1 - greatest(x, {tile}) as j))))"""
    spread = cut(parted.join(main, "cluster").select("cluster", "sid", F.explode(F.expr(pairs)).alias("pair")))
    return links.unionByName(_linked(spread.join(sets, "sid").select("cluster", "pair.i", "pair.j", "sid", "set"), n, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, root (null for empty sets; the same within a component) and row (a hash of id and text) of each row; documents link when 100 * |A and B| >= percent * |A or B|."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(rarity(texts.select("text"), width))
    sketch = cut(texts.mapInArrow(_sketch(width, percent, levels), "doc_id long, row long, n long, sid long, keys array<long>, sig binary"))
    light = sketch.select("doc_id", "row", "n", "sid")

    rows = sketch.select(F.explode("keys").alias("key"), "sid")
    groups = rows.repartition(n, "key").sortWithinPartitions("key", "sid").mapInArrow(_groups, "g long, i long, j long, sid long").distinct()
    known = sketch.where("sig IS NOT NULL").select(F.col("sid").alias("own"), "n", "sig").dropDuplicates(["own"])
    signed = groups.join(known, F.col("sid") == F.col("own")).select("g", "i", "j", "sid", "n", "sig")
    ties = signed.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_ties(percent), "a long, b long")
    members = components(ties).select(F.col("node").alias("sid"), F.col("root").alias("cluster"))
    totals = members.groupBy("cluster").agg(F.count("*").alias("all"))
    members = cut(members.join(totals, "cluster"))
    bitmap = spark.sparkContext.broadcast(membership(members, "sid"))
    sets = texts.select("text").mapInArrow(_member_sets(width, bitmap), "sid long, set binary")
    few = members.count() <= BROADCAST_ROWS
    stored = cut(sets.join(F.broadcast(members) if few else members, "sid").select("cluster", "all", "sid", "set"))
    links = cut(_linked(stored.select("cluster", F.expr(f"cast(pmod(xxhash64(sid), ceil(all / {TILE})) as int)").alias("i"), F.lit(0).alias("j"), "sid", "set"), n, percent))
    if not (large := members.where(F.col("all") > TILE)).isEmpty():
        links = _across(large.select("cluster", "sid"), stored.where(F.col("all") > TILE).select("sid", "set"), links, n, percent)
    roots = components(links)

    own = light.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    named = own.join(roots, own.sid == roots.node, "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = cut(named.join(least, "root").select(F.col("sid").alias("own_sid"), "component", "root"))
    return light.join(named, (light.sid == named.own_sid) & (light.n > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"), "row")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each component: the one with the smallest id (null after all) stays.

    Texts move only if more rows go than can be broadcast, or if rows are repeated as a whole. All columns stay,
    whatever their names; texts without words all stay; an empty table stays empty. Rows are told apart by 64-bit hashes of id
    and text.
    """
    found = cut(near_duplicates(docs, width, percent, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = cut(found.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("first")).select("root", F.col("first.row").alias("stays")))
    goes = cut(found.join(first, "root").where("row <> stays").select("row").distinct())
    again = cut(found.where("root IS NOT NULL").groupBy("row").count().where("count > 1").select("row"))
    of = [f"c{docs.columns.index(c)}" for c in (id_col, text_col)]
    rows = numbered(docs).withColumn("row", F.xxhash64(*of))

    def listed(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    rows = rows.join(listed(goes), "row", "left_anti")
    if not again.isEmpty():
        twice = listed(again)
        rows = rows.join(twice, "row", "left_anti").unionByName(rows.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return rows.drop("row").toDF(*docs.columns)
