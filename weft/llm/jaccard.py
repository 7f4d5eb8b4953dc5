"""N-gram Jaccard join: a size-aware heavy-light join on sets of word shingles.

Documents with equal sets are one class, named by a 128-bit fingerprint of the set; links are sought
between classes, so copies never meet in pairs.

1. Every block of documents sorts its shingles (48-bit hashes) into hash ranges; inside a block a class is a small
   number, so a posting takes some six bytes however many ranges there are.  A range counts the
   holders of each shingle over all blocks and sends a block the shingles that others hold too.  The block that is a class's home
   keeps those held by more than the class's own copies.  A class with so many shingles of its own that no other class
   can reach the threshold is done.  The others keep their shared shingles, rarest first; these are all
   that an intersection needs.
2. *Light* classes, smaller than a boundary, list every pair of shingles of their prefix: linked
   light classes share a pair.  *Heavy* ones, and those near the boundary, go into the inverted
   lists of their prefix's shingles.  The boundary is where the two costs, summed by size, are least
   together: pairs listed, and list entries with their share of ordering a list of that length.
3. In a list, members are tied to the least member of their size band and bands to the next, so a list
   of k members gives about k ties.  Connected ties are a *neighbourhood*: linked classes
   are always in the same one.
4. Each class is verified against two hubs, the least and the greatest of its ties, which joins most near
   copies.  What is still apart in a neighbourhood is verified in blocks of bounded size, by counting
   in an inverted index; blocks of one joined group are not compared, and a block pair returns a
   spanning set of links only.

Components of all links give the result.  Hashes stand for shingles: a pair of documents would need
two different shingles with equal 48-bit hashes to be misjudged.

A null or empty text has an empty set and is linked with nothing; rows with equal ids are separate
documents; a null id takes part and gets the least id of its component (null if there is none).
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import gathered, let_go, ragged, slices, stored, texts
from weft.llm.components import components

WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bytes of text whose shingles a task makes at a time.
SLICE_BYTES = 2 << 20
#: Bytes of text that a task turns into one block of sorted shingles.
BLOCK_BYTES = 6 << 20
#: Shingles per hash range, on average.
RANGE_SHINGLES = 2 << 20
#: Hash ranges at least.
RANGES = 32
#: Members of a block that is verified.
MEMBERS = 256

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def shingles(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of every text."""
    text = texts(column)
    for blank in "\t\n\v\f\r":
        text = pc.replace_substring(text, blank, " ")
    split = pc.split_pattern(text, " ")
    coded = split.flatten().dictionary_encode()
    bounds = np.asarray(split.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]  # a slice of a batch doesn't begin at 0
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    # bytes.lower() turns A-Z only; Arrow's own goes wrong on slices that don't begin at 0
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), dtype=np.uint64, count=len(words))
    real = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) > 0
    kept = real[index]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[kept]
    value = hashes[index[kept]]
    starts = np.searchsorted(doc, np.arange(len(bounds) - 1))
    ends = np.searchsorted(doc, np.arange(len(bounds) - 1), side="right")
    n = ends - starts
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = ragged(starts, count)
    end = np.repeat(ends, count)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        inside = at + j < end
        # a text of fewer words is filled up with a constant that no word has
        h = (h ^ np.where(inside, value[np.minimum(at + j, len(value) - 1)], _A) if len(value) else h) * _B
        h ^= h >> np.uint64(29)
    h = (h * _A) >> np.uint64(16)
    cut = np.concatenate(([0], np.cumsum(count)))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def fingerprint(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def prefix(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles among which a set of n must share one with any set linked to it."""
    return n - -(-percent * n // 100) + 1


def _source(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keys)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, pa.RecordBatch, list[np.ndarray]]]:
    """(block, its documents, their sets): the same blocks in every scan of the same partitions."""
    task = TaskContext.get().partitionId()
    for k, part in enumerate(gathered(batches, "text", BLOCK_BYTES)):
        yield task << 32 | k, part, [s for piece in slices(iter([part]), limit=SLICE_BYTES) for s in shingles(piece.column("text"), width)]


def _classes(sets: list[np.ndarray]) -> tuple[list[bytes | None], dict[bytes, int]]:
    """The sets' names (None for an empty one), and the classes of a block by their first place in it."""
    names = [fingerprint(s) if len(s) else None for s in sets]
    order: dict[bytes, int] = {}
    for name in names:
        if name is not None:
            order.setdefault(name, len(order))
    return names, order


def seal(order: dict[bytes, int]) -> int:
    """One number for the classes of a block in their order."""
    return xxhash.xxh3_64_intdigest(b"".join(order)) >> 1


def set_table(docs: DataFrame, width: int = WIDTH, keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, class, block, place, seal``: set size and fingerprint (null for an empty set), the block, the class's
    number in it, what tells whether another scan made the same block; then the ``keys`` (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, sets in _blocks(batches, width):
            names, order = _classes(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(np.full(len(sets), block), pa.int64()),
                    pa.array([None if name is None else order[name] for name in names], pa.int64()),
                    pa.array(np.full(len(sets), seal(order)), pa.int64()),
                    *[part.column(k) for k in keys],
                ],
                ["doc_id", "n", "class", "block", "place", "seal", *keys],
            )

    names = ["doc_id bigint", "n bigint", "class binary", "block bigint", "place bigint", "seal bigint", *[f"{k} bigint" for k in keys]]
    return _source(docs, *keys).mapInArrow(run, ", ".join(names))


POSTINGS = "block bigint, seal bigint, first bigint, gaps binary, places binary"


def _packed(h: np.ndarray, place: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending hashes as their first and gaps, class numbers as small as they are."""
    gaps = np.diff(h, prepend=h[0])
    return (
        int(h[0]),
        gaps.astype("<u4" if gaps.max() < 1 << 32 else "<u8").tobytes(),
        place.astype("<u2" if place.max() < 1 << 16 else "<u4").tobytes(),
    )


def _unpacked(first: int, gaps: bytes, places: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(gaps, "<u4" if len(gaps) == 4 * n else "<u8").astype(np.uint64)
    return np.cumsum(steps) + np.uint64(first), np.frombuffer(places, "<u2" if len(places) == 2 * n else "<u4").astype(np.int64)


def dealt_postings(docs: DataFrame, ranges: int, width: int = WIDTH) -> DataFrame:
    """A row for each block and hash range: ``range, n`` and ``POSTINGS``; a class of the block has its number there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, sets in _blocks(batches, width):
            names, order = _classes(sets)
            first = {name: s for name, s in zip(reversed(names), reversed(sets)) if name is not None}
            if not order:
                continue
            h = np.concatenate([first[name] for name in order])
            place = np.repeat(np.arange(len(order), dtype=np.uint32), [len(first[name]) for name in order])
            del first, sets
            by = np.argsort(h, kind="stable")
            h, place = h[by], place[by]
            del by
            edge = np.searchsorted(h, np.array([(k << 48) // ranges for k in range(ranges + 1)], dtype=np.uint64))
            some = np.flatnonzero(np.diff(edge)).tolist()
            cols = list(zip(*((k, int(edge[k + 1] - edge[k]), block, seal(order), *_packed(h[edge[k] : edge[k + 1]], place[edge[k] : edge[k + 1]])) for k in some)))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["range", "n", "block", "seal", "first", "gaps", "places"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return _source(docs).mapInArrow(deal, f"range int, n bigint, {POSTINGS}")


def shared_postings(dealt: DataFrame) -> DataFrame:
    """The postings of each block and range whose shingle has several holders: ``n``, ``POSTINGS`` and ``times`` (how many)."""

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpacked(r["first"], r["gaps"], r["places"], r["n"]) for r in rows]
        h = np.concatenate([p[0] for p in parts])
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        size = np.diff(np.append(start, len(h)))
        times = np.empty(len(h), dtype=np.uint32)
        times[order] = np.repeat(size, size)
        out, at = [], 0
        for r, (own, place) in zip(rows, parts):
            mine = times[at : at + len(own)]
            at += len(own)
            kept = mine > 1
            if kept.any():
                out.append((r["block"], r["seal"], int(kept.sum()), *_packed(own[kept], place[kept]), mine[kept].astype("<u4").tobytes()))
        del parts, h, order, ranked, start, size, times
        let_go()
        names = ["block", "seal", "n", "first", "gaps", "places", "times"]
        cols = list(zip(*out)) if out else [[]] * len(names)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(names, cols, types)})

    schema = "block bigint, seal bigint, n bigint, first bigint, gaps binary, places binary, times binary"
    return dealt.groupBy("range").applyInArrow(count, schema)


def class_table(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (``class, n, least, copies``) of a set table, stored, and where each is at home: ``class, n, block, place, seal, blocks``."""
    inside = every.filter("n > 0").groupBy("class", "block", "place", "seal").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    at = F.min(F.struct("block", "place", "seal")).alias("at")
    whole = inside.groupBy("class").agg(F.first("n").alias("n"), F.min("least").alias("least"), F.sum("copies").alias("copies"), at, F.count(F.lit(1)).alias("blocks"))
    whole = stored(whole, "classes")
    return whole.select("class", "n", "least", "copies"), whole.select("class", "n", "at.block", "at.place", "at.seal", "blocks")


def contenders(shared: DataFrame, homes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Classes that may have a link: ``class, n, q, hashes, light_cost, heavy_cost``, hashes (array)
    the shingles shared with other classes, rarest first, of which the first ``q`` are in the prefix."""
    schema = "class binary, n bigint, q int, hashes array<bigint>, light_cost double, heavy_cost double"
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64()]

    def run(here: pa.Table, postings: pa.Table) -> pa.Table:
        out = []
        if here.num_rows and postings.num_rows:
            if set(here["seal"].to_pylist()) != set(postings["seal"].to_pylist()):
                raise RuntimeError("the documents came in other partitions in the second scan: write them first")
            parts = [(*_unpacked(r["first"], r["gaps"], r["places"], r["n"]), np.frombuffer(r["times"], "<u4")) for r in postings.to_pylist()]
            h, place, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
            at = np.full(max(int(place.max()), max(here["place"].to_pylist())) + 1, -1, dtype=np.int64)
            at[here["place"].to_numpy()] = np.arange(here.num_rows)
            owner = at[place]
            own_copies = np.append(here["blocks"].to_numpy(), 0)[owner]
            kept = (owner >= 0) & (times > own_copies)  # a class's copies in other blocks are no other classes
            h, owner, times = h[kept], owner[kept], times[kept]
            order = np.lexsort((h, times, owner))
            h, owner, times = h[order], owner[order], times[order]
            bounds = np.searchsorted(owner, np.arange(here.num_rows + 1)).tolist()
            for name, n, a, b in zip(here["class"].to_pylist(), here["n"].to_pylist(), bounds[:-1], bounds[1:]):
                q = int(prefix(n, percent)) - (n - (b - a))
                if q < 1 or n < 3:  # different sets of fewer than three shingles are never linked
                    continue
                wide = min(q + 1, b - a)
                heavy = float(q + np.log2(times[a : a + q]).sum())
                out.append((name, n, q, h[a:b].astype(np.int64), float(wide * (wide - 1) // 2), heavy))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(names, cols, types)})

    left = homes.select(F.col("block").alias("home"), "class", "n", "place", "seal", "blocks")
    return left.groupBy("home").cogroup(shared.groupBy("block")).applyInArrow(run, schema)


def boundary(table: DataFrame, percent: int = PERCENT) -> int:
    """The size from which classes are heavy, by cost over size bands (some hundred rows at most)."""
    band = F.floor(F.log2(F.col("n").cast("double")) * 4)
    rows = table.groupBy(band.alias("band")).agg(F.sum("light_cost").alias("light"), F.sum("heavy_cost").alias("heavy")).orderBy("band").collect()
    best, least = 0, None
    for edge in [r["band"] for r in rows] + [rows[-1]["band"] + 1] if rows else []:
        size = int(np.ceil(2 ** (edge / 4)))
        near = np.log2(max(size * percent / 100, 1)) * 4
        cost = sum(r["light"] for r in rows if r["band"] < edge) + sum(r["heavy"] for r in rows if r["band"] >= int(near))
        if least is None or cost < least:
            best, least = size, cost
    return best


def _band(percent: int):
    """Two sets that may be linked are in the same size band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)).cast("int")


def ties(table: DataFrame, heavy_from: int, percent: int = PERCENT) -> DataFrame:
    """Candidate ties ``a, b`` between classes from subset keys and inverted lists."""
    head = F.expr("slice(hashes, 1, q)")
    wide = F.expr("slice(hashes, 1, q + 1)")
    pairs = F.flatten(F.transform(wide, lambda x, i: F.transform(F.slice(wide, i + 2, F.size(wide)), lambda y: F.xxhash64(x, y))))
    base = table.withColumn("band", _band(percent))
    light = base.filter(F.col("n") < heavy_from).select("class", "band", F.lit(0).alias("kind"), F.explode(pairs).alias("key"))
    lists = base.filter(F.col("n") * 100 >= F.lit(percent * heavy_from)).select("class", "band", F.lit(1).alias("kind"), F.explode(head).alias("key"))
    members = light.unionByName(lists)
    least = members.groupBy("kind", "key", "band").agg(F.min("class").alias("least"), F.max("class").alias("greatest"))
    several = least.filter("least <> greatest").select("kind", "key", "band", "least", "greatest")
    inside = members.join(several, ["kind", "key", "band"])
    one = inside.filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    two = inside.filter("class <> greatest").select(F.col("class").alias("a"), F.col("greatest").alias("b"))
    upper = least.select("kind", "key", (F.col("band") - 1).alias("band"), F.col("least").alias("next"))
    across = least.join(upper, ["kind", "key", "band"]).select(F.col("least").alias("a"), F.col("next").alias("b"))
    return one.unionByName(two).unionByName(across).distinct()


def _linked(k: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * k >= percent * (a + b - k)


def hub_links(table: DataFrame, tied: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links ``a, b`` of each class with the least and the greatest of its ties."""
    both = tied.unionByName(tied.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    chosen = ends.select(F.col("a"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("b"))
    chosen = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = table.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    right = table.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    k = F.size(F.array_intersect("h_a", "h_b"))
    met = chosen.join(left, "a").join(right, "b")
    return met.filter(k * 100 >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - k)).select("a", "b")


def block_links(table: DataFrame, grouped: DataFrame, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """Links ``a, b`` between classes of one neighbourhood (``class, hood, joined``) that are
    not joined yet, verified block against block."""
    rows = table.select("class", "n", "hashes", _band(percent).alias("band")).join(grouped, "class")
    sizes = grouped.groupBy("hood").agg(F.min("joined").alias("first"), F.max("joined").alias("last"))
    rows = rows.join(sizes.filter("first <> last").select("hood"), "hood")  # else all joined already
    large = rows.groupBy("hood", "band", "joined").agg(F.count(F.lit(1)).alias("n_joined")).filter(F.col("n_joined") >= members)
    rows = rows.join(large.select("hood", "band", "joined", "n_joined"), ["hood", "band", "joined"], "left")
    rows = rows.withColumn("part", F.when(F.col("n_joined").isNotNull(), F.col("joined")))
    counts = rows.groupBy("hood", "band", "part").agg(F.count(F.lit(1)).alias("n_part"))
    counts = counts.withColumn("blocks", F.ceil(F.col("n_part") / members).cast("int"))
    joint = [F.col("r.hood") == F.col("c.hood"), F.col("r.band") == F.col("c.band"), F.col("r.part").eqNullSafe(F.col("c.part"))]
    blocked = rows.alias("r").join(counts.alias("c"), joint).select(
        "r.hood", "r.band", "r.part", "r.class", "r.n", "r.hashes", "r.joined",
        F.pmod(F.xxhash64("r.class"), F.col("c.blocks")).cast("int").alias("block"),
    )
    # one row per block; pairs of blocks in the same or the next band, but not within a joined part
    each = counts.select("hood", "band", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    name = F.concat_ws("|", F.coalesce(F.hex("part"), F.lit("")), F.col("block").cast("string"))
    each = each.withColumn("name", name)
    left = each.select("hood", "band", F.col("part").alias("p1"), F.col("block").alias("k1"), F.col("name").alias("m1"))
    right = each.select("hood", "band", F.col("part").alias("p2"), F.col("block").alias("k2"), F.col("name").alias("m2"))
    same = left.join(right, ["hood", "band"]).filter("m1 <= m2 and (p1 is null or not (p1 <=> p2))").withColumn("up", F.lit(0))
    above = right.withColumn("band", F.col("band") - 1)
    other = left.join(above, ["hood", "band"]).filter("p1 is null or not (p1 <=> p2)").withColumn("up", F.lit(1))
    units = same.unionByName(other).withColumn("unit", F.xxhash64("hood", "band", "up", "m1", "m2"))
    first = units.select("hood", "band", F.col("p1").alias("part"), F.col("k1").alias("block"), "unit", F.lit(1).alias("side"))
    second = units.select("hood", (F.col("band") + F.col("up")).alias("band"), F.col("p2").alias("part"), F.col("k2").alias("block"), "unit", F.lit(2).alias("side"))
    sides = first.unionByName(second)
    joint = [F.col("x.hood") == F.col("s.hood"), F.col("x.band") == F.col("s.band"), F.col("x.part").eqNullSafe(F.col("s.part")), F.col("x.block") == F.col("s.block")]
    sent = blocked.alias("x").join(sides.alias("s"), joint).select("s.unit", "s.side", "x.class", "x.n", "x.joined", "x.hashes")
    # several small units share a task's group
    packs = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    sent = sent.withColumn("pack", F.pmod("unit", F.lit(packs)))

    def verify(pack: pa.Table) -> pa.Table:
        pack = pack.sort_by([("unit", "ascending"), ("side", "ascending")])
        unit = pack["unit"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))).tolist() + [len(unit)]
        found_a, found_b = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            for x, y in _unit_links(pack.slice(a, b - a), percent):
                found_a.append(x)
                found_b.append(y)
        return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})

    return sent.groupBy("pack").applyInArrow(verify, "a binary, b binary")


def _unit_links(rows: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the two sides of a unit that join what was apart."""
    side = rows["side"].to_numpy()
    names, joined = rows["class"].to_pylist(), rows["joined"].to_pylist()
    n = rows["n"].to_numpy()
    lists = rows["hashes"].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    bounds = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    size = np.diff(bounds)[right]
    h = flat[ragged(bounds[right], size)]
    owner = np.repeat(np.arange(len(right)), size)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    group: dict[bytes, bytes] = {j: j for j in joined}

    def root(x: bytes) -> bytes:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for i in left.tolist():
        mine = flat[bounds[i] : bounds[i + 1]]
        lo, hi = np.searchsorted(h, mine), np.searchsorted(h, mine, side="right")
        k = np.bincount(owner[ragged(lo, hi - lo)], minlength=len(right))
        for j in right[_linked(k, int(n[i]), n[right], percent) & (k > 0)].tolist():
            x, y = root(joined[i]), root(joined[j])
            if x != y:
                group[max(x, y)] = min(x, y)
                out.append((names[i], names[j]))
    return out


def links(table: DataFrame, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """Links ``a, b`` that span every component of the contending classes."""
    tied = stored(ties(table, boundary(table, percent), percent), "ties")
    hubs = stored(hub_links(table, tied, percent), "links")
    hood = components(tied).select(F.col("node").alias("class"), F.col("component").alias("hood"))
    joined = components(hubs).select(F.col("node").alias("class"), F.col("component").alias("joined"))
    grouped = hood.join(joined, "class", "left").select("class", "hood", F.coalesce("joined", "class").alias("joined"))
    rest = block_links(table, stored(grouped, "hoods"), percent, members)
    return hubs.unionByName(rest)


def class_components(docs: DataFrame, homes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``class, component`` of the documents' classes that are linked with another."""
    total = homes.agg(F.sum("n")).first()[0] or 0
    ranges = max(RANGES, -(-int(total) // RANGE_SHINGLES))
    shared = shared_postings(dealt_postings(docs, ranges, width))
    table = stored(contenders(shared, homes, percent), "contenders")
    return components(links(table, percent)).select(F.col("node").alias("class"), "component")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    The documents are scanned twice, so they must come in the same partitions both times, as from files.
    """
    every = stored(set_table(docs, width), "sets")
    classes, homes = class_table(every)
    part_of = class_components(docs, homes, width, percent)
    named = classes.join(part_of, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("class", "component_id")
    return every.join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document (all columns) of every component: the one of least id, a row without id only if
    no row of the component has one.  Of several rows with that id the one of the least fingerprint, then the first,
    stays.  A document with an empty set is linked with nothing, so each such row stays.
    """
    # a row's number is read from what was written; the caller's columns travel as one
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    numbered = stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "numbered")
    source = numbered.select("whole.doc_id", "whole.text", "row")
    every = stored(set_table(source, width, ("row",)), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = every.filter("n > 0").groupBy("class").agg(first)
    part_of = class_components(source, class_table(every)[1], width, percent)
    named = classes.join(part_of, "class", "left").withColumn("component", F.coalesce("component", "class"))
    chosen = named.groupBy("component").agg(F.min(F.struct("first.none", "first.doc_id", "class", "first.row")).alias("least"))
    kept = chosen.select("least.row").unionByName(every.filter("n = 0").select("row"))
    return numbered.join(kept, "row", "left_semi").select("whole.*")
