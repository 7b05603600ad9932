"""N-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles.  Similar documents are put into groups,
each group keeps the union of its tokens, and a query opens a group only when
its overlap with the union can reach the threshold; then it is compared with
the members exactly.

* Equal sets are one class, which enters once, by the first of its documents.
* Groups: classes with the same smallest shingle (under a hash) are compared
  with the first of them.  Those similar to it form a group of mutually
  reachable documents, cut into blocks of ``block_size``; the others are groups
  of their own.  A large group of near copies thus costs one comparison a copy.
* Matrix: a pair above the threshold shares a token among the first few of each
  side under one order of all tokens, so only these are entered, by token:
  which query meets which block of another group.  The order puts shingles of
  one class only first and the most frequent ones last, so that a passage found
  in several documents joins none of them.
* First the groups at a token ask only the largest of them, and what links is
  one group from then on; a second round lets every two remaining groups meet.
  So documents that are all near copies of each other need no pairs.
* A block and its queries meet in one task, in parts of ``query_block``.  The
  query's overlap with the block's union bounds every overlap inside.

No link between groups is lost: prefixes, sizes and unions are upper bounds,
and the frequency order only changes how many groups are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import tokens
from arealis.llm.components import connected_components
from arealis.llm.spread import (
    drop,
    id_filter,
    keep,
    pack,
    pack_counts,
    pack_sorted,
    passes,
    place_column,
    text_of,
    total_bytes,
    unpack,
    unpack_sorted,
)

RANGE_BYTES = 8 << 20
#: Shingles found in several documents come late in the order, those in at least FREQUENT_FROM, up to FREQUENT of
#: them, last.  The former are known by a bit for the first REPEATED_BITS bits of their hash, an array of fixed size;
#: only speed depends on either.
FREQUENT_FROM = 32
FREQUENT = 200_000
REPEATED_BITS = 26
BLOCK = 256
QUERY_BLOCK = 4096
#: pairs of entries at one token that are judged at once
PAIRS_AT_ONCE = 500_000


class _Similar:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def least_overlap(self, n):
        """The smallest overlap of a set of n tokens with any similar set."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least_overlap(n) + 1


def document_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    data = tokens.LOWER[data]
    starts, ends, bounds = tokens.find_words(data, offsets, tokens.SPACED)
    words = tokens.hash_words(data, starts, ends)
    grams = tokens.hash_grams(words, size, salt=size)
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= size:
            yield tokens.distinct(grams[a : b - size + 1])
        else:
            yield tokens.hash_grams(words[a:b], n, salt=n) if n else words[:0]


def _sets_of(batch: pa.RecordBatch, size: int, column: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = tokens.flatten(batch.column(column))
    for a, b in tokens.slices(offsets):
        at = offsets[a : b + 1]
        yield from enumerate(document_sets(data[at[0] : at[-1]], at - at[0], size), a)


def _describe(size: int):
    """n, a 128-bit sum that tells sets apart, and the smallest shingle under another hash."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            out = np.zeros((4, n), np.uint64)
            for i, shingles in _sets_of(batch, size):
                if len(shingles):
                    other = tokens.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    out[:, i] = len(shingles), shingles.sum(), other.sum(), other.min()
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["id", "txt"]).columns, *[pa.array(x.view(np.int64)) for x in out]],
                names=["id", "txt", "n", "s1", "s2", "low"],
            )

    return run


def _count(size: int, ranges: int, copies):
    """How many documents of a slice hold each shingle, by the upper 48 bits of its hash; without known copies."""
    starts = np.array([(r << 48) // ranges for r in range(ranges)], np.uint64)
    schema = pa.schema([("range", pa.int32()), ("shingles", pa.binary()), ("n", pa.binary())])

    def summed(waiting):
        known, n = np.unique(np.concatenate(waiting), return_counts=True)
        cuts = [*np.searchsorted(known, starts), len(known)]
        rows = [
            {"range": r, "shingles": pack_sorted(known[a:b]), "n": pack_counts(n[a:b])}
            for r, (a, b) in enumerate(zip(cuts, cuts[1:]))
            if b > a
        ]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        held, waiting = 0, []
        for batch in batches:
            batch = batch.filter(pa.array(~passes(copies.value, batch.column("place").to_numpy(zero_copy_only=False))))
            for _, shingles in _sets_of(batch, size):
                waiting.append(shingles >> np.uint64(16))
                held += len(shingles)
                if held > 1_500_000:
                    yield summed(waiting)
                    held, waiting = 0, []
        if held:
            yield summed(waiting)

    return run


_COUNTED = "shingle bigint, n bigint, words binary, bits binary"


def _frequent(least: int):
    """The frequent shingles of a range, and the bits of all that occur in two documents or more."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known, place = np.unique(np.concatenate([unpack_sorted(r["shingles"]) for r in rows]), return_inverse=True)
        n = np.bincount(place, np.concatenate([unpack(r["n"]) for r in rows]), len(known)).astype(np.int64)
        spot = known[n > 1] >> np.uint64(48 - REPEATED_BITS)
        words, first = np.unique(spot >> np.uint64(6), return_index=True)
        bit = np.uint64(1) << (spot & np.uint64(63))
        bits = np.bitwise_or.reduceat(bit, first) if len(spot) else bit
        often = n >= least
        shingle, count = known[often].view(np.int64).tolist(), n[often].tolist()
        return pa.table({
            "shingle": pa.array([None, *shingle], pa.int64()), "n": pa.array([None, *count], pa.int64()),
            "words": pa.array([words.tobytes(), *[None] * len(shingle)], pa.binary()),
            "bits": pa.array([bits.tobytes(), *[None] * len(shingle)], pa.binary()),
        })

    return run


def _token_order(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(bits of repeated shingles, the frequent ones ascending); both of bounded size."""
    top = counted.where("shingle is not null").orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle")
    repeated = np.zeros(1 << (REPEATED_BITS - 6), np.uint64)
    for row in counted.where("words is not null").select("words", "bits").toLocalIterator():
        repeated[np.frombuffer(row["words"], np.uint64)] |= np.frombuffer(row["bits"], np.uint64)
    return repeated, np.sort(top.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def _prefixes(size: int, similar: _Similar, order):
    """The first tokens of each set under the common order, and the parity of all its tokens by 128 places."""

    def run(batches):
        repeated, frequent = order.value
        for batch in batches:
            out: list[bytes | None] = [None] * len(batch)
            parity = np.zeros((2, len(batch)), np.uint64)
            for i, shingles in _sets_of(batch, size):
                if len(shingles):
                    short = shingles >> np.uint64(16)
                    spot = short >> np.uint64(48 - REPEATED_BITS)
                    rank = ((repeated[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(np.int8)
                    if len(frequent):
                        at = np.searchsorted(frequent, short)
                        at[at == len(frequent)] = 0
                        rank[frequent[at] == short] = 2
                    first = np.argsort(rank, kind="stable")[: similar.prefix(len(shingles))]
                    out[i] = shingles[first].tobytes()
                    for k in (0, 1):
                        half = shingles[(shingles >> np.uint64(6)) & np.uint64(1) == k]
                        parity[k, i] = np.bitwise_xor.reduce(np.uint64(1) << (half & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["id", "txt"]).columns, pa.array(out, pa.binary()), *[pa.array(x.view(np.int64)) for x in parity]],
                names=["rid", "rtxt", "prefix", "parity0", "parity1"],
            )

    return run


_FIELDS = ("tokens", "at", "id", "n", "grp", "size", "block", "parity0", "parity1")


def _entries(ranges: int):
    """Matrix entries by ranges of tokens: parallel arrays of token, its place in the set, and what is known of the set."""
    starts = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)
    schema = pa.schema([("range", pa.int32()), *[(f, pa.binary()) for f in _FIELDS]])

    def run(batches):
        for batch in batches:
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            if not prefixes:
                continue
            token = np.concatenate(prefixes)
            row = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
            place = np.concatenate([np.arange(len(x)) for x in prefixes])
            order = np.argsort(token, kind="stable")
            token, row, place = token[order], row[order], place[order].astype(np.uint64)
            cuts = [*np.searchsorted(token, starts), len(token)]
            values = [batch.column(f).to_numpy().astype(np.int64).view(np.uint64) for f in _FIELDS[2:]]
            yield pa.RecordBatch.from_pylist(
                [
                    {"range": r, "tokens": pack_sorted(token[a:b]), "at": pack(place[a:b])}
                    | {f: pack(v[row[a:b]]) for f, v in zip(_FIELDS[2:], values)}
                    for r, (a, b) in enumerate(zip(cuts, cuts[1:]))
                    if b > a
                ],
                schema,
            )

    return run


def _meetings(similar: _Similar, hubs_only: bool):
    """Which document has to look into which block of another group: (id, grp, block), each once per range.

    ``hubs_only``: of the groups at a token, all ask the largest one only.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        token = np.concatenate([unpack_sorted(r["tokens"]) for r in rows])
        at, ids, n, grp, size, block, *parity = (np.concatenate([unpack(r[f]).view(np.int64) for r in rows]) for f in _FIELDS[1:])
        order = np.lexsort((n, token))
        token, at, ids, n, grp, size, block, *parity = (x[order] for x in (token, at, ids, n, grp, size, block, *parity))

        def possible(i, j):
            """Whether the sets can be linked, were this their first common token; by places and by parities."""
            after = np.minimum(n[i] - at[i], n[j] - at[j])
            differ = sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in parity)
            return similar.linked(np.minimum(after, (n[i] + n[j] - differ) // 2), n[i], n[j])

        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        found: list[np.ndarray] = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2 or (grp[a:b] == grp[a]).all():
                continue
            if hubs_only:
                hub = a + np.lexsort((grp[a:b], -size[a:b]))[0]
                asks = a + np.flatnonzero((grp[a:b] != grp[hub]) & possible(np.arange(a, b), hub))
                if len(asks):
                    place = np.full(len(asks), hub)
                    found.append(np.unique(np.stack([ids[asks], grp[place], block[place]], axis=1), axis=0))
                continue
            # entries by rising n: i meets those after it that are not too large; so many pairs at a time as memory allows
            last = a + np.searchsorted(n[a:b] * similar.percent, n[a:b] * 100, side="right")
            reach = last - np.arange(a, b) - 1
            turns = np.unique((np.cumsum(reach) - 1) // PAIRS_AT_ONCE, return_index=True)[1]
            for start, stop in zip(turns, [*turns[1:], b - a]):
                here = reach[start:stop]
                i = np.repeat(np.arange(a + start, a + stop), here)
                j = np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here) + i + 1
                other = (grp[i] != grp[j]) & possible(i, j)
                i, j = i[other], j[other]
                # the smaller group asks; of equal ones, that with the smaller id
                swap = (size[i] > size[j]) | ((size[i] == size[j]) & (grp[i] > grp[j]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                if len(i):
                    found.append(np.unique(np.stack([ids[i], grp[j], block[j]], axis=1), axis=0))
        if not found:
            out = np.empty((0, 3), np.int64)
        else:
            out = np.unique(np.concatenate(found), axis=0)
        return pa.table({"id": out[:, 0], "grp": out[:, 1], "block": out[:, 2]})

    return run


def _emit_sets(size: int, bits: np.ndarray):
    schema = pa.schema([("rid", pa.int64()), ("rtxt", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column("place").to_numpy(zero_copy_only=False))))
            if len(batch):
                out = [pack_sorted(x) for _, x in _sets_of(batch, size)]
                yield pa.RecordBatch.from_arrays([*batch.select(["id", "txt"]).columns, pa.array(out, pa.binary())], schema=schema)

    return run


def _check_pairs(similar: _Similar):
    def run(batches):
        for batch in batches:
            links = []
            for a, b in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist()):
                x, y = unpack_sorted(a), unpack_sorted(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(bool(similar.linked(both, len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def _open_groups(similar: _Similar):
    """Members of one block and its queries: bound by the union of the block, then compare."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        ids = members.column("id").to_numpy()
        sets = [unpack_sorted(x) for x in members.column("shingles").to_pylist()]
        if sets and queries.num_rows:
            sizes = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for query, blob in zip(queries.column("id").to_pylist(), queries.column("asked").to_pylist()):
                own = unpack_sorted(blob)
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                present = hi > lo  # tokens in the block's union
                if present.sum() < similar.least_overlap(len(own)):
                    continue
                lo, n = lo[present], (hi - lo)[present]
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero(similar.linked(both, len(own), sizes))
                if len(hit):  # one link joins the query to the whole group
                    out_a.append(query)
                    out_b.append(int(ids[hit[0]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _classes(described: DataFrame) -> DataFrame:
    """One row for each set of shingles: ``n, s1, s2, low``, its first document (``rid``, ``rtxt``) and its number ``id``.

    The first document is that of the smallest id, of several texts under this
    id that with the smallest hash; null where no document has an id.  The
    number is the first document's id, unless that is also the first one of
    another set: then it is a new number beyond all ids.
    """
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "txt"))).alias("rep")
    found = described.where("n > 0").groupBy("n", "s1", "s2").agg(first, F.min("low").alias("low"))
    found = keep(found.select("n", "s1", "s2", "low", F.col("rep.id").alias("rid"), F.col("rep.txt").alias("rtxt")), "classes")
    several = found.where("rid is not null").groupBy("rid").agg(F.min("rtxt").alias("one"), F.count(F.lit(1)).alias("sets"))
    several = keep(several.where("sets > 1").select(F.col("rid").alias("of"), "one"), "several")
    if several.isEmpty():
        drop(several)
        return found.withColumn("id", F.col("rid"))
    ends = found.agg(F.min("rid").alias("low"), F.max("rid").alias("high")).first()
    seq = F.monotonically_increasing_id() + 1
    fresh = F.lit(ends["high"]) + seq if ends["high"] < 1 << 61 else F.lit(ends["low"]) - seq
    numbered = found.join(several, found["rid"] == several["of"], "left")
    number = F.when(F.col("of").isNull() | (F.col("rtxt") == F.col("one")), F.col("rid")).otherwise(fresh)
    return keep(numbered.withColumn("id", number).select("n", "s1", "s2", "low", "rid", "rtxt", "id"), "classes")


def _linked(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    percent: int = 85,
    block_size: int = BLOCK,
    query_block: int = QUERY_BLOCK,
    range_bytes: int = RANGE_BYTES,
    frequent_from: int = FREQUENT_FROM,
) -> tuple[DataFrame, DataFrame]:
    """The documents (``id, txt, n, s1, s2``) and the sets of :func:`_classes` with the number ``component`` of the least linked one."""
    similar = _Similar(percent)
    text = text_of(text_col)
    source = docs.select(
        F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("txt")
    ).withColumn("place", place_column("id"))
    size = total_bytes(source, "text")
    described = keep(
        source.mapInArrow(_describe(shingle), "id bigint, txt bigint, n bigint, s1 bigint, s2 bigint, low bigint"), "described"
    )
    classes = _classes(described)
    nodes = classes.where("rid is not null").select("id", "n", "low", "rid", "rtxt")

    def sets_for(ids: DataFrame) -> DataFrame:
        wanted = keep(nodes.join(ids.select("id").distinct(), "id").select("id", "rid", "rtxt"), "wanted")
        found = source.where("id is not null").mapInArrow(
            _emit_sets(shingle, id_filter(wanted, "rid")), "rid bigint, rtxt bigint, shingles binary"
        )
        return found.join(wanted, ["rid", "rtxt"]).select("id", "shingles").dropDuplicates(["id"])

    # groups: classes with the same smallest shingle, compared with the first of them
    heads = nodes.groupBy("low").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n_here")).where("n_here > 1")
    pairs = keep(nodes.join(heads, "low").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")), "pairs")
    sets = keep(sets_for(pairs.select(F.explode(F.array("a", "b")).alias("id"))), "sets")
    star = keep(
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set")), "b")
        .mapInArrow(_check_pairs(similar), "a bigint, b bigint"),
        "star",
    )
    # the matrix, by token, and who has to look where
    ranges = max(1, -(-size // range_bytes))
    spark = docs.sparkSession
    first = (described["id"] == nodes["rid"]) & (described["txt"] == nodes["rtxt"])
    copies = described.where("n > 0").join(nodes, first, "left_anti")
    copies = spark.sparkContext.broadcast(id_filter(copies, "id"))
    counted = keep(
        source.mapInArrow(_count(shingle, ranges, copies), "range int, shingles binary, n binary")
        .repartitionById(ranges, F.col("range")).groupBy("range").applyInArrow(_frequent(frequent_from), _COUNTED),
        "counted",
    )
    order = spark.sparkContext.broadcast(_token_order(counted))
    prefixes = source.where("id is not null").mapInArrow(
        _prefixes(shingle, similar, order), "rid bigint, rtxt bigint, prefix binary, parity0 bigint, parity1 bigint"
    )
    prefixes = prefixes.where("prefix is not null").join(nodes.select("id", "rid", "rtxt"), ["rid", "rtxt"])
    prefixes = keep(prefixes.select("id", "prefix", "parity0", "parity1").dropDuplicates(["id"]), "prefixes")

    def cross_links(reached: DataFrame, hubs_only: bool) -> DataFrame:
        """Links between documents of different groups, where ``reached`` (node, component) makes the groups."""
        grouped = nodes.join(reached, nodes.id == reached.node, "left").select(
            nodes.id, nodes.n, F.coalesce("component", nodes.id).alias("grp")
        )
        sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
        members = keep(
            grouped.join(sizes.where("size > 1"), "grp", "left")
            .select("id", "n", "grp", F.coalesce("size", F.lit(1)).alias("size"))
            .withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block_size)).cast("bigint")),
            "members",
        )
        entries = prefixes.join(members, "id").mapInArrow(
            _entries(ranges), "range int, " + ", ".join(f"{f} binary" for f in _FIELDS)
        )
        found = entries.repartitionById(ranges, F.col("range")).groupBy("range").applyInArrow(
            _meetings(similar, hubs_only), "id bigint, grp bigint, block bigint"
        )
        meetings = keep(found.distinct(), "meetings")
        # open the groups that qualify
        asked = meetings.groupBy("grp", "block").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts"))
        inside = members.join(asked, ["grp", "block"]).select("id", "grp", "block", "parts")
        needed = keep(meetings.select("id").union(inside.select("id")).distinct(), "needed")
        sets = keep(sets_for(needed), "sets")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("bigint")
        queries = meetings.join(asked, ["grp", "block"]).withColumn("part", part).join(
            sets.select(F.col("id").alias("id"), F.col("shingles").alias("asked")), "id"
        )
        rows = inside.join(sets, "id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        where = ["grp", "block", "part"]
        return keep(
            rows.select(*where, "id", "shingles").groupBy(*where)
            .cogroup(queries.select(*where, "id", "asked").groupBy(*where))
            .applyInArrow(_open_groups(similar), "a bigint, b bigint"),
            "cross",
        )

    links = star.union(cross_links(star.select(F.col("a").alias("node"), F.col("b").alias("component")), hubs_only=True))
    reached = connected_components(links)
    links = links.union(cross_links(reached, hubs_only=False))
    reached = connected_components(links)
    joined = classes.join(reached, classes["id"] == reached["node"], "left")
    return described, joined.select(*classes.columns, F.coalesce("component", "id").alias("component"))


def _least(linked: DataFrame) -> DataFrame:
    """``linked`` with the first document (``least``, ``least_txt``) of each component.

    That is the document whose number the component has, except where a set
    got a number beyond the ids: such components, few if ids are unique, are
    looked through.
    """
    odd = keep(linked.where("id <> rid").select("component").distinct(), "odd")
    plain = linked.withColumns({"least": F.col("component"), "least_txt": F.lit(None).cast("bigint")})
    if odd.isEmpty():
        drop(odd)
        return plain
    first = linked.join(odd, "component", "left_semi").groupBy("component").agg(F.min(F.struct("rid", "rtxt")).alias("first"))
    found = linked.join(first, "component", "left")
    return found.select(*linked.columns, F.coalesce("first.rid", "component").alias("least"), F.col("first.rtxt").alias("least_txt"))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when 100 * |A & B| >= percent * |A | B|, where A and B
    are their distinct shingles of ``shingle`` words (lower-cased A-Z, parted
    by ASCII white space; a shorter text is one shingle).  Null and empty texts
    have no shingle, no link, and their own id as component.  Ids must be whole
    numbers.  Rows that share an id but not the text are documents of their
    own, each with its own links; equal rows are returned as often as they
    occur; a null id takes part in no link and only joins its equals.
    """
    described, linked = _linked(docs, id_col=id_col, **options)
    named = _least(linked).select("n", "s1", "s2", "least")
    return described.join(named, ["n", "s1", "s2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, and of several texts under it one.

    Rows equal in id and text are one document and stay or go together.  Rows
    with a null id, and those without words, all stay.
    """
    described, linked = _linked(docs, id_col=id_col, text_col=text_col, **options)
    least = _least(linked)
    first = F.when(F.col("least_txt").isNull(), F.col("id") == F.col("component"))
    first = first.otherwise((F.col("rid") == F.col("least")) & (F.col("rtxt") == F.col("least_txt")))
    stay = least.where(first & F.col("rid").isNotNull()).select(F.col("rid").alias("id"), F.col("rtxt").alias("txt"))
    gone = described.where("n > 0 AND id IS NOT NULL").select("id", "txt").distinct().join(stay, ["id", "txt"], "left_anti")
    text_hash = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, (docs[id_col].cast("bigint") == gone["id"]) & (text_hash == gone["txt"]), "left_anti")
