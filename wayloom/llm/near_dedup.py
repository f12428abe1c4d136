"""Near-duplicate groups: one-permutation MinHash, bands, star edges, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayloom.llm import textvec as tv
from wayloom.llm.components import connected_components
from wayloom.llm.memory import bounded
from wayloom.llm.scratch import Scratch
from wayloom.llm.signatures import band_keys, one_permutation

SHINGLE_WORDS = 5
BINS, ROWS = 200, 5  # 40 bands: a pair of similarity 0.75 shares none with probability 2e-5
THRESHOLD = (75, 100)
BLOCK_DOCS = 160
STAR_PART = 2048  # members of a centre in one unit of work


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct hashes, bounds by text) of lower-cased texts."""
    for first, end, buf, offs in tv.slices(col):
        buf = tv.LOWER[buf]
        starts, ends, woffs = tv.words(buf, offs)
        yield first, end, *tv.sorted_sets(*tv.shingle_hashes(tv.word_hashes(buf, starts, ends), woffs, k))


def _sign(k: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, sets, offs in shingle_sets(batch.column(1), k):
                n, size = end - first, np.diff(offs)
                f1, f2 = (np.zeros(n, np.uint64) for _ in range(2))
                full = size > 0
                if full.any():
                    at = offs[:-1][full]
                    f1[full] = np.add.reduceat(tv.fmix(sets ^ np.uint64(0x5BF03635)), at)
                    f2[full] = np.add.reduceat(tv.fmix(sets + np.uint64(0x1D8AF066B5F4A3C1)), at)
                keys = band_keys(one_permutation(sets, offs, bins), rows)
                keys = _lists(keys, full)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(size.astype(np.int64)), _signed(f1), _signed(f2), keys], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return run


def _lists(keys: np.ndarray, full: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(full * keys.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[full].ravel()))


def _packed(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node), a range of them a task, to (key, a, b): b hangs on a, the first node of its key in this range.

    The first and the last key may go on in another range; for these, a row (key, a, a) says where the range's own star has its centre.
    """
    key = centre = None
    names = ["key", "a", "b"]
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        fresh = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        run = np.cumsum(fresh)  # 0: the key of the batch before
        centres = np.concatenate([[0 if centre is None else centre], nodes[fresh]])[run]
        on = centres != nodes
        on[0] |= key is None
        key, centre = int(keys[-1]), int(centres[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(centres[on]), pa.array(nodes[on])], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (key, centre, centre)], names)


def _joined_ranges(shared):
    """Stars whose key spans ranges hang on the first range's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, spanning = shared.value
        for batch in batches:
            keys, a, b = (batch.column(i).to_numpy() for i in range(3))
            a = a.copy()
            for i in np.flatnonzero(np.isin(keys, spanning)).tolist():
                a[i] = where.get((int(keys[i]), int(a[i])), a[i])
            on = a != b
            yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(a[on]), pa.array(b[on])], ["key", "a", "b"])

    return run


def star_rows(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, a, b) for every row (key, node) that is not its key's smallest node a.

    Rows are dealt by ranges of (key, node), so a key of any size is spread over
    tasks that each stream their range.  Two rows a task at most go to the
    driver, which names the centre of keys that span ranges.
    """
    ordered = members.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    pieces = scratch.save(ordered.mapInArrow(bounded(_stars), "key long, a long, b long"), "stars")
    centres: dict[int, set[int]] = {}
    for r in pieces.where("a = b").toLocalIterator():
        centres.setdefault(r.key, set()).add(r.a)
    where = {(k, a): min(v) for k, v in centres.items() if len(v) > 1 for a in v}
    if not where:
        return pieces.where("a <> b")
    shared = members.sparkSession.sparkContext.broadcast((where, np.array(sorted({k for k, _ in where}), np.int64)))
    whole = scratch.save(pieces.mapInArrow(bounded(_joined_ranges(shared)), "key long, a long, b long"), "stars")
    scratch.drop(pieces)
    return whole


def _edge_sets(k: int):
    """(a, part, lead, doc_id, text) to (a, part, lead, doc_id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, sets, offs in shingle_sets(batch.column(4), k):
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(8 * offs), pa.py_buffer(np.ascontiguousarray(sets))])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(4)), data.cast(pa.binary())], ["a", "part", "lead", "doc_id", "shingles"])

    return run


def _edge_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, lead first): (a, b, both, either) of the centre's set and each member's; one centre in memory."""
    key, centre = None, []
    for batch in batches:
        a, part, lead, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        rows = []
        for i, raw in enumerate(batch.column(4)):
            own = np.frombuffer(raw.as_buffer(), np.uint64)
            if (a[i], part[i]) != key:
                key, centre = (a[i], part[i]), []
            if lead[i]:
                centre.append(own.copy())
                continue
            for c in centre:
                small, large = (own, c) if len(own) < len(c) else (c, own)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                rows.append((int(a[i]), int(ids[i]), both, len(own) + len(c) - both))
        yield _packed(["a", "b", "both", "either"], [pa.int64()] * 4, rows)


def compared(edges: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int], part_rows: int = STAR_PART) -> DataFrame:
    """(a, b, linked, distance) of edges (a, b) from exact sets; ``texts`` has (doc_id, text).

    A unit of work is a centre with at most about ``part_rows`` of its members,
    streamed.  distance (1 - intersection / union) is null where an id has
    several rows, since it would not be one number.
    """
    size = edges.groupBy("a").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    members = edges.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("lead"), F.col("b").alias("doc_id"))
    centres = size.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"), F.col("a").alias("doc_id"))
    sets = members.unionByName(centres).join(texts, "doc_id").select("a", "part", "lead", "doc_id", "text").mapInArrow(
        bounded(_edge_sets(k)), "a long, part int, lead boolean, doc_id long, shingles binary")
    units = sets.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead"), "doc_id")
    links = units.mapInArrow(bounded(_edge_links), "a long, b long, both long, either long")
    return links.groupBy("a", "b").agg(
        F.max(threshold[1] * F.col("both") >= threshold[0] * F.col("either")).alias("linked"),
        F.when(F.count("*") == 1, 1 - F.max(F.col("both") / F.col("either"))).alias("distance"))


def _unit_sets(k: int):
    """(unit, blocks, block, component, text) to (unit, block, lead, component, shingles).

    block 0 and up: a lead, in its own block and a member of the blocks before; -1: a member of all blocks.
    """
    names, kinds = ["unit", "block", "lead", "component", "shingles"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, blocks, block, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for first, end, sets, offs in shingle_sets(batch.column(4), k):
                rows, held = [], 0
                for i in range(first, end):
                    raw = sets[offs[i - first] : offs[i - first + 1]].tobytes()
                    for other in range(int(blocks[i]) if block[i] < 0 else int(block[i]) + 1):
                        rows.append((int(unit[i]), other, other == block[i], int(own[i]), raw))
                        held += len(raw)
                        if held > 8_000_000:
                            yield _packed(names, kinds, rows)
                            rows, held = [], 0
                yield _packed(names, kinds, rows)

    return run


def linked_pairs(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Boolean matrix: the two sets' intersection holds at least the threshold's share of their union.

    Exact: counts come from products of 0/1 matrices over slices of the shared
    values, held in float32 below 2^24.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = row[keep], column[inverse[keep]]
    both = np.zeros((n, n), np.float32)
    width = max(1, 4_000_000 // max(n, 1))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        m = np.zeros((n, min(width, int(shared.sum()) - a)), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    return (threshold[1] * inter >= threshold[0] * union) & (union > 0)


def _bridges(parts: list[int], sets: list[np.ndarray], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of components that some link joins, one pair a component that is not the smallest of its own."""
    part, at = np.unique(parts, return_inverse=True)
    if len(part) < 2:
        return []
    link = linked_pairs(sets, threshold) & (at[:, None] != at[None, :])
    near = np.zeros((len(part), len(part)), bool)
    near[tuple(at[i] for i in np.nonzero(link))] = True
    label = np.arange(len(part))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(part)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(part[r]), int(part[i])) for i, r in enumerate(label.tolist()) if r != i]


def _confirm(threshold: tuple[int, int], chunk: int):
    """Rows sorted by (unit, block, leads first): linked components; a block's leads and ``chunk`` members are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []
        leads: tuple[list, list] = ([], [])
        members: tuple[list, list] = ([], [])

        def close():
            out.extend(_bridges(leads[0] + members[0], leads[1] + members[1], threshold))
            members[0].clear()
            members[1].clear()

        for batch in batches:
            unit, block, lead, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, raw in enumerate(batch.column(4)):
                if (unit[i], block[i]) != key:
                    close()
                    key = unit[i], block[i]
                    leads[0].clear()
                    leads[1].clear()
                to = leads if lead[i] else members
                to[0].append(int(own[i]))
                to[1].append(np.frombuffer(raw.as_buffer(), np.uint64).copy())
                if len(members[0]) == chunk:
                    close()
            if len(out) > 50_000:
                yield _packed(["a", "b"], [pa.int64()] * 2, out)
                out.clear()
        close()
        yield _packed(["a", "b"], [pa.int64()] * 2, out)

    return run


def _between_components(star: DataFrame, edges: DataFrame, known: DataFrame, label: DataFrame, texts: DataFrame, scratch: Scratch, k: int, threshold: tuple[int, int], block_docs: int) -> DataFrame:
    """Pairs (a, b) of components that links between members of one bucket join.

    In such a bucket, members outside its largest component lead: each is
    compared with all members, ``block_docs`` leads at a time.  A member of the
    largest component whose distance to the centre differs by more than
    1 - threshold from that of every lead can link none of them (Jaccard
    distance obeys the triangle inequality) and is left out.
    """
    own = lambda name, at: label.select(F.col("node").alias(at), F.col("component").alias(name))
    apart = edges.join(own("ca", "a"), "a").join(own("cb", "b"), "b").where("ca <> cb").select("a", "b")
    keys = scratch.save(star.join(apart, ["a", "b"], "left_semi").select("key").distinct(), "open")
    rows = star.join(keys, "key", "left_semi")
    same = rows.groupBy("key", "a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("sum"))
    same = same.groupBy("a", "n", "sum").agg(F.min("key").alias("key")).select("key")  # buckets of other bands with the same members say nothing new
    rows = scratch.save(rows.join(same, "key", "left_semi").join(own("component", "b"), "b").select("key", "a", "b", "component"), "open-rows")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main")
    rows = scratch.save(rows.join(main, "key").select("key", "a", "b", "component", (F.col("component") != F.col("main")).alias("lead")), "open-rows")
    if rows.isEmpty():
        return rows.select("a", "b")
    unknown = rows.select("a", "b").distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    seen = scratch.save(known.unionByName(compared(unknown, texts, k, threshold)).select("a", "b", "distance"), "known")
    rows = rows.join(seen, ["a", "b"], "left")
    slack = 1 - threshold[0] / threshold[1] + 1e-9
    bounds = rows.where("lead").groupBy("key").agg(
        F.min(F.coalesce("distance", F.lit(0.0))).alias("least"), F.max(F.coalesce("distance", F.lit(1.0))).alias("most"), F.ceil(F.count("*") / block_docs).cast("int").alias("blocks"))
    placed = rows.join(bounds, "key").where(F.col("lead") | F.col("distance").isNull() | F.col("distance").between(F.col("least") - slack, F.col("most") + slack))
    block = F.when(F.col("lead"), F.pmod(F.xxhash64("b", "key"), F.col("blocks"))).otherwise(F.lit(-1)).cast("int")
    units = (
        placed.select(F.col("key").alias("unit"), "blocks", block.alias("block"), F.col("b").alias("doc_id"), "component").join(texts, "doc_id")
        .select("unit", "blocks", "block", "component", "text").mapInArrow(bounded(_unit_sets(k)), "unit long, block int, lead boolean, component long, shingles binary")
        .repartition("unit", "block").sortWithinPartitions("unit", "block", F.desc("lead"))
    )
    return units.mapInArrow(bounded(_confirm(threshold, block_docs)), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
    bins: int = BINS, rows: int = ROWS, threshold: tuple[int, int] = THRESHOLD, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    1. Each text gives its shingle set's size, a 128 bit fingerprint and its
       band keys (one permutation, optimal densification).
    2. Equal sets collapse to one representative, the smallest id.
    3. In every bucket all members hang on the smallest, a star with one
       candidate edge a member; an edge that several bands make counts once.
    4. Edges are confirmed exactly on whole sets, centre by centre: first each
       document with its smallest centre, then the other edges that still lie
       between different components.
    5. Where a bucket still holds several components, its members outside the
       largest one are compared with all that could link across, ``block_docs``
       at a time in one bounded unit of work, so links between members that
       share no star edge are found too, without a cap.
    6. Components of the links go back to all documents.

    Defined cases: null or empty text (or no word) has n_shingles 0, links with
    nothing and is kept; a null id gives component null, kept; rows that share
    an id are one node, each returned; ties go to the smallest id; other
    columns of ``docs`` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.save(text.mapInArrow(bounded(_sign(k, bins, rows)), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "signed")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(live.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = live.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    star = star_rows(reps, scratch)
    edges = scratch.save(star.select("a", "b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = scratch.save(text.join(nodes.hint("merge"), "doc_id", "left_semi"), "texts")
    first = edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    known = scratch.save(compared(first, texts, k, threshold), "known")
    found = connected_components(known.where("linked").select("a", "b"), scratch)
    label = scratch.save(_labels(edges, found), "labels")
    own = lambda name, at: label.select(F.col("node").alias(at), F.col("component").alias(name))
    rest = edges.join(own("ca", "a"), "a").join(own("cb", "b"), "b").where("ca <> cb").select("a", "b").join(known.select("a", "b"), ["a", "b"], "left_anti")
    more = scratch.save(compared(rest, texts, k, threshold), "known")
    known = known.unionByName(more)
    links = known.where("linked").select("a", "b")
    if not more.where("linked").isEmpty():
        found = connected_components(links, scratch)
        label = scratch.save(_labels(edges, found), "labels")
    across = scratch.save(_between_components(star, edges, known, label, texts, scratch, k, threshold, block_docs), "across")
    if not across.isEmpty():
        found = connected_components(links.union(across), scratch)
    named = scratch.save(
        classes.join(found, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "named")
    scratch.free(signed, named)
    member = signed.select("doc_id", "n_shingles", "f1", "f2").join(named.hint("merge"), ["f1", "f2", "n_shingles"], "left")
    return member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labels(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of all ends of the edges; those without a link are their own."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
