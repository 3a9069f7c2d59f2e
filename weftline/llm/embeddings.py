"""Near-duplicate embeddings by NN-descent, with an audit and an exact way where lists of neighbours end.

Vectors that are equal in every component form one class, which its smallest id stands for. Each class holds a list of the
nearest classes met so far. In a round it meets others in two ways: in cells of random hyperplanes, new ones in each round,
and in the cell of every neighbour it holds, where it meets that neighbour's other ones. Within a cell all cosines are taken
in double precision. A list that is full of links is saturated and becomes twice as long, up to a bound. Rounds go on until
they find no new link and an audit, which compares a bounded sample of classes with all others, finds that nothing above
the tolerated share is missing; if the rounds run out before that, everything is compared exactly.

Classes whose longest list is full of links lie in dense clumps. They are compared with each other exactly, in blocks: two
blocks whose centres and radii prove that all or none of their pairs link are not compared. A pair of blocks may hold as
many links as pairs, so a task tells only each vector's number of links and, instead of the links, which vectors they join.
Links between such classes and others stand in the others' lists. Nothing is written for each pair of a clump.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_cache, release, saved, small, table, tidy
from .graph import components

THRESHOLD = 0.95
#: Neighbours below this cosine are not kept; members of a list at first and at most; tables of hyperplanes in a round.
WALK, LIST, MOST, TABLES = 0.7, 16, 64, 2
#: Neighbours in whose cells a class looks in one round; of a longer list others in each round.
VISITS = 8
#: Members that a cell should have, rows of cells for a task, rows of the graph for a task.
CELL, MEETING, PARTITION = 192, 16384, 1024
#: Rounds after which all is compared exactly, classes in the audit, the share of their links that must have been found.
ROUNDS, AUDIT, RECALL = 12, 512, 0.999
#: Exact comparison: rows and columns of a block, numbers in a part that is sent to all tasks.
ROWS, BLOCK, PART = 256, 1024, 1 << 22
JOINED = "id long, other long, n long"
GRAPH = "id long, v binary, m long, room int, near binary, cos binary, linked long, fresh long, wider boolean"


def _packed(kind: str):
    """(id, vector as a list) -> (id, its numbers as bytes). Vectors that are null, zero or hold null or non-finite numbers,
    and those of a null id, get null: they link with nothing. -0.0 and 0.0 are one."""

    def run(batches):
        no_cache()
        for batch in batches:
            vectors = batch.column(1)
            offsets = np.asarray(vectors.offsets)
            values = np.asarray(vectors.values.to_numpy(zero_copy_only=False), kind) + np.array(0, kind)
            there, ids = vectors.is_valid().to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            good = np.zeros(len(there), bool)
            for k in np.flatnonzero(there & ids):
                v = values[offsets[k] : offsets[k + 1]]
                good[k] = np.isfinite(v).all() and v.any()
            data = [values[a:b].tobytes() if g else None for a, b, g in zip(offsets[:-1], offsets[1:], good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "v"])

    return run


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)


def _numbers(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, one row behind the other, and how many each has."""
    offsets, data = _bytes(column)
    return data[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _matrix(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """Unit vectors in double precision; all of one length."""
    flat = _numbers(column, kind)[0].astype(float).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True) if flat.size else flat
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True)) if flat.size else flat


def _by_length(column: pa.BinaryArray, kind: str) -> dict[int, np.ndarray]:
    """Rows of a column of vectors, by the length of the vectors."""
    dims = _numbers(column, kind)[1]
    return {d: np.flatnonzero(dims == d) for d in np.unique(dims).tolist()}


def _lists(numbers: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Numbers of some rows, row k before ``ends[k]``, as bytes."""
    size = numbers.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.r_[0, ends] * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])


def _planes(bits: int, length: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, length)).standard_normal((bits, length))


def _codes(unit: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """On which sides of random hyperplanes vectors lie, as one number."""
    sides = unit @ _planes(bits, unit.shape[1], seed).T > 0
    return sides @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(unit), np.int64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Names of cells: 64-bit numbers spread by multiplication."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x94D049BB133111EB & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _meet(bits: int, round_: int, whole: bool, kind: str):
    """Rows of the graph -> a row for each cell that a class goes to; with its vector if ``whole``."""

    def run(batches):
        no_cache()
        for batch in batches:
            ids = batch.column("id").to_numpy()
            who, cells = [], []
            vectors = batch.column("v")
            for length, rows in _by_length(vectors, kind).items():
                unit = _matrix(vectors.take(pa.array(rows)), kind)
                for t in range(TABLES):
                    who.append(rows)
                    cells.append(_mixed(_codes(unit, bits, round_ * TABLES + t), (length << 16) + (round_ << 4) + t + 1))
            near, n = _numbers(batch.column("near"), "<i8")
            if len(near):
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((_mixed(near, round_ + 1), owner))
                near = near[order][np.arange(len(near)) - np.repeat(np.cumsum(n) - n, n) < VISITS]
                who += [np.repeat(np.arange(len(n)), np.minimum(n, VISITS)), np.flatnonzero(n)]
                cells += [_mixed(near, 0), _mixed(ids[n > 0], 0)]
            at = pa.array(np.concatenate(who) if who else np.zeros(0, np.int64))
            columns, names = [pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64)), batch.column("id").take(at)], ["cell", "id"]
            if whole:  # the longest list full of links is not added to any more
                room = pa.array(np.where(batch.column("linked").to_numpy() >= MOST, 0, batch.column("room").to_numpy()).astype(np.int32))
                for a in range(0, len(at), 8192):
                    part = at.slice(a, 8192)
                    yield pa.RecordBatch.from_arrays([columns[0].slice(a, 8192), columns[1].slice(a, 8192), room.take(part), vectors.take(part)], names=[*names, "room", "v"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _cells(rows: pa.Table, kind: str) -> pa.Table:
    """All cosines inside each of some cells -> for each member those it is nearest to, as many as its list may hold."""
    rows = rows.combine_chunks()
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    vectors = rows.column("v").combine_chunks()
    for _, mine in _by_length(vectors, kind).items():
        part = rows.take(pa.array(mine))
        cell, salt, ids, room = (part.column(c).to_numpy() for c in ("cell", "salt", "id", "room"))
        order = np.lexsort((ids, salt, cell))
        cell, salt, ids, room = cell[order], salt[order], ids[order], room[order]
        unit = _matrix(part.column("v").combine_chunks(), kind)[order]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])])
        for a, b in zip(starts, np.r_[starts[1:], len(ids)], strict=True):
            if b - a < 2:
                continue
            for c in range(a, b, 1024):
                cos = unit[c : min(c + 1024, b)] @ unit[a:b].T
                i, j = np.nonzero(cos >= WALK)
                apart = ids[c + i] != ids[a + j]
                i, j = i[apart], j[apart]
                if len(i):
                    near = cos[i, j]
                    best = np.lexsort((-near, i))
                    i, j, near = i[best], j[best], near[best]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    kept = rank < room[c + i]
                    out.append((ids[c + i[kept]], ids[a + j[kept]], near[kept]))
    ids, others, near = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"id": ids, "other": others, "cos": near})


def _merge(key, graph: pa.Table, found: pa.Table) -> pa.Table:
    """Lists with what has been found: the nearest of both, each once. Saturated lists get room for twice as many."""
    graph = graph.combine_chunks()
    ids, room = graph.column("id").to_numpy(), graph.column("room").to_numpy()
    (near, held), (cos, _) = _numbers(graph.column("near").combine_chunks(), "<i8"), _numbers(graph.column("cos").combine_chunks(), "<f8")
    held = np.repeat(np.arange(len(ids)), held)
    by_id = np.argsort(ids)
    at = by_id[np.searchsorted(ids, found.column("id").to_numpy(), sorter=by_id)]
    who, other = np.r_[held, at], np.r_[near, found.column("other").to_numpy()]
    value, new = np.r_[cos, found.column("cos").to_numpy()], np.r_[np.zeros(len(held), bool), np.ones(len(at), bool)]
    order = np.lexsort((new, other, who))
    who, other, value, new = who[order], other[order], value[order], new[order]
    first = np.r_[True, (who[1:] != who[:-1]) | (other[1:] != other[:-1])][: len(who)]
    who, other, value, new = who[first], other[first], value[first], new[first]
    order = np.lexsort((other, -value, who))
    who, other, value, new = who[order], other[order], value[order], new[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < room[who]
    who, other, value, new = who[kept], other[kept], value[kept], new[kept]
    linked = np.bincount(who[value >= THRESHOLD], minlength=len(ids))
    fresh = np.bincount(who[new & (value >= THRESHOLD)], minlength=len(ids))
    wider = (linked >= room) & (room < MOST)
    ends = np.cumsum(np.bincount(who, minlength=len(ids)))
    columns = {"id": graph.column("id"), "v": graph.column("v"), "m": graph.column("m"), "room": pa.array(np.where(wider, 2 * room, room).astype(np.int32))}
    columns |= {"near": _lists(other.astype("<i8"), ends), "cos": _lists(value.astype("<f8"), ends)}
    columns |= {"linked": pa.array(linked.astype(np.int64)), "fresh": pa.array(fresh.astype(np.int64)), "wider": pa.array(wider)}
    return pa.table(columns)


def _round(graph: DataFrame, n: int, round_: int, kind: str) -> DataFrame:
    """One round of descent over the whole graph. A cell with many members is split, otherwise in each round."""
    bits = max(0, math.ceil(math.log2(max(1, n) / CELL)))
    cells = graph.mapInArrow(_meet(bits, round_, False, kind), "cell long, id long").groupBy("cell").agg(F.count("*").alias("n"))
    hot = saved(cells.groupBy((F.col("n") > CELL).alias("many"), F.when(F.col("n") > CELL, F.col("cell")).alias("cell")).agg(F.sum("n").alias("n")))
    total = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = hot.where("many").select(F.col("cell").alias("c_"), F.ceil(F.col("n") / CELL).alias("parts"))
    rows = graph.mapInArrow(_meet(bits, round_, True, kind), "cell long, id long, room int, v binary").join(small(parts), F.col("cell") == F.col("c_"), "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", F.lit(round_)), F.col("parts")), F.lit(0)).cast("long"))
    task = F.pmod(F.xxhash64("cell", "salt"), F.lit(max(1, math.ceil(total / MEETING)))).alias("task")
    found = rows.select(task, "cell", "salt", "id", "room", "v").groupBy("task").applyInArrow(lambda rows: _cells(rows, kind), "id long, other long, cos double")
    part = lambda df: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / PARTITION))))).groupBy("part")
    out = saved(part(graph).cogroup(part(found)).applyInArrow(_merge, GRAPH))
    release(graph, hot)
    return out


def _recall(graph: DataFrame, kind: str) -> float:
    """Of the links of a bounded sample of classes, drawn by a hash of the id, the share that their lists hold.

    Classes of dense clumps are compared exactly anyway and are left out.
    """
    drawn = graph.where(F.col("linked") < MOST).orderBy(F.xxhash64("id"), "id").limit(AUDIT).select("id", "v", F.col("linked").alias("m")).toArrow()
    held = sum(drawn.column("m").to_pylist())
    part = _part(drawn, kind)

    def run(batches):
        for batch in batches:
            n = 0
            for length, rows in _by_length(batch.column(1), kind).items():
                if length in part:
                    ids, unit = part[length].ids, part[length].unit
                    own, mine = batch.column(0).to_numpy()[rows], _matrix(batch.column(1).take(pa.array(rows)), kind)
                    for a in range(0, len(own), ROWS):
                        n += int(((mine[a : a + ROWS] @ unit.T >= THRESHOLD) & (own[a : a + ROWS, None] != ids)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    true = graph.select("id", "v").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return held / true if true else 1.0


class _Part:
    """Vectors of one length in an order in which near ones stand together, with centre and radius of each block."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, m: np.ndarray, size: int):
        order = np.argsort(_codes(unit, 16, 7), kind="stable")
        self.ids, self.unit, self.m, self.size = ids[order], unit[order], m[order], size
        self.balls = [self.ball(a) for a in range(0, len(ids), size)]

    def ball(self, a: int) -> tuple[np.ndarray, float]:
        block = self.unit[a : a + self.size]
        centre = block.sum(0)
        length = math.sqrt(centre @ centre)
        centre = centre / length if length > 1e-9 else block[0]
        return centre, float(np.arccos(np.clip((block @ centre).min(), -1, 1)))


def _part(rows: pa.Table, kind: str) -> dict[int, _Part]:
    rows = rows.combine_chunks()
    vectors = rows.column("v").combine_chunks() if len(rows) else pa.array([], pa.binary())
    ids, m = rows.column("id").to_numpy(), rows.column("m").to_numpy().astype(float)
    return {d: _Part(ids[k], _matrix(vectors.take(pa.array(k)), kind), m[k], BLOCK) for d, k in _by_length(vectors, kind).items()}


def _groups(i: np.ndarray, j: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For links (row i, column j), sorted by row: the linked rows and, for them and for each column, the first column of the group that links join."""
    starts = np.flatnonzero(np.r_[True, np.diff(i) > 0])
    of_row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(i)]))
    label = np.arange(columns)
    while True:
        rows = np.minimum.reduceat(label[j], starts)
        new = label.copy()
        np.minimum.at(new, j, rows[of_row])
        if (new == label).all():
            return i[starts], rows, label
        label = new


def _compare(part: dict[int, _Part], threshold: float, kind: str):
    """Rows (id, v) against a part, as :data:`JOINED`. Angles obey the triangle inequality, which spares blocks."""
    limit, margin = math.acos(threshold), 1e-6

    def run(batches):
        no_cache()
        for batch in batches:
            for length, rows in _by_length(batch.column(1), kind).items():
                if length not in part:
                    continue
                mine, theirs = _Part(batch.column(0).to_numpy()[rows], _matrix(batch.column(1).take(pa.array(rows)), kind), np.ones(len(rows)), ROWS), part[length]
                for r, (centre, radius) in enumerate(mine.balls):
                    a, x = mine.ids[r * ROWS : (r + 1) * ROWS], mine.unit[r * ROWS : (r + 1) * ROWS]
                    for c, (other, reach) in enumerate(theirs.balls):
                        angle = math.acos(max(-1.0, min(1.0, float(centre @ other))))
                        if angle - radius - reach > limit + margin:
                            continue
                        cols = slice(c * BLOCK, (c + 1) * BLOCK)
                        b, m = theirs.ids[cols], theirs.m[cols]
                        if angle + radius + reach < limit - margin:  # all of them link: any one joins them all
                            held = dict(zip(b.tolist(), m.tolist(), strict=True))
                            n = np.array([m.sum() - held.get(k, 0.0) for k in a.tolist()]).astype(np.int64)
                            told = (np.r_[a, b], np.r_[np.full(len(a), b[0]), np.full(len(b), a[0])], np.r_[n, np.zeros(len(b), np.int64)])
                        else:
                            i, j = np.nonzero(x @ theirs.unit[cols].T >= threshold)
                            apart = a[i] != b[j]
                            i, j = i[apart], j[apart]
                            if not len(i):
                                continue
                            at, first, label = _groups(i, j, len(b))
                            n, hit = np.bincount(i, m[j], len(a)).astype(np.int64)[at], np.unique(j)
                            told = (np.r_[a[at], b[hit]], np.r_[b[first], b[label[hit]]], np.r_[n, np.zeros(len(hit), np.int64)])
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in told], names=["id", "other", "n"])

    return run


def links(classes: DataFrame, kind: str, *, threshold: float = THRESHOLD) -> DataFrame:
    """All classes of a saved table (id, v, m) compared exactly, as :data:`JOINED`: edges that join what links, and
    how many vectors of other classes each class links with (each class counts ``m`` times), as sums over its rows."""
    n, numbers = classes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    rows = saved(classes.select("id", "v").repartition(max(1, math.ceil(n / PARTITION)), "id"))
    parts = max(1, math.ceil(numbers / np.dtype(kind).itemsize / PART))
    dealt, joined = F.pmod(F.xxhash64("id"), F.lit(parts)), None
    for k in range(parts):
        part = _part(classes.where(dealt == k).select("id", "v", "m").toArrow(), kind)
        told = saved(rows.mapInArrow(tidy(_compare(part, threshold, kind)), JOINED))
        joined = told if joined is None else joined.unionByName(told)
    return joined


def descend(classes: DataFrame, kind: str) -> tuple[DataFrame | None, float]:
    """(graph, audited recall) for a saved table (id, v, m) of distinct vectors; no graph if the rounds ran out."""
    n = classes.count()
    none = F.lit(b"").cast("binary")
    graph, recall = classes.select("id", "v", "m", F.lit(LIST).cast("int").alias("room"), none.alias("near"), none.alias("cos"), F.lit(0).cast("long").alias("linked")), 0.0
    for k in range(ROUNDS):
        graph = _round(graph, n, k, kind)
        fresh, linked, wider = graph.agg(F.sum("fresh"), F.sum("linked"), F.max("wider")).first() if n else (0, 0, False)
        if not wider and (fresh or 0) <= 0.001 * (linked or 0):
            recall = _recall(graph, kind)
            if recall >= RECALL:
                return graph, recall
    return None, recall


def _held(batches):
    """Rows of the graph -> a row for each link that a list holds."""
    for batch in batches:
        (near, n), (cos, _) = _numbers(batch.column("near"), "<i8"), _numbers(batch.column("cos"), "<f8")
        at, linked = np.repeat(np.arange(len(n)), n), cos >= THRESHOLD
        rows = pa.array(at[linked])
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("m").take(rows), pa.array(near[linked])], names=["id", "m", "other"])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept, recall) for every row; ``recall`` is what the audit found, the same in every row.

    Defined results: vectors that are null, zero or hold null or non-finite components, and rows of a null id, link with
    nothing; of rows that share an id each counts as a vector of its own in ``n_links``, and they share a component only
    if their vectors link; vectors of different length never link; an empty table gives an empty table; other columns are
    not read.
    """
    kind = "<f8" if vectors.schema[vec_col].dataType.elementType.typeName() == "double" else "<f4"
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if kind == "<f8" else "array<float>").alias("embedding"))
    rows = saved(given.mapInArrow(tidy(_packed(kind)), "id long, v binary"))
    good = rows.where("v IS NOT NULL")
    classes = saved(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")))
    graph, recall = descend(classes, kind) if threshold == THRESHOLD else (None, 1.0)
    if graph is None:
        joined, recall = links(classes, kind, threshold=threshold), 1.0
    else:
        dense = saved(graph.where(F.col("linked") >= MOST).select("id", "v", "m"))
        lists = graph.where(F.col("linked") < MOST).select("id", "m", "near", "cos").mapInArrow(_held, "id long, m long, other long")
        several = small(saved(classes.where("m > 1").select(F.col("id").alias("i_"), F.col("m").alias("m_"))))
        own = lists.join(several, F.col("other") == F.col("i_"), "left").select("id", "other", F.coalesce("m_", F.lit(1)).cast("long").alias("n"))
        back = lists.join(small(saved(dense.select(F.col("id").alias("d_")))), F.col("other") == F.col("d_")).select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("m").alias("n"))
        joined = saved(own.unionByName(back))
        if not dense.isEmpty():
            joined = joined.unionByName(links(dense, kind))
    numbers = joined.groupBy("id").agg(F.sum("n").alias("n"))
    comps = components(joined.select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.join(numbers.select(F.col("id").alias("a"), "n"), F.col("id") == F.col("a"), "left").join(comps, F.col("id") == F.col("node"), "left")
    named = saved(named.select(F.col("v").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = good.join(named, F.col("v") == F.col("e")).select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(recall))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumnRenamed("id", "vec_id").drop("recall")
