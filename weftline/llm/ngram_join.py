"""Jaccard self-join of documents on word shingles through a token-group matrix.

1. Every document's distinct shingles are hashed and dealt by hash into buckets, as packed arrays. A bucket knows of each
   of its shingles in how many documents it occurs. Shingles that a bounded sample shows to be very frequent are known to be
   shared and go with their documents instead, so that no bucket grows with them. A document of which more than a quarter
   of the shingles occur nowhere else can link with nothing different and is done with; few documents are left.
2. Of documents with the same set one stays. The others are put into groups by the most frequent of their min-hashes and
   groups into blocks of bounded size; the most central document of a group stands in each of its blocks. All links inside
   a block are found there, and components follow from them.
3. The token-group matrix holds for each block the union of its members' shingles and its smallest set. Looking up a
   document's prefix (rare shingles first; a link must share one) gives the blocks that can hold a link to another
   component; of two components the smaller one asks. The overlap of the document with a block's union bounds that with each
   of its members: only where it reaches three quarters of the document, and three sevenths of the document and the block's
   smallest set together, the block is opened: only then members are read, and compared. These links join the components.

All links between different sets either are found or lie inside a component already, so that components are exact up to
collisions of hashes. No task holds more than a bucket or a block, and no step makes rows for pairs of a group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_cache, release, saved, slices, small, table, tidy, trim
from .graph import Sets, components

WIDTH, PERCENT = 5, 75
#: Bytes of text for a bucket of shingles; beyond so many buckets these grow to the second size, as packing gets worse.
BUCKET_BYTES, BUCKETS, LARGE_BUCKET = 8 << 20, 4096, 64 << 20
#: Members and shingles of a block, queries to a block at once, min-hashes for grouping.
BLOCK, BLOCK_TOKENS, QUERIES, HASHES = 512, 1_000_000, 2000, 4
#: Documents of the sample and the share of them that makes a shingle a frequent one. Results do not depend on either.
SAMPLE, FREQUENT = 8_000, 0.0025
_CACHE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _forget() -> None:
    _WORDS.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; ASCII letters in lower case, ``bytes.split`` white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    key = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        key = _mixed(key * _MIX + h[k : k + n])
    return np.unique(key)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _named(low: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """A shingle's name from its lower 48 bits and its bucket."""
    return (low & np.uint64((1 << 48) - 1)) | ((np.asarray(bucket).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48))


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _deal(buckets: int, frequent: np.ndarray):
    """Documents -> for each batch and bucket one row of packed arrays: ids, shingles per id, 48-bit shingles.

    Frequent shingles go, with their whole names, to the document's own part, which has the bucket number -1 - part.
    """
    schema = "bucket int, ids binary, counts binary, tokens binary"

    def flush(ids, sets):
        counts = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), counts)
        bucket = _bucket(tokens, buckets)
        known = np.zeros(len(tokens), bool)
        if len(frequent):
            known = frequent[np.searchsorted(frequent, tokens).clip(0, len(frequent) - 1)] == tokens
            tokens[known] = _named(tokens[known], bucket[known])
            bucket[known] = -1 - _part_of(ids, buckets)[owner[known]]
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        rows = []
        for a, b in zip(starts, np.r_[starts[1:], len(ranked)], strict=True):
            at = order[a:b]
            who, n = np.unique(owner[at], return_counts=True)
            full = tokens[at].astype("<u8")
            rows.append((int(ranked[a]), ids[who].astype("<i8").tobytes(), n.astype("<u4").tobytes(), full.tobytes() if ranked[a] < 0 else full.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "ids", "counts", "tokens"])

    def run(batches):
        own_cache(_forget)
        ids, sets, n = [], [], 0
        for batch in batches:
            texts = (t for part in slices(batch.column(1)) for t in part)
            for i, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                s = shingles(text)
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    n += len(s)
                if n > 1_500_000:
                    yield flush(np.array(ids), sets)
                    ids, sets, n = [], [], 0
        if n:
            yield flush(np.array(ids), sets)

    return tidy(run), schema


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that a sample of documents, drawn by a hash of the id, holds often; there are fewer of them than 1 / FREQUENT
    times the shingles of a document, and the driver gets no others."""

    def run(batches):
        own_cache(_forget)
        for batch in batches:
            sets = [shingles(t) for part in slices(batch.column(0)) for t in part]
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    drawn = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    often = drawn.mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = often.where(F.col("n") >= max(20, math.ceil(FREQUENT * min(n, SAMPLE)))).orderBy(F.desc("n"), "token").limit(1 << 17).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64)) if len(rows) else np.zeros(0, np.uint64)


def _arrays(rows: pa.Table, *columns: tuple[str, str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in columns]


def _count(parts: int):
    """One bucket -> for each part of the documents a row: ids, shingles here, shared ones here, those and their documents."""
    schema = "part int, ids binary, counts binary, shared binary, tokens binary, df binary"
    names = ["part", "ids", "counts", "shared", "tokens", "df"]

    def told(rows):
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=names)

    def run(key, rows):
        bucket = key[0].as_py()
        if bucket < 0:  # frequent shingles of a part's documents
            ids, counts, tokens = _arrays(rows, ("ids", "<i8"), ("counts", "<u4"), ("tokens", "<u8"))
            n = counts.tobytes()
            return told([(-1 - bucket, ids.tobytes(), n, n, tokens.tobytes(), np.full(len(tokens), 65535, "<u2").tobytes())])
        ids, counts, low = _arrays(rows, ("ids", "<i8"), ("counts", "<u4"), ("tokens", "u1"))
        full = np.zeros((len(low) // 6, 8), np.uint8)
        full[:, :6] = low.reshape(-1, 6)
        tokens = full.view("<u8").ravel()
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        size = np.diff(np.r_[start, len(ranked)])
        df = np.repeat(np.minimum(size, 65534).astype(np.uint16), size)
        keep = df > 1
        owner, ranked, df = owner[order[keep]], _named(ranked[keep], bucket), df[keep]
        back = np.argsort(owner, kind="stable")
        owner, ranked, df = owner[back], ranked[back], df[back]
        shared = np.bincount(owner, minlength=len(ids))
        part = _part_of(ids, parts)
        of_token = np.repeat(part, shared)
        by_part, by_token = np.argsort(part, kind="stable"), np.argsort(of_token, kind="stable")
        found = np.unique(part)
        ends, token_ends = np.searchsorted(part[by_part], found, "right"), np.searchsorted(of_token[by_token], found, "right")
        out = []
        for p, d, t in zip(found.tolist(), np.split(by_part, ends[:-1]), np.split(by_token, token_ends[:-1]), strict=True):
            out.append((p, ids[d].tobytes(), counts[d].astype("<u4").tobytes(), shared[d].astype("<u4").tobytes(), ranked[t].astype("<u8").tobytes(), df[t].astype("<u2").tobytes()))
        trim()
        return told(out)

    return run, schema


NODE = "id long, n long, tokens binary, same string, hashes array<long>, central double"


def prefix_length(n: int) -> int:
    """A set of n shingles and any that links with it share one of so many first ones in a common order."""
    return n - -(-PERCENT * n // 100) + 1


def _gather(key, rows):
    """One part of the documents -> a row each: size of the set, and for those that may link their shared shingles."""
    ids, counts, shared, tokens, df = _arrays(rows, ("ids", "<i8"), ("counts", "<u4"), ("shared", "<u4"), ("tokens", "<u8"), ("df", "<u2"))
    names, at = np.unique(ids, return_inverse=True)
    n, k = np.bincount(at, counts).astype(np.int64), np.bincount(at, shared).astype(np.int64)
    able = 100 * k >= PERCENT * n
    owner = np.repeat(at, shared)
    keep = able[owner]
    owner, tokens, df = owner[keep], tokens[keep], df[keep]
    order = np.lexsort((tokens, df, owner))
    owner, tokens, df = owner[order], tokens[order], df[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(names)))
    out = []
    for d, name in enumerate(names.tolist()):
        if not able[d]:
            out.append((name, int(n[d]), None, None, None, None))
            continue
        a, b = ends[d - 1] if d else 0, ends[d]
        t = tokens[a:b]
        same = hashlib.blake2b(np.sort(t).tobytes(), digest_size=16).hexdigest() if k[d] == n[d] else None
        hashes = [int(_mixed(t ^ np.uint64(s * 0x51ED2701)).min().view(np.int64)) for s in range(1, HASHES + 1)]
        out.append((name, int(n[d]), t.tobytes(), same, hashes, float(np.log(df[a:b]).mean())))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])


class _Index:
    """Members of a block by shingle: which members a query overlaps, and by how much."""

    def __init__(self, sets: list[np.ndarray]):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.n = tokens[order], owner[order], len(sets)

    def overlaps(self, query: np.ndarray, least: int) -> np.ndarray | None:
        """Shared shingles with each member; None if the union of all members has fewer than ``least`` of the query's."""
        a, b = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        hit = b > a
        if hit.sum() < least:
            return None
        a, size = a[hit], (b - a)[hit]
        at = np.arange(size.sum()) + np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size)
        return np.bincount(self.owner[at], minlength=self.n)


def _linked(i: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return 100 * i >= PERCENT * (n + sizes - i)


def _least(n: int) -> int:
    return -(-PERCENT * n // 100)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _inside(key, rows):
    """All links inside one block, as an edge from each member to the first of its component, and its row of the matrix."""
    ids, sizes, sets = rows.column("id").to_numpy(), rows.column("n").to_numpy(), _sets(rows.column("tokens"))
    index, groups = _Index(sets), Sets(len(sets))
    for k in np.lexsort((ids, -rows.column("central").to_numpy())):
        i = index.overlaps(sets[k], _least(sizes[k]))
        for m in np.flatnonzero(_linked(i, sizes[k], sizes)) if i is not None else ():
            groups.union(int(k), int(m))
    root = ids[[groups.find(k) for k in range(len(sets))]]
    union = index.tokens[np.r_[True, index.tokens[1:] != index.tokens[:-1]][: len(index.tokens)]]
    return pa.table({"block": [key[0].as_py()], "a": [ids.tolist()], "b": [root.tolist()], "least": [int(sizes.min())], "tokens": pa.array([union.astype("<u8").tobytes()], pa.binary())})


def _bound(key, blocks, queries):
    """Queries whose overlap with a block's union is enough for a link with one of its members."""
    ids, names = [], []
    if len(blocks) and len(queries):
        union, least = np.frombuffer(blocks.column("tokens")[0].as_py(), "<u8"), blocks.column("least")[0].as_py()
        for i, n, tokens in zip(queries.column("id").to_pylist(), queries.column("n").to_pylist(), _sets(queries.column("tokens")), strict=True):
            shared = int((union[np.searchsorted(union, tokens).clip(0, len(union) - 1)] == tokens).sum())
            if shared >= max(_least(n), -(-PERCENT * (n + least) // (100 + PERCENT))):
                ids.append(i)
                names.append(key[0].as_py())
    return pa.table({"id": pa.array(ids, pa.int64()), "block": pa.array(names, pa.int64())})


def _open(key, members, queries):
    """Queries against one block: links to members of other components, one edge for each component reached."""
    a, b = [], []
    if len(members) and len(queries):
        sizes, comps, index = members.column("n").to_numpy(), members.column("component").to_numpy(), _Index(_sets(members.column("tokens")))
        for n, own, tokens in zip(queries.column("n").to_pylist(), queries.column("component").to_pylist(), _sets(queries.column("tokens")), strict=True):
            i = index.overlaps(tokens, _least(n))
            if i is not None:
                found = np.unique(comps[_linked(i, n, sizes) & (comps != own)]).tolist()
                a += [own] * len(found)
                b += found
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _prefixes(batches):
    """(block, id, ...) with shared shingles in order -> the shared ones of the prefix, exploded later."""
    for batch in batches:
        names = batch.schema.names
        n, shared = batch.column("n").to_pylist(), [np.frombuffer(x, "<i8") for x in batch.column("tokens").to_pylist()]
        heads = [s[: max(0, prefix_length(m) - (m - len(s)))] for m, s in zip(n, shared, strict=True)]
        ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names) - 2)] + [lists], names=[*names[:-2], "head"])


def _nodes(docs: DataFrame, n: int, size: int) -> DataFrame:
    buckets = max(48, min(BUCKETS, size // BUCKET_BYTES), size // LARGE_BUCKET)
    run, schema = _deal(buckets, _frequent(docs, n))
    dealt = docs.mapInArrow(run, schema)
    run, schema = _count(buckets)
    counted = dealt.groupBy("bucket").applyInArrow(run, schema)
    return saved(counted.groupBy("part").applyInArrow(_gather, NODE))


def _blocks(able: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, n, block, centre) for each document that stands for its set."""
    keys = able.select("id", "n", "central", "hashes").join(small(reps), "id", "left_semi").select("id", "n", "central", F.posexplode("hashes").alias("k", "hash"))
    keys = saved(keys)
    sizes = keys.groupBy("k", "hash").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.max(F.struct("central", (-F.col("id")).alias("id"))).alias("c"))
    sizes = saved(sizes.where("m > 1").select(F.col("k").alias("gk"), F.col("hash").alias("gh"), "m", "all", (-F.col("c.id")).alias("centre")))
    best = keys.join(small(sizes), (F.col("k") == F.col("gk")) & (F.col("hash") == F.col("gh"))).groupBy("id", "n").agg(F.max(F.struct("m", "all", "gk", "gh", "centre")).alias("g"))
    parts = F.ceil(F.greatest(F.col("g.m") / BLOCK, F.col("g.all") / BLOCK_TOKENS))
    # Parts of a large group are cut by size too, as sets that link are of similar size.
    share = F.when(parts > 1, F.xxhash64(F.pmod(F.xxhash64("id"), parts), F.floor(F.log("n") / math.log(1.25)))).otherwise(0)
    groups = best.select("id", "n", F.xxhash64("g.gk", "g.gh", share).alias("block"), F.col("g.centre").alias("centre"))
    alone = able.select("id", "n").join(small(reps), "id", "left_semi").join(best.select("id"), "id", "left_anti").select("id", "n", F.xxhash64("id").alias("block"), F.col("id").alias("centre"))
    out = saved(groups.unionByName(alone))
    release(keys, sizes)
    return out


def _candidates(able: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, component, block): blocks that share a prefix shingle with a document, hold sets of fitting size and a component that
    comes after the document's own: the smaller component asks."""
    tops = saved(placed.groupBy("block").agg(F.max("rank").alias("top"), F.min("n").alias("least"), F.max("n").alias("most")))
    mine = saved(placed.select("id", "block", "rank"))
    heads = able.select("id", "n", "tokens").join(small(mine), "id").select("id", "block", "rank", "n", F.col("n").alias("size"), "tokens")
    heads = heads.select("id", "block", "rank", "size", "n", "tokens").mapInArrow(_prefixes, "id long, block long, rank struct<members:long,component:long>, size long, head array<long>")
    heads = saved(heads)
    matrix = heads.select(F.explode("head").alias("token"), "block").distinct().join(small(tops), "block")
    several = saved(matrix.groupBy("token").agg(F.count("*").alias("blocks"), F.max("top").alias("greatest")).where("blocks > 1").select(F.col("token").alias("t_"), "greatest"))
    asks = heads.select(F.explode("head").alias("token"), "id", "rank", "size")
    asks = asks.join(small(several), (F.col("token") == F.col("t_")) & (F.col("rank") < F.col("greatest"))).select("token", "id", "rank", "size")
    fits = (100 * F.col("most") >= PERCENT * F.col("size")) & (PERCENT * F.col("least") <= 100 * F.col("size"))
    opened = asks.join(matrix, "token").where((F.col("rank") < F.col("top")) & fits).select("id", F.col("rank.component").alias("component"), "block").distinct()
    out = saved(opened)
    release(tops, mine, heads, several)
    return out


def _salted(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with a salt that keeps those of a task few, and how many salts each block has."""
    load = saved(opened.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")))
    return saved(opened.join(small(load), "block").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")), load


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each distinct id of ``docs``.

    Defined results: null or empty texts have no shingles and link with nothing; of rows that share an id the longest text
    counts (then the greatest); rows with a null id are left out; texts of any length count whole; an empty table gives an
    empty table; other columns are not read, whatever their names.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    ids = saved(narrow.groupBy("id").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")))
    count, most, size = ids.agg(F.count("*"), F.max("rows"), F.sum("bytes")).first()
    if (most or 0) > 1:
        narrow = narrow.groupBy("id").agg(F.max(F.struct(F.length("text").alias("k"), "text"))["text"].alias("text"))
    nodes = _nodes(narrow, count, size or 0)
    able = nodes.where("tokens IS NOT NULL")
    firsts = saved(able.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("first")))
    named = saved(able.select("id", "same").join(small(firsts), "same", "left").select("id", F.coalesce("first", "id").alias("rep")))
    reps = saved(named.where("id = rep").select("id"))
    groups = _blocks(able, reps)

    # Links inside the blocks, and the matrix.
    sets = able.select("id", "n", "tokens", "central")
    seats = groups.select("block", "id").union(groups.where("id <> centre").select("block", F.col("centre").alias("id"))).distinct()
    shared_blocks = saved(seats.groupBy("block").agg(F.count("*").alias("seats")).where("seats > 1").select("block"))
    seats = saved(seats.join(small(shared_blocks), "block", "left_semi"))
    inside = sets.join(small(seats), "id")
    matrix = saved(inside.groupBy("block").applyInArrow(_inside, "block long, a array<long>, b array<long>, least long, tokens binary"))
    edges = matrix.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")
    comps = components(edges)
    placed = groups.join(comps, F.col("id") == F.col("node"), "left").select("id", "n", "block", F.coalesce("component", "id").alias("component"))
    weight = saved(placed.groupBy("component").agg(F.count("*").alias("members")))
    placed = saved(placed.join(small(weight), "component").select("id", "n", "block", F.struct("members", "component").alias("rank")))

    # Blocks of one member are bounded by that member's own set, which opening them compares anyway.
    opened = _candidates(able, placed)
    several = opened.join(small(shared_blocks), "block", "left_semi")
    asked, load = _salted(several)
    fresh = lambda: able.select("id", F.col("n").alias("n"), F.col("tokens").alias("tokens"))  # noqa: E731  columns of its own for each side
    queries = fresh().join(small(asked.select("id", "block", "salt")), "id").select(*[F.col(c).alias(c) for c in ("block", "salt", "id", "n", "tokens")])
    rows = matrix.select("block", "least", "tokens").join(small(load), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "least", "tokens")
    enough = saved(rows.groupBy("block", "salt").cogroup(queries.groupBy("block", "salt")).applyInArrow(_bound, "id long, block long"))
    kept = opened.join(small(enough), ["id", "block"], "left_semi").unionByName(opened.join(small(shared_blocks), "block", "left_anti"))
    asking, salts = _salted(kept.select("id", "component", "block"))
    queries = fresh().join(small(asking), "id").select(*[F.col(c).alias(c) for c in ("block", "salt", "component", "n", "tokens")])
    members = placed.join(small(salts), "block").select("id", F.col("rank.component").alias("component"), "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = saved(members)
    bridges = fresh().join(small(members), "id").select(*[F.col(c).alias(c) for c in ("block", "salt", "component", "n", "tokens")])
    bridges = saved(bridges.groupBy("block", "salt").cogroup(queries.groupBy("block", "salt")).applyInArrow(_open, "a long, b long").distinct())
    final = components(bridges)

    merged = saved(placed.select(F.col("id").alias("r"), F.col("rank.component").alias("c")).join(final, F.col("c") == F.col("node"), "left").select("r", F.coalesce("component", "c").alias("name")))
    lowest = saved(named.join(small(merged), F.col("rep") == F.col("r")).groupBy("name").agg(F.min("id").alias("component_id")).select(F.col("name").alias("l_"), "component_id"))
    told = merged.join(small(lowest), F.col("name") == F.col("l_")).select("r", "component_id")
    linked = saved(named.join(told, F.col("rep") == F.col("r")).select(F.col("id").alias("i"), "component_id"))
    release(firsts, named, reps, groups, shared_blocks, seats, matrix, weight, placed, opened, asked, load, enough, asking, salts, members, bridges, merged, lowest)
    out = ids.select("id").join(nodes.select(F.col("id").alias("j"), "n"), F.col("id") == F.col("j"), "left").join(linked, F.col("id") == F.col("i"), "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without documents that link to one of smaller id: of each component the smallest id stays.

    Defined results: rows of a null id stay; rows that share an id stay or go together; null and empty texts stay; ties do not
    occur, as ids of a component differ; an empty table stays empty; other columns are carried along, but for ``__gone``,
    which is reserved.
    """
    gone = link_documents(docs, id_col, text_col).where("component_id <> id").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")
