"""Approximate nearest neighbours: an inverted file whose probed lists are read by adaptive dimension scans.

Vectors are rotated at random, so that partial distances over the first d of D dimensions estimate whole ones.
Within a list they lie in column blocks. A query adds up one block after another; after each, a hypothesis test
abandons every candidate whose partial distance, scaled to D dimensions, exceeds the k-th best distance so far by more
than chance explains: sqrt(D / d) * partial > (1 + epsilon / sqrt(d)) * best. Where the first block abandons too few to
be worth picking the others, the rest of the dimensions is added up for all. What survives all blocks gets its exact
distance, in double precision from the vectors as they came. Lists are the cells of k-means over a sample of FIT_ROWS vectors, chosen by a hash of the id; every vector is in
the list of its nearest centre. Queries are all vectors, or those whose id is divisible by `every`; each probes the nearest lists.

Lists are gathered in groups of about GROUP_BYTES of vectors, at least as many as there are shuffle partitions; a query travels
once to each group with a list that it probes, not once a list, and its best distance so far is carried from list to list
within the group. Sums of a round of k-means are added up by list on the executors; the driver gets the centres.

Defined results
- Ids that can't be read as whole numbers count as missing; rows without an id have no neighbours and are none.
- Vectors that are null, hold a null or NaN, or have another length than most have no neighbours and are none.
- A vector isn't its own neighbour; others with equal values are, at distance 0. Ties go to the lower id.
- Rows that repeat an id and its values count once. Fewer than k others give fewer rows; an empty table gives none.
- Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import integer_id, plain

GROUP_BYTES = 64 << 20
#: About as many vectors at most choose the centres.
FIT_ROWS = 1 << 17
#: If a larger share of a list is left after the first block, the other blocks are read at once.
DENSE_SHARE = 1 / 8


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """What _binary packed."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dim)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, which may be a little below 0."""
    out = x @ (-2 * y.T)
    out += (y * y).sum(1)
    out += (x * x).sum(1)[:, None]
    return out


def scan_list(ids, x, query_ids, q, k: int, block: int = 16, epsilon: float = 2.1, best=None, whole=None):
    """(query row, candidate row, squared distance) of up to k nearest of x for each row of q; also the dimensions read.

    best: squared distance of each query beyond which nothing is of use, as far as known.
    whole: x and q before rotation, whose distances count; equal vectors are equal there.
    """
    dim, n = x.shape[1], len(x)
    whole = whole or (x, q)
    ends = np.minimum(np.arange(block, dim + block, block), dim)
    sums = _squares(q[:, : ends[0]], x[:, : ends[0]])
    same = np.flatnonzero(np.isin(query_ids, ids))
    own, at = np.nonzero(query_ids[same, None] == ids)
    sums[same[own], at] = np.inf
    best = np.full(len(q), np.inf) if best is None else best
    rounding = 4e-6 * ((q * q).sum(1) + (x * x).sum(1).max(initial=0)) + 1e-12  # of products in single precision

    def exact(row, at):
        return ((whole[0][at].astype(np.float64) - whole[1][row]) ** 2).sum(1)

    if n > k and len(new := np.flatnonzero(~np.isfinite(best))):  # the k best by the first block give a first bound on the k-th distance
        near = np.argpartition(sums[new], k - 1, axis=1)[:, :k]
        first = exact(np.repeat(new, k), near.ravel()).reshape(-1, k)
        first[~np.isfinite(np.take_along_axis(sums[new], near, 1))] = np.inf
        best = best.copy()
        best[new] = first.max(1)

    def bound(d):
        return ((1 + (epsilon / np.sqrt(d) if d < dim else 1e-5)) ** 2 * best * d / dim + rounding).astype(np.float32)

    j, read, ok = 1, sums.size * int(ends[0]), sums <= bound(ends[0])[:, None]
    if j < len(ends) and np.count_nonzero(ok) > DENSE_SHARE * ok.size:  # products of all pairs take less time than picking so many
        sums += _squares(q[:, ends[0] :], x[:, ends[0] :])
        j, read, ok = len(ends), sums.size * dim, sums <= bound(dim)[:, None]
        if n > k and len(many := np.flatnonzero(np.count_nonzero(ok, axis=1) > 2 * k)):
            best = best.copy()
            best[many] = np.minimum(best[many], np.partition(sums[many], k - 1, axis=1)[:, k - 1] + rounding[many])
            ok[many] = sums[many] <= bound(dim)[many, None]
    row, at = np.divmod(np.flatnonzero(ok), n)
    some = sums[row, at]
    row, at, some = (v[np.isfinite(some)] for v in (row, at, some))
    for j in range(j, len(ends)):
        a, b = ends[j - 1], ends[j]
        read += len(row) * int(b - a)
        some = some + ((x[at, a:b] - q[row, a:b]) ** 2).sum(1)
        left = some <= bound(b)[row]
        row, at, some = row[left], at[left], some[left]
    far = exact(row, at)
    left = far <= best[row]
    row, at, far = row[left], at[left], far[left]
    order = np.lexsort((ids[at], far, row))
    row, at, far = row[order], at[order], far[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k], far[place < k], read


def search_lists(lists: dict, query_ids, q, probed: list, k: int, block: int, epsilon: float, turn: np.ndarray):
    """(squared distances, ids), k columns a query, inf where fewer were found. lists: number -> (ids, vectors, vectors rotated); probed: numbers by query."""
    d, near = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    turned = (q @ turn).astype(np.float32)
    row = np.repeat(np.arange(len(q)), [len(p) for p in probed])
    number = np.concatenate(probed) if len(probed) else np.zeros(0, int)
    order = np.argsort(number, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(number[order], prepend=-1)), len(order))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, (ids, x, rotated) = row[order[a:b]], lists.get(int(number[order[a]]), (np.zeros(0, np.int64), None, None))
        step = max(1, (1 << 20) // max(len(ids), 1))
        for s in range(0, len(own) if len(ids) else 0, step):
            some = own[s : s + step]
            i, at, sums, _ = scan_list(ids, rotated, query_ids[some], turned[some], k, block, epsilon, d[some, -1], (x, q[some]))
            if not len(i):
                continue
            found, to = np.unique(i, return_inverse=True)  # the queries for which there is something new
            some, place = some[found], np.arange(len(i)) - np.searchsorted(i, i)
            wide_d, wide_i = np.full((len(some), 2 * k), np.inf), np.full((len(some), 2 * k), np.iinfo(np.int64).max)
            wide_d[:, :k], wide_i[:, :k] = d[some], near[some]
            wide_d[to, k + place], wide_i[to, k + place] = sums, ids[at]
            # rows that repeat an id within or across lists count once
            by = np.lexsort((wide_i, wide_d), axis=1)
            wide_d, wide_i = np.take_along_axis(wide_d, by, 1), np.take_along_axis(wide_i, by, 1)
            again = np.zeros(wide_d.shape, bool)
            again[:, 1:] = (wide_i[:, 1:] == wide_i[:, :-1]) & (wide_d[:, 1:] == wide_d[:, :-1])
            if (again & np.isfinite(wide_d)).any():
                wide_d[again] = np.inf
                by = np.lexsort((wide_i, wide_d), axis=1)
                wide_d, wide_i = np.take_along_axis(wide_d, by, 1), np.take_along_axis(wide_i, by, 1)
            d[some], near[some] = wide_d[:, :k], wide_i[:, :k]
    return d, near


def _distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows that repeat an id and its values."""
    if len(np.unique(ids)) == len(ids):
        return ids, x
    seen = {(i, v.tobytes()): at for at, (i, v) in enumerate(zip(ids.tolist(), x + 0.0))}  # one zero, not two
    kept = list(seen.values())
    return ids[kept], x[kept]


def nearest(vectors: DataFrame, k: int = 10, probe_share: float = 0.6, least_probes: int = 24, lists: int | None = None, rounds: int = 3, block: int = 16, epsilon: float = 2.1, seed: int = 7, every: int = 1) -> DataFrame:
    """vec_id, neighbour_id, rank (from 1) and distance (Euclidean) of the k nearest to every vector, or to every one whose id is divisible by `every`.

    lists: number of k-means cells; twice the square root of the number of vectors if not given.
    probe_share: share of the lists that each query probes, at least least_probes of them. Vectors with little cluster structure need more than half of
    them for a recall of 0.9; well separated ones far fewer.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    table, _, (vec_id, embedding) = plain(vectors, ("vec_id", "embedding"))
    some = table.select(integer_id(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"))
    some = some.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    common = some.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    dim, n = common["dim"], common["count"]
    some = some.where(F.size("embedding") == dim)
    lists = min(lists or max(1, round(2 * n**0.5)), n)
    turn = rotation(dim, seed)
    seeds = some.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(lists).select("embedding").toArrow()["embedding"]
    centres = np.unique(_matrix(seeds.combine_chunks(), dim), axis=0)
    lists = len(centres)
    probes = min(lists, max(least_probes, round(probe_share * lists)))
    sizes, partitions = np.zeros(lists, np.int64), int(spark.conf.get("spark.sql.shuffle.partitions"))
    fitted = some if n <= FIT_ROWS else some.where(F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(n)) < FIT_ROWS)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)  # 2 sqrt(n) rows

        def sums(batches, shared=shared, dim=dim):
            c = shared.value
            total, count = np.zeros(c.shape, np.float64), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _matrix(batch.column("embedding"), dim)
                for a in range(0, len(x), 4096):
                    own = np.argmin((c * c).sum(1) - 2 * (x[a : a + 4096] @ c.T), 1)
                    by = np.argsort(own, kind="stable")
                    at = np.flatnonzero(np.diff(own[by], prepend=-1))
                    total[own[by[at]]] += np.add.reduceat(x[a : a + 4096][by].astype(np.float64), at)
                    count += np.bincount(own, minlength=len(c))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([t.tobytes() for t in total[some]], pa.binary()), pa.array(count[some])], names=["cell", "total", "n"])

        def add(batches, dim=dim):
            found: dict[int, list] = {}
            for batch in batches:
                for cell, total, n in zip(*(batch.column(c).to_pylist() for c in ("cell", "total", "n"))):
                    own = found.setdefault(cell, [np.zeros(dim), 0])
                    own[0] += np.frombuffer(total)
                    own[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([t.tobytes() for t, _ in found.values()], pa.binary()), pa.array([n for _, n in found.values()], pa.int64())], names=["cell", "total", "n"])

        kind = "cell long, total binary, n long"
        new = fitted.select("embedding").mapInArrow(sums, kind).repartition(partitions, "cell").mapInArrow(add, kind).toArrow()  # a row a list
        at, sizes = np.asarray(new["cell"]), np.zeros(lists, np.int64)
        sizes[at] = np.asarray(new["n"])
        centres = centres.copy()
        centres[at] = np.array([np.frombuffer(t) for t in new["total"].to_pylist()]).reshape(-1, dim) / sizes[at, None]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centres)
    groups = max(1, min(max(partitions, -(-n * dim * 4 // GROUP_BYTES)), lists))
    # lists in groups of about as many members
    group = np.empty(lists, np.int64)
    load = np.zeros(groups)
    for one in np.argsort(-sizes, kind="stable"):
        group[one] = load.argmin()
        load[group[one]] += sizes[one] + 1
    names = ["cell", "query", "vec_id", "x", "probed"]
    step = max(1, min(1024, GROUP_BYTES // (dim * 4 * (groups + 1))))

    def assign(batches):
        c = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                own = batch.slice(a, step)
                ids, x = np.asarray(own.column("vec_id")), _matrix(own.column("embedding"), dim)
                d = (c * c).sum(1) - 2 * (x @ c.T)
                home, asks = d.argmin(1).astype(np.int32), np.flatnonzero(ids % every == 0)
                near = np.argpartition(d[asks], probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(asks), 1))
                flat = np.sort(near, axis=1).ravel().astype(np.int32)
                asked = np.repeat(asks, near.shape[1])
                by = np.lexsort((flat, group[flat], asked))
                flat, key = flat[by], asked[by] * groups + group[flat[by]]
                cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
                row = key[cuts[:-1]] // groups
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([group[home], key[cuts[:-1]] % groups]).astype(np.int32)), pa.array(np.repeat([0, 1], [len(x), len(row)]).astype(np.int8)), pa.array(np.concatenate([ids, ids[row]])),
                    _binary(x[np.concatenate([np.arange(len(x)), row])]),
                    pa.array([v.tobytes() for v in home] + [flat[p:q].tobytes() for p, q in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ], names=names)

    def search(batches):
        kept: list = []  # members of the group in hand: they come before its queries
        members: dict | None = None
        cell = None
        for batch in batches:
            cells, kinds, ids = (np.asarray(batch.column(c)) for c in ("cell", "query", "vec_id"))
            if not len(cells):
                continue
            x = _rows(batch.column("x"), dim)
            probed = [np.frombuffer(p, np.int32) for p in batch.column("probed").to_pylist()]
            key = cells.astype(np.int64) * 2 + kinds
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if cells[a] != cell:
                    cell, kept, members = cells[a], [], None
                if kinds[a] == 0:
                    kept.append((np.concatenate(probed[a:b]), ids[a:b], x[a:b]))
                    continue
                if members is None:
                    of, i, v = (np.concatenate(c) for c in zip(*kept)) if kept else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros((0, dim), np.float32))
                    by = np.argsort(of, kind="stable")
                    to = np.append(np.flatnonzero(np.diff(of[by], prepend=-1)), len(by))
                    members = {}
                    for p, q in zip(to[:-1], to[1:]):
                        i_own, v_own = _distinct(i[by[p:q]], v[by[p:q]])
                        members[int(of[by[p]])] = i_own, v_own, (v_own @ turn).astype(np.float32)
                    kept = []
                for s in range(a, b, 2048):
                    e = min(s + 2048, b)
                    d, near = search_lists(members, ids[s:e], x[s:e], probed[s:e], k, block, epsilon, turn)
                    count = np.isfinite(d).sum(1)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                    ok = np.isfinite(d)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.ListArray.from_arrays(offsets, pa.array(d[ok])), pa.ListArray.from_arrays(offsets, pa.array(near[ok]))], names=["vec_id", "d", "ids"])

    found = (
        some.mapInArrow(assign, "cell int, query byte, vec_id long, x binary, probed binary")
        .repartitionById(groups, "cell").sortWithinPartitions("cell", "query")
        .mapInArrow(search, "vec_id long, d array<double>, ids array<long>")
    )
    best = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("d", "ids"))))), 1, k).alias("near"))
    return best.select("vec_id", F.posexplode("near").alias("rank", "m")).select(
        "vec_id", F.col("m.ids").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"), F.round(F.sqrt("m.d"), 6).alias("distance")
    )
