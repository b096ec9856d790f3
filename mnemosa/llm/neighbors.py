"""Most similar vectors by an inverted multi-index.

Each group of comparable vectors gets two codebooks, one per vector half; a pair of centroids
is a cell, and every vector lies in exactly one cell. A vector visits the cells nearest to it
by the sum of both half distances, taken in order from a heap. Vectors travel as one byte a
component with a bound on the error; what the bound leaves open is settled from the vectors
themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions.keys import first_per_key, norm_key
from mnemosa.session import broadcast_if_small, materialize, partitions

#: Vectors a cell should hold on average, where all pairs are sought and where some vectors' neighbours are.
CELL, SEARCH_CELL = 1024, 64
#: Rows of a cell, and visitors to it, that meet in one place; larger cells are split into parts that meet pairwise, so nothing is lost.
SPLIT, VISITORS = 4096, 16384
#: The codebooks are fitted on at most this many vectors a group, or 32 a centroid if that is more.
SAMPLE = 8192
#: Cells a vector visits at least when all vectors are compared (its own included), and cells more for each doubling of the centroids.
PROBES, MORE_PROBES = 6, 1.3
#: A search visits so many cells for each centroid of a half: of n vectors it meets about SEARCH_CELL * SEARCH_PROBES * sqrt(n / SEARCH_CELL).
SEARCH_PROBES = 4
#: Candidates for each of the wanted neighbours that are ranked by the vectors themselves, at most.
RERANK = 4


@dataclass
class Codebook:
    halves: list[np.ndarray]

    def probes(self, wanted: int | None, all_visit: bool) -> int:
        if wanted:
            return wanted
        k = len(self.halves[0])
        return max(PROBES, round(MORE_PROBES * np.log2(k))) if all_visit else max(PROBES, SEARCH_PROBES * k)


def usable_vectors(df: DataFrame, field: str, vector: str, model: str, order: str | None = None) -> DataFrame:
    """grp, id, at, vec: one row per row of `df`; grp is null where the vector can't be compared."""
    vec = F.col(vector)
    there = vec.isNotNull() & (F.size(vec) > 0) & F.exists(vec, lambda x: x != 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    group = F.concat_ws("|", F.lit(field), F.size(vec).cast("string"), F.coalesce(norm_key(model), F.lit("")))
    at = F.col(order) if order else F.lit(None).cast("timestamp_ntz")
    return df.select(F.when(there, group).alias("grp"), norm_key("uuid").alias("id"), at.alias("at"), F.when(there, vec.cast("array<float>")).alias("vec")).filter("id IS NOT NULL")


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centers).argmin(1)
        for j in range(k):
            if (mine := near == j).any():
                centers[j] = x[mine].mean(0)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _halves(unit: np.ndarray) -> list[np.ndarray]:
    return [unit[:, 0::2], unit[:, 1::2]]


def _fit_one(cell: int):
    """A group's sample (grp, id, vec, size) to its codebooks (grp, dim, halves)."""

    def run(table: pa.Table) -> pa.Table:
        out = pa.schema([("grp", pa.string()), ("k", pa.int32()), ("halves", pa.binary())])
        grp, size = table["grp"][0].as_py(), table["size"][0].as_py()
        order = np.argsort(np.array(table["id"].to_pylist(), dtype=object), kind="stable")
        vec = table["vec"].combine_chunks().take(pa.array(order))
        x = _unit(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1))
        k = min(max(2, round((size / cell) ** 0.5)), len(x))
        if x.shape[1] < 2 or k < 2:
            return out.empty_table()
        halves = [_kmeans(h, k, seed).astype(np.float32) for seed, h in enumerate(_halves(x))]
        return pa.Table.from_pydict({"grp": [grp], "k": [k], "halves": [b"".join(h.tobytes() for h in halves)]}, schema=out)

    return run


def fit(vectors: DataFrame, cell: int = CELL) -> dict[str, Codebook]:
    """Codebooks of the groups with more than 2 * cell vectors, each fitted by one task from a bounded sample; smaller groups are one cell.

    Only the codebooks come to the driver: of a group of n vectors 4 bytes a component times sqrt(n / cell).
    """
    sizes = vectors.filter("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * cell)
    wanted = F.greatest(F.lit(SAMPLE), 32 * F.ceil(F.sqrt(F.col("size") / cell)))
    known = broadcast_if_small(materialize(sizes.coalesce(1)))
    drawn = vectors.join(known, "grp").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.least(F.lit(1.0), wanted / F.col("size")) * (1 << 20)).select("grp", "id", "vec", "size")
    books = {}
    for r in drawn.groupBy("grp").applyInArrow(_fit_one(cell), "grp string, k int, halves binary").collect():
        flat = np.frombuffer(r.halves, np.float32)
        dim = len(flat) // r.k
        first = r.k * ((dim + 1) // 2)
        books[r.grp] = Codebook([flat[:first].reshape(r.k, -1), flat[first:].reshape(r.k, -1)])
    return books


def _nearest_cells(d0: np.ndarray, d1: np.ndarray, n: int) -> list[list[int]]:
    """The (at most) `n` cells nearest to each row by summed half distance, nearest first, taken from a heap."""
    k0, k1 = d0.shape[1], d1.shape[1]
    near0, near1 = np.argsort(d0, 1)[:, :n], np.argsort(d1, 1)[:, :n]
    sorted0, sorted1 = np.take_along_axis(d0, near0, 1).tolist(), np.take_along_axis(d1, near1, 1).tolist()
    found = []
    for i0, i1, s0, s1 in zip(near0.tolist(), near1.tolist(), sorted0, sorted1):
        heap, cells = [(s0[0] + s1[0], 0, 0)], []
        while heap and len(cells) < n:
            _, a, b = heapq.heappop(heap)
            cells.append(i0[a] * k1 + i1[b])
            if b + 1 < len(s1):
                heapq.heappush(heap, (s0[a] + s1[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(s0):
                heapq.heappush(heap, (s0[a + 1] + s1[0], a + 1, 0))
        found.append(cells)
    return found


_CODED = "grp string, id string, at timestamp_ntz, code binary, err float, cells array<int>"


def _coder(books, probes: int | None, all_visit: bool):
    """Batches of (grp, id, at, vec, asks) to coded rows: one byte a component, and the cells visited, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = books.value
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), dtype=object)
            asks = np.ones(len(grp), bool) if all_visit else np.array(batch.column("asks").to_pylist(), dtype=bool)
            out = {"code": [None] * len(grp), "err": [None] * len(grp), "cells": [None] * len(grp)}
            for g in {x for x in grp if x is not None}:
                at = np.flatnonzero(grp == g)
                rows = batch.column("vec").take(pa.array(at))
                unit = _unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                code = np.rint(unit * (127 / np.abs(unit).max(1, keepdims=True))).astype(np.int8)
                err = np.linalg.norm(_unit(code) - unit, axis=1) + 1e-6
                book = known.get(g)
                cells = [[0]] * len(at)
                if book:
                    far = [_distances(h, c) for h, c in zip(_halves(unit), book.halves)]
                    cells = [[c] for c in (far[0].argmin(1) * far[1].shape[1] + far[1].argmin(1)).tolist()]
                    going = np.flatnonzero(asks[at])
                    for i, near in zip(going.tolist(), _nearest_cells(far[0][going], far[1][going], book.probes(probes, all_visit))):
                        cells[i] = cells[i] + [c for c in near if c != cells[i][0]]
                for i, c, e, near in zip(at.tolist(), code, err.tolist(), cells):
                    out["code"][i], out["err"][i], out["cells"][i] = c.tobytes(), e, near
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("id"), batch.column("at"), pa.array(out["code"], pa.binary()), pa.array(out["err"], pa.float32()), pa.array(out["cells"], pa.list_(pa.int32()))],
                names=["grp", "id", "at", "code", "err", "cells"],
            )

    return run


def _coded(sources: list[tuple[DataFrame, bool]], asks, books, probes: int | None) -> DataFrame:
    """The coded rows of all sources, folded to the latest row of an id where the source asks for that; written, as loads and slots read it. `asks` None: all visit."""
    out = None
    for v, fold in sources:
        part = (v if asks is None else v.withColumn("asks", F.coalesce(asks, F.lit(False)))).mapInArrow(_coder(books, probes, asks is None), _CODED)
        if asks is not None:
            part = part.withColumn("asks", F.coalesce(asks, F.lit(False)))
        part = _state(part) if fold else part
        out = part if out is None else out.unionByName(part)
    return materialize(out.filter("grp IS NOT NULL"))


def _slots(coded: DataFrame, everyone: bool) -> DataFrame:
    """grp, cell, i, j, among, guest, id, code, err: where each row is compared. In a slot guests meet hosts, and where `among` holds hosts meet each other.

    A cell of more than SPLIT rows, or with more than VISITORS visitors, is split: rows into P
    parts and visitors into W. Part i meets part j in slot (i, j) and visitors w in slot
    (i, w), so a slot holds about SPLIT + max(SPLIT, VISITORS) rows however hot the cell is.
    """
    each = coded.select("grp", "id", "code", "err", *([] if everyone else ["asks"]), F.posexplode("cells").alias("pos", "cell"))
    host, guest = F.col("pos") == 0, (F.col("pos") > 0 if everyone else F.col("asks"))
    loads = each.groupBy("grp", "cell").agg(F.count(F.when(host, 1)).alias("h"), F.count(F.when(guest, 1)).alias("g"))
    hot = loads.filter((F.col("h") > SPLIT) | (F.col("g") > VISITORS)).select("grp", "cell", F.ceil(F.col("h") / SPLIT).cast("int").alias("_parts"), F.greatest(F.lit(1), F.ceil(F.col("g") / VISITORS)).cast("int").alias("_wards"))
    hot = materialize(hot.coalesce(1))
    rows = each.join(broadcast_if_small(hot), ["grp", "cell"], "left").withColumns({"_parts": F.coalesce("_parts", F.lit(1)), "_wards": F.coalesce("_wards", F.lit(1))})
    h, one = F.xxhash64("id"), (F.col("_parts") == 1) & (F.col("_wards") == 1)
    rows = rows.withColumns({"_part": F.pmod(h, F.col("_parts")).cast("int"), "_ward": F.pmod(h, F.col("_wards")).cast("int")})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    slot = lambda i, j, among, guest: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(among).alias("among"), guest.alias("guest"))
    no, p, w = F.lit(False), F.col("_part"), F.col("_ward")
    none = F.array().cast("array<struct<i:int,j:int,among:boolean,guest:boolean>>")
    with_parts = F.transform(upto("_parts"), lambda q: F.struct(F.least(p, q).cast("int").alias("i"), F.greatest(p, q).cast("int").alias("j"), (p == q).alias("among"), (p > q).alias("guest")))
    to_guests = F.transform(upto("_wards"), lambda q: slot(p, F.col("_parts") + q, False, no))
    as_host = F.when(one, F.array(slot(F.lit(0), F.lit(0), everyone, no))).otherwise(F.concat(with_parts, to_guests) if everyone else to_guests)
    as_guest = F.when(one, F.array(slot(F.lit(0), F.lit(0), everyone, F.lit(True)))).otherwise(F.transform(upto("_parts"), lambda q: slot(q, F.col("_parts") + w, False, F.lit(True))))
    places = F.concat(F.when(host, as_host).otherwise(none), F.when(guest, as_guest).otherwise(none))
    return rows.select("grp", "cell", "id", "code", "err", F.inline(places))


def _by_slot(slots: DataFrame, kernel, schema: str) -> DataFrame:
    """`kernel` over every slot's rows, hosts first, many slots in one task's pass."""
    keys = ["grp", "cell", "i", "j", "among"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            bounds = _bounds(t)
            guest, err, among = (t[c].to_numpy() for c in ("guest", "err", "among"))
            code = t["code"].combine_chunks()
            at = np.frombuffer(code.buffers()[1], np.int32, len(code) + 1 + code.offset)[code.offset :]
            body = np.frombuffer(code.buffers()[2] or b"", np.int8)
            found = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                n = int(np.count_nonzero(~guest[lo:hi]))
                if n == 0 or hi - lo < 2:
                    continue
                x = body[at[lo] : at[hi]].reshape(hi - lo, -1).astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found += [(lo + a, lo + b, cos, slack) for a, b, cos, slack in kernel(x, err[lo:hi], n, bool(among[lo]))]
            if found:
                a, b, cos, slack = (np.concatenate(c) for c in zip(*found))
                yield from pa.Table.from_arrays([t["grp"].take(pa.array(a)), t["id"].take(pa.array(a)), t["id"].take(pa.array(b)), pa.array(cos.astype(float)), pa.array(slack.astype(float))], names=["grp", "a", "b", "cos", "slack"]).combine_chunks().to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            last = int(_bounds(t)[-2])
            if last:
                yield from work(t.slice(0, last))
            held = t.slice(last)
        if held is not None and len(held):
            yield from work(held)

    n = partitions(slots.sparkSession)
    spread = slots.repartition(n, *keys).sortWithinPartitions(*keys, "guest")
    return spread.select(*keys, "guest", "id", "code", "err").mapInArrow(run, schema)


def _bounds(t: pa.Table) -> np.ndarray:
    """Where slots begin, and the end."""
    new = np.zeros(len(t), bool)
    new[0] = True
    for c in ("grp", "cell", "i", "j", "among"):
        v = t[c].combine_chunks()
        v = v.dictionary_encode().indices if pa.types.is_string(v.type) else v
        v = v.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(t))


def _close(min_cos: float):
    """Pairs of hosts and guests, and of hosts where they meet each other, that may have a cosine of `min_cos`."""

    def kernel(x: np.ndarray, err: np.ndarray, n: int, among: bool):
        for lo in range(0, len(x), 2048):
            if lo < n and not among and lo + 2048 <= n:
                continue
            part = x[lo : lo + 2048]
            sims, slack = part @ x[:n].T, err[lo : lo + 2048, None] + err[None, :n]
            a, b = np.nonzero(sims + slack >= min_cos)
            cos, off = sims[a, b], slack[a, b]
            a = a + lo
            keep = (a >= n) | ((b < a) if among else False)
            yield a[keep], b[keep], cos[keep], off[keep]

    return kernel


def _best(k: int):
    """For each guest the hosts that may be among its `k` best, at most RERANK * k and itself."""

    def kernel(x: np.ndarray, err: np.ndarray, n: int, among: bool):
        most = RERANK * k + 1
        for lo in range(n, len(x), 2048):
            sims, slack = x[lo : lo + 2048] @ x[:n].T, err[lo : lo + 2048, None] + err[None, :n]
            top = np.argpartition(-sims, most - 1, axis=1)[:, :most] if n > most else np.tile(np.arange(n), (len(sims), 1))
            s, o = np.take_along_axis(sims, top, 1), np.take_along_axis(slack, top, 1)
            if top.shape[1] > k + 1:
                kth = -np.partition(-(s - o), k, axis=1)[:, k]
                a, b = np.nonzero(s + o >= kth[:, None])
            else:
                a, b = np.nonzero(np.ones_like(s, bool))
            yield a + lo, top[a, b], s[a, b], o[a, b]

    return kernel


_FOUND = "grp string, a string, b string, cos double, slack double"


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """`pairs` with cos from the vectors themselves."""
    ids = pairs.select("grp", F.explode(F.array("a", "b")).alias("id")).distinct()
    near = vectors.join(broadcast_if_small(ids), ["grp", "id"], "left_semi").select("grp", "id", F.col("vec").cast("array<double>").alias("v"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = near.withColumnsRenamed({"id": "a", "v": "va"}), near.withColumnsRenamed({"id": "b", "v": "vb"})
    joined = pairs.drop("cos").join(a, ["grp", "a"]).join(b, ["grp", "b"])
    return joined.withColumn("cos", dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))).select("grp", "a", "b", "cos")


def _state(coded: DataFrame) -> DataFrame:
    return first_per_key(coded, ["id"], [F.col("at").desc_nulls_last()])


def _latest(sources: list[tuple[DataFrame, bool]], ids: DataFrame) -> DataFrame:
    """The vectors of the records in `ids` (id)."""
    latest = None
    ids = broadcast_if_small(ids.distinct())
    for v, fold in sources:
        v = v.join(ids, "id", "left_semi")
        v = first_per_key(v, ["id"], [F.col("at").desc_nulls_last()]) if fold else v
        latest = v if latest is None else latest.unionByName(v)
    return latest


def _books(sources: list[tuple[DataFrame, bool]], cell: int):
    every = sources[0][0]
    for v, _ in sources[1:]:
        every = every.unionByName(v)
    return every.sparkSession.sparkContext.broadcast(fit(every, cell))


def similar_pairs(sources: list[tuple[DataFrame, bool]], min_cos: float, probes: int | None = None) -> DataFrame:
    """grp, a, b: pairs of different records of a group with cosine of at least `min_cos`, a < b.

    `sources` are outputs of usable_vectors, each with whether its rows are folded to the
    latest row of an id first. Rows are coded before that, so one byte a component is
    shuffled. Every vector is a query and an entry. A pair is missed only if neither vector
    visits the other's cell; tests measure the recall against brute force.
    """
    coded = _coded(sources, None, _books(sources, CELL), probes)
    met = _by_slot(_slots(coded, True), _close(min_cos), _FOUND).filter("a <> b")
    pairs = met.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos", "slack")
    pairs = materialize(pairs.dropDuplicates(["grp", "a", "b"]))
    sure = pairs.filter(F.col("cos") - F.col("slack") >= min_cos).select("grp", "a", "b")
    open_ = pairs.filter(F.col("cos") - F.col("slack") < min_cos)
    if open_.isEmpty():
        return sure
    latest = _latest(sources, open_.select(F.explode(F.array("a", "b")).alias("id")))
    settled = _exact(open_.select("grp", "a", "b", "cos"), latest).filter(F.col("cos") >= min_cos - 1e-9).select("grp", "a", "b").distinct()
    return sure.unionByName(settled)


def nearest(sources: list[tuple[DataFrame, bool]], asks, k: int = 10, probes: int | None = None) -> DataFrame:
    """grp, query, rank_no, neighbor, cos: the `k` most similar vectors of every vector for which `asks` (a column over id) holds.

    All rows are entries. Codes choose the candidates: those that, with what the codes leave
    open, may be among the `k` best, RERANK * k of them at most; cosines and ranks come from
    the vectors themselves. Equal cosines are ranked by id.
    """
    coded = _coded(sources, asks, _books(sources, SEARCH_CELL), probes)
    met = _by_slot(_slots(coded, False), _best(k), _FOUND).filter("a <> b")
    by = Window.partitionBy("grp", "a").orderBy(F.desc("cos"), "b")
    few = met.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= RERANK * k)
    kth = F.min(F.when(F.col("_n") <= k, F.col("cos") - F.col("slack"))).over(Window.partitionBy("grp", "a"))
    few = materialize(few.withColumn("_kth", kth).filter(F.col("cos") + F.col("slack") >= F.col("_kth")).select("grp", "a", "b", "cos"))
    exact = _exact(few, _latest(sources, few.select(F.explode(F.array("a", "b")).alias("id")))).withColumn("cos", F.round("cos", 9))
    return exact.withColumn("rank_no", F.row_number().over(by)).filter(F.col("rank_no") <= k).select("grp", F.col("a").alias("query"), "rank_no", F.col("b").alias("neighbor"), "cos")
