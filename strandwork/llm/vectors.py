"""Near-duplicate vectors through randomised-rotation binary codes.

Vectors of one label are linked when their cosine reaches a threshold. First, vectors whose codes share
their leading bits are gathered into groups so narrow that all members are linked with each other. A group
goes by its centre, a size and a radius, so that a crowd of copies becomes a few groups. Most groups have a
single member.

Centres meet in cells, which are leading bits of codes under further rotations, in as many tables as the
wanted recall takes. In a cell one side is its binary code with a correction factor, the other the rotated
vector in four bits a component. Their product over the factor is an unbiased estimate of the inner
product, and the factor gives its error. Pairs whose upper confidence bound misses the threshold are done;
the others are computed anew from the vectors. The angle and the two radii then say that all members of two
groups are linked, or none, or (a pair that straddles the threshold) that members have to be compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.store import written
from strandwork.operators.graph import connected_components

#: Rows of one key that are gathered at a time.
GATHERED = 1 << 16
#: Angle beyond the threshold for which tables are planned: centres may lie that much further apart than members.
SLACK = math.radians(4.0)
#: Standard deviations of the estimate up to which a pair is recomputed.
CONFIDENCE = 4.0
#: Chance to miss a pair at the threshold, and groups of a label in one cell, on average.
MISSED, CELL = 0.002, 32
_SURE = 1e-9
_BLOCK = 1024


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation of ``dim`` dimensions; equal numbers give equal rotations."""
    q, r = np.linalg.qr(np.random.default_rng([20240611, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(rows: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows, exact for small ones too."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(axis=-1)) / 2))


def _leading(signs: np.ndarray, bits: int) -> np.ndarray:
    return signs[:, :bits].astype(np.int64) @ (1 << np.arange(min(bits, signs.shape[1]), dtype=np.int64))


def _usable(vectors: DataFrame, id: str, vector: str, label: str) -> tuple[DataFrame, str]:
    """``(row, id, label, dim, vec, key)`` of all rows; ``key`` is NULL for those that link with nothing."""
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    types = [vectors.schema[c].dataType.simpleString() for c in (id, label)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            dims, data, keys = [None] * n, [None] * n, [None] * n
            by_dim: dict[int, list[int]] = {}
            labels = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for i, cell in enumerate(batch.column(1)):
                if not labels[i] or not cell.is_valid or cell.values.null_count or not len(cell.values):
                    continue
                x = cell.values.to_numpy()
                if np.isfinite(x).all() and x.any():
                    dims[i], data[i] = len(x), (x + 0.0).astype(kind).tobytes()
                    by_dim.setdefault(len(x), []).append(i)
            for dim, at in by_dim.items():
                signs = units([data[i] for i in at], kind) @ rotation(dim, 0).T > 0
                for i, key in zip(at, _leading(signs, 62).tolist(), strict=True):
                    keys[i] = key
            columns = [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(2)]
            columns += [pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(keys, pa.int64())]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "dim", "vec", "key"])

    schema = f"row bigint, id {types[0]}, label {types[1]}, dim int, vec binary, key bigint"
    return vectors.select(id, vector, label).mapInArrow(kernel, schema), kind


def narrow_groups(x: np.ndarray, widest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(group of each row, first row, centre, radius of each group)`` for unit vectors.

    A row joins the first group whose first row is within ``widest`` of it. The centre is the mean of the
    members unless the first row serves better; no radius exceeds ``widest``.
    """
    mine, heads, centres, radii = np.full(len(x), -1), [], [], []
    while (mine < 0).any():
        free = np.flatnonzero(mine < 0)
        angles = _angles(x[free], x[free[0]])
        angles[0] = 0.0
        members, angles = free[angles <= widest], angles[angles <= widest]
        mine[members] = len(heads)
        centre, radius = x[free[0]], float(angles.max())
        if radius > 0:
            mean = x[members].mean(axis=0).astype(np.float32).astype(np.float64)
            mean /= np.sqrt((mean * mean).sum())
            around = float(_angles(x[members], mean).max())
            if around < radius:
                centre, radius = mean, around
        heads.append(free[0])
        centres.append(centre)
        radii.append(radius)
    return mine, np.array(heads), np.array(centres), np.array(radii)


def _gathered(rows: DataFrame, kind: str, widest: float) -> DataFrame:
    """Members ``(leader, row, id, vec)`` and, with a ``size``, groups ``(leader, vec, size, radius, least)``.

    ``leader`` is the number of a group's first row. The vector of a member is NULL if it is the group's.
    Vectors are dealt by ranges of key, label and row: a key with a third of all rows lies in several tasks,
    each of which makes groups of its own, of at most ``GATHERED`` rows at a time.
    """
    n = rows.filter("key IS NOT NULL").count()
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = min(62, max(14, (n // CELL).bit_length()))
    home = F.xxhash64("label", "dim", F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    order = ["home", "label", "row"]
    own = rows.filter("key IS NOT NULL").withColumn("home", home).drop("key")
    own = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("home", "label", "dim")), strict=True))
            i = 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if held and (keys[i] != at or size >= GATHERED):
                    yield from gathered(held)
                    held, size = [], 0
                at = keys[i]
                held.append(batch.slice(i, j - i))
                size += j - i
                i = j
        if held:
            yield from gathered(held)

    def gathered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        vecs, ids = table["vec"].to_pylist(), table["id"].to_pylist()
        mine, first, centres, radii = narrow_groups(units(vecs, kind), widest)
        size = np.bincount(mine)
        leader = table["row"].to_numpy()[first]
        least: list = [None] * len(first)
        for k, id in zip(mine.tolist(), ids, strict=True):
            if id is not None and (least[k] is None or id < least[k]):
                least[k] = id
        # A group without extent keeps the very vector of its members.
        middle = [vecs[f] if r == 0 else c.astype(kind).tobytes() for f, c, r in zip(first, centres, radii, strict=True)]
        vecs = [None if radii[k] == 0 else v for k, v in zip(mine.tolist(), vecs, strict=True)]
        yield shaped(table, leader=leader[mine], row=table["row"], id=table["id"], vec=vecs)
        yield shaped(table, leader=leader, vec=middle, size=size, radius=radii + (radii > 0) * 1e-6, least=least)

    def shaped(table: pa.Table, **have) -> pa.RecordBatch:
        id, label = (table.schema.field(c).type for c in ("id", "label"))
        n = len(have["leader"])
        have |= {"label": [table["label"][0].as_py()] * n, "dim": [table["dim"][0].as_py()] * n}
        kinds = {"leader": pa.int64(), "row": pa.int64(), "id": id, "label": label, "dim": pa.int32(), "vec": pa.binary(),
                 "size": pa.int64(), "radius": pa.float64(), "least": id}
        arrays = []
        for name, to in kinds.items():
            values = have.get(name)
            if isinstance(values, pa.ChunkedArray):
                values = values.combine_chunks()
            arrays.append(pa.nulls(n, to) if values is None else values if isinstance(values, pa.Array) else pa.array(values, to))
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    id, label = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"leader bigint, row bigint, id {id}, label {label}, dim int, vec binary, size bigint, radius double, least {id}"
    return written(own.mapInArrow(kernel, schema), "vectors-gathered")


def table_plan(most: int, angle: float) -> tuple[int, int]:
    """Bits of a cell and number of tables, so that a pair at ``angle`` shares some cell with the wanted chance."""
    bits = max(6, (most // CELL).bit_length())
    met = (1 - angle / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - met))


def _cells(groups: DataFrame, kind: str, bits: int, tables: int) -> DataFrame:
    """``(cell, leader, radius, dim, code, factor, fine, low, step)``: every group once for each table."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = units(part.column("vec").to_pylist(), kind)
                turned = x @ rotation(dim, 0).T
                factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)  # of the vector and its code
                low = turned.min(axis=1)
                step = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
                dither = np.random.default_rng([7, dim]).random(dim)  # unbiased rounding
                fine = np.floor((turned - low[:, None]) / step[:, None] + dither).clip(0, 15).astype(np.uint8)
                fine = np.pad(fine, ((0, 0), (0, dim % 2)))
                fine = fine[:, ::2] | fine[:, 1::2] << 4
                code = np.packbits(turned > 0, axis=1)
                rows = [part.column(c) for c in ("leader", "radius", "label", "dim")]
                rows += [pa.array([r.tobytes() for r in code], pa.binary()), pa.array(factor.astype(np.float32))]
                rows += [pa.array([r.tobytes() for r in fine], pa.binary()), pa.array(low.astype(np.float32))]
                rows += [pa.array(step.astype(np.float32))]
                each = max(1, dim // bits)  # tables of one rotation
                for t in range(tables):
                    k, s = divmod(t, each)
                    if s == 0:
                        signs = x @ rotation(dim, k + 1).T > 0
                    value = _leading(signs[:, s * bits :], bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array(value), *rows],
                        names=["slot", "value", "leader", "radius", "label", "dim", "code", "factor", "fine", "low", "step"],
                    )

    label = groups.schema["label"].dataType.simpleString()
    schema = f"slot int, value bigint, leader bigint, radius double, label {label}, dim int, code binary, factor float, "
    rows = groups.select("leader", "radius", "label", "dim", "vec").mapInArrow(kernel, schema + "fine binary, low float, step float")
    return rows.withColumn("cell", F.xxhash64("slot", "value", "label", "dim")).drop("slot", "value", "label")


def _proposed(cells: DataFrame, angle: float) -> DataFrame:
    """``(a, b)``: pairs of groups of a cell whose centres may lie within ``angle`` and both radii."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if cells[i] != at and held:
                        yield from met(held)
                        held = []
                    at = cells[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield from met(held)

    def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(h.num_rows for h in held)
        if n < 2:
            return
        table = pa.Table.from_batches(held)
        leader, radius, dims = (table[c].to_numpy() for c in ("leader", "radius", "dim"))
        dim = int(dims[0])
        if (dims != dim).any():
            raise ValueError("two cells share a checksum")
        factor, low, step = (table[c].to_numpy().astype(np.float64) for c in ("factor", "low", "step"))
        code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(n, -1)
        fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint8).reshape(n, -1)
        error = np.sqrt(np.maximum(0, 1 - factor**2) / max(1, dim - 1)) / factor

        def block(i: int):
            j = slice(i, i + _BLOCK)
            signs = np.unpackbits(code[j], axis=1, count=dim) * np.float32(2) - 1
            parts = np.stack([fine[j] & 15, fine[j] >> 4], axis=2).reshape(len(code[j]), -1)[:, :dim]
            return j, signs, (low[j, None] + step[j, None] * parts).astype(np.float32)

        for i in range(0, n, _BLOCK):
            one, signs, turned = block(i)
            for k in range(i, n, _BLOCK):
                two, other_signs, other = (one, signs, turned) if k == i else block(k)
                limit = np.cos(np.minimum(math.pi, angle + radius[one, None] + radius[None, two]))
                possible = np.ones(limit.shape, bool)
                for products, own, rounding in (
                    (signs @ other.T, (factor[one, None], error[one, None]), step[None, two]),
                    (turned @ other_signs.T, (factor[None, two], error[None, two]), step[one, None]),
                ):
                    estimate = products / (math.sqrt(dim) * own[0])
                    possible &= estimate + CONFIDENCE * np.sqrt(own[1] ** 2 + (rounding / (2 * own[0])) ** 2) >= limit
                x, y = np.nonzero(possible)
                a, b = leader[one][x], leader[two][y]
                new = a != b if k > i else x < y
                a, b = a[new], b[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    own = cells.repartition("cell").sortWithinPartitions("cell")
    return own.mapInArrow(kernel, "a bigint, b bigint").distinct()


def _compared(pairs: DataFrame, kind: str) -> DataFrame:
    """``pairs`` with ``cosine`` and ``angle`` of the vectors ``u`` and ``v``, which are left out."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            cosine, angle = np.empty(len(u)), np.empty(len(u))
            sizes = np.array([len(x) for x in u], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, y = units([u[i] for i in at], kind), units([v[i] for i in at], kind)
                cosine[at], angle[at] = (x * y).sum(axis=1), _angles(x, y)
            out = batch.drop_columns(["u", "v"])
            yield out.append_column("cosine", pa.array(cosine)).append_column("angle", pa.array(angle))

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("u", "v"))
    return pairs.mapInArrow(kernel, f"{rest}, cosine double, angle double")


def near_duplicates(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows of equal label are linked when the cosine of their vectors is at least ``threshold``; ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id reachable and ``kept`` says
    whether that is the row's own. Rows with a NULL label, or a vector that is NULL, empty, zero or holds a
    NULL or non-finite component, link with nothing; vectors of different length do not link. Repeated rows
    and equal ids are rows of their own, linked like any other; a NULL id counts for no ``component_id``
    unless there is no other. Other columns are not read. An empty table gives an empty result.

    Links are exact; a pair at the threshold is found with a chance of 99 % or more, closer ones almost
    surely. Only pairs of groups that straddle the threshold are compared member by member.
    """
    coded, kind = _usable(vectors, id, vector, label)
    rows = written(coded, "vectors-rows")
    limit = math.acos(threshold)
    gathered = _gathered(rows, kind, limit / 2 - 1e-6)
    groups, members = gathered.filter("size IS NOT NULL"), gathered.filter("size IS NULL")
    most = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    pairs = written(_proposed(_cells(groups, kind, *table_plan(most, limit + SLACK)), limit), "vectors-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    needed = written(groups.join(met, "leader", "left_semi"), "vectors-needed")

    def side(df: DataFrame, key: str, vec: str) -> DataFrame:
        return df.select(
            F.col("leader").alias(key), F.col("vec").alias(vec), *[F.col(c).alias(f"{c}_{key}") for c in ("size", "radius", "label")]
        )

    both = pairs.join(side(needed, "a", "u"), "a").join(side(needed, "b", "v"), "b").filter("label_a = label_b")
    reach = F.col("radius_a") + F.col("radius_b")
    linked = F.when(reach == 0, F.when(F.col("cosine") >= threshold, "all")).when(
        F.col("angle") + reach <= limit - _SURE, "all"
    )
    linked = linked.when((reach > 0) & (F.col("angle") - reach <= limit + _SURE), "some")
    judged = _compared(both.drop("label_a", "label_b"), kind).withColumn("linked", linked)
    judged = written(judged.filter("linked IS NOT NULL").select("a", "b", "size_a", "size_b", "linked"), "vectors-judged")

    # Member by member, where two groups straddle the threshold.
    heads = needed.select("leader", F.col("vec").alias("head"))
    some = judged.filter("linked = 'some'").select("a", "b")
    ends = some.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    open_members = members.join(ends, "leader", "left_semi").join(heads, "leader")
    open_members = open_members.select("leader", "row", F.coalesce("vec", "head").alias("vec"))
    left = open_members.select(F.col("leader").alias("a"), F.col("row").alias("x"), F.col("vec").alias("u"))
    right = open_members.select(F.col("leader").alias("b"), F.col("row").alias("y"), F.col("vec").alias("v"))
    single = _compared(some.join(left, "a").join(right, "b"), kind).filter(F.col("cosine") >= threshold)
    single = written(single.select("a", "b", "x", "y"), "vectors-single")

    whole = judged.filter("linked = 'all'")
    edges = whole.select("a", "b").unionByName(single.select("a", "b"))
    parts = connected_components(edges)
    groups = groups.select("leader", "size", "least")
    by_part = parts.join(groups.select(F.col("leader").alias("id"), "least"), "id")
    smallest = by_part.groupBy("component").agg(F.min("least").alias("smallest"))
    smallest = parts.join(smallest, "component").select(F.col("id").alias("leader"), "smallest")
    sums = whole.select("a", F.col("size_b").alias("n")).unionByName(whole.select(F.col("b").alias("a"), F.col("size_a").alias("n")))
    sums = sums.groupBy("a").agg(F.sum("n").alias("around")).withColumnRenamed("a", "leader")
    info = groups.join(smallest, "leader", "left").join(sums, "leader", "left")
    info = info.select(
        "leader", F.coalesce("smallest", "least").alias("component"), (F.col("size") - 1 + F.coalesce("around", F.lit(0))).alias("n")
    )
    more = single.select("x").unionByName(single.select(F.col("y").alias("x"))).groupBy("x").agg(F.count("*").alias("more"))
    own = members.select("leader", "row", "id").join(info, "leader").join(more, F.col("row") == F.col("x"), "left")
    own = own.select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("key IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = own.unionByName(alone)
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
