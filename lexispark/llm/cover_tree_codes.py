"""Vector code compression: product codes from Lloyd rounds over partition-local cover trees.

Vectors are cut into parts, and each part position has a codebook of its own. The vectors of a partition are dealt into blocks; for
each block and part position a cover tree is built once and written: nested nets of halving scale from a farthest-first order of
some of the points, each net point a node with the exact radius of its subtree, whose points are a run of the block's order. In a
round a task reads its trees and goes down them level by level: where the nearest entry of a node's centre is nearer by more than
twice the radius than the second, the triangle inequality gives the whole subtree to it, and cumulative sums give what it adds to the
entry; only points of nodes that stay ambiguous are compared one by one. A round sends (part, entry, count, sums), at most a row for
each entry and task; the driver holds the codebooks alone, whose size is fixed by the parameters.

All arithmetic is on integers floor(scale * x), in float64 where every square sum is below 2**53 and in int64 otherwise, so results
don't depend on partitions, blocks or trees.

Defined results: rows whose vector is null or has null or non-finite components go; components beyond +-65,536 count as that, so that
sums stay within 64 bits; a vector shorter than the longest, or than a whole number of parts, is filled with zeros at its end; rows of
one vec_id are several vectors (as seeds they are ordered by their components), null vec_ids come last; fewer vectors than entries
make smaller codebooks; rows with a null label share one label_error; a table without vectors gives an empty result; columns other
than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import BROADCAST_ROWS, discard, written

#: Vectors of a block, and how many of its points may become net points; the others are leaves of the nearest.
BLOCK, NET = 2048, 256
#: Absolute value beyond which a component is cut.
LARGEST = 65_536.0
#: How often totals of a label are repeated where labels are too many to be sent to all.
SALTS = 32


def whole_vectors(vectors: DataFrame, parts: int) -> DataFrame:
    """vec_id, label and v, the components of the rows that count, filled with zeros to a multiple of parts."""
    fine = vectors.where("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = fine.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    most = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-most // parts) * parts
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    return rows.select("vec_id", "label", F.when(F.size("v") < width, filled).otherwise(F.col("v")).alias("v"))


def as_integers(lists: pa.Array, scale: int) -> np.ndarray:
    """A list column of doubles -> int64 rows floor(scale * x)."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(np.clip(flat, -LARGEST, LARGEST) * scale).astype(np.int64).reshape(n, -1 if n and len(flat) else 0)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of y."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if 8 * most * most * max(x.shape[1], 1) < 1 << 53 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


def farthest_first(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Net points in farthest-first order: their rows, their distances to earlier ones when chosen, the distances between net points,
    and for every row the nearest net point."""
    centres, reach, nearest = [0], [np.inf], np.zeros(len(points), np.int64)
    near = squared_distances(points[:1], points)[0]
    rows = [near]
    while len(centres) < NET:
        at = int(near.argmax())
        if near[at] == 0:
            break
        centres.append(at)
        reach.append(float(near[at]) ** 0.5)
        own = squared_distances(points[at : at + 1], points)[0]
        rows.append(own)
        closer = own < near
        nearest[closer] = len(centres) - 1
        near = np.where(closer, own, near)
    centres = np.array(centres)
    return centres, np.array(reach), np.array([r[centres] for r in rows]), nearest


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree of points (integer rows): order: rows so that every subtree is a run; centre: rows of net points; and by node, level
    after level: net (index of its net point), radius, begin and end (its run), level."""
    centres, reach, between, nearest = farthest_first(points)
    top = reach[1] if len(reach) > 1 else 0.0
    level = np.zeros(len(centres), np.int64)
    level[1:] = np.floor(np.log2(top / reach[1:])).astype(np.int64) + 1  # the net of level i holds points chosen at distances above top / 2**i
    depth = int(level.max())
    parent = np.zeros(len(centres), np.int64)
    for k in range(1, len(centres)):
        above = np.flatnonzero(level[:k] < level[k])
        parent[k] = above[between[above, k].argmin()]
    ancestors = np.empty((depth + 1, len(centres)), np.int64)
    ancestors[depth] = np.arange(len(centres))
    for i in range(depth, 0, -1):
        below = ancestors[i]
        ancestors[i - 1] = np.where(level[below] <= i - 1, below, parent[below])
    paths = ancestors[:, nearest]
    order = np.lexsort(paths[::-1])
    nodes = {k: [] for k in ("net", "radius", "begin", "end", "level")}
    for i in range(depth + 1):
        own = paths[i, order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        differences = (points[order] - points[centres[own]]).astype(np.float64)
        away = np.sqrt((differences * differences).sum(axis=1)) * (1 + 1e-12)
        for name, values in (("net", own[begin]), ("radius", np.maximum.reduceat(away, begin)), ("begin", begin), ("end", np.append(begin[1:], len(points))), ("level", np.full(len(begin), i))):
            nodes[name].append(values)
    return {"order": order, "centre": centres} | {k: np.concatenate(v) for k, v in nodes.items()}


TREE = "order array<int>, centre array<int>, net array<int>, radius array<double>, begin array<int>, end array<int>, level array<int>"


def trees_udf(parts: int, scale: int):
    """Batches of vectors -> a row for each block: ids, labels, points and the trees of its part positions."""
    names = [c.split()[0] for c in TREE.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                points = as_integers(batch.column("v"), scale)
                trees = [build_tree(p) for p in np.split(points, parts, axis=1)]
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                kinds = [pa.float64() if n == "radius" else pa.int32() for n in names]
                tree = pa.StructArray.from_arrays([pa.array([t[n] for t in trees], pa.list_(k)) for n, k in zip(names, kinds, strict=True)], names=names)
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("vec_id")),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("label")),
                    one(points.ravel(), pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, parts], pa.int32()), tree),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "points", "trees"])

    return blocks


def assign(points: np.ndarray, tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Nearest entry of every place in a tree's order; the runs (begin, end, entry) that subtrees took whole; and the places compared
    one by one. points: in the tree's order. Of equal entries only the first can be nearest, so the others are left out."""
    own = np.sort(np.unique(book, axis=0, return_index=True)[1])
    book = book[own]
    to_centres = squared_distances(tree["points_of_net"], book)
    nearest = to_centres.argmin(axis=1)
    rest = to_centres.copy()
    first = np.sqrt(np.take_along_axis(rest, nearest[:, None], axis=1)[:, 0].astype(np.float64))
    np.put_along_axis(rest, nearest[:, None], np.iinfo(np.int64).max, axis=1)
    second = np.sqrt(rest.min(axis=1).astype(np.float64))
    net, radius = tree["net"], tree["radius"]
    # strict, and with room for rounding: no point below such a node ties or is nearer to another entry
    clear = (first[net] + 2 * radius < second[net] * (1 - 1e-9)) | (radius == 0) | (len(book) == 1)
    entry = np.full(len(points), -1, np.int64)
    runs = []
    begin, end, level = tree["begin"], tree["end"], tree["level"]
    for i in range(int(level.max()) + 1):
        for k in np.flatnonzero((level == i) & clear & (entry[begin] < 0)).tolist():
            entry[begin[k] : end[k]] = nearest[net[k]]
            runs.append((int(begin[k]), int(end[k]), int(nearest[net[k]])))
    left = np.flatnonzero(entry < 0)
    if len(left):
        entry[left] = squared_distances(points[left], book).argmin(axis=1)
    return own[entry], [(b, e, int(own[x])) for b, e, x in runs], left


def read_block(batch: pa.RecordBatch, k: int, parts: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """Row k of the tree table -> for each part: its number, its points in the tree's order, the tree."""
    points = batch.column("points")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
    trees = batch.column("trees")[k].values
    n = len(batch.column("ids")[k].values)
    for part, values in enumerate(np.split(points.reshape(n, -1), parts, axis=1)):
        tree = {f: trees.field(f)[part].values.to_numpy(zero_copy_only=False) for f in (c.split()[0] for c in TREE.split(", "))}
        tree["points_of_net"] = values[tree["centre"]]
        yield part, values[tree["order"]], tree


def sums_udf(books: np.ndarray):
    """Blocks -> part, entry, n and the sums of components: what the task's points add to the entries that they are nearest to."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                for part, points, tree in read_block(batch, k, parts):
                    entry, runs, left = assign(points, tree, books[part])
                    count[part] += np.bincount(entry, minlength=entries)
                    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points, axis=0)])
                    if runs:
                        begin, end, to = np.array(runs).T
                        np.add.at(total[part], to, running[end] - running[begin])
                    np.add.at(total[part], entry[left], points[left])
        part, entry = np.nonzero(count)
        out = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
        rows = total[part, entry]
        offsets = pa.array(np.arange(len(part) + 1) * width, pa.int32())
        yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["part", "entry", "n", "sums"])

    return sums


def codes_udf(books: np.ndarray):
    """Blocks -> vec_id, label, codes (an entry for each part) and the error of every vector."""
    parts = len(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                code, error = np.empty((len(ids), parts), np.int32), np.zeros(len(ids), np.int64)
                for part, points, tree in read_block(batch, k, parts):
                    entry = assign(points, tree, books[part])[0]
                    difference = points - books[part][entry]
                    code[tree["order"], part] = entry
                    error[tree["order"]] += (difference * difference).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * parts, pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return codes


def seeds(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The first codebooks (part, entry, component): the parts of the vectors of smallest vec_id."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # as many rows as entries
    if not first or not len(first[0][0]):
        return None
    points = np.floor(np.clip(np.array([r[0] for r in first]), -LARGEST, LARGEST) * scale).astype(np.int64)
    return np.stack(np.split(points, parts, axis=1))


def lloyd(trees: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after rounds of assignment and replacement by floors of means; unused entries stay."""
    width = books.shape[2]
    for _ in range(rounds):
        added = trees.mapInArrow(sums_udf(books), "part int, entry int, n bigint, sums array<bigint>")
        added = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        books = books.copy()
        for r in added.collect():  # at most a row for each entry of each codebook
            books[r.part, r.entry] = np.floor_divide(np.array(r.sums, np.int64), r.n)
    return books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over its label. coded is a written table."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    totals = written(totals, "label-errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(totals), same).drop("_label")
    # a label may hold many rows: they are dealt over salts, and its total is repeated for each
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    totals = totals.withColumn("_own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(totals, same & (F.col("_salt") == F.col("_own"))).drop("_label", "_salt", "_own")


def encode_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, embedding, label) -> (vec_id, label, codes array<int>, error; codebooks by part, entry, component)."""
    rows = whole_vectors(vectors, parts)
    books = seeds(rows, parts, entries, scale)
    ids, labels = (f.dataType.simpleString() for f in (rows.schema["vec_id"], rows.schema["label"]))
    if books is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error")), np.zeros((parts, 0, 0), np.int64)
    schema = f"ids array<{ids}>, labels array<{labels}>, points array<int>, trees array<struct<{TREE.replace(' ', ': ').replace(',: ', ', ')}>>"
    trees = written(rows.mapInArrow(trees_udf(parts, scale), schema), "trees")
    books = lloyd(trees, books, rounds)
    coded = written(trees.mapInArrow(codes_udf(books), f"vec_id {ids}, label {labels}, codes array<int>, error bigint"), "codes")
    discard(trees)
    return coded, books


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vectors -> vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    coded, books = encode_vectors(vectors, parts, entries, rounds, scale)
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return with_label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
