"""N-gram Jaccard self-join: a count-vector R-tree finds the pairs, exact sets verify them.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set is its
distinct 5-word shingles (fewer words: the whole sequence as one; no words: empty). Two
documents link when 100 * |intersection| >= 80 * |union|.

Plan
  1. One pass over the texts: set size, a 64-bit signature of the set and its count vector (shingles
     hashed into 64 to 4096 groups, about 4 to a group, counted; halves add up to the vector with half the
     groups), plus the shingles that are frequent within a task's share.
     Documents with one signature are one class, and only classes go on.
  2. Any linked pair shares one of the first n - ceil(0.8 n) + 1 shingles of both sets in any common
     order. The order puts frequent shingles last. A cell is the classes that share such a shingle.
     Cells decide only which classes can meet, and no pair is lost by them.
  3. Cells with equal members are one. Within a small cell, classes whose count vectors allow a link
     (9 * sum of coordinate minima >= 4 * (n_a + n_b)) are joined by a spanning forest; a frequent
     shingle's cell is joined whole, as a star. The connected pieces are clusters that contain all links.
  4. A cluster is dealt out in blocks; every pair of blocks is a task with both blocks' sets. A task packs
     one block's count vectors into an R-tree (sorted tiles; a box holds the largest coordinates and
     the range of sizes below it), descends it with the other block's points by the bound, and verifies
     surviving pairs on the sets. A task emits a forest of its links and the number of links of each
     set, so that a group of copies never becomes all its pairs.
  5. Components over the verified links of classes; the label is the smallest doc_id of any of their rows.

Shingles are compared by 64-bit hashes. Cases: null or empty texts have an empty set and are their
own component; a null doc_id takes part, but labels are the smallest non-null id. Repeated rows are one
class; rows that repeat an id with other texts are classes of their own, each with its own links. Very long texts are
blocks of their own. Frequent shingles beyond OFTEN_MAX, and cells over SMALL_CELL (joined whole, as a star), cost
time and change no result. An empty table gives an empty table. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import bytewise as bw
from quernel.llm.graph import components
from quernel.session import Scratch

SHINGLE = 5
#: Count vectors have a power of two of groups, about n / 4, within these limits.
GROUPS = (64, 4096)
#: Tokens gathered before frequent ones are counted, the least count within them, and over all.
FLUSH, OFTEN_LOCAL, OFTEN = 1 << 21, 3, 48
#: The most shingles put last in the order. More would only go back to their place; results stay.
OFTEN_MAX = 1_000_000
#: Members of a cell that is checked pair by pair against the bound; larger ones become stars.
SMALL_CELL = 512
LEAF = 32
#: Tokens of candidates that are compared with a set at once.
VERIFY = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, one after another; where each begins)."""
    n = len(offsets) - 1
    data = bw.LOWER[data]
    starts, ends, doc = bw.word_spans(data, offsets)
    tokens, owner = bw.shingle_hashes(bw.range_hash(bw.prefix_hash(data), starts, ends), doc, n, SHINGLE)
    at = np.concatenate([[0], np.cumsum(bw.counts_of(owner, n))])
    for k in range(n):
        tokens[at[k] : at[k + 1]].sort()
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[fresh], np.concatenate([[0], np.cumsum(bw.counts_of(owner[fresh], n))])


def signatures(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(bw.mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=total[1:])
    return bw.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(bw.BASE)).view(np.int64)


def resolution(n: np.ndarray) -> np.ndarray:
    """Groups for a set of n shingles; grows with n."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) / 4.0)), *GROUPS).astype(np.int64)


def count_vectors(tokens: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(owner * groups + (tokens % np.uint64(groups)).astype(np.int64), minlength=n * groups).reshape(n, groups).astype(np.int32)


def vector_bytes(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's count vector at its own resolution, as bytes, or as 32-bit integers if a count is over 255."""
    out = []
    for k, g in enumerate(resolution(np.diff(at)).tolist()):
        counts = np.bincount((tokens[at[k] : at[k + 1]] % np.uint64(g)).astype(np.int64), minlength=g)
        out.append(counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes())
    return out


def folded(vector: bytes, own: int, groups: int) -> np.ndarray:
    """A vector of `own` groups, summed up to fewer."""
    return np.frombuffer(vector, np.uint8 if len(vector) == own else np.int32).reshape(-1, groups).sum(axis=0, dtype=np.int64)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 * intersection >= 80 * union, from the sizes; also a bound, if common is one from above."""
    return 9 * common >= 4 * (a + b)


def _frequent(pool: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(np.concatenate(pool), return_counts=True) if pool else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return values[counts >= OFTEN_LOCAL].view(np.int64), counts[counts >= OFTEN_LOCAL].astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool: list[np.ndarray] = []
    held, seen = 0, set()

    def frequent() -> pa.RecordBatch:
        token, often = _frequent(pool)
        none = [None] * len(token)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(none, pa.int64()), "n": pa.array(none, pa.int64()), "cls": pa.array(none, pa.int64()), "counts": pa.array(none, pa.binary()), "token": pa.array(token), "often": pa.array(often)})

    for rows, data, offsets in bw.chunks(batches, "text"):
        tokens, at = shingle_sets(data, offsets)
        n, cls = np.diff(at), signatures(tokens, at)
        none = [None] * len(n)
        yield pa.RecordBatch.from_pydict({
            "doc_id": rows.column(rows.schema.get_field_index("doc_id")), "n": pa.array(n), "cls": pa.array(cls, mask=n == 0),
            "counts": pa.array(vector_bytes(tokens, at), pa.binary()), "token": pa.array(none, pa.int64()), "often": pa.array(none, pa.int64()),
        })
        for k, c in enumerate(cls.tolist()):  # a copy in the same share counts once
            if c not in seen:
                seen.add(c)
                pool.append(tokens[at[k] : at[k + 1]])
                held += at[k + 1] - at[k]
        if held >= FLUSH:
            yield frequent()
            pool, held, seen = [], 0, set()
    yield frequent()


def _first_tokens(often):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = often.value
        for _, data, offsets in bw.chunks(batches, "text"):
            tokens, at = shingle_sets(data, offsets)
            cls = signatures(tokens, at)
            n = np.diff(at)
            once = np.zeros(len(n), bool)
            once[np.unique(cls, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(tokens), bool)
            if len(last):
                late = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens
            early = np.concatenate([[0], np.cumsum(~late)])
            place = np.where(late, np.arange(len(tokens)) - at[owner] + (early[at[owner + 1]] - early[:-1]), early[:-1] - early[at[owner]])
            keep = (place < (n - (4 * n + 4) // 5 + 1)[owner]) & once[owner]
            yield pa.RecordBatch.from_pydict({"token": tokens[keep].view(np.int64), "cls": cls[owner[keep]], "n": pa.array(n[owner[keep]], pa.int32()), "often": late[keep]})

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that share a token, one cell for each set of members; star edges for large cells.

    A token's classes in order of size are cut where the next is too large to link with the one before it.
    """
    got = [tuple(b.column(k).to_numpy() for k in range(3)) for b in batches]
    if not got:
        return
    token, cls, n = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((cls, n, token))
    token, cls, n = token[order], cls[order], n[order].astype(np.int64)
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, n = token[fresh], cls[fresh], n[fresh]
    begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (4 * n[1:] > 5 * n[:-1])])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(token)]]))
    shared = size > 1
    begin, size = begin[shared], size[shared]
    total = np.concatenate([[np.uint64(0)], np.cumsum(bw.mix(cls.view(np.uint64)))])
    cell = bw.mix(total[begin + size] - total[begin] + size.astype(np.uint64)).view(np.int64)
    _, first = np.unique(cell, return_index=True)
    begin, size, cell = begin[first], size[first], cell[first]
    index = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    large = np.repeat(size > SMALL_CELL, size)
    yield pa.RecordBatch.from_pydict({"cell": np.repeat(cell, size), "cls": cls[index], "hub": pa.array(np.repeat(cls[begin], size), mask=~large)})


class Forest:
    """Labels that merge; small enough to relabel by scanning."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == y] = x
        return True


def _cell_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the classes of a cell whose count vectors allow a link."""
    left: list[int] = []
    right: list[int] = []
    for group in bw.sorted_groups(batches, "cell"):
        n = group.column("n").to_numpy()
        order = np.argsort(n, kind="stable")  # the rest of the cell is never coarser than its smallest member
        cls, n = group.column("cls").to_numpy()[order], n[order]
        vectors = group.column("counts").take(pa.array(order)).to_pylist()
        groups = resolution(n)
        forest = Forest(len(cls))
        for k in range(len(cls) - 1):
            if not k or groups[k] != groups[k - 1]:
                counts = np.zeros((len(cls), groups[k]), np.int64)
                for j in range(k, int(np.searchsorted(4 * n, 5 * n[groups == groups[k]].max(), "right"))):
                    counts[j] = folded(vectors[j], int(groups[j]), int(groups[k]))
            rest = np.arange(k + 1, np.searchsorted(4 * n, 5 * n[k], "right"))
            rest = rest[forest.label[rest] != forest.label[k]]
            rest = rest[linked(np.minimum(counts[k], counts[rest]).sum(axis=1), n[k], n[rest])]
            for j in rest.tolist():
                if forest.join(k, j):
                    left.append(cls[k])
                    right.append(cls[j])
        if len(left) > 10_000:
            yield pa.RecordBatch.from_pydict({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})
            left, right = [], []
    yield pa.RecordBatch.from_pydict({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})


class CountTree:
    """R-tree over count vectors, packed by sorted tiles: size first, then the widest coordinate."""

    def __init__(self, counts: np.ndarray, n: np.ndarray):
        self.counts, self.n = counts, n
        by_size = np.argsort(n, kind="stable")
        tile = LEAF * LEAF
        parts = []
        for k in range(0, len(n), tile):
            part = by_size[k : k + tile]
            parts.append(part[np.argsort(counts[part, counts[part].var(axis=0).argmax()], kind="stable")])
        self.order = np.concatenate(parts) if parts else by_size
        self.levels = []
        high, low, top = counts[self.order], n[self.order], n[self.order]
        while len(low) > 1 or not self.levels:
            cut = np.arange(0, len(low), LEAF)
            high, low, top = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)
            self.levels.append((high, low, top))
            if len(low) == 1:
                break

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Members that the bound lets link with the point."""
        if not len(self.order):  # a block that no member was dealt to
            return self.order
        least = (4 * size + 4) // 5
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = self.levels[depth]
            fits = (top[nodes] >= least) & (4 * low[nodes] <= 5 * size)
            nodes = nodes[fits]
            nodes = nodes[linked(np.minimum(point, high[nodes]).sum(axis=1), size, np.maximum(low[nodes], least))]
            below = len(self.levels[depth - 1][1]) if depth else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        found = self.order[nodes]
        found = found[linked(np.minimum(point, self.counts[found]).sum(axis=1), size, self.n[found])]
        return found[(5 * self.n[found] >= 4 * size) & (4 * self.n[found] <= 5 * size)]


def join_block(tokens: np.ndarray, at: np.ndarray, copies: np.ndarray | None, left: np.ndarray, right: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between members of `left` and of `right` (indices of sets; the same ones, or none in common).

    Returns a spanning forest of them and, for each set, the copies of the sets that it links with. Without `copies`
    nothing is counted, and pairs that the forest connects already are not verified.
    """
    n = np.diff(at)
    counts = count_vectors(tokens, at, int(min(resolution(n).max(initial=GROUPS[0]), 1024)))
    _, local = np.unique(tokens, return_inverse=True)
    mark = np.zeros(int(local.max(initial=0)) + 1, bool)
    tree = CountTree(counts[right], n[right])
    forest = Forest(len(n))
    one_block = len(left) == len(right) and (left == right).all()
    links = np.zeros(len(n), np.int64)
    out = []
    for a in left.tolist():
        near = right[tree.search(counts[a], int(n[a]))]
        near = near[near != a] if copies is not None else near[forest.label[near] != forest.label[a]]
        mark[local[at[a] : at[a + 1]]] = True
        for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(n[near]) // VERIFY)) + 1):
            if not len(part):
                continue
            size = n[part]
            ends = np.cumsum(size)
            index = np.repeat(at[part] - ends + size, size) + np.arange(ends[-1])
            common = np.add.reduceat(mark[local[index]].astype(np.int64), ends - size)
            hits = part[linked(common, n[a], size)]
            if copies is not None:
                links[a] += copies[hits].sum()
                if not one_block:
                    links[hits] += copies[a]
            for b in hits[forest.label[hits] != forest.label[a]].tolist():
                if forest.join(a, b):
                    out.append((a, b))
        mark[local[at[a] : at[a + 1]]] = False
    return out, links


def _task_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in bw.chunks(batches, "text"):
        tokens, at = shingle_sets(data, offsets)
        own = signatures(tokens, at)
        cls = rows.column(rows.schema.get_field_index("cls")).to_numpy()
        tasks = rows.column(rows.schema.get_field_index("tasks")).to_pylist()
        copies = rows.column(rows.schema.get_field_index("copies")).to_pylist()
        for k in np.flatnonzero(own == cls).tolist():  # another row of the id may have another text
            todo = tasks[k]
            body = tokens[at[k] : at[k + 1]].tobytes()
            for j in range(0, len(todo), 256):
                part = todo[j : j + 256]
                yield pa.RecordBatch.from_pydict({"task": pa.array([t["task"] for t in part], pa.int64()), "side": pa.array([t["side"] for t in part], pa.int32()), "cls": pa.array([cls[k]] * len(part), pa.int64()), "copies": pa.array([copies[k]] * len(part), pa.int64()), "tokens": pa.array([body] * len(part), pa.binary())})


def _verify(count: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in bw.sorted_groups(batches, "task"):
            cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)
            side = group.column("side").to_numpy()[first]
            bodies = group.column("tokens").take(pa.array(first)).to_pylist()
            tokens = np.frombuffer(b"".join(bodies), np.uint64)
            at = np.concatenate([[0], np.cumsum([len(b) // 8 for b in bodies])])
            copies = group.column("copies").to_numpy()[first] if count else None
            # side 0: the blocks are one; 1 and 2: the two blocks
            edges, links = join_block(tokens, at, copies, np.flatnonzero(side != 2), np.flatnonzero(side != 1))
            a, b = np.array(edges, np.int64).reshape(-1, 2).T
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({"u": np.concatenate([cls[a], cls[some]]), "v": pa.array(np.concatenate([cls[b], cls[some]]), mask=np.arange(len(a) + len(some)) >= len(a)), "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]]))})

    return run


def _tasks(members: DataFrame) -> DataFrame:
    """(doc_id, cls, copies, array of (task, side)): the cluster's blocks are paired, and a member goes to its block's pairs."""
    sizes = members.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("volume")).filter("m > 1")
    spread = F.when(F.col("m") <= 192, 1).otherwise(F.least(F.ceil(F.col("m") / 96), F.lit(24)))
    blocks = F.greatest(F.ceil(F.col("m") / 2048), F.ceil(F.col("volume") / (1 << 21)), spread).cast("int")
    dealt = members.join(sizes, "label").withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("b")).cast("int"))
    other = F.sequence(F.lit(0), F.col("b") - 1)
    task = F.transform(
        other,
        lambda k: F.struct(
            F.xxhash64("label", F.least(k, F.col("own")), F.greatest(k, F.col("own"))).alias("task"),
            F.when(k == F.col("own"), 0).when(F.col("own") < k, 1).otherwise(2).alias("side"),
        ),
    )
    return dealt.select(F.col("rep").alias("doc_id"), "cls", "copies", task.alias("tasks"))


def join(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row for each row of docs; n_links counts the other rows it links with.

    Without count_links there is no n_links, and of each component only a spanning forest need be verified.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = scratch.stash(docs.mapInArrow(_profile, "doc_id long, n long, cls long, counts binary, token long, often long"), "profile")

    often = profile.filter("token is not null").groupBy("token").agg(F.sum("often").alias("often")).filter(F.col("often") >= OFTEN)
    heavy = often.orderBy(F.desc("often"), "token").limit(OFTEN_MAX).select("token").toArrow()  # bounded by OFTEN_MAX
    last = spark.sparkContext.broadcast(np.sort(heavy.column(0).to_numpy().astype(np.int64).view(np.uint64)))

    rows = profile.filter("token is null").select("doc_id", "n", "cls", "counts")
    classes = scratch.stash(rows.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.count("*").alias("copies")), "classes")

    prefix = docs.filter("doc_id is not null").mapInArrow(_first_tokens(last), "token long, cls long, n int, often boolean")
    prefix = scratch.stash(prefix, "prefix")
    cells = scratch.stash(prefix.filter("not often").select("token", "cls", "n").repartition("token").mapInArrow(_cells, "cell long, cls long, hub long"), "cells")
    busy = prefix.filter("often").select("token", "cls").distinct()
    hubs = busy.groupBy("token").agg(F.min("cls").alias("hub"))
    stars = busy.join(hubs, "token").select("cls", "hub").unionByName(cells.filter("hub is not null").select("cls", "hub")).filter("cls <> hub").distinct()
    star_edges = stars.select(F.col("cls").alias("u"), F.col("hub").alias("v"))
    small = cells.filter("hub is null").select("cell", "cls").distinct().join(classes.select("cls", "n", "counts"), "cls").select("cell", "cls", "n", "counts")
    cell_edges = small.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_forest, "u long, v long")
    near = scratch.stash(star_edges.unionByName(cell_edges), "near")
    scratch.drop("prefix", "cells")

    clusters = components(near, scratch, "cluster")
    members = clusters.join(classes.select(F.col("cls").alias("node"), "rep", "n", "copies"), "node").withColumnRenamed("node", "cls")
    tasks = scratch.stash(_tasks(members), "tasks")
    # texts meet their tasks by a merge join at every size: the tasks grow with the corpus
    sets = docs.join(tasks.hint("merge"), "doc_id").select("text", "cls", "copies", "tasks").mapInArrow(_task_sets, "task long, side int, cls long, copies long, tokens binary")
    links = scratch.stash(sets.repartition("task").sortWithinPartitions("task").mapInArrow(_verify(count_links), "u long, v long, links long"), "links")
    scratch.drop("near", "tasks")

    found = components(links.filter("v is not null").select("u", "v"), scratch, "component").withColumnRenamed("node", "cls")
    found = found.join(classes.select("cls", "rep"), "cls")
    lowest = found.groupBy("label").agg(F.min("rep").alias("component"))
    named = classes.select("cls", "rep", "copies").join(found.select("cls", "label"), "cls", "left").join(lowest, "label", "left").withColumn("component", F.coalesce("component", "rep"))
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if count_links:
        others = links.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
        named = named.join(others, "cls", "left")
        own = F.when(F.col("doc_id").isNotNull(), 1).otherwise(0)
        out.append(F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - own, F.lit(0)).cast("long").alias("n_links"))
    return rows.join(named.select("cls", "component", *(["links", "copies"] if count_links else [])), "cls", "left").select(*out)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs' rows whose doc_id is their component's smallest; rows without an id, and all rows that repeat such an id, stay."""
    first = join(docs, count_links=False).filter("doc_id = component_id").select(F.col("doc_id").alias("_nj_id")).distinct()
    joined = docs.join(first, docs["doc_id"] == first["_nj_id"], "left").filter("_nj_id is not null or doc_id is null")
    return joined.drop("_nj_id")
