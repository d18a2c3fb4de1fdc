"""N-gram Jaccard join by a token-group matrix: which documents are linked, directly or through others.

A document's set holds its distinct word n-grams; two documents link when the Jaccard similarity of their sets reaches
``NUMERATOR / DENOMINATOR``. The join is exact.

1. Equal sets fold into one: their digest's smallest document stands for them. Further copies that another task has only lead to it.
2. Similar documents meet in clusters. A set of n n-grams is dealt by hash into m parts; linked sets of that size differ in at
   most k n-grams, so with m = k + 1 + e parts at least e + 1 parts are equal. Each part but the set's e least, by number of
   n-grams and then digest, is a row of the matrix (its digest), and the documents that share a row are hung on the smallest of
   them. The greatest of the equal parts is among neither set's e least, so no link is lost, and small parts don't pull
   unrelated documents together through common n-grams. An empty part is never a row: a set with fewer than k + 1 parts that
   aren't empty is dealt once more by another hash, as a set that is linked with it through empty parts alone would be. A task hangs the
   documents that it has on the smallest of them itself, some thousands at a time, so that only one of these takes a row to the shuffle. Sizes go
   by classes of ratio ``DENOMINATOR / NUMERATOR``, and each document takes part with its own class and the one below.
3. The components of these rows are the clusters to search. A small one is one task's work. Those of a larger one meet once more, by
   the rarest of their n-grams in it, which takes apart what a passage of many documents has brought together. What stays large is cut into blocks, each
   a task of its own together with the cluster's few pivots, the documents that have most in common with the others, so that copies of one text are linked
   through these and the work grows with the cluster, not with its square. Then only documents outside the cluster's largest class so far are taken further,
   each to the blocks in which it meets a document of another class. Within a task documents are partitioned into groups of
   similar ones, the matrix has each group's union of n-grams, a document's overlap with a union bounds its overlap with every member,
   and only groups whose bound reaches the threshold are opened and compared. Documents that are already linked
   through others are not compared again, and a task returns a spanning tree of its links rather than all pairs.
4. Components of all the trees are the classes.

Words are compared in lower case of A-Z. A document of fewer words than n has its whole word sequence as its only n-gram. Null or
blank texts have an empty set and link with nothing. Each row is a document of its own; of rows with equal sets the smallest doc_id stands for
all, and sets for which the same doc_id stands (a doc_id with several texts) count as linked. Rows with a null doc_id link with nothing and
have a null component. An empty table gives no rows; further columns are ignored. N-grams are compared by 64-bit and sets by 128-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import few, saved, small_side
from geolode.llm.components import components

WIDTH, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Parts of a set beyond those that linked sets need, in hundredths of these.
SPARE = 60
#: Documents of a group of the matrix; documents and n-grams of a task's block; documents of a cluster that meet all its blocks.
GROUP, BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 16, 1500, 1_500_000, 4
#: Documents whose rows are folded together before they are shuffled, and rows of them.
FOLD_DOCS, FOLD_ROWS = 8192, 1_000_000
#: Times that a set is dealt anew for want of parts with an n-gram. Each time is rarer than one set in a thousand that came so far.
DEALS = 16
#: Words kept by a Python worker.
KEPT = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of words, as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The text's set of n-grams, as sorted 64-bit hashes."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    if len(h) < width:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)) if len(h) else h
    x = h[: len(h) - width + 1] * np.uint64(1)
    for k in range(1, width):
        x = _mixed(x) + h[k : len(h) - width + 1 + k] * _ODD[k % len(_ODD)]
    return np.unique(_mixed(x))


@functools.lru_cache(maxsize=8)
def _bounds(numerator: int, denominator: int) -> np.ndarray:
    """Least sizes of the size classes: linked sets are of one class or of neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * denominator // numerator)))
    return np.array(bounds)


def rows(tokens: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> np.ndarray:
    """The matrix rows in which a set takes part."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    bounds = _bounds(numerator, denominator)
    own = int(np.searchsorted(bounds, len(tokens), "right")) - 1
    out = []
    for slot in (own, own + 1)[own == 0 :]:
        # at most k n-grams differ, the smaller set being of the class below the slot's
        k = (denominator - numerator) * (int(bounds[slot]) - 1) // numerator
        spare = 1 + -(-SPARE * (k + 1) // 100) if k else 0
        parts, hashes = k + 1 + spare, tokens
        for deal in range(DEALS):
            part = ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sizes = np.bincount(part, minlength=parts)
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[order], dtype=np.uint64)])
            mark = (slot * int(_ODD[3]) + deal * int(_ODD[0])) % (1 << 64)
            digest = _mixed((sums[ends] - sums[ends - sizes]) * _ODD[1] + np.arange(parts, dtype=np.uint64) * _ODD[2] + np.uint64(mark) + sizes.astype(np.uint64) * _ODD[4])
            taken = np.lexsort((digest, sizes))[spare:]
            whole = bool(sizes[taken[0]])
            out.append(digest[taken if whole or deal == DEALS - 1 else taken[sizes[taken] > 0]])
            if whole:
                break
            hashes = _mixed(hashes + _ODD[deal % len(_ODD)])
    return np.concatenate(out).view(np.int64)


FEATURES = "doc_id bigint, n_shingles bigint, digest binary, rows array<bigint>, links array<bigint>"


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values by owner (rising, of n) as lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, pa.int64()))


def folded(ids: np.ndarray, taken: list[np.ndarray]) -> tuple[pa.ListArray, pa.ListArray]:
    """Of documents and their rows: the rows that each takes on as the smallest document that has them, and the smallest documents that it hangs on by the others."""
    n = len(ids)
    owner, row = np.repeat(np.arange(n), [len(t) for t in taken]), np.concatenate([*taken, np.zeros(0, np.int64)])
    order = np.lexsort((ids[owner], row))
    owner, row = owner[order], row[order]
    head = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    smallest = ids[owner[np.flatnonzero(head)]][np.cumsum(head) - 1] if len(row) else ids[:0]
    hung = np.unique(np.stack([owner[~head], smallest[~head]]), axis=1)
    hung = hung[:, ids[hung[0]] != hung[1]]
    kept = np.lexsort((row[head], owner[head]))
    return _lists(owner[head][kept], row[head][kept], n), _lists(hung[0], hung[1], n)


def features(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """A row per document: doc_id, n_shingles, digest of the set (null if empty), its rows and links.

    Rows that a smaller document of the same task has as well are left out, and links has that document; equal sets have rows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, held, n_rows = np.zeros(0, np.int64), [], 0

        def flushed() -> pa.RecordBatch:
            ids, sizes, digests, taken = zip(*held, strict=True)
            number = np.array([-1 if i is None else i for i in ids], np.int64)
            first: dict[bytes, int] = {}
            for k, d in enumerate(digests):
                if d is not None and ids[k] is not None and (d not in first or ids[k] < ids[first[d]]):
                    first[d] = k
            own = set(first.values())
            rows_, links = folded(number, [t if k in own else none for k, t in enumerate(taken)])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), rows_, links], ["doc_id", "n_shingles", "digest", "rows", "links"])

        for batch in few(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens = shingles(text, width) if text else np.zeros(0, np.uint64)
                taken = rows(tokens, numerator, denominator)
                held.append((doc_id, len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None, taken))
                n_rows += len(taken)
                if len(held) >= FOLD_DOCS or n_rows >= FOLD_ROWS:
                    yield flushed()
                    held, n_rows = [], 0
        if held:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def linked(ids: np.ndarray, sets: list[np.ndarray], numerator: int = NUMERATOR, denominator: int = DENOMINATOR, split: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, by the token-group matrix.

    split: side of each set; then only links between different sides are looked for. label: class of each set that is known so far.
    """
    n = np.array([len(s) for s in sets])
    label = np.array(label) if label is not None else np.arange(len(sets))
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)])
    own = [inverse[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    # groups: neighbours in the order of their smallest hash, which similar sets mostly share
    order = np.lexsort((n, [s[0] for s in sets]))
    group = np.empty(len(sets), np.int64)
    group[order] = np.arange(len(sets)) // GROUP
    n_groups = int(group.max()) + 1
    # the matrix by token: the groups whose union has it
    cells = np.unique(inverse * n_groups + np.repeat(group, n))
    columns, first = cells % n_groups, np.searchsorted(cells // n_groups, np.arange(len(tokens) + 1))
    marked = np.zeros(len(tokens), bool)
    found = []
    # those with most in common with all come first, as they link most
    turn = np.empty(len(sets), np.int64)
    visits = np.argsort(-np.add.reduceat(np.bincount(inverse)[inverse], starts[:-1]) / n, kind="stable")
    turn[visits] = np.arange(len(sets))
    for q in visits.tolist():
        open_ = (label != label[q]) & (turn > turn[q]) & (denominator * np.minimum(n, n[q]) >= numerator * np.maximum(n, n[q]))
        if split is not None:
            open_ &= split != split[q]
        if not open_.any():
            continue
        a, b = first[own[q]], first[own[q] + 1]
        width = b - a
        at = np.repeat(b - np.cumsum(width), width) + np.arange(width.sum())
        bound = np.bincount(columns[at], minlength=n_groups)
        marked[own[q]] = True
        for s in np.flatnonzero(open_ & (denominator * bound >= numerator * n[q])[group]):
            if label[s] == label[q]:
                continue
            common = int(marked[own[s]].sum())
            if denominator * common >= numerator * (n[q] + n[s] - common):
                label[label == label[s]] = label[q]
                found.append((int(ids[q]), int(ids[s])))
        marked[own[q]] = False
    return found


PLACES = "array<struct<cluster:bigint,task:bigint,side:int,label:bigint>>"


def members(docs: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """placed (digest, doc_id, cluster, task, side, label) with each set's n-grams (tokens), dealt by cluster and task."""
    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("text"))
    # a row for each set, so that its n-grams are found once
    wanted = saved(placed.groupBy(F.col("doc_id").alias("rep"), F.col("digest").alias("wanted")).agg(F.collect_list(F.struct("cluster", "task", "side", "label")).alias("places")))
    size = wanted.agg(F.count("*"), F.sum(F.size("places"))).first()
    joined = texts.join(small_side(wanted, 80 * size[0] + 32 * (size[1] or 0), 1), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "wanted", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()  # repeated rows go on once from each task
        for batch in few(batches):
            keep, tokens, last, known = [], [], None, None
            for k, (doc_id, text, digest) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if text is None or (doc_id, digest) in seen:
                    continue
                if last != text:
                    raw = shingles(text, width).tobytes()
                    last, known = text, (xxhash.xxh3_128_digest(raw), raw)
                if known[0] == digest:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add((doc_id, digest))
                    keep.append(k)
                    tokens.append(known[1])
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(tokens, pa.binary()), some.column(3)], ["doc_id", "digest", "tokens", "places"])

    found = joined.mapInArrow(run, f"doc_id bigint, digest binary, tokens binary, places {PLACES}")
    dealt = found.select("doc_id", "digest", "tokens", F.explode("places").alias("p")).select("p.*", "doc_id", "digest", "tokens").repartition("cluster", "task")
    return dealt.groupBy("cluster", "task", "side", "label", "doc_id", "digest").agg(F.first("tokens").alias("tokens"))


def compared(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (u, v) of the sets of each task."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        side, label = part["side"].to_numpy(), part["label"].to_numpy()
        arrays = [np.frombuffer(t, np.uint64) for t in part["tokens"]]
        links = linked(part["doc_id"].to_numpy(), arrays, numerator, denominator, *((side, label) if (side == 2).any() else ()))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return sets.groupBy("cluster", "task").applyInPandas(compare, "u bigint, v bigint")


def hubs(sets: DataFrame) -> DataFrame:
    """Of each task's sets some (PIVOTS at most) that have the most in common with all, and less than half with each other: rank, score and set."""

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(t, np.uint64) for t in part["tokens"]]
        _, inverse, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        n = np.array([len(a) for a in arrays])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        score, taken, chosen = np.add.reduceat(counts[inverse] / len(n), starts) / n, np.zeros(len(counts), bool), []
        open_ = np.ones(len(n), bool)
        while len(chosen) < PIVOTS and open_.any():
            best = int(np.argmax(np.where(open_, score, -1.0)))
            chosen.append(best)
            taken[inverse[starts[best] : starts[best] + n[best]]] = True
            open_ &= 2 * np.add.reduceat(taken[inverse].astype(np.int64), starts) < n
        out = part.iloc[chosen][["cluster", "task", "doc_id", "digest"]]
        return out.assign(rank=np.arange(len(chosen)), score=score[chosen])[["cluster", "task", "rank", "score", "doc_id", "digest"]]

    return sets.groupBy("cluster", "task").applyInPandas(choose, "cluster bigint, task bigint, rank bigint, score double, doc_id bigint, digest binary")


def _shares() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long")


def rare(docs: DataFrame, large: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Of the sets of large clusters (digest, doc_id, cluster, block) the n-grams by which linked ones must meet: doc_id, of (cluster) and row (n-gram).

    In an order of all n-grams of a cluster, two linked sets have one in common among each one's first n - ceil(threshold * n) + 1. The rarest
    come first, so a passage that very many documents share brings none of them together.
    """
    placed = large.select("digest", "doc_id", "cluster", F.col("block").alias("task"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("label"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            sets = [np.frombuffer(t, np.int64) for t in batch.column(3).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in sets])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], tokens], ["of", "doc_id", "digest", "tokens"])

    sets = members(docs, placed, width).select("cluster", "doc_id", "digest", "tokens")
    lists = saved(sets.mapInArrow(listed, "of bigint, doc_id bigint, digest binary, tokens array<bigint>"))
    cells = lists.select("of", "doc_id", "digest", F.size("tokens").alias("n"), F.explode("tokens").alias("row"))
    counts = cells.groupBy("of", "row").agg(F.count("*").alias("c")).filter("c > 1")
    common = cells.join(counts.hint("merge"), ["of", "row"]).groupBy("of", "doc_id", "digest", "n").agg(F.sort_array(F.collect_list(F.struct("c", "row"))).alias("common"))
    n = F.col("n")
    first = n - F.ceil(n * numerator / denominator) + 1 - (n - F.size("common"))  # behind the n-grams that no other set has
    taken = common.select("doc_id", "of", F.explode(F.slice("common", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x"))
    return saved(taken.select("doc_id", "of", F.col("x.row").alias("row")).distinct())


def hung_on_smallest(cells: DataFrame, *row: str) -> DataFrame:
    """u, v: each document of cells (doc_id and row) and the smallest that has the row, by one exchange."""
    dealt = cells.repartition(*row)
    least = dealt.groupBy(*row).agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last")).filter("v < last").select(*row, "v")
    return dealt.join(least.hint("merge"), list(row)).filter("doc_id <> v").select(F.col("doc_id").alias("u"), "v")


def _blocks(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """digest, doc_id, n_shingles, cluster, blocks and block of the sets of clusters (doc_id, cluster) that have several."""
    sized = clusters.join(sets, "doc_id")
    blocks = sized.groupBy("cluster").agg(_shares().alias("blocks"), F.count("*").alias("sets")).filter("sets > 1").drop("sets")  # not copies of one set alone
    return saved(sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))


def links_of(docs: DataFrame, sets: DataFrame, clusters: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """A spanning forest (u, v) of the links within clusters (doc_id, cluster); sets has digest, doc_id and n_shingles."""
    work = _blocks(clusters, sets)
    large = work.filter("blocks > 1")
    if not large.isEmpty():
        # large clusters fall apart by what their documents have in common but for frequent n-grams
        cells = rare(docs, large, width, numerator, denominator)
        parts = components(hung_on_smallest(cells, "of", "row")).withColumnsRenamed({"node": "doc_id", "component": "cluster"})
        work = saved(work.filter("blocks = 1").unionByName(_blocks(parts, sets)))
    columns = ["digest", "doc_id", "cluster", "task", "side", "label"]
    placed = work.withColumns({"task": F.col("block"), "side": F.lit(1), "label": F.lit(0).cast("long")})
    large = placed.filter("blocks > 1")
    any_large = not large.isEmpty()
    if any_large:
        # the pivots of a large cluster, those with most in common in any of its blocks, stand in each of its blocks
        best = hubs(members(docs, large.select(*columns), width)).groupBy("cluster", "rank").agg(F.max(F.struct("score", "digest", "doc_id", "task")).alias("p"))
        best = saved(best.join(large.select("cluster", "blocks").distinct(), "cluster"))
        pivots = best.select("p.digest", "p.doc_id", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("task"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("label"), F.col("p.task").alias("home"))
        placed = placed.select(*columns).unionByName(pivots.filter("task <> home").select(*columns))
    links = saved(compared(members(docs, placed.select(*columns), width), numerator, denominator))
    if not any_large:
        return links
    # what is outside the largest class of its cluster goes on
    known = components(links).withColumnsRenamed({"node": "doc_id", "component": "label"})
    labelled = saved(large.drop("label", "task", "side").join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    main = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = saved(labelled.join(main, "cluster").filter("label <> main").drop("main"))
    if rest.isEmpty():
        return links
    # an n-gram that linked documents must meet by says which blocks hold documents of which classes
    having = cells.join(labelled.select("doc_id", "cluster", "block", "label"), "doc_id").groupBy("of", "row", "cluster", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    own = cells.join(rest.select("doc_id", F.col("block").alias("home"), "label"), "doc_id")
    meets = own.join(having, ["of", "row"]).filter("block <> home and (least <> label or most <> label)").select("doc_id", "cluster", "block").distinct()
    wanted = saved(meets.join(rest.select("doc_id", "digest", "n_shingles", "label"), "doc_id"))
    chunks = wanted.groupBy("cluster", "block").agg(_shares().alias("chunks"))
    task = F.xxhash64("block", "chunk")
    first = wanted.join(chunks, ["cluster", "block"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("chunks")))
    second = labelled.join(chunks, ["cluster", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    sides = [df.select("digest", "doc_id", "cluster", task.alias("task"), F.lit(k).alias("side"), "label") for k, df in ((1, first), (2, second))]
    return links.unionByName(compared(members(docs, sides[0].unionByName(sides[1]), width), numerator, denominator))


def classes(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """A row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links, itself included."""
    known = saved(features(docs, width, numerator, denominator))
    some = known.filter("digest is not null and doc_id is not null")
    sets = saved(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles")))
    # of the documents that take a row to the shuffle there is one for some thousand at most
    met = hung_on_smallest(some.select("doc_id", F.explode("rows").alias("row")), "row")
    hung = some.select(F.col("doc_id").alias("u"), F.explode("links").alias("v"))
    clusters = saved(components(met.unionByName(hung)).withColumnsRenamed({"node": "doc_id", "component": "cluster"}))
    links = links_of(docs, sets, clusters, width, numerator, denominator)
    joined = components(links).withColumnsRenamed({"node": "doc_id", "component": "linked"})
    by_set = sets.join(joined, "doc_id", "left").select("digest", F.coalesce("linked", "doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return known.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
