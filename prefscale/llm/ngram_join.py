"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Sets of sizes a and b with Jaccard similarity t differ in at most
(1 - t) / (1 + t) * (a + b) shingles. Per size band (sizes from a power of two to the next) a set is cut by hash into
blocks, more than it may differ in, and each block is the XOR of its shingles' hashes. Every shingle in which two sets
differ changes one block, so similar sets agree in all but that many blocks, and must share a block among the first
d + 1 of them in any common order; blocks of many shingles come first, as they are the rarest. A band's pairs are met
on these blocks. A second, short parity sketch (one bit flipped per shingle) gives the Hamming distance, which never
exceeds the difference, and so drops candidates before their whole sets are fetched and intersected.

A block that many documents share doesn't give all their pairs. Equal sets are grouped first: the smallest doc_id stands
for its copies. Each other document is then tested against one document only, among the smallest ones of its blocks the
one with which it shares most of them (smallest within a map task, then across tasks). What passes is a forest of
pointers to smaller doc_ids, whose roots name the components so far. Then, in blocks that hold more than one component,
every pair across components is compared by its sketches, in chunks and without being written out. Of what passes, the
closest pair of each document outside a block's largest component with each other component is verified first; most
components grow together by that. Last, all pairs that pass between those that are still apart are verified. So no link
between different components is lost, and no group is expanded.

Defined results: null and empty texts have no shingles and are linked with nothing; rows that repeat a doc_id are one
document with any of their texts; rows without a doc_id have no links and a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.llm.text import giving_back, packed, unpacked
from prefscale.operators.graph import connected_components
from prefscale.session import cut, ship, table

#: The contract of the query: shingles of four words, 100 * intersection >= 85 * union.
WORDS, PERCENT = 4, 85
SKETCH_BITS = 512
#: Blocks beside the d + 1 that the pigeonhole needs, so that blocks of few shingles can be left out.
SPARE = 1.1
#: Rows of blocks that a map task groups at a time, and documents of a block that are compared as one chunk.
FLUSH_ROWS, CHUNK = 500_000, 512
#: Rows of blocks with the same largest component that go to one task, so that a pair is given out by few tasks.
PIECE_ROWS = 5_000
#: Up to so many ids are sent to every task.
BROADCAST_IDS = 200_000
#: Pairs that a task looks at together, and pairs that it gathers, each once, before it gives them out.
TOGETHER, GATHERED = 50_000, 200_000
#: Jumps over a forest of pointers; each doubles the way.
MAX_JUMPS = 64

U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD))


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``k`` words; of all words, if they are fewer."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, U(size))
    for i in range(size):
        out = (out ^ h[i : i + n]) * ODD[i % len(ODD)]
        out ^= out >> U(29)
    return np.unique(scatter(out))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, of which each shingle flips one, in bytes."""
    bits = np.bincount(((hashes >> U(7)) & U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8))


def sketch_rows(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), U).reshape(len(sketches), SKETCH_BITS // 64)


def most_apart(a: int, b: int, percent: int) -> int:
    """The most shingles in which similar sets of these sizes can differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def block_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The keys on which a set meets similar ones: of its own band, and of the next if a larger partner may lie there."""
    n = len(hashes)
    largest = n * 100 // percent
    out = []
    for band in range(n.bit_length() - 1, largest.bit_length()):
        top = (2 << band) - 1
        blocks = int(SPARE * (most_apart(top, top, percent) + 1)) + 1
        need = most_apart(n, min(top, largest), percent) + 1
        spot = ((hashes >> U(32)) * U(blocks)) >> U(32)  # rises with the hash, so blocks lie one after another
        starts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
        counts = np.diff(np.r_[starts, n])
        word = np.bitwise_xor.reduceat(scatter(hashes ^ ODD[0]), starts)
        at = spot[starts]
        if need > len(starts):  # too few blocks have shingles: empty ones count too
            empty = np.setdiff1d(np.arange(blocks, dtype=U), at)
            at, word, counts = np.r_[at, empty], np.r_[word, np.zeros(len(empty), U)], np.r_[counts, np.zeros(len(empty), counts.dtype)]
        key = scatter(scatter(word + at * ODD[1]) ^ scatter(np.full(1, band, U)))
        order = np.lexsort((key, -counts))[:need]
        out.append(key[order])
    return np.concatenate(out)


#: Rows of one pass over the texts: of a document (key null, other: the number of shingles) or of a block (key, doc_id,
#: and, if the document has met one of its own task, that one as other).
#: Sketches are binary, as lists are slow to send to Python row by row.
MADE = "key long, doc_id long, other long, set_key binary, sketch binary"


def groups_of(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key and doc sorted and each pair once, and the smallest doc of each row's key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
    key, doc = key[once], doc[once]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key, doc, np.repeat(doc[starts], np.diff(np.r_[starts, len(key)]))


def nullable(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def batch_of(key: pa.Array, doc: pa.Array, other: pa.Array, set_key: pa.Array | None = None, sketch: pa.Array | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.binary())
    columns = [key, doc, other, none if set_key is None else set_key, none if sketch is None else sketch]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "other", "set_key", "sketch"])


def map_side(k: int, percent: int) -> Callable:
    """Rows of MADE. Of a task's equal sets the smallest document gives blocks; of its documents with the same block the
    smallest goes on to meet other tasks', the rest have met it."""

    def flush(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        keys = [x[1] for x in held.values()]
        docs = np.repeat(np.array([x[0] for x in held.values()], np.int64), [len(x) for x in keys])
        key, doc, centre = groups_of(np.concatenate([np.zeros(0, U), *keys]).view(np.int64), docs)
        for i in range(0, len(key), 100_000):
            own = slice(i, i + 100_000)
            yield batch_of(nullable(key[own]), nullable(doc[own]), nullable(centre[own], doc[own] == centre[own]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        rows = 0
        for batch in batches:
            sizes, names, bits = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                hashes = shingle_set(text.as_py(), k)
                name = xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None
                sizes.append(len(hashes))
                names.append(name)
                bits.append(parity_sketch(hashes).tobytes())
                if name is None or doc is None:
                    continue
                if name in held:
                    held[name][0] = min(held[name][0], doc)
                    continue
                held[name] = [doc, block_keys(hashes, percent)]
                rows += len(held[name][1])
                if rows >= FLUSH_ROWS:
                    yield from flush(held)
                    held, rows = {}, 0
            yield batch_of(pa.nulls(len(sizes), pa.int64()), batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bits, pa.binary()))
        yield from flush(held)

    return work


def reduce_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those of blocks that haven't met any document get the smallest of their key as other, and go
    if they are that one; the rest passes. The rows of the last key are held back: one for each map task at most."""
    key = doc = np.zeros(0, np.int64)

    def met(key: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        to = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.r_[starts, len(key)]))
        more = doc != to
        if more.any():
            yield batch_of(nullable(key[more]), nullable(doc[more]), nullable(to[more]))

    for batch in batches:
        head = pa.compute.and_(batch.column("key").is_valid(), batch.column("other").is_null())
        rest = batch.filter(pa.compute.invert(head))
        if rest.num_rows:
            yield rest
        heads = batch.filter(head)
        if heads.num_rows:
            key = np.r_[key, heads.column("key").to_numpy(zero_copy_only=False)]
            doc = np.r_[doc, heads.column("doc_id").to_numpy(zero_copy_only=False)]
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from met(key[:last], doc[:last])
                key, doc = key[last:], doc[last:]
    if len(key):
        yield from met(key, doc)


def sets_and_blocks(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key, sketch) of every row, and the meetings (key, doc_id, centre) of documents with the
    same block: each but the smallest with the smallest of its task or of all. One pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(map_side(k, percent)), MADE)
    # rows of documents, and those that have met their centre, only pass through: they go anywhere
    place = F.when(F.col("key").isNull() | F.col("other").isNotNull(), F.xxhash64("doc_id", "other")).otherwise(F.col("key"))
    made = cut(rows.repartition(place).sortWithinPartitions("key").mapInArrow(giving_back(reduce_side), MADE))
    thin = made.where("key is null").select("doc_id", F.col("other").alias("n_shingles"), "set_key", "sketch")
    return thin, made.where("key is not null").select("key", "doc_id", F.col("other").alias("centre"))


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 64):
                some = part.iloc[i : i + 64]
                yield pd.DataFrame({"doc_id": some["doc_id"], "shingles": [shingle_set(t, k).view(np.int64) for t in some["text"]]})

    return docs.select("doc_id", "text").mapInPandas(giving_back(work), "doc_id long, shingles array<long>")


def close(pairs: DataFrame, thin: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches allow."""
    side = thin.select("doc_id", "n_shingles", "sketch")
    both = pairs.join(side.toDF("b", "nb", "sb"), "b").join(side.toDF("a", "na", "sa"), "a")

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.bitwise_count(sketch_rows(x) ^ sketch_rows(y)).sum(1).astype(np.int64))

    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    allowed = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    return both.where(apart("sa", "sb") <= allowed).select("a", "b").distinct()


def verified(both: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Those of the pairs (a, b), read twice, whose whole sets are similar; None if there are no pairs."""
    n = both.count()
    if not n:
        return None
    wanted = both.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # few ids go to the texts, so that these needn't be shuffled to be picked
    sets = cut(whole_sets(docs.join(F.broadcast(wanted) if 2 * n <= BROADCAST_IDS else wanted, "doc_id", "left_semi"), k))
    # many b have one a: their sets travel to it, and its own isn't repeated in a shuffle
    both = both.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a")
    shared = F.size(F.array_intersect("xa", "xb"))
    return both.where(shared * 100 >= (F.size("xa") + F.size("xb") - shared) * percent).select("a", "b")


def roots(pointers: DataFrame) -> DataFrame:
    """pointers (node, label, copy), one a node, all to smaller nodes -> the same with the roots as labels."""
    for _ in range(MAX_JUMPS):
        far = pointers.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = pointers.join(far, F.col("label") == F.col("via"), "left")
        new = cut(new.select("node", F.coalesce("far", "label").alias("label"), "copy", F.col("far").isNotNull().alias("moved")))
        pointers = new.select("node", "label", "copy")
        if new.where("moved").isEmpty():
            return pointers
    raise RuntimeError(f"pointers did not settle in {MAX_JUMPS} jumps")


def nearest(pairs: np.ndarray) -> np.ndarray:
    """Of rows (apart, a, b, outside) the closest of each document outside."""
    pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0], pairs[3]))]
    first = np.r_[True, pairs[3, 1:] != pairs[3, :-1]] if pairs.shape[1] else np.zeros(0, bool)
    return pairs[:, first]


def across(percent: int, best: bool) -> Callable:
    """Pairs of documents of one piece (key, i, j), of different components, whose sketches allow a link: (apart, a, b,
    left document), all of them or the closest of each left document. Rows come sorted by piece, a piece's left rows
    before its right ones."""
    piece = ["key", "i", "j"]
    reduced = nearest if best else lambda pairs: np.unique(pairs, axis=1)

    def pairs_of(rows: pd.DataFrame) -> Iterator[np.ndarray]:
        sketch = sketch_rows(rows["sketch"])
        doc, part, n, right = (rows[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "right"))
        at = rows[piece].to_numpy()
        number = np.cumsum(np.r_[0, (at[1:] != at[:-1]).any(1)])
        rights = np.bincount(number[right], minlength=number[-1] + 1)
        begin = np.searchsorted(number, np.arange(number[-1] + 1), side="right") - rights
        left = np.flatnonzero(~right)
        ends = np.cumsum(rights[number[left]])
        done = 0
        while done < len(left):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TOGETHER, side="right")))
            own = left[done:stop]
            many = rights[number[own]]
            i = np.repeat(own, many)
            j = np.repeat(begin[number[own]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            fits = (part[i] != part[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
            i, j = i[fits], j[fits]
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1).astype(np.int64)
            fits = apart <= (100 - percent) * (n[i] + n[j]) // (100 + percent)
            i, j, apart = i[fits], j[fits], apart[fits]
            a, b = doc[i], doc[j]
            yield np.stack([apart, np.minimum(a, b), np.maximum(a, b), a if best else 0 * a])
            done = stop

    def frame(found: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(found.T, columns=["apart", "a", "b", "outside"])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, held, size = None, [], 0  # documents share many keys, but each pair is held once, and given out seldom twice

        def more(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal held, size
            for pairs in pairs_of(rows):
                held, size = [*held, pairs], size + pairs.shape[1]
                if size > GATHERED or len(held) > 1_000:
                    held = [reduced(np.concatenate(held, 1))]
                    size = held[0].shape[1]
                    if size > GATHERED // 2:
                        yield frame(held[0])
                        held, size = [], 0

        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if not len(part):
                continue
            last = (part[piece] == part[piece].iloc[-1]).all(axis=1).to_numpy()
            rest = part[last]  # the last piece may go on
            if not last.all():
                yield from more(part[~last])
        if rest is not None:
            yield from more(rest)
        yield frame(reduced(np.concatenate([np.zeros((4, 0), np.int64), *held], 1)))

    return work


def cross_pairs(met: DataFrame, thin: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame | None:
    """Pairs (a, b) that share a key, lie in different components, and may be similar by their sketches; None if no key
    has two components. best: of each document outside a key's largest component only the closest pair.

    In a key, the documents outside its largest component meet all others. They are dealt to chunks of at most about
    CHUNK documents, and each pair of chunks of a key is one piece of work. Pieces of keys with the same largest component
    go to one task, or to several by their key if they are many, so a hot key or component is spread. Copies stay out:
    the document that stands for them has all their keys.
    """
    rows = met.select("key", "doc_id").unionByName(met.select("key", F.col("centre").alias("doc_id"))).distinct()
    rows = rows.join(labels, F.col("doc_id") == F.col("node"), "left").where("copy is null or not copy")
    rows = rows.select("key", "doc_id", F.coalesce("label", "doc_id").alias("component"))
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most"))
    chunks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
    keys = cut(keys.where("parts > 1").select("key", "main", "all", chunks(F.col("all") - F.col("most")).alias("cl"), chunks(F.col("all")).alias("cr")))
    if keys.isEmpty():
        return None
    tasks = keys.groupBy("main").agg(F.ceil(F.sum("all") / PIECE_ROWS).alias("tasks"))
    keys = keys.join(tasks, "main").select("key", "main", "cl", "cr", F.pmod(F.xxhash64("key"), F.col("tasks")).alias("task"))
    rows = rows.join(keys, "key").join(thin.select("doc_id", "n_shingles", "sketch"), "doc_id")
    left, right = F.pmod(F.hash("doc_id"), F.col("cl")), F.pmod(F.xxhash64("doc_id"), F.col("cr")).cast("int")
    spots = lambda i, j, is_right: F.struct(i.alias("i"), j.alias("j"), F.lit(is_right).alias("right"))
    rights = F.transform(F.sequence(F.lit(0), F.col("cl") - 1), lambda i: spots(i, right, True))
    lefts = F.transform(F.sequence(F.lit(0), F.col("cr") - 1), lambda j: spots(left, j, False))
    work = rows.withColumn("at", F.explode(F.when(F.col("component") == F.col("main"), rights).otherwise(F.concat(rights, lefts))))
    work = work.select("key", "main", "task", "at.*", "doc_id", "component", "n_shingles", "sketch")
    work = work.repartition("main", "task", "i", "j").sortWithinPartitions("key", "i", "j", "right")
    pairs = work.drop("main", "task").mapInPandas(giving_back(across(percent, best)), "apart long, a long, b long, outside long")
    if best:
        pairs = pairs.groupBy("outside").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
    return pairs.select("a", "b").distinct()


def link_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), a row each."""
    ship(docs.sparkSession)
    thin, met = sets_and_blocks(docs, k, percent)
    known = docs.where("doc_id is not null").select("doc_id", "text")
    sized = thin.where("doc_id is not null and n_shingles > 0")
    # the first copy of a set stands for all: what is linked to one copy is linked to the others
    copies = sized.groupBy("set_key").agg(F.min("doc_id").alias("label"), F.count("*").alias("n")).where("n > 1")
    copies = cut(sized.join(copies, "set_key").where("doc_id <> label").groupBy(F.col("doc_id").alias("node")).agg(F.min("label").alias("label")).withColumn("copy", F.lit(True)))
    best = met.groupBy(F.col("centre").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("n"))
    best = best.join(copies, F.col("b") == F.col("node"), "left_anti")
    best = best.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    near = cut(close(best, sized, percent))
    links = verified(near, known, k, percent)
    labels = copies
    if links is not None:
        labels = copies.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("label"), F.lit(False).alias("copy")).distinct())
    labels = roots(cut(labels))
    tested = near
    for nearest_only in (True, False):
        pairs = cross_pairs(met, sized, labels, percent, nearest_only)
        if pairs is None:
            break
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        links = verified(pairs, known, k, percent)
        if links is not None:
            labels = merged(labels, links)
            tested = tested.unionByName(pairs)
    out = thin.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the components that ``links`` (a, b) connect have become one."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    parts = connected_components(edges.select(F.coalesce("la", "a").alias("src"), F.coalesce("lb", "b").alias("dst")))
    parts = parts.where("node <> component").toDF("root", "component")
    old = labels.join(parts, F.col("label") == F.col("root"), "left").select("node", F.coalesce("component", "label").alias("label"), "copy")
    return cut(old.unionByName(parts.select(F.col("root").alias("node"), F.col("component").alias("label"), F.lit(False).alias("copy"))))


def near_dedup(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` from each component, the one whose doc_id names it; rows without a doc_id stay. Rows that repeat
    a doc_id are compared each for itself: those with the same text are one, those with other texts have their own
    components, of which the smallest (doc_id, text) stays."""
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        parts = cut(link_components(docs.select("doc_id", "text"), k, percent))
        gone = parts.where("doc_id <> component_id").select("doc_id")
        few = gone.count() <= BROADCAST_IDS  # then the rows needn't be shuffled to lose them
        return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    once = W.partitionBy("doc_id", "text").orderBy(F.lit(1))
    rows = packed(known, "doc_id", "text").withColumn("n", F.row_number().over(once)).where("n = 1")
    # numbers that rise with (doc_id, text): ranges in the order of partitions, sorted within
    rows = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    rows = cut(rows.select("text", "_packed", F.monotonically_increasing_id().alias("row")))
    parts = link_components(rows.select(F.col("row").alias("doc_id"), "text"), k, percent)
    stay = parts.where("doc_id = component_id").select(F.col("doc_id").alias("row"))
    return unpacked(rows.join(stay, "row", "left_semi")).unionByName(docs.where("doc_id is null"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(node, seen) AS (SELECT a, least(a, b) FROM e UNION SELECT e.b, t.seen FROM t JOIN e ON t.node = e.a),
c AS (SELECT node, min(seen) AS seen FROM t GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(c.seen, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node
"""
