"""Exact dedup by Patricia-trie owners.

Texts are equal when their normalised bytes are. Each input partition first puts its own texts into a compressed radix
trie, so that a group of copies leaves it as one row however large it is. These rows are dealt out by length and
content hash, and a second set of tries, one per partition, finds each text's owner: the smallest identifier at its
terminal node. Owners of more than one row are joined back to the thin rows (identifier, hash).

A trie that outgrows its budget spills its heaviest subtree: the subtree's texts, each once with what is known of it so
far, go on to the shuffle, where they meet the later ones. The second tries get their texts sorted by length and hash,
so they give out what they hold whenever they outgrow their budget at the end of a key. So spilled texts lie in Spark's
own shuffle and sort files, and no task keeps files of its own.

Defined results: a null text counts as empty; a group whose doc_ids are all null has a null owner, and so on its rows
keep_id is null; rows that repeat both doc_id and text are copies, of which one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.llm.text import SPACE, giving_back, packed, unpacked
from prefscale.session import cut, ship, table

#: Bytes of texts that a trie holds before it spills a subtree.
TRIE_BYTES = 48 << 20
#: Owners of up to so many texts, of some 50 bytes each, are sent to every task.
BROADCAST_TEXTS = 100_000
#: What a node costs beside its label.
NODE_BYTES = 200
#: Stands for a missing doc_id, as it is larger than all others.
NO_ID = (1 << 63) - 1
ENTRY = "text_key binary, n_bytes long, body binary, keep_id long, group_size long"


class Node:
    """A node: the bytes on the edge into it, its children by first byte, and at a terminal the owner and the count."""

    __slots__ = ("label", "children", "owner", "count", "key")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count, self.key = label, None, NO_ID, 0, None


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``, by halving."""
    n = min(len(a), len(b) - start)
    if a[:n] == b[start : start + n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A Patricia trie of byte strings with spill by subtree."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.budget, self.held = budget, 0
        self.root = Node(b"")
        self.weight: dict[int, int] = {}  # bytes held below each child of the root

    def add(self, body: bytes, key: bytes, owner: int, count: int) -> None:
        more = self._insert(body, key, owner, count)
        self.held += more
        first = body[0] if body else -1
        self.weight[first] = self.weight.get(first, 0) + more

    def full(self) -> bool:
        return self.held > self.budget

    def spill(self) -> Iterator[tuple[bytes, bytes, int, int]]:
        """Takes the heaviest subtree below the root out and gives its entries; nothing, if only the empty string is held."""
        heavy = max((b for b in self.weight if b >= 0), key=self.weight.get, default=None)
        if heavy is not None:
            self.held -= self.weight.pop(heavy)
            yield from self._walk(self.root.children.pop(heavy), b"")

    def _insert(self, body: bytes, key: bytes, owner: int, count: int) -> int:
        node, at, more = self.root, 0, 0
        while at < len(body):
            if node.children is None:
                node.children = {}
            child = node.children.get(body[at])
            if child is None:
                child = node.children[body[at]] = Node(body[at:])
                node, more, at = child, more + len(body) - at + NODE_BYTES, len(body)
                break
            same = common(child.label, body, at)
            if same < len(child.label):
                upper = node.children[body[at]] = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children = {child.label[0]: child}
                child, more = upper, more + NODE_BYTES
            node, at = child, at + same
        if node.count:
            node.owner = min(node.owner, owner)
        else:
            node.owner, node.key = owner, key
        node.count += count
        return more

    def _walk(self, node: Node, above: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            here = above + node.label
            if node.count:
                yield here, node.key, node.owner, node.count
            stack.extend((c, here) for c in (node.children or {}).values())

    def entries(self) -> Iterator[tuple[bytes, bytes, int, int]]:
        """(body, key, owner, count) of every distinct string held."""
        return self._walk(self.root, b"")


def in_frames(entries: Iterator[tuple[bytes, bytes, int, int]], whole: bool) -> Iterator[pd.DataFrame]:
    """Frames of limited size. whole: with the text, for the next round; else only those held more than once."""
    rows, size = [], 0
    for body, key, owner, count in entries:
        if whole or count > 1:
            rows.append((key, len(body), body if whole else None, owner, count))
            size += len(body) if whole else 50
        if size > 8 << 20:
            yield frame(rows)
            rows, size = [], 0
    yield frame(rows)


def held_rows(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, bytes, int, int]]:
    for part in parts:
        for body, key, owner, count in zip(part["body"], part["text_key"], part["keep_id"], part["group_size"], strict=True):
            yield body, key, int(owner), int(count)


def local_owners(parts: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """The distinct texts of a partition; one that was spilled before comes once more with what was found since."""

    def entries() -> Iterator[tuple[bytes, bytes, int, int]]:
        trie = Trie(budget)
        for row in held_rows(parts):
            trie.add(*row)
            if trie.full():
                yield from trie.spill()
        yield from trie.entries()

    return in_frames(entries(), True)


def final_owners(parts: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """The texts that more than one row has, from rows sorted by length and hash."""

    def entries() -> Iterator[tuple[bytes, bytes, int, int]]:
        trie, last = Trie(budget), None
        for row in held_rows(parts):
            if row[1] != last and trie.full():
                yield from trie.entries()
                trie = Trie(budget)
            trie.add(*row)
            last = row[1]
        yield from trie.entries()

    return in_frames(entries(), False)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["text_key", "n_bytes", "body", "keep_id", "group_size"])
    return out.astype({"keep_id": "int64", "group_size": "int64", "n_bytes": "int64"})


def normal_text(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_owners(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """(text_key, keep_id, group_size) for every text that more than one row has."""
    ship(docs.sparkSession)
    body = F.encode(normal_text(F.col("text")), "UTF-8")
    rows = docs.select(body.alias("body"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("keep_id"))
    rows = rows.select(F.unhex(F.sha2("body", 256)).alias("text_key"), F.length("body").cast("long").alias("n_bytes"), "body", "keep_id", F.lit(1).cast("long").alias("group_size"))
    local = rows.mapInPandas(giving_back(lambda parts: local_owners(parts, budget)), ENTRY)
    dealt = local.repartition("n_bytes", "text_key").sortWithinPartitions("n_bytes", "text_key")
    return dealt.mapInPandas(giving_back(lambda parts: final_owners(parts, budget)), ENTRY).select("text_key", F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 (of the normalised text); every row stays, other columns too."""
    found = cut(text_owners(docs, budget))
    few = found.count() <= BROADCAST_TEXTS  # then the rows needn't be shuffled to meet them
    found = found.withColumnRenamed("text_key", "_key")
    made = ("keep_id", "group_size", "kept", "text_sha256")
    rows = docs.drop(*made).withColumn("text_sha256", F.sha2(F.encode(normal_text(F.col("text")), "UTF-8"), 256))
    rows = rows.join(F.broadcast(found) if few else found, F.unhex(rows["text_sha256"]) == found["_key"], "left").drop("_key")
    alone = F.col("group_size").isNull()
    rows = rows.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
    rows = rows.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def one_of_each(rows: DataFrame, *order: str) -> DataFrame:
    """Of rows of one text that repeat the owner's doc_id, ``kept`` stays true on one, the first in ``order``."""
    same = W.partitionBy("text_sha256", "doc_id").orderBy(*(order or [F.lit(1)]))
    return rows.withColumn("kept", F.col("kept") & (F.row_number().over(same) == 1))


def exact_dedup(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts, the one with the smallest doc_id; of rows that repeat it with other
    white space, the smallest text."""
    rows = exact_groups(packed(docs, "doc_id", "text"), budget).where("kept")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # then an owner is one row
        return unpacked(rows)
    return unpacked(one_of_each(rows, "text").where("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    thin = exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return one_of_each(thin)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
