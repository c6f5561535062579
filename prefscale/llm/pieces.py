"""SentencePiece encoding and decoding by N-best segmentation.

A text, with spaces as U+2581 and one put before it, is segmented into pieces of a public vocabulary so that the sum of
their scores is largest. No piece goes on past the end of a word, and some characters are in no piece but their own, so
the lattice of a text falls apart into short chunks whose best segmentations are found once and remembered. For a chunk,
a forward Viterbi pass gives the best score up to each position; these scores are the exact heuristic of an A-star
search from the end, which yields segmentations in falling order of score. The N best of a text combine its chunks'.

A character without a piece becomes its UTF-8 bytes, as does U+2581 itself, so decoding gives the text back exactly.
The vocabulary travels as a broadcast of fixed size. Texts are encoded whole. Equal scores go to the segmentation that
the search meets first, the same in every run.

Defined results: null and empty texts have no pieces, the score 0 and no runner-up; every row gives one row.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscale.llm.text import giving_back
from prefscale.session import ship, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segmentations of a text; those of the query.
N_BEST, N_BEST_QUERY = 2, 4
#: Chunks that a worker remembers at most, with their best segmentation and with their N best, and the longest of them.
REMEMBERED, SEARCHED, LONGEST = 100_000, 25_000, 40
#: Texts, and characters of texts, that are encoded together at most.
TOGETHER, TOGETHER_CHARS = 1_000, 300_000
#: How far below the lowest score of any piece a character without one is scored.
UNKNOWN = 10.0


class PieceCodec:
    """Segments and joins texts with the pieces of a vocabulary: lists of pieces, scores and kinds by id."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], n_best: int = N_BEST):
        plain = {p: i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values() and p}
        self.ids, self.n_best, self.byte_ids = plain, n_best, byte_ids
        self.scores = {p: float(scores[i]) for p, i in plain.items()}
        # the least score of a letter; pieces of spaces alone have scores of their own kind
        self.unknown = min((s for p, s in self.scores.items() if len(p) == 1 and p != SPACE), default=0.0) - UNKNOWN
        self.steps: dict[str, tuple[float, list[int]] | None] = {p[:n]: None for p in plain for n in range(1, len(p))}
        self.steps |= {p: (self.scores[p], [i]) for p, i in plain.items()}
        self.bigrams = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.bytes_of = [b""] * len(pieces)
        for p, i in plain.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for byte, i in byte_ids.items():
            self.bytes_of[i] = bytes([byte])
        joined = {c for p in plain if len(p) > 1 for c in p} - {SPACE}
        inner = any(SPACE in p.lstrip(SPACE) for p in plain)  # then words can't be cut apart
        letters = "".join(map(re.escape, sorted(joined)))
        self.chunks = re.compile(f"[{SPACE}{letters}]+|." if inner else f"{SPACE}*[{letters}]+|{SPACE}+|.", re.DOTALL)
        self.memory: dict[str, list[tuple[float, list[int]]]] = {}

    @classmethod
    def load(cls, model: str = MODEL, n_best: int = N_BEST) -> PieceCodec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in every]
        byte_ids = {int(pieces[i][3:5], 16): i for i in every if sp.is_byte(i)}
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in every], byte_ids, special, n_best)

    def as_bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def best_of(self, chunk: str) -> list[tuple[float, list[int]]]:
        """The best segmentations of a chunk: (score, ids), best first, at most n_best."""
        bigrams = self.bigrams
        edges = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in bigrams]
        if edges:  # two characters that no piece holds together: the lattice falls apart there
            get, search = self.memory.get, self.search
            parts = [get(c) or search(c) for c in (chunk[a:b] for a, b in zip([0, *edges], [*edges, len(chunk)], strict=True))]
            found = self.combined(parts)
        else:
            found = self.search(chunk)
        return self.remember(chunk, found)

    def remember(self, chunk: str, found: list) -> list:
        if len(chunk) <= LONGEST:
            if len(self.memory) >= SEARCHED:
                self.memory.clear()
            self.memory[chunk] = found
        return found

    def search(self, chunk: str) -> list[tuple[float, list[int]]]:
        """Forward Viterbi scores, then A-star from the end with them as the exact cost to come."""
        steps, n = self.steps, len(chunk)
        forward = [0.0] + [-np.inf] * n
        into: list[list] = [[] for _ in range(n + 1)]
        for start in range(n):
            base = forward[start]
            step = steps.get(chunk[start], False)
            if not step:
                step = (self.unknown, self.as_bytes(chunk[start]))
            end = start + 1
            while True:
                if step:
                    into[end].append((start, step[0], step[1]))
                    if base + step[0] > forward[end]:
                        forward[end] = base + step[0]
                end += 1
                if end > n:
                    break
                step = steps.get(chunk[start:end], False)
                if step is False:
                    break
        found, turn = [], 0
        push, pop = heapq.heappush, heapq.heappop
        agenda = [(-forward[n], 0, n, 0.0, None)]
        while agenda:
            cost, _, at, behind, path = pop(agenda)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((-cost, ids))
                if len(found) == self.n_best:
                    break
                continue
            for start, score, ids in into[at]:
                turn -= 1  # of equal scores, the shortest last piece goes first
                push(agenda, (-(forward[start] + score + behind), turn, start, score + behind, (ids, path)))
        return self.remember(chunk, found)

    def nbest(self, text: str | None) -> list[tuple[float, list[int]]]:
        """The best segmentations of a text: (score, ids), best first."""
        if not text:
            return [(0.0, [])]
        parts: list[list[tuple[float, list[int]]]] = []
        for number, plain in enumerate(text.split(SPACE)):
            if number:
                parts.append([(self.unknown, [self.byte_ids[b] for b in SPACE.encode()])])
            if plain or not number:
                line = plain.replace(" ", SPACE)
                get, best_of = self.memory.get, self.best_of
                parts.extend([get(c) or best_of(c) for c in self.chunks.findall(line if number else SPACE + line)])
        return self.combined(parts)

    def combined(self, parts: list[list[tuple[float, list[int]]]]) -> list[tuple[float, list[int]]]:
        """The best segmentations of chunks that follow each other."""
        total = sum([p[0][0] for p in parts])
        first = list(chain.from_iterable([p[0][1] for p in parts]))
        cheap = heapq.nsmallest(self.n_best - 1, ((p[0][0] - p[1][0], i) for i, p in enumerate(parts) if len(p) > 1)) if self.n_best > 1 else []
        more = swaps([(i, parts[i]) for _, i in cheap], self.n_best)
        return [(total, first), *[(total - loss, list(chain.from_iterable(p[swap.get(i, 0)][1] for i, p in enumerate(parts)))) for loss, swap in more]]

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


def swaps(parts: list[tuple[int, list[tuple[float, list[int]]]]], n_best: int) -> list[tuple[float, dict[int, int]]]:
    """What follows the best: (loss, {chunk: its k-th segmentation}), cheapest first, at most n_best - 1. Of the chunks of
    a text only the n_best - 1 whose second segmentation costs least can be in it, so only those are given."""
    choices: list[tuple[float, tuple]] = [(0.0, ())]
    for i, found in parts:
        more = [(loss + found[0][0] - score, (*chosen, (i, k))) for loss, chosen in choices for k, (score, _) in enumerate(found)]
        choices = heapq.nsmallest(n_best, more)
    out = [(loss, {i: k for i, k in chosen if k}) for loss, chosen in choices]
    return [x for x in out if x[1]][: n_best - 1]


class Speller:
    """Texts of pieces, by gathering their bytes."""

    def __init__(self, bytes_of: list[bytes]):
        self.byte_sizes = np.array([len(b) for b in bytes_of], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.all_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        size = self.byte_sizes[ids]
        ends = np.cumsum(size)
        spots = np.repeat(self.byte_starts[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.all_bytes[spots].tobytes().decode("utf-8", "replace")[1:]


class BatchCoder:
    """The best segmentations of many texts at once.

    The chunks that are new in a batch are laid out as rows of code points. All their substrings are looked up by
    rolling hash, and the forward pass runs over all rows position by position. As its scores are the exact scores to
    come, the first thing that A-star finds from the end is the path of no loss, which is walked for all rows together;
    the least loss among the branches that it passes is that of the chunk's second segmentation. For more than one
    segmentation, the chunks of a text that cost least to change go to the codec's A-star search with its agenda, whose
    N best are remembered by chunk, and the text's N best are put together from them.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        pieces = list(codec.ids)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.piece_ids = np.array([codec.ids[p] for p in pieces], np.int64)[order]
        self.piece_scores = np.array([codec.scores[p] for p in pieces])[order]
        self.widths = sorted({len(p) for p in pieces})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.best, self.loss = np.zeros(0), np.zeros(0)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def learn(self, chunks: list[str]) -> None:
        """Segments chunks and appends them to what is known."""
        chunks.sort(key=len)
        ids, counts, best, loss = [self.ids], [self.counts], [self.best], [self.loss]
        at = 0
        while at < len(chunks):
            widest = len(chunks[at]) + 2
            end = at
            while end < len(chunks) and end - at < 4096 and len(chunks[end]) <= widest:
                end += 1
            if widest > LONGEST:  # rare, and of any length
                found = [self.codec.best_of(c) for c in chunks[at:end]]
                ids += [np.array(f[0][1], np.int32) for f in found]
                counts.append(np.array([len(f[0][1]) for f in found], np.int64))
                best.append(np.array([f[0][0] for f in found]))
                loss.append(np.array([f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in found]))
            else:
                for total, more in zip((ids, counts, best, loss), self._segment(chunks[at:end]), strict=True):
                    total.append(more)
            at = end
        for c in chunks:
            self.known[c] = len(self.known)
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.best, self.loss = np.concatenate(best), np.concatenate(loss)
        self.starts = np.cumsum(self.counts) - self.counts

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after another, number of ids, best score, runner-up's loss) of chunks of about one length."""
        size = np.array([len(c) for c in chunks])
        n, width = len(chunks), int(size.max())
        points = np.frombuffer("".join([c.ljust(width, "\0") for c in chunks]).encode("utf-32-le"), np.uint32).reshape(n, width)
        prefix = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * self.BASE + points[:, j] + np.uint64(1)
        widths = [w for w in self.widths if w <= width]
        score = np.full((len(widths), n, width + 1), -np.inf)
        which = np.zeros((len(widths), n, width + 1), np.int32)
        for k, w in enumerate(widths):
            power = np.uint64(pow(int(self.BASE), w, 1 << 64))
            h = prefix[:, w:] - prefix[:, :-w] * power
            spot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[spot] == h
            score[k, :, w:] = np.where(hit, self.piece_scores[spot], -np.inf)
            which[k, :, w:] = np.where(hit, self.piece_ids[spot], 0)
            if w == 1:  # characters without a piece, by their code point
                score[k, :, 1:][~hit] = self.codec.unknown
                which[k, :, 1:] = np.where(hit, which[k, :, 1:], -1 - points.astype(np.int64))
        forward = np.full((n, width + 1), -np.inf)
        forward[:, 0] = 0
        for j in range(1, width + 1):
            for k, w in enumerate(widths):
                if w <= j:
                    np.maximum(forward[:, j], forward[:, j - w] + score[k, :, j], out=forward[:, j])
        rows, steps = np.arange(n), np.array(widths)
        at, loss = size.copy(), np.full(n, np.inf)
        taken = []
        while True:
            live = np.flatnonzero(at)
            if not len(live):
                break
            here = at[live]
            back = here[None, :] - steps[:, None]
            cost = forward[live, here] - (forward[live, np.maximum(back, 0)] + score[:, live, here])
            cost[back < 0] = np.inf
            pick = cost.argmin(0)
            lanes = np.arange(len(live))
            cost[pick, lanes] = np.inf
            loss[live] = np.minimum(loss[live], cost.min(0))
            ids = np.full(n, np.iinfo(np.int32).min, np.int32)
            ids[live] = which[pick, live, here]
            taken.append(ids)
            at[live] -= steps[pick]
        grid = np.stack(taken[::-1], 1)  # first piece last found; rows of fewer pieces begin with gaps
        flat = grid[grid > np.iinfo(np.int32).min]
        counts = (grid > np.iinfo(np.int32).min).sum(1)
        if (flat < 0).any():
            spelled = [self.codec.as_bytes(chr(-1 - x)) if x < 0 else [x] for x in flat.tolist()]
            owner = np.repeat(rows, counts)
            counts = np.bincount(np.repeat(owner, [len(x) for x in spelled]), minlength=n)
            flat = np.array(list(chain.from_iterable(spelled)), np.int32)
        return flat, counts, forward[rows, size], loss

    def encode(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """The best segmentations of each text: (score, ids), best first, at most the codec's n_best."""
        if len(self.known) > REMEMBERED:
            self.forget()
        find, get = self.codec.chunks.findall, self.known.get
        parts: list[list[str]] = []
        for text in texts:
            whole = SPACE + text.replace(" ", SPACE) if text else ""
            # a text's own U+2581 is no space, but spelled in bytes: such texts take the plain way below
            parts.append(find(whole) if SPACE not in text else [])
        flat = list(chain.from_iterable(parts))
        codes = np.fromiter((get(c, -1) for c in flat), np.int64, len(flat))
        new = np.flatnonzero(codes < 0)
        if len(new):
            self.learn(list({flat[i] for i in new}))
            codes[new] = [self.known[flat[i]] for i in new]
        per_word = self.counts[codes]
        ends = np.cumsum(per_word)
        ids = self.ids[np.repeat(self.starts[codes] - (ends - per_word), per_word) + np.arange(ends[-1])] if len(codes) else self.ids[:0]
        out, word = [], 0
        for text, own in zip(texts, parts, strict=True):
            if not own:
                out.append([(score, np.array(x, np.int32)) for score, x in self.codec.nbest(text)])
                continue
            stop = word + len(own)
            bounds = np.r_[ends[word] - per_word[word], ends[word:stop]]
            score = float(self.best[codes[word:stop]].sum())
            out.append([(score, ids[bounds[0] : bounds[-1]]), *self.runners_up(own, self.loss[codes[word:stop]], score, ids, bounds)])
            word = stop
        return out

    def runners_up(self, chunks: list[str], loss: np.ndarray, score: float, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """What follows a text's best segmentation, whose chunks' ids lie between ``bounds``."""
        more = self.codec.n_best - 1
        if not more:
            return []
        cheap = np.flatnonzero(loss <= (np.partition(loss, more - 1)[more - 1] if more < len(loss) else np.inf))
        cheap = cheap[np.isfinite(loss[cheap])]
        cheap = cheap[np.argsort(loss[cheap], kind="stable")][:more].tolist()
        get, best_of, found = self.codec.memory.get, self.codec.best_of, {}
        for i in cheap:
            found[i] = get(chunks[i]) or best_of(chunks[i])
        out = []
        for lost, swap in swaps([(i, found[i]) for i in cheap], self.codec.n_best):
            at, pieces = bounds[0], []
            for i in sorted(swap):
                pieces += [ids[at : bounds[i]], np.array(found[i][swap[i]][1], np.int32)]
                at = bounds[i + 1]
            out.append((score - lost, np.concatenate([*pieces, ids[at : bounds[-1]]])))
        return out


def coder_of(broadcast) -> BatchCoder:
    """The worker's coder: made once from the broadcast vocabulary and kept with it."""
    codec = broadcast.value
    if not hasattr(codec, "coder"):
        codec.coder = BatchCoder(codec)
    return codec.coder


MADE = "pieces array<int>, n_pieces long, piece_score double, runner_up double, alternatives array<struct<score:double,pieces:array<int>>>"


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def encode_texts(docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, decode: bool = False) -> DataFrame:
    """``docs`` with pieces (ids), n_pieces and piece_score of the best segmentation, runner_up (score of the second) and
    alternatives (score and pieces of the second to the ``n_best``-th, fewer if there are no more), and, if asked for,
    decoded (what the pieces stand for, so that a round trip takes one Python worker); other columns stay, those of the
    same names are replaced. A task holds the pieces of some texts at a time, not of a whole batch."""
    spark = docs.sparkSession
    ship(spark)
    codec = spark.sparkContext.broadcast(PieceCodec.load(model, n_best))  # as large as the vocabulary
    fields = T.StructType.fromDDL(f"{MADE}, decoded string" if decode else MADE).fields
    made = [f.name for f in fields]
    rows = docs.drop(*made)
    schema = T.StructType([*rows.schema.fields, *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(codec)
        speller = Speller(codec.value.bytes_of) if decode else None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, TOGETHER)
                texts, held = [], 0
                for text in some.column("text"):
                    texts.append(text.as_py() or "")
                    held += len(texts[-1])
                    if held >= TOGETHER_CHARS:
                        break
                got = coder.encode(texts)
                more = [x for g in got for x in g[1:]]
                others = pa.StructArray.from_arrays([pa.array([x[0] for x in more], pa.float64()), lists([x[1] for x in more])], ["score", "pieces"])
                ends = np.cumsum([0, *(len(g) - 1 for g in got)], dtype=np.int32)
                new = [lists([g[0][1] for g in got]), pa.array([len(g[0][1]) for g in got], pa.int64()), pa.array([g[0][0] for g in got], pa.float64())]
                new += [pa.array([g[1][0] if len(g) > 1 else None for g in got], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), others)]
                new += [pa.array([speller.decode(g[0][1]) for g in got], pa.string())] if speller else []
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, *new], [*batch.schema.names, *made])
                at += len(texts)

    return rows.mapInArrow(giving_back(work), schema)


def decode_pieces(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (pieces, ...) with ``decoded``: the text that the pieces stand for."""
    spark = rows.sparkSession
    ship(spark)
    spelled = spark.sparkContext.broadcast(PieceCodec.load(model).bytes_of)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        speller = Speller(spelled.value)
        for batch in batches:
            yield pd.Series([speller.decode(np.asarray(p)) for p in batch], dtype="object")

    return rows.withColumn("decoded", decode("pieces"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), n_best=N_BEST_QUERY, decode=True)
    return rows.select(
        "doc_id",
        "n_pieces",
        "piece_score",
        "runner_up",
        F.sha2(F.array_join(F.col("pieces").cast("array<string>"), " "), 256).alias("pieces_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        F.size("alternatives").alias("n_alternatives"),
        F.xxhash64("alternatives").alias("alternatives_hash"),  # scores and ids, without spelling them out
    )
