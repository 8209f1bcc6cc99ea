"""Substring deduplication with compressed FM-indexes over shards.

Words covered by a window of ``width`` words that also starts in an earlier document are removed. The
steps:

1. Every document is cut into runs of windows that share their smallest ``gram``-word hash (their
   anchor). Equal windows have equal anchors, so an anchor seen in one document only needs no search.
2. Runs with a shared anchor are the text to index. Equal runs are one entry with its first and last
   document, so what a third of the documents share is indexed once.
3. Entries go to shards by anchor, so equal windows meet in one shard. An anchor with very many
   different runs is dealt out by window instead. Each shard gets an FM-index: suffix array,
   Burrows-Wheeler transform and a wavelet matrix of packed bits with counts. The shard's entries are
   streamed against it; backward search gives, up to the width, how far each place matches, and the
   places whose match reaches the width report the first document of their suffix interval.
4. The reports go back to all runs, and the covered words are removed in one pass over the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.session import materialise, shuffle_width

#: Words of the hash that decides a window's anchor.
GRAM = 5
#: Different runs of one anchor beyond which they are dealt out by window.
CROWDED = 20_000
#: Words that one shard indexes, on average.
SHARD_WORDS = 400_000
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHashes:
    """64-bit hashes of all words of a byte string at once, from a polynomial over its bytes.

    Powers of an odd number have inverses modulo 2^64, so the sum over a word is brought to the same
    power wherever the word stands. Equal words have equal hashes.
    """

    def __init__(self) -> None:
        self._letters = np.random.default_rng(11).integers(0, 1 << 64, size=256, dtype=np.uint64)
        self._white = np.zeros(256, dtype=bool)
        self._white[[9, 10, 11, 12, 13, 32]] = True
        self._up = self._down = np.zeros(0, dtype=np.uint64)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words."""
        data = np.frombuffer(text, dtype=np.uint8)
        if len(data) >= len(self._up):
            n = 2 * len(data) + 1
            self._up = np.cumprod(np.full(n, _ODD, dtype=np.uint64))
            self._down = np.cumprod(np.full(n, pow(_ODD, -1, 1 << 64), dtype=np.uint64))
        edge = np.diff(np.concatenate([[True], self._white[data], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._letters[data] * self._up[:len(data)], out=sums[1:])
        values = (sums[ends] - sums[starts]) * self._down[starts]
        return _mix(values + (ends - starts).astype(np.uint64)), starts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def runs_of(hashes: np.ndarray, windows: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and number of windows of each run.

    ``hashes`` are those of several documents one after the other; ``windows`` are the starts of the
    windows that lie in one document. A run ends where its document's windows end.
    """
    grams = np.zeros(len(hashes) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(_ODD) + hashes[j:j + len(grams)]
    grams = _mix(grams)
    n = len(hashes) - width + 1
    low, best = grams[:n].copy(), np.arange(n)
    for j in range(1, width - gram + 1):
        less = grams[j:j + n] < low
        np.copyto(low, grams[j:j + n], where=less)
        np.copyto(best, np.arange(j, j + n), where=less)
    low, best = low[windows], best[windows]
    cut = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (windows[1:] != windows[:-1] + 1)])
    count = np.diff(np.r_[cut, len(windows)])
    start = windows[cut]
    content = np.zeros(len(start), dtype=np.uint64)
    for j in range(width):
        content = content * np.uint64(_ODD) + hashes[start + j]
    for j in range(width, width + int(count.max()) - 1):
        more = np.flatnonzero(j < count + width - 1)
        content[more] = content[more] * np.uint64(_ODD) + hashes[start[more] + j]
    return low[cut].view(np.int64), _mix(content + count.astype(np.uint64)).view(np.int64), start, count


def find_runs(docs: DataFrame, width: int) -> DataFrame:
    """``anchor, run, doc_id, place``; ``place`` holds 20 bits of the text's key, the first window and the number of windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts: list[list[np.ndarray]] = []
            texts: list[bytes] = []

            def flush(upto: int) -> None:
                """Runs of the documents gathered, the last of which is row ``upto - 1``."""
                hashes, starts = hashed.of(b"\n".join(texts))
                offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
                owner = np.searchsorted(offsets, starts, side="right") - 1
                sizes = np.bincount(owner, minlength=len(texts))
                heads = np.cumsum(sizes) - sizes
                inside = np.arange(len(hashes))
                windows = inside[inside - heads[owner] <= sizes[owner] - width]
                if len(windows):
                    anchor, run, start, count = runs_of(hashes, windows, width)
                    mine = owner[start]
                    row = mine + (upto - len(texts))
                    parts.append([anchor, run, ids[row], (keys[row] << 43) | ((start - heads[mine]) << 8) | count])
                texts.clear()

            pending = 0
            for i, text in enumerate(batch.column(2)):
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                pending += len(texts[-1])
                if pending > 500_000:
                    flush(i + 1)
                    pending = 0
            if texts:
                flush(batch.num_rows)
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "run", "doc_id", "place"])

    return docs.mapInArrow(cut, "anchor long, run long, doc_id long, place long")


def _text_key() -> Column:
    """20 bits that tell apart rows with one id and different texts."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 20))


class WaveletMatrix:
    """Rank queries over a sequence of numbers: one packed bit vector with word counts per level."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, dtype=np.uint8)
            padded[:len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, len(ones) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])
        self.heads: dict[int, int] = {}

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        lo = np.zeros(len(at), dtype=np.int64)
        hi = at.copy()
        both = np.stack([lo, hi])
        top = len(self.levels) - 1
        for k, (packed, before, zeros) in enumerate(self.levels):
            word = both >> 6
            below = packed[word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[word] + np.bitwise_count(below)
            both = np.where((symbols >> (top - k) & 1).astype(bool)[None, :], zeros + ones, both - ones)
        return both[1] - both[0]


class FMIndex:
    """Backward search over entries of words. Every entry ends in a separator of its own."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, documents: np.ndarray, size: int) -> None:
        """``words`` are numbers from one up to ``size``, cut into entries of ``sizes``, each with its first document."""
        n_entries = len(sizes)
        total = len(words) + n_entries
        owner = np.repeat(np.arange(n_entries), sizes + 1)
        text = np.zeros(total, dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(total, dtype=bool)
        inner[ends] = False
        text[inner] = words
        self.starts = ends - sizes
        # Separators sort below all words, each apart, so no comparison goes beyond its entry.
        rank = np.where(inner, text + n_entries, owner)
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            after = np.zeros(total, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            pair = rank * (total + n_entries + size + 2) + after
            order = np.argsort(pair, kind="stable")
            ranked = pair[order]
            fresh = np.r_[True, ranked[1:] != ranked[:-1]]
            rank = np.empty(total, dtype=np.int64)
            rank[order] = np.cumsum(fresh) - 1
            step *= 2
            if fresh.all() or step >= total:
                break
        self.text, self.size = text, size
        self.documents = documents[owner[order]]
        self.below = n_entries + np.concatenate([[0], np.cumsum(np.bincount(text[inner], minlength=size + 1)[1:])])
        self.bwt = WaveletMatrix(text[order - 1], size + 1)

    def match(self, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns that end at ``places``, read backwards up to ``width`` words.

        Gives how many words match and the suffix interval of the match. The patterns come from the
        text, so one that is found only once is found where it stands, and is not read further.
        """
        symbol = self.text[places]
        lo, hi = self.below[symbol - 1], self.below[symbol]
        length = (hi > lo).astype(np.int64)
        for t in range(1, width):
            live = np.flatnonzero((length == t) & (hi - lo > 1))
            if not len(live):
                break
            symbol = self.text[places[live] - t]
            base = self.below[symbol - 1]
            ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            new_lo, new_hi = base + ranks[:len(live)], base + ranks[len(live):]
            found = new_hi > new_lo
            went = live[found]
            lo[went], hi[went] = new_lo[found], new_hi[found]
            length[went] = t + 1
        return np.where(hi - lo == 1, width, length), lo, hi

    def first_documents(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document of each suffix interval; intervals of several places are equal or apart."""
        out = self.documents[lo]
        many = np.flatnonzero(hi - lo > 1)
        if len(many):
            starts, back = np.unique(lo[many], return_inverse=True)
            ends = np.zeros(len(starts), dtype=np.int64)
            ends[back] = hi[many]
            padded = np.append(self.documents, np.iinfo(np.int64).max)
            cuts = np.stack([starts, ends], axis=1).ravel()
            out[many] = np.minimum.reduceat(padded, cuts)[::2][back]
        return out


class _Numbers(dict):
    """Numbers from one for words as they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def _search_shard(shard: pa.Table, width: int) -> pa.RecordBatch:
    """Index a shard and stream its entries against it: first documents of the windows of each entry."""
    shard = shard.combine_chunks()
    numbers = _Numbers()
    split = [words_of(t) for t in shard.column("segment").to_pylist()]
    sizes = np.array([len(w) for w in split])
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
    index = FMIndex(flat, sizes, shard.column("first").to_numpy(), len(numbers))
    counts = sizes - width + 1
    ends = np.cumsum(counts)
    heads = np.repeat(index.starts - (ends - counts), counts)
    length, lo, hi = index.match(heads + np.arange(int(ends[-1])) + width - 1, width)
    first = np.full(len(length), np.iinfo(np.int64).max)
    reached = length >= width
    first[reached] = index.first_documents(lo[reached], hi[reached])
    last = np.repeat(shard.column("last").to_numpy(), counts)
    hit = np.flatnonzero(np.add.reduceat((first < last).astype(np.int64), ends - counts) > 0)
    offsets = np.cumsum(np.r_[0, counts[hit]])
    inner = np.arange(int(offsets[-1])) + np.repeat((ends - counts)[hit] - offsets[:-1], counts[hit])
    firsts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(first[inner], pa.int64()))
    kept = shard.select(["anchor", "run", "shift"]).take(pa.array(hit))
    return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in kept.columns], firsts], names=["anchor", "run", "shift", "firsts"])


def search_shards(entries: DataFrame, shards: int, width: int) -> DataFrame:
    """``anchor, run, shift, firsts``: the first document of each window of entries that some document repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                if names[a] != shard and held:
                    yield _search_shard(pa.Table.from_batches(held), width)
                    held = []
                shard = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _search_shard(pa.Table.from_batches(held), width)

    width_now = min(shards, 4 * shuffle_width(entries.sparkSession))
    return entries.repartition(width_now, "shard").sortWithinPartitions("shard").mapInArrow(
        run, "anchor long, run long, shift int, firsts array<long>")


def repeated_windows(docs: DataFrame, width: int = 13) -> DataFrame:
    """``doc_id, key, start, mask``: bit j says that the window at ``start + j`` also starts in an earlier document.

    Rows without an id neither repeat anything nor are repeated.
    """
    source = docs.filter("doc_id is not null and text is not null").select("doc_id", _text_key().alias("key"), "text")
    same = W.partitionBy("anchor")
    shared = materialise(
        find_runs(source, width).withColumns({"lo": F.min("doc_id").over(same), "hi": F.max("doc_id").over(same)})
        .filter("lo < hi").drop("lo", "hi"), "runs")
    place = F.struct("doc_id", "place")
    entries = shared.groupBy("anchor", "run").agg(F.min(place).alias("at"), F.max("doc_id").alias("last"))
    wanted = (
        entries.select(F.col("at.doc_id").alias("doc"), F.shiftright(F.col("at.place"), 43).alias("doc_key"), F.struct("anchor", "run", "last", F.col("at.place").alias("place")).alias("e"))
        .groupBy("doc", "doc_key").agg(F.collect_list("e").alias("es"))
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "run", "first", "last", "segment"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, es in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = words_of(text.as_py())
                for e in es:
                    start, count = e["place"] >> 8 & 0x7FFFFFFFF, e["place"] & 0xFF
                    rows.append((e["anchor"], e["run"], doc, e["last"], b" ".join(words[start:start + count + width - 1]).decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()])], names=names)

    texts = source.join(wanted, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("doc_key"))).select("doc_id", "text", "es")
    cut = materialise(
        texts.mapInArrow(segments, "anchor long, run long, first long, last long, segment string"), "segments")
    words = cut.select(F.sum(F.length("segment"))).first()[0] or 0
    shards = max(1, -(-words // (6 * SHARD_WORDS)))
    crowded = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("anchor", F.lit(True).alias("crowded"))
    marked = cut.join(crowded, "anchor", "left")
    # ASCII white space parts the words and single blanks join them, so a blank is a word's end.
    parts = F.split("segment", " ")
    whole = F.array(F.struct(F.lit(0).alias("shift"), F.col("segment").alias("segment")))
    single = F.transform(F.sequence(F.lit(0), F.size(parts) - width), lambda i: F.struct(
        i.cast("int").alias("shift"), F.array_join(F.slice(parts, i + 1, F.lit(width)), " ").alias("segment")))
    dealt = marked.withColumn("e", F.explode(F.when(F.col("crowded"), single).otherwise(whole)))
    dealt = dealt.select(
        "anchor", "run", "e.shift", "first", "last", "e.segment",
        F.pmod(F.when(F.col("crowded"), F.xxhash64("e.segment")).otherwise(F.xxhash64("anchor")), F.lit(shards)).cast("int").alias("shard"))
    reports = search_shards(dealt, shards, width)
    joined = shared.join(reports, ["anchor", "run"])
    bits = F.aggregate(
        F.transform("firsts", lambda f, j: F.when(f < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), j)).otherwise(F.lit(0))),
        F.lit(0), lambda a, b: a.bitwiseOR(b))
    return joined.select(
        "doc_id", F.shiftright(F.col("place"), 43).alias("key"),
        (F.shiftright(F.col("place"), 8).bitwiseAND(F.lit(0x7FFFFFFFF)) + F.col("shift")).alias("start"), bits.alias("mask")).filter("mask <> 0")


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text`` of every row of ``docs``.

    Words are parted by ASCII white space and compared as they are. A word goes if a window of
    ``width`` words that covers it also starts in a document with a smaller id; windows are judged on
    the input. A null text has no words. Rows with a null id keep their words. Rows that repeat one id
    and text are one document. Not lazy: steps are stored in the shared folder.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = repeated_windows(base, width).groupBy(F.col("doc_id").alias("doc"), F.col("key").alias("doc_key")).agg(
        F.collect_list(F.struct("start", "mask")).alias("hits"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py() or "")
                total = len(words)
                if found.is_valid:
                    edge = np.zeros(total + 1, dtype=np.int64)
                    for h in found.as_py():
                        for j in range(h["mask"].bit_length()):
                            if h["mask"] >> j & 1:
                                edge[h["start"] + j] += 1
                                edge[h["start"] + j + width] -= 1
                    stays = np.cumsum(edge[:total]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                left = b" ".join(words)
                rows.append((total, total - len(words), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if with_text else None))
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    both = base.join(hits, (F.col("doc_id") == F.col("doc")) & (_text_key() == F.col("doc_key")), "left")
    out = both.select("doc_id", "text", "hits").mapInArrow(
        keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
