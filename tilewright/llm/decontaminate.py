"""Benchmark decontamination by latent semantic retrieval.

The benchmark's passages are weighted by TF-IDF, with document frequencies counted over the whole
corpus, and a randomised SVD, whose products are formed in Spark tasks, gives their latent space. A
block of passages has as many dimensions as distinct passages, so none loses weight to the others.
Every window of every document is projected into it and compared with all passages by cosine;
candidates are then verified by the longest common subsequence of words, and by the passage's answer
where the subsequence alone does not settle the case, as with a paraphrase. Benchmarks are taken in
blocks of a bounded number of passages, so what goes to a task has a bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tilewright.session import materialise

_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_"
LEAKS = "doc_id long, item_id long, start long, cosine double, lcs_share double, answer_found boolean"


def plain_words(text: str) -> list[str]:
    """Lower-case words without outer punctuation; words of punctuation only are left out."""
    return [w for w in (p.strip(_MARKS).lower() for p in text.split()) if w]


@dataclass(frozen=True)
class LatentIndex:
    """Latent space and passages of one block of the benchmark."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    other_idf: float
    basis: np.ndarray
    passages: np.ndarray
    item_ids: list[int]
    items: list[list[str]]
    answers: list[list[str]]


class WordNumbers:
    """Vocabulary numbers of the words of texts, -1 for others; punctuation-only words are dropped.

    As ``plain_words``, but for all words of some texts at once: Python lowers a text as a whole, since what
    becomes of a letter depends on no other word, and Arrow parts, strips and looks up.
    """

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self._words = pa.array(sorted(vocabulary, key=vocabulary.__getitem__), pa.large_string())

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts one after the other, and how many each text has."""
        parts = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        words = pc.utf8_trim(parts.flatten(), characters=_MARKS)
        numbers = pc.index_in(words, value_set=self._words).fill_null(-1).to_numpy().astype(np.int32)
        owners = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
        some = pc.utf8_length(words).to_numpy() > 0
        return numbers[some], np.bincount(owners[some], minlength=len(texts))


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of ``vocabulary`` occurs, and the number of documents."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers(vocabulary)
        counts, n = np.zeros(size + 1, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                words, sizes = numbers.of([t or "" for t in batch.column(0).slice(at, 256).to_pylist()])
                inside = words >= 0
                pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes)[inside] * size + words[inside])
                counts[:size] += np.bincount(pairs % size, minlength=size)
            n += batch.num_rows
        counts[size] = n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, dtype=np.int64)
    for r in rows:
        out[r.word] = r.n
    return out[:size], int(out[size])


def _weighted(words: list[str], vocabulary: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.unique([vocabulary[w] for w in words if w in vocabulary], return_counts=True)
    terms = terms.astype(np.int64)
    values = counts * idf[terms] if len(terms) else np.zeros(0)
    norm = np.linalg.norm(values)
    return terms, values / norm if norm else values


def randomised_svd(passages: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, rank: int, extra: int = 16, seed: int = 7) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of ``passages`` (column ``text``).

    With a random matrix R of ``rank + extra`` columns, drawn alike in every task from the seed, the
    tasks sum A'(AR), whose columns span the range, and then (AQ)'(AQ) for its basis Q. Only these
    sums, bounded by the vocabulary of a block and the rank, are brought together.
    """
    size, width = len(vocabulary), min(rank + extra, len(vocabulary))

    def range_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed).standard_normal((size, width))
        total = np.zeros((size, width))
        for batch in batches:
            for text in batch.column(0):
                terms, values = _weighted(plain_words(text.as_py() or ""), vocabulary, idf)
                total[terms] += np.outer(values, values @ draw[terms])
        rows = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(list(total[rows]), pa.list_(pa.float64()))], names=["word", "part"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"word": [key[0]], "part": [np.sum(rows["part"].tolist(), axis=0)]})

    source = passages.select("text")
    spread = source.mapInArrow(range_part, "word long, part array<double>").groupBy("word").applyInPandas(add, "word long, part array<double>")
    sketch = np.zeros((size, width))
    for r in spread.collect():
        sketch[r.word] = r.part
    basis, _ = np.linalg.qr(sketch)

    def gram_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for text in batch.column(0):
                terms, values = _weighted(plain_words(text.as_py() or ""), vocabulary, idf)
                row = values @ basis[terms]
                total += np.outer(row, row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["word", "part"])

    gram = np.zeros((width, width))
    for r in source.mapInArrow(gram_part, "word long, part array<double>").groupBy("word").applyInPandas(add, "word long, part array<double>").collect():
        gram[r.word] = r.part
    values, vectors = np.linalg.eigh(gram)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    return basis @ vectors[:, keep]


def build_index(docs: DataFrame, block: DataFrame, rank: int | None = None, answer_words: int = 5, has_answer: bool = False) -> LatentIndex | None:
    """Index one block of the benchmark; None if it has no words. ``block`` is stored and bounded.

    Without a ``rank`` the latent space holds every passage whole. A smaller one leaves out part of each
    passage, the more the more passages there are, and copies fall below the cut on the cosine.
    """
    rows = sorted(block.collect(), key=lambda r: (r.item_id, r.text))
    words = [plain_words(r.text) for r in rows]
    rows, words = zip(*[(r, w) for r, w in zip(rows, words) if w]) if any(words) else ((), ())
    if not rows:
        return None
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    counts, n = document_frequencies(docs, vocabulary)
    idf = np.log((n + 1) / (counts + 1)) + 0.05
    basis = randomised_svd(block, vocabulary, idf, min(rank or len(rows), len({tuple(w) for w in words})))
    passages = []
    for ws in words:
        terms, values = _weighted(ws, vocabulary, idf)
        at = values @ basis[terms]
        passages.append(at / max(np.linalg.norm(at), 1e-12))
    used = np.array([vocabulary[w] for ws in words for w in ws])
    answers = [plain_words(r.answer or "") if has_answer else ws[-answer_words:] for r, ws in zip(rows, words)]
    return LatentIndex(
        vocabulary, idf, float(idf[used].mean()), (basis * idf[:, None]).astype(np.float32), np.array(passages, dtype=np.float32),
        [r.item_id for r in rows], [list(w) for w in words], answers)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine-integer row at a time."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def leaks(
    docs: DataFrame, index: LatentIndex, block: int = 24, cosine: float = 0.35, certain: float = 0.8, likely: float = 0.6
) -> DataFrame:
    """``doc_id, item_id, start, cosine, lcs_share, answer_found`` of documents that hold a passage.

    Windows are two blocks of ``block`` words, one block apart, over the whole text. A candidate is
    verified against its window and the passage's length on either side: it is a leak if the common
    subsequence covers ``certain`` of the passage, or ``likely`` of it and most of the answer. Per
    row of ``docs`` and item the best window is reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers(index.vocabulary)
        square = np.append(index.idf, index.other_idf).astype(np.float32) ** 2
        queries = np.ascontiguousarray(index.passages.T)
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _search(part, numbers, square, queries, rows)
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start", "cosine", "lcs_share", "answer_found"])

    def _search(part: pa.RecordBatch, numbers: WordNumbers, square: np.ndarray, queries: np.ndarray, rows: list[tuple]) -> None:
        every, counts = numbers.of([t or "" for t in part.column(1).to_pylist()])
        found = np.split(every, np.cumsum(counts)[:-1])
        ids = part.column(0).to_pylist()
        lo = 0
        while lo < len(found):
            # documents are taken together up to a number of words, a longer one alone
            hi, total = lo, 0
            while hi < len(found) and (hi == lo or total + len(found[hi]) <= 100_000):
                total += len(found[hi])
                hi += 1
            words = found[lo:hi]
            sizes = np.array([len(w) for w in words])
            blocks = -(-sizes // block)
            total_blocks = int(blocks.sum())
            first_doc, lo = lo, hi
            if not total_blocks:
                continue
            flat = np.concatenate(words)
            owners = np.repeat(np.arange(len(words)), blocks)
            inner = (np.arange(total_blocks) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
            starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + inner
            last = np.append(owners[1:] != owners[:-1], True)
            weight = np.add.reduceat(square[flat], starts)
            latent = np.zeros((total_blocks, index.basis.shape[1]), dtype=np.float32)
            inside = np.flatnonzero(flat >= 0)
            if len(inside):
                owner = np.repeat(np.arange(total_blocks), np.diff(np.append(starts, len(flat))))[inside]
                cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                latent[owner[cut]] = np.add.reduceat(index.basis[flat[inside]], cut, axis=0)
            latent[:-1] += np.where(last[:-1, None], 0, latent[1:])
            weight = weight + np.where(last, 0, np.append(weight[1:], 0))
            # No cosine exceeds the share of the window that lies in the latent space.
            able = np.flatnonzero(np.einsum("ij,ij->i", latent, latent) >= cosine**2 * weight)
            if not len(able):
                continue
            score = latent[able] @ queries
            score /= np.sqrt(np.maximum(weight[able], 1e-12))[:, None]
            best: dict = {}
            for w, i in zip(*np.nonzero(score >= cosine)):
                k, s = first_doc + int(owners[able[w]]), int(inner[able[w]])
                item = index.items[i]
                mine = found[k][max(0, s - len(item)):s + 2 * block + len(item)].tolist()
                wanted = [index.vocabulary[x] for x in item]
                share = common_subsequence(wanted, mine) / len(wanted)
                if share < likely:
                    continue
                answer = [index.vocabulary.get(x, -3) for x in index.answers[i]]
                told = bool(answer) and common_subsequence(answer, mine) >= math.ceil(0.8 * len(answer))
                if share >= certain or told:
                    key = (k, i)
                    value = (share, float(score[w, i]), -s, told)
                    if key not in best or value > best[key]:
                        best[key] = value
            for (k, i), (share, cos, s, told) in sorted(best.items()):
                rows.append((ids[k], index.item_ids[i], -s, round(cos, 6), round(share, 6), told))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = 256, **options) -> DataFrame:
    """Leaks of all benchmark passages, in blocks of about ``block_items`` passages.

    A column ``answer`` of the benchmark is used if there is one; else the last words of a passage are
    its answer. Null or empty passages match nothing, null or empty texts hold nothing; repeated rows
    and null ids are reported as they come. Not lazy: frequencies and the SVD are computed at once.
    """
    has_answer = "answer" in benchmark.columns
    columns = [F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")]
    items = materialise(benchmark.select(*columns, *([F.col("answer").cast("string").alias("answer")] if has_answer else [])).filter("text is not null"), "items")
    blocks = max(1, math.ceil(items.count() / block_items))
    out = None
    for i in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i)
        index = build_index(docs, block, has_answer=has_answer)
        if index is not None:
            part = leaks(docs, index, **options)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose id has a leak; rows without an id are judged by their text alone."""
    hits = find_leaks(docs, benchmark, **options)
    named = docs.join(hits.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti")
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return named
    keyed = nameless.withColumn("doc_id", F.xxhash64("text"))
    bad = find_leaks(keyed, benchmark, **options).select(F.col("doc_id").alias("__key")).distinct()
    clean = nameless.join(bad, F.xxhash64("text") == F.col("__key"), "left_anti")
    return named.filter("doc_id is not null").unionByName(clean)
