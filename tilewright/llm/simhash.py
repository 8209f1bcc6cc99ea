"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints within the allowed
distance, one segment differs in at most one bit. Each segment is indexed once per bit with that bit
struck out; two fingerprints that share such a variant meet in an equality join and are compared.
Equal fingerprints are one item with a weight, so copies never meet one by one, and dense groups are
joined without listing their pairs (``linking``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilewright.llm.linking import linked_groups
from tilewright.session import materialise

BITS = 64


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Bitwise majority over the XXH64 of all shingles of ``width`` words, repeats included.

    Only ASCII letters are lowered and only ASCII white space parts words. Fewer words than ``width``
    are one shingle; no words give zero.
    """
    words = _words(text)
    return majority(_hashes(words, width, seed)) if words else 0


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a sequence of ``width`` words or fewer is one shingle."""
    import xxhash

    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - width].tolist()]
    stops = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; a null or empty text has the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(max_distance: int) -> list[tuple[int, int]]:
    """Offset and width of the segments: just enough that one differs in at most one bit."""
    n = max_distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(offset: int, width: int) -> int:
    value = ((1 << width) - 1) << offset
    return value - (1 << 64) if value >= 1 << 63 else value


def variant_keys(fp: Column, max_distance: int) -> Column:
    """One key per segment and struck bit: the segment without that bit, with both numbers."""
    keys = []
    for i, (offset, width) in enumerate(segments(max_distance)):
        value = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            # the struck bit is closed up, so number, bit and rest fit one long for segments up to 50 bits
            high = F.shiftleft(F.shiftrightunsigned(value, bit + 1), bit)
            low = value.bitwiseAND(F.lit((1 << bit) - 1))
            keys.append(F.lit((i << 58) | (bit << 51)).bitwiseOR(high).bitwiseOR(low))
    return F.array(*keys)


def _near(max_distance: int):
    def near(a: str, b: str, key: Column) -> Column:
        return F.bit_count(F.col(f"{a}.id").bitwiseXOR(F.col(f"{b}.id"))) <= max_distance

    return near


def near_duplicates(docs: DataFrame, max_distance: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    Fingerprints link at ``max_distance`` or fewer differing bits; ``component_id`` is the smallest
    document id reachable. Documents without words share the fingerprint zero and are linked like any
    other. Repeated rows stay repeated; a null id keeps its row and never names a component unless the
    component has no other. No rows give no rows; other columns are ignored. Not lazy.
    """
    if not 2 <= max_distance <= 31:
        raise ValueError("max_distance must be between 2 and 31")
    marks = materialise(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    items = materialise(
        marks.groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("weight")), "items")
    grouped = materialise(linked_groups(
        items, lambda df: df.withColumn("key", F.explode(variant_keys(F.col("id"), max_distance))), _near(max_distance), []), "grouped")
    named = grouped.groupBy("component").agg(F.min("lowest").alias("component_id"))
    labels = grouped.join(named, "component").select(F.col("id").alias("fp"), "component_id")
    return marks.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each group the document with the smallest id stays.

    Rows that repeat one id and text are one document. Rows without an id cannot be named in a group
    and stay. All columns are kept as they are.
    """
    return _first_of_groups(docs, near_duplicates(docs, **options))


def _first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))


#: Bands and hashes a band of the MinHash signature: a pair of Jaccard 0.8 shares no band in 2 of 10,000 cases.
BANDS, ROWS = 16, 4


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of all shingles of ``width`` words, parted and lowered as in ``fingerprint``."""
    return np.unique(_hashes(_words(text), width, 42))


def _bands(hashes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One key per band: the least values of ``ROWS`` hash functions over all shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 4096):
        mixed = hashes[lo:lo + 4096, None] * odd + add
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


#: Two of so many parts of a fingerprint are a key: four differing bits leave two parts untouched.
PARTS = 6


def part_keys(fp: Column) -> Column:
    """One key per pair of the ``PARTS`` parts: fingerprints within ``PARTS - 2`` bits share one at least."""
    cuts = [BITS * i // PARTS for i in range(PARTS + 1)]
    pairs = [(i, j) for i in range(PARTS) for j in range(i)]
    masks = [_mask(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(masks[i])), fp.bitwiseAND(F.lit(masks[j]))) for n, (i, j) in enumerate(pairs)])


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, max_distance: int = PARTS - 2) -> DataFrame:
    """``doc_id, component_id`` of every row: documents linked at a Jaccard of ``similarity`` of their shingles.

    Candidates are documents whose SimHash fingerprints differ in at most ``max_distance`` bits, and, since
    pairs at the least similarity often differ in more, those that share a band of a MinHash signature; each is
    verified on the distinct shingles of both texts. Equal sequences of words are one item. Documents without
    words are one group. Not lazy.
    """
    if not 0 <= max_distance <= PARTS - 2:
        raise ValueError(f"max_distance must be between 0 and {PARTS - 2}")
    draw = np.random.default_rng(1)
    odd, add = (draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, fps, sizes, bands = [], [], [], []
            for t in batch.column(1):
                words = _words(t.as_py() or "")
                every = _hashes(words, width, 42)
                hashes = np.unique(every)
                ids.append(xxhash.xxh64_intdigest(b" ".join(words)))
                fps.append(majority(every) if words else 0)
                sizes.append(len(hashes))
                bands.append(_bands(hashes, odd, add))
            whole = [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (ids, fps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *whole, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), batch.column(1)],
                names=["doc_id", "id", "fp", "size", "bands", "text"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = materialise(source.mapInArrow(run, "doc_id long, id long, fp long, size long, bands array<long>, text string"), "shingled")
    items = materialise(marks.groupBy("id").agg(
        F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("weight"), F.first("fp").alias("fp"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("text").alias("text")), "similar-items")

    def near(a: str, b: str, key: Column) -> Column:
        one, two = F.col(f"{a}.size"), F.col(f"{b}.size")
        bits = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp")))
        banded = key.bitwiseAND(F.lit(1)) == 1
        return (F.least(one, two) >= F.greatest(one, two) * F.lit(similarity)) & (banded | (bits <= max_distance))

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (shingle_hashes(t.as_py() or "", width) for t in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    def verify(links: DataFrame) -> DataFrame:
        texts = items.select("id", "text")
        both = links.join(texts.select(F.col("id").alias("src"), F.col("text").alias("x")), "src").join(
            texts.select(F.col("id").alias("dst"), F.col("text").alias("y")), "dst")
        return materialise(both.select("src", "dst", "x", "y").mapInArrow(jaccard, "src long, dst long"), "similar-links")

    # The last bit of a key tells a band from two parts of a fingerprint.
    of_parts = F.transform(part_keys(F.col("fp")), lambda k: k.bitwiseAND(F.lit(-2)))
    of_bands = F.transform("bands", lambda k: k.bitwiseOR(F.lit(1)))
    keyed = lambda df: df.withColumn("key", F.explode(F.concat(of_parts, of_bands)))
    grouped = materialise(linked_groups(items.drop("text"), keyed, near, ["size", "fp"], verify), "similar-groups")
    named = grouped.groupBy("component").agg(F.min("lowest").alias("component_id"))
    labels = grouped.join(named, "component").select("id", "component_id")
    return marks.select("doc_id", "id").join(labels, "id").select("doc_id", "component_id")


def keep_one_per_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """As ``keep_one_per_group``, with groups linked by the Jaccard of shingles."""
    return _first_of_groups(docs, similar_documents(docs, similarity, width))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
