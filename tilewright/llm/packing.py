"""Best-fit packing of token pieces under several capacities.

Documents become token pieces in one pass over the text. The pieces, a few numbers each, are dealt
by a hash into groups that each fill some thousand sequences, and every group is packed on its own
by vector best fit: a sequence has a residual of tokens, documents and attention cost (the sum of
squared piece lengths), and of all sequences that meet every demand the rule takes the best one.
What a group leaves unfilled is part of about one sequence, so the loss against one global packing is one
sequence in some thousand. No task sees more than its group.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilewright.session import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


#: ASCII marks that no rule of the vocabulary joins to the letters before them; an apostrophe is none.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class WordEncoder(dict):
    """Token ids of a text as little-endian 32-bit bytes; as a dict, of the parts seen before.

    The vocabulary drops white space and never joins across it, so the ids of a text are the ids of
    its parts one after the other. For the same reason a run of marks at the end of a run of letters is
    looked up on its own. Lower-case Latin letters are what the normaliser leaves as they are and the
    splitter takes as one word, so they go to the tokenizer's model at once; all else goes through the whole of it.
    """

    def __init__(self, path: str, keep: int = 700_000, longest: int = 48) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self._encode, self._model = tokenizer.encode, tokenizer.model.tokenize
        self._spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._keep, self._longest = keep, longest

    def _letters(self, word: str) -> bytes:
        spelled = word if word.isascii() else self._spell(word)[0][0]
        return array("I", [t.id for t in self._model(spelled)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) > self._keep:
            self.clear()
        lower = part.lower()
        word = lower.rstrip(_MARKS)
        if not word.isalpha() or max(word) > "\u024f":
            ids = np.array(self._encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        elif part != word:
            ids = self[word] + (self[lower[len(word):]] if len(word) < len(lower) else b"")
        else:
            ids = self._letters(word)
        if len(part) <= self._longest:
            self[part] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that later tasks find the parts known."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its token ids followed by ``end_id``; only documents above ``max_tokens`` are cut,
    and only their last piece may be shorter. A null or empty text is the lone ``end_id``; a row with a
    null id keeps it. Repeated rows give repeated pieces. Other columns are ignored.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, max_tokens)):
                    part = ids[4 * start:4 * (start + max_tokens)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, PIECES)


def vector_best_fit(
    lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length, which must come in decreasing order.

    Of the open bins whose residual tokens, documents and attention cost all cover the demand, rule
    ``norm`` takes the one with the smallest weighted norm of what would be left, and rule ``dot`` the
    one with the smallest weighted dot product of demand and residual; ties go to the oldest bin. A
    piece that exceeds a capacity on its own gets a bin of its own.
    """
    n = len(lengths)
    cap = np.array(capacity, dtype=np.float64)
    scale = np.array(weights) / cap**2
    bins, offsets = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    least = float(lengths[-1]) if n else 0.0
    residual = np.empty((max(n, 1), 3))
    number = np.empty(max(n, 1), dtype=np.int64)
    live = made = 0
    for i in range(n):
        size = float(lengths[i])
        need = np.array((size, 1.0, size * size))
        left = residual[:live] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            score = left[fits] ** 2 @ scale if rule == "norm" else (residual[fits] * need) @ scale
            at = int(fits[np.argmin(score)])
            offsets[i] = cap[0] - residual[at, 0]
            bins[i] = number[at]
            residual[at] -= need
        else:
            at, made = live, made + 1
            live += 1
            residual[at], number[at], bins[i] = cap - need, made - 1, made - 1
        # A bin that cannot take the smallest piece any more is closed; order is kept for the ties.
        if residual[at, 0] < least or residual[at, 1] < 1 or residual[at, 2] < least * least:
            residual[at:live - 1] = residual[at + 1:live].copy()
            number[at:live - 1] = number[at + 1:live].copy()
            live -= 1
    return bins, offsets


def pack(
    pieces: DataFrame, max_tokens: int = 2048, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", group_tokens: int = 4_000_000,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``max_documents`` and ``max_attention`` default to values that never bind (one document per token,
    the square of the sequence length). ``group_tokens`` is the share of one task. Runs one job to
    count the tokens; give it stored pieces. No rows give no rows.
    """
    capacity = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    total = pieces.agg(F.sum(F.col("length") + 16)).first()[0] or 0
    groups = max(1, round(total / group_tokens))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = vector_best_fit(rows["length"].to_numpy(), capacity, weights, rule)
        rows = rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, **limits) -> DataFrame:
    """Tokenise, cut and pack; the pieces are stored once in the shared folder."""
    return pack(materialise(token_pieces(docs, tokenizer, max_tokens), "pieces"), max_tokens, **limits)
