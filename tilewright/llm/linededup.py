"""Fuzzy line deduplication with DataFrame functions only.

Every line is normalised and gets a 64-bit SimHash of its words, whatever its length. Distinct lines meet in
an equality join on pigeonhole blocks of the fingerprint, which find every pair within ``DISTANCE`` bits;
``wide`` adds bands of least word hashes, which find lines that share most words though their fingerprints
lie farther apart. What meets is filtered by the distance of the fingerprints and verified by edit
similarity; linked lines form connected groups (``linking``: no pairs of a dense group are listed), and of
each group the first occurrence stays. Equal lines are one item before the join, so a line that a third of
the documents share is one row there.
"""

from __future__ import annotations

import random
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.llm.linking import linked_groups
from tilewright.session import materialise

#: Bits that may differ between fingerprints that meet in a pigeonhole block, and between any candidates. At an edit
#: similarity of 0.8 a fifth of the words differ, which turns 13 bits on average, with a deviation of 3.3.
DISTANCE, WIDE = 3, 21
#: Bands, and least word hashes in each. Lines with a fifth of their words replaced share a band in 91 of 100 cases.
BANDS, ROWS = 7, 3
#: Lines of up to so many characters are similar also if a fifth of their characters is changed.
LETTERS = 256
#: Counts of four bits share one long; a group of words counted so is at most _CHUNK words.
_CHUNK = 32_000
#: So many words are counted together in one row.
RIDE = 7
_FIELDS = 0x0001000100010001
_LANES, _ONES = 0x0000FFFF0000FFFF, 0x0000000100000001


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^a-z0-9\p{L}\p{N}]+", " "))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _majority(count: Column, n: Column, k: int) -> Column:
    """Bits k, k + 16, k + 32 and k + 48 of which one long holds the counts, set where they exceed half of ``n``.

    Adding 2^16 minus the least majority carries into the bit above a count exactly where it is reached.
    """
    lift = (F.lit(1 << 16) - F.floor(n / 2) - 1) * F.lit(_ONES)

    def half(field: Column) -> Column:
        return F.shiftrightunsigned(field.bitwiseAND(F.lit(_LANES)) + lift, 16).bitwiseAND(F.lit(_ONES))

    return F.shiftleft(half(count).bitwiseOR(F.shiftleft(half(F.shiftrightunsigned(count, 16)), 16)), k)


def _least() -> dict[str, Column]:
    """Least word hashes under ``BANDS * ROWS`` orders, each drawn by xor with a fixed number."""
    draw = random.Random(20)
    return {f"m{i}": F.min(F.col("__g").bitwiseXOR(F.lit(draw.randrange(-1 << 31, 1 << 31)))) for i in range(BANDS * ROWS)}


def _planes(rows: DataFrame, ride: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with the sums of their ``ride`` hashes, bit by bit, as columns of weight 1, 2 and 4."""
    if ride == 1:
        return rows, ["__h0"]
    assert ride == 7
    # Each adder takes three columns of one weight and gives one of that weight and one of twice that.
    for adders in ((("a", "h0", "h1", "h2"), ("b", "h3", "h4", "h5")), (("c", "a", "b", "h6"),), (("d", "a2", "b2", "c2"),)):
        new = {}
        for name, *ends in adders:
            x, y, z = (F.col(f"__{e}") for e in ends)
            new[f"__{name}"] = x.bitwiseXOR(y).bitwiseXOR(z)
            new[f"__{name}2"] = x.bitwiseAND(y).bitwiseOR(z.bitwiseAND(x.bitwiseXOR(y)))
        rows = rows.withColumns(new)
    return rows, ["__c", "__d", "__d2"]


def sketched(lines: DataFrame, keys: list[str], wide: bool) -> DataFrame:
    """``keys, fp, words`` and, if ``wide``, the least word hashes of lines with a normalised text ``norm``.

    Words become rows, ``RIDE`` in each, and are counted by one aggregation, whose partial step leaves one row per line. ``fp``
    is the majority of each bit over the XXH64 of the words, repeats included; a line of over ``_CHUNK`` words
    gives a row per chunk, each with the majority of its own.
    """
    # Several words ride in one row, as the bits of their sums: planes of weight 1, 2 and 4.
    ride = 1 if wide else RIDE
    per = -(-_CHUNK // ride)
    every = lines.select(*keys, F.split("norm", " ").alias("__words")).withColumn("__n", F.size("__words"))
    rides = F.floor(F.col("__n") / _CHUNK) * per + F.ceil(F.col("__n") % _CHUNK / ride)
    dealt = every.select(*keys, "__words", "__n", F.explode(F.sequence(F.lit(0), rides.cast("int") - 1)).alias("__i")).select(
        *keys, "__words", "__n", F.floor(F.col("__i") / per).alias("__chunk"), (F.col("__i") % per * ride).alias("__in"))
    dealt = dealt.withColumn("__at", (F.col("__chunk") * _CHUNK + F.col("__in")).cast("int")).withColumn(
        "__many", F.least(F.lit(ride), F.lit(_CHUNK) - F.col("__in"), F.col("__n") - F.col("__at")))
    word = lambda j: F.get("__words", F.col("__at") + j)
    hashes = {f"__h{j}": F.when(F.col("__many") > j, F.xxhash64(word(j))).otherwise(F.lit(0)) for j in range(ride)}
    hashed = dealt.select(*keys, "__chunk", "__many", *[c.alias(n) for n, c in hashes.items()], F.hash(word(0)).alias("__g"))
    hashed, planes = _planes(hashed, ride)

    def of_plane(p: str, k: int) -> Column:
        return F.shiftrightunsigned(p, k).bitwiseAND(F.lit(_FIELDS))

    sums = [F.sum(sum((of_plane(p, k) * F.lit(1 << i) for i, p in enumerate(planes[1:], 1)), of_plane(planes[0], k))).alias(f"__c{k}") for k in range(16)]
    least = _least() if wide else {}
    counted = hashed.groupBy(*keys, "__chunk").agg(F.sum("__many").alias("words"), *sums, *[c.alias(n) for n, c in least.items()])
    value = F.lit(0).cast("long")
    for k in range(16):
        value = value.bitwiseOR(_majority(F.col(f"__c{k}"), F.col("words"), k))
    return counted.select(*keys, "words", value.alias("fp"), *least)


def line_table(docs: DataFrame, min_words: int, wide: bool = False) -> DataFrame:
    """One row per line with ``min_words`` words or more, or per chunk of a very long one: its place, key and sketches."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Normalising inside the generator keeps the filter from doing it a second time.
    norm = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), normalised(line).alias("norm")))
    lines = base.select("doc_id", F.xxhash64("text").alias("text_key"), F.inline(norm))
    lines = lines.filter(F.col("norm").rlike("^[^ ]+" + " [^ ]+" * (min_words - 1)))
    lines = lines.withColumns({"a": F.xxhash64("norm"), "b": F.hash("norm")})
    return sketched(lines, ["doc_id", "text_key", "line_no", "a", "b"], wide)


def block_masks(items: int, distance: int = DISTANCE) -> list[int]:
    """Masks of which one must agree for fingerprints within ``distance``.

    The fingerprint is cut into ``distance + extra`` blocks, of which any ``extra`` may be asked to
    agree: each choice finds every pair, and the wider keys of more blocks keep the expected number
    of unrelated lines per key small for more lines.
    """
    for extra in range(1, 5):
        n = distance + extra
        width = 64 * extra // n
        if items <= 4 << width or extra == 4:
            cuts = [64 * i // n for i in range(n + 1)]
            parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
            masks = [sum(chosen) for chosen in combinations(parts, extra)]
            assert len(masks) == comb(n, extra)
            return masks
    raise AssertionError


def line_keys(masks: list[int], wide: bool) -> Column:
    """Keys of a line: the low six bits number a band or, from ``BANDS`` on, the mask of a pigeonhole block."""
    low = (1 << 6) - 1
    assert len(masks) <= 63 - BANDS

    def tagged(value: Column, i: int) -> Column:
        return value.bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(i))

    blocks = [tagged(F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(m)))), BANDS + i) for i, m in enumerate(masks)]
    bands = [tagged(F.xxhash64(*[F.col(f"m{i * ROWS + j}") for j in range(ROWS)]), i) for i in range(BANDS if wide else 0)]
    return F.array(*blocks, *bands)


def _near(similarity: float, masks: list[int]):
    """Candidates: close fingerprints in a block; in a band, fingerprints that a similar pair can have.

    Sizes must be those of a similar pair, and a pair that agrees in several blocks is taken at the first.
    """
    def near(one: Column, two: Column, key: Column) -> Column:
        apart = F.bit_count(one["fp"].bitwiseXOR(two["fp"]))

        def alike(size: str) -> Column:
            return F.least(one[size], two[size]) >= F.greatest(one[size], two[size]) * F.lit(similarity)

        number = key.bitwiseAND(F.lit((1 << 6) - 1))
        banded = number < BANDS
        first = F.lit(True)
        for i, m in enumerate(masks[:-1]):
            first = first & ((number <= BANDS + i) | (one["fp"].bitwiseXOR(two["fp"]).bitwiseAND(F.lit(_signed(m))) != 0))
        # The fingerprint of a line in chunks is that of one chunk.
        long = F.greatest(one["words"], two["words"]) > _CHUNK
        return F.when(banded, (apart <= WIDE) | long).otherwise((apart <= DISTANCE) & first) & alike("words")

    return near


def _finer(masks: list[int]):
    """Of the bits that a pigeonhole block leaves, fingerprints within ``DISTANCE`` agree in one of ``DISTANCE + 1`` parts."""
    n = DISTANCE + 1

    def parts(left: list[int]) -> list[list[int]]:
        cuts = [len(left) * i // n for i in range(n + 1)]
        return [left[a:b] for a, b in zip(cuts, cuts[1:])]

    def rest(bits: list[int], taken: list[int]) -> list[int]:
        return [k for k in bits if k not in taken]

    free = [[k for k in range(64) if not m >> k & 1] for m in masks]
    # By the number of a mask and the path: once narrowed, a path is the number of the part taken.
    first = [[parts(f) for _ in range(n)] for f in free]
    tables = [first, [[parts(rest(f, taken)) for taken in parts(f)] for f in free]]

    def finer(key: Column, path: Column, level: int) -> list[Column]:
        at = (key.bitwiseAND(F.lit((1 << 6) - 1)) - BANDS).cast("int") * n + path
        flat = [[_signed(sum(1 << k for k in of_path[w])) for of_mask in tables[level] for of_path in of_mask] for w in range(n)]
        return [F.col("me.fp").bitwiseAND(F.get(F.array(*[F.lit(v) for v in of_way]), at)) for of_way in flat]

    return finer


def duplicate_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = 3, wide: bool = False) -> DataFrame:
    """Places of the lines to remove: ``doc_id, text_key, line_no``.

    ``text_key`` is the XXH64 of the text, which tells rows with one id and different texts apart; rows
    that repeat both are one document. The first occurrence is that of the smallest document id; null
    ids come last. Lines of fewer than ``min_words`` words, blank lines and null texts are never
    duplicates. Equal lines are those with equal 96-bit hashes of the normalised text. Candidates
    are lines within ``DISTANCE`` bits, which misses many pairs near the limit of the similarity; ``wide``
    finds nine of ten of these too, at several times the cost. Not lazy: steps are stored in the shared folder.
    """
    lines = materialise(line_table(docs, min_words, wide), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key", "line_no")
    # Chunks of a line come together here: the least hashes are those of the whole line.
    facts = [F.min("fp").alias("fp"), F.max("words").alias("words")]
    items = materialise(
        lines.groupBy("a", "b").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("weight"), *facts,
            *[F.min(n).alias(n) for n in (_least() if wide else ())]),
        "line-items")
    masks = block_masks(items.count())
    keys = line_keys(masks, wide)

    def verify(links: DataFrame) -> DataFrame:
        pairs = materialise(links, "line-pairs")
        ends = pairs.select(F.col("src").alias("a")).unionByName(pairs.select(F.col("dst").alias("a"))).distinct()
        texts = materialise(_line_texts(docs, items.select("first", "a").join(ends, "a")), "line-texts")
        both = pairs.join(texts.withColumnsRenamed({"a": "src"}), "src").join(
            texts.select(F.col("a").alias("dst"), F.col("norm").alias("norm2")), "dst")
        return similar_texts(both, similarity).select("src", "dst")

    nodes, close = items.withColumnRenamed("a", "id"), _near(similarity, masks)
    grouped = linked_groups(
        nodes, lambda df: df.withColumn("key", F.explode(keys)), lambda a, b, key: close(F.col(a), F.col(b), key), ["fp", "words"], verify,
        sift=close, finer=None if wide else _finer(masks), bits=None if wide else ("fp", DISTANCE))
    named = grouped.select(F.col("id").alias("a"), "b", "first", "weight", "component")
    heads = named.groupBy("component").agg(F.min("first").alias("keep"))
    kept = named.join(heads, "component").filter("weight > 1 or keep <> first").select("a", "b", "keep")
    return (
        lines.select("a", "b", "doc_id", "text_key", "line_no", place.alias("here")).join(kept, ["a", "b"])
        .filter(~F.col("here").eqNullSafe(F.col("keep"))).select("doc_id", "text_key", "line_no").distinct()
    )


def similar_texts(pairs: DataFrame, similarity: float) -> DataFrame:
    """Rows whose ``norm`` and ``norm2`` have an edit similarity of at least ``similarity``.

    That is one less the least number of words put in, left out or replaced, over the words of the
    longer line; for lines of up to ``LETTERS`` characters, where one word weighs much, also the same of
    characters. Words that both begin or end with are left out first. Where replacing word by word does
    not settle it, each word is written as one of 55,000 letters by its hash, so that Spark's own edit
    distance counts words.
    """
    # Steps over an array of one pair: each binds its value, so no step is computed again in the filter.
    one = F.array(F.struct(F.split("norm", " ").alias("x"), F.split("norm2", " ").alias("y")))
    allowed = F.floor(F.greatest(F.size(F.split("norm", " ")), F.size(F.split("norm2", " "))) * F.lit(1 - similarity) + 1e-9).cast("int")

    def common(s: Column) -> Column:
        differ = F.array_position(F.zip_with(s["x"], s["y"], lambda a, b: a.eqNullSafe(b)), False)
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), F.when(differ == 0, F.size(s["x"])).otherwise(differ - 1).cast("int").alias("n"))

    def rest(s: Column) -> Column:
        return F.struct(*[F.reverse(F.slice(s[c], s["n"] + 1, F.size(s[c]))).alias(c) for c in ("x", "y")])

    for _ in range(2):  # from the front, then from the back
        one = F.transform(F.transform(one, common), rest)
    bounded = F.transform(one, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), allowed.alias("most")))

    def letters(words: Column) -> Column:
        # Letters from 256 up to the surrogates.
        code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(55_000)) + 256), 4, "0")
        return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")

    def near(s: Column) -> Column:
        short = F.greatest(F.size(s["x"]), F.size(s["y"])) <= s["most"]
        # Place by place is one way to edit, and the best where words were only replaced.
        replaced = F.size(F.filter(F.zip_with(s["x"], s["y"], lambda a, b: ~a.eqNullSafe(b)), lambda v: v)) <= s["most"]
        return short | replaced | (F.call_function("levenshtein", letters(s["x"]), letters(s["y"]), s["most"]) >= 0)

    longer = F.greatest(F.length("norm"), F.length("norm2"))
    edits = F.call_function("levenshtein", F.col("norm"), F.col("norm2"), F.floor(longer * F.lit(1 - similarity) + 1e-9).cast("int"))
    # Each word that only one of the two has takes an edit: that settles most pairs at once.
    split = F.array(F.struct(F.split("norm", " ").alias("x"), F.split("norm2", " ").alias("y")))

    def shared(s: Column) -> Column:
        most = F.floor(F.greatest(F.size(s["x"]), F.size(s["y"])) * F.lit(1 - similarity) + 1e-9)
        return (F.size(F.array_except(s["x"], s["y"])) <= most) & (F.size(F.array_except(s["y"], s["x"])) <= most)

    return pairs.filter((F.exists(split, shared) & F.exists(bounded, near)) | F.when(longer <= LETTERS, edits >= 0).otherwise(F.lit(False)))


def _line_texts(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """``a, norm``: the normalised text of each line in ``shown``, cut out of the document it first occurs in."""
    wanted = shown.groupBy(F.col("first.doc_id").alias("__doc"), F.col("first.text_key").alias("__key")).agg(
        F.collect_list(F.struct("a", F.col("first.line_no").alias("line_no"))).alias("__lines"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key")))
    cut = joined.select(F.split("text", "\n").alias("parts"), "__lines").select(
        F.inline(F.transform("__lines", lambda x: F.struct(x["a"].alias("a"), normalised(F.element_at(F.col("parts"), x["line_no"] + 1)).alias("norm")))))
    return cut.groupBy("a").agg(F.first("norm").alias("norm"))


def drop_duplicate_lines(
    docs: DataFrame, similarity: float = 0.8, min_words: int = 3, drop_emptied: bool = True, wide: bool = False
) -> DataFrame:
    """``docs`` with duplicate lines cut out of ``text`` (and ``n_chars`` measured anew, if there is one).

    A document that loses all its lines is a copy made up of lines kept elsewhere; it goes unless
    ``drop_emptied`` is false. All other columns and all untouched texts stay as they are.
    """
    gone = _per_document(duplicate_lines(docs, similarity, min_words, wide))
    rest = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("__gone"), i))
    hit = F.col("__gone").isNotNull()
    out = _with_gone(docs, gone).withColumn("__rest", F.when(hit, rest))
    if drop_emptied:
        out = out.filter(~hit | F.exists("__rest", lambda line: F.length(F.trim(line)) > 0))
    out = out.withColumn("text", F.when(hit, F.array_join("__rest", "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, similarity: float = 0.8, min_words: int = 3, wide: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` of every row of ``docs``; a null text has no lines."""
    gone = _per_document(duplicate_lines(docs, similarity, min_words, wide))
    lines = F.split("text", "\n")
    rest = F.filter(lines, lambda _, i: ~F.array_contains(F.col("__gone"), i))
    hit = F.col("__gone").isNotNull()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_gone(base, gone).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(hit, F.size("__gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.array_join(rest, "\n")).otherwise(F.col("text")).alias("kept_text"))


def _per_document(gone: DataFrame) -> DataFrame:
    """The removed line numbers of a document as one array, which is no longer than the document."""
    return gone.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))


def _with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    key = F.xxhash64(F.col("text").cast("string"))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (key == F.col("__key")), "left")
