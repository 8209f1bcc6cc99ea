"""Steps that were rewritten for time, disk or memory: the same results, with what made them costly left out."""

from __future__ import annotations

import random

import numpy as np
import pytest


def test_encoder_keeps_case_of_odd_parts_and_looks_marks_up():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tilewright.llm.packing import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), WordEncoder(path)
    rnd = random.Random(4)
    letters = "aAzZéÉßſĿŉǅʼ'́%%%..,_-<=>|09 \n\tµªºİıÿȷɐΣσς"
    odd = ["<|ENDOFTEXT|>", "a<|endoftext|>b", "Viétion%%% viétion*** viétion"]
    odd += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    for s in odd:
        assert encode(s) == np.array(tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes(), s
    before = encode._encode
    encode("neverseen")
    encode._encode = None  # marks and capitals around known letters need no tokenizer
    assert encode("Neverseen%%% neverseen***")
    encode._encode = before


def test_word_numbers_of_many_texts_are_those_of_plain_words():
    from tilewright.llm.decontaminate import WordNumbers, plain_words

    rnd = random.Random(2)
    letters = "aZΣσςİıß'\".,-_ͅ\xad:\x1c\x1f\x85 ​　\xa0 \t\n%ªǅ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 12))) for _ in range(5000)]
    words = [plain_words(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words[:2500] for w in ws}))}
    numbers, sizes = WordNumbers(vocabulary).of(texts)
    assert sizes.tolist() == [len(ws) for ws in words]
    assert numbers.tolist() == [vocabulary.get(w, -1) for ws in words for w in ws]


def test_keys_of_many_items_find_every_link(spark):
    """Keys of one, a few and many items; the links of a large key that the first comparisons miss join groups too."""
    from tilewright.llm import linking

    rows = [(i, i, 1) for i in range(3)]  # alone
    rows += [(10 + i, 10, 1) for i in range(linking.FEW)] + [(100 + i, 100, 1) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, k long, weight long")

    def near(a, b, key):
        from pyspark.sql import functions as F

        return (F.col(f"{a}.id") - F.col(f"{b}.id")) % 7 == 0  # no item of a large key is near the one before it

    got = {r.id: r.component for r in linking.linked_groups(items, lambda df: df.withColumn("key", df.k), near, ["k"]).collect()}
    assert got == {i: min(j for j, m, _ in rows if m == k and (i - j) % 7 == 0) for i, k, _ in rows}


def test_a_key_of_many_unrelated_lines_is_narrowed(spark, monkeypatch):
    """Lines that share a block by chance leave no rows for the comparison with all others; every close pair links."""
    from pyspark.sql import functions as F

    from tilewright.llm import linededup, linking

    rnd = random.Random(31)
    masks = linededup.block_masks(2 * 10**6)
    base = rnd.getrandbits(63)
    fps = [base & masks[0] | rnd.getrandbits(63) & ~masks[0] for _ in range(1500)]
    fps += [f ^ sum(1 << b for b in rnd.sample(range(63), k)) for f in fps[:300] for k in (1, 2, 3)]
    fps = sorted(set(fps))
    items = spark.createDataFrame([(i, f, 20, 1) for i, f in enumerate(fps)], "id long, fp long, words long, weight long")
    steps, store = [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, label: steps.append((label, store(df, label))) or steps[-1][1])
    close, keys = linededup._near(0.8, masks), linededup.line_keys(masks, False)
    got = linking.linked_groups(
        items, lambda df: df.withColumn("key", F.explode(keys)), lambda a, b, key: close(F.col(a), F.col(b), key), ["fp", "words"],
        sift=close, finer=linededup._finer(masks))
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in got.collect()} == {i: top(i) for i in range(len(fps))}
    assert [df for label, df in steps if label == "met"][-1].filter("me is not null").count() < 100
    assert not any(label == "mixed" and df.count() > 100 for label, df in steps)


def test_a_key_of_some_lines_is_compared_in_its_list(spark, monkeypatch):
    """Unrelated lines of one block leave no row each; of a dense cluster one link per line is verified at first, then hardly any."""
    from pyspark.sql import functions as F

    from tilewright.llm import linededup, linking

    rnd = random.Random(33)
    masks = linededup.block_masks(2 * 10**6)
    base = rnd.getrandbits(63)
    apart = [base & masks[0] | rnd.getrandbits(63) & ~masks[0] for _ in range(200)]
    dense = [apart[0] ^ (1 << k) for k in range(63)]  # all within two bits of one another
    fps = apart + [f for f in dense if f not in apart]
    items = spark.createDataFrame([(i, f, 20, 1) for i, f in enumerate(fps)], "id long, fp long, words long, weight long")
    steps, store, verified = [], linking.materialise, []
    monkeypatch.setattr(linking, "materialise", lambda df, label: steps.append((label, store(df, label))) or steps[-1][1])

    def verify(links):
        verified.append(links.count())
        return links

    close, keys = linededup._near(0.8, masks), linededup.line_keys(masks, False)
    got = linking.linked_groups(
        items, lambda df: df.withColumn("key", F.explode(keys)), lambda a, b, key: close(F.col(a), F.col(b), key), ["fp", "words"], verify,
        sift=close, finer=linededup._finer(masks), bits=("fp", linededup.DISTANCE))
    assert {r.id: r.component for r in got.collect()} == {i: 0 if i >= 200 else i for i in range(len(fps))}
    met = [df for label, df in steps if label == "met"]
    assert len(met) == 1 and met[0].filter("src is null").count() == 0
    assert verified[0] <= len(dense) and sum(verified[1:]) == 0


def test_words_that_ride_together_are_counted_bit_by_bit(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tilewright.llm import linededup

    rnd = random.Random(32)
    lines = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n)) for n in (1, 6, 7, 8, 14, 15, 40, 100, 333)]
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, norm string")
    hashes = {r.i: r.h for r in frame.select("i", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("h")).collect()}
    for chunk in (32_000, 50):
        monkeypatch.setattr(linededup, "_CHUNK", chunk)
        wanted = sorted(
            (i, len(part), sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in part) > len(part)))
            for i, h in hashes.items() for part in (h[a:a + chunk] for a in range(0, len(h), chunk)))
        assert sorted((r.i, r.words, r.fp % (1 << 64)) for r in linededup.sketched(frame, ["i"], False).collect()) == wanted


def test_line_blocks_hold_few_unrelated_lines():
    from tilewright.llm.linededup import block_masks

    for items in (10**5, 2 * 10**6, 10**8):
        assert items / 2 ** min(m.bit_count() for m in block_masks(items)) <= 4


def test_fit_sums_in_slices():
    from tilewright.llm.toxicity import _slices, _summed

    rng = np.random.default_rng(1)
    at = np.sort(rng.integers(0, 40, 500).astype(np.int32))
    of, values = rng.integers(0, 30, 500).astype(np.int32), rng.standard_normal(30)
    for size in (40, 45):
        slices = _slices(at, of, size, together=16)
        assert len(slices) > 10
        assert (_summed(slices, values) == np.bincount(at, weights=values[of], minlength=size)).all()
