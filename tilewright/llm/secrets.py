"""Secret scan by patterns and a battery of randomness tests, with DataFrame functions only.

Three patterns find assignments, access keys and hex strings. Besides them every long run of
encoding letters is a candidate: its encoding is inferred, its symbols are tested for uniformity
(chi-squared), for runs about the middle of the alphabet and for serial correlation, and the three
p-values are combined by Fisher's method. Candidates that a Benjamini-Hochberg control, kept apart
by length, rejects as not random are dropped; the others are reported as ``random``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.llm.spans import by_start, digest, joined, labelled, matches, overlaps, unmarked
from tilewright.session import materialise

# The patterns of the three base kinds.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Lower bounds of the length classes that the false-discovery control keeps apart.
LENGTHS = (20, 32, 48, 80)
_BINS = 5
_GRID = 20  # steps of the p-value histogram per power of ten
_DEEPEST = 300 * _GRID


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike(r"^[A-Z2-7]+$"), "base32")
        .when(token.rlike(r"^[0-9a-z]+$"), "base36").otherwise("base64"))


def _symbols(token: Column, encoding: Column) -> Column:
    """Zero-based alphabet positions of the token's letters."""
    plain = F.when(encoding == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), encoding)
    return F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c) - 1)


def _two_sided(z: Column) -> Column:
    """Two-sided normal p-value by a rational approximation (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _within(lo: Column, hi: Column):
    return lambda s: (s >= lo) & (s < hi)


def _battery(symbols: Column, size: Column) -> Column:
    """Combined p-value of the tests on a token of symbols from an alphabet of ``size``."""
    n = F.size(symbols).cast("double")
    chi = F.lit(0.0)
    for b in range(_BINS):
        lo, hi = F.ceil(size * (b / _BINS)), F.ceil(size * ((b + 1) / _BINS))
        seen = F.size(F.filter(symbols, _within(lo, hi)))
        expected = n * (hi - lo) / size
        chi = chi + (seen - expected) * (seen - expected) / expected
    uniform = F.greatest(F.exp(-chi / 2) * (1 + chi / 2), F.lit(1e-300))  # four degrees of freedom
    before, after = F.slice(symbols, 1, F.size(symbols) - 1), F.slice(symbols, 2, F.size(symbols))
    upper = lambda s: s * 2 >= size
    changes = F.aggregate(F.zip_with(before, after, lambda a, b: F.when(upper(a) != upper(b), 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    runs = _two_sided((changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    centred = lambda s: (s + 0.5) / size - 0.5
    product = F.aggregate(F.zip_with(before, after, lambda a, b: centred(a) * centred(b)), F.lit(0.0), lambda x, y: x + y)
    serial = _two_sided(product * 12 / F.sqrt(n - 1))
    half = -(F.log(uniform) + F.log(runs) + F.log(serial))
    return F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(1e-300))  # Fisher, six degrees


def _bucket(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * _GRID), F.lit(_DEEPEST)).cast("int")


def _cutoffs(tested: DataFrame, rate: float) -> list[float]:
    """Benjamini-Hochberg p-value bound per length class, from a histogram of bounded size."""
    counts = (
        tested.select(F.explode("candidates").alias("c")).groupBy("c.class", _bucket(F.col("c.p")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = []
    for c in range(len(LENGTHS)):
        mine = sorted(((r.bucket, r.n) for r in counts if r["class"] == c), reverse=True)
        total, below, bound = sum(n for _, n in mine), 0, 0.0
        for bucket, n in mine:
            below += n
            largest = 10 ** (-bucket / _GRID)
            if largest * total <= rate * below:
                bound = largest
        bounds.append(bound)
    return bounds


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``doc_id, base, added`` with arrays of spans (start, order, end, kind, value) per row of ``docs``.

    ``base`` holds the matches of the three patterns that pass their length tests; ``added`` the
    random candidates that no base span overlaps. A null text is empty and has no spans; repeated rows
    and null ids keep their rows. A candidate needs letters and digits. Tested rows are stored once in
    the shared folder, because the bounds come from all of them.
    """
    text = unmarked(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    assign = F.filter(matches(F.col("t"), ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 6)
    found = base.select(
        "doc_id", labelled(assign, "assign", 0).alias("assign"), labelled(matches(F.col("t"), ACCESS), "access", 1).alias("access"),
        labelled(matches(F.col("t"), HEX), "hex", 2).alias("hex"),
        F.filter(matches(F.col("t"), CANDIDATE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("tokens"))
    found = found.select("doc_id", by_start(F.col("assign"), F.col("access"), F.col("hex")).alias("base"), "tokens")
    free = F.filter("tokens", lambda s: ~overlaps(s, F.col("base")))

    def tested(s: Column) -> Column:
        token = F.rtrim(s["value"], F.lit("="))
        encoding = _encoding(token)
        size = F.element_at(F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, len(v))]), encoding)
        kind = sum((F.when(F.length(token) >= lo, 1).otherwise(0) for lo in LENGTHS[1:]), F.lit(0))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), encoding.alias("encoding"),
            kind.cast("int").alias("class"), _battery(_symbols(token, encoding), size).alias("p"))

    stored = materialise(found.withColumn("candidates", F.transform(free, tested)).drop("tokens"), "secrets")
    bounds = F.array(*[F.lit(float(b)) for b in _cutoffs(stored, rate)])
    kept = F.filter("candidates", lambda c: c["p"] > F.element_at(bounds, c["class"] + 1))
    return stored.select("doc_id", "base", labelled(kept, "random", 3).alias("added"))


def report(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Counts, digest and places per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, then ``n_random``."""
    found = scan(docs, rate)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        digest(joined(F.col("base"))).alias("base_sha256"), joined(by_start(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"))
