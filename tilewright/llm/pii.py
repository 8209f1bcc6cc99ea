"""Personal data by patterns, checksums and context words, with DataFrame functions only.

Patterns propose spans; part bounds, digit counts, Luhn and mod-97 confirm them. Every confirmed span
has a score, from how much its form proves and from the words within some code points of it. E-mail,
network, card and phone spans are always reported; account numbers (IBAN) and identity numbers, whose
forms prove less, are added when their score reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.llm.spans import digest, labelled, matches, overlaps, unmarked

# The patterns of the base kinds, written so that no long run is scanned twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Kind, score of the bare form, words nearby that raise it, words that lower it.
KINDS = [
    ("email", 0.9, "mail|e-mail|contact|write", "noreply|example"),
    ("ip", 0.5, "ip|host|server|address|login", "version|release|section"),
    ("card", 0.7, "card|visa|credit|debit|payment", "order|invoice|serial|isbn"),
    ("phone", 0.7, "phone|tel|call|mobile|fax", "order|invoice|serial"),
    ("iban", 0.8, "iban|account|bank|konto|transfer", "serial|sample"),
    ("identity", 0.3, "ssn|social|identity|taxpayer", "part|serial|order"),
]
BASE = ("email", "ip", "card", "phone")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _between(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


def luhn(value: Column) -> Column:
    digits = F.transform(F.reverse(F.split(_digits(value), "")), lambda d: d.cast("int"))
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's check digits hold: letters count from ten, the head goes last."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def _score(span: Column, text: Column, bare: float, raising: str, lowering: str, reach: int) -> Column:
    begin = F.greatest(span["start"] - reach, F.lit(0))
    near = F.lower(F.concat(F.substring(text, begin + 1, span["start"] - begin), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(reach))))
    up = near.rlike(rf"(?<![a-z])(?:{raising})(?![a-z])")
    down = near.rlike(rf"(?<![a-z])(?:{lowering})(?![a-z])")
    score = F.lit(bare) + F.when(up, 0.3).otherwise(0.0) - F.when(down, 0.2).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def find(docs: DataFrame, threshold: float = 0.5, reach: int = 40) -> DataFrame:
    """``doc_id`` and an array of spans (start, order, end, kind, value, score) per row, by kind and start.

    A null text is empty and has no spans; repeated rows and null ids keep their rows. Added kinds
    leave out what a base span overlaps. Nothing is shuffled.
    """
    t = F.col("t")
    checked = {
        "email": matches(t, EMAIL),
        "ip": F.filter(matches(t, IP), lambda s: F.forall(F.split(s["value"], r"\."), lambda part: part.rlike(IP_PART))),
        "card": F.filter(matches(t, CARD), lambda s: _between(s["value"], 13, 19) & luhn(s["value"])),
        "phone": F.filter(matches(t, PHONE), lambda s: _between(s["value"], 9, 15)),
        "iban": F.filter(matches(t, IBAN), lambda s: F.length(F.regexp_replace(s["value"], r"\x20", "")).between(15, 34) & mod97(s["value"])),
        "identity": F.filter(matches(t, IDENTITY), lambda s: ~s["value"].rlike(r"^(?:000|666|9)|-00-|-0000$")),
    }
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), unmarked(F.col("text")).alias("t"))
    spans = base.select("doc_id", "t", *[labelled(checked[kind], kind, i).alias(kind) for i, (kind, *_) in enumerate(KINDS)])
    spans = spans.withColumn("certain", F.concat(*BASE))

    def scored(kind: str, bare: float, raising: str, lowering: str) -> Column:
        out = F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"),
            _score(s, t, bare, raising, lowering, reach).alias("score")))
        return out if kind in BASE else F.filter(out, lambda s: (s["score"] >= threshold) & ~overlaps(s, F.col("certain")))

    return spans.select("doc_id", F.concat(*[scored(*k) for k in KINDS]).alias("spans"))


def report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row, then ``n_added`` and ``scores``."""
    found = find(docs, threshold).withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans, last: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s[last].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE], digest(text("base", "end")).alias("base_sha256"),
        text("spans", "end").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        text("spans", "score").alias("scores"))
