"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re



def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = []
    pattern = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for m in pattern.finditer(text):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, m.end(), "hex"))
    spans.sort()
    count = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*count, _sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def personal(text: str | None) -> tuple[int, int, int, int, str]:
    text = text or ""
    groups: list[list[tuple[str, int, int]]] = [[], [], [], []]
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        groups[0].append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            groups[1].append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            groups[2].append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            groups[3].append(("phone", m.start(), m.end()))
    joined = ",".join(f"{k}:{a}:{b}" for g in groups for k, a, b in g)
    return (*[len(g) for g in groups], _sha(joined))


def fingerprint(text: str | None, width: int = 4) -> int:
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Root of each of ``n`` nodes: the smallest reachable."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def letters_apart(a: str, b: str) -> int:
    """Edit distance of characters, a column of the table at a time as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        x = same | down
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        score += (rise >> len(a) - 1 & 1) - (fall >> len(a) - 1 & 1)
        rise, fall = rise << 1 & full | 1, fall << 1 & full
        up, down = fall | (full & ~(x | rise)), rise & x
    return score


def similar_lines(a: str, b: str, similarity: float = 0.8) -> bool:
    """By words or, in lines of up to 256 characters, by characters."""
    def fits(x, y, apart) -> bool:
        most = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
        return abs(len(x) - len(y)) <= most and apart(x, y) <= most

    return fits(a.split(), b.split(), edit_distance) or (max(len(a), len(b)) <= 256 and fits(a, b, letters_apart))


def removed_lines(docs: list[tuple[int, str | None]], similarity: float = 0.8, min_words: int = 3) -> dict[int, list[int]]:
    """Line numbers to remove per document, from all pairs of distinct lines."""
    first: dict[str, tuple[int, int]] = {}
    places: list[tuple[str, int, int]] = []
    for doc, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            norm = " ".join(re.sub(r"[\W_]+", " ", line.lower()).split())
            if len(norm.split()) >= min_words:
                places.append((norm, doc, i))
                first.setdefault(norm, (doc, i))
    texts = list(first)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar_lines(texts[i], texts[j], similarity)]
    root = components(len(texts), links)
    keep: dict[int, tuple[int, int]] = {}
    for i, t in enumerate(texts):
        keep[root[i]] = min(keep.get(root[i], first[t]), first[t])
    number = {t: i for i, t in enumerate(texts)}
    out: dict[int, list[int]] = {}
    for norm, doc, i in places:
        if keep[root[number[norm]]] != (doc, i):
            out.setdefault(doc, []).append(i)
    return out


def without_repeats(docs: list[tuple[int, str | None]], width: int = 13) -> dict[int, tuple[int, int, str]]:
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i:i + width]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), _sha(" ".join(kept)))
    return out


def subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
