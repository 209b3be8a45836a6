"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = lowered(text)
    if not words:
        return set()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod_97(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda v: all(int(p) <= 255 for p in v.split(".")),
    ),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)),
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", lambda v: 15 <= len(v) <= 34 and mod_97(v)),
    "ssn": (
        r"[0-9]+-[0-9]+-[0-9]+",
        lambda v: re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", v) is not None,
    ),
}


def pii_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = []
    for kind, (pattern, valid) in PII.items():
        for m in re.finditer(pattern, text):
            if not valid(m[0]):
                continue
            before = text[max(0, m.start() - 40) : m.start()].lower()
            if kind == "ssn" and not re.search("ssn|social security|taxpayer", before):
                continue
            found.append((kind, m.start(), m.end()))
    return found


NAMES = "password|passwd|secret|token|api_?key"
SECRETS = {
    "assign": (
        rf"((?ai:{NAMES}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m[2]) >= 12,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def secret_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    found = []
    for rank, (kind, (pattern, valid)) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or ""):
            if valid(m):
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def components(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(docs: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs.items()}
    links = [
        (a, b)
        for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return components(list(sets), links)


def repeated_bytes(docs: dict[int, str | None], width: int = 50) -> dict[int, list[bool]]:
    """Which bytes of each document are covered by a string of an earlier one."""
    first: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(data):
        for at in range(len(data[i]) - width + 1):
            first.setdefault(data[i][at : at + width], i)
    marks = {}
    for i, raw in data.items():
        gone = [False] * len(raw)
        for at in range(len(raw) - width + 1):
            if first[raw[at : at + width]] < i:
                gone[at : at + width] = [True] * width
        marks[i] = gone
    return marks


def removed_lines(docs: dict[int, str | None]) -> dict[int, list[bool]]:
    seen, marks = set(), {}
    for i in sorted(docs):
        lines = (docs[i] or "").split("\n") if docs[i] else []
        gone = [False] * len(lines)
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone[at : at + 3] = [True] * 3
            seen.add(window)
        marks[i] = gone
    return marks


def runs(marks: list[bool]) -> int:
    return sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))


def grouped(pairs) -> dict:
    out = defaultdict(list)
    for key, value in pairs:
        out[key].append(value)
    return out
