"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text: str | None, words: int = 5) -> set:
    parts = [w for w in BLANKS.split(lower_ascii(text or "")) if w]
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[k : k + words]) for k in range(len(parts) - words + 1)}


class Groups:
    """Components by union of the smaller name."""

    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id to (shingles, component)."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders, common = defaultdict(list), defaultdict(int)
    for k, (_, own) in enumerate(sets):
        for s in own:
            for j in holders[s]:
                common[j, k] += 1
            holders[s].append(k)
    groups = Groups(i for i, _ in rows)
    for (j, k), both in common.items():
        if 100 * both >= percent * (len(sets[j][1]) + len(sets[k][1]) - both):
            groups.join(sets[j][0], sets[k][0])
    return {i: (len(own), groups.find(i)) for i, own in sets}


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def private_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind as listed."""
    found = []
    for order, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


WORDS = "|".join(
    "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
ASSIGN = r"(" + WORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secret_spans(text: str | None) -> list[tuple[int, int, str]]:
    found = []
    for order, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(pattern, text or ""):
            least = {"assign": 6, "access": 20, "hex": 24}[kind]
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
