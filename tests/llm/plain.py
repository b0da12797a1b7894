"""Plain versions of what the operators must give, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> frozenset[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def components(texts: dict, size: int, percent: int) -> dict:
    """Least id that links reach, by id."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    holders, parent = defaultdict(list), {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        shared = Counter(o for x in s for o in holders[x])
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(k)
    return {k: root(k) for k in texts}


class Bayes:
    """Naive Bayes over hashed n-grams of one to three characters, one count at a time; a text counts once a language."""

    def __init__(self, labelled: list):
        self.counts = {}
        for lang, text in sorted({(lang, text) for lang, text in labelled if lang is not None and any(c.isalpha() for c in text or "")}):
            self.counts.setdefault(lang, Counter()).update(self.grams(text))
        self.totals = {lang: sum(n.values()) + 0.5 * 2**15 for lang, n in self.counts.items()}

    @staticmethod
    def grams(text: str):
        p = [ord(c) if c.isalpha() else 32 for c in f"  {text.lower()} "]
        mask = 2**64 - 1

        def mixed(h):
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ (h >> 33)) * m & mask
            return h ^ (h >> 33)

        for k in range(2, len(p)):
            two = p[k] * 0x9E3779B1 + p[k - 1] & mask
            three = two * 0x85EBCA77 + p[k - 2] & mask
            for n, g in enumerate((p[k], two, three)):
                yield mixed(g * 4 + n & mask) >> 49

    def logs(self, text: str) -> tuple[dict, int]:
        grams = list(self.grams(text))
        return {lang: sum(math.log((n[g] + 0.5) / self.totals[lang]) for g in grams) for lang, n in self.counts.items()}, len(grams)

    def predict(self, text) -> tuple:
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        logs, _ = self.logs(text)
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())

    def likely(self, text) -> float:
        """Average log likelihood of the n-grams in the best language."""
        logs, n = self.logs(text)
        return max(logs.values()) / n


def bare(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hit_words(text: str | None, items: dict) -> tuple[set[int], set]:
    """Places under a window of ten words of an item, and the items."""
    w, hit, found = words(text), set(), set()
    for item, other in items.items():
        o = words(other)
        n = min(10, len(o))
        windows = {tuple(o[k : k + n]) for k in range(len(o) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(item)
    return hit, found
