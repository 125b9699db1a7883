"""Many patterns looked for in one pass: an automaton of all their literals, and plain regular expressions for the few others."""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick

_PLAIN = re.compile(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^\w\s])+")
#: Characters that a pattern without regard to case takes for ASCII letters, with the letters.
_ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"} | {c: chr(c + 32) for c in range(65, 91)}


def folded(text: str) -> str:
    """``text`` with the case of ASCII letters gone, character by character."""
    return text.lower() if text.isascii() else text.translate(_ALIKE)


def literal(pattern: str) -> str | None:
    """The folded text that a pattern stands for if it has no operators and is ASCII; else null."""
    return folded(re.sub(r"\\(.)", r"\1", pattern)) if pattern.isascii() and _PLAIN.fullmatch(pattern) else None


class Patterns:
    """Regular expressions, without regard to case, that are searched for together.

    Those that are plain text go into one automaton, so a text is read once however many they are; others are tried one by one.
    """

    def __init__(self, patterns: Iterable[str]):
        self.patterns = list(dict.fromkeys(patterns))
        self.others, words = [], {}
        for k, p in enumerate(self.patterns):
            text = literal(p)
            if text is None:
                self.others.append((k, re.compile(p, re.IGNORECASE)))
            else:
                words.setdefault(text, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for text, ks in words.items():
            self.automaton.add_word(text, (len(text), ks))
        if words:
            self.automaton.make_automaton()
        self.any = bool(words)

    def counts(self, text: str) -> dict[str, int]:
        """Matches that do not overlap, from the left, of each pattern that occurs."""
        found: dict[int, int] = {}
        ends: dict[int, int] = {}
        if self.any and text:
            for at, (size, ks) in self.automaton.iter(folded(text)):
                for k in ks:
                    if at - size >= ends.get(k, -1):
                        found[k] = found.get(k, 0) + 1
                        ends[k] = at
        for k, regex in self.others:
            n = sum(1 for _ in regex.finditer(text))
            if n:
                found[k] = n
        return {self.patterns[k]: n for k, n in found.items()}
