"""Front ends: which extractor reads which extension, in order of priority."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from graphloom.functions import candidates as cand
from graphloom.functions.catalogue import READ
from graphloom.functions.specifiers import EXTRACTORS


@dataclass(frozen=True)
class FrontEnd:
    """A language: its extensions, ``extract(text)`` giving (line, raw), and ``candidates(lang, raw, path, config)``
    giving (ranked keys, tag where none exists, package).
    """

    lang: str
    extensions: tuple[str, ...]
    extract: Callable[[str], Iterable[tuple[int, str]]]
    candidates: Callable = cand.candidates


class FrontEnds:
    """The first front end that claims an extension keeps it; later claims are conflicts, kept for inspection."""

    def __init__(self, ends: Iterable[FrontEnd]):
        self.ends = tuple(ends)
        self.by_extension: dict[str, FrontEnd] = {}
        self.conflicts: list[tuple[str, str]] = []
        for end in self.ends:
            for e in end.extensions:
                key = e.lower()
                if key in self.by_extension:
                    self.conflicts.append((key, end.lang))
                else:
                    self.by_extension[key] = end

    def for_extension(self, extension: str) -> FrontEnd | None:
        return self.by_extension.get(extension.lower())

    def extensions(self) -> list[str]:
        return sorted(self.by_extension)

    def languages(self) -> list[str]:
        return sorted({e.lang for e in self.ends})

    def of(self, lang: str) -> FrontEnd | None:
        return next((e for e in self.ends if e.lang == lang), None)

    def extract(self, lang: str, text: str) -> list[tuple[int, str]]:
        end = self.of(lang)
        return list(end.extract(text)) if end else []

    def candidates(self, lang: str, raw: str, path: str, config: dict):
        end = self.of(lang)
        return (end.candidates if end else cand.candidates)(lang, raw, path, config)

    def langs(self) -> dict[str, str]:
        return {e: end.lang for e, end in self.by_extension.items()}


def built_in() -> FrontEnds:
    """All languages that are read, in claiming order."""
    lines = (line.split(": ", 1) for line in READ.strip().splitlines())
    return FrontEnds(FrontEnd(lang, tuple(words.split()), EXTRACTORS[lang]) for lang, words in lines)
