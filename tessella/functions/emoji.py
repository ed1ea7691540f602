"""Emoji sequences by longest match over a table of them, as Column expressions.

The table is the caller's: sequences with their names. It becomes a trie, and the trie a regular
expression whose branches differ in their first character, so the longest sequence of the table that
starts at a place is the one that matches there.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Asks for the pictorial form of the character before it.
SELECTOR = "\ufe0f"
KEYCAP = "\u20e3"
#: Blocks of pictographs, the range of flag letters and that of skin tones (fixed values).
PICTOGRAPHS = ((0x2190, 0x21FF), (0x2300, 0x23FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF))
FLAG_LETTERS = (0x1F1E6, 0x1F1FF)
TONES = (0x1F3FB, 0x1F3FF)


@dataclass(frozen=True)
class Table:
    """Sequences in all their forms, with their names, and the expression that finds them."""

    names: dict[str, str]
    pattern: str


def with_forms(names: dict[str, str]) -> dict[str, str]:
    """The table with each sequence also without its selectors; a sequence listed itself keeps its name."""
    bare = {s.replace(SELECTOR, ""): name for s, name in names.items()}
    return {s: n for s, n in (bare | names).items() if s}


def _class(chars: list[str]) -> str:
    """One character of a set, neighbours as ranges."""
    points, parts = sorted(map(ord, chars)), []
    for p in points:
        if parts and parts[-1][1] == p - 1:
            parts[-1][1] = p
        else:
            parts.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in parts) + "]"


def trie_pattern(sequences) -> str:
    """An expression that matches the longest of ``sequences`` at a place; nothing, if there are none.

    Characters that lead to the same rest share a branch.
    """
    root: dict = {}
    for s in sequences:
        node = root
        for ch in s:
            node = node.setdefault(ch, {})
        node[""] = {}

    def rest(node: dict) -> str:
        branches: dict[str, list[str]] = {}
        for ch, child in node.items():
            if ch:
                branches.setdefault(rest(child), []).append(ch)
        if not branches:
            return ""
        inner = "|".join(_class(chars) + more for more, chars in sorted(branches.items()))
        return f"(?:{inner}){'?' if '' in node else ''}"

    root.pop("", None)
    return rest(root) or "(?!)"


def table(names: dict[str, str]) -> Table:
    """A table from sequences and names, such as a Unicode list that the caller has read."""
    every = with_forms(names)
    return Table(every, trie_pattern(every))


def characters() -> dict[str, str]:
    """Names by rule from Python's character database: pictographs, skin tones, keycaps, letter flags.

    Joined sequences and flags of regions follow no rule; the caller adds those wanted.
    """
    out = {}
    tones = {chr(t): unicodedata.name(chr(t)).removeprefix("EMOJI MODIFIER ").lower() for t in range(TONES[0], TONES[1] + 1)}
    for low, high in PICTOGRAPHS:
        for p in range(low, high + 1):
            name = unicodedata.name(chr(p), "").lower()
            if name and chr(p) not in tones:
                out[chr(p) + SELECTOR] = name
                out |= {chr(p) + t: f"{name} {n}" for t, n in tones.items() if p >= 0x1F300 or p in (0x261D, 0x26F9, *range(0x270A, 0x270E))}
    out |= {k + SELECTOR + KEYCAP: f"keycap {k}" for k in "0123456789#*"}
    letters = {chr(p): chr(ord("a") + p - FLAG_LETTERS[0]) for p in range(FLAG_LETTERS[0], FLAG_LETTERS[1] + 1)}
    return out | {a + b: f"flag {x}{y}" for a, x in letters.items() for b, y in letters.items()}


def region_flag(code: str) -> str:
    """The flag of a region within a country, of tags closed by a cancel tag, such as ``gbsct``."""
    return "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in code) + "\U000e007f"


def joined(*parts: str) -> str:
    """Pictographs joined into one."""
    return "\u200d".join(parts)


def found(text: Column, t: Table) -> Column:
    """The sequences of a text in order, each the longest at its place; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(t.pattern), F.lit(0))


def _name_map(t: Table) -> Column:
    return F.from_json(F.lit(json.dumps(t.names)), "map<string,string>")


def names_of(sequences: Column, t: Table) -> Column:
    """The names of an array of sequences, null for those that the table lacks."""
    return F.transform(sequences, lambda e: F.element_at(_name_map(t), e))


def named(text: Column, t: Table, before: str = " emoji ", after: str = " emoji ") -> Column:
    """A text with each sequence replaced by its name between two marks; null becomes empty.

    The text is cut at the matches and put together again with their names, so what a name holds is
    never searched itself, and no sequence is replaced inside a longer one.
    """
    raw = F.coalesce(text, F.lit(""))
    spoken = F.concat(F.transform(names_of(found(raw, t), t), lambda n: F.concat(F.lit(before), n, F.lit(after))), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(F.split(raw, t.pattern, -1), spoken, lambda a, b: F.array(a, b))), "")
