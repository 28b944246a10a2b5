"""Ids of texts by a byte-level BPE tokenizer, each distinct word encoded once.

The tokenizer's pattern takes a word with the one space before it, and never joins what stands before white space to what
follows. A text is therefore cut before spaces and line feeds, and ids of words are remembered. Texts with other white space, with
runs of spaces or more than two line feeds, or with marks of special tokens go to the tokenizer whole.
"""

from __future__ import annotations

from array import array
from itertools import filterfalse

import numpy as np

from tessera.llm.token_files import tokenizer

#: Words that a worker remembers from task to task (some 150 MB), those of up to so many characters only; and new words spelt at a time.
CACHE_WORDS, CACHE_CHARS, AT_ONCE = 700_000, 48, 4096
#: White space but space and line feed, by any standard; and runs and marks that the cuts can't stand.
ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
ODD_RUNS = ("  ", " \n", "\n ", "\n\n\n", "<|")
#: Marks that the pattern takes together at a word's end: no white space, letters, numbers, or apostrophes.
MARKS = ".,;:!?*#%&$|()\"-"

_KNOWN: dict[str, dict[str, bytes]] = {}


def _whole(text: str) -> bool:
    return any(x in text for x in ODD_RUNS) or text.endswith("\n\n") or any(c in text for c in ODD_SPACES)


def _ids(texts: list[str], path: str) -> list[bytes]:
    return [array("H", e.ids).tobytes() for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _spell(words: list[str], path: str) -> list[bytes]:
    """Ids of words, each with a space before it or none. Line feeds part them in one text, so that it is spelt at one go."""
    feed = array("H", tokenizer(path).encode("\n", add_special_tokens=False).ids)
    out: list[bytes] = []
    for at in range(0, len(words), AT_ONCE):
        group = words[at : at + AT_ONCE]
        raw = _ids(["\n".join(group)], path)[0]
        cuts = [-2, *(2 * np.flatnonzero(np.frombuffer(raw, "<u2") == feed[0])).tolist(), len(raw)]
        out += [raw[a + 2 : b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(group) + 1 and len(feed) == 1 else _ids(group, path)  # noqa: B905
    return out


def _learn(new: set[str], known: dict[str, bytes], path: str) -> set[str]:
    """Adds the ids of units to known; returns all that it added. Letters and closing marks, which the pattern parts, are spelt each for itself."""
    marked = {}
    for u in new:
        if u[-1:] in MARKS:
            core = u.rstrip(MARKS)
            letters = core[1:] if core[:1] in (" ", "\n") else core
            if letters.isalpha() and (letters.isascii() or max(letters) < "ɐ"):
                marked[u] = core
    plain = list({*(u for u in new if u not in marked), *marked.values()}.difference(known))
    bare = [u[1:] if u[:1] in (" ", "\n") else f" {u}" for u in plain]
    spelt = dict(zip([w for w in bare if w.strip(" ")], _spell([w for w in bare if w.strip(" ")], path), strict=True)) | {"": b"", " ": _ids([" "], path)[0]}
    feed = _ids(["\n"], path)[0]
    for u, w in zip(plain, bare, strict=True):
        known[u] = feed + spelt[w] if u[:1] == "\n" else spelt[w]
    tails = list({u[len(core) :] for u, core in marked.items()})
    ends = dict(zip(tails, _ids(tails, path), strict=True))
    for u, core in marked.items():
        known[u] = known[core] + ends[u[len(core) :]]
    return {*plain, *marked}


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text (null: none) as little-endian unsigned 16-bit numbers."""
    if tokenizer(path).get_vocab_size() > 1 << 16:
        raise ValueError("this encoder needs a vocabulary of at most 65,536 ids")
    known = _KNOWN.setdefault(path, {})
    if len(known) > CACHE_WORDS:
        known.clear()
    out = [b""] * len(texts)
    whole = [i for i, t in enumerate(texts) if t and _whole(t)]
    odd = set(whole)
    # A word stands under itself if a space is before it, under "\n" and itself after a line feed, under a space and itself at the start.
    units = [f" {t}".replace("\n", " \n").split(" ") if t and i not in odd else None for i, t in enumerate(texts)]
    new: set[str] = set()
    for u in units:
        if u:
            u[1] = f" {u[1]}"
            new.update(filterfalse(known.__contains__, u[1:]))
    added = _learn(new, known, path)
    for i, u in enumerate(units):
        if u:
            out[i] = b"".join(map(known.__getitem__, u[1:]))
    for u in added:
        if len(u) > CACHE_CHARS:
            del known[u]
    for i, ids in zip(whole, _ids([texts[i] for i in whole], path) if whole else [], strict=True):
        out[i] = ids
    return out
