"""Byte-level BPE through the public libraries, fast enough for whole corpora.

Two facts keep results equal to one library call on the whole text:

* The pre-splitting pattern never matches across the border before a white-space character that a
  non-white-space character follows: the match in front ends there in any case, and no alternative looks back.
  A text may be cut at such places and the parts encoded alone (``safe_parts``, and units below).
* A unit (a space and what follows up to the next space) is such a part, so the number of its ids can be kept and
  reused. Texts with runs of white space after a space, or holding a special token, go to the library whole.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: A text longer than this many characters is encoded in parts cut at safe boundaries.
LONG_TEXT = 200_000
#: Units kept by one worker; beyond it the cache starts anew.
CACHE_UNITS = 150_000
_BORDER = re.compile(r"[ \t\n\r](?=[A-Za-z0-9])")
_ODD_SPACE = re.compile(r" (?=\s)")
_loaded: dict[tuple, object] = {}


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """The text in parts of about size characters, cut before a white-space character that a letter or digit follows."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size:
        found = _BORDER.search(text, at + size)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def _once(key: tuple, make):
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker process."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return _once(("ranks", path, pattern), make)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def json_encoding(path: str, pattern: str):
    """A tokenizers file as a tiktoken encoding, refused unless both must give the same ids.

    They do if it is plain byte-level BPE, without a normalizer or an added prefix space, and its merges are in
    the order of the ids they make, so that the lowest rank is the first merge.
    """

    def make():
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain = not any((file["normalizer"], pre.get("add_prefix_space"), model.get("dropout"), model.get("ignore_merges"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is not plain byte-level BPE")
        byte = _byte_of_char()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    return _once(("json", path, pattern), make)


def library_tokenizer(path: str):
    """The tokenizers library's own tokenizer of a file, single-threaded; one per worker process."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return _once(("library", path), make)


class Units:
    """Encodes texts unit by unit and keeps what it has encoded. encode_many gives a value for each string."""

    def __init__(self, encode_many, special: Iterable[str]):
        self.encode_many, self.special, self.kept = encode_many, tuple(special), {}

    def split(self, texts: list[str]) -> list[list[str] | None]:
        """Each text's units, or None where it must be encoded whole. All units are in the cache afterwards."""
        out, new = [], set()
        if len(self.kept) > CACHE_UNITS:
            self.kept.clear()
        kept = self.kept
        for text in texts:
            if any(s in text for s in self.special) or _ODD_SPACE.search(text):
                out.append(None)
                continue
            units = text.replace(" ", "\0 ").split("\0") if "\0" not in text else None
            out.append(units)
            if units is not None:
                new.update(units)
        new -= kept.keys()
        if new:
            todo = list(new)
            kept.update(zip(todo, self.encode_many(todo), strict=True))
        return out


def ids_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        return np.array(ids, "<u4").tobytes()
    return packed.tobytes()


def encode_all(encoding, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit bytes; special tokens' strings become their ids."""
    encode = lambda part: encoding.encode_to_numpy(part, allowed_special="all").astype("<u4", copy=False).tobytes()
    return [b"".join(map(encode, safe_parts(text))) for text in texts]


def count_all(path: str, texts: list[str]) -> list[int]:
    """The number of ids that the tokenizers library gives for each text, without those it adds itself."""
    tokenizer = library_tokenizer(path)
    many = lambda todo: [len(e) for e in tokenizer.encode_batch_fast(todo, add_special_tokens=False)]
    units = _once(("count units", path), lambda: Units(many, [t.content for t in tokenizer.get_added_tokens_decoder().values()]))
    kept, out = units.kept, []
    for text, parts in zip(texts, units.split(texts), strict=True):
        out.append(sum(many(safe_parts(text))) if parts is None else sum(map(kept.__getitem__, parts)))
    return out
