"""Exact ids of the public byte-level BPE, from the tokenizers library, at corpus speed."""

from __future__ import annotations

import re
import sys
from array import array

#: The Unicode White_Space characters, at which the pre-tokenizer's pattern splits.
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680))) + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space other than a space and a line feed, and runs of those two.
_OTHER = [c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c) and c not in " \n"]
_RUNS = ("  ", " \n", "\n ", "\n\n", *_OTHER)
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Chunks of more characters hardly repeat and are not kept: a cache of many could be of any size.
LONG = 256
#: Marks that the pre-tokenizer groups into one token after letters.
_TAIL = ",.;:!?|"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class ChunkEncoder:
    """Encodes texts by encoding each distinct chunk once.

    The pre-tokenizer never joins characters across the start of a run of white space, so a text
    is the concatenation of chunks "white space, then non-space" and its ids are the chunks' ids
    in order.  Words repeat, so most chunks are found in the cache; the others go through the
    tokenizers library.  The cache is cleared when it holds ``max_entries`` chunks (of at most
    ``LONG`` characters), so memory is bounded.  An added token's string in a text becomes that token, as the library has it by
    default; with ``special_as_text`` special tokens' strings are ordinary text.
    """

    def __init__(self, path: str, max_entries: int = 1_100_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (special_as_text and t.special)}
        self.added = {c: i for c, (i, _) in added.items()}
        self._splits = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        #: Tokens that take in their surroundings are left to the library, with the whole text.
        self._plain_splits = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values())
        #: Ids are packed as narrow as the vocabulary allows.
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._code = {"<u2": "H", "<u4": "I"}[self.dtype]
        self.letters = _byte_letters()
        self.max_entries = max_entries
        self.after_space: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        packed = array(self._code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _whole(self, chunk: str) -> bytes:
        return self._pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _word(self, chunk: str) -> bytes:
        """A chunk that the pre-tokenizer keeps whole: the model alone gives the same ids."""
        mapped = chunk.replace(" ", self.letters[32]) if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def _new(self, lead: str, part: str) -> bytes:
        core = part.rstrip(_TAIL)
        if not core.isalpha() or len(core) > 200:
            return self._whole(lead + part)
        if len(core) == len(part):
            return self._word(lead + part)
        if lead:
            ids = self.after_space.get(core)
            if ids is None:
                ids = self.after_space[core] = self._word(lead + core)
        else:
            ids = self._word(core)
        tail = part[len(core) :]
        return ids + self._one(tail)

    def _spaced(self, parts: list[str]) -> bytes:
        table = self.after_space
        try:
            return b"".join([table[p] for p in parts])
        except KeyError:
            long = []
            for p in parts:
                if p not in table:
                    table[p] = self._whole(p) if p[:1] == "\n" else self._new(" ", p)
                    if len(p) > LONG:
                        long.append(p)
            ids = b"".join([table[p] for p in parts])
            for p in long:
                del table[p]
            return ids

    def _one(self, chunk: str) -> bytes:
        ids = self.plain.get(chunk)
        if ids is None:
            ids = self._new("", chunk)
            if len(chunk) <= LONG:
                self.plain[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned integers of ``dtype``; a null or empty text has none."""
        if not text:
            return b""
        if any([c in text for c in self.added]):
            if not self._plain_splits:
                return self._whole(text)
            parts = self._splits.split(text)
            return b"".join([self._pack([self.added[p]]) if i % 2 else self._ordinary(p) for i, p in enumerate(parts)])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        """A text without added tokens."""
        if not text:
            return b""
        if len(self.after_space) + len(self.plain) > self.max_entries:
            self.after_space.clear()
            self.plain.clear()
        if any([run in text for run in _RUNS]):  # each is a search at memory speed
            return b"".join([self._spaced([c[1:]]) if c[0] == " " and c[1:2] not in ("", "\n") else self._one(c) for c in _CHUNK.findall(text)])
        # No two white-space characters meet, so a chunk starts at each space and line end; a chunk
        # after a line end keeps it, which tells the two kinds apart in one table.
        parts = text.replace("\n", " \n").split(" ")
        if parts[0]:
            return self._one(parts[0]) + self._spaced(parts[1:])
        return self._spaced(parts[1:])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and tokenizer file, kept across tasks."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
