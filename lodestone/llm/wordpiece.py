"""Greedy word-piece counts with a linear-time longest-match automaton."""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, text_or_empty

#: Words of the cache of one worker, and the characters of a word that it keeps at most.
_CACHE, _LONG = 1_000_000, 256


class LongestMatch:
    """A trie of word-initial and continuation pieces with failure links and popped counts.

    ``link[v]`` is where matching goes on after the pieces that are certain at node v are popped,
    and ``popped[v]`` is how many they are.  A word's count is the sum of what is popped on the
    way, so each character is looked at once and no piece is ever built.
    """

    def __init__(self, initial: set[str], continuation: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.link: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        self.start, self.inside = 0, 1
        ends = [False, False]
        for root, pieces in ((self.start, initial), (self.inside, continuation)):
            for piece in sorted(pieces):
                at = root
                for ch in piece:
                    to = self.next[at].get(ch)
                    if to is None:
                        to = self.next[at][ch] = len(self.next)
                        self.next.append({})
                        self.link.append(-1)
                        self.popped.append(0)
                        ends.append(False)
                    at = to
                if piece:
                    ends[at] = True
        queue = deque([self.start, self.inside])
        while queue:  # breadth first: links lead to shorter strings
            u = queue.popleft()
            for ch, v in self.next[u].items():
                if ends[v]:
                    self.link[v], self.popped[v] = self.inside, 1
                else:
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and ch not in self.next[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][ch], n
                queue.append(v)

    def count(self, word: str) -> int:
        """How many pieces greedy longest match cuts the word into; 0 if it cannot."""
        next_, link, popped = self.next, self.link, self.popped
        at, n = self.start, 0
        for ch in word:
            while ch not in next_[at]:
                if link[at] < 0:
                    return 0
                n += popped[at]
                at = link[at]
            at = next_[at][ch]
        while at != self.inside:
            if link[at] < 0:
                return 0
            n += popped[at]
            at = link[at]
        return n


def pieces_of(model_file: str) -> tuple[set[str], set[str]]:
    """Word-initial and continuation pieces of a public piece model: with and without its mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]}, {p for p in pieces if "▁" not in p}


_automata: dict[str, tuple[LongestMatch, dict[str, int]]] = {}


def automaton(model_file: str) -> tuple[LongestMatch, dict[str, int]]:
    if model_file not in _automata:
        _automata[model_file] = LongestMatch(*pieces_of(model_file)), {}
    return _automata[model_file]


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _counter(model_file: str):
    def run(batches):
        match, known = automaton(model_file)
        for batch in batches:
            words, pieces, unknown = [], [], []
            for text in batch.column(1):
                found = _WORDS.findall(text.as_py())
                if len(known) > _CACHE:
                    known.clear()
                try:
                    counts = [known[w] for w in found]
                except KeyError:
                    new = [w for w in set(found) if w not in known]
                    for w in new:
                        known[w] = match.count(w)
                    counts = [known[w] for w in found]
                    for w in new:
                        if len(w) > _LONG:
                            del known[w]
                none = counts.count(0)
                words.append(len(found))
                pieces.append(sum(counts) + none)
                unknown.append(none)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, pieces, unknown))], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    return run


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_words, n_pieces, n_unknown, over the whole text.

    Words are runs of what is not ASCII white space.  Each is cut greedily into the longest
    word-initial piece and then the longest continuations; a word that cannot be cut counts as one
    unknown piece.  A worker matches each distinct word once while its bounded cache lasts.

    Null texts count as empty (all zero); null ids and repeated rows are kept; other columns are
    ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_counter(model_file), "doc_id long, n_words long, n_pieces long, n_unknown long")
