"""SentencePiece encoding by shared-prefix Viterbi, and decoding."""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, text_or_empty

MARK = "▁"
#: What an unknown character costs below the least score of a piece.
UNKNOWN = 10.0
#: Words of the cache of one worker, and the characters of a word that it keeps at most.
_CACHE, _LONG = 1_000_000, 256
#: Texts whose new words are sorted into one trie together.
_TEXTS = 256


class UnigramPieces:
    """A piece model's vocabulary, read as a unigram model: the best segmentation of a text has
    the highest sum of piece scores.  Characters outside the vocabulary become byte pieces.

    Pieces hold the space mark at their start only (or consist of marks), so a text is segmented
    word by word: a marked word is a run of marks and what follows up to the next mark.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.strings = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.strings[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.score = {self.strings[i]: (model.get_score(i), i) for i in plain}
        #: The pieces spelled backwards as a trie: dicts by character, the piece under "".
        self.backwards: dict = {}
        for piece, found in self.score.items():
            node = self.backwards
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = found
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN
        self.unknown_id = model.unk_id()
        inner = [p for p in self.score if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a mark inside cross words: {inner[:3]}")
        self.cache: dict[str, tuple[bytes, float]] = {}
        self.readable = [None if i in self.of_byte else s for i, s in enumerate(self.strings)]

    def viterbi(self, words: list[str]) -> None:
        """Segments marked words into the cache.

        Sorted words are a trie read depth first: the stacks hold the forward scores of the
        current path, and a word keeps those of the prefix it shares with the word before.
        """
        score, unknown, backwards = self.score, self.unknown, self.backwards
        best, back = [0.0], [(0, -1)]
        path = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                top, via, node = None, None, backwards
                for j in range(i - 1, -1, -1):
                    node = node.get(word[j])
                    if node is None:
                        break
                    if "" in node:
                        s, piece = node[""]
                        s += best[j]
                        if top is None or s >= top:  # ties: the longest last piece
                            top, via = s, (j, piece)
                if word[i - 1] not in score:
                    s = best[i - 1] + unknown
                    if top is None or s > top:
                        top, via = s, (i - 1, -1)
                best.append(top)
                back.append(via)
            path = word
            ids, i = [], len(word)
            while i:
                j, piece = back[i]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [self.bytes.get(b, self.unknown_id) for b in reversed(word[j:i].encode())]
                i = j
            self.cache[word] = array("I", reversed(ids)).tobytes(), best[len(word)]

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words of a text; a non-empty text gets a mark in front."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def encode_batch(self, texts: list[str]) -> list[tuple[array, float]]:
        """The ids of each text and the score of its segmentation."""
        split = [self.words(t) for t in texts]
        if len(self.cache) > _CACHE:
            self.cache.clear()
        cache = self.cache
        new = {w for ws in split for w in ws if w not in cache}
        self.viterbi(list(new))
        out = []
        for ws in split:
            found = [cache[w] for w in ws]
            ids = array("I")
            ids.frombytes(b"".join([f[0] for f in found]))
            out.append((ids, sum([f[1] for f in found])))
        for w in new:
            if len(w) > _LONG:
                del cache[w]
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids; byte pieces are joined and decoded as UTF-8."""
        readable = self.readable
        try:
            text = "".join(map(readable.__getitem__, ids))
        except TypeError:  # None stands for a byte piece
            text = b"".join([bytes([self.of_byte[i]]) if i in self.of_byte else readable[i].encode() for i in ids]).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_models: dict[str, UnigramPieces] = {}


def model(model_file: str) -> UnigramPieces:
    if model_file not in _models:
        _models[model_file] = UnigramPieces(model_file)
    return _models[model_file]


def _little(ids: array) -> array:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids


def _encode(model_file: str, keep_ids: bool):
    def run(batches):
        m = model(model_file)
        for batch in batches:
            for a in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(a, _TEXTS)
                texts = part.column(1).to_pylist()
                found = m.encode_batch(texts)
                columns = [part.column(0), pa.array([s for _, s in found])]
                if keep_ids:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([list(i) for i, _ in found], pa.list_(pa.int32()))], ["doc_id", "score", "ids"])
                else:
                    back = [m.decode(i) == t.replace(MARK, " ") for (i, _), t in zip(found, texts)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([len(i) for i, _ in found], pa.int64()), pa.array([zlib.crc32(_little(i)) for i, _ in found], pa.int64()), pa.array(back)], ["doc_id", "score", "n_pieces", "ids_crc32", "restored"])

    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row a document: doc_id, score and ids (or, without them, their count, crc and whether
    decoding restores the text).

    Null texts count as empty and have no pieces.  A space mark in a text is a space, as in the
    library.  Null ids and repeated rows are kept; other columns are ignored; an empty table gives
    no rows.  Among segmentations of equal score the longest last piece wins.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kinds = "ids array<int>" if keep_ids else "n_pieces long, ids_crc32 long, restored boolean"
    return rows.mapInArrow(_encode(model_file, keep_ids), f"doc_id long, score double, {kinds}")


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row a sequence: doc_id and its text; null ids give an empty text."""
    ship(encoded.sparkSession)

    def run(batches):
        m = model(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
