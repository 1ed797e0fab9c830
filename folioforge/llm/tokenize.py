"""SentencePiece encoding and decoding by a table of distinct marked words.

When no piece of the model holds a whitespace marker after another character, no merge can cross the start of a marked
word (a run of markers and what follows up to the next marker), so a text's ids are its marked words' ids in a row.
Each worker keeps a table of the distinct marked words it has met, segments the unseen ones once with the library and
joins the stored ids back by position. The table is cleared at `table_words` entries: that repeats work, never drops it.

Rows: a null text counts as empty; every row, repeated or with a null doc_id, gives a row; other columns are dropped;
an empty table gives an empty one. A text of any length is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, own_tables, small_batches, texts_of

MARK = "▁"
TABLE_WORDS = 400_000
#: Longer words are segmented again where they come again.
KEPT_LETTERS = 200
_RUNS = re.compile(" +[^ ]*")


def words_stay_apart(processor) -> bool:
    """Whether every piece holds markers at its start only."""
    return not any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


class MarkedWordTable:
    """Distinct marked word -> its ids as little-endian unsigned 32-bit integers. A key holds the word without its first marker."""

    def __init__(self, model_file: str, table_words: int = TABLE_WORDS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        # Besides the pieces, the library must add one marker before a text and map no other characters.
        probe = ["a", " a", "  a b ", " a\u0001\t"]
        self.apart = words_stay_apart(self.sp) and self.sp.decode(self.sp.encode(probe)) == probe and pieces[self.sp.encode("a")[0]].startswith(MARK)
        self.most, self.ids = table_words, {}

    def segment(self, words: list[str]) -> None:
        """Adds words: many in one call of the library, parted again where a piece starts with a marker."""
        plain = [w for w in words if w and w[0] != " "]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            x = np.asarray(self.sp.encode(" ".join(part), num_threads=1), dtype="<u4")
            starts = np.flatnonzero(self.marked[x]) * 4
            if len(starts) == len(part):
                raw, ends = x.tobytes(), [*starts[1:].tolist(), len(x) * 4]
                for w, i, j in zip(part, starts.tolist(), ends):
                    self.ids[w] = raw[i:j]
            else:
                for w in part:
                    self.ids[w] = np.asarray(self.sp.encode(w), dtype="<u4").tobytes()
        for w in words:
            if not w:
                self.ids[w] = np.asarray([self.sp.piece_to_id(MARK)], dtype="<u4").tobytes()
            elif w[0] == " ":
                self.ids[w] = np.asarray(self.sp.encode(w), dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without begin and end ids."""
        if not self.apart:
            return [np.asarray(x, dtype="<u4").tobytes() for x in self.sp.encode(texts, num_threads=1)]
        split, seen = [], set()
        for t in texts:
            if MARK in t:
                t = t.replace(MARK, " ")
            if not t:
                words = []
            elif "  " in t or t[0] == " " or t[-1] == " ":
                words = [w[1:] for w in _RUNS.findall(" " + t)]
            else:
                words = t.split(" ")
            split.append(words)
            seen.update(words)
        if len(self.ids) > self.most:
            self.ids.clear()
        new = [w for w in seen if w not in self.ids]
        self.segment(new)
        get = self.ids.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:  # kept words are short, so the table's bytes are bounded as its entries are
            if len(w) > KEPT_LETTERS:
                del self.ids[w]
        return out


_tables: dict = {}


def table_for(model_file: str, table_words: int) -> MarkedWordTable:
    """One table for all tasks of a worker process."""
    own_tables("tokenize", _tables)
    key = (model_file, table_words)
    if key not in _tables:
        _tables[key] = MarkedWordTable(*key)
    return _tables[key]


def encode_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id", table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): begin id, pieces, end id, and the library's decoding of those ids."""
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_encoder(model_file, table_words, schema, _rows), "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id", table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same ids and decoding, hashed where they are made."""
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_encoder(model_file, table_words, schema, _digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(ids: list[bytes], decoded: list[str]) -> list:
    return [[np.frombuffer(x, dtype="<i4") for x in ids], decoded]


def _digests(ids: list[bytes], decoded: list[str]) -> list:
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [[len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(t.encode()) for t in decoded]]


def _encoder(model_file: str, table_words: int, schema: pa.Schema, finish):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wrap = table_for(model_file, table_words), batches(schema)
        begin, end = (int(x).to_bytes(4, "little") for x in (table.sp.bos_id(), table.sp.eos_id()))
        for b in parts:
            ids = [begin + x + end for x in table.encode(texts_of(b.column(1)))]
            decoded = []
            for x in ids:
                decoded.append(table.sp.decode(np.frombuffer(x, dtype="<u4").tolist()))
            yield wrap([b.column(0), *finish(ids, decoded)])

    return run
