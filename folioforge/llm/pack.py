"""Packing by concatenating and cutting.

Pass one encodes every document once and writes its ids to the shared folder with the tokens before it in its own
partition. The totals of the partitions (one small row each) are summed in order; that gives every document its place
in one endless row of tokens. Pass two cuts that row into windows of `window` tokens: a document's ids are cut where a
window ends, and each piece is a boundary record. Only the last sequence can be short, so padding is below one window.

Rows: a null text counts as empty and still has its end id; rows with a null or repeated doc_id are packed like any
other; extra columns are dropped; an empty table gives an empty one. A text of any length is packed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, own_tables, small_batches, write_table

WINDOW = 4096
END_ID = 2
TABLE_WORDS = 400_000
#: Longer chunks and parts are encoded again where they come again.
KEPT_LETTERS = 200
#: Bytes of text that are parted at once (more only where a chunk is longer), and that share one look-up of their distinct units.
SLICE, TOGETHER = 1 << 20, 8 << 20
#: Letters that lower-case and compose alone: a-z and those of Latin-1, with their capitals.
_LOWER = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: ASCII punctuation but the apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A line that is a part: lower-case letters, or punctuation.
_PART = re.compile(r"^(?:[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)$", re.M)
_SPACE, _LETTER, _MARK, _OTHER = range(4)
#: The kind of each byte of UTF-8; a letter of Latin-1 is found by its two bytes.
_KINDS = bytes(_SPACE if chr(c) in " \n" else _LETTER if chr(c) in _LOWER[:26] + _UPPER[:26] else _MARK if chr(c) in _MARKS else _OTHER for c in range(256))
_SMALL = bytes(range(256)).lower()


def _units(data: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of a run of texts in UTF-8, in order, and how many there are up to each of `stops`, where texts end.

    A chunk (what stands between spaces, line ends and ends of texts) of simple letters and punctuation after them gives two
    units, its letters in lower case and the punctuation, or one if there is none; any other chunk is a unit as it stands.
    """
    text = bytearray(data)
    kept = (data != 32) & (data != 10)
    before = np.append(0, np.cumsum(kept, dtype=np.int64))
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    ended = stops[stops < len(data)]
    first[ended] = kept[ended]
    chunks, stops = before[np.flatnonzero(first)], before[stops]
    # From here on without white space.
    kinds, low = (np.frombuffer(text.translate(table, b" \n"), dtype=np.uint8) for table in (_KINDS, _SMALL))
    pairs = np.flatnonzero(low[:-1] == 0xC3)
    pairs = pairs[~np.isin(low[pairs + 1], (0x97, 0xB7))]  # the signs of multiplication and division
    kinds[pairs] = kinds[pairs + 1] = _LETTER
    second = low[pairs + 1]
    low[pairs + 1] = np.where(second < 0x9F, second | 0x20, second)
    opens = np.zeros(len(low) + 1, dtype=bool)
    opens[chunks] = opens[-1] = True
    marks = np.flatnonzero(kinds == _MARK)
    after, inner = marks + 1, marks[~opens[marks]]
    after = after[~opens[after]]
    odd = np.concatenate([np.flatnonzero(kinds == _OTHER), marks[opens[marks]], after[kinds[after] == _LETTER]])
    tails = inner[kinds[inner - 1] == _LETTER]
    if len(odd):
        whole = np.unique(np.searchsorted(chunks, odd, "right")) - 1
        tails = tails[~np.isin(np.searchsorted(chunks, tails, "right") - 1, whole)]
        raw, ends = np.frombuffer(text.translate(None, b" \n"), dtype=np.uint8), np.append(chunks[1:], len(low))
        for i, j in zip(chunks[whole].tolist(), ends[whole].tolist()):
            low[i:j] = raw[i:j]
    opens[tails] = True
    starts = np.flatnonzero(opens)
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(low)), np.searchsorted(starts, stops)


def _slices(data: np.ndarray, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Slices of a run of texts, each of which ends where a chunk does."""
    while end - at > SLICE:
        cut = at + SLICE
        while cut < end and data[cut] not in (32, 10):
            cut += 1
        yield at, cut
        at = cut
    yield at, end


class WordTable:
    """Distinct unit -> its ids: parts (`words`) and chunks that don't part, each encoded once while it stays in the table.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are its chunks' ids in a
    row. A chunk of simple letters and punctuation after them is parted further, as the tokenizer's own pattern does.
    Units are found and numbered by batch, so a table is asked once for each distinct one and ids are placed by number.
    A full table of parts is kept until the next is full; what is still in use goes over.
    """

    def __init__(self, tokenizer_file: str, table_words: int = TABLE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.tok = Tokenizer.from_file(tokenizer_file)
        # Where normalising changes no part, parts go without it.
        self.lower, parts = Tokenizer.from_file(tokenizer_file), " ".join([_LOWER, *_LOWER, _LOWER[::-1], _MARKS])
        if self.lower.normalizer is not None and self.lower.normalizer.normalize_str(parts) == parts:
            self.lower.normalizer = Sequence([])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.most, self.chunks, self.words, self.older = table_words, {"": b""}, {}, {}
        probe = "Ab cd.\nEf, gh ij.$$ kl" + _MARKS + " " + _UPPER
        pieces = ["ab", "cd", ".", "ef", ",", "gh", "ij", ".$$", "kl", _MARKS, _UPPER.lower()]
        self.parted = self._plain(probe) == b"".join(map(self._plain, pieces)) and self.ends[np.frombuffer(self._plain("ab"), dtype="<u4")].sum() == 1

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, many in one call of the library."""
        out = []
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            x = np.asarray(self.lower.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[x]) + 1) * 4).tolist()
            if len(stops) == len(some):
                raw = x.tobytes()
                out += [raw[i:j] for i, j in zip([0, *stops], stops)]
            else:
                out += map(self._plain, some)
        return out

    def _look_up(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, none of which holds a line end."""
        found = list(map(self.words.get, units))
        asked = [u for u, x in zip(units, found) if x is None]
        words = {u: x for u, x in zip(asked, map(self.older.get, asked)) if x is not None}
        new = [u for u in asked if u not in words and u not in self.chunks]
        parts = _PART.findall("\n".join(new))
        odd = list(set(new).difference(parts)) if len(parts) < len(new) else []
        words.update(zip(parts, self._encode(parts)))
        chunks = dict(zip(odd, map(self._plain, odd)))
        rest = iter([words[u] if u in words else chunks[u] if u in chunks else self.chunks[u] for u in asked])
        found = [next(rest) if x is None else x for x in found]
        for some in (words, chunks):  # kept units are short, so the tables' bytes are bounded as their entries are
            for u in [u for u in some if len(u) > KEPT_LETTERS]:
                del some[u]
        if len(self.words) + len(words) > self.most:
            self.words, self.older = {}, self.words
        if len(self.chunks) + len(chunks) > self.most:
            self.chunks = {"": b""}
        self.words.update(islice(words.items(), self.most))
        self.chunks.update(islice(chunks.items(), self.most - 1))
        return found

    def _ids(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts that end at `ends`, and how many there are up to each end."""
        out, stops, total, row, slices = [], [], 0, 0, _slices(data, 0, len(data))
        while some := list(islice(slices, TOGETHER // SLICE)):
            units = []
            for at, cut in some:
                until = int(np.searchsorted(ends, cut, "right"))
                units.append(_units(data[at:cut], ends[row:until] - at))
                row = until
            coded = pa.concat_arrays([x for x, _ in units]).dictionary_encode()
            ids, numbers, at = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(), 0
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            firsts, ids = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), dtype="<u4")
            for x, ending in units:
                number = numbers[at : at + len(x)]
                n = lengths[number]
                done = np.append(0, np.cumsum(n))
                places = np.repeat(firsts[number] - done[:-1], n)
                places += np.arange(len(places))
                out.append(ids[places])
                stops.append(total + done[ending])
                at, total = at + len(x), total + len(places)
        return np.concatenate(out), np.concatenate(stops)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of rows, in order: their ids, and how many there are up to each row's end. A null text counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.parted:
            for t in texts.to_pylist():
                ids = np.frombuffer(self._plain(t), dtype="<u4")
                yield ids, np.array([len(ids)])
            return
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, row = np.frombuffer(data or b"", dtype=np.uint8), 0
        while row < len(texts):
            until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOGETHER, "right")) - 1)
            yield self._ids(data[offsets[row] : offsets[until]], offsets[row + 1 : until + 1] - offsets[row])
            row = until

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for ids, stops in self.encode_column(pa.array(texts, pa.large_string())):
            out += [x.tobytes() for x in np.split(ids, stops[:-1])]
        return out


_tables: dict = {}


def table_for(tokenizer_file: str, table_words: int) -> WordTable:
    """One table for all tasks of a worker process."""
    own_tables("pack", _tables)
    key = (tokenizer_file, table_words)
    if key not in _tables:
        _tables[key] = WordTable(*key)
    return _tables[key]


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches, put together up to the bytes that share a look-up."""

    def joined() -> tuple[pa.Array, pa.Array]:
        return pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])

    held, size = [], 0
    for b in parts:
        if held and size + b.nbytes > TOGETHER:
            yield joined()
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield joined()


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, table_words: int = TABLE_WORDS) -> DataFrame:
    """Pass one: (doc_id, ids binary, n, part, before): a document's ids with its end id, and what comes before it in its partition."""
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("part", pa.int64()), ("before", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, wrap = table_for(tokenizer_file, table_words), batches(schema)
        part, before = TaskContext.get().partitionId(), 0
        for ids_of, texts in _gathered(parts):
            row = 0
            for ids, stops in table.encode_column(texts):
                ids, stops = np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)
                starts = np.append(0, stops[:-1])
                offsets = pa.array(np.append(0, stops) * 4).cast(pa.int32())  # an error from 2 GB of ids in a row on
                binary = pa.Array.from_buffers(pa.binary(), len(stops), [None, offsets.buffers()[1], pa.py_buffer(ids)])
                yield wrap([ids_of.slice(row, len(stops)), binary, stops - starts, np.full(len(stops), part), before + starts])
                row, before = row + len(stops), before + len(ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n long, part long, before long")


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset): the pieces, with their ids."""
    rows = write_table(encoded(docs, tokenizer_file, end_id, table_words), "packed-ids")
    # One row for each partition of the input: the window over them is as small as the list of partitions.
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    firsts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    n_parts = totals.count()
    placed = rows.join(F.broadcast(firsts) if n_parts <= 100_000 else firsts, "part").select("doc_id", "ids", "n", (F.col("first") + F.col("before")).alias("at"))
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            out: list[list] = [[] for _ in schema]
            for doc, ids, n, at in zip(*(c.to_pylist() for c in b.columns)):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    for column, value in zip(out, (doc, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset)):
                        column.append(value)
                    start += length
            yield wrap(out)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def crc32_of(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids (Spark's crc32 of the bytes, unsigned)."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
