"""Encoding and decoding with a tokenizer file, exactly as its library does.

Texts are cut at ASCII white space, across which the tokenizer never merges, and
pieces of ASCII and Latin-1 letters into the runs that the tokenizer's own
splitting leaves unsplit; a process remembers the ids of what it has met, within
bounds. A run longer than ``LONG`` is encoded by tree concatenation: it is halved
down to leaves, and neighbouring results are joined by encoding a window around the join
anew, growing it until on either side a whole token pair has the same place and
id in the window and in the half. Neighbours within an encoding decide it, so
the joined ids are those of the whole run.

Texts above ``part_chars`` are cut into parts that are encoded by different
tasks, unsplit runs of that size into pieces that are joined in the same way when
the parts of a text come together again.

Defined cases: null is the empty text, which has no ids and decodes to ''; rows
are encoded once each, repeated ones too. Only ``doc_id`` and ``text`` are read.
The tokenizer file must lie at the same path on every machine.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitframe.llm.common import map_rows

PIECES = re.compile(r"[^ \t\n\r\f\v]+")
# Texts of these characters alone are split and lower-cased here as the tokenizer does it.
SIMPLE = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
LONG = 512
LEAF = 256
WINDOW = 32
MEMORY = 50_000
TEXTS_AT_ONCE = 64
END = "</w>"

Run = tuple[list[int], list[int]]  # ids, and where each token ends


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


BYTE_LETTERS = byte_letters()


@functools.cache
def encoder_of(path: str) -> "Encoder":
    """One encoder per process, so what it has learned outlives a task."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def words_of_ids(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    # Pieces and texts

    def keys_of(self, text: str) -> list[str]:
        """What a text is made of: plain runs, and whole pieces after a line break."""
        if SIMPLE.match(text) and not (self.split_added and self.split_added.search(text)):
            return RUNS.findall(text.lower())
        keys: list[str] = []
        for piece in PIECES.findall(text):
            if SIMPLE.match(piece) and not (self.split_added and self.split_added.search(piece)):
                keys += RUNS.findall(piece.lower())
            else:
                keys.append("\n" + piece)
        return keys

    def known(self, key: str) -> tuple[bytes, str]:
        """Ids and words of a key; those of two generations are remembered."""
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.long_piece(key[1:]) if key[0] == "\n" else self.plain_run(key)
            if len(key) > LONG:
                return found
            if len(self.young) >= MEMORY:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def plain_run(self, run: str) -> tuple[bytes, str]:
        run = run if run.isascii() else "".join(map(BYTE_LETTERS.__getitem__, run.encode()))
        if len(run) > LONG:
            ids = np.array(self.tree(run)[0], "<u4")
            return ids.tobytes(), self.words_of_ids(ids)
        tokens = self.tokenizer.model.tokenize(run)
        return b"".join([self.packed[t.id] for t in tokens]), " ".join([t.value for t in tokens])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian bytes and the decoded text, per text."""
        for text in texts:
            get, known = self.young.get, self.known
            found = [get(k) or known(k) for k in self.keys_of(text)]
            yield b"".join([ids for ids, _ in found]), " ".join([words for _, words in found if words])

    def long_piece(self, piece: str) -> tuple[bytes, str]:
        ids = np.fromiter((i for run in self.runs(piece) for i in self.run_ids(run)), "<u4")
        return ids.tobytes(), self.words_of_ids(ids)

    def runs(self, piece: str) -> Iterator[str | int]:
        """The tokenizer's unsplit runs, and ids of added tokens between them."""
        for part in self.split_added.split(piece) if self.split_added else [piece]:
            if part in self.added:
                yield self.added[part]
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                yield from (run for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain))

    def run_ids(self, run: str | int) -> list[int]:
        return [run] if isinstance(run, int) else self.tree(run)[0]

    # Runs

    def whole(self, run: str) -> Run:
        tokens = self.tokenizer.model.tokenize(run)
        lengths = [len(t.value) for t in tokens]
        if tokens and tokens[-1].value.endswith(END):
            lengths[-1] -= len(END)
        return [t.id for t in tokens], np.cumsum(lengths).tolist()

    def tree(self, run: str) -> Run:
        if len(run) <= LEAF:
            return self.whole(run)
        middle = len(run) // 2
        return self.joined(run, middle, self.tree(run[:middle]), self.tree(run[middle:]))

    def joined(self, run: str, middle: int, left: Run, right: Run) -> Run:
        """The encoding of ``run`` from those of its two sides."""
        right = right[0], [e + middle for e in right[1]]
        width = WINDOW
        while True:
            start, end = max(0, middle - width), min(len(run), middle + width)
            ids, ends = self.whole(run[start:end])
            window = ids, [e + start for e in ends]
            a = (0, 0) if start == 0 else common_pair(left, 0, window, start, last=False)
            b = (len(right[0]), len(ids)) if end == len(run) else common_pair(right, middle, window, start, last=True)
            if a and b and a[1] <= b[1]:
                return (
                    left[0][: a[0]] + ids[a[1] : b[1]] + right[0][b[0] :],
                    left[1][: a[0]] + window[1][a[1] : b[1]] + right[1][b[0] :],
                )
            width *= 2


def common_pair(side: Run, offset: int, window: Run, start: int, last: bool) -> tuple[int, int] | None:
    """Indices between two neighbouring tokens that stand alike in both encodings.

    The first such place in the window, or the last one; None without any.
    """
    ids, ends = side
    begins = [offset, *ends[:-1]]
    low = int(np.searchsorted(ends, start, side="right"))
    spans = {(begins[i], ends[i], ids[i]): i for i in range(low, len(ids)) if begins[i] >= start}
    w_ids, w_ends = window
    w_begins = [start, *w_ends[:-1]]
    order = range(len(w_ids) - 1)
    for j in reversed(order) if last else order:
        i = spans.get((w_begins[j], w_ends[j], w_ids[j]))
        if i is not None and spans.get((w_begins[j + 1], w_ends[j + 1], w_ids[j + 1])) == i + 1:
            return i + 1, j + 1
    return None


# Texts that are encoded by more than one task

PLAIN, RUN, MORE = 0, 1, 2  # a part of text, the first piece of a run, a further piece


def parts_of(text: str, encoder: Encoder, size: int) -> Iterator[tuple[int, str]]:
    """A text in order: parts cut at white space, and pieces of runs longer than ``size``."""
    begin = end = 0
    for piece in PIECES.finditer(text):
        if piece.end() - piece.start() > size:
            if begin < end:
                yield PLAIN, text[begin:end]
            for run in encoder.runs(piece.group()):
                if isinstance(run, int):
                    yield PLAIN, encoder.tokenizer.id_to_token(run)
                else:
                    for at in range(0, len(run), size):
                        yield (MORE if at else RUN), run[at : at + size]
            begin = end = piece.end()
        else:
            if piece.end() - begin > size and begin < end:
                yield PLAIN, text[begin:end]
                begin = end
            end = piece.end()
    if begin < end:
        yield PLAIN, text[begin:end]


def encoded(documents: DataFrame, path: str, part_chars: int = 1 << 20) -> DataFrame:
    """``doc_id, ids, decoded``: ids as little-endian unsigned 32-bit integers, in order."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    length = F.coalesce(F.length("text"), F.lit(0))
    result = "doc_id long, ids binary, decoded string"
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def short_rows(batches):
        for batch in batches:
            encoder = encoder_of(path)
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [t.as_py() or "" for t in part.column(1)]
                for key, (ids, decoded) in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    yield key, ids, decoded

    def cut_rows(batches):
        for batch in batches:
            encoder = encoder_of(path)
            for row, key, text in zip(*(batch.column(i) for i in range(3))):
                for number, (kind, body) in enumerate(parts_of(text.as_py(), encoder, part_chars)):
                    yield row.as_py(), key.as_py(), number, kind, body

    def part_rows(batches):
        for batch in batches:
            encoder = encoder_of(path)
            for row, key, number, kind, body in zip(*(batch.column(i) for i in range(5))):
                kind, body = kind.as_py(), body.as_py()
                if kind == PLAIN:
                    ids, _ = next(encoder.encode([body]))
                    ends = b""
                    body = ""
                else:
                    own_ids, own_ends = encoder.tree(body)
                    ids, ends = np.array(own_ids, "<u4").tobytes(), np.array(own_ends, "<i8").tobytes()
                yield row.as_py(), key.as_py(), number.as_py(), kind, body, ids, ends

    def together(key, table):
        encoder = encoder_of(path)
        out, run = [], None
        for part in table.sort_by("number").to_pylist():
            ids, ends = np.frombuffer(part["ids"], "<u4"), np.frombuffer(part["ends"], "<i8")
            own = part["body"], (ids.tolist(), ends.tolist())
            if part["kind"] == MORE:
                body = run[0] + own[0]
                run = body, encoder.joined(body, len(run[0]), run[1], own[1])
                continue
            if run:
                out.append(np.array(run[1][0], "<u4"))
                run = None
            if part["kind"] == RUN:
                run = own
            else:
                out.append(ids)
        if run:
            out.append(np.array(run[1][0], "<u4"))
        ids = np.concatenate([np.empty(0, "<u4"), *out])
        row = [key[1].as_py()], [ids.tobytes()], [encoder.words_of_ids(ids)]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

    short = map_rows(texts.where(length <= part_chars), short_rows, result, arrow)
    long = texts.where(length > part_chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    number = [("row", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()), ("kind", pa.int32()), ("body", pa.string())]
    cut = map_rows(
        long, cut_rows, "row long, doc_id long, number int, kind int, body string", pa.schema(number)
    ).repartition("row", "number")
    coded = map_rows(
        cut, part_rows, "row long, doc_id long, number int, kind int, body string, ids binary, ends binary",
        pa.schema([*number, ("ids", pa.binary()), ("ends", pa.binary())]),
    )
    return short.unionByName(coded.groupBy("row", "doc_id").applyInArrow(together, result))
