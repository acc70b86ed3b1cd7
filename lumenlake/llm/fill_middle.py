"""Fill-in-the-middle documents by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that are never changed: its own text and the
sentinels. Cutting splits a descriptor in two, an arrangement permutes descriptors and puts those of sentinels between them,
and the inverse permutation restores; bytes are copied only where an output is written, and digests are fed descriptor by
descriptor. Cuts lie between tokens: runs of A-Z and a-z, and every other code point.

A row's draw is the hexadecimal SHA-256 of the seed, a colon and its id; its first four groups of eight digits, h1 to h4,
choose both cuts (h1 and h2 modulo n + 1), whether a text stays plain (h3 modulo 100) and the order of its parts (h4).
Rows are independent of one another: one pass over the texts, no shuffle.

Defined results: null text is empty, and empty text is plain; a text that holds a sentinel is plain, as it could not be told
apart; a null id draws as "null"; rows that share an id draw alike; other columns are ignored. A task holds a block of
texts, or one longer text, and as much output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textblocks import BYTES, Block, blocks

TEXT, MARKS = 0, 1
#: the sentinels, and where each lies in their buffer
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
MARK_BUFFER = b"".join(SENTINELS.values())
WIDTH = 3
#: the parts of a form in the order of its output
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
LETTER = ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122))


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


Table = list[Piece]


def mark(part: str) -> Piece:
    return Piece(MARKS, MARK_BUFFER.index(SENTINELS[part]), WIDTH)


def cut(table: Table, *places: int) -> list[Table]:
    """The table in parts that end at rising places, and the rest; the descriptor that holds a place is split there."""
    out: list[Table] = []
    rest, at = list(table), 0
    for place in places:
        part: Table = []
        while rest and at + rest[0].length <= place:
            part.append(rest.pop(0))
            at += part[-1].length
        if rest and place > at:
            b, start, length = rest[0]
            part.append(Piece(b, start, place - at))
            rest[0] = Piece(b, start + place - at, length - (place - at))
            at = place
        out.append(part)
    return [*out, rest]


def arranged(parts: dict[str, Table], form: str) -> Table:
    """The parts in the order of a form, each behind its sentinel."""
    return [piece for name in FORMS[form] for piece in (mark(name), *parts[name])]


def disarranged(output: memoryview, form: str) -> Table:
    """Descriptors over an output that give back its text: cut at the sentinels, which are dropped, in the first order."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    held, places = bytes(output), []
    for name in FORMS[form]:
        places.append(held.index(SENTINELS[name], places[-1] + WIDTH if places else 0))
    cuts = [x for p in places for x in (p, p + WIDTH)]
    pieces = cut([Piece(TEXT, 0, len(output))], *cuts)
    own = dict(zip(FORMS[form], pieces[2::2], strict=True))
    return [*own["prefix"], *own["middle"], *own["suffix"]]


def streamed(table: Table, text: memoryview) -> Iterator[memoryview]:
    """The bytes of a table, a descriptor at a time."""
    buffers = text, memoryview(MARK_BUFFER)
    for b, start, length in table:
        yield buffers[b][start : start + length]


def digest(table: Table, text: memoryview) -> str:
    out = hashlib.sha256()
    for part in streamed(table, text):
        out.update(part)
    return out.hexdigest()


def token_starts(b: Block) -> np.ndarray:
    """Where tokens begin: at code points, but not at a letter that follows one in its row."""
    point = (b.data & 0xC0) != 0x80
    letter = LETTER[b.data]
    follows = np.zeros(len(letter), bool)
    follows[1:] = letter[1:] & letter[:-1]
    starts = b.offs[:-1]
    follows[starts[starts < len(letter)]] = False
    return np.flatnonzero(point & ~follows)


def _rows_with_sentinels(b: Block) -> np.ndarray:
    d, out = b.data, np.zeros(b.rows, bool)
    if len(d) >= WIDTH:
        at = np.flatnonzero((d[:-2] == 60) & (d[2:] == 62) & np.isin(d[1:-1], np.frombuffer(b"PSM", np.uint8)))
        row = np.searchsorted(b.offs, at, "right") - 1
        out[row[at + WIDTH <= b.offs[row + 1]]] = True
    return out


def draw(doc_id: object, seed: str = SEED) -> list[int]:
    """h1 to h4 of an id."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null where plain), pieces (the
    output's descriptors: buffer 0 is the text, 1 the sentinels; start and length in bytes), output, output_sha256."""
    shape = "doc_id {}, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string"

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids = batch.column(0).slice(b.first, b.rows)
                starts, points = token_starts(b), np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
                first = np.searchsorted(starts, b.offs)
                marked, data = _rows_with_sentinels(b), memoryview(b.data)
                n = np.diff(first)
                forms, chars, tables, outputs, digests = [], [], [], [], []
                for i, doc_id in enumerate(ids.to_pylist()):
                    lo, hi = int(b.offs[i]), int(b.offs[i + 1])
                    text = data[lo:hi]
                    h1, h2, h3, h4 = draw(doc_id, seed)
                    table = [Piece(TEXT, 0, hi - lo)]
                    if lo == hi or marked[i] or h3 % 100 >= plain_from:
                        forms.append("plain")
                        chars.append((None, None))
                    else:
                        forms.append("spm" if h4 % 100 < spm_below else "psm")
                        units = sorted((h1 % (int(n[i]) + 1), h2 % (int(n[i]) + 1)))
                        ends = [int(starts[first[i] + u]) if u < n[i] else hi for u in units]
                        chars.append((int(points[ends[0]] - points[lo]), int(points[ends[1]] - points[ends[0]])))
                        parts = cut(table, *[e - lo for e in ends])
                        table = arranged(dict(zip(("prefix", "middle", "suffix"), parts, strict=True)), forms[-1])
                    tables.append([p._asdict() for p in table])
                    outputs.append(b"".join(streamed(table, text)))
                    digests.append(digest(table, text))
                pieces = pa.array(tables, pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])))
                of = lambda j: pa.array([c[j] for c in chars], pa.int64())
                columns = [ids, pa.array(n.astype(np.int64)), pa.array(forms), of(0), of(1), pieces, pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, shape.format(dict(rows.dtypes)["doc_id"]))


def restored(outputs: DataFrame, keep: tuple[str, ...] = ("doc_id",), form_col: str = "form", output_col: str = "output") -> DataFrame:
    """keep, text and restored_sha256: the exact texts, rebuilt from outputs and forms alone."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in outputs.select(*keep).dtypes)

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(len(keep) + 1)):
                forms = batch.column(len(keep)).slice(b.first, b.rows).to_pylist()
                texts, digests = [], []
                for i, form in enumerate(forms):
                    output = memoryview(b.data)[int(b.offs[i]) : int(b.offs[i + 1])]
                    table = disarranged(output, form)
                    texts.append(b"".join(streamed(table, output)))
                    digests.append(digest(table, output))
                kept = [batch.column(j).slice(b.first, b.rows) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)], [*keep, "text", "restored_sha256"])

    return outputs.select(*keep, form_col, output_col).mapInArrow(run, f"{kinds}, text string, restored_sha256 string")
