"""Fill-in-the-middle examples by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers, its UTF-8 text
and the sentinels. Cutting splits a descriptor, an arrangement permutes them, and the inverse
permutation brings the text back. Text is never moved in between: hashes and outputs read the
descriptors one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import raw_texts, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: The pieces of a text in the order that a form puts them: prefix 0, middle 1, suffix 2.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: The mark before each piece, by its number above.
MARK_OF = (0, 2, 1)
#: Bytes of text that a result batch holds, about; a bound on memory only.
BATCH_BYTES = 16 << 20

TEXT, SENTINELS = 0, 1


@dataclass(frozen=True)
class Piece:
    """``length`` bytes of a buffer (``TEXT`` or ``SENTINELS``) from ``start`` on."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """A sequence of pieces over a text and the sentinels; operations return a new table."""

    def __init__(self, text: bytes, marks: Sequence[bytes], pieces: Sequence[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(b"".join(marks)))
        self.marks = tuple(marks)
        self.pieces = (Piece(TEXT, 0, len(text)),) if pieces is None else tuple(pieces)

    def _with(self, pieces: Sequence[Piece]) -> PieceTable:
        made = object.__new__(PieceTable)
        made.buffers, made.marks, made.pieces = self.buffers, self.marks, tuple(pieces)
        return made

    def cut(self, offset: int) -> PieceTable:
        """Split at ``offset`` bytes; there is always one piece more, if need be an empty one."""
        before = 0
        for i, piece in enumerate(self.pieces):
            if offset <= before + piece.length:
                left = Piece(piece.buffer, piece.start, offset - before)
                right = Piece(piece.buffer, piece.start + left.length, piece.length - left.length)
                return self._with([*self.pieces[:i], left, right, *self.pieces[i + 1 :]])
            before += piece.length
        raise ValueError(f"offset {offset} is beyond the {before} bytes of the table")

    def permute(self, order: Sequence[int]) -> PieceTable:
        return self._with([self.pieces[i] for i in order])

    def restore(self, order: Sequence[int]) -> PieceTable:
        """Undo ``permute(order)``."""
        inverse = [0] * len(order)
        for place, i in enumerate(order):
            inverse[i] = place
        return self.permute(inverse)

    def marked(self, numbers: Sequence[int]) -> PieceTable:
        """Put the mark ``numbers[i]`` before piece ``i``."""
        starts = np.concatenate([[0], np.cumsum([len(m) for m in self.marks])])
        out = []
        for number, piece in zip(numbers, self.pieces, strict=True):
            out += [Piece(SENTINELS, int(starts[number]), len(self.marks[number])), piece]
        return self._with(out)

    def unmarked(self, numbers: Sequence[int]) -> PieceTable:
        """Undo ``marked(numbers)`` on a table with one piece: cut around the marks, drop them.

        The marks stand in the order of ``numbers``, each once, the first at the start.
        """
        (whole,) = self.pieces
        data = bytes(self.buffers[whole.buffer][whole.start : whole.start + whole.length])
        cuts = [(at := data.index(self.marks[n]), at + len(self.marks[n])) for n in numbers]
        ends = [at for at, _ in cuts[1:]] + [len(data)]
        return self._with(
            [Piece(whole.buffer, whole.start + start, end - start) for (_, start), end in zip(cuts, ends)]
        )

    def views(self) -> Iterator[memoryview]:
        for piece in self.pieces:
            yield self.buffers[piece.buffer][piece.start : piece.start + piece.length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.views())


def line_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the units ``[^\\n]*\\n|[^\\n]+`` of a text end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and not text.endswith(b"\n") else ends


def code_points(view: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(view, np.uint8) & 0xC0) != 0x80))


@dataclass(frozen=True)
class Rules:
    """How documents are drawn: percent that are rearranged, of these percent in the form spm."""

    seed: int = 7
    rearranged: int = 100
    spm: int = 50
    marks: tuple[bytes, ...] = tuple(m.encode() for m in MARKS)

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits that depend on the seed and the id only."""
        told = f"{self.seed}:{'' if doc_id is None else doc_id}"
        whole = hashlib.sha256(told.encode()).hexdigest()
        return [int(whole[i : i + 8], 16) for i in range(0, 32, 8)]

    def arrange(self, doc_id: int | None, text: bytes) -> tuple[int, str, PieceTable, tuple[int, int] | None]:
        """Units, form, output, and the code points of prefix and middle."""
        ends = line_ends(text)
        whole = PieceTable(text, self.marks)
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or h3 % 100 >= self.rearranged or any(m in text for m in self.marks):
            return len(ends), "plain", whole, None
        form = "spm" if h4 % 100 < self.spm else "psm"
        first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
        offsets = np.concatenate([[0], ends])
        pieces = whole.cut(int(offsets[first])).cut(int(offsets[last]))
        prefix, middle, _ = pieces.views()
        order = ARRANGEMENTS[form]
        output = pieces.permute(order).marked([MARK_OF[i] for i in order])
        return len(ends), form, output, (code_points(prefix), code_points(middle))

    def rebuild(self, output: bytes, form: str) -> PieceTable:
        """The text, from an output and its form alone."""
        whole = PieceTable(output, self.marks)
        if form == "plain":
            return whole
        order = ARRANGEMENTS[form]
        return whole.unmarked([MARK_OF[i] for i in order]).restore(order)


ARRANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def fill_in_middle(
    docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every whole document into prefix, middle and suffix at line ends and rearrange it.

    Returns a row per row of ``docs``: ``doc_id``, ``n`` (lines), ``form`` (plain, psm or spm),
    ``prefix_chars`` and ``middle_chars`` (null for plain), ``output`` and ``output_sha256``. A null text
    counts as empty, an empty text or one that holds a mark stays plain. Cuts depend on the id: rows
    without an id are drawn alike (as the empty id), repeated rows get equal results. An empty table
    gives no rows. Other columns are not read.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            ids, ns, forms, prefixes, middles, outputs, digests = zip(*rows)
            texts = pa.array(outputs, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()),
                 pa.array(middles, pa.int64()), texts, pa.array(digests)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                if held and held + len(text or b"") > BATCH_BYTES:
                    yield out()
                    rows, held = [], 0
                n, form, output, sizes = rules.arrange(doc_id, text or b"")
                content = output.content()
                rows.append((doc_id, n, form, *(sizes or (None, None)), content, output.sha256()))
                held += len(content)
        if rows:
            yield out()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, ARRANGED)


def restored(arranged: DataFrame, rules: Rules | None = None, digest_only: bool = False) -> DataFrame:
    """Add ``restored`` (unless ``digest_only``) and ``restored_sha256`` to rows of ``fill_in_middle``.

    Both come from ``output`` and ``form`` alone. With ``digest_only`` the output is dropped, too: the
    descriptors are hashed, and no text leaves the task.
    """
    rules = rules or Rules()
    names = arranged.columns
    kept = [c for c in names if not (digest_only and c == "output")]
    more = [] if digest_only else ["restored"]
    at_output, at_form = names.index("output"), names.index("form")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in arranged.schema if f.name in kept]
    schema = ", ".join([*fields, *(f"{c} string" for c in more), "restored_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(raw_texts(batch.column(at_output)), batch.column(at_form).to_pylist())
            digests, texts = [], []
            for output, form in pairs:
                rebuilt = rules.rebuild(output, form)
                digests.append(rebuilt.sha256())
                if not digest_only:
                    texts.append(rebuilt.content())
            columns = [batch.column(names.index(c)) for c in kept]
            if not digest_only:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], [*kept, *more, "restored_sha256"])

    return arranged.mapInArrow(run, schema)


def middle_query(spark, folder: str) -> DataFrame:
    """op13: all ``documents``."""
    return restored(fill_in_middle(table(spark, folder, "documents")), digest_only=True)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', doc_id)) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix,
    array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
