"""Decoded labels of whole documents inside one row: no shuffle, window or join.

The row-local form of what :mod:`tessera.operators.decode` and :mod:`tessera.operators.entities` do on word rows. Candidates come
as they left the documents' rows: a document's head, which holds the true ``labels`` of its words, and behind it its pieces in
order, in the same task. They become ``(document, real, said0, said1, ...)``: the label ids of its words, true and said at each
cell of a grid, by place; ``O`` where nothing is said.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.bio import ENTITY_TYPES
from ..schema import LABELS, O_ID, O_LABEL, RewriteMode

#: Of a word that nothing is said of.
NEVER = np.iinfo(np.int64).max

_IDS, _NAMES = T.ArrayType(T.ByteType()), T.ArrayType(T.StringType())
#: Every label that is given or that a repair can write: a rewritten prefix may make one that the label set lacks.
NAMES = (*LABELS, *sorted({p + x[1:] for x in LABELS if x != O_LABEL for p in "BI"} - set(LABELS)))
_TYPE = np.array([-1 if x == O_LABEL else ENTITY_TYPES.index(x[2:]) for x in NAMES], np.int8)
_BEGINS = np.array([x.startswith("B-") for x in NAMES])
_BEGUN, _GONE_ON = (np.array([i if x == O_LABEL else NAMES.index(p + x[1:]) for i, x in enumerate(NAMES)], np.int8) for p in "BI")


def _said(n: int) -> list[str]:
    return [f"said{i}" for i in range(n)]


def said_by_document(live: DataFrame, n: int) -> DataFrame:
    """:func:`~tessera.operators.decode.sweep_words` of ``live(document, labels, token, _k0, ...)``, pieces that fire at some of
    ``n`` thresholds behind their document's head, in the order of the documents' rows: of every word the first that fires."""
    keys = [f"_k{i}" for i in range(n)]
    names = ["document", "real", *_said(n)]
    schema = T.StructType([live.schema["document"], *[T.StructField(x, _IDS) for x in names[1:]]])

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        labels = rows.column("labels")
        head = labels.is_valid().to_numpy(zero_copy_only=False)
        real = labels.filter(pa.array(head))
        offsets = np.concatenate([[0], np.cumsum(real.value_lengths().to_numpy())]).astype(np.int32)
        piece = np.flatnonzero(~head)
        word = offsets[np.cumsum(head)[piece] - 1] + rows.column("token").to_numpy(zero_copy_only=False)[piece]
        order = np.argsort(word, kind="stable")
        piece, word = piece[order], word[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        lists = [real.flatten()]
        for key in keys:
            k = rows.column(key).fill_null(NEVER).to_numpy()[piece]
            out = np.full(offsets[-1], O_ID, np.int8)
            if len(first):
                least = np.minimum.reduceat(k, first)
                out[word[first]] = np.where(least < NEVER, least % 16, O_ID)
            lists.append(pa.array(out))
        columns = [rows.column("document").filter(pa.array(head)), *[pa.ListArray.from_arrays(pa.array(offsets), x) for x in lists]]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a document that may go on
        for batch in batches:
            heads = np.flatnonzero(batch.column("labels").is_valid().to_numpy(zero_copy_only=False))
            if len(batch) and not held and not (len(heads) and heads[0] == 0):
                raise ValueError("a document's pieces came without its head")
            if len(heads):
                done = [*held, batch.slice(0, heads[-1])]
                held = [batch.slice(heads[-1])]
                if sum(map(len, done)):
                    yield whole(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            elif len(batch):
                held.append(batch)
        if held:
            yield whole(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return live.select("document", "labels", "token", *keys).mapInArrow(run, schema)


def repaired_documents(docs: DataFrame, modes: Sequence[int]) -> DataFrame:
    """BIO repair (:func:`~tessera.operators.decode.repair_bio`) of every cell under each of ``modes``, by mode first."""
    given = [c for c in docs.columns if c.startswith("said")]
    names = ["document", "real", *_said(len(given) * len(modes))]
    schema = T.StructType([docs.schema["document"], *[T.StructField(x, _IDS) for x in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("real").offsets.to_numpy()
            offsets = offsets - offsets[0]
            begins = np.zeros(offsets[-1] + 1, bool)
            begins[offsets] = True
            cells: list[list[np.ndarray]] = [[] for _ in modes]
            for name in given:
                said = batch.column(name).flatten().to_numpy()
                kind = _TYPE[said]
                # The word before is of the same document and says the same type.
                cont = ~begins[:-1] & (np.concatenate([[-1], kind[:-1]])[:len(kind)] == kind) & (kind >= 0)
                for mode, out in zip(modes, cells):
                    new = said
                    if mode != RewriteMode.NO_REWRITE:
                        new = np.where(~_BEGINS[said] & ~cont, _BEGUN[said], said)
                    if mode == RewriteMode.REWRITE_BOTH:
                        new = np.where(_BEGINS[said] & cont, _GONE_ON[said], new)
                    out.append(new)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for out in cells for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("document"), batch.column("real"), *lists], names)

    return docs.select("document", "real", *given).mapInArrow(run, schema)


def label_lists(docs: DataFrame, cells: Sequence[tuple[int, float]] | None = None) -> DataFrame:
    """``(document, labels_real, labels_pred)`` by name, or with ``cells`` (mode, threshold) ``(mode, threshold, ...)``, a row for
    each cell of a document."""
    given = _said(len(cells) if cells else 1)
    lists = [docs.schema["document"], T.StructField("labels_real", _NAMES), T.StructField("labels_pred", _NAMES)]
    grid = [T.StructField("mode", T.IntegerType()), T.StructField("threshold", T.DoubleType())] if cells else []
    schema = T.StructType([*grid, *lists])

    def named(ids: pa.ListArray) -> pa.ListArray:
        offsets = ids.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(NAMES).take(ids.flatten()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            real = named(batch.column("real"))
            for i, name in enumerate(given):  # a cell at a time: a long document's lists aren't held twelve times over
                cell = [pa.array(np.full(len(batch), cells[i][0], np.int32)), pa.array(np.full(len(batch), cells[i][1]))] if cells else []
                yield pa.RecordBatch.from_arrays([*cell, batch.column("document"), real, named(batch.column(name))], schema.names)

    return docs.select("document", "real", *given).mapInArrow(run, schema)
