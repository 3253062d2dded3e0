"""Spans, pieces and alignment of whole documents inside their row: no sort, window or shuffle.

The row-local form of :mod:`tessera.operators.tokens` and :mod:`tessera.operators.pieces`: a document's
tokeniser matches stand in one array, and everything about positions follows from running sums and searches over it.
Spark tokenises, deals and explodes; the helpers below are array arithmetic over an Arrow batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABELS, O_ID, TARGET_LABELS
from .labels import with_phone_labels
from .scoring import hash_columns, hash_keys

#: Of a word: its tokeniser match and flags, offsets, and the code of its mark (0: none).
WORD_FIELDS = {"match": "string", "space": "boolean", "blank": "boolean", "prev_space": "boolean", "char_start": "int",
               "char_end": "int", "code": "int"}
#: Of a piece: number, word it was cut from, offsets, word it is aligned to (:func:`~tessera.operators.pieces.align_pieces`)
#: and that word's match, word whose label it takes (:func:`~tessera.operators.pieces.labelled_pieces`) and, if that is
#: another than its own, match and code of it; -1 for no word.
PIECE_FIELDS = {"piece": "int", "own": "int", "start": "int", "end": "int", "at": "int", "at_match": "string",
                "labelled_by": "int", "other_match": "string", "other_code": "int"}


class Words:
    """Positions of the words of a batch of documents, from their tokeniser matches.

    ``cuts`` are the documents' bounds in the flat arrays, ``base`` the characters of the batch before a word's document:
    ``base + start`` grows over the whole batch, so that one search serves all its documents.
    """

    def __init__(self, matches: pa.ListArray):
        offsets = matches.offsets.to_numpy()
        flat = matches.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.cuts = offsets - offsets[0]
        self.flat = flat
        self.n = len(flat)
        self.doc = np.repeat(np.arange(len(matches)), np.diff(self.cuts))
        _, at, data = flat.buffers()
        at = np.frombuffer(at, np.int32, self.n + 1, 4 * flat.offset) if self.n else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if self.n else np.zeros(0, np.uint8)
        first, last, size = data[at[:-1]], data[at[1:] - 1], np.diff(at)
        before_last = np.where(size > 1, data[np.maximum(at[1:] - 2, 0)], 32)
        # As match_has_space: the last character is a space and the one before is not.
        self.space = (last == 32) & (size > 1) & (before_last != 32)
        # Code points: bytes that don't continue one.
        points = np.concatenate([[0], np.cumsum((data[:at[-1]] & 0xC0) != 0x80)])
        whole = points[at[1:]] - points[at[:-1]]
        self.blank = self._blank(flat, first)
        self.length = whole - self.space
        ends = np.concatenate([[0], np.cumsum(whole)])
        self.base = ends[self.cuts[:-1]][self.doc] if self.n else np.zeros(0, np.int64)
        self.start = ends[:-1] - self.base
        self.end = self.start + self.length
        before = np.concatenate([[False], (self.space | self.blank)[:-1]]) if self.n else np.zeros(0, bool)
        before[self.cuts[:-1][np.diff(self.cuts) > 0]] = False
        self.prev_space = before

    @staticmethod
    def _blank(flat: pa.StringArray, first: np.ndarray) -> np.ndarray:
        """``str.isspace()`` of each match; a visible ASCII character at its head settles most."""
        out = np.zeros(len(first), bool)
        asked = np.flatnonzero((first < 33) | (first > 126))
        if len(asked):
            coded = flat.take(pa.array(asked)).dictionary_encode()
            out[asked] = np.array([s.isspace() for s in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]
        return out


def _listed(cuts: np.ndarray, fields: dict[str, object]) -> pa.ListArray:
    rows = pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rows)


def _taken(flat: pa.StringArray, at: np.ndarray) -> pa.StringArray:
    return flat.take(pa.array(at, mask=at < 0))


def cut_batch(w: Words, piece_len: int, names: Sequence[str]) -> tuple[np.ndarray, dict[str, object]]:
    """The pieces of a batch in order: each word holds those cut from it, with the head before a document's first and the
    tail after its last. The words' bounds among them, and the fields asked for; ``_own`` and ``_by`` are words by position in
    the batch (-1: none)."""
    k = np.where(w.blank, 0, -(-w.length // piece_len))
    cut = np.concatenate([[0], np.cumsum(k)])
    of = np.repeat(np.arange(w.n), k)
    j = np.arange(len(of)) - cut[:-1][of]
    has = np.diff(w.cuts) > 0
    held = k.copy()
    held[w.cuts[:-1][has]] += 1
    held[w.cuts[1:][has] - 1] += 1
    bounds = np.concatenate([[0], np.cumsum(held)])
    place = np.arange(len(of)) + (2 * np.cumsum(has) - 1)[w.doc[of]]
    begin = w.start[of] + piece_len * j
    start = begin - ((j == 0) & w.prev_space[of])

    def put(values: np.ndarray, rest: int) -> np.ndarray:
        out = np.full(bounds[-1], rest, np.int64)
        out[place] = values
        return out

    first = w.cuts[:-1][w.doc]
    in_document = lambda at: np.where(at >= 0, at - first[at], -1).astype(np.int32) if len(first) else at.astype(np.int32)
    out: dict[str, object] = {}
    if "piece" in names:
        holder = np.repeat(np.arange(w.n), held)
        out["piece"] = (np.arange(bounds[-1]) - bounds[:-1][first[holder]]).astype(np.int32)
    if "own" in names:
        out["_own"] = put(of, -1)
        out["own"] = in_document(out["_own"])
    if "start" in names:
        out["start"] = put(start, 0).astype(np.int32)
    if "end" in names:
        out["end"] = put(np.minimum(begin + piece_len, w.end[of]), 0).astype(np.int32)
    if "at" in names or "at_match" in names:
        at = put(aligned_words(w, of, start), -1)
        out["at"] = in_document(at)
        if "at_match" in names:
            out["at_match"] = _taken(w.flat, at)
    if "labelled_by" in names:
        by = label_words(w, of, start)
        out |= {"_by": put(by, -1), "_other": put(np.where(by == of, -1, by), -1)}
        out["labelled_by"] = in_document(out["_by"])
    return bounds, out


def _at_heads(w: Words, bounds: np.ndarray, label: np.ndarray) -> pa.ListArray:
    """For every piece of a batch null, but for the first of a document: the labels of its words."""
    size = np.diff(w.cuts)
    head = bounds[w.cuts[:-1][size > 0]]
    held, rest = np.zeros(bounds[-1] + 1, np.int32), np.ones(bounds[-1], bool)
    held[head + 1], rest[head] = size[size > 0], False
    return pa.ListArray.from_arrays(pa.array(np.cumsum(held, dtype=np.int32)), pa.array(label.astype(np.int8)), mask=pa.array(rest))


def pieces_in_row(w: Words, code: np.ndarray, piece_len: int, names: Sequence[str]) -> pa.ListArray:
    """The pieces of every word as a list (:func:`cut_batch`)."""
    bounds, out = cut_batch(w, piece_len, names)
    if "labelled_by" in names:
        other = out["_other"]
        out |= {"other_match": _taken(w.flat, other),
                "other_code": np.where(other >= 0, code[other], 0).astype(np.int32) if w.n else other.astype(np.int32)}
    return _listed(bounds, {n: out[n] for n in names})


def phone_codes(w: Words, hits: pa.ListArray) -> np.ndarray:
    """Of every word 1 if a phone span begins with it, 2 if one goes on with it, else 0: the row-local form of
    :func:`~tessera.operators.rules.find_spans` and ``span_word_labels``.

    ``hits``: a document's hits as lists of words. Every occurrence of every hit among the document's words is found, word by
    word on codes: a run stays as long as it equals the beginning of some hit of its document, so a document of any length
    is read once for each length of its hits.
    """
    code = np.zeros(w.n, np.int8)
    held = np.asarray(hits.value_lengths().fill_null(0))
    if not held.any():
        return code
    targets = hits.flatten()
    doc, length = np.repeat(np.arange(len(held)), held), np.asarray(targets.value_lengths())
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    asked = np.flatnonzero((held > 0)[w.doc])
    words = w.flat.take(pa.array(asked))
    words = pc.if_else(pa.array(w.space[asked]), pc.utf8_rtrim(words, characters=" "), words)
    coded = pa.concat_arrays([words, targets.flatten()]).dictionary_encode()
    n, ids = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    ids, target_ids = ids[:len(asked)], ids[len(asked):]
    rest = w.cuts[1:][w.doc[asked]] - asked  # words to the document's end
    begins = []
    for size in np.unique(length[length > 0]):
        of = np.flatnonzero(length == size)
        at = np.flatnonzero(rest >= size)
        known, run = doc[of], w.doc[asked[at]]
        for k in range(size):
            wanted, known = np.unique(known * n + target_ids[first[of] + k], return_inverse=True)
            run = run * n + ids[at + k]
            place = np.minimum(np.searchsorted(wanted, run), len(wanted) - 1)
            same = wanted[place] == run
            at, run = at[same], place[same]
        for k in range(1, size):
            code[asked[at + k]] = 2
        begins.append(asked[at])
    code[np.concatenate(begins)] = 1
    return code


def piece_hashes(document: pa.Array, own: np.ndarray, piece: np.ndarray, salt: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each piece's ``document:word:piece``, behind the salt if there is one (:func:`~tessera.operators.scoring.hash_logits`)."""
    parts = [pc.cast(x if isinstance(x, pa.Array) else pa.array(x), pa.string()) for x in (document, own, piece)]
    return hash_keys(pc.binary_join_element_wise(*([] if salt is None else [salt]), *parts, ":"))


def piece_rows(docs: DataFrame, fields: Sequence[str] = (), piece_len: int = 4, salts: Sequence[str | None] = ()) -> DataFrame:
    """``(document, piece, own, *fields, word_label[, label_id][, labels])``: a flat row of every piece, with the label id of the word
    it was cut from (null for specials) and, with ``labelled_by`` among ``fields`` (``PIECE_FIELDS``), the one it is trained on.
    With ``labels`` among them, a document's first row, its head, holds the label ids of all its words; the others hold null.
    For each of ``salts`` come the two integers of a piece's hash (:func:`~tessera.operators.scoring.hash_columns`).

    ``docs``: ``(document, _ms, _ids, _hits)``, a document's tokeniser matches, the words' label ids by the rules that read a word
    alone (:func:`~tessera.operators.labels.match_label_ids`), and its phone hits as lists of words. No list of words or pieces goes back to Spark: the rows leave as flat Arrow columns.
    """
    names = ("piece", "own", *[f for f in fields if f not in ("piece", "own", "labels")])
    kept = [n for n in names if n != "labelled_by"]
    kinds = {"string": T.StringType(), "int": T.IntegerType()}
    labels = ["word_label", *(["label_id"] if "labelled_by" in names else [])]
    schema = T.StructType([docs.schema["document"], *[T.StructField(n, kinds[PIECE_FIELDS[n]]) for n in kept],
                           *[T.StructField(n, T.IntegerType()) for n in labels],
                           *([T.StructField("labels", T.ArrayType(T.ByteType()))] if "labels" in fields else []),
                           *[T.StructField(n, T.LongType()) for salt in salts for n in hash_columns(salt)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document = batch.column("document")
            w, label = _labelled(batch)
            bounds, out = cut_batch(w, piece_len, names)
            own = out["_own"]
            out["word_label"] = pa.array(label[own] if w.n else own, pa.int32(), mask=own < 0)
            if "labelled_by" in names:
                by = out["_by"]
                out["label_id"] = np.where(by >= 0, label[by], O_ID).astype(np.int32) if w.n else by.astype(np.int32)
            holder = np.repeat(np.arange(len(document)), np.diff(bounds[w.cuts]))
            holders = document.take(pa.array(holder))
            columns = [holders, *[out[n] for n in (*kept, *labels)]]
            if "labels" in fields:
                columns.append(_at_heads(w, bounds, label))
            for salt in salts:
                columns += piece_hashes(holders, out["own"], out["piece"], salt)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names)

    return docs.select("document", "_ms", "_ids", "_hits").mapInArrow(run, schema)


#: What counts as a target word, by label id.
_TARGET = np.array([x in TARGET_LABELS for x in LABELS])
_EXAMPLE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("piece", "start", "end", "label_id")]))


def _labelled(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """The words of a batch of ``_ms, _ids, _hits`` (:func:`piece_rows`) and their label ids."""
    w = Words(batch.column("_ms"))
    ids = batch.column("_ids").flatten().to_numpy(zero_copy_only=False)
    return w, with_phone_labels(ids, phone_codes(w, batch.column("_hits")), w.blank)


def _per_list(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the lists with the bounds ``cuts``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])


def cut_examples(w: Words, label: np.ndarray, doc: np.ndarray, skip: np.ndarray, max_length: int,
                 piece_len: int = 4) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Training examples of a batch: of document ``doc[i]`` without its first ``skip[i]`` words, spans anew from the first word
    left, at most ``max_length`` pieces. Their pieces, the words that are left and the target words among them."""
    first = w.cuts[doc] + skip
    n = w.cuts[doc + 1] - first
    cuts = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(cuts[-1]) + np.repeat(first - cuts[:-1], n)
    left = Words(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), w.flat.take(pa.array(at))))
    label = label[at]
    bounds, out = cut_batch(left, piece_len, ("piece", "own", "start", "end", "labelled_by"))
    piece, by, special = out["piece"], out["_by"], out["_own"] < 0
    keep = special | (piece <= max_length - 2)
    pieces = {"piece": np.where(piece > max_length - 2, max_length - 1, piece), "start": out["start"], "end": out["end"],
              "label_id": np.where(by >= 0, label[by], O_ID) if len(label) else by}
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds[cuts]]
    return _listed(kept, {k: v[keep].astype(np.int32) for k, v in pieces.items()}), n, _per_list(_TARGET[label], cuts)


def document_examples(docs: DataFrame, max_length: int) -> DataFrame:
    """:func:`tessera.operators.prepare.training_examples` of documents in one row, ``(document, _ms, _ids, _hits[, _skip])``:
    ``_skip`` words are left out at the left of a document that was labelled whole."""
    cut = ["_skip"] if "_skip" in docs.columns else []
    ints = [T.StructField(n, T.IntegerType()) for n in ("length", "target_num", "group")]
    schema = T.StructType([docs.schema["document"], T.StructField("pieces", _EXAMPLE), *ints])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, label = _labelled(batch)
            skip = batch.column("_skip").fill_null(0).to_numpy() if cut else np.zeros(len(batch), np.int32)
            pieces, n, targets = cut_examples(w, label, np.arange(len(batch)), skip, max_length)
            columns = [batch.column("document"), pieces, pieces.value_lengths(), pa.array(targets.astype(np.int32)),
                       pa.array((targets > 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(n > 0))

    return docs.select("document", "_ms", "_ids", "_hits", *cut).mapInArrow(run, schema)


def planned_documents(docs: DataFrame, keep_last: int | None, max_length: int) -> DataFrame:
    """:func:`tessera.operators.prepare.planned_examples` of documents in one row with the entries of the plan that read them,
    ``(_plan, _ms, _ids, _hits)``: a document is cut into words once, whatever examples it gives."""
    entry = docs.schema["_plan"].dataType.elementType
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in entry], T.StructField("pieces", _EXAMPLE),
                           T.StructField("length", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, label = _labelled(batch)
            plan = batch.column("_plan")
            doc = np.repeat(np.arange(len(batch)), plan.value_lengths().fill_null(0).to_numpy())
            entries = plan.flatten()
            cut = entries.field("cut").to_numpy(zero_copy_only=False).astype(bool)
            skip = np.where(cut, np.maximum(np.diff(w.cuts)[doc] - keep_last, 0), 0) if keep_last is not None else np.zeros(len(doc), np.int64)
            pieces, n, _ = cut_examples(w, label, doc, skip, max_length)
            columns = [*entries.flatten(), pieces, pieces.value_lengths()]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(n > 0))

    return docs.select("_plan", "_ms", "_ids", "_hits").mapInArrow(run, schema)


def document_counts(docs: DataFrame, keep_last: int | None) -> DataFrame:
    """``(document, n_words, targets, cut_targets)`` of documents in one row that have words
    (:func:`tessera.operators.prepare.cut_counts`)."""
    schema = T.StructType([docs.schema["document"], T.StructField("n_words", T.IntegerType()), T.StructField("targets", T.LongType()),
                           T.StructField("cut_targets", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, label = _labelled(batch)
            n, hit = np.diff(w.cuts), _TARGET[label]
            place = np.arange(w.n) - w.cuts[:-1][w.doc]
            late = hit if keep_last is None else hit & (place >= (n - keep_last)[w.doc])
            columns = [batch.column("document"), n.astype(np.int32), _per_list(hit, w.cuts), _per_list(late, w.cuts)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names).filter(pa.array(n > 0))

    return docs.select("document", "_ms", "_ids", "_hits").mapInArrow(run, schema)


def word_rows(matches: Column, hits: Column | None = None, fields: Sequence[str] = tuple(WORD_FIELDS),
              piece_fields: Sequence[str] = (), piece_len: int = 4) -> Column:
    """The words of a document in order as an array of structs of ``fields`` (``WORD_FIELDS``), and with ``piece_fields``
    (``PIECE_FIELDS``) the ``pieces`` of each.

    ``matches``: its tokeniser matches; ``hits``: its phone hits as arrays of words (:func:`phone_codes`), or none. A piece stands with its word as :func:`~tessera.operators.pieces.cut_pieces` cuts it.
    """
    names, piece_names = tuple(fields), tuple(piece_fields)
    kind = ",".join(f"{n}:{WORD_FIELDS[n]}" for n in names)
    if piece_names:
        kind += ",pieces:array<struct<" + ",".join(f"{n}:{PIECE_FIELDS[n]}" for n in piece_names) + ">>"

    def listed(ms: pa.ListArray, found: pa.ListArray | None) -> pa.ListArray:
        w = Words(ms)
        code = np.zeros(w.n, np.int32) if found is None else phone_codes(w, found).astype(np.int32)
        values = {"match": w.flat, "space": w.space, "blank": w.blank, "prev_space": w.prev_space,
                  "char_start": w.start.astype(np.int32), "char_end": w.end.astype(np.int32), "code": code}
        out = {n: values[n] for n in names}
        if piece_names:
            out["pieces"] = pieces_in_row(w, code, piece_len, piece_names)
        return _listed(w.cuts, out)

    if hits is None:
        @F.arrow_udf(f"array<struct<{kind}>>")
        def words(ms: pa.Array) -> pa.Array:
            return listed(ms, None)

        return words(matches)

    @F.arrow_udf(f"array<struct<{kind}>>")
    def marked(ms: pa.Array, found: pa.Array) -> pa.Array:
        return listed(ms, found)

    return marked(matches, hits)


def aligned_words(w: Words, of: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first word of the document that isn't blank and ends beyond ``start``, by position in the batch; else -1."""
    solid = np.flatnonzero(~w.blank)
    found = np.searchsorted((w.base + w.end)[solid], w.base[of] + start, side="right")
    hit = solid[np.minimum(found, len(solid) - 1)] if len(solid) else np.zeros(len(of), np.int64)
    return np.where((found < len(solid)) & (w.doc[hit] == w.doc[of]), hit, -1) if len(of) else hit


def label_words(w: Words, of: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The word whose label a piece takes, by position in the batch: that of the character it starts on, or of the next
    one if it starts on white space; -1 (``O``) if that is a separator."""
    if not len(of):
        return of
    hit = np.searchsorted(w.base + w.start, w.base[of] + start, side="right") - 1
    inside = start < w.end[hit]
    following = np.minimum(hit + 1, w.n - 1)
    following = np.where((hit + 1 < w.n) & (w.doc[following] == w.doc[hit]), following, -1)
    own = inside & (~w.blank[hit] | (start + 1 < w.end[hit]))
    return np.where(own, hit, np.where(inside & w.space[hit], -1, following))
