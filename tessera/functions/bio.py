"""BIO label helpers and metric arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BETA, LABELS, O_LABEL

# Entity types in sorted order, and per label id: its type index (-1 for O) and B- flag.
ENTITY_TYPES = tuple(sorted({x[2:] for x in LABELS if x != O_LABEL}))
TYPE_OF_LABEL_ID = tuple(ENTITY_TYPES.index(x[2:]) if x != O_LABEL else -1 for x in LABELS)
IS_BEGIN_LABEL_ID = tuple(x.startswith("B-") for x in LABELS)


def bio_prefix(label: Column) -> Column:
    """'B', 'I' or 'O'."""
    return F.substring(label, 1, 1)


def bio_type(label: Column) -> Column:
    """Entity type: the label without its two-character prefix ('' for 'O')."""
    return F.substring(label, 3, 1 << 20)


def label_name(label_id: Column) -> Column:
    """Label id -> name through a literal array (no join)."""
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), label_id + 1)


def label_id(label: Column) -> Column:
    """Label name -> id; null for an unknown label."""
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), label).cast("int") - 1


def f_beta(precision: Column, recall: Column, beta: float = BETA) -> Column:
    """(1+b^2)PR / (b^2 P + R); null when both are zero or either is null."""
    b2 = float(beta) * float(beta)
    den = b2 * precision + recall
    return F.when(den > 0, (1.0 + b2) * precision * recall / den)


def type_id_of(label_id_col: Column) -> Column:
    """Entity-type index of a label id (B-X and I-X share it)."""
    return F.element_at(F.array(*[F.lit(t) for t in TYPE_OF_LABEL_ID]), label_id_col + 1)


def is_begin_id(label_id_col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in IS_BEGIN_LABEL_ID]), label_id_col + 1)
