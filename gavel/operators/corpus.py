"""Document-set preparation: near-copy removal, leakage removal, balance, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import is_blank, opening_signature, strip
from gavel.operators.ranks import balance, keep_first, with_position, without
from gavel.session import cut_lineage


def drop_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(~is_blank(F.col(text)))


def dedupe(docs: DataFrame, order: str, text: str = "text", *, label: Column | None = None) -> DataFrame:
    """Keep the first document of every opening signature, text stripped.

    Equal normal forms have equal signatures, so one key covers exact copies
    and near copies alike. With ``label``, "first" means by (label, ``order``):
    classes are taken one after the other and share what was seen.
    """
    kept = keep_first(drop_empty(docs, text), opening_signature(F.col(text)), order, after=label)
    return kept.withColumn(text, strip(F.col(text)))


def signed(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """``order, signature`` of every document that has a text, worked out once."""
    return cut_lineage(drop_empty(docs, text).select(order, opening_signature(F.col(text)).alias("signature")))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct signatures of a document set: the seen-set of another split."""
    return drop_empty(docs, text).select(opening_signature(F.col(text)).alias("signature")).distinct()


def remove_seen(
    docs: DataFrame, seen: DataFrame, order: str, text: str = "text", *, marks: DataFrame | None = None
) -> DataFrame:
    """Documents whose signature is not in ``seen``.

    Signatures are compared beside ids only (``marks``, if ``signed`` was called before);
    the ids found are then taken out, see ``ranks.without``. ``seen`` is distinct, so a
    signature repeated in ``docs`` meets one row, and AQE splits it if it is hot.
    """
    marks = signed(docs, order, text) if marks is None else marks
    found = marks.join(seen.select("signature").distinct(), "signature", "left_semi")
    return without(drop_empty(docs, text), found.select(order), order)


def prepare(docs: DataFrame, label: str, order: str, *, seen: DataFrame | None = None, balanced: bool = True) -> DataFrame:
    """Dedupe per set, drop what another split has, then trim classes to equal size."""
    kept = dedupe(docs if seen is None else remove_seen(docs, seen, order), order, label=F.col(label))
    return balance(kept, label, order) if balanced else kept


def with_record_ids(docs: DataFrame, order: str, tag: str, label: str | None = None) -> DataFrame:
    """``document_id`` = ``llm-<tag>-<six-digit position>``, numbered by (label, order)."""
    after = F.col(label) if label else None
    numbered = with_position(docs, order, after=after)
    return numbered.withColumn(
        "document_id", F.format_string(f"llm-{tag}-%06d", F.col("position"))
    )
