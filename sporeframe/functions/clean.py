"""Column expressions for cleaning and name parsing.

All are built-in Spark expressions: they stay inside whole-stage codegen and
work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# pandas.to_numeric accepts decimal / exponent notation (inf / nan too, but
# those become NULL below anyway); Spark's cast also accepts Java suffixes
# such as '1d' and '2f', which pandas rejects.  Group 1 is the number.
_NUMERIC_TEXT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def clean_numeric(x: ColumnOrName) -> Column:
    """NaN and +/-Inf become NULL (P8).  Spark treats ``NaN > 0`` as true and
    orders NaN last in ``median``, so this runs before any filter or aggregate.
    (``abs(NaN) < inf`` is false in Spark, so one comparison covers both.)"""
    v = _c(x).cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def lenient_double(x: ColumnOrName) -> Column:
    """Text to double like ``pd.to_numeric(errors='coerce')`` (P4): junk, empty
    text and NULL give NULL, never an error under ANSI mode.  The input is
    referenced once, so pushed-down filters do not copy a parsing chain."""
    number = F.regexp_extract(_c(x).cast("string"), _NUMERIC_TEXT, 1)
    return clean_numeric(number.try_cast("double"))


def species_from_filename(path: ColumnOrName, lower: bool = True, check: bool = True) -> Column:
    """Base name, first two ``_`` parts joined (F1; ``lower=False, check=False`` is F2).

    With ``check`` a name of fewer than two parts raises, as the reference does.
    """
    base = F.element_at(F.split(_c(path), "/"), -1)
    parts = F.split(base, "_")
    name = F.array_join(F.slice(parts, 1, 2), "_")
    if lower:
        name = F.lower(name)
    if check:
        name = F.when(F.size(parts) >= 2, name).otherwise(
            F.raise_error(F.concat(F.lit("cannot read a species from the file name "), base))
        )
    return name


def species_from_result_file(path: ColumnOrName, check: bool = True) -> Column:
    """Strip ``.csv``, keep the LAST two ``_`` parts, lower case (F3);
    more than four parts is an error."""
    base = F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.csv", "")
    parts = F.split(base, "_")
    name = F.lower(F.array_join(F.slice(parts, -2, 2), "_"))
    if check:
        name = F.when(F.size(parts) <= 4, name).otherwise(
            F.raise_error(F.concat(F.lit("cannot read a species from the file name "), base))
        )
    return name


def genus(name: ColumnOrName, separators: str = " ") -> Column:
    """First word of a species name (F4).  ``separators="[ _]"`` also splits on
    the underscores of file-derived names (quirk Q7)."""
    if separators == " ":
        return F.split_part(_c(name), F.lit(" "), F.lit(1))
    return F.split(_c(name), separators).getItem(0)


def strip_pattern(x: ColumnOrName, pattern: str) -> Column:
    """Remove an anchored regex prefix / suffix (F5), e.g. ``'^gene-SPOM_'``."""
    return F.regexp_replace(_c(x), pattern, "")


# The literal pieces removed from an MPRA block name, in the
# order they are removed (order matters: '_one_ins' before '_one').
BLOCK_NAME_PIECES = (
    "native_", "pad_", "Lib_pre_", "term_full_", "term_null_", "term_ins_", "lib_suff_nag_",
    "ib_suff_osz_", "stop_codon_", "canon_term_neg_", "canon_term_pos_", "_no_ins", "_three_ins",
    "_four_ins", "_two_ins", "_one_ins", "_one", "_synth_insert_pad", "_synth_t", "_512_mut", "_wt",
)


def remove_pieces(x: ColumnOrName, pieces: Sequence[str] = BLOCK_NAME_PIECES, drop_leading: str | None = "l") -> Column:
    """Apply literal removals in order, then drop one leading ``drop_leading``."""
    out = _c(x)
    for piece in pieces:
        out = F.replace(out, F.lit(piece), F.lit(""))
    if drop_leading:
        out = F.when(out.startswith(drop_leading), F.substring(out, len(drop_leading) + 1, 1 << 30)).otherwise(out)
    return out


def block_from_description(desc: ColumnOrName) -> Column:
    """MPRA group label: second ``#`` part, text after the last ``context_``,
    cleaned by ``remove_pieces`` (F7 + F6)."""
    second = F.split_part(_c(desc), F.lit("#"), F.lit(2))
    after = F.element_at(F.split(second, "context_"), -1)
    return remove_pieces(after)


def five_part_name(folder: ColumnOrName) -> Column:
    """Struct ``(model_type, dataset)`` of a ``a-b-model-dataset-e`` folder
    name, NULL when the name does not have exactly five parts (F8)."""
    parts = F.split(_c(folder), "-")
    return F.when(
        F.size(parts) == 5,
        F.struct(parts.getItem(2).alias("model_type"), parts.getItem(3).alias("dataset")),
    )


def model_label(path: ColumnOrName) -> Column:
    """Model label from an output folder name (F9, the definition that wins):
    third ``-`` part minus its first ``_`` word; cut to two words when it
    holds digits; 'Agnostic' when it says so, else 'Aware:<token>'."""
    third = F.split_part(_c(path), F.lit("-"), F.lit(3))
    token = F.array_join(F.slice(F.split(third, "_"), 2, 1 << 20), " ")
    token = F.when(token.rlike(r"\d+"), F.array_join(F.slice(F.split(token, " "), 1, 2), " ")).otherwise(token)
    label = F.when(token.contains("agnostic"), F.lit("Agnostic, ")).otherwise(F.concat(F.lit("Aware:"), token, F.lit(", ")))
    return F.regexp_replace(label, "[, ]+$", "")


def trim_id(x: ColumnOrName) -> Column:
    """``astype(str).str.strip()``."""
    return F.trim(_c(x).cast("string"))


def path_safe(x: ColumnOrName) -> Column:
    """Spaces to underscores."""
    return F.translate(_c(x), " ", "_")


def int_without_nbsp(x: ColumnOrName) -> Column:
    """Remove non-breaking spaces, then integer (F12); junk gives NULL."""
    return F.replace(_c(x), F.lit("\u00a0"), F.lit("")).try_cast("int")
