"""Small column functions for names, lists and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Prefixes of exported term columns, stripped in this order.
TERM_PREFIXES = ("Neurosynth_TFIDF__", "Neurosynth__", "TFIDF__")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def term_name(c: Column) -> Column:
    """Drops the known prefixes, then what is left up to the first double underscore, and turns underscores into blanks."""
    bare = F.regexp_replace(c, "^" + "".join(f"(?:{p})?" for p in TERM_PREFIXES), "")
    return F.trim(F.replace(F.regexp_replace(bare, r"(?s)^.*?__", ""), F.lit("_"), F.lit(" ")))


def network_of_label(c: Column, names: dict[str, str]) -> Column:
    """Network by the third underscore-separated token of a parcel name, Unassigned if unknown."""
    table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(F.get(F.split(c, "_"), F.lit(2)), F.lit(""))), F.lit("Unassigned"))


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")


def threshold_list(c: Column) -> Column:
    """Sorted distinct numbers; raises where there is none, or one that isn't strictly between 0 and 1."""
    numbers = F.transform(csv_list(c), lambda s: s.try_cast("double"))
    good = (F.size(numbers) > 0) & F.forall(numbers, lambda v: F.coalesce((v > 0) & (v < 1), F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(numbers))).otherwise(F.raise_error(F.concat(F.lit("thresholds must be numbers between 0 and 1: "), c)))


def dims_of(c: Column) -> Column:
    """The three numbers of a text like 48x64x80, null if it has another form."""
    return F.when(c.rlike(r"^\d+x\d+x\d+$"), F.transform(F.split(c, "x"), lambda s: s.cast("int")))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 8)


def expand_subjects(tokens, subject_column: str = "subject"):
    """Distinct subjects of comma-separated tokens (column tokens, ord) in first-seen order."""
    parts = tokens.select("ord", F.posexplode(csv_list(F.col("tokens"))).alias("pos", subject_column))
    return parts.groupBy(subject_column).agg(F.min(F.struct("ord", "pos")).alias("seen")).orderBy("seen").select(subject_column)


def flat_affine(affine: Column) -> Column:
    """The 16 numbers of a 4 x 4 matrix, row by row."""
    return F.flatten(affine)


def ordered_entries(m: Column) -> Column:
    """The entries of a map in the order of its keys."""
    return F.sort_array(F.map_entries(m))
