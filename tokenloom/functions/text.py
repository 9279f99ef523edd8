"""Small string helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(x: Column) -> Column:
    """Lower case, runs of other than letters and digits (of any script) to one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


#: Endings of dataset names, each taken off once, in this order; models that go by a family's name.
SUBSAMPLED = ("_test_subsampled", "_train_subsampled", "_val_subsampled")
FAMILIES = ("colqwen2", "colpali")


def _last(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def dataset_name(path: Column) -> Column:
    name = _last(path)
    for ending in SUBSAMPLED:
        name = F.regexp_replace(name, ending + "$", "")
    return slug(name)


def model_name(path: Column) -> Column:
    name = F.lower(_last(path))
    out = slug(name)
    for family in reversed(FAMILIES):
        out = F.when(F.contains(name, F.lit(family)), F.lit(family)).otherwise(out)
    return out


def embedding_file(dataset: Column, model: Column, limit: Column) -> Column:
    return F.concat(F.lit("vidore-"), dataset_name(dataset), F.lit("-"), model_name(model), F.lit("-limit"), limit.cast("string"), F.lit(".npz"))


def scale_key(name: Column, otherwise: Column) -> Column:
    """Digits after the last colon, else after "limit", else a number of documents."""
    some = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return F.coalesce(some(":([0-9]+)$"), some("limit([0-9]+)"), otherwise.cast("string"))
