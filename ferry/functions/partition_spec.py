"""Partition specs: the ``k1=v1/k2=v2`` strings of ``SHOW PARTITIONS`` and of
partition directory names.

Plain Spark SQL expressions, so millions of partition names are parsed by
executors, never on the driver:

* :func:`file_partition_spec` takes a spec out of a data file's URI;
* :func:`partition_spec_values` explodes a spec column into one row per
  ``(pos, key, value)``, unescaped, with the default partition read as NULL;
* :func:`spec_keys` gives only the ordered key list, for detection.

No higher-order function appears in the unescape and explode paths:
they are chains of ``replace``/``regexp`` calls and ``url_decode``, so the
projection stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Partition path conventions of Spark's file catalogs.
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape_path_value(raw: Column | str) -> Column:
    """A value from its escaped form in a path: ``%XX`` -> character, a ``%``
    that starts no code kept as is, the default partition name -> NULL.

    ``url_decode`` does the decoding; beforehand ``+`` is protected (the
    decoder would read it as a space) and a lone ``%`` is written as
    ``%25`` (the decoder would reject it).
    """
    r = _col(raw)
    protected = F.regexp_replace(F.replace(r, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return (
        F.when(r == DEFAULT_PARTITION, F.lit(None).cast("string"))
        .when(F.instr(r, "%") == 0, r)
        .otherwise(F.url_decode(protected))
    )


_SEGMENT = "(?:^|/)([^/]*=[^/]*)"


def _segments(spec: Column) -> Column:
    return F.regexp_extract_all(spec, F.lit(_SEGMENT), 1)


def spec_keys(spec: Column | str) -> Column:
    """Ordered array of the (unescaped) keys of a spec."""
    return F.transform(
        _segments(_col(spec)), lambda s: unescape_path_value(F.trim(F.substring_index(s, "=", 1)))
    )


def partition_spec_values(
    df: DataFrame,
    spec_col: str = "partition",
    *,
    pos_col: str = "pos",
    key_col: str = "key",
    value_col: str = "value",
    keep_spec: bool = False,
) -> DataFrame:
    """One row per (spec, segment): the other columns of ``df`` plus the
    1-based position, key and unescaped value.  Runs as a narrow,
    code-generated transformation: no shuffle, any number of specs."""
    seg = F.col("__seg")
    others = [f"`{c}`" for c in df.columns if keep_spec or c != spec_col]
    exploded = df.select(*others, F.posexplode(_segments(F.col(f"`{spec_col}`"))).alias("__pos", "__seg"))
    return exploded.select(
        *others,
        (F.col("__pos") + 1).alias(pos_col),
        unescape_path_value(F.trim(F.substring_index(seg, "=", 1))).alias(key_col),
        unescape_path_value(F.substr(seg, F.instr(seg, "=") + 1)).alias(value_col),
    )


def file_partition_spec(path: Column | str) -> Column:
    """The partition spec in a data file's URI (``_metadata.file_path``).

    A URI encodes the folder names once more, so it is decoded once; a plus
    sign stands for itself in it.  Blank for an unpartitioned file.
    """
    folders = F.regexp_extract_all(_col(path), F.lit("/([^/=]+=[^/]*)(?=/)"), 1)
    return F.url_decode(F.replace(F.array_join(folders, "/"), F.lit("+"), F.lit("%2B")))
