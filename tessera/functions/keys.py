"""Column expressions for references, keys, ids and the coverage predicates between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ref_key(kind: Column, id: Column) -> Column:
    """An artifact and a prefix may have one id and stay apart."""
    return F.concat_ws(" ", kind, id)


def is_prefix(kind: Column) -> Column:
    return kind == "prefix"


def covers(prefix: Column, id: Column) -> Column:
    """Whether the region of ids that start with `prefix` holds the id. For joins use operators.deps, which hashes."""
    return id.startswith(prefix)


def overlaps(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def row_key(*values: Column) -> Column:
    """JSON list of the values in order, NULLs included."""
    return F.to_json(F.array(*(v.cast("string") for v in values)), {"ignoreNullFields": "false"})


def task_id(name: str, values: list[Column]) -> Column:
    """`name`, or `name:` and the values that aren't NULL, joined with '/'."""
    if not values:
        return F.lit(name)
    some = F.coalesce(*(F.when(v.isNotNull(), F.lit(True)) for v in values), F.lit(False))
    return F.when(some, F.concat(F.lit(f"{name}:"), F.concat_ws("/", *(v.cast("string") for v in values)))).otherwise(F.lit(name))


def set_label(number: int, names: list[str]) -> Column:
    """Text that names one joined set in messages."""
    return F.concat_ws(" ", F.lit(f"rule {number}"), *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names))


def file_stamp(content: Column) -> Column:
    """Stamp of a file's bytes."""
    return F.sha2(content, 256)


def time_stamp(mtime_ns: Column, size: Column) -> Column:
    """Stamp without reading bytes."""
    return F.concat_ws(":", mtime_ns.cast("string"), size.cast("string"))


def digest(lines: Column) -> Column:
    """Aggregate: digest of the lines in order of their text. No lines have a digest, too."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(lines))), 256)


def set_digest(lines: Column) -> Column:
    """Aggregate: digest of the lines as a bag, whatever their order and number. Four 60-bit words of each line's hash are added
    up, so a group never meets in one task or row: partial sums are combined before the shuffle. Stands for digest() where groups
    are too large for one row; its value is another one. NULL lines don't count."""
    hash = F.sha2(lines, 256)
    words = [F.coalesce(F.sum(F.conv(F.substring(hash, 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")).cast("string"), F.lit("0")) for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(lines).cast("string"), *words), 256)


def json_key_stamps(document: Column) -> Column:
    """Map from each key of a JSON object to the hash of its value's text."""
    return F.transform_values(F.from_json(document, "map<string,string>"), lambda _, v: F.sha2(v, 256))
