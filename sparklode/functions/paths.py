"""Column expressions on file paths and sizes (all JVM-side)."""

from pyspark.sql import Column, functions as F

from sparklode import model as M

_SUFFIX = r"^(?:.*/)?\.*[^/.][^/]*?(\.[^./]+)$"


def file_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path) -> Column:
    """Last dotted suffix of the file name, '' when there is none."""
    return F.regexp_extract(path, _SUFFIX, 1)


def file_stem(path) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def _dirs(rel) -> Column:
    parts = F.split(rel, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def in_ignored_dir(rel) -> Column:
    return F.exists(
        _dirs(rel), lambda d: d.isin(M.IGNORED_DIRS) | d.startswith("."))


def is_test_code(rel) -> Column:
    stem = file_stem(rel)
    return (F.exists(_dirs(rel), lambda d: F.lower(d).isin(M.TEST_DIRS))
            | stem.startswith("test_") | stem.endswith("_test"))


def has_source_extension(rel) -> Column:
    return suffix(rel).isin(M.SOURCE_EXTENSIONS)


def within_size(length) -> Column:
    return F.col(length) <= M.MAX_FILE_BYTES if isinstance(length, str) \
        else length <= M.MAX_FILE_BYTES


def indexable(rel, length, exclude_tests: bool = True) -> Column:
    """All corpus filters in one predicate."""
    keep = within_size(length) & has_source_extension(rel) & ~in_ignored_dir(rel)
    return keep & ~is_test_code(rel) if exclude_tests else keep


def under_prefix(rel, prefix: str | None) -> Column:
    """Case-insensitive path-prefix scope; a plain string prefix."""
    if not prefix:
        return F.lit(True)
    return F.lower(rel).startswith(prefix.lower().rstrip("/"))


def relative_path(path, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.col(path).startswith(base),
                  F.substring(path, len(base) + 1, 2 ** 31 - 1)
                  ).otherwise(F.col(path))


def display_path(rel, path) -> Column:
    """Trimmed relative path, else the last two components of the full path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    tail = F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, -2, 2))
                  ).otherwise(F.col(path) if isinstance(path, str) else path)
    return F.coalesce(F.nullif(F.trim(rel), F.lit("")), tail)


def language(path) -> Column:
    ext = F.lower(suffix(path))
    out = F.lit(None).cast("string")
    for e, lang in M.LANGUAGE_BY_EXTENSION.items():
        out = F.when(ext == e, F.lit(lang)).otherwise(out)
    return out


def chunk_key(path, start_line) -> Column:
    return F.concat_ws(":", path, F.col(start_line).cast("string"))
