"""Path functions on ``/``-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 20 directory colours, in their order.
PALETTE = [
    "#6366f1", "#818cf8", "#8b5cf6", "#7c3aed", "#6d28d9",
    "#3b82f6", "#60a5fa", "#0ea5e9", "#06b6d4", "#14b8a6",
    "#0d9488", "#475569", "#64748b", "#7dd3fc", "#a78bfa",
    "#38bdf8", "#2dd4bf", "#a5b4fc", "#94a3b8", "#5eead4",
]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def basename(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dirname(path: str | Column) -> Column:
    """Parent folder, ``''`` for a file at the root."""
    p = _c(path)
    cut = F.length(p) - F.length(basename(p)) - 1
    return F.when(cut > 0, F.substring(p, F.lit(1), cut)).otherwise(F.lit(""))


def directory(path: str | Column) -> Column:
    """Parent folder, ``.`` for a file at the root."""
    d = dirname(path)
    return F.when(d == "", F.lit(".")).otherwise(d)


def extension(path: str | Column) -> Column:
    """Extension with its dot; ``''`` when the only dots lead the file name."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def suffix(path: str | Column) -> Column:
    """Text from the last dot of the file name, also when the name is nothing else."""
    return F.regexp_extract(_c(path), r"(\.[^./]*)$", 1)


def stem(path: str | Column) -> Column:
    """File name without its extension."""
    b = basename(path)
    return F.substring(b, F.lit(1), F.length(b) - F.length(extension(path)))


def join_path(folder: Column, rest: Column) -> Column:
    """``folder/rest``; an absolute ``rest`` replaces the folder."""
    return (F.when((folder == "") | rest.startswith("/"), rest)
            .otherwise(F.concat(folder, F.lit("/"), rest)))


def normalize(path: str | Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments; an empty result is ``.``.

    Paths that hold no such segment skip the fold.
    """
    p = _c(path)
    absolute = p.startswith("/")

    def step(acc: Column, seg: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return (F.when(seg.isin("", "."), acc)
                .when((seg == "..") & (F.size(acc) > 0) & (last != ".."),
                      F.slice(acc, F.lit(1), F.size(acc) - 1))
                .when((seg == "..") & absolute & (F.size(acc) == 0), acc)
                .otherwise(F.concat(acc, F.array(seg))))

    folded = F.array_join(
        F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    full = F.when(absolute, F.concat(F.lit("/"), folded)).otherwise(folded)
    tidy = F.regexp_replace(full, r"\A\z", ".")  # names the fold once, so it is done once
    return F.when(p.rlike(r"(^|/)\.{0,2}(/|$)"), tidy).otherwise(p)


def climb(folder: Column, levels: Column) -> Column:
    """The folder ``levels`` above; ``''`` at or beyond the root."""
    parts = F.split(folder, "/")
    keep = F.size(parts) - levels
    return F.when(keep > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), "/")) \
            .otherwise(F.lit(""))


def ancestors(path: str | Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(_c(path), "/")
    n = F.size(parts) - 1
    return (F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                      lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
            .otherwise(F.array().cast("array<string>")))


def path_suffixes(path: str | Column) -> Column:
    """The path and every tail of it that starts after a ``/``."""
    parts = F.split(_c(path), "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n),
                       lambda i: F.array_join(F.slice(parts, i, n), "/"))


def snake_case(name: Column) -> Column:
    """Lower case, with ``_`` between a lower-case and an upper-case letter."""
    return F.lower(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", "_"))


def dir_color(path: str | Column) -> Column:
    """Palette colour of a path's directory: MD5 of the directory modulo 20.

    A power of 16 is 16 modulo 20, so the 128-bit value reduces from three short pieces.
    """
    h = F.md5(directory(path))

    def piece(start: int, n: int) -> Column:
        return F.conv(F.substring(h, start, n), 16, 10).cast("bigint")

    idx = F.pmod(16 * (piece(1, 8) + piece(9, 12)) + piece(21, 12), F.lit(20))
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (idx + 1).cast("int"))


def layer_of(path: str | Column, layers: list[str]) -> Column:
    """First path segment that names a layer: struct(name, rank), null when none does."""
    ranks = {}
    for i, name in enumerate(layers):
        ranks[name.lower()] = i
    flat = [x for name, i in ranks.items() for x in (F.lit(name), F.lit(i))]
    table = F.create_map(*flat)
    segs = F.split(F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/"))), "/")
    hit = F.try_element_at(F.filter(segs, lambda s: F.array_contains(F.map_keys(table), s)), F.lit(1))
    return F.when(hit.isNotNull(), F.struct(hit.alias("name"), F.element_at(table, hit).alias("rank")))


def mermaid_id(path: str | Column) -> Column:
    return F.translate(_c(path), "/.-", "___")


def word_id(path: str | Column) -> Column:
    """Identifier for the editor export: every character but letters, digits, ``_`` becomes ``_``."""
    return F.regexp_replace(_c(path), r"[^a-zA-Z0-9_]", "_")
