"""Rounding, classification, badges, colours and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour and label per risk class.
RISK_COLORS = {
    "critical": "#ef4444", "high": "#f97316", "warning": "#eab308",
    "normal": "#3b82f6", "entry": "#22c55e", "system": "#6b7280",
}
RISK_LABELS = {
    "critical": "Critical / God file", "high": "High influence",
    "warning": "High dependency", "normal": "Normal",
    "entry": "Entry point / leaf", "system": "System / external",
}
RISK_ORDER = ["critical", "high", "warning", "normal", "entry", "system"]


def round_half_even(x: Column, digits: int) -> Column:
    """Round a non-negative double to ``digits`` places as Python's ``round`` does.

    Python decides ties on the exact binary value, not on its shortest decimal text. The
    distance to the tie is exact here: ``x`` is split into a 24-bit head and the rest, and
    both products with the small integer ``2 * 10**digits`` fit a double.
    """
    scale = 10 ** digits
    x = x.cast("double")
    low = F.floor(x * scale).cast("double")
    head = x.cast("float").cast("double")
    gap = (head * (2.0 * scale) - (2.0 * low + 1.0)) + (x - head) * (2.0 * scale)
    up = (gap > 0) | ((gap == 0) & (low % 2 == 1))
    return F.when(up, low + 1.0).otherwise(low) / F.lit(float(scale))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n``, the rounding of browser-side percentages."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5).cast("double") / F.lit(scale)


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def risk_color(risk: Column) -> Column:
    return F.element_at(literal_map(RISK_COLORS), risk)


def risk_label(risk: Column) -> Column:
    return F.element_at(literal_map(RISK_LABELS), risk)


def risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), risk).cast("int")


def risk_class(id_: Column, in_degree: Column, out_degree: Column, in_cycle: Column,
               reach_pct: Column, total: Column) -> Column:
    """Risk class with thresholds that grow with the number of nodes."""
    def pick(small: int, medium: int, floor_: int, share: int) -> Column:
        return (F.when(total <= 10, F.lit(small)).when(total <= 50, F.lit(medium))
                .otherwise(F.greatest(F.lit(floor_).cast("bigint"), F.floor(total / share))))

    return (F.when(id_.startswith("system:") | id_.startswith("<"), F.lit("system"))
            .when(in_cycle | (in_degree >= pick(5, 8, 10, 5)) | (reach_pct >= 50), F.lit("critical"))
            .when((in_degree >= pick(3, 5, 5, 10)) | (reach_pct >= 30), F.lit("high"))
            .when(out_degree >= pick(4, 6, 8, 8), F.lit("warning"))
            .when(in_degree == 0, F.lit("entry"))
            .otherwise(F.lit("normal")))


def instability(in_degree: Column, out_degree: Column) -> Column:
    touched = in_degree + out_degree
    return (F.when(touched > 0, round_half_even(out_degree / touched, 3))
            .otherwise(F.lit(0.5)))


def node_size(in_degree: Column) -> Column:
    return (F.lit(80) + in_degree * 40).cast("bigint")


def edge_weight(in_degree: Column, max_in: Column, reach_pct: Column) -> Column:
    raw = in_degree / F.greatest(max_in, F.lit(1)) * 0.6 + reach_pct / 100 * 0.4
    return round_half_even(1 + 4 * F.least(raw, F.lit(1.0)), 2)


def churn_color(score: Column) -> Column:
    """Blue, yellow, red ramp over a score in [0, 1]."""
    blue, yellow, red = (0x3B, 0x82, 0xF6), (0xEA, 0xB3, 0x08), (0xEF, 0x44, 0x44)

    def channel(i: int) -> Column:
        rising = blue[i] + (yellow[i] - blue[i]) * (score / 0.5)
        falling = yellow[i] + (red[i] - yellow[i]) * ((score - 0.5) / 0.5)
        level = round_half_up(F.when(score <= 0.5, rising).otherwise(falling)).cast("bigint")
        return F.lpad(F.lower(F.hex(level)), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def search_score(id_: Column, needle: str) -> Column:
    """Quick-jump rank of a hit: file name, file-name prefix, path prefix, anywhere."""
    q = needle.lower()
    name = F.lower(F.substring_index(id_, "/", -1))
    return (F.when(name == q, F.lit(3)).when(name.startswith(q), F.lit(2))
            .when(F.lower(id_).startswith(q), F.lit(1)).otherwise(F.lit(0)))


def level_badge(value: Column, low: float, high: float) -> Column:
    """green / yellow / red for values up to ``low``, up to ``high``, above."""
    return (F.when(value > high, F.lit("red")).when(value > low, F.lit("yellow"))
            .otherwise(F.lit("green")))


def stability_badge(value: Column) -> Column:
    return (F.when(value > 0.7, F.lit("red")).when(value < 0.3, F.lit("green"))
            .otherwise(F.lit("yellow")))


def repository_url(url: Column) -> Column:
    """Canonical clone address of ``owner/repo`` or of a URL on a known host, else null."""
    u = F.trim(url)
    known = r"^(?i)https?://(github\.com|gitlab\.com|bitbucket\.org)/([\w./-]+?)(?:\.git)?/?$"
    return (F.when(u.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), u, F.lit(".git")))
            .when(u.rlike(known), F.concat(F.lit("https://"), F.lower(F.regexp_extract(u, known, 1)),
                                           F.lit("/"), F.regexp_extract(u, known, 2), F.lit(".git"))))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def rank_name(rank: Column, layers: list[str] | None) -> Column:
    """Display name of a layer rank: its name, ``other`` past the last, ``L<n>`` without names."""
    if not layers:
        return F.concat(F.lit("L"), rank.cast("string"))
    names = F.array(*[F.lit(x.lower()) for x in layers])
    return F.when(rank < len(layers), F.try_element_at(names, (rank + 1).cast("int"))).otherwise(F.lit("other"))


def pattern_predicate(id_: Column, pattern: str) -> Column:
    """``/re/flags`` or text with metacharacters is a regex, other text a substring.

    Case is ignored unless explicit flags leave out ``i``.
    """
    body, flags = pattern, "i"
    if len(pattern) > 1 and pattern.startswith("/") and pattern.rfind("/") > 0:
        cut = pattern.rfind("/")
        tail = pattern[cut + 1:]
        if all(ch in "gimsuy" for ch in tail):
            body, flags = pattern[1:cut], tail or "i"
            keep = "".join(f for f in "ims" if f in flags)
            return id_.rlike(f"(?{keep}){body}" if keep else body)
    if any(ch in ".*+?^${}()|[]\\" for ch in body):
        return id_.rlike(f"(?i){body}")
    return F.contains(F.lower(id_), F.lit(body.lower()))
