"""Scalar rules of the rating model, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Franchise codes that moved, in the games source.
GAME_TEAM_CODES = {"STL": "LA", "SD": "LAC", "OAK": "LV"}

# Franchise codes that differ in the ratings source.
RATING_TEAM_CODES = {"LAR": "LA", "OAK": "LV", "WSH": "WAS"}

# Long-run rating mean, and share of the distance to it lost between seasons.
RATING_MEAN = 1505.0
RATING_PULL = 1.0 / 3.0

# Scheduled games per team, and the last season of the shorter schedule.
SHORT_SEASON_GAMES, LONG_SEASON_GAMES, LAST_SHORT_SEASON = 16, 17, 2020


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_values(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace known codes, keep every other value (and NULL)."""
    c = col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return c if out is None else out.otherwise(c)


def side_margin(result: Column | str, side: Column | str) -> Column:
    """Home-minus-away result seen from one side; NULL when unplayed."""
    result, side = col(result), col(side)
    return F.when(side == "home", result).when(side == "away", -result)


def outcome_win(result: Column | str, side: Column | str, unplayed_win: float = 0.5) -> Column:
    """1 for a win, 0 for a loss, 0.5 for a tie; ``unplayed_win`` when there is no result."""
    result = col(result)
    share = (F.signum(side_margin(result, side).cast("double")) + 1.0) / 2.0
    return F.when(result.isNull(), F.lit(float(unplayed_win))).otherwise(F.coalesce(share, F.lit(0.5)))


def outcome_delta(win: Column | str, result: Column | str, side: Column | str) -> Column:
    """Margin from the side's view. Anything scored as half a win counts 0, so an unplayed
    game gives 0 when it is scored 0.5 and NULL when it is scored 0."""
    return F.when(col(win) == 0.5, F.lit(0.0)).otherwise(side_margin(result, side).cast("double"))


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that gives NULL for a NULL condition (``otherwise`` alone would not)."""
    return F.when(cond, yes).when(~cond, no)


def null_default(c: Column | str, default: Column | float) -> Column:
    return F.coalesce(col(c), default if isinstance(default, Column) else F.lit(default))


def mean_reversion(rating: Column | str, mean: float = RATING_MEAN, pull: float = RATING_PULL) -> Column:
    rating = col(rating)
    return rating - F.lit(pull) * (rating - F.lit(mean))


def scheduled_games(season: Column | str) -> Column:
    """Scheduled games per team: one rule for every place that turns a share into wins."""
    short = col(season) <= LAST_SHORT_SEASON
    return F.when(short, SHORT_SEASON_GAMES).when(~short, LONG_SEASON_GAMES)


def round_away(c: Column | str) -> Column:
    """Round away from zero to whole numbers; 0 and NULL stay."""
    c = col(c)
    return F.signum(c) * F.ceil(F.abs(c))


def round_decimals(c: Column | str, digits: int) -> Column:
    """``round`` of doubles, of which most do without decimal arithmetic (a third of its time or less).

    The part after the point is scaled and rounded as a double. Where the digits that Spark rounds may lie on the
    other side of a half (they are within a unit in the last place), or a result is no whole number of places, it is left to ``round``.
    """
    c, unit = col(c), 10.0**digits
    size = F.abs(c)
    whole = F.floor(size).cast("double")
    scaled = (size - whole) * F.lit(unit)
    below = F.floor(scaled).cast("double")
    sure = (size < F.lit(2.0**53 / unit - 1.0)) & (F.abs(scaled - below - 0.5) > size * F.lit(unit * 2.0**-51) + F.lit(1e-6))
    near = (whole * F.lit(unit) + F.when(scaled - below > 0.5, below + 1.0).otherwise(below)) / F.lit(unit)
    return F.when(sure, F.signum(c) * near).otherwise(F.round(c, digits))


def beta_alpha(p: Column | str, se: Column | str) -> Column:
    p, se = col(p), col(se)
    return F.try_divide(p * p * (F.lit(1.0) - p), se * se) - p


def beta_beta(alpha: Column | str, p: Column | str) -> Column:
    return col(alpha) * (F.try_divide(F.lit(1.0), col(p)) - F.lit(1.0))


def clip_probability(p: Column | str, eps: float = 1e-6) -> Column:
    p = col(p)
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))


def beta_struct(alpha: Column | str, beta: Column | str) -> Column:
    """A Beta distribution as one value."""
    return F.struct(col(alpha).alias("alpha"), col(beta).alias("beta"))


def beta_mean(dist: Column | str) -> Column:
    d = col(dist)
    a, b = d.getField("alpha"), d.getField("beta")
    return F.try_divide(a, a + b)


def beta_sd(dist: Column | str) -> Column:
    d = col(dist)
    a, b = d.getField("alpha"), d.getField("beta")
    total = a + b
    return F.sqrt(F.try_divide(a * b, total * total * (total + 1.0)))


def compose_key(*parts: Column | str) -> Column:
    """Concatenation that is NULL when any part is; plain strings are column names."""
    return F.concat(*[col(p).cast("string") for p in parts])


def template(text: str, keep_null: bool = False, **values: Column | str) -> Column:
    """Fill ``{name}`` places in a text with columns; a missing value prints as NA, or makes the
    whole text NULL with ``keep_null``."""
    pieces: list[Column] = []
    rest = text
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            pieces.append(F.lit(head))
        value = col(values.get(name, name)).cast("string")
        pieces.append(value if keep_null else F.coalesce(value, F.lit("NA")))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces) if pieces else F.lit("")


def strip_first(c: Column | str, pattern: str) -> Column:
    """Remove the first match of a pattern only."""
    return F.regexp_replace(col(c), f"^(.*?)(?:{pattern})", "$1")


def number_text(c: Column | str, digits: int = 1) -> Column:
    """Rounded text, ties to even, without a thousands mark."""
    return F.regexp_replace(F.format_number(col(c), digits), ",", "")


def percent_text(c: Column | str, digits: int = 1) -> Column:
    return F.concat(number_text(col(c) * 100, digits), F.lit("%"))


def unit_hash(*parts: Column | str, seed: int = 0, word: int = 0) -> Column:
    """A 32-bit whole number from the md5 of (seed, parts): the same on any cluster layout.

    ``word`` picks one of the four 32-bit words of the digest.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1 + 8 * word, 8), 16, 10).cast("long")
