"""Column functions of event-data warehousing: ids, clocks, classifications, rates, predicates, priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- ids and dates -----------------------------------------------------------------------------------------------


def game_key(c: Column) -> Column:
    """Canonical game id: text without leading zeros."""
    return F.regexp_replace(c.cast("string"), "^0+", "")


def padded_game_key(c: Column, width: int = 10) -> Column:
    return F.lpad(game_key(c), width, "0")


def season_label(date: Column, rollover_month: int = 10) -> Column:
    """'2023-24' style label; the season starts in rollover_month."""
    start = F.year(date) - F.when(F.month(date) >= rollover_month, 0).otherwise(1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad((F.pmod(start + 1, F.lit(100))).cast("string"), 2, "0"))


def season_of_game_id(game_id: Column, pivot: int = 90) -> Column:
    """Season start year from digits 4-5 of a ten-digit id."""
    two = F.substring(padded_game_key(game_id), 4, 2).try_cast("int")
    return F.when(two >= pivot, two + 1900).otherwise(two + 2000)


def season_type_of_game_id(game_id: Column) -> Column:
    kind = F.substring(padded_game_key(game_id), 3, 1)
    return F.when(kind == "1", "Preseason").when(kind == "2", "Regular Season").when(kind == "4", "Playoffs")


def age_at(birth: Column, on: Column) -> Column:
    before = (F.month(on) < F.month(birth)) | ((F.month(on) == F.month(birth)) & (F.dayofmonth(on) < F.dayofmonth(birth)))
    return F.year(on) - F.year(birth) - F.when(before, 1).otherwise(0)


def career_year(season_start: Column, from_year: Column) -> Column:
    return F.when(season_start >= from_year, season_start - from_year + 1)


# --- clocks ------------------------------------------------------------------------------------------------------


def clock_seconds(clock: Column) -> Column:
    """Remaining seconds of 'PTmmMss.ssS' or 'mm:ss'; null on other text."""
    iso = r"^PT(\d+)M(\d+(?:\.\d+)?)S$"
    plain = r"^(\d+):(\d+(?:\.\d+)?)$"
    read = lambda p: F.regexp_extract(clock, p, 1).try_cast("double") * 60 + F.regexp_extract(clock, p, 2).try_cast("double")
    return F.when(clock.rlike(iso), read(iso)).when(clock.rlike(plain), read(plain))


def period_seconds(period: Column) -> Column:
    return F.when(period <= 4, 720).otherwise(300)


def elapsed_seconds(period: Column, remaining: Column) -> Column:
    """Game seconds: four periods of twelve minutes, then five-minute ones."""
    before = F.when(period <= 4, (period - 1) * 720).otherwise(2880 + (period - 5) * 300)
    return before + period_seconds(period) - remaining


def period_at(elapsed: Column, at_end: bool = False) -> Column:
    """Period of an elapsed time; a boundary belongs to the earlier period with at_end."""
    x = elapsed.cast("double")
    step = lambda v, size: F.greatest(F.ceil(v / size) - 1, F.lit(0)) if at_end else F.floor(v / size)
    regular = (x <= 2880) if at_end else (x < 2880)
    return F.when(regular, step(x, 720) + 1).otherwise(step(x - 2880, 300) + 5).cast("int")


def iso_duration(mmss: Column) -> Column:
    parts = F.split(mmss, ":")
    return F.format_string("PT%02dM%05.2fS", F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("double"))


def minutes_value(text: Column) -> Column:
    """Decimal minutes of 'PTmmMss.ssS', 'mm:ss' or a number."""
    return F.coalesce(clock_seconds(text) / 60, text.try_cast("double"))


# --- texts -------------------------------------------------------------------------------------------------------


def score_pair(text: Column) -> tuple[Column, Column]:
    """(away, home) of 'away - home'."""
    parts = F.split(text, r"\s*-\s*")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")


def matchup_sides(text: Column) -> tuple[Column, Column]:
    """(home, away) of 'A @ B' or 'A vs. B'."""
    at, vs = F.split(text, " @ "), F.split(text, r" vs\. ")
    away = text.contains(" @ ")
    home_side = F.when(away, F.get(at, F.lit(1))).when(text.contains(" vs. "), F.get(vs, F.lit(0)))
    away_side = F.when(away, F.get(at, F.lit(0))).when(text.contains(" vs. "), F.get(vs, F.lit(1)))
    return F.trim(home_side), F.trim(away_side)


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_score(name: Column) -> Column:
    """-1 for empty or placeholder names; else length, and 100 more for two words or more."""
    clean = F.trim(name)
    return F.when(clean.isNull() | (clean == "") | clean.rlike(r"^Player \d+$"), -1).otherwise(F.length(clean) + F.when(clean.contains(" "), 100).otherwise(0))


def keyword_class(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first keyword that the lower-cased text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for word, name in rules:
        out = out.when(low.contains(word), name)
    return out.otherwise(default)


# Keywords of jump-shot types in order of precedence.
SHOT_TYPES = [
    ("step back", "stepback"), ("stepback", "stepback"), ("pullup", "pullup"), ("pull-up", "pullup"), ("pull up", "pullup"), ("running", "running"), ("driving", "running"),
    ("fadeaway", "fadeaway"), ("fade away", "fadeaway"), ("turnaround", "turnaround"), ("turn around", "turnaround"),
]


def shot_type(text: Column, default: str = "catch_shoot") -> Column:
    return keyword_class(text, SHOT_TYPES, default)


def shot_area(x: Column, y: Column, area: Column) -> Column:
    corner = ((F.abs(x) >= 220) & (y <= 100)) | F.lower(area).contains("corner")
    return F.when(F.coalesce(corner, F.lit(False)), "corner").otherwise("above_break")


def rim_class(text: Column, distance: Column, x: Column, y: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    near = F.when(distance.isNotNull(), distance <= 5).otherwise(F.sqrt(x * x + y * y) <= 30)
    return F.when(low.contains("dunk"), "dunk").when(low.contains("layup"), "layup").when(F.coalesce(near, F.lit(False)), "other_rim")


def last_of_sequence(text: Column) -> Column:
    p = r"(\d+) of (\d+)"
    return F.coalesce(F.regexp_extract(text, p, 1).try_cast("int") == F.regexp_extract(text, p, 2).try_cast("int"), F.lit(False))


def height_inches(text: Column) -> Column:
    parts = F.split(text, "-")
    return F.get(parts, F.lit(0)).try_cast("int") * 12 + F.get(parts, F.lit(1)).try_cast("int")


def tidy(text: Column) -> Column:
    """Without trailing '*' or '(n)', white space and non-breaking blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\\s ]+", " "), r"\s*\(\d+\)\s*$", ""), r"\*+\s*$", ""))


def number_or(c: Column, default: float | None = 0.0) -> Column:
    out = c.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def id_set(c: Column) -> Column:
    """Order-insensitive id of an array of ids."""
    return F.array_join(F.sort_array(c), "-")


# --- box score rates ---------------------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def true_shooting(pts: Column, fga: Column, fta: Column) -> Column:
    return ratio(pts, 2 * (fga + F.lit(0.44) * fta))


def many_doubles(stats: list[Column], k: int, at: int = 10) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.when(s >= at, 1).otherwise(0), F.lit(0)) for s in stats]) >= k


def rate(value: Column, mode: str, games: Column | None = None, minutes: Column | None = None, possessions: Column | None = None) -> Column:
    """totals, per_game, per_36 or per_100; null where the denominator is not positive."""
    if mode == "totals":
        return value
    by, unit = {"per_game": (games, 1), "per_36": (minutes, 36), "per_100": (possessions, 100)}[mode]
    return F.when(by > 0, value * unit / by)


def combine(left: Column, op: str, right: Column) -> Column:
    return {"/": ratio(left, right), "+": left + right, "-": left - right}[op]


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


# --- predicates --------------------------------------------------------------------------------------------------


def in_range(c: Column, low=None, high=None) -> Column:
    """Inclusive on both ends, either optional; null fails when either bound is set."""
    out = F.lit(True)
    if low is not None:
        out = out & (c >= F.lit(low))
    if high is not None:
        out = out & (c <= F.lit(high))
    return out if low is None and high is None else F.coalesce(out, F.lit(False))


def compares(c: Column, op: str, value) -> Column:
    test = {">=": c >= F.lit(value), "<=": c <= F.lit(value), "=": c == F.lit(value)}[op]
    return F.coalesce(test, F.lit(False))


def name_contains(c: Column, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


# --- priors ------------------------------------------------------------------------------------------------------


def sliding_prior(attempts: Column, mix: Column | float = 1.0) -> tuple[Column, Column]:
    """(mu, kappa): mu runs from .32 to .36 and kappa from 200 to 300 over the first thousand attempts."""
    t = F.least(attempts / 1000.0, F.lit(1.0))
    return (F.lit(0.32) + F.lit(0.04) * t) * mix, F.lit(200.0) + 100.0 * t


def shrunk_rate(makes: Column, attempts: Column, mu: Column, kappa: Column) -> Column:
    return (makes + kappa * mu) / (attempts + kappa)


# --- events ------------------------------------------------------------------------------------------------------

# Names of the numeric event types.
EVENT_NAMES = {1: "Made Shot", 2: "Missed Shot", 3: "Free Throw", 4: "Rebound", 5: "Turnover", 6: "Foul", 8: "Substitution", 9: "Timeout", 10: "Jump Ball", 11: "Ejection", 12: "Period", 13: "Period"}

# Expected three-point rates by area and shot type, and the league's rate they are taken relative to.
LEAGUE_THREE = 0.365
THREE_RATES = {
    "corner": {"catch_shoot": 0.41, "pullup": 0.37, "stepback": 0.36, "running": 0.34, "fadeaway": 0.33, "turnaround": 0.33},
    "above_break": {"catch_shoot": 0.38, "pullup": 0.34, "stepback": 0.33, "running": 0.32, "fadeaway": 0.31, "turnaround": 0.31},
}


def lookup(code: Column, names: dict, default) -> Column:
    """The value of a small fixed table, `default` for other codes and null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def event_name(code: Column) -> Column:
    return lookup(code.cast("int"), EVENT_NAMES, "")


def first_text(*texts: Column) -> Column:
    """The first text, trimmed, that is neither null, blank nor 'nan'; '' if there is none."""
    filled = lambda c: F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.trim(c))
    return F.coalesce(*[filled(c) for c in texts], F.lit(""))


def is_three(text: Column, value: Column | None = None) -> Column:
    """Worth three: the value says so, or the text."""
    said = F.coalesce(F.upper(text).rlike("3-?PT"), F.lit(False))
    return said if value is None else said | F.coalesce(value == 3, F.lit(False))


def is_assisted(text: Column, second_player: Column | None = None) -> Column:
    said = F.coalesce(F.upper(text).contains("AST)") | F.lower(text).contains("assist by"), F.lit(False))
    return said if second_player is None else said | F.coalesce(second_player > 0, F.lit(False))


def event_action(name: Column, text: Column) -> Column:
    """Field goals as '2pt' or '3pt' by their text, free throws and jump balls in one word; other names stay."""
    shot = F.when(F.coalesce(F.lower(text).rlike("3(-| )?pt"), F.lit(False)), "3pt").otherwise("2pt")
    return F.when(name.isin("Made Shot", "Missed Shot"), shot).when(name == "Free Throw", "freethrow").when(name == "Jump Ball", "jumpball").otherwise(name)


def shot_result(result: Column, name: Column) -> Column:
    """A result that is given, else that of the event's name."""
    return F.coalesce(F.when(result != "", result), F.when(name == "Made Shot", "Made").when(name == "Missed Shot", "Missed"))


def is_free_throw(action: Column, sub_type: Column, text: Column) -> Column:
    """By action, sub-type or text, without regard to case, blanks and marks."""
    a, s, t = (F.coalesce(name_key(c), F.lit("")) for c in (action, sub_type, text))
    return (a == "freethrow") | s.startswith("freethrow") | t.contains("freethrow")


def free_throw_points(text: Column) -> Column:
    return F.when(F.lower(F.coalesce(text, F.lit(""))).startswith("miss"), 0).otherwise(1)


def rebound_side(text: Column, team: Column | None = None, shot_team: Column | None = None) -> Column:
    """'offensive' or 'defensive' as the text says, else by whether the team took the last shot, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = F.when(low.contains("offensive"), "offensive").when(low.contains("defensive"), "defensive")
    return said if team is None else F.coalesce(said, F.when(team == shot_team, "offensive").when(team != shot_team, "defensive"))


def period_end(period: Column) -> Column:
    """Game seconds at which a period ends."""
    return F.when(period <= 4, period * 720).otherwise(2880 + (period - 4) * 300)


def clock_at(elapsed: Column, at_end: bool = False) -> Column:
    """Remaining time of the period as 'PTmmMss.ssS'; at_end: a boundary is the end of the earlier period."""
    left = period_end(period_at(elapsed, at_end)) - elapsed.cast("double")
    return F.format_string("PT%02dM%05.2fS", F.floor(left / 60).cast("int"), left - F.floor(left / 60) * 60)


def shot_factor(area: Column, kind: Column, catch_rate: Column | float) -> Column:
    """Difficulty of a three relative to the league: by area and type; for type 'unknown' the season's mix of catch-and-shoot
    and pull-up, for other types 1."""
    flat = {f"{a}/{k}": r / LEAGUE_THREE for a, kinds in THREE_RATES.items() for k, r in kinds.items()}
    at = lambda k: lookup(F.concat(area, F.lit("/"), k), flat, 1.0)
    share = F.lit(catch_rate) if isinstance(catch_rate, float) else catch_rate
    return F.when(kind == "unknown", share * at(F.lit("catch_shoot")) + (1 - share) * at(F.lit("pullup"))).otherwise(at(kind))


def name_aliases(name: Column) -> Column:
    """Keys by which a feed may name a player: the whole name, the last name with and without the first initial, and of
    'Last Jr.' the last name with its suffix; an array without repeats."""
    parts = name_words(name)
    n, last = F.size(parts), F.try_element_at(parts, F.lit(-1))
    suffixed = (n >= 2) & last.isin("jr", "sr", "ii", "iii", "iv")
    joined, initial = F.concat(F.try_element_at(parts, F.lit(-2)), last), F.concat(F.left(F.get(parts, F.lit(0)), F.lit(1)), last)
    all_ = F.array(name_key(F.coalesce(name, F.lit(""))), F.when(suffixed, joined).otherwise(last), F.when(~suffixed, initial))
    return F.array_except(all_, F.array(F.lit(None).cast("string"), F.lit("")))


def approximate_date(game_id: Column) -> Column:
    """A date for a play-off game from its number: rounds follow each other from mid April to June.

    Ids are '49' + last digit of the year from 1990 + number, or '4' + two digits of the year (from 96 on of the last century) + two
    of the kind + number; other ids give null.
    """
    old = game_id.startswith("49")
    short = F.substring(game_id, 2, 2).try_cast("int")
    year = F.when(old, 1990 + F.substring(game_id, 3, 1).try_cast("int")).otherwise(F.when(short >= 96, 1900 + short).otherwise(2000 + short))
    number = F.when(old, F.substring(game_id, 4, 20).try_cast("int")).otherwise(F.when(F.length(game_id) > 5, F.substring(game_id, 6, 20).try_cast("int")).otherwise(1))
    into = lambda low, step: F.floor((number - low) / step)
    month = F.when(number <= 48, 4).when(number <= 84, 5).otherwise(6)
    day = F.when(number <= 48, F.least(15 + into(0, 4), F.lit(30))).when(number <= 72, F.least(1 + into(48, 2), F.lit(31))).when(number <= 84, F.least(20 + into(72, 2), F.lit(31))).otherwise(F.least(1 + into(84, 2), F.lit(30)))
    return F.when(game_id.startswith("4"), F.make_date(year, month, day.cast("int")))


#: Words of event texts that are no names, and suffixes of names.
EVENT_WORDS = (
    "and", "assist", "ball", "block", "def", "defensive", "drawn", "dunk", "fadeaway", "foul", "free", "ft", "hook", "jump", "layup", "loose", "made", "makes", "miss", "missed", "off", "offensive", "of", "pass", "personal", "pts",
    "pullup", "rebound", "running", "shot", "steal", "step", "sub", "throw", "tip", "to", "turnaround", "turnover", "vs", "for",
)
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def name_words(name: Column) -> Column:
    """The words of a name as keys, points taken as spaces."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("."), F.lit(" "))), "[^a-z0-9 ]", ""), " "), "")


def text_name_keys(text: Column) -> Column:
    """Keys of the name that an event text begins with ('MISS Ja. Green 3PT': green, ja, jagreen, jgreen); an array."""
    from .names import text_name_keys as keys  # that module uses the words above

    return keys(text)
