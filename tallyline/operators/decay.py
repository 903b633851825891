"""Decayed state by window: values before each row, recency weights, posterior tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.beta import beta_quantiles

#: Half-lives in a block of running attempts. Weights run from 2^-500 to 1 in a block, and rows two blocks back weigh less than 2^-500.
_BLOCK = 500.0


def decayed_before(df: DataFrame, key: str, order: list[str], attempts: str, makes: str, half_life: float = 1000.0) -> DataFrame:
    """Add a_before and m_before: sums over the key's earlier rows, each attempt halving older ones after `half_life`.

    With g = 2^(-1/half_life) and C the running attempts, state = g^C * sum(x * g^-C_row). Series of any length keep their
    precision: C is cut into blocks, weights are taken relative to the end of a row's block, and a state is made of its own
    block's earlier rows and the total of the block before; what is older is smaller than any rounding. Ties in
    `order` must be summed beforehand.
    """
    w = Window.partitionBy(key).orderBy(*order)
    size = _BLOCK * half_life
    df = df.withColumn("_c", F.sum(F.col(attempts)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double"))
    df = df.withColumns({"_b": F.floor(F.col("_c") / size), "_p": F.col("_c") - F.col(attempts)})
    grow = F.pow(F.lit(2.0), (F.col("_c") - (F.col("_b") + 1) * size) / half_life)
    own = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(key).orderBy("_b").rangeBetween(-1, -1)
    since = lambda blocks: F.pow(F.lit(2.0), ((F.col("_b") + blocks) * size - F.col("_p")) / half_life)

    def state(c: str) -> Column:
        near = F.coalesce(F.sum(F.col(c) * grow).over(own) * since(1), F.lit(0.0))
        return near + F.coalesce(F.sum(F.col(c) * grow).over(last) * since(0), F.lit(0.0))

    return df.withColumns({"a_before": state(attempts), "m_before": state(makes)}).drop("_c", "_b", "_p")


def shot_priors(shots: DataFrame, skill: Column, key: str = "player_id", order: list[str] | None = None, skill_half_life: float = 1200.0, penalty_half_life: float = 800.0, anchor: float = 150.0, penalty_weight: float = 250.0) -> DataFrame:
    """Add `theta`, `delta` and `expected` to shots (made, assisted; 0 or 1): the state of a player's two tracks before the shot.

    theta is the decayed rate of assisted shots, begun at `skill` with twice the anchor's weight; delta that of what
    unassisted shots fell short of theta, begun at -0.06. An assisted shot is expected at theta, another at theta + delta,
    within [.10, .60]. The tracks are two decayed_before() runs, the second on what the first left.
    """
    order = order or ["game_id", "action_number"]
    seen = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def track(df: DataFrame, flag: Column, value: Column, start: Column, weight: float, half_life: float, name: str) -> DataFrame:
        df = df.withColumns({"_a": flag, "_m": F.when(flag == 1, value).otherwise(0.0)})
        df = decayed_before(df, key, order, "_a", "_m", half_life)
        left = F.pow(F.lit(2.0), -F.coalesce(F.sum("_a").over(seen), F.lit(0)) / half_life) * weight
        return df.withColumn(name, (start * left + F.col("m_before")) / (left + F.col("a_before"))).drop("_a", "_m", "a_before", "m_before")

    made, assisted = F.col("made").cast("double"), F.col("assisted").cast("long")
    out = track(shots, assisted, made, skill, 2 * anchor, skill_half_life, "theta")
    out = track(out, 1 - assisted, made - F.col("theta"), F.lit(-0.06), penalty_weight, penalty_half_life, "delta")
    rate = F.when(assisted == 1, F.col("theta")).otherwise(F.col("theta") + F.col("delta"))
    return out.withColumn("expected", F.greatest(F.least(rate, F.lit(0.60)), F.lit(0.10)))


def starting_skill(free_throw_rate: Column, league: float = 0.36, default_rate: float = 0.75) -> Column:
    """A newcomer's three-point rate: midway between a rookie's (the league's less .02) and what the free throws suggest."""
    return ((league - 0.02) + (F.coalesce(free_throw_rate, F.lit(default_rate)) * 0.5 - 0.02)) / 2.0


def career_rates(seasons: DataFrame, player: str, attempts: str, makes: str, name: str = "rate") -> DataFrame:
    """Per player the rate over all seasons; players without attempts are left out."""
    sums = seasons.where(F.col(player) > 0).groupBy(player).agg(F.sum(attempts).alias("_a"), F.sum(F.coalesce(makes, F.lit(0))).alias("_m"))
    return sums.where("_a > 0").select(player, (F.col("_m") / F.col("_a")).alias(name))


def recent_rate(seasons: DataFrame, player: str, season: str, attempts: str, rate: str, half_life: float = 3.0, default: float = 0.78) -> DataFrame:
    """Per player the mean of season rates, weighted by attempts and recency (relative to the player's last season); players
    without attempts get the default."""
    known = F.col(attempts).isNotNull() & F.col(rate).isNotNull()
    w = recency_weight(F.col(season), F.max(F.when(known, F.col(season))).over(Window.partitionBy(player)), half_life) * F.col(attempts)
    rows = seasons.withColumn("_w", F.when(known, w))
    return rows.groupBy(player).agg(F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col(rate)), F.sum("_w")), F.lit(default)).alias(rate))


def group_share(rows: DataFrame, by: str, part: str, whole: str, default: float = 0.67) -> tuple[DataFrame, DataFrame]:
    """Share of `part` in `whole` per group and over all rows (one row; the default without any)."""
    rows = rows.where(F.col(whole) > 0)
    share = F.try_divide(F.sum(F.coalesce(part, F.lit(0))), F.sum(whole))
    return rows.where(F.col(by) != "").groupBy(by).agg(share.alias("share")), rows.agg(F.coalesce(share, F.lit(default)).alias("share_all"))


def with_default(rows: DataFrame, rates: DataFrame, by: str, overall: DataFrame) -> DataFrame:
    """Add `share`: that of the row's group, else the overall one (a single row)."""
    return rows.join(rates, by, "left").crossJoin(F.broadcast(overall)).withColumn("share", F.coalesce("share", "share_all")).drop("share_all")


def shot_split(rows: DataFrame) -> DataFrame:
    """Catch-and-shoot and pull-up counts and rates of (fg3a, fg3m, catch_a, catch_m): pull-ups are the rest, not below 0;
    rates are null on 0 attempts."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rest = lambda a, c: F.greatest(F.col(a) - zero(c), F.lit(0.0))
    out = rows.withColumns({"pull_a": rest("fg3a", "catch_a"), "pull_m": rest("fg3m", "catch_m")}).withColumns({"catch_a": zero("catch_a"), "catch_m": zero("catch_m")})
    ratio = lambda m, a: F.when(F.col(a) != 0, F.col(m) / F.col(a))
    return out.withColumns({"pull_pct": ratio("pull_m", "pull_a"), "catch_pct": ratio("catch_m", "catch_a"), "catch_share": ratio("catch_a", "fg3a")})


def seeded_state(state: DataFrame, players: DataFrame, careers: DataFrame, reset: bool = False) -> DataFrame:
    """State rows (player_id, attempts, makes) with those of new players begun at their career totals (0 without any); with
    `reset`, everyone begins anew."""
    ids = players.select("player_id").distinct()
    kept = state.where(F.lit(not reset)).select("player_id", "attempts", "makes")
    new = (ids.unionByName(state.select("player_id")).distinct() if reset else ids.join(state.select("player_id"), "player_id", "left_anti")).join(careers, "player_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return kept.select("player_id", F.col("attempts").cast("double"), F.col("makes").cast("double")).unionByName(new.select("player_id", zero("attempts"), zero("makes")))


def recency_weight(season: Column, reference: Column, half_life: float) -> Column:
    return F.exp(F.lit(-math.log(2) / half_life) * (reference - season))


def posterior_table(df: DataFrame, player: str, season: str, attempts: str, makes: str, mu: float, kappa: float, half_life: float = 2.0, z: float = 1.6448536269514722, split: str | None = None, least: float = 0.0, exact: bool = False) -> DataFrame:
    """Recency-weighted attempts and makes, the Beta posterior's mean and its 90 % interval, normal or with `exact` by Beta quantiles; with `split`, one row per
    player and kind of shot of at least `least` weighted attempts, and one of kind 'overall' (the player's sum)."""
    ref = F.max(season).over(Window.partitionBy(player))
    rows = df.withColumn("_w", recency_weight(F.col(season), ref, half_life))
    if split:
        both = rows.withColumn(split, F.explode(F.array(F.col(split), F.lit("overall"))))
        out = both.groupBy(player, split).agg(F.sum(F.col("_w") * F.col(attempts)).alias("attempts"), F.sum(F.col("_w") * F.col(makes)).alias("makes"))
        out = out.where((F.col(split) == "overall") | (F.col("attempts") >= least))
    else:
        out = rows.groupBy(player).agg(F.sum(F.col("_w") * F.col(attempts)).alias("attempts"), F.sum(F.col("_w") * F.col(makes)).alias("makes"))
    a, b = F.lit(mu * kappa) + F.col("makes"), F.lit((1 - mu) * kappa) + F.col("attempts") - F.col("makes")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    if exact:
        return out.withColumns({"mean": a / (a + b), "low": beta_quantiles(0.05, a, b), "high": beta_quantiles(0.95, a, b)})
    return out.withColumns({"mean": a / (a + b), "low": a / (a + b) - z * sd, "high": a / (a + b) + z * sd})


def weighted_line(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted simple regression where weights multiply residuals (effective weight w squared): slope, intercept, and the share
    of variance explained, r2, which uses w itself as weight."""
    ww, c = F.col(w) * F.col(w), F.col
    sums = {"s": ww, "sx": ww * c(x), "sy": ww * c(y), "sxx": ww * c(x) * c(x), "sxy": ww * c(x) * c(y), "v": c(w), "vx": c(w) * c(x), "vy": c(w) * c(y), "vxx": c(w) * c(x) * c(x), "vxy": c(w) * c(x) * c(y), "vyy": c(w) * c(y) * c(y)}
    s = df.agg(*[F.sum(e.cast("double")).alias(n) for n, e in sums.items()])
    slope = (c("s") * c("sxy") - c("sx") * c("sy")) / (c("s") * c("sxx") - c("sx") * c("sx"))
    s = s.withColumn("slope", slope).withColumn("intercept", (c("sy") - c("slope") * c("sx")) / c("s"))
    a, b = c("slope"), c("intercept")
    left = c("vyy") - 2 * a * c("vxy") - 2 * b * c("vy") + a * a * c("vxx") + 2 * a * b * c("vx") + b * b * c("v")
    return s.select("slope", "intercept", (1 - left / (c("vyy") - c("vy") * c("vy") / c("v"))).alias("r2"))


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0: eight steps of its recurrence, then Stirling's series (within 1e-11)."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    return series - F.log(low)


def concentration_likelihood(df: DataFrame, attempts: str, makes: str, mean: Column, kappas: list[float], weight: Column | None = None) -> DataFrame:
    """Beta-binomial log-likelihood (without the constant binomial terms) of each concentration kappa: one row per kappa, summed
    in Spark over all rows; `mean` is the row's expected rate, `weight` how often the row counts."""
    rows = df.select((F.lit(1) if weight is None else weight).alias("n"), F.col(attempts).cast("double").alias("a"), F.col(makes).cast("double").alias("m"), mean.alias("mu"), F.explode(F.array(*[F.lit(float(k)) for k in kappas])).alias("kappa"))
    alpha, beta = F.col("mu") * F.col("kappa"), (1 - F.col("mu")) * F.col("kappa")
    ll = log_gamma(alpha + F.col("m")) + log_gamma(beta + F.col("a") - F.col("m")) - log_gamma(F.col("kappa") + F.col("a")) - log_gamma(alpha) - log_gamma(beta) + log_gamma(F.col("kappa"))
    return rows.groupBy("kappa").agg(F.sum(F.col("n") * ll).alias("log_likelihood"))


def concentration_fit(df: DataFrame, attempts: str, makes: str, mean: Column, low: float = 5.0, high: float = 2000.0, points: int = 24, rounds: int = 3) -> float:
    """The kappa of largest likelihood within [low, high], by a grid on its logarithm that narrows to the best point's neighbours."""
    counts = df.groupBy(F.col(attempts).alias("_a"), F.col(makes).alias("_m"), mean.alias("_mu")).agg(F.count("*").alias("_n"))
    bounds = math.log(low), math.log(high)
    for _ in range(rounds):
        step = (bounds[1] - bounds[0]) / (points - 1)
        grid = [math.exp(bounds[0] + i * step) for i in range(points)]
        best = concentration_likelihood(counts, "_a", "_m", F.col("_mu"), grid, F.col("_n")).orderBy(F.col("log_likelihood").desc(), "kappa").first()
        at = math.log(best["kappa"])
        bounds = max(at - step, math.log(low)), min(at + step, math.log(high))
    return best["kappa"]
