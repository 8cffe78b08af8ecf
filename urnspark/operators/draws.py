"""Descriptive, prize, sequential and scoring queries over draws.

Each entry is a function of the dialect that gives the SELECT over the lifted views. What must hold before a date is
summed by date first: the calendar bounds the rows of every running window, however many draws there are.
"""

from __future__ import annotations

from math import comb

from urnspark.functions.probability import RANKS, rank_probability
from urnspark.operators.dialect import Dialect

P5 = "(5e0 / 49e0)"
PAIR = comb(47, 3) / comb(49, 5)
LOWER = "CASE rank " + " ".join(f"WHEN {r} THEN {rank_probability(r)!r}" + "e0" * ("e" not in repr(rank_probability(r))) for r, _, _ in RANKS if r > 1) + " END"
P9 = f"{rank_probability(9)!r}e0"
#: Numbers, a spine of 1 to 49.
SPINE = f"spine AS (SELECT CAST(number AS BIGINT) AS number FROM (VALUES {', '.join(f'({i})' for i in range(1, 50))}) AS t(number))"
WIDE = """wide AS (SELECT draw_id, max(CASE WHEN rank = 1 THEN winners END) AS w1, max(CASE WHEN rank = 2 THEN winners END) AS w2, max(CASE WHEN rank = 9 THEN winners END) AS w9,
  max(CASE WHEN rank = 1 THEN payout END) AS p1, max(CASE WHEN rank = 2 THEN payout END) AS p2, max(CASE WHEN rank = 8 THEN payout END) AS p8, max(CASE WHEN rank = 9 THEN payout END) AS p9 FROM prizes GROUP BY draw_id)"""
OBS = f"""obs AS (SELECT d.draw_id, draw_date, game, CASE WHEN w1 > 1 THEN p1 * w1 ELSE p1 END AS jackpot, w9, w9 / {P9} AS tickets, w1, w2, chance
  FROM draws d JOIN wide ON d.draw_id = wide.draw_id WHERE p1 > 0 AND w9 > 0)"""
#: By date: draws before it, and hits of each number before it.
DAYS = "days AS (SELECT draw_date, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM draws GROUP BY draw_date)"
_HITS = f"""{SPINE}, {DAYS}, dayhits AS (SELECT draw_date, number, count(*) AS k FROM draws d JOIN draw_numbers m ON d.draw_id = m.draw_id GROUP BY draw_date, number),
grid AS (SELECT y.draw_date, s.number, y.n, y.h, coalesce(k, 0) AS k FROM days y CROSS JOIN spine s LEFT JOIN dayhits x ON x.draw_date = y.draw_date AND x.number = s.number),
hist AS (SELECT draw_date, number, n, h, k, coalesce(sum(k) OVER (PARTITION BY number ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM grid)"""
#: Stands for _HITS on the checking side, and for the lifted table on Spark's.
HITS = "@hits"
PROB = f"{HITS}, prob AS (SELECT draw_date, number, n, h, 5e0 * (c + 20e0) / (5e0 * h + 49e0 * 20e0) AS p FROM hist WHERE h >= 100)"
HIT = f"""{PROB}, scored AS (SELECT d.draw_id, d.draw_date, sum(p.p) AS hitp FROM draws d JOIN draw_numbers m ON d.draw_id = m.draw_id JOIN prob p ON p.draw_date = d.draw_date AND p.number = m.number GROUP BY d.draw_id, d.draw_date),
square AS (SELECT draw_date, sum(p * p) AS s2, sum(-ln(1e0 - p)) AS lq FROM prob GROUP BY draw_date),
brier AS (SELECT s.draw_id, s.draw_date, (s2 - 2e0 * hitp + 5e0) / 49e0 AS brier FROM scored s JOIN square q ON s.draw_date = q.draw_date)"""


def _q(ctes: str, body):
    return lambda d: (ctes(d) if callable(ctes) else ctes, body(d) if callable(body) else body)


def ROLL(w: int):
    """number, i, draw_date, c: of each date, the draws before it and how many of the last w of them have the number.

    Spark takes the difference of two dates' running counts and corrects it by the draws of the earlier date that stand
    before the window; so no window orders the draws of a number.
    """
    check = f"""{DAYS}, {SPINE}, placed AS (SELECT d.draw_id, y.h + row_number() OVER (PARTITION BY d.draw_date ORDER BY game, d.draw_id) - 1 AS idx FROM draws d JOIN days y ON d.draw_date = y.draw_date),
ev AS (SELECT number, CAST(idx AS BIGINT) AS i, 1 AS v, CAST(NULL AS DATE) AS draw_date FROM placed p JOIN draw_numbers m ON p.draw_id = m.draw_id
  UNION ALL SELECT number, CAST(h AS BIGINT), 0, draw_date FROM days CROSS JOIN spine),
roll AS (SELECT number, i, draw_date, coalesce(sum(v) OVER (PARTITION BY number ORDER BY i RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS c,
  max(CASE WHEN v = 1 THEN i END) OVER (PARTITION BY number ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev)"""
    spark = f"""starts AS (SELECT h AS at, 0 AS kind, draw_date AS u, draw_date, h AS uh FROM days UNION ALL SELECT greatest(h - {w}, 0), 1, NULL, draw_date, NULL FROM days),
held AS (SELECT at, kind, draw_date, last_value(u, true) OVER w AS u, last_value(uh, true) OVER w AS uh FROM starts WINDOW w AS (ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bound AS (SELECT draw_date, u, at - uh AS r FROM held WHERE kind = 1),
part AS (SELECT b.draw_date, number, count(*) AS k FROM bound b JOIN placed p ON p.draw_date = b.u AND p.place < b.r LATERAL VIEW explode(p.numbers) e AS number GROUP BY b.draw_date, number),
roll AS (SELECT x.number, x.h AS i, x.draw_date, x.c - y.c - coalesce(t.k, 0) AS c FROM hist x JOIN bound b ON b.draw_date = x.draw_date JOIN hist y ON y.draw_date = b.u AND y.number = x.number
  LEFT JOIN part t ON t.draw_date = x.draw_date AND t.number = x.number)"""
    return lambda d: spark if d.spark else check


def CHANCE(d):
    """ordered: draw_id, game, draw_date, chance, prev, i: draws of a game in order, and the chance number before.

    Spark counts dates first and joins a draw to the one before by its place; no window orders a whole game.
    """
    if not d.spark:
        return "ordered AS (SELECT draw_id, game, draw_date, chance, lag(chance) OVER (PARTITION BY game ORDER BY draw_date, draw_id) AS prev, row_number() OVER (PARTITION BY game ORDER BY draw_date, draw_id) AS i FROM draws)"
    return """gamedays AS (SELECT game, draw_date, coalesce(sum(count(*)) OVER (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM draws GROUP BY game, draw_date),
inday AS (SELECT d.draw_id, d.game, d.draw_date, chance, h + row_number() OVER (PARTITION BY d.game, d.draw_date ORDER BY draw_id) AS i FROM draws d JOIN gamedays g ON d.game = g.game AND d.draw_date = g.draw_date),
ordered AS (SELECT a.draw_id, a.game, a.draw_date, a.chance, b.chance AS prev, a.i FROM inday a LEFT JOIN inday b ON a.game = b.game AND a.i = b.i + 1)"""


def _rolled(d):
    """Of each draw: the class counts of the last fifty draws of its game, k1 to k10."""
    span = range(1, 11)
    if not d.spark:
        return CHANCE(d) + ", rolled AS (SELECT draw_id, i, " + ", ".join(f"count(CASE WHEN chance = {c} THEN 1 END) OVER (PARTITION BY game ORDER BY i ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS k{c}" for c in span) + " FROM ordered)"
    day = ", ".join(f"coalesce(sum(count_if(chance = {c})) OVER (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b{c}" for c in span)
    run = ", ".join(f"b{c} + count_if(chance = {c}) OVER (PARTITION BY o.game, o.draw_date ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s{c}" for c in span)
    return f"""{CHANCE(d)}, classdays AS (SELECT game, draw_date, {day} FROM draws GROUP BY game, draw_date),
sums AS (SELECT draw_id, o.game, i, {run} FROM ordered o JOIN classdays y ON o.game = y.game AND o.draw_date = y.draw_date),
rolled AS (SELECT a.draw_id, a.i, {", ".join(f"coalesce(b.s{c}, 0) - coalesce(e.s{c}, 0) AS k{c}" for c in span)} FROM sums a
  LEFT JOIN sums b ON a.game = b.game AND a.i = b.i + 1 LEFT JOIN sums e ON a.game = e.game AND a.i = e.i + 51)"""


#: What stands for a name on Spark's side and on the checking side.
PARTS = {"@hits": ("dayhits AS (SELECT draw_date, number, k FROM hist WHERE k > 0)", _HITS)}

#: Features of the five numbers m, in ascending order.
SHAPES = """CAST(size(filter(m, x -> x > 31)) AS DOUBLE) AS high, CASE WHEN m[4] <= 31 THEN 1e0 ELSE 0e0 END AS all_low,
  CAST(size(filter(sequence(1, 4), i -> m[i] - m[i - 1] = 1)) AS DOUBLE) AS adjacent, CAST(size(filter(m, x -> x IN (7, 13))) AS DOUBLE) AS lucky,
  round((m[0] + m[1] + m[2] + m[3] + m[4]) / 150e0, 9) AS total, round(abs(m[0] + m[1] + m[2] + m[3] + m[4] - 125) / 100e0, 9) AS off_centre"""

SQL = {
    "main_frequency": _q(
        f"{SPINE}, n AS (SELECT count(*) AS n FROM draws), c AS (SELECT number, count(*) AS hits FROM draw_numbers GROUP BY number)",
        f"SELECT s.number, coalesce(hits, 0) AS hits, round(n * {P5}, 9) AS expected, round((coalesce(hits, 0) - n * {P5}) / sqrt(n * {P5} * (1e0 - {P5})), 9) AS z FROM spine s CROSS JOIN n LEFT JOIN c ON s.number = c.number",
    ),
    "main_chi_square": _q(
        f"{SPINE}, n AS (SELECT count(*) AS n FROM draws), c AS (SELECT number, count(*) AS hits FROM draw_numbers GROUP BY number)",
        lambda d: f"SELECT {d.big('max(n)')} AS n_draws, {d.big('count(*)')} AS cells, round(sum(pow(coalesce(hits, 0) - n * {P5}, 2) / (n * {P5})), 6) AS chi_square FROM spine s CROSS JOIN n LEFT JOIN c ON s.number = c.number",
    ),
    "chance_frequency": _q("n AS (SELECT count(*) AS n FROM draws)", "SELECT chance, count(*) AS hits, round((count(*) - max(n) / 10e0) / sqrt(max(n) * 0.09e0), 9) AS z FROM draws CROSS JOIN n GROUP BY chance"),
    "chance_chi_square": _q("n AS (SELECT count(*) AS n FROM draws), c AS (SELECT chance, count(*) AS hits FROM draws GROUP BY chance)", lambda d: f"SELECT {d.big('max(n)')} AS n_draws, round(sum(pow(hits - n / 10e0, 2) / (n / 10e0)) + (10 - count(*)) * max(n) / 10e0, 6) AS chi_square FROM c CROSS JOIN n"),
    "pair_counts": _q("", "SELECT a.number AS a, b.number AS b, count(*) AS hits FROM draw_numbers a JOIN draw_numbers b ON a.draw_id = b.draw_id AND a.number < b.number GROUP BY a.number, b.number"),
    "pair_z_topk": _q(
        f"{SPINE}, n AS (SELECT count(*) AS n FROM draws), c AS (SELECT a.number AS a, b.number AS b, count(*) AS hits FROM draw_numbers a JOIN draw_numbers b ON a.draw_id = b.draw_id AND a.number < b.number GROUP BY a.number, b.number), z AS (SELECT x.number AS a, y.number AS b, coalesce(hits, 0) AS hits, round((coalesce(hits, 0) - n * {PAIR!r}e0) / sqrt(n * {PAIR!r}e0 * {1 - PAIR!r}e0), 9) AS z FROM spine x JOIN spine y ON x.number < y.number CROSS JOIN n LEFT JOIN c ON c.a = x.number AND c.b = y.number)",
        "SELECT a, b, hits, z FROM z ORDER BY abs(z) DESC, a, b LIMIT 20",
    ),
    # The draw before is sought within the day, else on the day before: no window spans all draws.
    "lag_overlap": _q(
        """seq AS (SELECT draw_id, draw_date, row_number() OVER (PARTITION BY draw_date ORDER BY game, draw_id) AS r, count(*) OVER (PARTITION BY draw_date) AS c FROM draws),
days AS (SELECT draw_date, lag(draw_date) OVER (ORDER BY draw_date) AS before, lag(n) OVER (ORDER BY draw_date) AS nb FROM (SELECT draw_date, count(*) AS n FROM draws GROUP BY draw_date) t),
prev AS (SELECT s.draw_id, CASE WHEN s.r > 1 THEN s.draw_date ELSE y.before END AS pd, CASE WHEN s.r > 1 THEN s.r - 1 ELSE y.nb END AS pr FROM seq s JOIN days y ON s.draw_date = y.draw_date),
linked AS (SELECT p.draw_id, q.draw_id AS prev_id FROM prev p JOIN seq q ON p.pd = q.draw_date AND p.pr = q.r),
o AS (SELECT l.draw_id, count(b.number) AS overlap FROM linked l JOIN draw_numbers a ON a.draw_id = l.draw_id LEFT JOIN draw_numbers b ON b.draw_id = l.prev_id AND b.number = a.number GROUP BY l.draw_id)""",
        "SELECT count(*) AS n_pairs, round(avg(overlap), 9) AS mean_overlap, round(25e0 / 49e0, 9) AS expected FROM o",
    ),
    "games_summary": _q("", lambda d: f"SELECT game, count(*) AS n_draws, min(draw_date) AS first_date, max(draw_date) AS last_date, {d.big('count(DISTINCT draw_date)')} AS n_dates FROM draws GROUP BY game"),
    "database_info": _q("", lambda d: "SELECT game, 'current' AS regime, count(*) AS n_draws, min(draw_date) AS first_date, max(draw_date) AS last_date FROM draws GROUP BY game"),
    "dedup_draws": _q(
        "u AS (SELECT draw_id, game, draw_date, chance, 1 AS seq FROM draws UNION ALL SELECT draw_id, game, draw_date, chance, 2 FROM draws WHERE draw_id % 3 = 0)",
        lambda d: "SELECT draw_id, game, draw_date, chance, seq FROM (SELECT u.*, row_number() OVER (PARTITION BY draw_id, game, draw_date, chance ORDER BY seq DESC) AS rn FROM u) t WHERE rn = 1",
    ),
    "prize_pivot": _q(WIDE, "SELECT * FROM wide"),
    "complete_prize_draws": _q("c AS (SELECT draw_id FROM prizes WHERE payout IS NOT NULL GROUP BY draw_id HAVING count(DISTINCT rank) = 9)", "SELECT game, count(*) AS n FROM draws d JOIN c ON d.draw_id = c.draw_id GROUP BY game"),
    "lower_rank_ev": _q("c AS (SELECT draw_id FROM prizes WHERE payout IS NOT NULL GROUP BY draw_id HAVING count(DISTINCT rank) = 9)", f"SELECT p.draw_id, round(sum({LOWER} * payout), 9) AS lower_ev FROM prizes p JOIN c ON p.draw_id = c.draw_id WHERE rank > 1 GROUP BY p.draw_id"),
    "mean_code_pool": _q("codes AS (SELECT game, CASE WHEN draw_id % 6 = 0 THEN NULL ELSE draw_id % 11 END AS w, CASE WHEN draw_id % 6 = 0 THEN NULL ELSE 20000e0 + tp % 1000 END AS p FROM draws)", "SELECT game, coalesce(avg(CASE WHEN w > 0 AND p > 0 THEN w * p END), 0e0) AS mean_pool FROM codes GROUP BY game"),
    "participation_observations": _q(f"{WIDE}, {OBS}", "SELECT draw_id, draw_date, game, jackpot, w9 AS rank_9_winners, round(tickets, 6) AS tickets FROM obs"),
    "participation_features": _q(
        f"{WIDE}, {OBS}",
        lambda d: f"SELECT draw_id, round(ln(1e0 + jackpot) / 20e0, 9) AS log_jackpot, round(pow(ln(1e0 + jackpot) / 20e0, 2), 9) AS log_jackpot_sq, round({d.days('draw_date')} / 3652e0, 9) AS trend, round(sin(2e0 * pi() * month(draw_date) / 12e0), 9) + 0e0 AS month_sin, round(cos(2e0 * pi() * month(draw_date) / 12e0), 9) + 0e0 AS month_cos, {d.big(d.weekday('draw_date'))} AS weekday, CASE WHEN game = 'loto' THEN 1 ELSE 0 END AS is_loto FROM obs",
    ),
    # Medians at three levels: game and weekday with ten observations, else game with any, else all.
    "segmented_median_baseline": _q(
        lambda d: f"{WIDE}, {OBS}, l AS (SELECT draw_id, game, {d.weekday('draw_date')} AS wd, ln(tickets) AS lt FROM obs), a AS (SELECT game, wd, {d.median('lt')} AS m, count(*) AS n FROM l GROUP BY game, wd), b AS (SELECT game, {d.median('lt')} AS m, count(*) AS n FROM l GROUP BY game), c AS (SELECT {d.median('lt')} AS m FROM l)",
        lambda d: f"SELECT a.game, {d.big('a.wd')} AS weekday, round(CASE WHEN a.n >= 10 THEN a.m WHEN b.n >= 1 THEN b.m ELSE c.m END, 9) AS baseline FROM a JOIN b ON a.game = b.game CROSS JOIN c",
    ),
    # Winners of the five numbers need rank 2 as well; the jackpot alone doesn't.
    "popularity_observations": _q(WIDE, f"SELECT draw_id, w1 AS jackpot_winners, w1 + w2 AS main_winners, round(w9 / {P9} / {comb(49, 5)}e0, 9) AS main_exposure, round(w9 / {P9} / {comb(49, 5) * 10}e0, 9) AS jackpot_exposure FROM wide WHERE w1 IS NOT NULL AND w9 > 0"),
    "popularity_features": _q(
        lambda d: "" if d.spark else "g AS (SELECT draw_id, number, number - lag(number) OVER (PARTITION BY draw_id ORDER BY number) AS gap FROM draw_numbers)",
        lambda d: f"SELECT draw_id, {SHAPES} FROM (SELECT draw_id, array_sort(numbers) AS m FROM draws) t"
        if d.spark
        else "SELECT draw_id, CAST(count(*) FILTER (WHERE number > 31) AS DOUBLE) AS high, CASE WHEN max(number) <= 31 THEN 1e0 ELSE 0e0 END AS all_low, CAST(count(*) FILTER (WHERE gap = 1) AS DOUBLE) AS adjacent, CAST(count(*) FILTER (WHERE number = 7 OR number = 13) AS DOUBLE) AS lucky, round(sum(number) / 150e0, 9) AS total, round(abs(sum(number) - 125) / 100e0, 9) AS off_centre FROM g GROUP BY draw_id",
    ),
    "chance_observations": _q(WIDE, "SELECT d.draw_id, game, chance, w1 AS successes, w1 + w2 AS trials FROM draws d JOIN wide ON d.draw_id = wide.draw_id WHERE w1 >= 0 AND w2 >= 0 AND w1 + w2 > 0"),
    "chance_posterior": _q(
        lambda d: f"{WIDE}, c AS (SELECT CAST(chance AS BIGINT) AS chance FROM (VALUES {', '.join(f'({i})' for i in range(1, 11))}) AS t(chance)), g AS (SELECT DISTINCT game FROM draws), o AS (SELECT game, chance, sum(w1) AS s, sum(w1 + w2) AS t FROM draws d JOIN wide ON d.draw_id = wide.draw_id WHERE w1 >= 0 AND w2 >= 0 AND w1 + w2 > 0 GROUP BY game, chance)",
        "SELECT g.game, c.chance, round((coalesce(s, 0) + 10e0 * 0.1e0) / (coalesce(t, 0) + 10e0), 9) AS share FROM g CROSS JOIN c LEFT JOIN o ON o.game = g.game AND o.chance = c.chance",
    ),
    "smoothed_walk_forward": _q(HIT, "SELECT draw_id, round(brier, 9) AS brier FROM brier"),
    "walk_forward_summary": _q(HIT, f"SELECT count(*) AS n, round(avg(brier), 9) AS brier, round(avg(brier - {5 * 44 / 49 / 49!r}e0), 9) AS delta, round(stddev_samp(brier) / sqrt(count(*)), 9) AS stderr FROM brier"),
    "top5_hits": _q(f"{PROB}, best AS (SELECT draw_date, number, row_number() OVER (PARTITION BY draw_date ORDER BY round(p, 12) DESC, number) AS r FROM prob)", lambda d: f"SELECT d.draw_id, {d.count_if('r <= 5')} AS hits FROM draws d JOIN draw_numbers m ON d.draw_id = m.draw_id JOIN best b ON b.draw_date = d.draw_date AND b.number = m.number GROUP BY d.draw_id"),
    "log_loss": _q(
        f"{PROB}, q AS (SELECT draw_date, sum(-ln(1e0 - p)) AS s FROM prob GROUP BY draw_date), x AS (SELECT d.draw_id, d.draw_date, sum(-ln(p.p) + ln(1e0 - p.p)) AS t FROM draws d JOIN draw_numbers m ON d.draw_id = m.draw_id JOIN prob p ON p.draw_date = d.draw_date AND p.number = m.number GROUP BY d.draw_id, d.draw_date)",
        "SELECT draw_id, round((s + t) / 49e0, 9) AS log_loss FROM x JOIN q ON x.draw_date = q.draw_date",
    ),
    "bayesian_posterior": _q(HITS, f"SELECT draw_date, number, round((c + 200e0 * {P5}) / (h + 200e0), 9) AS p FROM hist"),
    **{f"rolling_frequency_{w}": _q(ROLL(w), f"SELECT draw_date, number, round(c / (CASE WHEN i > {w} THEN {w}e0 ELSE greatest(i, 1) * 1e0 END), 9) AS frequency FROM roll WHERE draw_date IS NOT NULL") for w in (10, 50, 200)},
    "number_gap": _q(lambda d: "roll AS (SELECT draw_date, number, h AS i, seen FROM hist)" if d.spark else ROLL(1)(d), "SELECT draw_date, number, round(ln(1e0 + CASE WHEN seen IS NULL THEN i + 1 ELSE i - seen END) / ln(1e0 + greatest(i, 1)), 9) AS gap FROM roll WHERE draw_date IS NOT NULL"),
    "previous_date_presence": _q(f"{HITS}, lagged AS (SELECT draw_date, number, lag(k) OVER (PARTITION BY number ORDER BY draw_date) AS k FROM hist)", "SELECT draw_date, number, CASE WHEN k > 0 THEN 1 ELSE 0 END AS present FROM lagged WHERE k IS NOT NULL"),
    # Per draw: the class counts of the last fifty draws of the game.
    "chance_rolling": _q(_rolled, "SELECT draw_id, " + ", ".join(f"round((k{c} + 1e0) / (least(i - 1, 50) + 10e0), 9) AS p{c}" for c in range(1, 11)) + " FROM rolled"),
    "chance_transitions": _q(CHANCE, "SELECT game, prev, chance, count(*) AS n, round((count(*) + 2e0) / (sum(count(*)) OVER (PARTITION BY game, prev) + 20e0), 9) AS p FROM ordered WHERE prev IS NOT NULL GROUP BY game, prev, chance"),
    "chance_weekday": _q("", lambda d: f"SELECT game, {d.big(d.weekday('draw_date'))} AS weekday, chance, count(*) AS n FROM draws GROUP BY game, {d.weekday('draw_date')}, chance"),
    "date_folds": _q(
        "dates AS (SELECT DISTINCT draw_date FROM draws), f AS (SELECT draw_date, ntile(5) OVER (ORDER BY draw_date) AS fold FROM dates)",
        "SELECT CAST(fold AS INT) AS fold, min(f.draw_date) AS first_date, max(f.draw_date) AS last_date, count(*) AS n_draws FROM f JOIN draws d ON d.draw_date = f.draw_date GROUP BY fold",
    ),
    "inner_split": _q(
        "dates AS (SELECT draw_date, row_number() OVER (ORDER BY draw_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT draw_date FROM draws) t)",
        lambda d: f"SELECT CASE WHEN i - 1 >= greatest(1, floor(0.8e0 * n)) THEN 'validation' ELSE 'train' END AS part, {d.big('count(*)')} AS n_dates, min(draw_date) AS first_date FROM dates GROUP BY 1",
    ),
    "calibration_bins": _q(
        lambda d: f"{PROB}, long AS (SELECT p.draw_date, p.number, p.p, p.n, coalesce(x.k, 0) AS k FROM prob p LEFT JOIN dayhits x ON x.draw_date = p.draw_date AND x.number = p.number), e AS (SELECT {d.quantiles('round(p, 9)', 10)} AS q FROM prob), b AS (SELECT l.*, greatest(0, least(9, {' + '.join(f'CASE WHEN round(p, 9) > {d.at("q", str(i))} THEN 1 ELSE 0 END' for i in range(2, 11))})) AS bin FROM long l CROSS JOIN e)",
        lambda d: f"SELECT CAST(bin AS INT) AS bin, {d.big('sum(n)')} AS n, round(sum(p * n) / sum(n), 9) AS mean_p, round(sum(k) * 1e0 / sum(n), 9) AS mean_y FROM b GROUP BY bin",
    ),
    "poisson_deviance": _q(f"{WIDE}, {OBS}", f"SELECT draw_id, round(2e0 * (CASE WHEN w1 > 0 THEN w1 * ln(w1 / (tickets / {comb(49, 5) * 10}e0)) ELSE 0e0 END - (w1 - tickets / {comb(49, 5) * 10}e0)), 9) AS deviance FROM obs"),
    "binomial_deviance": _q(
        WIDE,
        "SELECT draw_id, round(2e0 * (CASE WHEN w1 > 0 THEN w1 * ln(w1 / ((w1 + w2) * 0.1e0)) ELSE 0e0 END + CASE WHEN w2 > 0 THEN w2 * ln(w2 / ((w1 + w2) * 0.9e0)) ELSE 0e0 END), 9) AS deviance FROM wide WHERE w1 >= 0 AND w2 >= 0 AND w1 + w2 > 0",
    ),
    # A ticket of 7, 14, 21, 28, 35 and chance 3 against every draw.
    "winning_ranks": _q(
        lambda d: f"h AS (SELECT draw_id, {d.count_if('number IN (7, 14, 21, 28, 35)')} AS m FROM draw_numbers GROUP BY draw_id), r AS (SELECT d.draw_id, CASE WHEN m = 5 THEN 1 WHEN m = 4 THEN 3 WHEN m = 3 THEN 5 WHEN m = 2 THEN 7 END AS main, m, chance = 3 AS c FROM draws d JOIN h ON d.draw_id = h.draw_id)",
        "SELECT CASE WHEN main IS NOT NULL THEN CASE WHEN c THEN main ELSE main + 1 END WHEN c THEN 9 ELSE 0 END AS rank, count(*) AS n FROM r GROUP BY 1",
    ),
    # A draw whose code prizes aren't known has no value. Spark keeps the digits of a small share; the other side writes it out.
    "observed_schedule_ev": _q(
        f"{WIDE}, {OBS}, c AS (SELECT draw_id FROM prizes WHERE payout IS NOT NULL GROUP BY draw_id HAVING count(DISTINCT rank) = 9), l AS (SELECT p.draw_id, sum({LOWER} * payout) AS ev FROM prizes p JOIN c ON p.draw_id = c.draw_id WHERE rank > 1 GROUP BY p.draw_id), lam AS (SELECT obs.*, (obs.draw_id % 11) * (20000e0 + tp % 1000) AS pool, tickets / {comb(49, 5) * 10}e0 AS lam FROM obs JOIN draws d ON obs.draw_id = d.draw_id WHERE obs.draw_id % 6 <> 0)",
        lambda d: f"SELECT l.draw_id, round(l.ev + pool / tickets + {rank_probability(1)!r} * jackpot * ({'CASE WHEN lam = 0 THEN 1e0 ELSE -expm1(-lam) / lam END' if d.spark else '(1e0 - exp(-lam)) / lam'}), 9) AS ev FROM l JOIN lam ON l.draw_id = lam.draw_id",
    ),
    # Forecasts of a ledger stand for draws of even id, scores for those of ids divisible by four.
    "pending_forecasts": _q("forecasts AS (SELECT draw_id, game, draw_date FROM draws WHERE draw_id % 2 = 0), scores AS (SELECT draw_id FROM draws WHERE draw_id % 4 = 0)", "SELECT f.draw_id, game, draw_date FROM forecasts f LEFT JOIN scores s ON f.draw_id = s.draw_id WHERE s.draw_id IS NULL"),
    "cohort_first_100": _q(
        lambda d: "q AS (SELECT game, draw_date, coalesce(sum(count(*)) OVER (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM draws WHERE draw_id % 4 = 0 GROUP BY game, draw_date), s AS (SELECT d.game, d.draw_date, draw_id, h + row_number() OVER (PARTITION BY d.game, d.draw_date ORDER BY draw_id) AS r FROM draws d JOIN q ON d.game = q.game AND d.draw_date = q.draw_date WHERE draw_id % 4 = 0 AND h < 100)"
        if d.spark
        else "s AS (SELECT game, draw_date, draw_id, row_number() OVER (PARTITION BY game ORDER BY draw_date, draw_id) AS r FROM draws WHERE draw_id % 4 = 0)",
        "SELECT game, count(*) AS n, max(draw_date) AS closed_on, max(draw_id) AS last_id FROM s WHERE r <= 100 GROUP BY game",
    ),
    "cohort_alpha": _q("c AS (SELECT game, year(draw_date) AS y, count(*) AS n FROM draws GROUP BY game, year(draw_date)), i AS (SELECT game, y, n, row_number() OVER (PARTITION BY game ORDER BY y) AS i FROM c)", "SELECT game, CAST(y AS INT) AS cohort, n, round(0.05e0 / (i * (i + 1)), 12) AS alpha FROM i"),
}
