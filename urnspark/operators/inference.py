"""Resampling tests, simulations, hash chains and ticket search over draws.

Chance comes from a hash of (replicate, place), so any task can draw it again after a lost executor, and both dialects
draw the same.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from urnspark.functions.probability import RANKS, any_prize, rank_probability
from urnspark.operators.draws import HIT, PROB, _q
from urnspark.operators.resampling import bits32_sql, resampled

UNIFORM = 5 * 44 / 49 / 49
#: Replicates of a resampling test, and draws of a block.
RUNS, BLOCK = 2000, 20

#: Deltas of the Brier score against chance, placed by date: i counts from 0 with no window over all draws.
DELTAS = f"""{HIT}, sdays AS (SELECT draw_date, coalesce(sum(count(*)) OVER (ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h, sum(count(*)) OVER () AS n FROM brier GROUP BY draw_date),
deltas AS (SELECT CAST(s.h + row_number() OVER (PARTITION BY b.draw_date ORDER BY draw_id) - 1 AS BIGINT) AS i, round(brier - {UNIFORM!r}e0, 12) AS delta, CAST(s.n AS BIGINT) AS n FROM brier b JOIN sdays s ON b.draw_date = s.draw_date),
total AS (SELECT max(n) AS n, avg(delta) AS observed FROM deltas)"""

#: (rank, upper end of its share of the unit interval), in the order of ranks.
_ENDS = [(r, sum(rank_probability(x) for x, _, _ in RANKS if x <= r)) for r, _, _ in RANKS]
_RANK = lambda u: "CASE " + " ".join(f"WHEN {u} < {e:.17e} THEN {r}" for r, e in _ENDS) + " ELSE 0 END"


def _weighed(ends: int) -> str:
    """A Poisson weight of 32 bits: how many of the ends they reach; the ends' rate is the blocks needed over all starts."""
    term = lambda k: f"exp(-rate) * pow(rate, {k}) / {math.factorial(k)}"
    return " + ".join(f"CASE WHEN bits >= floor(({' + '.join(term(j) for j in range(k + 1))}) * 4294967296) THEN 1 ELSE 0 END" for k in range(ends))


def _bootstrap(d):
    """Means of replicates in which every moving block has a Poisson weight from a hash of both; the checking side's."""
    if d.spark:
        return DELTAS
    return f"""{DELTAS}, runs AS ({d.series(RUNS)}), rate AS (SELECT max(n) AS n, ceil(max(n) / {BLOCK}.0) / (max(n) - {BLOCK - 1}) AS rate FROM deltas),
blocks AS (SELECT i AS s, sum(delta) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING) AS v FROM deltas),
drawn AS (SELECT r.x AS r, v, rate, {bits32_sql("r.x", "s", 1)} AS bits FROM blocks CROSS JOIN runs r CROSS JOIN rate WHERE s <= n - {BLOCK}),
means AS (SELECT r, sum(w * v) / sum(w * {BLOCK}) AS mean FROM (SELECT r, v, {_weighed(6)} AS w FROM drawn) t GROUP BY r)"""


def _signs(d):
    if d.spark:
        return DELTAS
    return f"""{DELTAS}, runs AS ({d.series(RUNS)}), sums AS (SELECT i // {BLOCK} AS j, sum(delta) AS v, max(n) AS n FROM deltas GROUP BY 1),
means AS (SELECT x AS r, sum(CASE WHEN {bits32_sql("x", "j", 2)} % 2 = 1 THEN v ELSE -v END) / max(n) AS mean FROM sums CROSS JOIN runs GROUP BY x)"""


def resampled_deltas(deltas: DataFrame) -> DataFrame:
    """n, observed, low, high, p_lower of the Brier scores' deltas, by place."""
    return resampled(deltas, [], "delta", "i", replicates=RUNS, block=BLOCK)


def _chance_runs(d):
    """Each replicate deals every draw a chance number; a cell that none got counts with its expectation."""
    return f"""n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM draws), runs AS ({d.series(100)}), seen AS (SELECT chance, count(*) AS k FROM draws GROUP BY chance),
observed AS (SELECT sum(pow(k - n / 10e0, 2) / (n / 10e0)) + (10 - count(*)) * max(n) / 10e0 AS chi FROM seen CROSS JOIN n),
dealt AS (SELECT x AS r, {d.random("concat('chance-', CAST(x AS VARCHAR(20)), '-', CAST(draw_id AS VARCHAR(20)))")} % 10 AS c, count(*) AS k FROM draws CROSS JOIN runs GROUP BY 1, 2),
sims AS (SELECT r, sum(pow(k - n / 10e0, 2) / (n / 10e0)) + (10 - count(*)) * max(n) / 10e0 AS chi FROM dealt CROSS JOIN n GROUP BY r)"""


def _bankroll(d):
    """A ticket for every draw in each of fifty runs; ranks by their odds, payouts by their means."""
    u = d.random("concat('run-', CAST(x AS VARCHAR(20)), '-', CAST(draw_id AS VARCHAR(20)))")
    return f"""runs AS ({d.series(50)}), pay AS (SELECT rank, avg(payout) AS payout FROM prizes GROUP BY rank),
tries AS (SELECT r, rank, count(*) AS k FROM (SELECT x AS r, {_RANK(f"{u} / 4294967296e0")} AS rank FROM draws CROSS JOIN runs) t GROUP BY r, rank),
nets AS (SELECT r, sum(k * coalesce(payout, 0e0)) - 2.2e0 * sum(k) AS net FROM tries LEFT JOIN pay ON tries.rank = pay.rank GROUP BY r)"""


def crowd(a: list[str]) -> str:
    """The score of five ascending numbers, with the heuristic's fixed weights."""
    gaps = [f"{y} - {x}" for x, y in zip(a, a[1:])]
    total = lambda cs: "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in cs) + ")"
    repeated = total(["(" + " OR ".join(f"{a[i]} % 10 = {a[j]} % 10" for j in range(i)) + ")" for i in range(1, 5)])
    return f"""1.2e0 * {total(f"{x} > 31" for x in a)} - CASE WHEN {a[4]} <= 31 THEN 5e0 ELSE 0e0 END - 1.5e0 * {total(f"{g} = 1" for g in gaps)}
- CASE WHEN {" AND ".join(f"{g} = {gaps[0]}" for g in gaps[1:])} THEN 4e0 ELSE 0e0 END - 0.5e0 * {repeated} - 0.4e0 * {total(f"{x} IN (7, 13)" for x in a)}"""


_FIVE = """placed AS (SELECT draw_id, number, row_number() OVER (PARTITION BY draw_id ORDER BY number) AS r FROM draw_numbers),
five AS (SELECT draw_id, max(CASE WHEN r = 1 THEN number END) AS a, max(CASE WHEN r = 2 THEN number END) AS b, max(CASE WHEN r = 3 THEN number END) AS c, max(CASE WHEN r = 4 THEN number END) AS d, max(CASE WHEN r = 5 THEN number END) AS e FROM placed GROUP BY draw_id)"""

#: A chain per game and hundred records of a year and month: bounded, however many draws there are.
_CHAIN = """seq AS (SELECT draw_id, game, chance, year(draw_date) * 100 + month(draw_date) AS period, row_number() OVER (PARTITION BY game, year(draw_date), month(draw_date) ORDER BY draw_date, draw_id) - 1 AS r FROM draws),
records AS (SELECT game, period, CAST(floor(r / 100e0) AS BIGINT) AS cohort, CAST(r AS BIGINT) AS r, concat('{"chance":', CAST(chance AS VARCHAR(20)), ',"draw_id":', CAST(draw_id AS VARCHAR(20)), ',"game":"', game, '"}') AS record FROM seq)"""


def _chained(d):
    """The hash of a chain: each record is hashed with the hash before it."""
    if d.spark:
        return f"{_CHAIN}, chains AS (SELECT game, period, cohort, transform(array_sort(collect_list(struct(r, record))), x -> x.record) AS rs FROM records GROUP BY game, period, cohort)"
    return f"{_CHAIN}, chains AS (SELECT game, period, cohort, list(record ORDER BY r) AS rs FROM records GROUP BY game, period, cohort)"


def _chain_hash(d):
    head = "aggregate(rs, '', (a, x) -> sha2(concat(a, x), 256))" if d.spark else "list_reduce(list_concat([''], rs), lambda a, x: sha256(a || x))"
    return f"SELECT game, CAST(period AS INT) AS period, cohort, {d.big('array_size(rs)' if d.spark else 'len(rs)')} AS n_records, {head} AS head FROM chains"


SQL = {
    "brier_deltas": _q(DELTAS, "SELECT i, delta FROM deltas"),
    "block_bootstrap_ci": _q(_bootstrap, lambda d: f"SELECT max(n) AS n, round(max(observed), 9) AS observed, round({d.quantile('mean', 0.025)}, 9) AS low, round({d.quantile('mean', 0.975)}, 9) AS high FROM means CROSS JOIN total"),
    "block_sign_permutation": _q(_signs, lambda d: f"SELECT max(n) AS n, round(max(observed), 9) AS observed, round(({d.count_if('mean <= observed + 1e-12')} + 1e0) / {RUNS + 1}e0, 9) AS p_value FROM means CROSS JOIN total"),
    "chance_monte_carlo": _q(_chance_runs, lambda d: f"SELECT round(max(o.chi), 6) AS chi_square, round(({d.count_if('s.chi >= o.chi')} + 1e0) / 101e0, 9) AS p_value FROM sims s CROSS JOIN observed o"),
    "bankroll_simulation": _q(_bankroll, lambda d: f"SELECT {d.big('count(*)')} AS runs, round(avg(net), 6) AS mean_net, round({d.quantile('net', 0.5)}, 6) AS median_net, round({d.quantile('net', 0.05)}, 6) AS p05_net, round({d.quantile('net', 0.95)}, 6) AS p95_net, round(avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END), 9) AS positive_rate FROM nets"),
    "anti_crowd_scores": _q(_FIVE, f"SELECT draw_id, round({crowd(list('abcde'))}, 9) + 0e0 AS score FROM five"),
    # All tickets by what the last date's smoothed frequencies and the crowd score say of them; a report of the best.
    "ticket_search": _q(
        lambda d: f"{PROB}, latest AS (SELECT max(draw_date) AS t FROM prob), now AS (SELECT {'transform(array_sort(collect_list(struct(number, round(p, 12) AS p))), x -> x.p)' if d.spark else 'list(round(p, 12) ORDER BY number)'} AS ps FROM prob JOIN latest ON draw_date = t), pool AS (SELECT x + 1 AS number FROM ({d.series(49)}) s), fives AS (SELECT a.number AS a, b.number AS b, c.number AS c, d.number AS d, e.number AS e FROM pool a JOIN pool b ON a.number < b.number JOIN pool c ON b.number < c.number JOIN pool d ON c.number < d.number JOIN pool e ON d.number < e.number), tickets AS (SELECT a, b, c, d, e, {' + '.join(d.at('ps', f'CAST({x} AS INT)') for x in 'abcde')} AS hits FROM fives CROSS JOIN now)",
        f"SELECT a, b, c, d, e, round(hits, 9) AS hits, round({crowd(list('abcde'))}, 9) + 0e0 AS crowd FROM tickets ORDER BY round(round(hits, 9) + 0.01e0 * ({crowd(list('abcde'))}), 9) DESC, a, b, c, d, e LIMIT 20",
    ),
    "ledger_chains": _q(_chained, _chain_hash),
    "any_prize_rate": _q("n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM draws)", f"SELECT n AS draws, round(n * {any_prize()!r}e0, 6) AS expected_prizes, round(n * 2.2e0, 6) AS stake FROM n"),
}
