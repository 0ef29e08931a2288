"""Moves and arrears of a credit from the bits of its months, against a walk over its rows in order."""

import random
from collections import Counter

import pytest

from riskloom.operators import panel as B

STATES = "CX012345"


def _months(spark, rows):
    return spark.createDataFrame(rows, "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string")


def _credits(seed=7, n=400):
    """Whole, short and broken windows over all 97 months."""
    rnd, out = random.Random(seed), {}
    for c in range(n):
        share = rnd.choice((1.0, 0.9, 0.5, 0.1))
        first, states = rnd.choice((-96, -80, -63, -62, -61, -5)), rnd.choice((STATES, "01", "1X", "15C", "0CX"))
        months = [m for m in range(first, rnd.choice((first, -62, -61, -60, -3, 0)) + 1) if rnd.random() < share] or [first]
        out[c] = [(m, rnd.choice(states)) for m in months]
    return out


def _walk(rows):
    rows = sorted(rows)
    late = [s in "12345" for _, s in rows]
    pairs = [(s, t) for (m, s), (k, t) in zip(rows, rows[1:]) if k - m == 1]
    after = [t for s, t in pairs if s == "1"]
    first = next((m for m, s in rows if s in "12345"), None)
    return pairs, (
        sum(x and not (i and late[i - 1]) for i, x in enumerate(late)),
        int(bool(after)),
        int(any(t in "2345" for t in after)),
        int(any(t in "0C" for t in after)),
        None if first is None else first - rows[0][0],
    )


def test_paths_of_random_credits(spark):
    credits = _credits()
    panel = _months(spark, [(c, m, s) for c, rows in credits.items() for m, s in rows])
    names = ["episodes", "passed_level_1", "escalated", "cured", "months_to_first_arrears"]
    got = {r["SK_ID_BUREAU"]: tuple(r[n] for n in names) for r in B.arrears_path(panel).collect()}
    assert got == {c: _walk(rows)[1] for c, rows in credits.items()}
    want = Counter(p for rows in credits.values() for p in _walk(rows)[0] if p[0] in "012345")
    from_state = Counter()
    for (s, _), n in want.items():
        from_state[s] += n
    rates = {(r.STATUS, r.next_status): (r.n, r.share) for r in B.roll_rates(panel).collect()}
    assert rates == {(s, t): (n, pytest.approx(n / from_state[s])) for (s, t), n in want.items()}


def test_paths_need_no_sort_of_the_months(spark):
    panel = _months(spark, [(1, -1, "1"), (1, 0, "2")])
    for df in (B.arrears_path(panel), B.roll_rates(panel).select("STATUS", "next_status", "n")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "Sort" not in plan


def test_equal_rows_count_once_and_two_states_of_a_month_fail(spark):
    twice = _months(spark, [(1, -2, "0"), (1, -1, "1"), (1, -1, "1"), (1, 0, "2")])
    assert {(r.STATUS, r.next_status): r.n for r in B.roll_rates(twice).collect()} == {("0", "1"): 1, ("1", "2"): 1}
    assert tuple(B.arrears_path(twice).first())[1:] == (1, 1, 1, 0, 1)
    torn = _months(spark, [(1, -1, "1"), (1, -1, "0"), (1, 0, "2")])
    for df in (B.roll_rates(torn), B.arrears_path(torn)):
        with pytest.raises(Exception, match="two states in one month"):
            df.collect()
    assert B.roll_rates(twice.limit(0)).collect() == [] == B.arrears_path(twice.limit(0)).collect()
