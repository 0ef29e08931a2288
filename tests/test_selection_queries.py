"""Selection queries over all columns against brute force on the smallest data."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from __spark_entry__ import queries
from riskloom.operators.stages import LateRatioBuilder
from riskloom.plans.presets import table_of
from riskloom.queries.base import clients

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
DECLARED = {("BUREAU_DAYS_CREDIT_MIN", "BUREAU_LOAN_COUNT")}


def corr(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return None
    return float(np.corrcoef(x, y)[0, 1])


def pairs_of(frame, owner):
    """(a, b) -> r of the pairs over the limit, in the band or declared."""
    flag = {c: bool(np.isin(v[~np.isnan(v)], (0, 1)).all()) for c, v in frame.items()}
    low = {c: np.nanmin(v) if (~np.isnan(v)).any() else np.nan for c, v in frame.items()}
    out = {}
    for a, b in combinations(sorted(frame), 2):
        if owner.get(a, "") == owner.get(b, "") and (a, b) not in DECLARED:
            continue
        r, event = corr(frame[a], frame[b]), None
        if flag[a] != flag[b]:
            f, m = (a, b) if flag[a] else (b, a)
            if low[m] >= 0:
                event = corr(frame[f], np.where(np.isnan(frame[m]), np.nan, frame[m] > 0))
        both = flag[a] and flag[b]
        over = abs(r or 0) > (0.5 if both else 0.7) or abs(event or 0) > 0.5
        if over or (not both and abs(r or 0) >= 0.6) or (a, b) in DECLARED:
            out[a, b] = r
    return out


def test_pairs_among_all_numeric_columns(spark):
    df = clients(spark, SF)
    df = LateRatioBuilder().fit(df).transform(df)
    numbers = [c for c, t in df.dtypes if t not in ("string", "boolean") and c not in ("SK_ID_CURR", "TARGET")]
    rows = df.select(*[df[c].cast("double").alias(c) for c in numbers]).toPandas()
    want = pairs_of({c: rows[c].to_numpy(float) for c in numbers}, table_of())
    got = {(r.a, r.b): r.r for r in queries()["R1_redundant_pairs"](spark, SF).collect()}
    assert len(numbers) > 150 and got.keys() == want.keys()
    assert all(got[p] is None if want[p] is None else abs(got[p] - want[p]) < 1e-6 for p in want)
    assert {(r.a, r.b) for r in queries()["R2_resolve_redundancy"](spark, SF).collect()} == want.keys()
