"""Scoring against the rules restated in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from offerlens.operators import score as S

SCHEMA = (
    "comparison_id int, idx bigint, user_context string, product_id string, title string, price string, rating string, "
    "specs array<struct<key:string,value:string>>, bullet_points array<string>"
)


def make_sets(seed=5):
    rng = random.Random(seed)
    rows = []
    for cid in range(40):
        context = rng.choice(["", "steel body steel", "large brand \"note", "café x"])
        for i in range(rng.choice([1, 2, 9, 40])):
            price = rng.choice(["Price unavailable", "R35,99", f"R{rng.randint(1, 400)}.5", f"R {rng.randint(1, 9)},000.00"])
            rating = rng.choice(["N/A", "4.7 of 5", "4,5", f"{rng.randint(20, 50) / 10} stars", "..", "9"])
            specs = [(f"Brand {k}", rng.choice(["steel", "wood\"s", "é"])) for k in range(rng.randint(0, 12))]
            bullets = [rng.choice(["Steel body", "x" * 120, "note"]) for _ in range(rng.randint(0, 3))]
            rows.append((cid, i, context, f"P{cid}_{i}", f"T{i}", price, rating, specs, bullets))
    return rows


def plain(rows):
    loose = []
    for r in rows:
        digits = re.sub(r"[^\d.]", "", r[5])
        try:
            loose.append(float(digits) if digits else 0.0)
        except ValueError:
            loose.append(0.0)
    positive = [p for p in loose if p > 0]
    low, high = (min(positive), max(positive)) if positive else (100.0, 1000.0)
    out = []
    for r, price in zip(rows, loose):
        _, idx, context, pid, title, shown, rating, specs, bullets = r
        specs_score = min(9.5, max(6.0, 7.0 + len(specs) * 0.3))
        value = round(9.5 - (price - low) / (high - low) * 3.5, 1) if high > low else 8.5
        m = re.search(r"[\d.]+", rating)
        try:
            stars = float(m.group()) if m else 4.5
        except ValueError:
            stars = 4.5
        perf = round(min(10.0, stars * 2.0), 1)
        build = round(min(10.0, perf * 0.95 + 0.5), 1)
        text = json.dumps(dict(specs)).lower() + json.dumps(bullets).lower()
        hits = sum(len(t) > 3 and t in text for t in context.lower().split())
        overall = round(min(9.9, perf * 0.35 + value * 0.25 + specs_score * 0.25 + build * 0.15 + min(1.2, hits * 0.4)), 1)
        pros = []
        if price == low and low > 0:
            pros.append(f"Lowest price in comparison matrix ({shown})")
        if stars >= 4.7:
            pros.append(f"Outstanding user satisfaction rating ({stars}/5.0)")
        if len(specs) >= 5:
            pros.append(f"Comprehensive technical specs dataset ({len(specs)} attributes verified)")
        pros += [b if len(b) <= 90 else b[:90] + "..." for b in bullets[:2]]
        if len(pros) < 2:
            pros.append(S.STOCK_PRO)
        top = price == high and high > low
        cons = [f"Highest cost item in selected dataset ({shown})" if top else S.STOCK_CON]
        out.append((pid, idx, value, perf, build, overall, pros[:3], cons, title, shown))
    return out


@pytest.fixture(scope="module")
def both(spark):
    rows = make_sets()
    scored = S.score(spark.createDataFrame(rows, SCHEMA))
    wanted = {}
    for cid in {r[0] for r in rows}:
        wanted[cid] = plain([r for r in rows if r[0] == cid])
    return scored, wanted


def test_scores(both):
    scored, wanted = both
    found = {
        r.product_id: (r.value_score, r.performance_score, r.build_score, r.overall_score, r.pros, r.cons) for r in scored.collect()
    }
    for rows in wanted.values():
        for pid, _, value, perf, build, overall, pros, cons, _, _ in rows:
            assert found[pid] == (value, perf, build, overall, pros, cons)


def test_order_winner_and_best_value(both):
    scored, wanted = both
    places = {(r.comparison_id, r.position): r.product_id for r in S.rank_scored(scored, block=8).collect()}
    verdict = {r.comparison_id: r for r in S.verdicts(scored).collect()}
    for cid, rows in wanted.items():
        order = sorted(rows, key=lambda r: -r[5])
        assert [places[(cid, i + 1)] for i in range(len(order))] == [r[0] for r in order]
        assert verdict[cid].winner_id == order[0][0]
        best = max(order, key=lambda r: r[2])
        assert verdict[cid].best_value_id == best[0]
        assert f"**{best[8]}** ({best[9]})" in verdict[cid].verdict_summary
        assert f"{order[0][5]}/10" in verdict[cid].recommendation_reason


def test_options(spark):
    rows = [
        (1, 0, "", "a", "A", "R35,99", "4.0", [], []),
        (1, 1, "", "b", "B", "R100.00", "4.0", [], []),
        (1, 2, "", "c", "C", "Price unavailable", "4.0", [], []),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    value = lambda **o: {r.product_id: r.value_score for r in S.score(df, **o).collect()}
    assert value()["c"] > 9.5  # an unpriced product counts as free
    assert value(price_source="strict", exclude_unpriced=True) == {"a": 9.5, "b": 6.0}


def test_empty_sets(spark, both):
    asked = spark.createDataFrame([(0,), (999,)], "comparison_id int")
    rows = {r.comparison_id: r for r in S.with_empty_sets(S.verdicts(both[0]), asked).collect()}
    assert rows[999].verdict_summary == S.NO_PRODUCTS and rows[999].winner_id is None
    assert rows[0].winner_id


def test_scores_are_joined_without_texts(spark):
    scored = S.score(spark.createDataFrame(make_sets(), SCHEMA)).select("comparison_id", "product_id", "overall_score")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "specs" not in above.replace("specs_score", "") and "bullet_points" not in above
