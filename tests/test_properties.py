"""Property tests: MERGE and patch against a plain-Python model on random small batches."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import order, orders_df, patch_df
from tidesync.operators import changes

KEY = ["o_orderkey"]
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

statuses = st.sampled_from(["O", "F", "P", None])
keys = st.integers(min_value=0, max_value=30)


def _row(k, status, price):
    return order(k, status=status, price=None if price is None else f"{price}.00")


rows = st.tuples(keys, statuses, st.one_of(st.none(), st.integers(0, 99)))


@SETTINGS
@given(target=st.lists(rows, max_size=12, unique_by=lambda r: r[0]),
       source=st.lists(rows, max_size=12, unique_by=lambda r: r[0]),
       strategy=st.sampled_from(["broadcast", "shuffle"]))
def test_merge_matches_model(spark, target, source, strategy):
    t = orders_df(spark, [_row(*r) for r in target])
    s = orders_df(spark, [_row(*r) for r in source])
    m = changes.merge(t, s, KEY, strategy=strategy)
    model = {r[0]: _row(*r) for r in target}
    model.update({r[0]: _row(*r) for r in source})            # NULLs in the source overwrite
    got = {r["o_orderkey"]: tuple(r) for r in m.result.collect()}
    assert got == model
    tkeys = {r[0] for r in target}
    metrics = m.metrics().first().asDict()
    assert metrics["num_updated_rows"] == sum(1 for r in source if r[0] in tkeys)
    assert metrics["num_inserted_rows"] == sum(1 for r in source if r[0] not in tkeys)
    assert metrics["num_affected_rows"] == len(source)


patch_rows = st.tuples(keys, statuses, st.one_of(st.none(), st.integers(0, 99)))


@SETTINGS
@given(target=st.lists(rows, max_size=12, unique_by=lambda r: r[0]),
       patches=st.lists(patch_rows, max_size=12, unique_by=lambda r: r[0]))
def test_patch_matches_model(spark, target, patches):
    t = orders_df(spark, [_row(*r) for r in target])
    p = patch_df(spark, [(k, None, s, None if pr is None else Decimal(f"{pr}.00"), None, None, None, None, None)
                         for k, s, pr in patches])
    r = changes.patch_update(t, p, KEY)
    model = {row[0]: list(_row(*row)) for row in target}
    outcomes = {}
    for k, s, pr in patches:
        if s is None and pr is None:
            outcomes[k] = "no_fields"
        elif k not in model:
            outcomes[k] = "not_found"
        else:
            outcomes[k] = "applied"
            if s is not None:
                model[k][2] = s                                  # NULL never overwrites
            if pr is not None:
                model[k][3] = Decimal(f"{pr}.00")
    got = {row["o_orderkey"]: list(row) for row in r.result.collect()}
    assert got == model
    assert {o["o_orderkey"]: o["outcome"] for o in r.outcomes.collect()} == outcomes
