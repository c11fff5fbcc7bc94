"""Point look-ups in published relations."""

import pytest

from tokenloom.plans.published import Published, find_token


def scanned(df):
    """Rows that the scans of an executed query gave out, and what was pushed to them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    out = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf
        while leaf.children().size():
            leaf = leaf.children().apply(0)
        out.append((leaf.metrics().apply("numOutputRows").value(), leaf.toString()))
    return sum(n for n, _ in out), " ".join(text for _, text in out)


def tokens(spark, n, first=0):
    return spark.range(first, first + n).selectExpr("concat('t', lpad(cast(id as string), 6, '0')) as name", "if(id % 2 = 0, 'colors', 'spacing') as category", "repeat(cast(id as string), 20) as value", "struct(id as c) as at")


def test_a_look_up_reads_one_row_group(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        store.read()
    n = 60_000
    store.publish(tokens(spark, n), group=1 << 16)
    found = find_token(store, "t031234")
    assert [tuple(r)[:2] for r in found.collect()] == [("t031234", "colors")]
    rows, plan = scanned(find_token(store, "t031234"))
    assert 0 < rows < n / 20 and "EqualTo(name,t031234)" in plan
    assert scanned(find_token(store, "t0312345"))[0] == 0  # between two keys: the Bloom filter says no
    assert find_token(store, "t031234", "spacing").count() == 0 and store.find("nothing").count() == 0


def test_versions_are_whole_and_the_newest_counts(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/t")
    store.publish(tokens(spark, 3))
    old = store.read()
    store.publish(tokens(spark, 3, 2))
    assert sorted(r.name for r in store.read().collect()) == ["t000002", "t000003", "t000004"] and old.count() == 3
    store.heads.publish, keep = lambda *_: (_ for _ in ()).throw(OSError("crash")), store.heads.publish
    with pytest.raises(OSError, match="crash"):
        store.publish(tokens(spark, 9))
    assert store.read().count() == 3
    store.heads.publish = keep
    assert store.publish(tokens(spark, 9)) == 3 and store.read().count() == 9
    store.publish(tokens(spark, 0))
    assert store.read().count() == 0 and store.find("t000001").count() == 0 and len(store.heads.names("states")) == 3
