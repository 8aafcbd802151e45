"""Pages for all users are made once for each set of tags."""

from feedloom.plans import insight as ins
from workload.adapter import Tables, as_of

SF = "/root/testdata/sf0.001"


def test_users_of_the_same_tags_share_a_page(spark):
    t = Tables(spark, SF)
    profiles = t.profiles()
    out = ins.diff_all(t.items(), profiles, as_of=as_of(), days=30)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("user_id" in line for line in windows)
    # a user in two rows has one page
    twice = ins.diff_all(t.items(), profiles.unionByName(profiles.limit(5)), as_of=as_of(), days=30)
    rows = lambda df: sorted((r.user_id, r.id, r.pos) for r in df.collect())
    assert rows(out) == rows(twice) and rows(out)
