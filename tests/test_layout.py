"""Saved facts: lookups read few row groups, the join of members and parameters moves nothing."""

import glob

import pyarrow.parquet as pq
import pytest

from sextant import facts as facts_module
from sextant.facts import SCHEMAS, Facts
from sextant.operators import lookups
from sextant.plans import star

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('facts')}/f"
    facts_module.ROW_GROUP, old = 64 << 10, facts_module.ROW_GROUP
    star.facts(spark, SF).save(path, buckets=8)
    facts_module.ROW_GROUP = old
    return path


@pytest.fixture(scope="module")
def loaded(spark, saved):
    return Facts.load(spark, saved)


def test_lookup_reads_few_row_groups(spark, saved, loaded):
    for table, key in facts_module.CLUSTERED.items():
        wanted = getattr(loaded, table).filter(f"{key} is not null").select(key).first()[0]
        groups, hit, bloom = 0, 0, 0
        for f in glob.glob(saved.removeprefix("file://") + f"/{table}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            k = meta.schema.names.index(key)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(k).statistics
                groups += 1
                hit += bool(s and s.has_min_max and s.min <= wanted <= s.max)
        assert groups >= 4 and 1 <= hit <= 1 + groups // 4, (table, groups, hit)
        plan = getattr(loaded, table).filter(f"{key} = {wanted}")._jdf.queryExecution().toString()
        assert f"EqualTo({key},{wanted})" in plan


def test_member_join_has_no_exchange(spark, loaded):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = loaded.params.join(loaded.members.select("member_id", "type_id"), "member_id")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_same_facts_also_in_a_new_session(spark, saved, loaded):
    full = star.facts(spark, SF)
    other = spark.newSession()
    other.sql(f"DROP TABLE {facts_module._table(saved, 'members')}")  # a catalog that does not know the tables
    again = Facts.load(other, saved)
    for name in SCHEMAS:
        columns = getattr(full, name).columns
        want = sorted(map(repr, getattr(full, name).select(*columns).collect()))
        assert sorted(map(repr, getattr(again, name).select(*columns).collect())) == want, name
    target = again.refs.first().target_id
    assert sorted(map(repr, lookups.references(again, target).collect())) == sorted(map(repr, lookups.references(full, target).collect()))
