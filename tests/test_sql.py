import os

import pytest

from voxelspark.plans import sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def test_bricks_decode_in_sql(spark):
    sql.register(spark, SF)
    wrong = "SELECT count(*) AS n FROM (SELECT e.brick_id, d.m, d.label FROM encoded e, LATERAL decode_brick(e.palette, e.packed, 8, {}) d) x FULL JOIN (SELECT * FROM nodes WHERE lod = {}) y ON x.brick_id = y.brick_id AND x.m = y.m WHERE NOT x.label <=> y.label"
    for lod in (0, 2, 3):
        assert spark.sql(wrong.format(lod, lod)).first().n == 0


def test_rays_step_in_sql(spark):
    sql.register(spark)
    got = [tuple(r)[:4] for r in spark.sql("SELECT * FROM ray_steps(-1.0D, 2.5D, 3.5D, 1.0D, 0.001D, 0.001D, 4.0D, 16.0D) ORDER BY seq").collect()]
    assert got == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 0, 0)]
    assert spark.sql("SELECT * FROM ray_steps(-1.0D, 20.0D, 0.0D, 1.0D, 0.001D, 0.001D, 4.0D, 16.0D)").count() == 0
