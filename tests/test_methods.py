"""The measurement view leaves no generated method to the interpreter."""

from measureaudit import fixtures


def test_methods_stay_within_what_hotspot_compiles(spark, sf_dir):
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    fixtures.entries(spark, sf_dir)
    assert int(spark.conf.get(name)) == 8000
    spark.conf.set(name, "4000")
    fixtures.entries(spark, sf_dir)
    assert int(spark.conf.get(name)) == 4000
    spark.conf.unset(name)
