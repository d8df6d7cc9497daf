"""Settings of the session that plans read when they run, so operators set them and leave them so."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: bytes of a method beyond which the JVM only interprets it
COMPILED = 8000


def small_methods(spark: SparkSession) -> None:
    """Stages whose generated method the JVM wouldn't compile run as single operators, whose expressions are split into methods that it does.

    A long condition or ``when`` behind a join is generated into the join's own method; scoring the
    1,918,405 pairs of ``er_rule_tiers_turbo`` on check_s took 10.5 s so and 5.2 s with this limit.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > COMPILED:
        spark.conf.set(key, COMPILED)
