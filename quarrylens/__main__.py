"""python -m quarrylens ROOT...: a report on each source tree."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from quarrylens.engine import Engine
from quarrylens.session import local_session


def report(root: str, out=print) -> None:
    spark = local_session()
    result = Engine(spark, root).full_analysis()
    model = result.model
    out(f"# {root}: {result.files_analyzed} files in {result.timing['total_s']:.1f} s")
    for name, value in model.stats().first().asDict().items():
        out(f"{name}: {value}")
    routes = model.facts["interfaces"].agg(
        F.sum(F.when(F.size("parameters") > 0, 1).otherwise(0)).alias("with_parameters"), F.count("handler_name").alias("with_handler"), F.count("request_body_type").alias("with_body")
    ).first()
    out(f"routes: {routes.asDict()}")
    for row in model.facts["env_dependencies"].groupBy("var_name").count().orderBy(F.desc("count"), "var_name").limit(15).collect():
        out(f"env {row.var_name}: {row['count']}")
    for row in model.files.groupBy("file_role").count().orderBy("file_role").collect():
        out(f"role {row.file_role}: {row['count']}")
    for row in model.components().collect():
        out(f"component {row.component}: {row.files} files, {row.dominant_language}")


if __name__ == "__main__":
    for tree in sys.argv[1:]:
        report(tree)
