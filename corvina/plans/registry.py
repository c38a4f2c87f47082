"""All named queries: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvina.plans import analytics, deeper, details, further, models, relational
from corvina.session import TABLES, register


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql_query(pair[0]) for name, pair in {**relational.SQL, **analytics.SQL, **models.SQL, **further.SQL, **details.SQL}.items()}
ORACLE: dict[str, str] = {name: pair[1] for name, pair in {**relational.SQL, **analytics.SQL, **models.SQL, **further.SQL, **details.SQL}.items()}
QUERIES.update(analytics.QUERIES)
ORACLE.update(analytics.ORACLE)
QUERIES.update(models.QUERIES)
ORACLE.update(models.ORACLE)
QUERIES.update(further.QUERIES)
ORACLE.update(further.ORACLE)
QUERIES.update(deeper.QUERIES)
ORACLE.update(deeper.ORACLE)
QUERIES.update(details.QUERIES)
ORACLE.update(details.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over parts, ordered by a sort specification, first hundred."""
    return QUERIES["txt1_keyword_search"](spark, sf_dir)
