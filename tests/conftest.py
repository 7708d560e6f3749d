from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offertide.settings import Settings
from offertide.sources.files import OFFER_SCHEMA

EVENTS = "account_id string, event string, time double, offer_ref string, amount double, reward double"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cfg():
    return Settings()


@pytest.fixture
def make_events(spark):
    """Flattened log from (account, event, time, offer, amount) tuples."""

    def build(*rows):
        return spark.createDataFrame([(*r, None, None, None)[:6] if len(r) < 6 else r for r in map(_pad, rows)], EVENTS)

    return build


def _pad(row):
    return tuple(row) + (None,) * (6 - len(row))


@pytest.fixture
def make_offers(spark):
    """Catalogue from (id, type, minimum, discount, duration[, channels]) tuples."""

    def build(*rows):
        return spark.createDataFrame(
            [(r[0], r[1], float(r[2]), float(r[3]), float(r[4]), list(r[5]) if len(r) > 5 else ["web", "email"])
             for r in rows], OFFER_SCHEMA)

    return build


def by_key(df, *keys):
    """Rows as {key tuple: row}."""
    return {tuple(r[k] for k in keys): r for r in df.collect()}
