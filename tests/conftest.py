from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def turn(idx, role, text, machine=False, ts=None):
    return (idx, role, ts, text, machine)


def make_doc(doc_id, turns, source="claude-code", title="", project="demo", day="2026-07-01", sensitivity="clean"):
    d = dt.date.fromisoformat(day) if day else None
    at = dt.datetime.combine(d, dt.time(10)) if d else None
    return (doc_id, source, doc_id, title, project, at, d, at, sensitivity, "", "", turns)


@pytest.fixture(scope="session")
def docs_of(spark):
    from mnemoframe import schema

    return lambda rows: spark.createDataFrame(rows, schema.DOC)
